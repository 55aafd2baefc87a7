import random

import numpy as np
from granary.llm import tokencounts, tokens
from tokenizers import Tokenizer

from tests.llm.conftest import AWKWARD, docs


def plain(text, spans, exact):
    offsets = exact.encode(text, add_special_tokens=False).offsets
    data = text.encode()
    ids = exact.encode(text, add_special_tokens=False).ids
    widths, at, rows = tokens.byte_bpe(tokens.vocabulary_path()).widths, 0, []
    for i in ids:
        s, e = at, at + int(widths[i])
        at = e
        while s and data[s] & 0xC0 == 0x80:
            s -= 1
        while e < len(data) and data[e] & 0xC0 == 0x80:
            e += 1
        lo, hi = len(data[:s].decode()), len(data[:e].decode())
        shares = [max(0, min(hi, b) - max(lo, a)) for _, a, b in spans]
        best = max(range(len(spans)), key=lambda k: (shares[k], -k), default=None)
        to = best if best is not None and shares[best] else None
        rows.append((to, to is not None and shares[to] < hi - lo))
    assert len(offsets) == len(rows)
    return rows


def test_attribution_matches_brute_force():
    exact = Tokenizer.from_file(tokens.vocabulary_path())
    bpe = tokens.byte_bpe(tokens.vocabulary_path())
    rng = random.Random(1)
    for _ in range(150):
        text = "".join(rng.choice(["abc", " the", "\n", "\n\n", " ", "é", "日本", "🙂", "12", "x"]) for _ in range(rng.randint(0, 40)))
        cuts = sorted({rng.randint(0, len(text)) for _ in range(rng.randint(0, 12))})
        spans = [(f"s{i}", a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if rng.random() < 0.8]
        to, crossing = tokencounts.attribute(*tokencounts.token_spans(text, bpe.encode(text), bpe.widths), spans)
        assert [(None if t < 0 else int(t), bool(c)) for t, c in zip(to, crossing)] == plain(text, spans, exact)


def test_ties_go_to_the_earlier():
    spans = [("a", 0, 2), ("b", 2, 4)]
    assert tokencounts.attribute(np.array([0, 1, 1]), np.array([4, 4, 3]), spans)[0].tolist() == [0, 1, 0]


def test_counts_sum_up(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = tokencounts.count_tokens(df).groupBy("id").agg({"n_tokens": "sum", "doc_tokens": "max", "n_chars": "sum"}).collect()
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    exact = Tokenizer.from_file(tokens.vocabulary_path())
    assert len(got) == len(texts)
    for r in got:
        assert r["sum(n_tokens)"] == r["max(doc_tokens)"] == len(exact.encode(texts[r["id"]], add_special_tokens=False).ids)
        assert r["sum(n_chars)"] == len(texts[r["id"]])


def test_sections():
    f = tokencounts.lead_body_tail
    assert f("a") == [("lead", 0, 1)]
    assert f("a\nb") == [("lead", 0, 1), ("tail", 2, 3)]
    assert f("a\nb\nc") == [("lead", 0, 1), ("body", 2, 3), ("tail", 4, 5)]
    assert f("\n") == [("lead", 0, 0), ("tail", 1, 1)]


def test_awkward_rows(spark, awkward, empty):
    rows = tokencounts.count_tokens(awkward).collect()
    assert {tuple(r)[1:] for r in rows if r["id"] in (2, 3)} == {("outside", 0, 0, 0, 0)}
    assert len({(r["id"]) for r in rows}) == len({a[0] for a in AWKWARD})
    assert tokencounts.count_tokens(empty).collect() == []
    assert tokencounts.count_tokens(docs(spark, ["ab cd"]), sections=lambda t: []).collect()[0]["section"] == "outside"
