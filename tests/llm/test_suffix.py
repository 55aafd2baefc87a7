import random
from collections import Counter

import numpy as np
import pytest
from granary.llm import suffix

from tests.llm.conftest import AWKWARD, docs


def plain(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def planted(rng, length):
    word = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    base = [word(rng.randint(length // 2, 6 * length)) for _ in range(6)]
    texts = []
    for _ in range(45):
        b, kind = rng.choice(base), rng.random()
        if kind < 0.2:
            texts.append(b)
        elif kind < 0.6:
            x = list(b)
            for _ in range(rng.randint(1, 5)):
                x[rng.randrange(len(x))] = rng.choice("XYZ")
            texts.append("".join(x))
        else:
            at = rng.randrange(len(b))
            texts.append(word(rng.randint(0, length)) + b[at : at + rng.randint(length - 10, 2 * length)] + word(rng.randint(0, length)))
    return [*texts, "a" * 3 * length, "ab" * 2 * length, "ab" * 2 * length, "é" * length, base[0] * 2, None, "", None]


@pytest.mark.parametrize(("seed", "length", "k", "most"), [(1, 400, 32, 20_000), (2, 400, 32, 2), (3, 64, 8, 20_000), (4, 64, 8, 3)])
def test_removed_bytes_match_brute_force(spark, seed, length, k, most):
    texts = planted(random.Random(seed), length)
    rows = suffix.without_repeats(docs(spark, texts).repartition(3), length=length, k=k, max_cell=most).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows}
    assert [got[i] for i in range(len(texts))] == plain(texts, length)


@pytest.mark.parametrize(("seed", "length", "also", "k", "most"), [(7, 400, 256, 32, 20_000), (8, 64, 40, 8, 20_000), (9, 64, 40, 8, 3), (10, 64, 40, 8, 2)])
def test_two_lengths_in_one_pass_match_brute_force(spark, seed, length, also, k, most):
    texts = planted(random.Random(seed), also) + planted(random.Random(seed), length)
    rows = suffix.without_repeats(docs(spark, texts).repartition(3), length=length, k=k, max_cell=most, also=also).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]), r["n_repeated"]) for r in rows}
    assert [got[i] for i in range(len(texts))] == [(*x, y[1]) for x, y in zip(plain(texts, length), plain(texts, also))]


def test_runs_of_few_words_stay(spark):
    rng = random.Random(11)
    prose = lambda n, size: " ".join("".join(rng.choice("abcdefgh") for _ in range(size)) for _ in range(n))
    passages = {"words": prose(55, 5), "few": prose(30, 9), "one": "".join(rng.choice("abcdefgh") for _ in range(420)), "fifty": "." + prose(50, 5) + "."}
    texts = [f"{prose(20, 6)} {i}|{p}|{i} {prose(20, 6)}" for p in passages.values() for i in range(2)]
    rows = {r["doc_id"]: r for r in suffix.without_repeats(docs(spark, texts), length=suffix.PASSAGE, words=suffix.WORDS).collect()}
    removed = [[rows[2 * i + j]["n_removed"] for j in range(2)] for i in range(4)]
    assert removed == [[331, 331], [0, 0], [422, 422], [0, 0]]
    assert [rows[i]["n_spans"] for i in range(8)] == [1, 1, 0, 0, 1, 1, 0, 0]
    assert all(bytes(rows[i]["kept"]).decode() == texts[i] for i in (2, 3, 6, 7))
    # Runs that overlap count as one.
    long, shared = prose(56, 5), [r["n_removed"] for r in suffix.without_repeats(docs(spark, texts), length=suffix.PASSAGE).collect()]
    assert sum(x > 0 for x in shared) == 8
    halves = [long, f"1 {long[:300]}.", f"2 .{long[-300:]}"]
    assert {r["doc_id"]: r["n_removed"] for r in suffix.without_repeats(docs(spark, halves), length=suffix.PASSAGE, words=suffix.WORDS).collect()}[0] == len(long)


def test_anchors_lie_in_every_window_also_over_parts(monkeypatch):
    rng = np.random.default_rng(5)
    text = rng.integers(97, 101, 9000, dtype=np.uint8).tobytes()
    whole = dict(suffix.anchors([b"", text, b"x"]))[1]
    monkeypatch.setattr(suffix, "SPAN", 1500)
    assert np.array_equal(dict(suffix.anchors([text]))[0], whole)
    for s in range(0, len(text) - 400, 13):
        assert ((whole >= s) & (whole <= s + 400 - 32)).any()


def test_quicksort_orders_by_group_and_bytes():
    rng = np.random.default_rng(6)
    rows = rng.integers(0, 2, (500, 16), dtype=np.uint8)
    group = rng.integers(0, 5, 500)
    order = suffix.quicksort_order(group, suffix._tokens(rows))
    keys = [(int(group[i]), rows[i].tobytes()) for i in order]
    assert keys == sorted(keys)


def test_filter_holds_what_was_put_in(spark):
    from granary.llm._common import Tables

    names = [-(2**63), -1, 0, 1, 32767, 32768, 32769, 2**62 + 12345]
    bits = suffix._filter_bits(Tables(spark, "t"), spark.createDataFrame([(n,) for n in names], "t1 long"))
    assert all(suffix._in(bits, n) for n in names)
    assert sum(suffix._in(bits, n + 777) for n in names) == 0


def test_awkward_rows(awkward, empty):
    got = suffix.without_repeats(awkward)
    assert got.columns == ["doc_id", "lang", "source", "id", "n", "n_bytes", "n_removed", "n_spans", "kept"]
    rows = got.collect()
    assert len(rows) == len(AWKWARD)
    long = next(r for r in rows if r["doc_id"] == 5)
    assert (long["n_removed"], long["n_spans"]) == (1000, 1)  # é is two bytes, so shifts by two repeat
    assert bytes(long["kept"]).decode() == " ß 日本語"
    assert {bytes(r["kept"]) for r in rows if r["doc_id"] == 2} == {b""}
    assert suffix.without_repeats(empty).collect() == []


def test_kept_text_has_whole_code_points(spark):
    texts = ["aé" * 30 + "x" * 9, "y" * 9 + "\u00e9a" * 30, "é" * 3]
    rows = {r["doc_id"]: r for r in suffix.without_repeats(docs(spark, texts), length=64, k=8, as_text=True).collect()}
    raw = {r["doc_id"]: bytes(r["kept"]) for r in suffix.without_repeats(docs(spark, texts), length=64, k=8).collect()}
    assert {i: r["kept"] for i, r in rows.items()} == {i: b.decode("utf-8", "ignore") for i, b in raw.items()} and rows[0]["n_removed"] > 0
