import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from granary.llm import packing, tokens
from tokenizers import Tokenizer

from tests.llm.conftest import AWKWARD, docs

DATA = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(tokens.vocabulary_path())


def test_fast_ids_are_the_tokenizers_own(spark, exact):
    bpe = tokens.byte_bpe(tokens.vocabulary_path())
    texts = [r[0] for r in spark.read.parquet(DATA).select("text").collect()] + ["", " ", "a<|endoftext|>b", "日本 語  \x00 ß'll 12 345  \n\n x", "a" * 5000, "🙂" * 50, "  ́e"]
    for t in texts:
        ids = bpe.encode(t)
        assert ids.tolist() == exact.encode(t, add_special_tokens=False).ids
        assert bpe.widths[ids].sum() == len(t.encode())


def test_best_fit_is_the_tightest_window():
    rng = random.Random(1)
    for _ in range(20):
        lengths = [rng.randint(1, 32) for _ in range(rng.randint(0, 200))]
        windows, offsets, n = packing.best_fit_decreasing(lengths, 32)
        room, expected = [], []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [r for r in room if r >= lengths[i]]
            if fits:
                room[room.index(min(fits))] -= lengths[i]
            else:
                room.append(32 - lengths[i])
            expected.append(sorted(room))
        used = defaultdict(list)
        for i, w in enumerate(windows):
            used[w].append((offsets[i], lengths[i]))
        assert sorted(used) == list(range(n)) and n == len(room)
        ends = []
        for pieces in used.values():
            at = 0
            for o, size in sorted(pieces):
                assert o == at
                at += size
            ends.append(32 - at)
        assert sorted(ends) == sorted(room) if room else True


def check(rows, texts, exact, capacity=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for key, pieces in by_doc.items():
        ids = np.array([*exact.encode(texts[key] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and 0 < r["length"] <= capacity
            part = ids[at : at + r["length"]]
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["ids"] == part.tolist()
            at += r["length"]
        assert at == len(ids)
    total = 0
    for pieces in by_sequence.values():
        at = 0
        for o, size in sorted(pieces):
            assert o == at
            at += size
        assert at <= capacity
        total += at
    return total / (capacity * len(by_sequence))


def test_round_trip(spark, exact, monkeypatch):
    df = spark.read.parquet(DATA)
    texts = {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    assert check(packing.pack(df).collect(), texts, exact) > 0.97
    monkeypatch.setattr(packing, "BLOCK_PIECES", 30)
    check(packing.pack(df.repartition(2)).collect(), texts, exact)


def test_awkward_rows(awkward, empty):
    rows = packing.pack(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert {(r["length"], tuple(r["ids"])) for r in rows if r["id"] in (2, 3)} == {(1, (1,))}
    assert packing.pack(empty).collect() == [] and "ids" not in packing.pack(awkward, with_ids=False).columns
