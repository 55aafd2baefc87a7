import random
import zlib

import numpy as np
import pytest
from granary.llm import langid

from tests.llm.conftest import AWKWARD

DATA = "/root/testdata/sf0.001/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA)
    rows = langid.identify(docs, langid.train(docs)).select("doc_id", "lang", "lang_pred", "lang_score", langid.held_out().alias("held")).collect()
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held"] and r["lang"]]
    assert len(held) > 20 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["lang_score"] <= 1 for r in rows)


def test_counts_are_those_of_single_texts():
    texts = ["Ab c", "", "zé\0z", "x" * 40]
    for n_buckets in (256, 1 << 16):
        whole = [np.zeros(n_buckets, int) for _ in texts]
        for bucket, owner in langid.grams(texts, n_buckets):
            for b, o in zip(bucket, owner):
                whole[o][b] += 1
        for t, w in zip(texts, whole):
            alone = np.zeros(n_buckets, int)
            for bucket, _ in langid.grams([t], n_buckets):
                np.add.at(alone, bucket, 1)
            assert (alone == w).all() and w.sum() == sum(max(0, len(t) - n + 1) for n in langid.SIZES)


def test_blocks_do_not_change_counts(monkeypatch):
    texts = ["abc déf " * 50, "x", "ghi " * 99]
    count = lambda: sum((np.bincount(b.astype(int) + 1000 * o.astype(int), minlength=9000) for b, o in langid.grams(texts, 512)), np.zeros(9000, int))
    one = count()
    monkeypatch.setattr(langid, "BLOCK", 16)
    assert (count() == one).all()


def test_sample_is_bounded(spark):
    df = spark.createDataFrame([(i, "abc" if i % 3 else "xyz", "a" if i % 3 else "b") for i in range(3000)], "doc_id long, text string, lang string")
    model = langid.train(df, train_docs=100)
    assert model.langs == ["a", "b"] and langid.score(["abc", "xyz"], model)[0] == ["a", "b"]


@pytest.mark.parametrize("labelled", [True, False])
def test_awkward_rows(spark, awkward, empty, labelled):
    model = langid.train(awkward if labelled else empty)
    got = langid.identify(awkward.withColumn("lang_pred", awkward["n"]), model)
    assert got.columns == [*awkward.columns, "lang_pred", "lang_score"]
    rows = got.collect()
    assert len(rows) == len(AWKWARD)
    assert all((r["lang_pred"], r["lang_score"]) == ("und", 0.0) for r in rows if not labelled or not r["text"] or not r["text"].strip())
    assert langid.identify(empty, model).collect() == []


def test_the_stage_rejects_what_was_never_learned(spark):
    """Other scripts and letter noise go; clean and short texts stay; without floors all of them passed."""
    import corpus_pipeline

    rng = random.Random(4)
    prose = lambda words: " ".join(rng.choices(words, k=120))
    noise = lambda chars: " ".join("".join(rng.choices(chars, k=rng.randint(2, 9))) for _ in range(120))
    one, two = "the of and house water little great people under where".split(), "der und nicht wasser haus klein gross leute unter wo".split()
    rows = [(i, prose(one if i % 2 else two), "en" if i % 2 else "de") for i in range(600)]
    rows += [(1000, noise("абвгдежзиклмнопрст"), "en"), (1001, noise("abcdefghijklmnopqrstuvwxyz"), "de"), (1002, "абв где", None), (1003, "qx zv", "en"), (1004, prose(one), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = dict(corpus_pipeline.STAGES)["language_id"](spark, df, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(600), 1002, 1003, 1004]
    assert langid.train(df).floor is None  # op8_language_id has none


def test_few_held_out_rows_give_no_floor(spark):
    df = spark.createDataFrame([(i, "abc def " * 100, "a") for i in range(40)] + [(99, "где " * 200, None)], "doc_id long, text string, lang string")
    model = langid.with_floors(df, langid.train(df))
    assert model.floor.tolist() == [-np.inf] and langid.score(["где " * 200], model)[0] == ["a"]


def test_predictions_are_those_of_a_plain_naive_bayes(spark):
    """Counts in dictionaries, one text at a time, with integers for the hash: the same language for every text."""
    rng = random.Random(11)
    words = {"a": ["rouge", "été", "maison", "le"], "b": ["rot", "haus", "größe", "das"], "c": ["red", "house", "the"]}
    rows = [(i, " ".join(rng.choices(words[k] + (words[rng.choice("abc")] if rng.random() < 0.4 else []), k=rng.randint(1, 12))), k) for i, k in enumerate(rng.choices("aabc", k=240))]
    rows += [(500, "été rouge haus", None), (501, "THE House!", None), (502, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def buckets(text):
        points = [c if c >= 128 or 97 <= c <= 122 else 32 for c in map(ord, text.lower())]
        out = []
        for n in langid.SIZES:
            for at in range(len(points) - n + 1):
                h = n * 0x9E3779B1 & 0xFFFFFFFF
                for k in range(n):
                    h = ((h ^ points[at + k]) * 0x85EBCA6B) & 0xFFFFFFFF
                    h ^= h >> 15
                out.append((h * 0xC2B2AE35 & 0xFFFFFFFF) >> 16)  # 65,536 buckets
        return out

    train = [r for r in rows if r[1] is not None and r[2] is not None and zlib.crc32(str(r[0]).encode()) % 5]
    counts = {k: {} for k in "abc"}
    for _, text, lang in train:
        for b in buckets(text):
            counts[lang][b] = counts[lang].get(b, 0) + 1
    size = langid.BUCKETS
    total = {k: sum(v.values()) + 0.5 * size for k, v in counts.items()}
    prior = {k: sum(r[2] == k for r in train) / len(train) for k in "abc"}
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, langid.train(df)).collect()}
    for i, text, _ in rows:
        if text is None:
            assert got[i] == "und"
            continue
        own = {k: np.log(prior[k]) + sum(np.log((counts[k].get(b, 0) + 0.5) / total[k]) for b in buckets(text)) for k in "abc"}
        best = max(own.values())
        assert got[i] in [k for k in own if best - own[k] < 1e-3]
