import random

import corpus_pipeline
import pytest
from granary.llm import decontam, langid, suffix

from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_suffix import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean texts of two languages, exact and near copies, a shared passage, a leak, texts without letters, nulls."""
    rng = random.Random(1)
    prose = lambda chars, n: " ".join("".join(rng.choice(chars) for _ in range(rng.randint(2, 9))) for _ in range(n))
    rows = [(i, prose("abcdefgh" if i % 2 else "mnopqrst", 150), "aa" if i % 2 else "bb", "s") for i in range(60)]
    passage, item = prose("abcdefgh", 90), prose("abcdefgh", 40)
    near = rows[5][1].split()
    near[7] = near[7] + "x"
    rows += [(100, rows[3][1], "aa", "s"), (101, " ".join(near), "aa", "s"), (102, prose("abcdefgh", 80) + " " + passage, "aa", "t"), (103, passage + " " + prose("abcdefgh", 80), "aa", "t")]
    rows += [(104, prose("abcdefgh", 50) + " " + item + " " + prose("abcdefgh", 50), "aa", "t"), (105, "12 34 56", None, "t"), (106, None, None, None), (107, "", "aa", "t"), (3, rows[3][1], "aa", "s")]
    path = tmp_path_factory.mktemp("data")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_match_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    f = dict(corpus_pipeline.STAGES)
    after = f["language_id"](spark, docs, folder)
    assert after.columns == docs.columns
    kept = sorted(r["doc_id"] for r in docs.collect() if r["text"] and any(map(str.isalpha, r["text"])))
    assert sorted(r["doc_id"] for r in after.collect()) == kept and langid.UNKNOWN == "und"

    rows = sorted(map(tuple, after.collect()))
    root = plain_components([plain_fingerprint(r[1]) for r in rows])
    expected = sorted(rows[i] for i in sorted(set(root)))
    once = f["simhash_neardup"](spark, after, folder)
    assert once.columns == docs.columns and sorted(map(tuple, once.collect())) == expected
    assert not {100, 101} & {r[0] for r in expected}

    cut = f["suffix_dedup"](spark, once, folder)
    bytes_ = {r[0]: p[3].decode("utf-8", "ignore") for r, p in zip(expected, plain([r[1] for r in expected], suffix.PASSAGE))}
    assert cut.columns == docs.columns and {r["doc_id"]: r["text"] for r in cut.collect()} == {k: t for k, t in bytes_.items() if t}
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect()) and len(bytes_[102]) < 600

    clean = f["decontaminate"](spark, cut, folder)
    assert clean.columns == docs.columns and {r["doc_id"] for r in cut.collect()} - {r["doc_id"] for r in clean.collect()} == {104}

    packed = f["packing"](spark, clean, folder).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in clean.collect()} and decontam.OVERLAP == 0.8
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, folder).collect()) == sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in packed)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
