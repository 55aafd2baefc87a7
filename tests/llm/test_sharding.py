import hashlib
from collections import defaultdict

from granary.llm import sharding

from tests.llm.conftest import AWKWARD, docs


def check(rows, limit):
    sizes, counts = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["depth"], r["prefix"], r["page"]] += r["n_bytes"]
        counts[r["depth"], r["prefix"], r["page"]] += 1
    for r in rows:
        key = r["depth"], r["prefix"], r["page"]
        assert sizes[key] == r["shard_bytes"] and (sizes[key] <= limit or counts[key] == 1)
    return sizes


def test_only_large_buckets_are_split(spark):
    texts = ["x" * (i * 37 % 400) for i in range(500)] + ["y" * 5000]
    limit = 3000
    rows = sharding.assign(docs(spark, texts), limit).collect()
    assert len(rows) == len(texts)
    check(rows, limit)
    bits = {i: int(hashlib.md5(f"{i}|{t}".encode()).hexdigest()[:15], 16) for i, t in enumerate(texts)}
    for r in rows:
        assert bits[r["id"]] >> (60 - r["depth"]) == r["prefix"]
        if r["depth"]:
            above = [i for i, h in bits.items() if h >> (61 - r["depth"]) == r["prefix"] >> 1]
            assert sum(len(texts[i]) for i in above) > limit and len(above) > 1


def test_repeated_rows_get_pages(spark):
    df = docs(spark, ["a" * 100] * 1).union(spark.createDataFrame([(7, "b" * 100)] * 25, "doc_id long, text string"))
    rows = sharding.assign(df, 1000).collect()
    sizes = check(rows, 1000)
    assert len(rows) == 26 and len(sizes) == 4 and max(r["page"] for r in rows) == 2


def test_shards_are_written_whole(spark, tmp_path):
    df = docs(spark, ["x" * 300 for _ in range(40)])
    shards = sharding.write_shards(df, 2000, str(tmp_path / "out")).collect()
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 40 and back.select("shard").distinct().count() == len({(r["depth"], r["prefix"], r["page"]) for r in shards})


def test_awkward_rows(awkward, empty):
    rows = sharding.assign(awkward, 20).collect()
    assert len(rows) == len(AWKWARD)
    check(rows, 20)
    assert sharding.assign(empty, 20).collect() == []
