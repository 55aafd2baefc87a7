import json
import sqlite3

import pytest
from granary.plans import prepare
from granary.sources import manifests, readers, sinks, sqlite, tokens
from granary.streaming import ingest
from pyspark.sql import functions as F


def test_mixed_corpus_has_pointers(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2)], "id string, n long").coalesce(1).write.parquet(str(tmp_path / "p"))
    (tmp_path / "x.jsonl").write_text('{"id": "c"}\n\n{"id": "d"}\n')
    found = readers.expand(spark, [f"{tmp_path}/p/*.parquet", f"{tmp_path}/$KIND.jsonl"], {"KIND": "x"})
    rows = sorted((r["id"], r["n"], r["source_row"]) for r in readers.corpus(spark, found).collect())
    assert rows == [("a", 1, 0), ("b", 2, 1), ("c", None, 0), ("d", None, 2)]
    with pytest.raises(FileNotFoundError):
        readers.expand(spark, [f"{tmp_path}/none*"])


def test_projected_scan_reads_two_columns(spark, tmp_path):
    spark.createDataFrame([("a", "x", "k"), ("b", "y", "k")], "id string, description string, svg string").coalesce(1).write.parquet(str(tmp_path / "p"))
    df = readers.projected(spark, [str(tmp_path / "p")], "id", "description", expected_files=1, expected_rows=2, limit=1)
    assert [(r["record_id"], r["row_index"]) for r in df.collect()] == [("a", 0)]
    assert "svg" not in df._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="missing"):
        readers.projected(spark, [str(tmp_path / "p")], "id", "none")
    with pytest.raises(ValueError, match="2 rows"):
        readers.projected(spark, [str(tmp_path / "p")], "id", "svg", expected_rows=3)


def test_faulty_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbad\n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        readers.json_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()
    from pyspark.sql.types import IntegerType, StructField, StructType

    rows = readers.json_lines_with_faults(spark, str(tmp_path / "x.jsonl"), StructType([StructField("a", IntegerType())])).collect()
    assert sorted(r["_corrupt_record"] or "" for r in rows) == ["", "bad"]


def test_allowlists_exclusions_neighbours(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a" * 32 + "\n" + "b" * 32 + "\n")
    assert readers.allowlist(spark, {"icon": str(tmp_path / "a.txt")}, 2).count() == 2
    (tmp_path / "b.txt").write_text("short\n")
    with pytest.raises(ValueError, match="malformed"):
        readers.allowlist(spark, {"icon": str(tmp_path / "b.txt")})
    df = spark.createDataFrame([("1", "AB", ["x", "y"]), ("1", None, None)], "id string, svg_hash string, caption_hashes array<string>")
    assert sorted(tuple(r) for r in readers.exclusions(df).collect()) == [("caption", "x"), ("caption", "y"), ("id", "1"), ("svg", "ab")]
    near = lambda rows: readers.neighbours(spark.createDataFrame(rows, "record_id string, domain string, top3 array<string>"))
    assert {r["key"]: r["retrieved"] for r in near([("1", "d", ["a"]), ("2", None, ["b"])]).collect()} == {"d:1": ["a"], "2": ["b"]}
    for bad in ([("1", "d", ["a"]), ("1", "d", ["b"])], [("1", "d", ["a", "a"])], [("1", "d", list("abcd"))]):
        with pytest.raises(Exception, match="neighbours"):
            near(bad).collect()


def test_manifest_shapes(spark, tmp_path):
    write = lambda name, data: (tmp_path / name).write_text(data if isinstance(data, str) else json.dumps(data)) and str(tmp_path / name)
    shapes = {
        "a.jsonl": '{"sample_id": "1"}\n\n{"metadata": {"dataset_id": "d", "record_id": "2"}}\n', "b.json": ["1", {"sample_id": "2"}], "c.json": {"ids": ["1", "2"]},
        "d.json": {"records": [{"sample_id": "1"}]}, "e.json": {"splits": {"train": {"file": "c.json"}, "test": "d.json"}}, "f.json": {"dataset_id": "d", "id": "9"},
    }
    ids = {n: [manifests.sample_id(r) for r in manifests.manifest_records(spark, write(n, d))] for n, d in shapes.items()}
    assert ids == {"a.jsonl": ["1", "d::2"], "b.json": ["1", "2"], "c.json": ["1", "2"], "d.json": ["1"], "e.json": ["1", "2", "1"], "f.json": ["d::9"]}
    with pytest.raises(ValueError, match="repeats"):
        manifests.identities(spark, {"sft": [str(tmp_path / "e.json")]})
    both = manifests.identities(spark, {"critic": [str(tmp_path / "d.json")], "sft": [str(tmp_path / "c.json")]})
    with pytest.raises(ValueError, match="shares"):
        manifests.disjoint_or_error(both, "critic")
    with pytest.raises(ValueError, match="line 1"):
        list(manifests.manifest_records(spark, write("g.jsonl", "{bad\n")))


def test_configuration(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("SOME_NAME", "v")
    (tmp_path / "c.yaml").write_text("a: {b: 1, c: $SOME_NAME}\nd: [1]\n")
    assert manifests.load_config(spark, str(tmp_path / "c.yaml"), ["a.b=2", "e.f=true"]) == {"a": {"b": 2, "c": "v"}, "d": [1], "e": {"f": True}}
    for bad in (["a"], ["a..b=1"], ["a=1", "a.b=2"]):
        with pytest.raises(ValueError):
            manifests.overrides(bad)
    with pytest.raises(ValueError):
        manifests.PrepareConfig(min_words=5, max_words=2)
    with pytest.raises(ValueError):
        manifests.PrepareConfig.of({"odd": 1})
    manifests.write_atomically(str(tmp_path / "q" / "x"), "t")
    assert (tmp_path / "q" / "x").read_text() == "t"


def test_publication_is_whole_and_not_repeated(spark, tmp_path):
    df = spark.createDataFrame([("b", 1)], "z string, a int")
    path = str(tmp_path / "out")
    manifest = sinks.publish({"train": df, "test": df.limit(0)}, path, {"seed": 1})
    assert manifest["parts"]["train"]["rows"] == 1 and manifest["parts"]["test"]["rows"] == 0
    assert spark.read.text(path + "/train").first()[0] == '{"a":1,"z":"b"}' and json.loads((tmp_path / "out" / "manifest.json").read_text())["seed"] == 1
    with pytest.raises(FileExistsError):
        sinks.publish({"train": df}, path, {})


def test_materialized_once(spark, tmp_path):
    built = []
    build = lambda: built.append(1) or spark.range(3)
    for settings in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert sinks.materialized(spark, str(tmp_path), settings, build).count() == 3
    assert len(built) == 2
    sinks.guard_identity(spark, str(tmp_path / "id"), {"a": 1})
    sinks.guard_identity(spark, str(tmp_path / "id"), {"a": 1})
    with pytest.raises(ValueError, match="begun"):
        sinks.guard_identity(spark, str(tmp_path / "id"), {"a": 2})


def test_upsert_and_quantize(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert sorted(tuple(r) for r in sinks.upserted(a, b, "k").collect()) == [(1, "x"), (2, "z"), (3, "w")]
    q = sinks.quantized(spark.createDataFrame([([0.5, -1.0],)], "v array<double>"), "v").first()
    assert [x * q["scale"] for x in q["v"]] == pytest.approx([0.5, -1.0], abs=0.01)


def test_sqlite_source(spark, tmp_path):
    path = str(tmp_path / "t.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE sequences (sample_index INTEGER PRIMARY KEY, split TEXT, body BLOB)")
        db.executemany("INSERT INTO sequences VALUES (?, ?, ?)", [(i, "train" if i % 2 else "test", bytes([i])) for i in range(10)])
    sqlite.register(spark)
    df = spark.read.format("sqlite").schema("sample_index int, split string, body binary").option("path", path).option("table", "sequences").option("key", "sample_index").load()
    assert df.groupBy("split").count().count() == 2 and df.agg(F.sum("sample_index")).first()[0] == 45


def test_token_cache_join(spark, tmp_path):
    cache = spark.createDataFrame([(0, "train", 0, "a", [1, 2, 3]), (1, "test", 0, "b", [1, 3])], "sample_index int, split string, source_line int, sample_id string, ids array<int>")
    tokens.write_cache(cache, str(tmp_path / "c"))
    assert tokens.read_split(spark, str(tmp_path / "c"), ["train"], {"train": 1}).first()["body_count"] == 1
    for bad in ([], ["train", "train"], ["odd"]):
        with pytest.raises(ValueError):
            tokens.read_split(spark, str(tmp_path / "c"), bad)
    with pytest.raises(ValueError, match="rows of splits"):
        tokens.read_split(spark, str(tmp_path / "c"), ["train"], {"train": 2})
    both = tokens.read_split(spark, str(tmp_path / "c"), ["train", "test"])
    records = spark.createDataFrame([("train", 0, "a"), ("test", 0, "b")], "split string, source_line int, sample_id string")
    assert tokens.join_cache(records, both).count() == 2
    with pytest.raises(ValueError, match="differ"):
        tokens.join_cache(records.replace("b", "x", "sample_id"), both)


def test_positions_and_digests(spark, tmp_path):
    df = spark.range(5).select(F.col("id").alias("p"))
    assert [r["p"] for r in readers.by_position(df, "p", [3, 0, 3]).collect()] == [3, 0, 3]
    with pytest.raises(Exception, match="position is missing"):
        readers.by_position(df, "p", [9]).collect()
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n')
    d = readers.digests(spark, str(tmp_path / "x.jsonl")).first()
    assert readers.checked_snapshot(spark, str(tmp_path / "x.jsonl"), "a int", 1, d["sha256"]).count() == 1
    with pytest.raises(ValueError, match="records"):
        readers.checked_snapshot(spark, str(tmp_path / "x.jsonl"), "a int", 2, d["sha256"])
    with pytest.raises(ValueError, match="repeated"):
        readers.unique_ids(df.union(df), "p")


def test_ingest_stores_each_key_once(spark, tmp_path):
    batch = lambda n, rows: spark.createDataFrame(rows, "k int, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    start = lambda target=None: ingest.ingest(ingest.files(spark, str(tmp_path / "in"), "k int, v string"), str(tmp_path / "out"), "k", str(tmp_path / "cp"), lambda d: d.withColumn("e", F.upper("v")), target).awaitTermination()
    batch(1, [(1, "a"), (2, "b"), (2, "b")])
    start()
    batch(2, [(2, "b"), (3, "c"), (4, "d")])
    start(3)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["k"], r["e"]) for r in rows) == [(1, "A"), (2, "B"), (3, "C")]


def test_preparation(spark, tmp_path):
    svg = lambda i: f'<svg xmlns="http://www.w3.org/2000/svg"><path d="M{i} 0"/></svg>'
    rows = [("icon", f"{i:032x}", f"a drawing of thing {i}", f"detail {i}", svg(i), "f", i) for i in range(12)]
    rows += [("icon", f"{99:032x}", "not on the list", "d", svg(99), "f", 12), ("icon", f"{50:032x}", "a copy", "d", svg(0), "f", 13), ("icon", f"{51:032x}", "unsafe one here", "d", svg(1).replace("<path", "<script/><path"), "f", 14), ("icon", f"{52:032x}", "HELD  out caption", "d", svg(52), "f", 15)]
    df = spark.createDataFrame(rows, "domain string, record_id string, description string, detail string, svg string, source_file string, source_row int")
    allow = df.where(~F.col("record_id").endswith("063")).select("domain", "record_id")
    import hashlib

    out = spark.createDataFrame([("caption", hashlib.sha256(b"held out caption").hexdigest()), ("svg", "none")], "kind string, value string")
    config = manifests.PrepareConfig(train=8, validation=2, test=2)
    manifest = prepare.prepare(df, config, allow, out, "set", str(tmp_path / "out"))
    reasons = {r["reason"]: r["n"] for r in manifest["reasons"]}
    assert (reasons["accepted"], reasons["not_in_sample_allowlist"], reasons["duplicate_svg"], reasons["svg_validation"], reasons["benchmark_exclusion"]) == (12, 1, 1, 1, 1)
    assert {n: p["rows"] for n, p in manifest["parts"].items()} == {"train": 8, "validation": 2, "test": 2}
    record = json.loads(spark.read.text(str(tmp_path / "out" / "train")).first()[0])
    assert record["metadata"]["split"] == "train" and record["metadata"]["svg_path_count"] == 1 and record["task"] == "text_to_svg"
    with pytest.raises(ValueError, match="too few"):
        prepare.prepare(df, manifests.PrepareConfig(train=100, validation=2, test=2), allow, out, "set", str(tmp_path / "out2"))
    with pytest.raises(ValueError, match="allowlist"):
        prepare.prepare(df, config, allow.union(spark.createDataFrame([("icon", "z")], "domain string, record_id string")), out, "set", str(tmp_path / "out3"))
