"""Writing: staged publication, reports, exports, fingerprinted tables, upserts."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.measures import set_digest


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "errorifexists").json(path)


def sorted_json(df: DataFrame) -> DataFrame:
    """One column, value: each row as JSON with its keys in order."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])).alias("value"))


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file on any store: written beside its place, then renamed."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    temporary = spark._jvm.org.apache.hadoop.fs.Path(path + ".part")
    out = fs.create(temporary, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    if not fs.rename(temporary, p):
        raise OSError(f"cannot rename to {path}")


def put_json(spark: SparkSession, path: str, data: object) -> None:
    put_text(spark, path, json.dumps(data, sort_keys=True, indent=2, default=str) + "\n")


def publish(parts: dict[str, DataFrame], path: str, manifest: dict, id_col: str | None = None) -> dict:
    """Write each part as JSON under path with a manifest; refuses an existing path.

    All is written to a staging folder that is then renamed, so readers see everything or nothing.
    """
    spark = next(iter(parts.values())).sparkSession
    fs, place = _fs(spark, path)
    if fs.exists(place):
        raise FileExistsError(path)
    staging = path.rstrip("/") + ".staging"
    fs.delete(_fs(spark, staging)[1], True)
    counts = {}
    for name, df in parts.items():
        sorted_json(df).write.text(f"{staging}/{name}")
        back = spark.read.text(f"{staging}/{name}")
        n = back.agg(F.count("*"), F.sum(F.xxhash64("value").cast("decimal(38,0)"))).first()
        counts[name] = {"rows": n[0], "content_sum": str(n[1] or 0)}
    whole = manifest | {"parts": counts} | ({"id": id_col} if id_col else {})
    put_json(spark, f"{staging}/manifest.json", whole)
    if not fs.rename(_fs(spark, staging)[1], place):
        raise OSError(f"cannot publish {path}")
    return whole


def fingerprint(settings: dict) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def materialized(spark: SparkSession, root: str, settings: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of these settings: read if it has been written whole, else built and written."""
    path = f"{root}/fp={fingerprint(settings)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
        put_json(spark, f"{root}/{fingerprint(settings)}.json", settings)
    return spark.read.parquet(path)


def guard_identity(spark: SparkSession, path: str, settings: dict) -> None:
    """Refuse to go on with a run that was begun with other settings."""
    own = fingerprint(settings)
    if exists(spark, path):
        if (was := spark.read.text(path).first()[0].strip()) != own:
            raise ValueError(f"the run was begun with settings {was}, not {own}")
    else:
        put_text(spark, path, own + "\n")


def upserted(stored: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """stored with rows put in; a row replaces the stored one of its key. Of rows with one key any may win: see first_per_key."""
    return stored.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def per_partition(df: DataFrame, send: Callable[[Iterator], None], batch: int = 64, retries: int = 5) -> None:
    """Send rows in batches to a service, each again if it fails; sends must be idempotent."""

    def run(rows: Iterator) -> None:
        held: list = []

        def flush() -> None:
            for attempt in range(retries):
                try:
                    send(iter(held))
                    return held.clear()
                except Exception:
                    if attempt == retries - 1:
                        raise

        for r in rows:
            held.append(r.asDict(recursive=True))
            if len(held) == batch:
                flush()
        if held:
            flush()

    df.foreachPartition(run)


def write_curve(train: DataFrame, evaluation: DataFrame, path: str) -> None:
    """Steps of both kinds as one CSV folder with a header."""
    train.unionByName(evaluation, allowMissingColumns=True).orderBy("step", "split").coalesce(1).write.option("header", True).csv(path)


def write_ids(df: DataFrame, id_col: str, path: str) -> dict:
    """Sorted ids as text; returns their count and a digest that is the same in any order (set_digest)."""
    ids = df.select(F.col(id_col).cast("string").alias("value"))
    ids.repartitionByRange(8, "value").sortWithinPartitions("value").write.text(path)
    n, digest = ids.agg(F.count("*"), set_digest("value")).first()
    return {"count": n, "id": id_col, "digest": digest}


def log_results(df: DataFrame, path: str) -> None:
    """Append outcomes (with their key and status) to a durable log; each call adds whole files or none. See joins.uncompleted."""
    df.write.mode("append").parquet(path)


def write_predictions(df: DataFrame, name: str, text: str, path: str) -> None:
    """Each row's text in a folder of its own, path/name=<name>: executors write them, and a lost one's are written again."""
    df.select(F.col(name).cast("string").alias("name"), F.col(text).cast("string").alias("value")).write.partitionBy("name").text(path)


def publish_bundle(spark: SparkSession, path: str, files: dict[str, str], sidecar: dict) -> dict:
    """An immutable bundle: its files and a sidecar with their digests, renamed into place in one step.

    A lock beside it, made only if it isn't there, keeps others out; a bundle that is there is never replaced.
    """
    fs, place = _fs(spark, path)
    lock = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + ".lock")
    if any("/" in name or name in ("", ".", "..") for name in files):
        raise ValueError("files of a bundle have plain names")
    fs.create(lock, False).close()
    try:
        if fs.exists(place):
            raise FileExistsError(path)
        staging = path.rstrip("/") + ".staging"
        fs.delete(_fs(spark, staging)[1], True)
        for name, text in files.items():
            put_text(spark, f"{staging}/{name}", text)
        whole = sidecar | {"files": {name: hashlib.sha256(text.encode()).hexdigest() for name, text in files.items()}}
        put_json(spark, f"{staging}/sidecar.json", whole)
        if not fs.rename(_fs(spark, staging)[1], place):
            raise OSError(f"cannot publish {path}")
        return whole
    finally:
        fs.delete(lock, False)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, below a temporary folder, but on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='granary-')}"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def longest(df: DataFrame, length_col: str, tie: str) -> DataFrame:
    return df.orderBy(F.desc(length_col), tie).limit(1)


def quantized(df: DataFrame, vector: str, quantile: float = 0.99) -> DataFrame:
    """The vector column as small integers: values are scaled so that the quantile of magnitudes is 127, and clipped there."""
    bound = df.select(F.explode(F.transform(vector, F.abs)).alias("x")).agg(F.percentile_approx("x", quantile, 10_000)).first()[0] or 1.0
    clip = lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x / bound * 127).cast("int"))).cast("byte")
    return df.withColumn(vector, F.transform(vector, clip)).withColumn("scale", F.lit(bound / 127))
