"""Run artifacts and landed corpora: file references, exclusions bound to revisions, caption tasks, counters of an indexing run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def resolved(folder: Column, reference: Column) -> Column:
    """(path, fault): a reference resolved beside its sidecar; missing, absolute, or escaping ones have a fault and no path."""
    parts = F.split(reference, "/")
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        up = x == ".."
        kept = F.when(up, F.slice(acc.kept, 1, F.greatest(F.size(acc.kept) - 1, F.lit(0)))).when(x.isin("", "."), acc.kept).otherwise(F.concat(acc.kept, F.array(x)))
        return F.struct(kept.alias("kept"), (acc.out | (up & (F.size(acc.kept) == 0))).alias("out"))

    walked = F.aggregate(parts, start, step)
    fault = F.when(F.coalesce(F.trim(reference), F.lit("")) == "", "missing").when(reference.startswith("/"), "absolute").when(walked.getField("out"), "escapes")
    return F.struct(F.when(fault.isNull(), F.concat(folder, F.lit("/"), F.array_join(walked.getField("kept"), "/"))).alias("path"), fault.alias("fault"))


def referenced(sidecars: DataFrame, files: DataFrame, folder: str, reference: str) -> DataFrame:
    """Sidecars with the files (path and more) that they refer to, and `fault`: missing, absolute, escapes, not_found."""
    rows = sidecars.withColumn("__r", resolved(F.col(folder), F.col(reference)))
    held = files.select(F.col("path").alias("__p"), *[c for c in files.columns if c != "path"], F.lit(True).alias("__there"))
    out = rows.join(held, F.col("__r.path") == F.col("__p"), "left")
    fault = F.coalesce("__r.fault", F.when(F.col("__there").isNull(), F.lit("not_found")))
    return out.withColumn("path", F.col("__r.path")).withColumn("fault", fault).drop("__r", "__p", "__there")


def unexcluded(rows: DataFrame, exclusions: DataFrame, key: str, revision: str, task_revision: str, split: str) -> DataFrame:
    """rows without the keys of the exclusions (key, hf_revision, task_revision, source_split) that are bound to these very revisions and split."""
    bound = exclusions.where((F.col("hf_revision") == revision) & (F.col("task_revision") == task_revision) & (F.col("source_split") == split))
    return rows.join(bound.select(key).distinct(), key, "left_anti")


def landed_split(spark: SparkSession, root: str, revision: str, split: str) -> DataFrame:
    """A pinned revision's split as it was landed: Parquet under root/revision/split."""
    return spark.read.parquet(f"{root.rstrip('/')}/{revision}/{split}")


def caption_tasks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The tasks of one landed JSON array; anything but an array of objects ends the job."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def indexing_counts(scanned: DataFrame, stored: DataFrame, key: str, target: int | None = None) -> DataFrame:
    """One row of an incremental run: rows stored before, scanned, already there, new, and stored after; rows past the target don't count."""
    ids = scanned.select(key).distinct()
    marked = ids.join(stored.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left")
    met = marked.agg(F.count("*").alias("scanned"), F.count("__k").alias("existing"))
    before = stored.select(key).distinct().agg(F.count("*").alias("count_before"))
    new = F.col("scanned") - F.col("existing")
    room = new if target is None else F.least(new, F.greatest(F.lit(target) - F.col("count_before"), F.lit(0)))
    return before.crossJoin(met).withColumn("indexed", room).withColumn("count_after", F.col("count_before") + F.col("indexed"))
