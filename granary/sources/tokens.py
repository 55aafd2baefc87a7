"""Token caches: Parquet by split, and the strict join of records with their cached sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.readers import asserted


def write_cache(df: DataFrame, path: str) -> None:
    """(sample_index, split, source_line, sample_id, ..., ids array<int>), a folder for each split, in order within files."""
    df.withColumn("body_count", F.size("ids") - 2).withColumn("framed_count", F.size("ids")).repartition("split").sortWithinPartitions("split", "sample_index").write.partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, splits: list[str], expected: dict[str, int] | None = None) -> DataFrame:
    """Rows of the wanted splits, by partition pruning; counts that aren't as expected are errors."""
    known = {"train", "validation", "test"}
    if not splits or len(set(splits)) < len(splits) or set(splits) - known:
        raise ValueError(f"splits must be different and of {sorted(known)}")
    df = spark.read.parquet(path).where(F.col("split").isin(splits))
    if expected is not None:
        got = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
        if wrong := {s: got.get(s, 0) for s in splits if got.get(s, 0) != expected.get(s)}:
            raise ValueError(f"rows of splits: {wrong}")
    return df


def join_cache(records: DataFrame, cache: DataFrame) -> DataFrame:
    """Records and sequences one to one by (split, source_line); a side that is missing, or ids that differ, are errors."""
    r = records.select("*", F.lit(True).alias("__r"))
    c = cache.withColumnRenamed("sample_id", "cached_id").select("*", F.lit(True).alias("__c"))
    both = r.join(c, ["split", "source_line"], "full_outer")
    differs = F.col("__r").isNull() | F.col("__c").isNull() | ~F.col("sample_id").eqNullSafe(F.col("cached_id"))
    return asserted(both, both.where(differs).select("split", "source_line"), "records and cache differ").drop("__r", "__c", "cached_id")
