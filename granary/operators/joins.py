"""Audited joins: strict two-sided joins, allowlists, two-level lookups, missing keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def strict_join(left: DataFrame, right: DataFrame, key: str, exceptions: DataFrame | None = None) -> DataFrame:
    """Both sides in full with `status`: matched, left_only, right_only, excepted (a left-only key that is listed), repeated.

    A key that a side repeats is `repeated`, once for each side's row count, so nothing multiplies.
    """
    l_n = left.groupBy(key).agg(F.count("*").alias("left_rows"))
    r_n = right.groupBy(key).agg(F.count("*").alias("right_rows"))
    both = l_n.join(r_n, key, "full_outer").na.fill(0, ["left_rows", "right_rows"])
    listed = F.lit(False)
    if exceptions is not None:
        both = both.join(exceptions.select(key).distinct().withColumn("__x", F.lit(True)), key, "left")
        listed = F.col("__x").isNotNull()
    status = F.when((F.col("left_rows") > 1) | (F.col("right_rows") > 1), "repeated").when(F.col("right_rows") == 0, F.when(listed, "excepted").otherwise("left_only")).when(F.col("left_rows") == 0, "right_only").otherwise("matched")
    return both.withColumn("status", status).drop("__x")


def join_statistics(audit: DataFrame) -> DataFrame:
    """One row of counts of a strict join."""
    c = lambda s: F.count_if(F.col("status") == s).alias(s)
    return audit.agg(F.coalesce(F.sum("left_rows"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("right_rows"), F.lit(0)).alias("right_rows"), F.count("*").alias("keys"), *[c(s) for s in ("matched", "left_only", "right_only", "excepted", "repeated")])


def allowlist_audit(rows: DataFrame, allow: DataFrame, domain: str, key: str) -> DataFrame:
    """(domain, listed, found, missing, repeated): how a domain's allowed keys occur in rows."""
    seen = rows.join(allow.select(domain, key), [domain, key], "left_semi").groupBy(domain, key).agg(F.count("*").alias("n"))
    per = allow.select(domain, key).distinct().join(seen, [domain, key], "left")
    return per.groupBy(domain).agg(F.count("*").alias("listed"), F.count("n").alias("found"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") > 1).alias("repeated"))


def two_level(df: DataFrame, lookup: DataFrame, qualified: str, bare: str, key: str, value: str) -> DataFrame:
    """df with the lookup's value for the qualified key, else for the bare one."""
    first = lookup.select(F.col(key).alias("__k1"), F.col(value).alias("__v1"))
    second = lookup.select(F.col(key).alias("__k2"), F.col(value).alias("__v2"))
    out = df.join(first, F.col(qualified) == F.col("__k1"), "left").join(second, F.col(bare) == F.col("__k2"), "left")
    return out.withColumn(value, F.coalesce("__v1", "__v2")).drop("__k1", "__k2", "__v1", "__v2")


def missing(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't stored: only these need work."""
    return rows.join(stored.select(key), key, "left_anti")


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key: an aggregation, so rows are combined before the shuffle."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")


def uncompleted(rows: DataFrame, log: DataFrame, key: str, retry_failures: bool) -> DataFrame:
    """Rows that the log doesn't count as done: any entry is done, or any that didn't fail if failures are tried again."""
    done = log.where("status <> 'failed'") if retry_failures else log
    return missing(rows, done, key)


def hydrated(hits: DataFrame, payload: DataFrame, file_col: str, row_col: str) -> DataFrame:
    """Hits with the rows that they point to; `fault` says why one isn't usable: no_row, other_id, other_document, too_large."""
    p = payload.select(F.col(file_col).alias("__f"), F.col(row_col).alias("__r"), F.col("record_id").alias("payload_id"), F.col("document").alias("payload_document"), "content")
    out = hits.join(p, (F.col("shard") == F.col("__f")) & (F.col("row_index") == F.col("__r")), "left")
    fault = F.when(F.col("__f").isNull(), "no_row").when(~F.col("payload_id").eqNullSafe(F.col("record_id")), "other_id").when(~F.col("payload_document").eqNullSafe(F.col("document")), "other_document").when(F.length("content") > 1_000_000, "too_large")
    return out.withColumn("fault", fault).drop("__f", "__r", "payload_id", "payload_document")


def requested(df: DataFrame, key: str, ids: list[str]) -> DataFrame:
    """Rows of the ids in their order; one that is missing is an error when the result is read."""
    asked = df.sparkSession.createDataFrame(list(enumerate(ids)), "__at long, __id string")
    out = asked.join(df, F.col("__id") == F.col(key).cast("string"), "left")
    return out.withColumn(key, F.when(F.col(key).isNull(), F.raise_error(F.lit("a requested id is missing"))).otherwise(F.col(key))).orderBy("__at").drop("__at", "__id")
