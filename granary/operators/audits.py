"""Audits of token sequences: every record is measured or has a code that says why not; manifests of what was measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.measures import length_summary, set_digest

#: Failure codes in the order in which they are asked.
CODES = (
    "invalid_codec_target", "cached_target_serialization_mismatch", "empty_codec_target", "framed_target_count_mismatch", "cached_framed_count_mismatch", "target_contains_non_codec_ids",
    "input_label_length_mismatch", "labeled_target_count_mismatch", "labeled_target_id_mismatch", "labels_contain_non_codec_ids",
)
IGNORED = -100


def record_audit(df: DataFrame, low: int, high: int) -> DataFrame:
    """df (tokens array<string>, target string, framed_count, target_ids, input_ids, labels: array<int>) with `failure` and lengths.

    low to high are the codec's ids. Null where nothing is wrong.
    """
    labeled = F.filter("labels", lambda x: x != IGNORED)
    outside = lambda c: F.exists(c, lambda x: ~x.between(low, high))
    tests = (
        (F.coalesce(F.size("tokens"), F.lit(0)) <= 0) | F.exists("tokens", lambda t: F.coalesce(t, F.lit("")) == ""),
        ~F.col("target").eqNullSafe(F.array_join("tokens", "")),
        F.coalesce(F.size("target_ids"), F.lit(0)) <= 0,
        F.size("target_ids") != F.size("tokens"),
        F.col("framed_count").isNotNull() & (F.col("framed_count") != F.size("tokens")),
        outside("target_ids"),
        F.size("input_ids") != F.size("labels"),
        F.size(labeled) != F.size("target_ids"),
        labeled != F.col("target_ids"),
        outside(labeled),
    )
    failure = None
    for name, fails in zip(CODES, tests):
        failure = F.when(fails, name) if failure is None else failure.when(fails, name)
    ok = lambda c: F.when(F.col("failure").isNull(), c)
    return df.withColumn("failure", failure).withColumns({"codec_tokens": ok(F.size("target_ids")), "labeled_tokens": ok(F.size(labeled)), "full_chat_tokens": ok(F.size("input_ids")), "maximum_id": ok(F.array_max("target_ids"))})


def maximum_violations(df: DataFrame, maxima: dict[str, int], key: str) -> DataFrame:
    """(key, metric, value, maximum) of every value over its maximum."""
    long = df.unpivot(key, list(maxima), "metric", "value")
    limit = F.create_map(*[F.lit(x) for k, v in maxima.items() for x in (k, v)])
    return long.withColumn("maximum", F.element_at(limit, F.col("metric"))).where("value > maximum")


def by_split_and_all(df: DataFrame, split: str, value: str, thresholds: tuple[int, ...] = ()) -> DataFrame:
    """A length summary of each split and of `all`, in one pass."""
    return df.rollup(split).agg(*length_summary(value, thresholds=thresholds)).withColumn(split, F.coalesce(split, F.lit("all")))


def length_manifest(df: DataFrame, length: str, ids: str, declared: str | None = None) -> DataFrame:
    """One row: count, shortest, longest, sum, a digest of the ids, and how many lengths are as declared."""
    c = F.col(length)
    extra = [F.count_if(c == F.col(declared)).alias("matching"), F.count_if(~c.eqNullSafe(F.col(declared))).alias("differing")] if declared else []
    return df.agg(F.count("*").alias("n"), F.min(c).alias("shortest"), F.max(c).alias("longest"), F.sum(c).alias("total"), set_digest(ids).alias("ids_digest"), *extra)


def selection_counts(df: DataFrame, chosen: str, policy: str, detail: str) -> DataFrame:
    """How instructions were chosen, and how often the policy's detail was missing."""
    missing = F.coalesce(F.trim(detail), F.lit("")) == ""
    return df.agg(F.count("*").alias("n"), F.count_if(F.col(chosen) == "description").alias("description"), F.count_if(F.col(chosen) == "detail").alias("detail"), F.count_if((F.col(policy) == "detail") & missing).alias("fallbacks"))


def prefix_length(kind: str, value: int | str, count: Column | None = None) -> Column:
    """Tokens before the target: a constant, a field that must be a non-negative integer, or a counted text."""
    if kind == "constant":
        return F.lit(value)
    c = F.col(str(value)) if kind == "field" else count
    return F.when(c.cast("bigint") >= 0, c.cast("bigint")).otherwise(F.raise_error(F.lit("prefix lengths are non-negative integers")))


def index_manifest_faults(stored: dict, expected: dict, legacy: tuple[str, ...] = ()) -> list[str]:
    """Settings in which an index's manifest differs; legacy ones may be missing from it."""
    return sorted(k for k in stored.keys() | expected.keys() if stored.get(k) != expected.get(k) and not (k in legacy and k not in stored))


def registration_faults(tokens: list[str], ids: list[list[int]]) -> list[str]:
    """Tokens that a vocabulary doesn't keep as one id of their own."""
    seen: dict[int, str] = {}
    out = []
    for t, own in zip(tokens, ids):
        if len(own) != 1 or own[0] in seen:
            out.append(t)
        else:
            seen[own[0]] = t
    return out


def mean_absolute_error(a: Column, b: Column) -> Column:
    """Mean difference of two images' bytes (arrays of 0 to 255), from 0 to 1; null if their sizes differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total / (F.lit(255.0) * F.size(a)))
