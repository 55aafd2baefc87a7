"""Aggregates: exact quantiles of two kinds, exceedance, arg-max, histograms, digests, ratios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Consecutive numbers of a block of an ordered digest.
DIGEST_BLOCK = 10_000


def nearest_rank(value: str, q: float) -> Column:
    """The ceil(q * n)-th smallest value, exactly."""
    return F.expr(f"CAST(percentile_disc({q}) WITHIN GROUP (ORDER BY {value}) AS BIGINT)")


def length_summary(value: str, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99), thresholds: tuple[int, ...] = ()) -> list[Column]:
    """count, least, largest, sum, mean, exact quantiles and counts over thresholds of an integer column."""
    c = F.col(value)
    return [
        F.count(c).alias("n"), F.min(c).cast("bigint").alias("min_value"), F.max(c).cast("bigint").alias("max_value"), F.sum(c).cast("bigint").alias("sum_value"), F.round(F.avg(c), 6).alias("mean_value"),
        *[nearest_rank(value, q).alias(f"p{round(q * 100)}") for q in quantiles], *[F.count_if(c > t).alias(f"over_{t}") for t in thresholds],
    ]


def floor_quantiles(df: DataFrame, by: list[str], value: str, quantiles: tuple[float, ...]) -> DataFrame:
    """The value of rank floor(q * (n - 1)), from 0, by counts of values: groups are never collected."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    own = W.partitionBy(*by)
    ranked = counts.select(*by, value, F.sum("c").over(own).alias("n"), F.sum("c").over(own.orderBy(value)).alias("upto"))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.lit(q) * (F.col("n") - 1)), F.col(value))).cast("bigint")
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), *[at(q).alias(f"p{round(q * 100)}") for q in quantiles])


def ceiling_quantiles(df: DataFrame, by: list[str], value: str, quantiles: tuple[float, ...]) -> DataFrame:
    """The value of rank floor(n * q + 1 - 1e-12), from 1: nearest rank by a ceiling that forgives what floats add."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    own = W.partitionBy(*by)
    ranked = counts.select(*by, value, F.sum("c").over(own).alias("n"), F.sum("c").over(own.orderBy(value)).alias("upto"))
    rank = lambda q: F.least(F.greatest(F.floor(F.col("n") * F.lit(q) + F.lit(0.999999999999)), F.lit(1)), F.col("n"))
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("upto") >= rank(q), F.col(value))).cast("bigint").alias(f"p{round(q * 100)}") for q in quantiles])


def median(value: str) -> Column:
    """The middle value, or the mean of the two in the middle."""
    return F.median(value)


def arg_max_first(row: Column, value: Column, order: Column) -> Column:
    """The row of the largest value, of several the first by order (an integer)."""
    return F.max_by(row, F.struct(value, -order))


def exceedance(df: DataFrame, by: list[str], value: str, thresholds: list[int]) -> DataFrame:
    """(by, threshold, at_most, over, over_fraction) for each threshold."""
    over = df.groupBy(*by).agg(F.count(value).alias("n"), *[F.count_if(F.col(value) > t).alias(str(t)) for t in thresholds])
    long = over.unpivot([*by, "n"], [str(t) for t in thresholds], "threshold", "over_count")
    return long.select(*by, F.col("threshold").cast("int").alias("threshold"), (F.col("n") - F.col("over_count")).alias("at_most"), "over_count", F.round(F.try_divide("over_count", "n"), 8).alias("over_fraction"))


def histogram(df: DataFrame, value: str, size: int) -> DataFrame:
    """(value, n) of every value of 0 to size - 1, zeros too."""
    counts = df.where(F.col(value).between(0, size - 1)).groupBy(F.col(value).cast("bigint").alias("value")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(size).select(F.col("id").alias("value")).join(counts, "value", "left").na.fill(0, ["n"])


def coverage(hist: DataFrame) -> DataFrame:
    """One row: values, seen, missing, and the share seen."""
    return hist.agg(F.count("*").alias("size"), F.count_if(F.col("n") > 0).alias("seen"), F.count_if(F.col("n") == 0).alias("absent"), F.round(F.avg((F.col("n") > 0).cast("double")), 8).alias("share"))


def extremes(hist: DataFrame, k: int = 10) -> DataFrame:
    """(end, place, value, n): the k most and the k least frequent values, ties by value. Top-k, no global sort."""
    top = hist.orderBy(F.desc("n"), "value").limit(k).select(F.lit("top").alias("end"), F.row_number().over(W.orderBy(F.desc("n"), "value")).alias("place"), "value", "n")
    low = hist.where("n > 0").orderBy("n", "value").limit(k).select(F.lit("least").alias("end"), F.row_number().over(W.orderBy("n", "value")).alias("place"), "value", "n")
    return top.unionByName(low)


def component_counts(df: DataFrame, parts: str, by: list[str]) -> DataFrame:
    """(by, kind, value, n) of an array of (kind, value)."""
    return df.select(*by, F.explode(parts).alias("p")).groupBy(*by, "p.kind", "p.value").agg(F.count("*").alias("n"))


def paired_lengths(df: DataFrame, before: str, after: str, by: list[str]) -> DataFrame:
    """How much longer `after` is: ratio of sums, mean of ratios, largest ratio and added length."""
    a, b = F.col(before), F.col(after)
    return df.groupBy(*by).agg(
        F.count("*").alias("pairs"), F.sum(b - a).cast("bigint").alias("added"), F.round(F.sum(b) / F.sum(a), 6).alias("ratio_of_sums"),
        F.round(F.avg(b / a), 6).alias("mean_ratio"), F.round(F.max(b / a), 6).alias("max_ratio"), F.max(b - a).cast("bigint").alias("max_added"),
    )


def ordered_digest(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """(by, n, digest): SHA-256 of the digests of a group's blocks in order; a block's is that of its lines in order.

    order is an integer, and a block DIGEST_BLOCK consecutive numbers of it, so a large group goes to
    many tasks, and only its blocks' digests meet.
    """
    joined = lambda at, what: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(what).cast("string").alias("v")))), lambda x: x.v), "\n")
    rows = df.select(*by, F.col(value).alias("__v"), F.col(order).alias("__o"), F.floor(F.col(order) / DIGEST_BLOCK).alias("__b"))
    blocks = rows.groupBy(*by, "__b").agg(F.count("*").alias("__n"), F.sha2(joined("__o", "__v"), 256).alias("__d"))
    return blocks.groupBy(*by).agg(F.sum("__n").alias("n"), F.sha2(joined("__b", "__d"), 256).alias("digest"))


def set_digest(value: str) -> Column:
    """A digest of a group's values in any order, repeats included: hashes are summed, so it merges and nothing is gathered."""
    return F.sha2(F.concat_ws(":", F.count(value), F.sum(F.xxhash64(F.col(value)).cast("decimal(38,0)")).cast("string")), 256)


def rates(df: DataFrame, flags: dict[str, Column], by: list[str]) -> DataFrame:
    """Share of rows where each flag is true; null flags don't count, and none at all gives 0."""
    return df.groupBy(*by).agg(*[F.coalesce(F.round(F.avg(c.cast("double")), 6), F.lit(0.0)).alias(n) for n, c in flags.items()])


def gates(metrics: DataFrame, by: list[str], names: list[str], thresholds: dict[str, float]) -> DataFrame:
    """(by, gate, value, threshold, passed) of min_<metric> and max_<metric> thresholds; a metric without a value fails."""
    long = metrics.unpivot(by, names, "metric", "value")
    table = F.explode(F.create_map(*[F.lit(x) for k, v in thresholds.items() for x in (k, float(v))])).alias("gate", "threshold")
    asked = metrics.sparkSession.range(1).select(table).withColumn("metric", F.substring("gate", 5, 200))
    good = F.when(F.col("gate").startswith("min_"), F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return long.join(F.broadcast(asked), "metric").select(*by, "gate", "value", "threshold", F.coalesce(good, F.lit(False)).alias("passed"))


def all_passed(gated: DataFrame, by: list[str]) -> DataFrame:
    return gated.groupBy(*by).agg(F.bool_and("passed").alias("passed"))


def outcome_counts(df: DataFrame, outcome: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(outcome), F.lit("unknown")).alias("outcome")).agg(F.count("*").alias("n"))


def weighted_means(df: DataFrame, losses: str, weights: str) -> DataFrame:
    """One row: the mean over all tokens by weight, and the mean of the rows' own weighted means."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y.cast("double"))
    product = F.zip_with(losses, weights, lambda x, w: x * w)
    sums = df.select(total(product).alias("s"), total(F.col(weights)).alias("w"))
    return sums.agg(F.try_divide(F.sum("s"), F.sum("w")).alias("token_mean"), F.avg(F.try_divide("s", "w")).alias("sample_mean"))


def learning_summary(steps: DataFrame) -> DataFrame:
    """One row of (step, loss): least loss and its step, first, mean of the last ten, improvement in percent (null if the first is 0)."""
    last = steps.orderBy(F.desc("step")).limit(10).agg(F.round(F.avg("loss"), 6).alias("last_mean"))
    main = steps.agg(F.min("loss").alias("best"), F.min_by("step", F.struct("loss", "step")).alias("best_step"), F.min_by("loss", "step").alias("first"))
    return main.crossJoin(last).withColumn("improvement", F.when(F.col("first") != 0, F.round(100 * (F.col("first") - F.col("best")) / F.col("first"), 4)))


def any_flag(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)
