"""Set operations: overlaps of roles, unseen values, first failures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlaps(ids: DataFrame, role: str = "role", key: str = "sample_id") -> DataFrame:
    """(role_a, role_b, shared) of every two roles, zeros too: roles are gathered by id, so each id is shuffled once."""
    roles = F.array_sort(F.collect_set(role))
    pairs = F.flatten(F.transform("rs", lambda a: F.transform(F.filter("rs", lambda b: b > a), lambda b: F.struct(a.alias("role_a"), b.alias("role_b")))))
    shared = ids.groupBy(key).agg(roles.alias("rs")).where(F.size("rs") > 1).select(F.explode(pairs).alias("p")).groupBy("p.role_a", "p.role_b").agg(F.count("*").alias("shared"))
    names = ids.select(role).distinct()  # as few as there are roles
    every = names.select(F.col(role).alias("role_a")).join(names.select(F.col(role).alias("role_b")), F.col("role_a") < F.col("role_b"))
    return every.join(shared, ["role_a", "role_b"], "left").na.fill(0, ["shared"])


def unseen(train: DataFrame, evaluation: DataFrame, keys: list[str], n: str) -> DataFrame:
    """(unseen_values, unseen_occurrences, values, occurrences) of counted evaluation values that training doesn't have."""
    mark = evaluation.join(train.select(*keys).distinct().withColumn("__seen", F.lit(True)), keys, "left")
    new = F.col("__seen").isNull()
    return mark.agg(F.count_if(new).alias("unseen_values"), F.coalesce(F.sum(F.when(new, F.col(n))), F.lit(0)).alias("unseen_occurrences"), F.count("*").alias("vals"), F.coalesce(F.sum(n), F.lit(0)).alias("occurrences"))


def first_failures(df: DataFrame, by: str, detail: list[str], most: int = 100) -> DataFrame:
    """(by, n, first): the full count and the first details in order. Only `most` of each group are gathered."""
    first = df.withColumn("__r", F.row_number().over(W.partitionBy(by).orderBy(*detail))).where(F.col("__r") <= most)
    listed = first.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*detail))).alias("first"))
    return df.groupBy(by).agg(F.count("*").alias("n")).join(listed, by)


def length_cohorts(df: DataFrame, length: str, most: int) -> DataFrame:
    """df with `retained`: whether its length is within the limit; a null length isn't. Both cohorts come from one pass."""
    return df.withColumn("retained", F.coalesce(F.col(length) <= most, F.lit(False)))


def same_pairs(a: str, b: str):
    """Two arrays hold the same different items."""
    return (F.array_sort(a) == F.array_sort(b)) & (F.size(F.array_distinct(a)) == F.size(a))
