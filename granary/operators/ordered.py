"""Operators that depend on order: trailing means, top-k, lineage, folds, deterministic samples and splits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def trailing_mean(value: str, by: list[str], order: str, rows: int = 5) -> Column:
    return F.avg(value).over(W.partitionBy(*by).orderBy(order).rowsBetween(1 - rows, 0))


def hash_order(seed: int, *keys: str) -> Column:
    """A key for a shuffled order that depends on nothing but the seed and the row."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]), 256)


def sampled(df: DataFrame, by: str, key: str, k: int, seed: int) -> DataFrame:
    """k rows of each group, all alike likely, the same on every run. The rank's limit is pushed below the shuffle."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(hash_order(seed, key), key))
    return df.withColumn("sample_rank", rank).where(F.col("sample_rank") <= k)


def buffer_shuffled(df: DataFrame, order: str, seed: int, size: int) -> DataFrame:
    """df with `place`: rows keep their order by blocks of `size` consecutive numbers of `order` (an integer from 0), and are shuffled within one."""
    block = F.floor(F.col(order) / size)
    shuffled = F.row_number().over(W.partitionBy(block).orderBy(hash_order(seed, order), order))
    return df.withColumn("place", block * size + shuffled - 1)


def split(df: DataFrame, rank: str, sizes: dict[str, int]) -> DataFrame:
    """Sampled rows with their split: the first ranks go to the first split, and so on."""
    column, start = None, 0
    for name, n in sizes.items():
        test = F.col(rank).between(start + 1, start + n)
        column = F.when(test, name) if column is None else column.when(test, name)
        start += n
    return df.withColumn("split", column).where("split is not null")


def permuted_sample(ids: list[str], k: int, seed: int) -> list[str]:
    """k ids by numpy's seeded permutation of the sorted list, on the driver, where its very order is needed."""
    ids = sorted(ids)
    return [ids[i] for i in np.random.default_rng(seed).permutation(len(ids))[:k]]


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def ranked(df: DataFrame, by: list[str], order: str, given: str = "rank") -> DataFrame:
    """Rows with their given rank, else their place."""
    return df.withColumn(given, F.coalesce(F.col(given), F.row_number().over(W.partitionBy(*by).orderBy(order))))


def lineage_faults(df: DataFrame, run: str, position: str, own: str, parent: str) -> DataFrame:
    """Rows whose parent isn't the attempt before them in their run; the first must have none."""
    before = F.lag(own).over(W.partitionBy(run).orderBy(position))
    return df.withColumn("expected", before).where(~F.col(parent).eqNullSafe(F.col("expected")))


def best_attempts(df: DataFrame, run: str, position: str, score: str, patience: int) -> DataFrame:
    """(run, best_position, best_score, used, stopped): attempts in order until `patience` in a row bring no better score.

    A fold over the run's attempts, which are few; a null score is no better.
    """
    steps = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(score).cast("double").alias("s"))))
    start = F.struct(F.lit(None).cast("long").alias("at"), F.lit(None).cast("double").alias("best"), F.lit(0).cast("long").alias("used"), F.lit(0).alias("idle"))

    def step(acc: Column, x: Column) -> Column:
        better = acc.best.isNull() & x.s.isNotNull() | (x.s > acc.best)
        better = F.coalesce(better, F.lit(False))
        going = acc.idle < patience
        new = F.struct(F.when(better, x.p.cast("long")).otherwise(acc["at"]).alias("at"), F.when(better, x.s).otherwise(acc.best).alias("best"), (acc.used + 1).alias("used"), F.when(better, 0).otherwise(acc.idle + 1).alias("idle"))
        return F.when(going, new).otherwise(acc)

    return df.groupBy(run).agg(F.aggregate(steps, start, step).alias("f")).select(run, F.col("f.at").alias("best_position"), F.col("f.best").alias("best_score"), F.col("f.used").alias("used"), (F.col("f.idle") >= patience).alias("stopped"))


def token_budget(items: DataFrame, by: str, order: str, text: str, budget: int) -> DataFrame:
    """(by, order, text, kept, tokens): items in order that still fit in the budget, whole, else their longest prefix of lines.

    Tokens are words of the joined text so far; an item of which nothing fits is passed over. A group
    is one context's items, bounded by what a retrieval returns, and so is gathered.
    """
    schema = f"{by} {items.schema[by].dataType.simpleString()}, {order} {items.schema[order].dataType.simpleString()}, {text} string, kept string, tokens long"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, used = [], 0
        for r in pdf.sort_values(order).itertuples(index=False):
            whole = getattr(r, text) or ""
            lines = whole.split("\n")
            words = np.cumsum([len(x.split()) for x in lines])
            n = int(np.searchsorted(words, budget - used, side="right"))
            if n and words[n - 1]:
                used += int(words[n - 1])
                out.append((getattr(r, by), getattr(r, order), whole, "\n".join(lines[:n]), used))
        return pd.DataFrame(out, columns=[by, order, text, "kept", "tokens"])

    return items.select(by, order, text).groupBy(by).applyInPandas(fold, schema)


def length_grouped(df: DataFrame, length: str, key: str, seed: int, mega: int) -> DataFrame:
    """(.., bucket, place): rows in random mega-batches of about `mega` rows, each longest first."""
    n = max(1, -(-df.count() // mega))
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(n)).cast("int")
    return df.withColumn("bucket", bucket).withColumn("place", F.row_number().over(W.partitionBy("bucket").orderBy(F.desc(length), key)))
