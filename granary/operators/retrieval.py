"""Retrieval by cosine similarity: exact top-k for a block of queries, thresholds, safety, hydration; incremental indexing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Most queries, and bytes of their vectors, that go to every task at once.
QUERY_BLOCK, QUERY_BYTES = 4096, 64 << 20
#: Most bytes of all queries' vectors, which the driver holds, in one call.
MOST_QUERY_BYTES = 1 << 30


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: (x / norm).cast("float")))


def score_of(distance: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - distance))


def nearest(corpus: DataFrame, queries: DataFrame, k: int, id_col: str, vector: str, query_id: str, query_vector: str, threshold: float = -1.0, keep_self: bool = False) -> DataFrame:
    """(query_id, id, score, rank): the k rows of the corpus most like each query, exactly; ties by id.

    Queries go to every task in blocks of bounded size; a task keeps its own k best of each query by
    one matrix product per batch, so at most k rows of a query leave a task. Vectors must be unit
    vectors of one length; null ones match nothing. Queries of over MOST_QUERY_BYTES are an error:
    the caller divides them.
    """
    spark = corpus.sparkSession
    width, n = queries.where(F.col(query_vector).isNotNull()).select(F.max(F.size(query_vector)), F.count("*")).first()
    width = width or 1
    if 8 * width * n > MOST_QUERY_BYTES:
        raise ValueError(f"{n} queries of {width} numbers are over {MOST_QUERY_BYTES} bytes; ask in parts")
    block = max(1, min(QUERY_BLOCK, QUERY_BYTES // (8 * width)))
    asked = queries.where(F.col(query_vector).isNotNull()).select(query_id, query_vector).orderBy(query_id)
    out, held = None, []
    parts: list[tuple[list, np.ndarray]] = []
    for r in asked.toLocalIterator():
        held.append(r)
        if len(held) == block:
            parts.append(([x[0] for x in held], np.array([x[1] for x in held], np.float64)))
            held = []
    if held or not parts:
        parts.append(([x[0] for x in held], np.array([x[1] for x in held], np.float64).reshape(len(held), width)))
    q_kind, i_kind = queries.schema[query_id].dataType.simpleString(), corpus.schema[id_col].dataType.simpleString()
    rows = corpus.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("__id"), F.col(vector).alias("__v"))
    for names, matrix in parts:
        shared = spark.sparkContext.broadcast((names, matrix))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, matrix = shared.value
            best: list[list[tuple]] = [[] for _ in names]
            for pdf in batches:
                if not len(pdf) or not len(names):
                    continue
                ids = pdf["__id"].to_numpy()
                scores = matrix @ np.stack(pdf["__v"].to_numpy()).astype(np.float64).T
                for i, row in enumerate(scores):
                    ok = np.flatnonzero(row >= threshold) if keep_self else np.flatnonzero((row >= threshold) & (ids != names[i]))
                    if len(ok) > k:
                        cut = np.partition(row[ok], len(ok) - k)[len(ok) - k]
                        ok = ok[row[ok] >= cut]
                    best[i] = sorted(best[i] + [(-row[j], ids[j]) for j in ok])[:k]
            found = [(names[i], b, -s) for i, own in enumerate(best) for s, b in own]
            yield pd.DataFrame(found, columns=["query_id", "id", "score"])

        part = rows.mapInPandas(run, f"query_id {q_kind}, id {i_kind}, score double")
        out = part if out is None else out.unionByName(part)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def over_fetched(hits: DataFrame, by: list[str], order: list[Column], k: int, factor: int, usable: Column) -> DataFrame:
    """The first k usable of the first k * factor hits; the new rank has no gaps."""
    wide = hits.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= k * factor).where(usable)
    return wide.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy("__r"))).where(F.col("rank") <= k).drop("__r")


def shared_items(a: DataFrame, b: DataFrame) -> DataFrame:
    """Hits of a query that two indexes both give, with both scores."""
    return a.select("query_id", "id", F.col("score").alias("score_a")).join(b.select("query_id", "id", F.col("score").alias("score_b")), ["query_id", "id"])


def quantized_scores(a: Column, b: Column, scale_a: Column, scale_b: Column) -> Column:
    """Dot product of small-integer vectors, scaled back."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("int") * y.cast("int")), F.lit(0).cast("bigint"), lambda s, x: s + x).cast("double") * scale_a * scale_b


def hashed_embedding(text: Column, width: int = 64) -> Column:
    """A stand-in encoder: signed word hashes summed into a unit vector, JVM-side. Real encoders plug in by mapInPandas."""
    words = F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    cell = lambda i: F.aggregate(F.filter(hashes, lambda h: F.pmod(h, F.lit(width)) == i), F.lit(0.0), lambda s, h: s + F.when(F.shiftright(h, 40) % 2 == 0, 1.0).otherwise(-1.0))
    return normalized(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), cell))
