"""Shards by extendible hashing: a directory by hash-prefix bits, split only where a bucket is too large; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm._common import Tables

#: Bits of the hash that the directory can use, and bits beyond the mean depth that a round looks at.
HASH_BITS, AHEAD = 60, 4


def assign(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, depth, prefix, page, shard_bytes): the shard (depth, prefix, page) of every row of docs.

    The hash is md5 over id and text. A bucket of depth d holds the hashes with its d first bits; it
    is split on the next bit only if its texts have over limit bytes and it has two rows or more. So
    every shard fits, but for single rows over limit. Rows whose id and text both repeat can't be
    told apart by bits: such a bucket gets overflow pages that fit (page > 0). A null text has no
    bytes; a null id hashes as empty; an empty table gives no rows; other columns aren't read. All
    sizes come from counts by prefix, which are summed before they are shuffled.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "shards")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit("|"), text).cast("binary"))
    rows = tables.cut(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), F.conv(F.substring(key, 1, 15), 16, 10).cast("long").alias("h")))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth, step = 0, min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + AHEAD)
    done, todo = None, rows
    while True:
        fine = todo.groupBy(F.shiftright("h", HASH_BITS - depth - step).alias("p")).agg(F.sum("n_bytes").alias("n"), F.count("*").alias("c"))
        up = fine.select("p", "n", "c", F.explode(F.sequence(F.lit(0), F.lit(step))).alias("up")).withColumn("q", F.call_function("shiftright", F.col("p"), F.col("up")))
        sizes = up.groupBy("up", "q").agg(F.sum("n").alias("size"), F.sum("c").alias("rows"))
        last = depth + step == HASH_BITS
        fits = sizes.where((F.col("size") <= limit) | (F.col("rows") == 1) | (F.lit(last) & (F.col("up") == 0)))
        leaf = up.join(fits, ["up", "q"]).groupBy("p").agg(F.max_by(F.struct((F.lit(depth + step) - F.col("up")).alias("depth"), F.col("q").alias("prefix"), F.col("size").alias("shard_bytes")), "up").alias("leaf"))
        placed = todo.withColumn("p", F.shiftright("h", HASH_BITS - depth - step)).join(leaf, "p", "left")
        placed = tables.cut(placed.select("id", "n_bytes", "h", "leaf"))
        found = placed.where("leaf is not null").select("id", "n_bytes", "leaf.depth", "leaf.prefix", "leaf.shard_bytes")
        done = found if done is None else done.unionByName(found)
        todo = placed.where("leaf is null").select("id", "n_bytes", "h")
        if last or todo.isEmpty():
            break
        depth, step = depth + step, min(AHEAD, HASH_BITS - depth - step)
    alike = done.where((F.col("shard_bytes") > limit) & (F.col("depth") == HASH_BITS))
    plain = done.where((F.col("shard_bytes") <= limit) | (F.col("depth") < HASH_BITS)).withColumn("page", F.lit(0))
    if alike.isEmpty():
        return plain.select("id", "n_bytes", "depth", "prefix", "page", "shard_bytes")
    # Such rows are copies of one row, so each page takes as many as fit. A copy's number is its place
    # in its part of a written table and the copies of earlier parts, so no task has them all.
    parts = tables.cut(alike.withColumn("part", F.spark_partition_id()).withColumn("r", F.monotonically_increasing_id()))
    kind, before = W.partitionBy("prefix", "n_bytes"), W.unboundedPreceding
    a_page = F.greatest(F.floor(F.lit(limit) / F.greatest(F.col("n_bytes"), F.lit(1))), F.lit(1))
    counts = parts.groupBy("prefix", "n_bytes", "part").agg(F.count("*").alias("c"))
    counts = counts.withColumn("base", F.coalesce(F.sum("c").over(kind.orderBy("part").rowsBetween(before, -1)), F.lit(0))).withColumn("copies", F.sum("c").over(kind))
    kinds = counts.select("prefix", "n_bytes", F.ceil(F.col("copies") / a_page).alias("pages")).distinct()
    first = kinds.select("prefix", "n_bytes", F.coalesce(F.sum("pages").over(W.partitionBy("prefix").orderBy("n_bytes").rowsBetween(before, -1)), F.lit(0)).alias("first"))
    placed = parts.join(counts.join(first, ["prefix", "n_bytes"]).drop("c"), ["prefix", "n_bytes", "part"])
    place = F.col("base") + F.row_number().over(W.partitionBy("prefix", "n_bytes", "part").orderBy("r")) - 1
    paged = placed.withColumn("own", F.floor(place / a_page)).withColumn("page", (F.col("first") + F.col("own")).cast("int"))
    paged = paged.withColumn("shard_bytes", F.least(a_page, F.col("copies") - F.col("own") * a_page) * F.col("n_bytes"))
    return plain.unionByName(paged.select(*plain.columns)).select("id", "n_bytes", "depth", "prefix", "page", "shard_bytes")


def write_shards(docs: DataFrame, limit: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs as Parquet under path, a folder for each shard; returns the assignment. Rows with a null id, or one that isn't unique, are refused."""
    shards = assign(docs, limit, id_col, text_col)
    name = F.concat_ws("-", F.col("depth"), F.lower(F.hex("prefix")), F.col("page")).alias("shard")
    by_id = shards.select(F.col("id").alias("__id"), name)
    bad = docs.groupBy(F.col(f"`{id_col}`")).count().where(F.col("count") > 1)
    if not bad.isEmpty() or not docs.where(F.col(f"`{id_col}`").isNull()).isEmpty():
        raise ValueError(f"{id_col} must be unique and not null to write shards")
    joined = docs.join(by_id, F.col(f"`{id_col}`").cast("long") == F.col("__id")).drop("__id")
    joined.repartition("shard").write.partitionBy("shard").parquet(path)
    return shards
