"""Quality rules with thresholds adapted to each language and source by mergeable quantile sketches; DataFrame functions only."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm._common import Tables

#: How many documents' weight a parent's sketch has in its child's: that of all documents in a language's, and this in a source's.
PRIOR = 25
#: Leading bits of a value that a sketch's bucket keeps: a quantile is right within 1 in 32.
BITS = 6
#: How far a fence lies beyond the outer quantile, in distances from there to the median.
REACH = 3
#: Millionths: the precision of a share of a sketch's documents.
SHARE = 1_000_000
#: Metric, the sides that have a fence, and the distance that counts where the quantiles' own is less (of many groups it is nothing).
METRICS: dict[str, tuple[str, int]] = {
    "symbol_rate": ("high", 10),  # symbols in 1000 characters of words
    "dup_line_rate": ("high", 100),  # repeated lines in 1000 lines
    "repeat_rate": ("high", 50),  # words of repeated windows in 1000 words
    "word_length": ("low high", 10),  # characters in 100 words
}

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.transform(F.array(value), use).getItem(0)


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _repeats(words: Column) -> Column:
    """Words that lie in 3-word windows found twice or more: windows are sorted by hash, equal neighbours' places by place."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def places(h: Column) -> Column:
        def twice(s: Column) -> Column:
            same = lambda j: F.get(s, j).getField("h") == F.get(s, j + 1).getField("h")
            found = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.when(j < F.size(s) - 1, same(j)).otherwise(False) | F.when(j > 0, same(j - 1)).otherwise(False))
            return F.array_sort(F.transform(found, lambda j: F.get(s, j).getField("i")))

        return let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), twice)

    def covered(p: Column) -> Column:
        steps = F.aggregate(F.slice(F.transform(p, lambda x, k: F.least(F.lit(3), F.get(p, k + 1) - x)), 1, F.size(p) - 1), F.lit(0).cast("long"), lambda acc, x: acc + x)
        return F.when(F.size(p) == 0, F.lit(0).cast("long")).otherwise(steps + 3)

    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(places(h), covered)))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(some)


def measures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long); a null text is empty.

    Windows are told apart by 64-bit hashes within their document.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeats(w).alias("n_repeat_words")))
    lined = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return F.struct(
        counted.alias("w"),
        lined.alias("l"),
        F.length(_without(text, _SPACE)).cast("long").alias("word_chars"),
        (F.octet_length(text) - F.octet_length(_without(text, _SYMBOLS))).cast("long").alias("n_symbols"),
    )


def bucket(value: Column) -> Column:
    """The least value with the same BITS leading bits: buckets of fixed bounds, so sketches merge by adding counts."""
    shift = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(rows: DataFrame, metrics: list[str], groups: list[str]) -> DataFrame:
    """(groups, metric, bucket, n): one sketch per group and metric; adding n merges any of them."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("bucket")) for m in metrics]))
    return rows.select(*groups, pairs.alias("m")).groupBy(*groups, "m.metric", "m.bucket").agg(F.count("*").alias("n"))


def weighed(sketch: DataFrame, keys: list[str], above: DataFrame | None) -> DataFrame:
    """(keys, metric, bucket, share): of every group, and every bucket that occurs in any, the share of documents up to it, in millionths.

    above: the same of the level above, (some of keys, metric, bucket, share); it counts like PRIOR
    documents of the group, so few documents hardly move the shares and many make them their own.
    """
    own = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    grid = own.select(*keys, "metric").distinct().join(F.broadcast(sketch.select(F.col("metric").alias("__m"), "bucket").distinct()), F.col("metric") == F.col("__m")).drop("__m")
    cells = own.unionByName(grid.withColumn("n", F.lit(0).cast("long"))).groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*keys, "metric")
    counted = cells.select(*keys, "metric", "bucket", F.sum("n").over(group).alias("all"), F.sum("n").over(group.orderBy("bucket")).alias("upto"))
    if above is None:
        return counted.select(*keys, "metric", "bucket", F.expr(f"upto * {SHARE} div all").alias("share"))
    parent = above.select(*[F.col(c).alias(f"__{c}") for c in above.columns])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in above.columns if c != "share"]
    met = counted.join(parent, functools.reduce(Column.__and__, same))
    return met.select(*keys, "metric", "bucket", F.expr(f"(upto * {SHARE} + {PRIOR} * __share) div (all + {PRIOR})").alias("share"))


def quantiles(shares: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, q10, q50, q90) of weighed sketches: the first bucket at which that share is reached."""
    at = lambda tenths: F.min(F.when(F.col("share") >= tenths * SHARE // 10, F.col("bucket")))
    return shares.groupBy(*keys, "metric").agg(at(1).alias("q10"), at(5).alias("q50"), at(9).alias("q90"))


def fences(sketch: DataFrame) -> DataFrame:
    """(lang, source, metric_low, metric_high of every metric) of every group of the sketch: outer deciles of its weighed sketch, and REACH times their distance to the median."""
    keys = ["lang", "source"]
    met = quantiles(weighed(sketch, keys, weighed(sketch, ["lang"], weighed(sketch, [], None))), keys)
    sides = []
    for name, (which, least) in METRICS.items():
        for side in ("low", "high"):
            far = F.col("q10") - REACH * F.greatest(F.col("q50") - F.col("q10"), F.lit(least)) if side == "low" else F.col("q90") + REACH * F.greatest(F.col("q90") - F.col("q50"), F.lit(least))
            sides.append(F.max(F.when((F.col("metric") == name) & F.lit(side in which.split()), far)).alias(f"{name}_{side}"))
    return met.groupBy("lang", "source").agg(*sides)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, the metrics, kept).

    base_failed: under 50 words, or over half of them in repeated windows. kept: not base_failed, and
    every metric within its group's fences; those come from the group's sketch of the rows that didn't
    fail, merged with its language's and that of all by weight. Null
    language or source is a group of its own; null texts are empty and fail; a null id stays null;
    repeated rows are judged each; an empty table gives no rows; other columns aren't read. Rows
    reach the sketches pre-aggregated, and the join with a hot group's fences can be split.
    """
    tables = Tables(docs.sparkSession, "quality")
    raw = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{source_col}`").cast("string").alias("source"), measures(F.col(f"`{text_col}`")).alias("m"))
    rows = tables.cut(raw).select("id", "lang", "source", "m.w.n_words", "m.word_chars", "m.n_symbols", "m.l.n_lines", "m.l.n_dup_lines", "m.w.n_repeat_words")
    rate = lambda k, a, b: F.expr(f"{k} * {a} div greatest({b}, 1L)")
    rows = rows.withColumns({
        "base_failed": F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"),
        "symbol_rate": rate(1000, "n_symbols", "word_chars"),
        "dup_line_rate": rate(1000, "n_dup_lines", "n_lines"),
        "repeat_rate": rate(1000, "n_repeat_words", "n_words"),
        "word_length": rate(100, "word_chars", "n_words"),
    })
    limits = tables.cut(fences(tables.cut(sketches(rows.where("not base_failed"), list(METRICS), ["lang", "source"])))).withColumnRenamed("lang", "__l").withColumnRenamed("source", "__s")
    inside = F.lit(True)
    for m in METRICS:
        inside &= F.coalesce(F.col(m) >= F.col(f"{m}_low"), F.lit(True)) & F.coalesce(F.col(m) <= F.col(f"{m}_high"), F.lit(True))
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("__l")) & F.col("source").eqNullSafe(F.col("__s")), "left")
    return joined.select(*rows.columns, (~F.col("base_failed") & inside).alias("kept"))
