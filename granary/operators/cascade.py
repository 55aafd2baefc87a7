"""The ordered filter cascade: one column with the first reason that rejects a row, and deduplication in scan order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reasons in their order.
REASONS = (
    "not_in_sample_allowlist", "missing_required_field", "missing_detail", "description_length", "benchmark_exclusion",
    "svg_char_length", "svg_validation", "svg_canonicalization", "duplicate_svg", "render", "svg_tokenization",
    "svg_token_length", "full_chat_token_length",
)


def rejection(tests: dict[str, Column]) -> Column:
    """The first failing test's name, in the dictionary's order; null if none fails. A test is true where a row fails; null doesn't."""
    out = None
    for name, fails in tests.items():
        out = F.when(fails, name) if out is None else out.when(fails, name)
    return out if out is not None else F.lit(None).cast("string")


def first_accepted(df: DataFrame, key: str, order: list[str], early: dict[str, Column], late: dict[str, Column], seeded: DataFrame | None = None, duplicate: str = "duplicate_svg") -> DataFrame:
    """df with `rejection`, where of the rows of one key only the first that passes every other test stays.

    A row is a duplicate if its key is seeded or an earlier row of the key was accepted in full; that
    is asked after the early tests and before the late ones. So a row that fails late leaves its
    place to a later one. order must be total. Rows of a null key are no duplicates.

    First places are aggregated, of keys with two rows or more, and joined back by a further key: that
    spreads the rows of a null key, lets a hot key's rows be split, and few repeated keys be broadcast.
    """
    before, after = rejection(early), rejection(late)
    spread = F.when(F.col(key).isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(*order))
    df = df.withColumn("__early", before).withColumn("__late", after).withColumn("__spread", spread)

    def meeting(keys: DataFrame) -> DataFrame:
        return df.join(keys.withColumn("__spread2", F.xxhash64("__key")), (F.col("__spread") == F.col("__spread2")) & (F.col(key) == F.col("__key")), "left").drop("__spread2", "__key")

    if seeded is not None:
        seeds = seeded.select(F.col(seeded.columns[0]).alias("__key")).where("__key is not null").distinct()
        df = meeting(seeds.withColumn("__seeded", F.lit(True))).withColumn("__seeded", F.coalesce("__seeded", F.lit(False)))
    else:
        df = df.withColumn("__seeded", F.lit(False))
    place = F.struct(*order)
    passes = F.col("__early").isNull() & F.col("__late").isNull() & ~F.col("__seeded")
    firsts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min(F.when(passes, place)).alias("__first"), F.count("*").alias("__n"))
    df = meeting(firsts.where("__n > 1 AND __first IS NOT NULL").drop("__n"))
    repeated = F.col(key).isNotNull() & (F.col("__seeded") | (place > F.col("__first")))
    df = df.withColumn("__dup", F.coalesce(repeated, F.lit(False))).withColumn("rejection", F.coalesce("__early", F.when(F.col("__dup"), duplicate), "__late"))
    return df.drop("__early", "__late", "__seeded", "__dup", "__spread", "__first")


def flagged(df: DataFrame, keys: DataFrame, on: dict[str, str], name: str) -> DataFrame:
    """df with a flag that tells if its values (on: column of df to column of keys) are among keys. Keys are made distinct, so rows don't multiply."""
    other = keys.select(*[F.col(k).alias(f"__{k}") for k in on.values()]).distinct().withColumn("__hit", F.lit(True))
    cond = None
    for mine, theirs in on.items():
        c = F.col(mine) == F.col(f"__{theirs}")
        cond = c if cond is None else cond & c
    return df.join(other, cond, "left").withColumn(name, F.coalesce("__hit", F.lit(False))).drop("__hit", *[f"__{k}" for k in on.values()])


def excluded(df: DataFrame, keys: DataFrame, id_col: str, caption: str, detail: str | None = None, name: str = "is_excluded") -> DataFrame:
    """df with a flag for rows whose id or caption hash is excluded: one equi-join for each key, never one join on either."""
    ids, captions = keys.where("kind = 'id'"), keys.where("kind = 'caption'")
    df = flagged(df, ids, {id_col: "value"}, "__by_id")
    df = flagged(df, captions, {caption: "value"}, "__by_caption")
    flag = F.col("__by_id") | F.col("__by_caption")
    if detail:
        df = flagged(df, captions, {detail: "value"}, "__by_detail")
        flag |= F.col("__by_detail")
    return df.withColumn(name, flag).drop("__by_id", "__by_caption", "__by_detail")


def reason_counts(df: DataFrame, by: str, reasons: tuple[str, ...] | list[str]) -> DataFrame:
    """(by, reason, n): every reason of every group, zeros too, and `accepted`."""
    wide = df.groupBy(by).agg(F.count_if(F.col("rejection").isNull()).alias("accepted"), *[F.count_if(F.col("rejection") == r).alias(r) for r in reasons])
    return wide.unpivot(by, ["accepted", *reasons], "reason", "n")
