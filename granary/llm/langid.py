"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from granary.llm._common import Tables, bounded_batches, frugal

UNKNOWN = "und"
#: Lengths of the n-grams.
SIZES = (1, 2, 3)
#: Most labelled documents per language that the counts are learned from, in expectation.
TRAIN_DOCS = 4000
#: Hash buckets, a power of two, and the most languages: 64 MB of the broadcast matrix; more are an error.
BUCKETS, MOST_LANGS = 1 << 16, 256
#: Code points that are scored at once.
BLOCK = 1 << 18
#: The most by which one document's log-odds count, in n-grams: the posterior of long texts isn't simply 1.
TEMPER = 50.0
#: A floor lies so many nats an n-gram below the lowest twentieth of a language's held-out rows, of which it needs FLOOR_DOCS; shorter texts have none.
MARGIN, FLOOR_DOCS, FLOOR_GRAMS = 2.0, 20, 300


@dataclass
class Model:
    """langs in order, log priors, log probabilities by bucket and language, and the least mean log probability of a text's n-grams by language."""

    langs: list[str]
    prior: np.ndarray
    logp: np.ndarray
    floor: np.ndarray | None = None


def hashed(points: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """A bucket for each n-gram of code points, by its first position."""
    h = np.full(len(points) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h = (h ^ points[k : len(points) - n + 1 + k]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE35)
    return h >> np.uint32(32 - buckets.bit_length() + 1)


def grams(texts: list[str], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, index of the text) of every n-gram, in blocks; none reaches over two texts.

    A text is taken whole, in lower case; digits and ASCII punctuation count as spaces.
    """
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) < BLOCK):
            size, end = size + len(texts[end]) + 1, end + 1
        points = np.frombuffer("\0".join(["", *(t.replace("\0", " ") for t in texts[start:end]), ""]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        for at in range(0, len(points), 4 * BLOCK):  # a very long text goes through in parts that share an n-gram's length
            part = points[at : at + 4 * BLOCK + max(SIZES) - 1]
            ends = part == 0
            owner = np.cumsum(ends) - 1 + start + int((points[:at] == 0).sum())
            plain = np.where((part < 128) & ~ends & ~((part >= 97) & (part <= 122)), np.uint32(32), part)
            for n in SIZES:
                m = min(len(part) - n + 1, 4 * BLOCK)
                if m <= 0:
                    continue
                inside = np.ones(m, bool)
                for k in range(n):
                    inside &= ~ends[k : k + m]
                yield hashed(plain[: m + n - 1], n, buckets)[inside], owner[:m][inside]
        start = end


def learn(labelled: DataFrame, tables: Tables, id_col: str, text_col: str, lang_col: str, train_docs: int = TRAIN_DOCS) -> Model | None:
    """Counts of n-grams by language, of a bounded sample of the labelled rows; None if there are no labels.

    The sample takes the rows whose hash of id and text is below train_docs over the language's rows.
    """
    spark = labelled.sparkSession
    bounded_batches(spark)
    labelled = labelled.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().limit(MOST_LANGS + 1).collect()}
    if not sizes:
        return None
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"over {MOST_LANGS} languages: their matrix would be too large to broadcast")
    langs, buckets = sorted(sizes), BUCKETS
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, train_docs / sizes[k])])
    sample = labelled.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).select("text", "lang")
    number = {k: i for i, k in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(langs) * buckets, np.int64)
        for batch in batches:
            lang = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            for bucket, owner in grams(batch.column(0).to_pylist(), buckets):
                np.add.at(total, lang[owner] * buckets + bucket, 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["cell", "n"])

    cells = sample.mapInArrow(frugal(count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(len(langs) * buckets)
    total[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(np.float64)
    total = total.reshape(len(langs), buckets).T + 0.5
    docs = np.array([sizes[k] for k in langs], np.float64)
    return Model(langs, np.log(docs / docs.sum()), np.ascontiguousarray(np.log(total / total.sum(axis=0)), dtype=np.float32))


def likelihoods(texts: list[str | None], model: Model) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Of the texts with a letter: their places, log likelihoods by language, and numbers of n-grams."""
    known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    sums, n = np.zeros((len(known), len(model.langs))), np.zeros(len(known))
    for bucket, owner in grams([texts[i] for i in known], len(model.logp)):
        if len(owner):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sums[owner[first]] += np.add.reduceat(model.logp[bucket], first, axis=0, dtype=np.float64)
            n[owner[first]] += np.diff(np.append(first, len(owner)))
    return known, sums, n


def score(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and tempered posterior of every text; UNKNOWN and 0 if it has no letter, or if it is below its language's floor."""
    known, sums, n = likelihoods(texts, model)
    full = sums + model.prior
    best = full.argmax(axis=1) if len(known) else np.empty(0, int)
    below = np.zeros(len(known), bool)
    if model.floor is not None:
        below = (n >= FLOOR_GRAMS) & (sums[np.arange(len(known)), best] < model.floor[best] * n)
    sums = sums * np.minimum(1, TEMPER / np.maximum(n, 1))[:, None] + model.prior
    sums = np.exp(sums - sums.max(axis=1, keepdims=True)) if len(known) else sums
    langs, out = [UNKNOWN] * len(texts), np.zeros(len(texts))
    for row, i in enumerate(known):
        if below[row]:
            continue
        langs[i], out[i] = model.langs[best[row]], sums[row, best[row]] / sums[row].sum()
    return langs, out


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and lang_score.

    The matrix of log probabilities is broadcast; it has 64 MB at most (see MOST_LANGS). A null text, one
    without a letter, or any text when nothing was learned is UNKNOWN with score 0; of languages
    that score the same the first in order is taken; repeated rows get the same result; an empty
    table gives no rows; columns of those names in docs are replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "lang_score")
    at = docs.columns.index(text_col)
    names = [*docs.columns, "lang_pred", "lang_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            langs, scores = score(texts, shared.value) if shared.value else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())])
    return docs.mapInArrow(frugal(run), schema)


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, mod 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> Model | None:
    """A model of the rows of docs that aren't held out."""
    return learn(docs.where(~held_out(id_col)), Tables(docs.sparkSession, "langid"), id_col, text_col, lang_col, **how)


def with_floors(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_DOCS) -> Model | None:
    """The model with floors by language, learned from labelled held-out rows: the counts haven't seen those, so few of them don't look likelier than they are.

    About `most` rows a language are read. A language that fewer than FLOOR_DOCS of them are taken for has no floor.
    """
    if model is None:
        return None
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.where(held_out(id_col) & F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    share = most * len(model.langs) / max(1, rows.count())
    rows = rows.where(F.pmod(F.xxhash64(f"`{id_col}`", f"`{text_col}`"), F.lit(1 << 30)) < share * (1 << 30))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, sums, n = likelihoods(batch.column(0).to_pylist(), shared.value)
            long = n >= FLOOR_GRAMS
            best = (sums + shared.value.prior)[long].argmax(axis=1) if long.any() else np.empty(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.int64()), pa.array(sums[long][np.arange(len(best)), best] / n[long])], ["lang", "mean"])

    floor = np.full(len(model.langs), -np.inf)
    means = rows.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(frugal(run), "lang long, mean double")
    for r in means.groupBy("lang").agg(F.count("*").alias("n"), F.percentile_approx("mean", 0.05).alias("low")).collect():
        if r["n"] >= FLOOR_DOCS:
            floor[r["lang"]] = r["low"] - MARGIN
    return replace(model, floor=floor)
