"""Benchmark decontamination: passages query a BM25 index of test items by block-max WAND."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm._common import as_bytes, bounded_batches, frugal

#: Words of a shingle, and the share of an item's shingles (and, if it has both, of the words of its question and of its answer) that a passage must hold.
SHINGLE, OVERLAP = 5, 0.8
#: Postings of a block of the index.
BLOCK = 32
#: Most bytes of item texts in one broadcast index; more items make more indexes, one after the other.
INDEX_BYTES = 16 << 20
#: BM25's parameters.
K1, B = 1.2, 0.75

_FOLD = bytes(ord(" ") if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" or c in range(9, 14) else c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-case words; ASCII punctuation divides words."""
    if not text:
        return []
    if not text.isascii():
        text = text.decode("utf-8", "replace").lower().encode("utf-8", "replace")
    return text.translate(_FOLD).split()


@dataclass
class Index:
    """Items as word numbers, and postings by shingle in blocks with their largest impact: arrays throughout.

    A term is a shingle. Impacts are BM25 weights over the item's own threshold, so that every item
    is retrieved from a score of 1 on. The threshold is what is left of the item's full score once
    its heaviest terms are taken away, as many as OVERLAP lets a passage lack: no passage that the
    verification would accept scores less. A word is known by its 64-bit hash. Beside the ids a word
    of item text takes about 40 bytes, so an index of INDEX_BYTES of text some 120 MB.
    """

    ids: list[int]
    words: np.ndarray  #: sorted hashes of the items' words; a word's number is its place here
    item_at: np.ndarray  #: where an item's words begin in item_words, and where the last ends
    item_words: np.ndarray
    question: np.ndarray  #: how many of an item's words are its question's
    hashes: np.ndarray  #: sorted terms
    at: np.ndarray  #: where a term's postings begin, and where the last's end
    items: np.ndarray
    impacts: np.ndarray
    block_at: np.ndarray  #: the same of its blocks
    block_last: np.ndarray
    block_most: np.ndarray
    most: np.ndarray  #: a term's largest impact

    def __post_init__(self):
        n = np.diff(self.item_at)
        self.longest, self.sizes = int(n.max(initial=0)), sorted({_size(int(x)) for x in np.unique(n)})

    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))

    def item(self, i: int) -> np.ndarray:
        return self.item_words[self.item_at[i] : self.item_at[i + 1]]


_MULT = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(64)], np.uint64)


def shingle_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    h = np.zeros(max(0, len(ids) - size + 1), np.uint64)
    for k in range(size):
        h += (ids[k : len(ids) - size + 1 + k].astype(np.uint64) + np.uint64(1)) * _MULT[k]
    h ^= h >> np.uint64(31)
    return h * _MULT[1]


def _size(n_words: int) -> int:
    return max(1, min(SHINGLE, n_words))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def build_index(items: list[tuple[int, str, str | None]]) -> Index:
    """items: (id, question, answer)."""
    ids, parts, question = [], [], []
    for key, q, a in items:
        q, a = words_of((q or "").encode()), words_of((a or "").encode())
        if q or a:
            ids.append(key)
            parts.append(_word_hashes(q + a))
            question.append(len(q))
    n = len(ids)
    lengths = np.fromiter(map(len, parts), np.int64, n)
    item_at = np.concatenate(([0], np.cumsum(lengths)))
    words, numbers = np.unique(np.concatenate(parts) if parts else np.empty(0, np.uint64), return_inverse=True)
    numbers = numbers.astype(np.int32).ravel()
    term, item, count = [np.empty(0, np.uint64)], [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    for i in range(n):
        size = _size(int(lengths[i]))
        h, f = np.unique(shingle_hashes(numbers[item_at[i] : item_at[i + 1]], size) ^ np.uint64(size), return_counts=True)
        term.append(h)
        item.append(np.full(len(h), i, np.int32))
        count.append(f)
    term, item, count = np.concatenate(term), np.concatenate(item), np.concatenate(count)
    by = np.lexsort((item, term))
    term, item, count = term[by], item[by], count[by]
    hashes, at = np.unique(term, return_index=True)
    at = np.append(at, len(term)).astype(np.int64)
    df = np.repeat(np.diff(at), np.diff(at))
    norm = K1 * (1 - B + B * lengths / max(1.0, lengths.mean() if n else 1.0))
    weight = np.log(1 + (n - df + 0.5) / (df + 0.5)) * count * (K1 + 1) / (count + norm[item])
    # An item's heaviest terms: as many as a passage may lack places of shingles.
    heavy = np.lexsort((-weight, item))
    first = np.searchsorted(item[heavy], np.arange(n))
    place = np.arange(len(heavy)) - first[item[heavy]]
    lack = ((1 - OVERLAP) * (lengths - [_size(int(x)) for x in lengths] + 1) + 1e-9).astype(np.int64) if n else lengths
    left = np.bincount(item[heavy], np.where(place < lack[item[heavy]], 0.0, weight[heavy]), minlength=n)
    least = weight[heavy][np.append(first[1:], len(heavy)) - 1] if n else left
    impacts = weight / (np.maximum(left, least) * (1 - 1e-9))[item]
    blocks = -(-np.diff(at) // BLOCK)
    block_at = np.concatenate(([0], np.cumsum(blocks)))
    starts = np.repeat(at[:-1], blocks) + BLOCK * (np.arange(block_at[-1]) - np.repeat(block_at[:-1], blocks))
    last = np.minimum(starts + BLOCK, np.repeat(at[1:], blocks)) - 1
    top = lambda x: np.maximum.reduceat(impacts, x) if len(impacts) else np.empty(0)
    return Index(ids, words, item_at, numbers, np.array(question, np.int64), hashes, at, item, impacts, block_at, item[last], top(starts), top(at[:-1]))


def block_max_wand(index: Index, slots: list[int], threshold: float = 1.0) -> list[tuple[int, float]]:
    """Every item whose summed impacts over the terms in these slots reach threshold: (item, score).

    Cursors stand at their lists' next item; the pivot is the first whose lists' largest impacts
    reach the threshold; if the blocks around it can't, all of them skip to the nearest block's end.
    """
    def pairs(a: np.ndarray, b: np.ndarray, at: np.ndarray, s: int) -> list[tuple[int, float]]:
        return list(zip(a[at[s] : at[s + 1]].tolist(), b[at[s] : at[s + 1]].tolist()))

    cursors = [[pairs(index.items, index.impacts, index.at, s), pairs(index.block_last, index.block_most, index.block_at, s), 0, float(index.most[s])] for s in slots]
    found = []
    while cursors := [c for c in cursors if c[2] < len(c[0])]:
        cursors.sort(key=lambda c: c[0][c[2]][0])
        bound, pivot = 0.0, None
        for k, c in enumerate(cursors):
            bound += c[3]
            if bound >= threshold:
                pivot = k
                break
        if pivot is None:
            break
        item = cursors[pivot][0][cursors[pivot][2]][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0][cursors[pivot + 1][2]][0] == item:
            pivot += 1
        near = []
        for c in cursors[: pivot + 1]:
            b = c[2] // BLOCK
            while b < len(c[1]) and c[1][b][0] < item:
                b += 1
            near.append(c[1][b] if b < len(c[1]) else (item, 0.0))
        if sum(w for _, w in near) < threshold:
            to = min(min((last for last, _ in near), default=item) + 1, cursors[pivot + 1][0][cursors[pivot + 1][2]][0] if pivot + 1 < len(cursors) else 1 << 62)
            to = max(to, item + 1)
        else:
            to = item
            if cursors[0][0][cursors[0][2]][0] == item:
                score = sum(c[0][c[2]][1] for c in cursors[: pivot + 1])
                if score >= threshold:
                    found.append((item, score))
                to = item + 1
        for c in cursors[: pivot + 1]:
            while c[2] < len(c[0]) and c[0][c[2]][0] < to:
                ahead = c[2] // BLOCK
                c[2] = (ahead + 1) * BLOCK if c[1][ahead][0] < to else c[2] + 1
    return found


def verify(index: Index, item: int, passage: np.ndarray) -> tuple[float, float | None, float | None] | None:
    """Shares of the item's shingles, question words and answer words that the passage holds; None if one is below OVERLAP.

    A word is held if a shingle that covers it is. Of an item without a question or without an answer
    only the share of shingles decides; the share of what it lacks is None.
    """
    ids = index.item(item).tolist()
    size, cut = _size(len(ids)), int(index.question[item])
    there = {tuple(t) for t in zip(*[passage[k:].tolist() for k in range(size)])}
    hit = [t in there for t in zip(*[ids[k:] for k in range(size)])]
    covered = [any(hit[max(0, i - size + 1) : i + 1]) for i in range(len(ids))]
    shares = (sum(hit) / len(hit), sum(covered[:cut]) / cut if cut else None, sum(covered[cut:]) / (len(ids) - cut) if cut < len(ids) else None)
    return shares if min(shares[:1] if None in shares else shares) >= OVERLAP - 1e-9 else None


def matches(index: Index, words: list[bytes]) -> dict[int, tuple[float, float, float | None, float | None]]:
    """Items that a text's passages hold: item to score and shares, the best passage's.

    Passages are 2 * longest words and start every longest words: any place of an item lies whole in one.
    """
    found: dict[int, tuple[float, float, float | None, float | None]] = {}
    own = _word_hashes(words)
    ids = np.minimum(np.searchsorted(index.words, own), len(index.words) - 1)
    known = index.words[ids] == own
    ids = np.where(known, ids, -1)
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    for size in index.sizes:
        if len(ids) < size:
            continue
        full = known[: len(ids) - size + 1].copy()
        for k in range(1, size):
            full &= known[k : len(ids) - size + 1 + k]
        at = np.flatnonzero(full)
        if len(at):
            h = np.zeros(len(at), np.uint64)
            for k in range(size):
                h += (ids[at + k].astype(np.uint64) + np.uint64(1)) * _MULT[k]
            h ^= h >> np.uint64(31)
            h = (h * _MULT[1]) ^ np.uint64(size)
            slot = np.minimum(np.searchsorted(index.hashes, h), len(index.hashes) - 1)
            same = index.hashes[slot] == h
            hits.append((at[same], slot[same]))
    if not hits or not sum(len(at) for at, _ in hits):
        return found
    at, slot = (np.concatenate(x) for x in zip(*hits))
    step = index.longest
    for start in sorted({int(s) * step for s in np.unique(at // step)} | {max(0, int(s) - 1) * step for s in np.unique(at // step)}):
        own = np.unique(slot[(at >= start) & (at < start + 2 * step)])
        if not len(own) or index.most[own].sum() < 1:
            continue
        for item, score in block_max_wand(index, own.tolist()):
            if (shares := verify(index, item, ids[start : start + 2 * step])) and (item not in found or score > found[item][0]):
                found[item] = (score, *shares)
    return found


def indexes(items: DataFrame, id_col: str = "item_id", question: str = "text", answer: str | None = None) -> Iterator[Index]:
    """Indexes over parts of the items, INDEX_BYTES of text each at most but for single larger items.

    The parts are by hashed id; one part at a time is on the driver.
    """
    text = F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in (question, answer) if c])
    rows = items.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{question}`").cast("string").alias("q"), (F.col(f"`{answer}`").cast("string") if answer else F.lit(None).cast("string")).alias("a"), F.octet_length(text).alias("n"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    parts = math.ceil(total / (INDEX_BYTES / 2)) or 1
    for part in range(parts):
        own = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("id", "q"), F.lit(parts)) == part)
        index = build_index(sorted(((r["id"], r["q"], r["a"]) for r in own.collect()), key=lambda r: (r[0] is None, r[0], r[1] or "")))
        if index.ids:
            yield index


def contaminations(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", question: str = "text", answer: str | None = None) -> DataFrame:
    """(id, item_id, score, shingle_overlap, question_overlap, answer_overlap) for every row of docs and item that one of its passages holds.

    score is BM25 over the item's threshold; a share of what the item lacks is null. Null and empty texts and items match nothing; items of
    under five words are matched as one shingle; a null id stays null; repeated rows and items match
    each; empty tables give no rows; other columns aren't read. The items must be far fewer than the
    documents, as every part of INDEX_BYTES is one pass over them.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), as_bytes(text_col))
    schema = "id long, item_id long, score double, shingle_overlap double, question_overlap double, answer_overlap double"
    out = spark.createDataFrame([], schema)
    for index in indexes(items, item_id, question, answer):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                found = [(key, index.ids[item], *shares) for key, text in zip(batch.column(0).to_pylist(), batch.column(1)) for item, shares in matches(index, words_of(text.as_py())).items()]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 2 else pa.float64()) for i, c in enumerate(zip(*found))], schema.replace(",", "").split()[::2])

        out = out.unionByName(rows.mapInArrow(frugal(run), schema))
    return out


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", question: str = "text", answer: str | None = None) -> DataFrame:
    """The rows of docs whose passages hold no item; all columns stay.

    Each row is judged by its own text where it lies, without a shuffle, so ids play no part: rows
    with null or shared ids stay or go one by one. Null and empty texts stay; empty tables give
    no rows, or all of docs.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    at, kind = docs.columns.index(text_col), docs.schema
    for index in indexes(items, item_id, question, answer):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                clean = [not matches(index, words_of(text.as_py())) for text in batch.column(at).cast(pa.string()).cast(pa.binary())]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(frugal(run), kind)
    return docs
