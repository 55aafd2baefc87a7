"""Near-duplicates by SimHash fingerprints, found in BK-trees over Hamming distance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm._common import Tables, as_bytes, bounded_batches, frugal, partitions
from granary.llm.components import connected_components, split_join

BITS = 64
SEED = 42


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """A bit is 1 if set in over half the shingles' hashes; no words give 0."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    whole, n = b" ".join(words), len(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(whole, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - shingle] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(whole[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, n - shingle + 1))


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes; no hashes give 0."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long) of every row: words are runs of anything but ASCII space, A-Z in lower case."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), as_bytes(text_col)).mapInArrow(frugal(run), "id long, fp long")


class BKTree:
    """Children are keyed by their integer Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        values, children = self.values, self.children
        at, new = 0, len(values)
        values.append(value)
        children.append({})
        if new:
            while (below := children[at].setdefault((values[at] ^ value).bit_count(), new)) != new:
                at = below

    def within(self, value: int, radius: int) -> list[int]:
        """Nodes at distance radius or less; by the triangle inequality only edges of a like distance can lead there."""
        values, children, found = self.values, self.children, []
        todo = [0] if values else []
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            below = children[at]
            if len(below) <= 2 * radius:
                todo += [c for e, c in below.items() if -radius <= e - d <= radius]
            else:
                todo += [below[e] for e in range(d - radius, d + radius + 1) if e in below]
        return found


def tree_links(stored: list[int], asked: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between stored values, or of stored with asked values: never all pairs."""
    values = stored + (asked or [])
    parent = list(range(len(values)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    tree = BKTree()
    if asked is not None:
        for v in stored:
            tree.add(v)
    links = []
    for i in range(len(stored) if asked is not None else 0, len(values)):
        for j in tree.within(values[i], radius):
            a, b = find(i), find(j)
            if a != b:
                parent[a] = b
                links.append((values[i], values[j]))
        if asked is None:
            tree.add(values[i])
    return links


def tree_units(keyed: DataFrame, key: list[str], node: str, tables: Tables, max_tree: int) -> DataFrame:
    """keyed with i, j, stored: a shard of max_tree rows or fewer is a unit (0, 0) of rows that are stored and asked.

    A larger one is dealt into parts by node; its units are the parts (i, i), and every two of them: i stored, j asked.
    """
    large = tables.cut(keyed.groupBy(*key).count().where(F.col("count") > max_tree).select(*key, F.ceil(F.col("count") / max_tree).cast("int").alias("s")))
    if large.isEmpty():
        return keyed.select("*", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("stored"))
    own = F.pmod(F.xxhash64(node), F.col("s")).cast("int")
    dealt = keyed.join(large, key, "left").withColumn("s", F.coalesce("s", F.lit(1))).withColumn("own", own)
    return dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("other")).select(
        *keyed.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("stored"))


def near_links(prints: DataFrame, tables: Tables, radius: int = 2, max_tree: int = 4096) -> DataFrame:
    """Links (a, b) that connect every two fingerprints (fp long, each once) at distance radius or less.

    Fingerprints are cut in radius + 2 blocks: two that differ in radius bits agree on two blocks at
    least, so shards are keyed by every pair of blocks, and each shard has its own tree. Trees hold
    max_tree nodes at most: a larger shard is dealt into parts, and the tree of each part goes to the
    rows of each other part, so nothing is capped and no tree outgrows a worker. (A tree of all
    fingerprints grows with the corpus, so it can't be broadcast as one; rows go to the tree's task.)
    """
    blocks = radius + 2
    edges_at = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges_at, edges_at[1:])]
    keys = F.array(*[F.struct(F.lit(n).alias("part"), block[i].alias("x"), block[j].alias("y")) for n, (i, j) in enumerate(combinations(range(blocks), 2))])
    keyed = prints.select("fp", F.explode(keys).alias("k")).select("fp", "k.part", "k.x", "k.y")
    key = ["part", "x", "y"]
    unit = [*key, "i", "j"]
    dealt = tree_units(keyed, key, "fp", tables, max_tree).repartition(partitions(prints.sparkSession), *unit).sortWithinPartitions(*unit, F.desc("stored"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _then_none(batches):
            if batch is not None:
                cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(7)]
                held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            if held is None or not len(held[0]):
                continue
            n = len(held[0])
            new = np.ones(n, bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in held[:5]])
            starts = np.flatnonzero(new)
            if batch is not None:  # the last unit may go on in the next batch
                starts, end = starts[:-1], int(starts[-1])
            else:
                end = n
            links: list[tuple[int, int]] = []
            stops = np.append(starts[1:], end) if len(starts) else starts
            many = stops - starts > 1
            for s, e in zip(starts[many].tolist(), stops[many].tolist()):
                values, stored = held[6][s:e].view(np.uint64).tolist(), int(held[5][s:e].sum())
                links += tree_links(values[:stored], None if held[3][s] == held[4][s] else values[stored:], radius)
            held = [c[end:] for c in held]
            if links:
                both = np.array(links, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return dealt.select(*unit, "stored", "fp").mapInArrow(frugal(run), "a long, b long")


def _then_none(batches):
    yield from batches
    yield None


def _groups(docs: DataFrame, tables: Tables, id_col: str, text_col: str, shingle: int, radius: int, max_tree: int) -> tuple[DataFrame, DataFrame]:
    """(id, fp) of every row of docs, and (fp, group, component_id) of every fingerprint; group is the component's least fingerprint, signed."""
    rows = tables.cut(fingerprints(docs, id_col, text_col, shingle))
    nodes = tables.cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = tables.cut(connected_components(near_links(nodes.select("fp"), tables, radius, max_tree), tables))
    grouped = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", "root")
    linked = grouped.where("root is not null")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    alone = grouped.where("root is null").select("fp", F.col("fp").alias("group"), F.col("least").alias("component_id"))
    return rows, alone.unionByName(split_join(linked, least, "root").select("fp", F.col("root").alias("group"), "component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, max_tree: int = 4096) -> DataFrame:
    """(id, fp long, component_id) of every row of docs; component_id is the least id reachable over links.

    Null and empty texts have fingerprint 0 and link like any other; repeated rows and ids each keep
    their row; a null id gets its component's least id, null if there is none; an empty table gives
    no rows; other columns of docs aren't read. Equal fingerprints are one node, so groups of copies
    cost one row each after the first aggregation.
    """
    rows, labels = _groups(docs, Tables(docs.sparkSession, "simhash"), id_col, text_col, shingle, radius, max_tree)
    return rows.join(labels, "fp").select("id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, max_tree: int = 4096) -> DataFrame:
    """The rows of docs with one of each group of near-duplicates: that with the least id; all columns stay.

    A row without an id stays only where no row of its group has one; of rows that share an id or
    have none, the one with the least text stays. Different texts under one id are told apart by
    their groups, so none of them is lost.
    """
    tables = Tables(docs.sparkSession, "simhash-kept")
    rows, labels = _groups(docs, tables, id_col, text_col, shingle, radius, max_tree)
    return least_rows(docs, rows, tables.cut(labels), lambda text: fingerprint(text, shingle), id_col, text_col)


def least_rows(docs: DataFrame, rows: DataFrame, labels: DataFrame, node_of: Callable[[bytes | None], int], id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that one_of_each keeps of groups: rows (id, fp), labels (fp, group, component_id); node_of gives a text's fp."""
    own = F.col(f"`{id_col}`").cast("long")
    if rows.agg(F.count("*") == F.countDistinct("id")).first()[0]:
        return docs.join(labels.select(F.col("component_id").alias("__keep")), own == F.col("__keep"), "left_semi")

    @F.pandas_udf("long")
    def print_of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((node_of(t) for t in texts), np.uint64, len(texts)).view(np.int64))

    # Ids don't tell rows apart here: each group's row is found by fingerprint, aggregated before it is shuffled.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(own.isNull(), own, F.col(f"`{text_col}`")).alias("rank"), print_of(as_bytes(text_col)).alias("fp"))
    return whole.join(labels.select("fp", "group"), "fp").groupBy("group").agg(F.min_by("row", "rank").alias("row")).select("row.*")
