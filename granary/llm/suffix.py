"""Exact substring deduplication over a distributed, sparse suffix array.

Every window of `length` bytes has an anchor, the leftmost least hash of its K-grams; equal windows
have equal anchors at equal offsets. So only suffixes that start at anchors (about 2 in 370
positions for 400 bytes) are gathered, each with the text before it as far as a window can reach.
Several lengths go through one pass: anchors are those of the shortest, and a longer window has the
anchor of the shortest window that it starts with.

1. Anchors with all their context equal elsewhere settle themselves by counting context hashes.
2. The others meet in two cells, by the bytes that all windows of an offset range share (216 of 400 bytes).
   A cell with one context is done. The contexts of the rest are fetched, range-partitioned by
   their leading bytes with sampled splitters, and each bucket sorts its suffixes, and the reversed
   texts before the anchors, by multikey quicksort; windows at an offset are equal if no common
   prefix between them in either order is too short.
3. Splitters never divide a cell: what lies on both sides of a boundary differs in its leading
   bytes, which the windows of a cell share, so nothing is lost there. A cell of too many contexts
   takes no bucket: its windows are counted by hash, offset by offset.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm._common import Tables, as_bytes, bounded_batches, frugal, partitions

LENGTH, K = 400, 32
#: Bytes that a passage of over 50 words has at least, but for one in forty: what the pipeline's stage removes, and what op4's further column tells.
PASSAGE = 256
#: Words that a passage has more than; a run of LENGTH bytes goes whatever its words, as not all scripts part them.
WORDS = 50
#: Most contexts of a cell that one bucket sorts, and rows of a bucket on average.
MAX_CELL, BUCKET_ROWS = 20_000, 12_000
#: Bytes that are searched for anchors at once, and anchors among which a task combines equal contexts.
SPAN, COMBINE = 1 << 16, 1 << 15
#: Bits of the filter that holds documents to be fetched: a broadcast of 2 MB at every size.
FILTER_BITS = 1 << 24

_BYTE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(23))


def _kgram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from every position; k is a power of two."""
    h, step = _BYTE[data], 1
    while step < k:
        h = h[: len(h) - step] * np.uint64(0xD6E8FEB86659FD93) + h[step:]
        h ^= h >> np.uint64(29)
        step *= 2
    return h * np.uint64(0x9E3779B97F4A7C15)


def _sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value of every window: block-wise running minima of packed values."""
    bits = np.uint64(21)
    v = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    n = len(h) - width + 1
    full = np.full(-(-len(h) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[: len(h)] = v
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64((1 << 21) - 1)).astype(np.int64)


def anchors(texts: list[bytes], length: int = LENGTH, k: int = K) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the text, its anchors in order); only texts with a window. A text over SPAN is searched in parts that share a window less a byte."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def search() -> Iterator[tuple[int, np.ndarray]]:
        nonlocal held, size
        data = np.frombuffer(b"".join(x for _, _, x in held), np.uint8)
        at = _sliding_argmin(_kgram_hashes(data, k), length - k + 1)
        start = 0
        for i, offset, x in held:
            own = at[start : start + len(x) - length + 1]
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            yield i, own - start + offset
            start += len(x)
        held, size = [], 0

    for i, text in enumerate(texts):
        if len(text) < length:
            continue
        if len(text) > SPAN:
            parts = []
            for at in range(0, len(text) - length + 1, SPAN - length + 1):
                mine, kept = [(i, at, text[at : at + SPAN])], (held, size)
                held, size = mine, 0
                parts += [x for _, x in search()]
                held, size = kept
            yield i, np.unique(np.concatenate(parts))
            continue
        if size + len(text) > SPAN:
            yield from search()
        held.append((i, 0, text))
        size += len(text)
    if held:
        yield from search()


def _key(data: bytes) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(data), "big", signed=True)


def _two(data: bytes, seed: int = 0) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(data, seed)
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def quicksort_order(group: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Order of rows by group and then by their token rows: multikey quicksort, a token a round, on ties only."""
    order = np.argsort(group, kind="stable")
    tie = np.zeros(len(order), np.int64)  # the first place of the run of equals that a place is in
    tie[1:] = np.where(group[order][1:] != group[order][:-1], np.arange(1, len(order)), 0)
    tie = np.maximum.accumulate(tie)
    for d in range(tokens.shape[1]):
        first = np.concatenate(([True], tie[1:] != tie[:-1]))
        many = np.flatnonzero(~first | np.append(~first[1:], False))
        if not len(many):
            break
        value = tokens[order[many], d]
        by = np.lexsort((value, tie[many]))
        order[many] = order[many][by]
        value = value[by]
        new = np.concatenate(([True], (value[1:] != value[:-1]) | (tie[many][1:] != tie[many][:-1])))
        tie[many] = many[np.maximum.accumulate(np.where(new, np.arange(len(many)), 0))]
    return order


def _tokens(matrix: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(matrix).view(">u8").astype(np.uint64)


def _common(order: np.ndarray, group: np.ndarray, matrix: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length of the prefix that each place shares with the one before, 0 at a group's start."""
    a, b = order[1:], order[:-1]
    lcp = np.zeros(len(order), np.int64)
    for at in range(0, len(a), 8192):
        x, y = a[at : at + 8192], b[at : at + 8192]
        off = matrix[x] != matrix[y]
        n = np.where(off.any(axis=1), off.argmax(axis=1), matrix.shape[1])
        lcp[at + 1 : at + 1 + len(x)] = np.where(group[x] == group[y], np.minimum(np.minimum(n, sizes[x]), sizes[y]), 0)
    return lcp


def settle(cell: np.ndarray, which: np.ndarray, before: list[bytes], after: list[bytes], lengths: tuple[int, ...] = (LENGTH,), k: int = K) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length the least and largest offset (-1: none) at which a context's window equals another's of its cell.

    cell: the cell's number; which: 0 or 1, the offset range; before: bytes before the anchor (as
    far as the shortest window reaches), after: bytes from the anchor on. All windows of a context
    hold its anchor, so those found make one run of bytes.
    """
    n, reach, longest = len(cell), min(lengths) - k, max(lengths)
    half = reach // 2
    left, right = np.zeros((n, -(-reach // 8) * 8), np.uint8), np.zeros((n, -(-longest // 8) * 8), np.uint8)
    nl, nr = np.fromiter(map(len, before), np.int64, n), np.fromiter(map(len, after), np.int64, n)
    for i in range(n):
        left[i, : nl[i]] = np.frombuffer(before[i], np.uint8)[::-1]
        right[i, : nr[i]] = np.frombuffer(after[i], np.uint8)
    ol, orr = quicksort_order(cell, _tokens(left)), quicksort_order(cell, _tokens(right))
    ll, lr = _common(ol, cell, left, nl), _common(orr, cell, right, nr)
    head_l, head_r = np.concatenate(([True], cell[ol][1:] != cell[ol][:-1])), np.concatenate(([True], cell[orr][1:] != cell[orr][:-1]))
    found = [(np.full(n, -1), np.full(n, -1)) for _ in lengths]
    for o in range(reach + 1):
        ranged = ((which == 0) & (o <= half) | (which == 1) & (o >= half)) & (nl >= o)
        a = np.empty(n, np.int64)
        a[ol] = np.cumsum(head_l | (ll < o))
        for length, (least, most) in zip(lengths, found):
            rows = np.flatnonzero(ranged & (nr >= length - o))
            if not len(rows):
                continue
            b = np.empty(n, np.int64)
            b[orr] = np.cumsum(head_r | (lr < length - o))
            both = a[rows] * (n + 1) + b[rows]
            by = np.argsort(both, kind="stable")
            same = both[by][1:] == both[by][:-1]
            dup = rows[by[np.append(False, same) | np.append(same, False)]]
            least[dup] = np.where(least[dup] < 0, o, least[dup])
            most[dup] = o
    return found


def _rows(names: str, rows: list[tuple], kinds: str = "") -> pa.RecordBatch:
    """l: long, b: binary."""
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if kind == "b" else pa.int64()) for c, kind in zip(cols, kinds or "l" * len(cols))], names.split())


def _find_anchors(length: int, longest: int, k: int):
    reach, half = length - k, (length - k) // 2
    names = "t1 t2 pos first last c1 c2 k0 k1 n"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], list] = {}
        done: list[tuple] = []

        def ready() -> Iterator[pa.RecordBatch]:
            rows = done + [tuple(x) for x in seen.values()]
            for at in range(0, len(rows), 20_000):
                yield _rows(names, rows[at : at + 20_000])
            seen.clear()
            done.clear()

        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column(0)]
            for i, at in anchors(texts, length, k):
                text = texts[i]
                t1, t2 = _two(text)
                for a in at.tolist():
                    lo, hi = max(0, a - reach), min(len(text), a + longest)
                    c = _two(text[lo:hi], a - lo)
                    if (known := seen.get(c)) is not None:
                        known[9] += 1
                        done.append((t1, t2, a, lo, hi, None, None, None, None, None))
                    else:
                        seen[c] = [t1, t2, a, lo, hi, *c, _key(text[a : a + length - half]) if hi - a >= length - half else None, _key(text[a - half : a + length - reach]) if a - lo >= half else None, 1]
                if len(seen) + len(done) >= COMBINE:
                    yield from ready()
        if seen or done:
            yield from ready()

    return run, ", ".join(f"{x} long" for x in names.split())


def _filter_bits(tables: Tables, names: DataFrame) -> np.ndarray:
    """A bit for each hashed text name; FILTER_BITS at every size, so with very many names it only lets more texts through."""
    bit = F.pmod("t1", F.lit(FILTER_BITS))
    rows = names.select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 8 + 8192, np.uint8)
    for r in rows:
        at = (r["bucket"] - 1) * 4096 if r["bucket"] > 0 else 0
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        bits[at : at + len(part)] |= part
    return bits


def _in(bits: np.ndarray, t1: int) -> bool:
    b = t1 % FILTER_BITS
    bucket, position = (b + 32767) // 32768 if b > 0 else 0, (b - 1) % 32768 if b > 0 else 0
    at = ((bucket - 1) * 4096 if bucket > 0 else 0) + position // 8
    return bool(bits[at] >> (position % 8) & 1)


def repeated_spans(docs: DataFrame, text_col: str, tables: Tables, lengths: tuple[int, ...] = (LENGTH,), k: int = K, max_cell: int = MAX_CELL) -> DataFrame:
    """(t1, t2, spans array<struct<l, s, e>>): what windows of l bytes that start elsewhere too cover in the texts with that 128-bit name."""
    spark = docs.sparkSession
    bounded_batches(spark)
    length, longest = min(lengths), max(lengths)
    half, reach = (length - k) // 2, length - k
    texts = docs.select(as_bytes(text_col).alias("text"))
    run, schema = _find_anchors(length, longest, k)
    found = tables.cut(texts.mapInArrow(frugal(run), schema))
    kept = found.where("n is not null").repartition(partitions(spark), "c1", "c2")
    counts = kept.groupBy("c1", "c2").agg(F.sum("n").alias("all"), F.min(F.struct("t1", "t2", "pos", "k0", "k1")).alias("r"))
    whole = kept.join(counts.where("all > 1").select("c1", "c2"), ["c1", "c2"], "left_semi").select("t1", "t2", F.col("first").alias("s"), F.col("last").alias("e"))
    cells = counts.select("r.t1", "r.t2", "r.pos", "r.k0", "r.k1", (F.col("all") == 1).alias("open")).select("t1", "t2", "pos", "open", F.explode(F.array(F.struct(F.lit(0).alias("w"), F.col("k0").alias("key")), F.struct(F.lit(1).alias("w"), F.col("k1").alias("key")))).alias("c")).select("t1", "t2", "pos", "open", "c.w", "c.key").where("key is not null")
    shared = cells.groupBy("key", "w").agg(F.count("*").alias("m"), F.max("open").alias("any_open")).where("m > 1 and any_open").select("key", "w", (F.col("m") > max_cell).alias("hot"))
    # Another key than the aggregation's, so that both sides are shuffled for the join and a hot cell's side can be split.
    again = F.col("key").bitwiseXOR(F.lit(0x5BD1E995))
    met = tables.cut(cells.withColumn("j", again).join(shared.select(again.alias("j"), "w", "hot"), ["j", "w"]).select("t1", "t2", "pos", "open", "w", "key", "hot"))
    each = F.explode(F.array(*[F.lit(x).cast("long") for x in lengths]))
    covered = whole.unionByName(found.where("n is null").select("t1", "t2", F.col("first").alias("s"), F.col("last").alias("e"))).distinct()
    covered = tables.cut(covered.select("t1", "t2", each.alias("l"), "s", "e").where("e - s >= l"))
    tables.drop(found)

    n_met = met.agg(F.count("*"), F.count_if("hot")).first()
    if not n_met[0]:
        return _gathered(covered)
    bits = spark.sparkContext.broadcast(_filter_bits(tables, met.select("t1")))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, mine = zstandard.ZstdCompressor(level=1), bits.value
        for batch in batches:
            out, names = [], set()
            for x in batch.column(0):
                if (text := x.as_py()) and len(text) >= length and (t := _two(text)) not in names and _in(mine, t[0]):
                    names.add(t)
                    out.append((*t, press.compress(text)))
            if out:
                yield _rows("t1 t2 z", out, "llb")

    asked = met.groupBy("t1", "t2").agg(F.collect_list(F.struct("pos", "open", "w", "key", "hot")).alias("at"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["t1", "t2", "pos", "cut", "open", "w", "key", "hot", "lead", "context"]
        kinds = [pa.int64()] * 4 + [pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
        for batch in batches:
            t1, t2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for i in range(batch.num_rows):
                text = zstandard.decompress(batch.column(2)[i].as_py())
                for c in batch.column(3)[i].as_py():
                    from_, first = c["pos"] - (half if c["w"] else 0), max(0, c["pos"] - reach)
                    out.append((t1[i], t2[i], c["pos"], c["pos"] - first, c["open"], c["w"], c["key"], c["hot"], int.from_bytes(text[from_ : from_ + 8], "big", signed=True), text[first : c["pos"] + longest]))
                if len(out) >= 4000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds)], names)

    context = texts.mapInArrow(frugal(fetch), "t1 long, t2 long, z binary").join(asked, ["t1", "t2"]).select("t1", "t2", "z", "at").mapInArrow(contexts, "t1 long, t2 long, pos long, cut long, open boolean, w long, key long, hot boolean, lead long, context binary")
    context = tables.cut(context)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        col = {c: table[c].to_numpy() for c in ("t1", "t2", "pos", "cut", "open", "w", "key")}
        names = np.stack([col[c] for c in ("key", "w", "t1", "t2", "pos")])
        once = np.sort(np.unique(names, axis=1, return_index=True)[1])  # a context can come from several copies of its text
        cell = np.unique(names[:2, once], axis=1, return_inverse=True)[1].ravel()
        context = table["context"].take(pa.array(once)).to_pylist()
        cut = col["cut"][once].tolist()
        settled = settle(cell, col["w"][once], [x[:c] for x, c in zip(context, cut)], [x[c:] for x, c in zip(context, cut)], lengths, k)
        for size, (least, most) in zip(lengths, settled):
            hit = np.flatnonzero((most >= 0) & col["open"][once])
            if len(hit):
                rows = once[hit]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (col["t1"][rows], col["t2"][rows], np.full(len(hit), size), col["pos"][rows] - most[hit], col["pos"][rows] + size - least[hit])], ["t1", "t2", "l", "s", "e"])

    buckets = max(1, -(-(n_met[0] - n_met[1]) // BUCKET_ROWS))
    by_bucket = context.where("not hot").repartitionByRange(buckets, "lead", "key", "w")
    spans = covered.unionByName(by_bucket.select("t1", "t2", "pos", "cut", "open", "w", "key", "context").mapInArrow(frugal(sort), "t1 long, t2 long, l long, s long, e long"))
    if n_met[1]:
        spans = spans.unionByName(_counted(context.where("hot"), tables, lengths, half, reach))
    return _gathered(spans)


def _counted(context: DataFrame, tables: Tables, lengths: tuple[int, ...], half: int, reach: int) -> DataFrame:
    """Spans of contexts of hot cells: all windows of the cell's offsets are counted by a 128-bit hash."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                x, cut = r["context"], r["cut"]
                lo, hi = (half, reach) if r["w"] else (0, half)
                out += [(r["t1"], r["t2"], size, r["pos"] - o, *_two(x[cut - o : cut - o + size], size)) for size in lengths for o in range(lo, hi + 1) if o <= cut and len(x) - cut + o >= size]
                if len(out) > 50_000:
                    yield _rows("t1 t2 l s h1 h2", out)
                    out = []
            if out:
                yield _rows("t1 t2 l s h1 h2", out)

    rows = context.dropDuplicates(["t1", "t2", "pos", "w"]).mapInArrow(frugal(windows), "t1 long, t2 long, l long, s long, h1 long, h2 long")
    rows = tables.cut(rows.dropDuplicates(["t1", "t2", "l", "s"]))  # a window can hold two hot anchors
    other = F.col("h1").bitwiseXOR(F.lit(0x5BD1E995))  # as above: a hot window's rows can be split
    again = rows.groupBy("h1", "h2").count().where("count > 1").select(other.alias("j"), "h2")
    return rows.withColumn("j", other).join(again, ["j", "h2"]).select("t1", "t2", "l", "s", (F.col("s") + F.col("l")).alias("e"))


def _gathered(spans: DataFrame) -> DataFrame:
    """A text's spans are as many as its own bytes allow, however many copies it has."""
    return spans.groupBy("t1", "t2").agg(F.sort_array(F.collect_set(F.struct("l", "s", "e"))).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def without_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, k: int = K, max_cell: int = MAX_CELL, as_text: bool = False, also: int | None = None, words: int | None = None) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans (long), and kept in place of the text: bytes, or text if asked, where code points that lost bytes go.

    Removed is every byte of a string of `length` bytes that also starts anywhere else in the column;
    all places go, the first too. also: a second, shorter length, by which nothing is removed; n_repeated
    (long), which is there only if it is asked for, says how many bytes that rule covers. words: a maximal run
    under LENGTH bytes stays unless it has more words (parts between ASCII spaces) than that; None: all runs go. Null texts are empty; texts shorter than `length` stay whole; equal
    rows lose what they share; ids play no part; an empty table gives no rows; columns with these
    names in docs are replaced, others stay.
    """
    spark = docs.sparkSession
    tables, added, least = Tables(spark, "suffix"), ["n_bytes", "n_removed", "n_spans", *["n_repeated"] * bool(also)], min(length, also or length)
    docs = docs.drop(*[c for c in (*added, "kept") if c != text_col])
    spans = tables.cut(repeated_spans(docs, text_col, tables, (length, also) if also else (length,), k, max_cell))
    bits = spark.sparkContext.broadcast(_filter_bits(tables, spans.select("t1")))
    rest = [c for c in docs.columns if c != text_col]
    row = docs.select(F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in rest]).alias("row"), as_bytes(text_col).alias("text"))
    kind = row.schema["row"].dataType.simpleString()

    def given(kept: list[bytes]) -> pa.Array:
        return pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())

    def deal(inside: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            press, mine = zstandard.ZstdCompressor(level=1), bits.value
            for batch in batches:
                take, t1, t2, out = [], [], [], []
                for i, x in enumerate(batch.column(1)):
                    text = x.as_py() or b""
                    t = _two(text) if len(text) >= least else None
                    if (t is not None and _in(mine, t[0])) == inside:
                        take.append(i)
                        t1.append(t[0] if t else None)
                        t2.append(t[1] if t else None)
                        out.append(press.compress(text) if inside else text)
                rows = batch.column(0).take(pa.array(take, pa.int64()))
                if inside:
                    yield pa.RecordBatch.from_arrays([rows, pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array(out, pa.binary())], ["row", "t1", "t2", "z"])
                else:
                    zero = pa.array(np.zeros(len(take), np.int64))
                    yield pa.RecordBatch.from_arrays([rows, pa.array([len(x) for x in out], pa.int64()), *[zero] * (len(added) - 1), given(out)], ["row", *added, "kept"])

        return run

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for z, spans in zip(batch.column(1), batch.column(2)):
                text, at, parts = zstandard.decompress(z.as_py()), 0, []
                spans = spans.as_py() or []
                runs = merged([(x["s"], x["e"]) for x in spans if x["l"] == length])
                if words is not None:
                    runs = [(s, e) for s, e in runs if e - s >= LENGTH or len(text[s:e].split()) > words]
                for s, e in runs:
                    parts.append(text[at:s])
                    at = e
                kept = b"".join([*parts, text[at:]])
                repeated = [sum(e - s for s, e in merged([(x["s"], x["e"]) for x in spans if x["l"] == also]))] if also else []
                out.append((len(text), len(text) - len(kept), len(runs), *repeated, kept))
            *counts, kept = list(zip(*out)) or [[]] * (len(added) + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], given(kept)], ["row", *added, "kept"])

    result = f"row {kind}, n_bytes long, n_removed long, n_spans long{", n_repeated long" if also else ""}, kept {'string' if as_text else 'binary'}"
    same = row.mapInArrow(frugal(deal(False)), result)
    other = row.mapInArrow(frugal(deal(True)), f"row {kind}, t1 long, t2 long, z binary").join(spans, ["t1", "t2"], "left").select("row", "z", "spans").mapInArrow(cut, result)
    return same.unionByName(other).select(*[F.col("row").getField(c).alias(c) for c in rest], *added, "kept")
