"""Drawing-command token sequences: classes, factorization, and vectorized Python for its inverse and the grammar."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType


@dataclass(frozen=True)
class Codebook:
    """Id ranges of the token classes.

    Fixed values: ranges (both ends included), grid, framing, and the arguments of each command
    from the first on (c: coordinate, a: arc).
    """

    grid: int = 200
    command: tuple[int, int] = (151938, 151942)
    coordinate: tuple[int, int] = (151943, 191942)
    color: tuple[int, int] = (191946, 196043)
    arc: tuple[int, int] = (196436, 196535)
    bos: int = 196998
    eos: int = 196999
    special_colors: int = 2
    arguments: tuple[str, ...] = ("cc", "c", "ccc", "caaac", "c")

    def shifted(self, by: int) -> Codebook:
        """The same book with ids moved, as registered vocabularies have them."""
        move = lambda r: (r[0] + by, r[1] + by)
        return Codebook(self.grid, move(self.command), move(self.coordinate), move(self.color), move(self.arc), self.bos + by, self.eos + by, self.special_colors, self.arguments)

    def sizes(self) -> dict[str, int]:
        """Vocabulary sizes: contiguous ids, ids that an encoder makes, and both factorizations."""
        n = lambda r: r[1] - r[0] + 1
        rest = n(self.command) + n(self.arc) + 2
        return {
            "contiguous": self.eos - self.command[0] + 1,
            "atomic": rest + self.grid**2 + n(self.color),
            "xy": rest + 2 * self.grid + n(self.color),
            "xy_rgb": rest + 2 * self.grid + 3 * 16 + self.special_colors + 1,
        }


BOOK = Codebook()


def token_kind(i: Column, book: Codebook = BOOK) -> Column:
    """Class of an id; null for one that no encoder makes."""
    kind = F.when(i == book.bos, "bos").when(i == book.eos, "eos")
    for name in ("command", "coordinate", "color", "arc"):
        kind = kind.when(i.between(*getattr(book, name)), name)
    return kind


def _component(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.cast("int").alias("value"))


def _plain(i: Column, book: Codebook) -> Column:
    """Classes that factorization leaves whole; the value counts from the class's first id."""
    kind = token_kind(i, book)
    first = F.when(kind == "command", book.command[0]).when(kind == "arc", book.arc[0]).when(kind == "color", book.color[0]).otherwise(i)
    return F.array(F.struct(kind.alias("kind"), (i - first).cast("int").alias("value")))


def factorize_xy(ids: Column, book: Codebook = BOOK) -> Column:
    """array<struct<kind, value>>: each coordinate becomes its x and its y."""

    def one(i: Column) -> Column:
        at = i - book.coordinate[0]
        return F.when(i.between(*book.coordinate), F.array(_component("x", at % book.grid), _component("y", F.floor(at / book.grid)))).otherwise(_plain(i, book))

    return F.flatten(F.transform(ids, one))


def factorize_xy_rgb(ids: Column, book: Codebook = BOOK) -> Column:
    """As factorize_xy; each color becomes its channels, or one special color, and a path end."""

    def one(i: Column) -> Column:
        at, c = i - book.coordinate[0], (i - book.color[0]).cast("int")
        rgb = c - book.special_colors
        nibble = lambda shift: F.shiftright(rgb, shift).bitwiseAND(F.lit(15))
        end = _component("path_end", F.lit(0))
        return (
            F.when(i.between(*book.coordinate), F.array(_component("x", at % book.grid), _component("y", F.floor(at / book.grid))))
            .when(i.between(*book.color) & (c < book.special_colors), F.array(_component("special_color", c), end))
            .when(i.between(*book.color), F.array(_component("r", nibble(8)), _component("g", nibble(4)), _component("b", nibble(0)), end))
            .otherwise(_plain(i, book))
        )

    return F.flatten(F.transform(ids, one))


KINDS = ("x", "y", "r", "g", "b", "path_end", "special_color", "command", "arc", "color", "bos", "eos")


def _inverted(parts: pa.Array, book: Codebook) -> pa.Array:
    """Every part looks at its neighbours in its own row, over all rows of the batch at once."""
    sizes, flat = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(), pc.list_flatten(parts)
    kind = pc.fill_null(pc.index_in(flat.field("kind"), value_set=pa.array(KINDS)), len(KINDS)).to_numpy()
    value = pc.fill_null(flat.field("value").cast(pa.int64()), -1).to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    x, y, r, g, b, end, special, command, arc, color, bos, eos = range(len(KINDS))

    def beside(values: np.ndarray, n: int) -> np.ndarray:
        out = np.full(len(values), -1, np.int64)
        here, there = (slice(None, -n), slice(n, None)) if n > 0 else (slice(-n, None), slice(None, n))
        out[here] = np.where(row[here] == row[there], values[there], -1)
        return out

    fits = np.isin(kind, (command, arc, color, bos, eos))
    within = lambda n: (value >= 0) & (value < n)
    for k, size, at in ((x, book.grid, {1: (y,)}), (y, book.grid, {-1: (x,)}), (r, 16, {1: (g,), 2: (b,), 3: (end,)}), (g, 16, {-1: (r,)}), (b, 16, {-1: (g,)}), (special, book.special_colors, {1: (end,)}), (end, 1, {-1: (b, special)})):
        ok = (kind == k) & within(size)
        for n, allowed in at.items():
            ok &= np.isin(beside(kind, n), allowed)
        fits |= ok
    first = {y: book.coordinate[0], b: book.color[0] + book.special_colors, special: book.color[0], color: book.color[0], command: book.command[0], arc: book.arc[0], bos: book.bos, eos: book.eos}
    ids, gives = np.zeros(len(kind), np.int64), np.isin(kind, list(first))
    for k, base in first.items():
        own = kind == k
        ids[own] = base + (value[own] if k not in (bos, eos) else 0)
    ids += np.where(kind == y, (book.grid - 1) * value + beside(value, -1), 0) + np.where(kind == b, 256 * beside(value, -2) + 16 * beside(value, -1), 0)
    bad = np.bincount(row[~fits], minlength=len(sizes)) > 0
    bad |= pc.is_null(parts).to_numpy(zero_copy_only=False)
    keep = gives & ~bad[row]
    ends = np.concatenate(([0], np.cumsum(np.bincount(row[keep], minlength=len(sizes))))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[keep]), mask=pa.array(bad))


def invert(parts: Column, book: Codebook = BOOK) -> Column:
    """Ids of a factorized sequence of either kind; null if its parts don't follow one another as factorization makes them."""

    def run(batch: pa.Array) -> pa.Array:
        return _inverted(batch, book)

    return F.arrow_udf(run, ArrayType(LongType()))(parts)


#: Result of the grammar: counts, or the first error and its place in the body.
FEATURES = StructType([StructField(n, IntegerType()) for n in ("coordinates", "colors", "rgb_colors", "special_colors", "commands", "arcs", "paths", "error_at")] + [StructField("error", StringType())])


def parse(ids: list[int], book: Codebook = BOOK) -> dict:
    """Walk a framed sequence as a small automaton: what may come next is a stack of expected argument classes."""

    def kind(i: int) -> str:
        if i in (book.bos, book.eos):
            return "frame"
        return next((n for n in ("command", "coordinate", "color", "arc") if getattr(book, n)[0] <= i <= getattr(book, n)[1]), "reserved")

    n = dict.fromkeys(("coordinates", "colors", "rgb_colors", "special_colors", "commands", "arcs", "paths"), 0)
    fail = lambda at, error: dict.fromkeys(n) | {"error_at": at, "error": error}
    if len(ids) < 3:
        return fail(None, "empty_body")
    if ids[0] != book.bos or ids[-1] != book.eos:
        return fail(None, "framing")
    wanted, in_path = [], 0
    for at, i in enumerate(ids[1:-1]):
        k = kind(i)
        if k in ("frame", "reserved"):
            return fail(at, "inner_framing" if k == "frame" else "reserved_id")
        if wanted:
            if k != wanted.pop():
                return fail(at, "argument")
            n["coordinates" if k == "coordinate" else "arcs"] += 1
        elif k == "command":
            n["commands"], in_path = n["commands"] + 1, in_path + 1
            wanted = [{"c": "coordinate", "a": "arc"}[a] for a in reversed(book.arguments[i - book.command[0]])]
        elif k == "color":
            if not in_path:
                return fail(at, "color_without_command")
            n["special_colors" if i - book.color[0] < book.special_colors else "rgb_colors"] += 1
            n["paths"], n["colors"], in_path = n["paths"] + 1, n["colors"] + 1, 0
        else:
            return fail(at, "expected_command")
    if wanted or in_path:
        return fail(len(ids) - 2, "truncated_command" if wanted else "open_path")
    return n | {"error_at": None, "error": None}


#: Errors of parse(), by number: the first of those that hold for a token is its error.
ERRORS = ("", "inner_framing", "reserved_id", "argument", "color_without_command", "expected_command", "empty_body", "framing", "truncated_command", "open_path")


def features(rows: list, book: Codebook = BOOK) -> dict[str, list]:
    """parse() of many sequences at once, over their flattened ids.

    Up to a sequence's first error every command before a token is a true one, so the last command
    and the last color before a token say what may stand there.
    """
    known = [x for x in rows if x is not None]
    sizes = np.fromiter(map(len, known), np.int64, len(known))
    flat = np.concatenate([np.asarray(x, np.int64) for x in known]) if known else np.empty(0, np.int64)
    start, row = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(known)), sizes)
    within = lambda r: (flat >= r[0]) & (flat <= r[1])
    command, coordinate, color, arc = map(within, (book.command, book.coordinate, book.color, book.arc))
    frame, at = (flat == book.bos) | (flat == book.eos), np.arange(len(flat))
    inner = (at > start[row]) & (at < (start + sizes - 1)[row]) if len(flat) else np.empty(0, bool)

    def before(mark: np.ndarray) -> np.ndarray:
        """Where the last marked token before this one is, in its own body; else -1."""
        last = np.maximum.accumulate(np.where(mark & inner, at, -1)) if len(at) else at
        last = np.concatenate(([-1], last[:-1]))[: len(at)]
        return np.where(last >= start[row], last, -1) if len(at) else last

    arity = np.array([len(x) for x in book.arguments])
    wants_arc = np.zeros((len(arity), int(arity.max()) + 1), bool)
    for k, x in enumerate(book.arguments):
        for j, c in enumerate(x):
            wants_arc[k, j + 1] = c == "a"
    c, last_color = before(command), before(color)
    which = np.where(c >= 0, flat[c] - book.command[0], 0) if len(flat) else c
    step = np.where(c >= 0, at - c, 0)
    due = (c >= 0) & (step <= arity[which]) if len(flat) else np.empty(0, bool)
    fits = np.where(wants_arc[which, np.minimum(step, wants_arc.shape[1] - 1)], arc, coordinate) if len(flat) else due
    in_path = c > last_color
    reserved = ~(frame | command | coordinate | color | arc)
    error = np.select([frame, reserved, due & ~fits, ~due & color & ~in_path, ~due & ~color & ~command], [1, 2, 3, 4, 5], 0)
    error = np.where(inner, error, 0)
    first = np.full(len(known), -1)
    bad = np.flatnonzero(error)[::-1]
    first[row[bad]] = bad
    end = np.maximum(start + sizes - 1, 0)
    code, place = np.zeros(len(known), np.int64), np.full(len(known), -1)
    for i in range(len(known)):
        if sizes[i] < 3:
            code[i] = 6
        elif flat[start[i]] != book.bos or flat[end[i]] != book.eos:
            code[i] = 7
        elif first[i] >= 0:
            code[i], place[i] = error[first[i]], first[i] - start[i] - 1
        elif c[end[i]] >= 0 and end[i] - c[end[i]] <= arity[which[end[i]]]:
            code[i], place[i] = 8, sizes[i] - 2
        elif in_path[end[i]]:
            code[i], place[i] = 9, sizes[i] - 2
    special = color & (flat - book.color[0] < book.special_colors)
    count = lambda mark: np.bincount(row[mark & inner], minlength=len(known))
    n = {"coordinates": count(coordinate), "colors": count(color), "rgb_colors": count(color & ~special), "special_colors": count(special), "commands": count(command), "arcs": count(arc), "paths": count(color)}
    out: dict[str, list] = {name: [] for name in FEATURES.names}
    k = -1
    for x in rows:
        k += x is not None
        ok = x is not None and not code[k]
        for name, values in n.items():
            out[name].append(int(values[k]) if ok else None)
        out["error_at"].append(int(place[k]) if x is not None and place[k] >= 0 else None)
        out["error"].append(ERRORS[code[k]] if x is not None and code[k] else None)
    return out


@F.pandas_udf(FEATURES)
def sequence_features(ids: pd.Series) -> pd.DataFrame:
    """Counts of a framed sequence, or its first error; a null sequence gives nulls."""
    return pd.DataFrame(features(ids.tolist()), columns=FEATURES.names).astype({n: "Int32" for n in FEATURES.names[:-1]})


def component_counts(df: DataFrame, ids: str, factorize: Callable[[Column], Column]) -> DataFrame:
    """(kind, value, n) of the parts of all ids: ids are counted, and only the different ones, as many as the vocabulary at most, are factorized."""
    counted = df.select(F.explode(ids).alias("i")).groupBy("i").agg(F.count("*").alias("c"))
    return counted.select(F.explode(factorize(F.array("i"))).alias("p"), "c").groupBy("p.kind", "p.value").agg(F.sum("c").alias("n"))


def recovered_prefix(ids: list[int], book: Codebook = BOOK) -> list[int]:
    """The longest prefix of whole paths, framed again; empty if there is none."""
    body = [i for i in ids if i not in (book.bos, book.eos)]
    ends = [k + 1 for k, i in enumerate(body) if book.color[0] <= i <= book.color[1]]
    for end in reversed(ends):
        framed = [book.bos, *body[:end], book.eos]
        if parse(framed, book)["error"] is None:
            return framed
    return []


@F.pandas_udf(ArrayType(IntegerType()))
def recover(ids: pd.Series) -> pd.Series:
    return ids.map(lambda x: None if x is None else recovered_prefix(list(map(int, x))))


def named(i: Column, book: Codebook = BOOK) -> Column:
    """`<|svg_n|>` of an id, n from the first command on."""
    return F.concat(F.lit("<|svg_"), (i - book.command[0]).cast("string"), F.lit("|>"))


def unnamed(name: Column, book: Codebook = BOOK) -> Column:
    return F.nullif(F.regexp_extract(name, r"^<\|svg_(\d+)\|>$", 1), F.lit("")).cast("int") + book.command[0]


def upstream(i: Column, registered: Codebook, book: Codebook = BOOK) -> Column:
    """The upstream id of a registered one; null outside the registered range."""
    return F.when(i.between(registered.command[0], registered.eos), i - registered.command[0] + book.command[0])


def response_roles(ids: Column, book: Codebook = BOOK) -> Column:
    """Role of every token of a response: structure, geometry, style, framing."""
    role = lambda i: F.coalesce(F.when(token_kind(i, book) == "command", "structure").when(token_kind(i, book).isin("coordinate", "arc"), "geometry").when(token_kind(i, book) == "color", "style"), F.lit("framing"))
    return F.transform(ids, role)


def role_weights(roles: Column, weights: dict[str, float]) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
    return F.transform(roles, lambda r: F.coalesce(F.element_at(table, r), F.lit(1.0)))


def masked_labels(ids: Column, starts: Column, ends: Column, span_start: Column, span_end: Column, ignore: int = -100) -> Column:
    """Labels of tokens whose characters lie in the target span; others are `ignore`."""
    zipped = F.arrays_zip(ids.alias("i"), starts.alias("s"), ends.alias("e"))
    return F.transform(zipped, lambda t: F.when((t.getField("s") >= span_start) & (t.getField("e") <= span_end) & (t.getField("e") > t.getField("s")), t.getField("i")).otherwise(F.lit(ignore)))


def padded(values: Column, size: Column, pad: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(pad).cast("int"), (size - F.size(values)).cast("int")))

