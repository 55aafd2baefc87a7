"""A codec for path-only markup on a grid of points: one automaton serves encoding checks, decoding and constrained generation."""

from __future__ import annotations

import math
import re
from functools import cached_property
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from granary.functions.markup import SVG, _parsed, _split

_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_LEXEME = re.compile(rf"\s*,?\s*(?:([MLCAZ])|({_NUMBER}))")
_COLOR = re.compile(r"#(?:[0-9a-f]{3}|[0-9a-f]{6})")
#: Numbers that a path command takes; token names, in `token` and `classes`, are fixed too.
ARITY = {"M": 2, "L": 2, "C": 6, "A": 7, "Z": 0}
#: Largest text in bytes, and most paths.
MOST_BYTES, MOST_PATHS = 8 << 20, 2048

_OPEN = {"M": "point", "L": "point", "C": "c1", "A": "radius", "Z": "closed", "F": "fill"}
#: State to what may come next, as classes of tokens, and the state after it.
AUTOMATON: dict[str, dict[str, str]] = {
    "start": {"sop": "first"}, "first": {"M": "point"}, "point": {"xy": "open"}, "open": _OPEN, "closed": {"M": "point", "F": "fill"},
    "c1": {"xy": "c2"}, "c2": {"xy": "point"}, "radius": {"radius": "rotation"}, "rotation": {"rot": "large"}, "large": {"flag": "sweep"}, "sweep": {"flag": "point"},
    "fill": {"color": "end"}, "end": {"eop": "between"}, "between": {"sop": "first", "eos": "done"}, "done": {"eos": "done"},
}


class PathCodec:
    """Markup of direct path children with absolute M, L, C, A, Z and a plain fill, as tokens `<|svgd1:...|>`; all else is refused."""

    def __init__(self, grid: int = 200):
        if grid < 2:
            raise ValueError("a grid has two points a side at least")
        self.grid, self.width = grid, len(str(grid * grid - 1))

    @staticmethod
    def token(body: str) -> str:
        return f"<|svgd1:{body}|>"

    @cached_property
    def classes(self) -> dict[str, list[str]]:
        """Tokens by class, each in its order."""
        cell = [self.token(f"xy:{i:0{self.width}d}") for i in range(self.grid**2)]
        return {
            **{k: [self.token(k)] for k in ("sop", "eop", "eos")}, **{k: [self.token(f"cmd:{k}")] for k in "MLCAZF"}, "flag": [self.token(f"flag:{i}") for i in (0, 1)],
            "rot": [self.token(f"rot:{i:03d}") for i in range(360)], "xy": cell, "radius": [t for i, t in enumerate(cell) if i % self.grid and i // self.grid],
            "color": [self.token("color:none"), *(self.token(f"rgb:{i:03x}") for i in range(4096))],
        }

    @cached_property
    def vocabulary(self) -> list[str]:
        return [t for k, tokens in self.classes.items() if k != "radius" for t in tokens]

    @cached_property
    def _members(self) -> dict[str, set[str]]:
        return {k: set(v) for k, v in self.classes.items()}

    def _walk(self, tokens: list[str]):
        """(state, class, token) of every token; ValueError where one may not come."""
        state = "start"
        for n, t in enumerate(tokens):
            k = next((k for k in AUTOMATON[state] if t in self._members[k]), None)
            if k is None:
                raise ValueError(f"token {n} ({t}) may not follow in state {state}")
            yield state, k, t
            state = AUTOMATON[state][k]
        yield state, None, None

    def allowed_next(self, tokens: list[str]) -> list[str]:
        """Every token that may come after these."""
        *_, (state, _, _) = self._walk(tokens)
        return [t for k in AUTOMATON[state] for t in self.classes[k]]

    def decode(self, tokens: list[str]) -> str:
        """Canonical markup of a whole sequence."""
        paths: list[tuple[str, str]] = []
        words: list[str] = []
        *steps, (state, _, _) = self._walk(tokens)
        if state != "done" or [k for _, k, _ in steps].count("eos") != 1:
            raise ValueError("the sequence doesn't end with one end token")
        for _, k, t in steps:
            body = t[2:-2].partition(":")[2].rpartition(":")[2]
            if k in ("xy", "radius"):
                y, x = divmod(int(body), self.grid)
                words += [str(x), str(y)]
            elif k in ("rot", "flag"):
                words.append(str(int(body)))
            elif k == "color":
                paths.append((" ".join(words), "none" if body == "none" else "#" + "".join(c * 2 for c in body)))
                words = []
            elif k in ARITY:
                words.append(k)
        inner = "".join(f'<path d="{d}" fill="{fill}"/>' for d, fill in paths)
        return f'<svg xmlns="{SVG}" viewBox="0 0 {self.grid} {self.grid}">{inner}</svg>'

    def encode(self, text: str) -> list[str]:
        """Tokens of a text within the codec's limits; ValueError otherwise."""
        if not text or not text.strip() or len(text.encode()) > MOST_BYTES:
            raise ValueError("the text is empty or too long")
        if "<!DOCTYPE" in text.upper() or "<!--" in text or "<?" in text.lstrip()[5:]:
            raise ValueError("only elements are allowed")
        try:
            root, instructions = _parsed(text)
        except ElementTree.ParseError as e:
            raise ValueError("not well-formed") from e
        if instructions or root.tag != f"{{{SVG}}}svg" or set(root.attrib) != {"viewBox"} or (root.text or "").strip() or not 0 < len(root) <= MOST_PATHS:
            raise ValueError("the root must be an svg with a viewBox and paths only")
        box = [float(x) for x in re.split(r"[\s,]+", root.get("viewBox").strip())]
        if len(box) != 4 or not all(map(math.isfinite, box)) or box[2] <= 0 or box[3] <= 0:
            raise ValueError("viewBox")
        out: list[str] = []
        for e in root:
            if _split(e.tag) != (SVG, "path") or len(e) or (e.text or "").strip() or (e.tail or "").strip() or not {"d"} <= set(e.attrib) <= {"d", "fill"}:
                raise ValueError("only paths with d and fill are allowed")
            out += [self.token("sop"), *self._path(e.get("d"), box), self.token("cmd:F"), self._color(e.get("fill", "#000000")), self.token("eop")]
        out.append(self.token("eos"))
        for _ in self._walk(out):
            pass
        return out

    def _cell(self, x: float, y: float, box: list[float]) -> str:
        at = []
        for v, low, size in ((x, box[0], box[2]), (y, box[1], box[3])):
            share = (v - low) / size
            if not -1e-12 <= share <= 1 + 1e-12:
                raise ValueError("a point lies outside the viewBox")
            at.append(math.floor(min(1.0, max(0.0, share)) * (self.grid - 1) + 0.5))
        return self.token(f"xy:{at[1] * self.grid + at[0]:0{self.width}d}")

    def _path(self, d: str, box: list[float]) -> list[str]:
        out, at, d = [], 0, d.strip()
        parts: list[tuple[str, list[float]]] = []
        while at < len(d):
            m = _LEXEME.match(d, at)
            if not m or not (m[1] or parts):
                raise ValueError(f"path data at {at}")
            if m[1]:
                parts.append((m[1], []))
            else:
                parts[-1][1].append(float(m[2]))
            at = m.end()
        for command, v in parts:
            if len(v) != ARITY[command] or not all(map(math.isfinite, v)):
                raise ValueError(f"{command} takes {ARITY[command]} numbers")
            out.append(self.token(f"cmd:{command}"))
            if command == "A":
                if v[0] <= 0 or v[1] <= 0 or {v[3], v[4]} - {0.0, 1.0}:
                    raise ValueError("arc")
                out += [self._cell(v[0], v[1], [0.0, 0.0, *box[2:]]), self.token(f"rot:{math.floor(v[2] % 360 + 0.5) % 360:03d}"), self.token(f"flag:{int(v[3])}"), self.token(f"flag:{int(v[4])}"), self._cell(v[5], v[6], box)]
            else:
                out += [self._cell(x, y, box) for x, y in zip(v[::2], v[1::2])]
        return out

    def _color(self, fill: str) -> str:
        fill = fill.strip().lower()
        if fill == "none":
            return self.token("color:none")
        if not _COLOR.fullmatch(fill):
            raise ValueError("fill")
        channels = [fill[i] * 2 for i in (1, 2, 3)] if len(fill) == 4 else [fill[i : i + 2] for i in (1, 3, 5)]
        return self.token("rgb:" + "".join(f"{math.floor(int(c, 16) * 15 / 255 + 0.5):x}" for c in channels))


_CODEC = PathCodec()


@F.pandas_udf(StructType([StructField("tokens", ArrayType(StringType())), StructField("error", StringType())]))
def encode(c: pd.Series) -> pd.DataFrame:
    """(tokens, error) of each text."""

    def one(text: str | None) -> tuple:
        if text is None:
            return None, None
        try:
            return _CODEC.encode(text), None
        except ValueError as e:
            return None, str(e)

    return pd.DataFrame([one(t) for t in c], columns=["tokens", "error"])


@F.pandas_udf(StringType())
def decode(c: pd.Series) -> pd.Series:
    """Markup of each sequence; null if it is none."""

    def one(tokens) -> str | None:
        try:
            return None if tokens is None else _CODEC.decode(list(tokens))
        except ValueError:
            return None

    return c.map(one)
