"""Token counts by section: documents are encoded once, and tokens attributed by their character spans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm._common import bounded_batches
from granary.llm.tokens import byte_bpe, vocabulary_path

Span = tuple[str, int, int]


def lead_body_tail(text: str) -> list[Span]:
    """The first line, the lines between, the last line if there are two or more; in code points, without the dividing newlines."""
    first = text.find("\n")
    if first < 0:
        return [("lead", 0, len(text))]
    last = text.rfind("\n")
    return [("lead", 0, first), *([("body", first + 1, last)] if last > first else []), ("tail", last + 1, len(text))]


def token_spans(text: str, ids: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of every token; a token that holds part of a character spans all of it."""
    data = np.frombuffer(text.encode(), np.uint8)
    ends = np.cumsum(widths[ids])
    if not len(data):
        return ends, ends
    if len(data) == len(text):
        return ends - widths[ids], ends
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    return char[ends - widths[ids]], char[ends - 1] + 1


def attribute(starts: np.ndarray, ends: np.ndarray, spans: list[Span]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the span that each token goes to (-1: it touches none), and whether the token reaches over its bounds.

    Rule: a token goes to the span that holds most of its characters; of spans that hold as many, to
    the earlier. spans: in order, not overlapping. A token can touch many short spans, so every span
    from that of its first character on competes until the token's end.
    """
    best, held = np.full(len(starts), -1), np.zeros(len(starts), np.int64)
    if not spans or not len(starts):
        return best, np.zeros(len(starts), bool)
    lo, hi = np.array([s[1] for s in spans]), np.array([s[2] for s in spans])
    at = np.searchsorted(hi, starts, side="right")
    todo = np.arange(len(starts))
    while len(todo := todo[at[todo] < len(spans)]) and len(todo := todo[lo[at[todo]] < ends[todo]]):
        k = at[todo]
        share = np.minimum(hi[k], ends[todo]) - np.maximum(lo[k], starts[todo])
        more = share > held[todo]
        best[todo[more]], held[todo[more]] = k[more], share[more]
        at[todo] += 1
    return best, (held > 0) & (held < ends - starts)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections: Callable[[str], list[Span]] = lead_body_tail, path: str | None = None) -> DataFrame:
    """(id, section, n_tokens, n_chars, n_crossing, doc_tokens): one row per document and section name, and `outside` for the rest.

    n_crossing counts a section's tokens that reach over its bounds. A document's n_tokens sum up to
    its doc_tokens. A null or empty text has one row, section `outside`, with zeros; a null id stays
    null; repeated rows are counted each; an empty table gives no rows; other columns aren't read.
    Spans of one name add up.
    """
    path = path or vocabulary_path()
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                ids, spans = bpe.encode(text), sections(text) if text else []
                to, crossing = attribute(*token_spans(text, ids, bpe.widths), spans)
                n = np.bincount(to + 1, minlength=len(spans) + 1).tolist()
                over = np.bincount(to[crossing] + 1, minlength=len(spans) + 1).tolist()
                rows: dict[str, list[int]] = {}
                for k, (name, lo, hi) in enumerate(spans, 1):
                    row = rows.setdefault(name, [0, 0, 0])
                    row[0], row[1], row[2] = row[0] + n[k], row[1] + hi - lo, row[2] + over[k]
                rows["outside"] = [n[0], len(text) - sum(s[2] - s[1] for s in spans), over[0]]
                out += [(key, name, *row, len(ids)) for name, row in rows.items()]
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 1 else pa.int64()) for i, c in enumerate(cols)], ["id", "section", "n_tokens", "n_chars", "n_crossing", "doc_tokens"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, "id long, section string, n_tokens long, n_chars long, n_crossing long, doc_tokens long")
