"""Text functions: hashes, counts, extraction, names."""

from __future__ import annotations

import ast
import base64
import difflib
import gzip
import hashlib
import json
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

#: A word, and a path command, as they are counted.
WORD = r"\b\w+(?:[-']\w+)*\b"
PATH_COMMAND = r"(?<![A-Za-z])[MmZzLlHhVvCcSsQqTtAa](?![A-Za-z])"
#: Fixed value: the name space of UUIDs of URLs.
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"


def word_count(c: Column) -> Column:
    """Words in any script; JVM-side."""
    return F.regexp_count(c, F.lit(f"(?U){WORD}"))


def count_of(c: Column, part: str) -> Column:
    """How often part stands in c, without overlaps."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")


def path_command_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(PATH_COMMAND))


def spaces_folded(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def caption_key(c: Column) -> Column:
    """SHA-256 of the lower-cased text with white space folded, JVM-side; caption_hash() folds case fully."""
    return F.sha2(spaces_folded(F.lower(c)), 256)


@F.pandas_udf(StringType())
def caption_hash(c: pd.Series) -> pd.Series:
    """As caption_key, with full Unicode case folding and white space."""
    return c.map(lambda t: None if t is None else hashlib.sha256(" ".join(t.casefold().split()).encode()).hexdigest())


def first_markup(c: Column, tag: str = "svg") -> Column:
    """The first element of that name in the text; null without one."""
    return F.nullif(F.regexp_extract(c, rf"(?is)(<{tag}\b.*?</{tag}>)", 1), F.lit(""))


def tag_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"<[a-zA-Z]"))


def wrapped(inner: Column, width: int, height: int) -> Column:
    return F.format_string(f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" viewBox="0 0 {width} {height}">%s</svg>', inner)


def stable_key(*parts: Column) -> Column:
    """SHA-256 of the parts joined by U+001F; a null part is empty, so it still holds its place."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def hash_bucket(key: Column, of: int = 100) -> Column:
    """The first 64 bits of a hex key modulo `of`."""
    return (F.conv(F.substring(key, 1, 16), 16, 10).cast("decimal(20,0)") % of).cast("int")


def file_stem(c: Column) -> Column:
    """The last part of a path without its extension; a leading dot isn't one."""
    name = F.regexp_extract(c, r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def only_instruction(c: Column) -> Column:
    """The single item of an array that isn't blank; an error if there isn't exactly one."""
    found = F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise(F.raise_error(F.lit("exactly one instruction is needed")))


def is_commit(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{40}$"), F.lit(False))


def safe_name(c: Column, size: int = 80) -> Column:
    """A name for files: other characters than letters, digits, `.`, `_` and `-` become one dash."""
    return F.substring(F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w.-]+", "-"), r"^-+|-+$", ""), 1, size)


def json_object(c: Column) -> Column:
    """The text as a JSON object (variant), out of its code fence if it has one; null if it isn't one."""
    bare = F.regexp_replace(F.trim(c), r"(?s)^```[a-zA-Z]*\s*|\s*```$", "")
    return F.when(bare.startswith("{") & bare.endswith("}"), F.try_parse_json(bare))


def json_slice(c: Column) -> Column:
    """From the first `{` to the last `}`, as JSON; null without."""
    return F.try_parse_json(F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit("")))


def uuid_of(name: Column) -> Column:
    """Version-5 UUID in the name space of URLs, JVM-side."""
    h = F.substring(F.sha1(F.concat(F.unhex(F.lit(URL_SPACE)), name.cast("binary"))), 1, 32)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def fallback_identity(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def bounded_prefix(c: Column, size: int) -> Column:
    """(text, truncated)"""
    return F.struct(F.substring(c, 1, size).alias("text"), (F.length(c) > size).alias("truncated"))


def required_changes(categories: Column, changes: Column) -> Column:
    return F.to_json(F.transform(F.arrays_zip(categories.alias("category"), changes.alias("change")), lambda x: x))


@F.pandas_udf(StringType())
def unified_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else "".join(difflib.unified_diff(x.splitlines(True), y.splitlines(True), "a", "b")) for x, y in zip(a, b)])


@F.pandas_udf(StringType())
def listed_detail(c: pd.Series) -> pd.Series:
    """A detail that was stored as the text of a list: its items joined by a space; others as they are."""

    def one(t: str | None) -> str | None:
        if t is None or not (t.strip().startswith("[") and t.strip().endswith("]")):
            return t
        try:
            items = ast.literal_eval(t.strip())
        except (ValueError, SyntaxError):
            return t
        return " ".join(x.strip() for x in items if x.strip()) if isinstance(items, list) and all(isinstance(x, str) for x in items) else t

    return c.map(one)


_PAYLOAD = StructType([StructField("codec", StringType()), StructField("data", StringType())])


@F.pandas_udf(_PAYLOAD)
def compressed(c: pd.Series) -> pd.DataFrame:
    """(codec, data): gzip in base64 where that is shorter, else the text itself."""

    def one(t: str | None) -> tuple:
        if t is None:
            return None, None
        z = base64.b64encode(gzip.compress(t.encode(), mtime=0)).decode()
        return ("gzip+base64", z) if len(z) < len(t.encode()) else ("utf8", t)

    return pd.DataFrame([one(t) for t in c], columns=["codec", "data"])


@F.pandas_udf(StringType())
def decompressed(codec: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else gzip.decompress(base64.b64decode(d)).decode() if k == "gzip+base64" else d for k, d in zip(codec, data)])


@F.pandas_udf(BinaryType())
def packed_ids(ids: pd.Series) -> pd.Series:
    """Little-endian unsigned 32-bit ids, compressed."""
    return ids.map(lambda x: None if x is None else zlib.compress(np.asarray(x, "<u4").tobytes()))


@F.pandas_udf(ArrayType(IntegerType()))
def unpacked_ids(blob: pd.Series) -> pd.Series:
    return blob.map(lambda x: None if x is None else np.frombuffer(zlib.decompress(x), "<u4").astype("int32"))


@F.pandas_udf(StringType())
def canonical_json_hash(c: pd.Series) -> pd.Series:
    """SHA-256 of JSON with sorted keys and no spaces: byte for byte that of Python's serializer."""
    return c.map(lambda t: None if t is None else hashlib.sha256(json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest())


@F.pandas_udf(IntegerType())
def word_count_unicode(c: pd.Series) -> pd.Series:
    """Word count by Unicode's own word characters, combining marks as Python sees them."""
    word = re.compile(WORD)
    return c.map(lambda t: None if t is None else len(word.findall(t))).astype("Int32")
