"""Choosing values from candidate fields, and building records from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StructType


def blank_to_null(c: Column) -> Column:
    """A blank string is a missing one; others lose outer white space."""
    trimmed = F.regexp_replace(c.cast("string"), r"^(?U:\s)+|(?U:\s)+$", "")
    return F.nullif(trimmed, F.lit(""))


def as_text(c: Column, kind: DataType) -> Column:
    """Text of a scalar, of bytes as UTF-8, or of an array's non-blank items joined by a space; null if blank."""
    if isinstance(kind, ArrayType):
        return F.nullif(F.array_join(F.filter(F.transform(c, blank_to_null), lambda x: x.isNotNull()), " "), F.lit(""))
    if isinstance(kind, BinaryType):
        return blank_to_null(F.try_validate_utf8(c.cast("string")))
    if isinstance(kind, StructType | MapType):
        return blank_to_null(F.to_json(c))
    return blank_to_null(c)


def _typed(df: DataFrame, name: str) -> Column | None:
    return as_text(F.col(f"`{name}`"), df.schema[name].dataType) if name in df.columns else None


def first_text(df: DataFrame, names: list[str]) -> Column:
    """The first candidate that isn't blank; columns that df doesn't have are passed over."""
    found = [c for n in names if (c := _typed(df, n)) is not None]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def first_text_with_field(df: DataFrame, names: list[str]) -> Column:
    """A struct of that text and of the name of the column that it came from."""
    found = [(n, c) for n in names if (c := _typed(df, n)) is not None]
    value = F.coalesce(*[c for _, c in found]) if found else F.lit(None).cast("string")
    field = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in found]) if found else F.lit(None).cast("string")
    return F.struct(value.alias("value"), field.alias("field"))


def first_value(row: list[Column], nested: list[Column]) -> Column:
    """The first value that isn't blank: those of the row before those of its metadata."""
    return F.coalesce(*[blank_to_null(c) for c in [*row, *nested]])


def qualified_id(sample_id: Column, dataset: Column, record: Column) -> Column:
    """The sample's id, else `dataset::record`; null if neither is there."""
    both = F.when(blank_to_null(dataset).isNotNull() & blank_to_null(record).isNotNull(), F.concat_ws("::", blank_to_null(dataset), blank_to_null(record)))
    return F.coalesce(blank_to_null(sample_id), both)


def required(c: Column, message: str) -> Column:
    """c, or an error that ends the job if it is null."""
    return F.coalesce(c, F.raise_error(F.lit(message)))


def json_path(variant: Column, path: str, kind: str = "string") -> Column:
    """A value of a dotted path in a parsed JSON column; null if it isn't there or doesn't fit.

    A boolean is never a number here, nor a number a boolean.
    """
    at = "$." + path
    value = F.try_variant_get(variant, at, kind)
    is_bool = F.schema_of_variant(F.try_variant_get(variant, at, "variant")) == "BOOLEAN"
    if kind == "boolean":
        return F.when(is_bool, value)
    if kind in {"int", "bigint", "double", "float"}:
        return F.when(~is_bool, value)
    return value


def identity(variant: Column, aliases: list[str], places: tuple[str, ...] = ("", "metadata.", "source_metadata.", "provenance.", "provenance.source.")) -> Column:
    """The first of the aliases that isn't blank, in the row and then in each nested place."""
    return F.coalesce(*[blank_to_null(json_path(variant, p + a)) for p in places for a in aliases])


def agreeing(a: Column, b: Column, message: str) -> Column:
    """Either value; an error if both are there and differ."""
    return F.when(a.isNotNull() & b.isNotNull() & (a != b), F.raise_error(F.lit(message))).otherwise(F.coalesce(a, b))


def choose_instruction(description: Column, detail: Column, mode: str, policy: Column | None = None) -> Column:
    """The instruction under mode description, detail or mixed (by the record's policy); description if the detail is missing."""
    if mode == "description":
        return description
    chosen = detail if mode == "detail" else F.when(policy == "detail", detail)
    return F.coalesce(blank_to_null(chosen), description)


def choose_target(raw: Column, coded: Column, use_codec: bool) -> Column:
    return F.when(coded.isNotNull(), coded).otherwise(F.raise_error(F.lit("the codec gave no target"))) if use_codec else raw


def keep_metadata(m: Column, allowed: list[str]) -> tuple[Column, Column]:
    """A map's allowed entries, and the sorted names of the others."""
    names = F.array(*[F.lit(a) for a in allowed]).cast("array<string>")
    return F.map_filter(m, lambda k, v: F.array_contains(names, k)), F.array_sort(F.array_except(F.map_keys(m), names))


def flat_metadata(df: DataFrame, names: list[str]) -> DataFrame:
    """Nested columns as JSON strings, scalars as they are."""
    return df.select(*[F.to_json(n).alias(n) if isinstance(df.schema[n].dataType, ArrayType | MapType | StructType) else F.col(n) for n in names])


def restored(c: Column) -> Column:
    """A JSON string as a variant; null if it isn't JSON."""
    return F.try_parse_json(c)


def search_text(parts: dict[str, Column]) -> Column:
    """Lines `Name: value` of the parts that aren't blank."""
    lines = [F.concat(F.lit(f"{name}: "), blank_to_null(c)) for name, c in parts.items()]
    return F.concat_ws("\n", *lines)


def tags(c: Column) -> Column:
    """Tags divided by `|` if there is one, else by commas; without blanks, in order."""
    parts = F.when(c.contains("|"), F.split(c, r"\|")).otherwise(F.split(c, ","))
    return F.coalesce(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def stable_id(kind: Column, record: Column) -> Column:
    return F.concat_ws(":", F.lower(F.trim(kind)), F.trim(record))


def source_uri(source: Column, revision: Column, file: Column, row: Column) -> Column:
    return F.format_string("%s@%s/%s#%d", source, F.coalesce(revision, F.lit("main")), file, row)


def chat(system: str, user: Column, assistant: Column | None = None) -> Column:
    """Messages as an array of (role, content)."""
    turns = [("system", F.lit(system)), ("user", user)] + ([("assistant", assistant)] if assistant is not None else [])
    return F.array(*[F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in turns])


def numbered_context(items: Column) -> Column:
    """`Example n:` blocks of an array of texts, divided by blank lines."""
    return F.array_join(F.transform(items, lambda x, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(":\n"), x)), "\n\n")


def brief_prompt(instruction: Column, context: Column | None = None) -> Column:
    """The instruction with the retrieved context, if there is any, before it."""
    own = F.concat(F.lit("Request: "), instruction)
    if context is None:
        return own
    return F.when(F.coalesce(context, F.lit("")) == "", own).otherwise(F.concat(F.lit("References:\n"), context, F.lit("\n\n"), own))


def revision_prompt(instruction: Column, previous: Column, issues: Column) -> Column:
    listed = F.array_join(F.transform(issues, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.concat(F.lit("Request: "), instruction, F.lit("\nPrevious:\n"), previous, F.lit("\nChange:\n"), listed)


#: Parts of key names whose values are secrets.
SECRET_PARTS = ("api_key", "apikey", "authorization", "credential", "password", "secret", "token")


def redacted(config: object) -> object:
    """A nested configuration with the values of secret keys replaced; counts such as max_tokens stay."""
    def secret(key: str) -> bool:
        k = key.lower().replace("-", "_")
        return any(p in k for p in SECRET_PARTS) and not k.endswith("tokens") and not k.startswith("tokenizer")

    if isinstance(config, dict):
        return {k: "[redacted]" if secret(str(k)) and v is not None else redacted(v) for k, v in config.items()}
    return [redacted(x) for x in config] if isinstance(config, list | tuple) else config


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags, F.lit(False))
