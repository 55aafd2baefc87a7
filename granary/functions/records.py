"""Identities, search texts and documents of records; coercion of what models and tools report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DateType, DayTimeIntervalType, TimestampType

from granary.functions.fields import agreeing, blank_to_null, first_text, first_text_with_field, required, tags
from granary.functions.markup import safe_names
from granary.functions.text import uuid_of

#: The orders in which audits and token caches ask a record, and then its metadata, for its id.
AUDIT_KEYS = ("id", "sample_id", "source_id", "record_id", "example_id", "svg_id")
CACHE_KEYS = ("id", "sample_id", "source_id", "source_index", "record_id", "upstream_id")


def record_id(record: Column, keys: tuple[str, ...] = AUDIT_KEYS) -> Column:
    """The first key of a record (variant), then of its metadata, that isn't null, as text; a blank one counts."""
    return F.coalesce(*[F.try_variant_get(record, f"$.{place}{k}", "string") for place in ("", "metadata.") for k in keys])


def prepared_id(record: Column) -> Column:
    """metadata.record_id or id; an error if both are there and differ, or neither is."""
    at = lambda path: blank_to_null(F.try_variant_get(record, path, "string"))
    return required(agreeing(at("$.metadata.record_id"), at("$.id"), "metadata.record_id and id differ"), "a record has no id")


def json_safe(df: DataFrame, names: list[str]) -> Column:
    """The columns as one JSON object: nulls are left out, and what JSON has no kind for is text."""
    text = (BinaryType, DateType, TimestampType, DayTimeIntervalType)
    return F.to_json(F.struct(*[(F.col(n).cast("string") if isinstance(df.schema[n].dataType, text) else F.col(n)).alias(n) for n in names]))


def pattern_text(name: Column, description: Column, labels: Column, elements: Column) -> Column:
    """Search text of a named pattern: lines of those parts that aren't empty; underscores of the name are spaces, lists are joined by commas."""
    line = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c))
    return F.concat_ws("\n", line("Name", F.replace(name, F.lit("_"), F.lit(" "))), line("Description", description), line("Tags", F.array_join(labels, ", ")), line("SVG elements", F.array_join(elements, ", ")))


def prepared_documents(df: DataFrame, source: str, split: str, revision: str, content: list[str], captions: list[str], ids: list[str], labels: str, most_content: int, most_caption: int) -> DataFrame:
    """(content, record_id, source, dataset_revision, description, caption_field, tags, svg_elements, search_text) of rows that can be retrieved.

    Content must be there, of bounded size, and safe. The description is the first caption, cut; else
    the tags; a row with neither goes. A row without an id gets a UUID of its content.
    """
    rows = df.select(first_text(df, content).alias("content"), first_text_with_field(df, captions).alias("__c"), tags(F.col(labels)).alias("tags"), first_text(df, ids).alias("__id"))
    rows = rows.where(F.length("content") <= most_content).withColumn("svg_elements", safe_names("content")).where("svg_elements is not null")
    cut = lambda c: F.nullif(F.trim(F.substring(c, 1, most_caption)), F.lit(""))
    rows = rows.withColumn("description", F.coalesce(cut(F.col("__c.value")), cut(F.array_join("tags", " ")))).where("description is not null")
    rows = rows.withColumn("record_id", F.coalesce("__id", uuid_of(F.col("content")))).withColumn("caption_field", F.col("__c.field"))
    text = pattern_text(F.lit(""), F.col("description"), F.col("tags"), F.col("svg_elements"))
    return rows.select("content", "record_id", F.concat(F.lit(f"hf://{source}/{split}/"), "record_id").alias("source"), F.lit(revision).alias("dataset_revision"), "description", "caption_field", "tags", "svg_elements", text.alias("search_text"))


def source_identity(df: DataFrame, sources: DataFrame, kind: str, record: str) -> DataFrame:
    """df with `source` and `revision` from a small table of sources (dataset_type, dataset_id, dataset_revision); an unknown kind names itself."""
    known = sources.select(F.lower(F.trim("dataset_type")).alias("__t"), F.col("dataset_id").alias("__d"), blank_to_null(F.col("dataset_revision")).alias("revision"))
    own = F.lower(F.trim(kind))
    out = df.join(known, own == F.col("__t"), "left")
    suffix = F.coalesce(F.concat(F.lit("@"), F.col("revision")), F.lit(""))
    return out.withColumn("source", F.concat(F.lit("hf://"), F.coalesce("__d", own), suffix, F.lit("/train/"), F.col(record).cast("string"))).drop("__t", "__d")


def chat_ids(c: Column) -> Column:
    """Token ids of a chat counter's answer in JSON: a list, a list of one list, or an object with input_ids; null for all else, negative and empty ones too."""
    whole = F.try_parse_json(c)
    own = F.coalesce(F.try_variant_get(whole, "$.input_ids", "variant"), whole)
    kind = F.schema_of_variant(own)
    nested = F.try_variant_get(own, "$", "array<array<bigint>>")
    ids = F.when(kind == "ARRAY<BIGINT>", F.try_variant_get(own, "$", "array<bigint>")).when((kind == "ARRAY<ARRAY<BIGINT>>") & (F.size(nested) == 1), F.get(nested, F.lit(0)))
    return F.when((F.size(ids) > 0) & F.forall(ids, lambda i: i >= 0), ids)


def seconds(record: Column, path: str) -> Column:
    """A duration of a record (variant): a number, none below 0; 0 for all else, booleans too."""
    value = F.try_variant_get(record, path, "double")
    number = ~F.schema_of_variant(F.try_variant_get(record, path, "variant")).isin("BOOLEAN", "STRING", "VOID")
    return F.greatest(F.lit(0.0), F.coalesce(F.when(number, value), F.lit(0.0)))


def similarity_faults(attempt: Column, score: Column, logit: Column, latency: Column, sha256: Column) -> Column:
    """What is wrong with a record of image-text similarity: codes in order; none if it is sound."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    tests = {
        "attempt": blank_to_null(attempt).isNull(), "score": ~(finite(score) & score.between(0, 1)), "logit": ~finite(logit),
        "latency": ~(finite(latency) & (latency >= 0)), "image": ~F.coalesce(sha256.rlike("^[0-9a-f]{64}$"), F.lit(False)),
    }
    return F.filter(F.array(*[F.when(F.coalesce(fails, F.lit(True)), F.lit(name)) for name, fails in tests.items()]), lambda x: x.isNotNull())


def integer_width(least: Column, most: Column) -> Column:
    """The narrowest of 8, 32 and 64 bits that holds the values between: b, i or q."""
    return F.when((least >= -128) & (most <= 127), "b").when((least >= -(2**31)) & (most < 2**31), "i").otherwise("q")


def feedback_record(df: DataFrame) -> Column:
    """A critic's feedback as JSON by the version of its schema: plain issues in 1; structured ones, status and what to keep in 2; evaluations in 3.

    df: (version, score, status, issues array<string>, structured array<struct>, preserve array<string>, evaluations array<struct>), and any of feedback_id, target_attempt_id.
    """
    own = [F.col(c) for c in ("feedback_id", "target_attempt_id") if c in df.columns]
    later = [F.col("structured").alias("issues"), F.col("issues").alias("legacy_issues"), F.col("version").alias("critic_schema_version"), "status"]
    v1 = F.to_json(F.struct(*own, "score", "issues"))
    v2 = F.to_json(F.struct(*own, "score", *later, "preserve"))
    v3 = F.to_json(F.struct(*own, "score", *later, "evaluations"))
    return F.when(F.col("version") >= 3, v3).when(F.col("version") >= 2, v2).otherwise(v1)
