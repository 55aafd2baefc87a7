"""Corpus preparation end to end: filter cascade, exclusion, deduplication, sample, split, publication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.fields import choose_instruction
from granary.functions.markup import canonicalize, validate
from granary.functions.text import caption_hash, count_of, hash_bucket, path_command_count, stable_key, word_count
from granary.operators.cascade import REASONS, excluded, first_accepted, flagged, reason_counts
from granary.operators.joins import allowlist_audit, two_level
from granary.operators.ordered import sampled, split
from granary.sources.manifests import PrepareConfig
from granary.sources.sinks import publish


def judged(rows: DataFrame, config: PrepareConfig, allow: DataFrame, exclusions: DataFrame, renders: Callable[[Column], Column] | None = None, tokens: Callable[[Column], Column] | None = None, chat_tokens: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """rows (domain, record_id, description, detail, svg, source_file, source_row) with `rejection` and what was computed on the way.

    Plain tests come first; only rows that pass them reach the parser, and only canonical ones the
    counters, which are parameters: renders says if a text renders, tokens and chat_tokens count, null on failure.
    """
    rows = flagged(rows, allow, {"domain": "domain", "record_id": "record_id"}, "is_allowed")
    rows = rows.withColumn("caption_sha256", caption_hash("description")).withColumn("detail_sha256", caption_hash("detail"))
    rows = excluded(rows, exclusions, "record_id", "caption_sha256", "detail_sha256")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rows = rows.withColumn("description_words", word_count(F.col("description"))).withColumn("detail_words", word_count(F.col("detail")))
    plain = {
        REASONS[0]: ~F.col("is_allowed"),
        REASONS[1]: blank("record_id") | blank("description") | blank("svg"),
        REASONS[2]: F.lit(config.require_detail) & blank("detail"),
        REASONS[3]: ~F.col("description_words").between(config.min_words, config.max_words),
        REASONS[4]: F.col("is_excluded"),
        REASONS[5]: ~F.length("svg").between(config.min_chars, config.max_chars),
    }
    early = None
    for name, fails in plain.items():
        early = F.when(fails, name) if early is None else early.when(fails, name)
    rows = rows.withColumn("__early", early)
    # A Python function inside CASE would see all rows; it gets nulls for those that are out already.
    rows = rows.withColumn("__svg", F.when(F.col("__early").isNull(), F.col("svg"))).withColumn("__valid", validate("__svg").is_valid)
    rows = rows.withColumn("__c", canonicalize(F.when(F.col("__valid"), F.col("__svg")))).withColumn("canonical", F.col("__c.canonical")).withColumn("element_count", F.col("__c.nodes"))
    rows = rows.withColumn("canonical_sha256", F.sha2("canonical", 256))
    rows = rows.withColumn("token_count", tokens(F.col("canonical")) if tokens else F.lit(None).cast("int")).withColumn("chat_token_count", chat_tokens(F.col("description"), F.col("canonical")) if chat_tokens else F.lit(None).cast("int"))
    first = {name: F.col("__early") == name for name in plain} | {REASONS[6]: ~F.col("__valid"), REASONS[7]: F.col("canonical").isNull()}
    late = {} if renders is None else {REASONS[9]: ~renders(F.col("canonical"))}
    if tokens or chat_tokens:
        late[REASONS[10]] = (F.col("token_count").isNull() if tokens else F.lit(False)) | (F.col("chat_token_count").isNull() if chat_tokens else F.lit(False))
    if config.max_tokens is not None:
        late[REASONS[11]] = F.col("token_count") > config.max_tokens
    if config.max_chat_tokens is not None:
        late[REASONS[12]] = F.col("chat_token_count") > config.max_chat_tokens
    seeds = exclusions.where("kind = 'svg'").select("value")
    out = first_accepted(rows, "canonical_sha256", ["domain", "source_file", "source_row"], first, late, seeds)
    return out.drop("__early", "__svg", "__valid", "__c")


def records(accepted: DataFrame, dataset: str, revision: str | None, neighbours: DataFrame | None = None) -> DataFrame:
    """Accepted rows as training records with their metadata."""
    key = stable_key(F.lit(dataset), F.lit(revision).cast("string"), F.col("domain"), F.col("record_id"), F.col("canonical_sha256"))
    rows = accepted.withColumn("stable_record_key", key).withColumn("policy", F.when(hash_bucket(F.col("stable_record_key")) < 60, "detail").otherwise("description"))
    if neighbours is not None:
        rows = two_level(rows.withColumn("__q", F.concat_ws(":", "domain", "record_id")), neighbours, "__q", "record_id", "key", "retrieved").drop("__q")
    else:
        rows = rows.withColumn("retrieved", F.lit(None).cast("array<string>"))
    meta = F.struct(
        F.lit(dataset).alias("dataset_id"), F.lit(revision).cast("string").alias("dataset_revision"), F.col("domain").alias("dataset_type"), "record_id",
        F.struct(F.col("source_file").alias("file"), F.col("source_row").alias("row")).alias("source_pointer"), "description_words", "detail_words",
        F.length("canonical").alias("svg_char_length"), F.col("token_count").alias("svg_token_length"), F.col("chat_token_count").alias("full_chat_token_length"),
        F.col("element_count").alias("svg_element_count"), count_of(F.col("canonical"), "<path").alias("svg_path_count"), path_command_count(F.col("canonical")).alias("svg_path_command_count"),
        F.col("canonical_sha256").alias("canonical_svg_sha256"), "caption_sha256", "detail_sha256", F.col("stable_record_key").alias("stable_record_key_sha256"),
        F.struct(F.lit("description").alias("r0_description_only"), F.col("policy").alias("r1_detail_60_description_40"), F.lit("detail").alias("r2_detail_only")).alias("instruction_policy"),
        F.coalesce("retrieved", F.array().cast("array<string>")).alias("retrieved_item_ids"),
    )
    return rows.select("domain", F.lit("text_to_svg").alias("task"), choose_instruction(F.col("description"), F.col("detail"), "description").alias("instruction"), F.lit("description").alias("instruction_source"), "description", "detail", F.col("canonical").alias("output_svg"), meta.alias("metadata"))


def prepare(rows: DataFrame, config: PrepareConfig, allow: DataFrame, exclusions: DataFrame, dataset: str, path: str, revision: str | None = None, neighbours: DataFrame | None = None, **hooks) -> dict:
    """Judge, check that all allowed ids were found and that each domain has enough, sample, split and publish; returns the manifest."""
    known = judged(rows, config, allow, exclusions, **hooks).persist()
    try:
        audit = {r["domain"]: r.asDict() for r in allowlist_audit(rows, allow, "domain", "record_id").collect()}
        if bad := {d: r for d, r in audit.items() if r["missing"] or r["repeated"]}:
            raise ValueError(f"allowlist: {bad}")
        counts = [r.asDict() for r in reason_counts(known, "domain", REASONS).collect()]
        if short := [r for r in counts if r["reason"] == "accepted" and r["n"] < config.per_domain]:
            raise ValueError(f"too few accepted rows: {short}")
        chosen = sampled(records(known.where("rejection is null"), dataset, revision, neighbours).withColumn("__id", F.col("metadata.record_id")), "domain", "__id", config.per_domain, config.seed)
        sizes = {"train": config.train, "validation": config.validation, "test": config.test}
        parts = split(chosen, "sample_rank", sizes).withColumn("metadata", F.col("metadata").withField("split", F.col("split"))).drop("__id", "sample_rank", "domain")
        return publish({name: parts.where(F.col("split") == name).drop("split") for name in sizes}, path, {"dataset": dataset, "revision": revision, "seed": config.seed, "reasons": counts})
    finally:
        known.unpersist()
