"""Integrity of nested run records: every rule gives rows (run_id, rule, detail); none means that all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Shape of a run record, as far as rules look at it.
RUN = """run_id string, schema_version int, selected_attempt_id string, accepted boolean, acceptance_score double,
attempts array<struct<attempt_id: string, parent_id: string, position: int, status: string, mode: string, svg_sha256: string, target_ids: array<string>,
  model_calls: array<struct<call_id: string, latency_seconds: double, prompt_tokens: int, completion_tokens: int>>>>,
critic_feedback array<struct<attempt_id: string, score: double, status: string, flags: array<boolean>,
  evaluations: array<struct<category: string, type: string, applicable: boolean, score: double>>,
  issues: array<struct<category: string, type: string, target_ids: array<string>>>>>"""

STATUSES, MODES = ("pass", "revise", "reject"), ("initial", "revision")


def _rule(df: DataFrame, name: str, fails: Column, detail: Column) -> DataFrame:
    return df.where(F.coalesce(fails, F.lit(True))).select("run_id", F.lit(name).alias("rule"), detail.cast("string").alias("detail"))


def violations(runs: DataFrame, score_threshold: float = 7.0) -> DataFrame:
    """(run_id, rule, detail) of every broken rule: types and ranges, lineage, references, coverage of issues, acceptance."""
    attempts = runs.select("run_id", "schema_version", F.posexplode("attempts").alias("at", "a")).select("run_id", "at", "a.*")
    feedback = runs.select("run_id", "schema_version", F.posexplode("critic_feedback").alias("at", "f")).select("run_id", "schema_version", "at", "f.*")
    calls = attempts.select("run_id", "attempt_id", F.explode("model_calls").alias("c"))
    evaluations = feedback.select("run_id", "at", F.explode("evaluations").alias("e"))
    issues = feedback.select("run_id", "at", "attempt_id", "evaluations", F.explode("issues").alias("i"))
    before = F.lag("attempt_id").over(W.partitionBy("run_id").orderBy("at"))
    line = attempts.withColumn("before", before)
    known = runs.select("run_id", F.transform("attempts", lambda a: a.attempt_id).alias("ids"))
    targets = attempts.select("run_id", "attempt_id", "target_ids")
    low = F.exists("evaluations", lambda e: (e.category == F.col("i.category")) & (e.type == F.col("i.type")) & (e.score < score_threshold))
    rules = [
        _rule(runs, "schema_version", ~F.col("schema_version").between(0, 3), F.col("schema_version")),
        _rule(runs, "no_attempts", F.coalesce(F.size("attempts"), F.lit(0)) <= 0, F.lit("attempts")),
        _rule(runs.join(known, "run_id").where("selected_attempt_id is not null"), "selected_attempt", ~F.array_contains("ids", F.col("selected_attempt_id")), F.col("selected_attempt_id")),
        _rule(attempts, "attempt_status", ~F.col("status").isin(*STATUSES), F.col("status")),
        _rule(attempts, "attempt_mode", (F.col("mode") == "initial") != (F.col("at") == 0), F.col("mode")),
        _rule(attempts, "attempt_position", F.col("position") != F.col("at"), F.col("position")),
        _rule(line, "attempt_parent", ~F.col("parent_id").eqNullSafe(F.col("before")), F.col("attempt_id")),
        _rule(attempts, "attempt_digest", ~F.col("svg_sha256").rlike("^[0-9a-f]{64}$"), F.col("attempt_id")),
        _rule(attempts.groupBy("run_id", "attempt_id").count().where("count > 1"), "attempt_repeated", F.lit(True), F.col("attempt_id")),
        _rule(calls, "call_values", (F.col("c.latency_seconds") < 0) | (F.col("c.prompt_tokens") < 0) | (F.col("c.completion_tokens") < 0), F.col("c.call_id")),
        _rule(feedback.join(known, "run_id"), "feedback_attempt", ~F.array_contains("ids", F.col("attempt_id")), F.col("attempt_id")),
        _rule(feedback, "feedback_score", ~F.col("score").between(0, 10), F.col("score")),
        _rule(feedback, "feedback_status", ~F.col("status").isin(*STATUSES), F.col("status")),
        _rule(evaluations, "evaluation_score", F.col("e.applicable") & ~F.col("e.score").between(0, 10), F.concat_ws("/", "e.category", "e.type")),
        _rule(evaluations.groupBy("run_id", "at", "e.category", "e.type").count().where("count > 1"), "evaluation_repeated", F.lit(True), F.concat_ws("/", "category", "type")),
        _rule(issues, "issue_without_low_score", ~low, F.concat_ws("/", "i.category", "i.type")),
        _rule(issues.join(targets, ["run_id", "attempt_id"], "left"), "issue_target", F.size(F.array_except("i.target_ids", F.coalesce("target_ids", F.array().cast("array<string>")))) > 0, F.concat_ws(",", "i.target_ids")),
        _rule(runs.where("accepted").select("*", F.filter("critic_feedback", lambda f: f.attempt_id == F.col("selected_attempt_id")).alias("own")), "accepted_without_pass", ~F.exists("own", lambda f: (f.status == "pass") & (f.score >= F.coalesce(F.col("acceptance_score"), F.lit(score_threshold)))), F.col("selected_attempt_id")),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def scorecard(evaluations: Column, threshold: float) -> Column:
    """(least, below, mean) of applicable evaluations."""
    scores = F.transform(F.filter(evaluations, lambda e: e.applicable), lambda e: e.score)
    return F.struct(F.array_min(scores).alias("least"), F.size(F.filter(scores, lambda s: s < threshold)).alias("below"), F.try_divide(F.aggregate(scores, F.lit(0.0), lambda a, s: a + s), F.size(scores)).alias("mean"))


def accepted(evaluations: Column, status: Column, flags: Column, score: Column, version: Column, threshold: float, acceptance: float) -> Column:
    """Version 3: every applicable evaluation reaches the threshold and status is pass; 2: pass and all flags; 1: all flags and the score."""
    flags_ok = F.forall(F.coalesce(flags, F.array().cast("array<boolean>")), lambda f: f)
    v3 = (status == "pass") & F.forall(F.filter(evaluations, lambda e: e.applicable), lambda e: e.score >= threshold)
    return F.coalesce(F.when(version >= 3, v3).when(version == 2, (status == "pass") & flags_ok).otherwise(flags_ok & (score >= acceptance)), F.lit(False))


def combined(feedback: DataFrame, by: list[str]) -> DataFrame:
    """Several critics' feedback as one: mean score, all flags, the worst status, issues in first-seen order.

    feedback: (by, critic_order, score, status, flag, issues).
    """
    worst = F.max(F.when(F.col("status") == "reject", 2).when(F.col("status") == "revise", 1).otherwise(0))
    lists = F.transform(F.array_sort(F.collect_list(F.struct("critic_order", "issues"))), lambda x: x.issues)
    return feedback.groupBy(*by).agg(F.round(F.avg("score"), 6).alias("score"), F.bool_and("flag").alias("flag"), F.element_at(F.array(*map(F.lit, STATUSES)), worst + 1).alias("status"), F.array_distinct(F.flatten(lists)).alias("issues"))


def rule_score(errors: Column, warnings: Column) -> Column:
    return F.greatest(F.lit(0), 10 - 3 * errors - warnings)


def raise_if_any(found: DataFrame) -> None:
    """Gate before publication."""
    if rows := found.limit(10).collect():
        raise ValueError(f"integrity: {[r.asDict() for r in rows]}")


def isolation_faults(examples: DataFrame) -> DataFrame:
    """Benchmark examples that could leak into memory: only held-out, memory-ineligible ones are clean."""
    return examples.where(F.coalesce("memory_eligible", F.lit(True)) | ~F.col("split").eqNullSafe("test"))


def issue_faults(issues: DataFrame, evaluations: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Issues whose (category, type) has no evaluation under the threshold."""
    return issues.join(evaluations.where(F.col("score") < threshold), [*keys, "category", "type"], "left_anti")
