import random
import statistics

import pytest
from granary.operators import cascade, evaluation, integrity, joins, measures, ordered, retrieval, sets
from pyspark.sql import functions as F


def test_first_accepted_is_that_of_a_sequential_scan(spark):
    rng = random.Random(1)
    rows = [(i, f"k{rng.randrange(60)}" if rng.random() < 0.95 else None, rng.random() < 0.2, rng.random() < 0.3) for i in range(800)]
    seeds, seen, expected = {"k1", "k2"}, {"k1", "k2"}, []
    for _, k, early, late in rows:
        reason = "early" if early else "duplicate_svg" if k in seen else "late" if late else None
        if reason is None and k is not None:
            seen.add(k)
        expected.append(reason)
    df = spark.createDataFrame(rows, "pos int, k string, e boolean, l boolean").repartition(5)
    out = cascade.first_accepted(df, "k", ["pos"], {"early": F.col("e")}, {"late": F.col("l")}, spark.createDataFrame([(s,) for s in [*seeds, None]], "k string"))
    assert [r["rejection"] for r in out.orderBy("pos").collect()] == expected


def test_reasons_are_counted_with_zeros(spark):
    df = spark.createDataFrame([("a", None), ("a", "x"), ("b", "x")], "g string, rejection string")
    got = {(r["g"], r["reason"]): r["n"] for r in cascade.reason_counts(df, "g", ["x", "y"]).collect()}
    assert got == {("a", "accepted"): 1, ("a", "x"): 1, ("a", "y"): 0, ("b", "accepted"): 0, ("b", "x"): 1, ("b", "y"): 0}


def test_exclusion_by_any_key(spark):
    df = spark.createDataFrame([("1", "c", "d"), ("2", "x", "d"), ("3", "c", "y"), ("4", None, None)], "id string, cap string, det string")
    keys = spark.createDataFrame([("id", "1"), ("caption", "x"), ("caption", "y"), ("caption", "y"), ("svg", "c")], "kind string, value string")
    assert {r["id"]: r["is_excluded"] for r in cascade.excluded(df, keys, "id", "cap", "det").collect()} == {"1": True, "2": True, "3": True, "4": False}


def test_strict_join_statuses(spark):
    left = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), ("d",)], "k string")
    right = spark.createDataFrame([("a",), ("b",), ("e",)], "k string")
    audit = joins.strict_join(left, right, "k", spark.createDataFrame([("d",)], "k string"))
    assert {r["k"]: r["status"] for r in audit.collect()} == {"a": "matched", "b": "repeated", "c": "left_only", "d": "excepted", "e": "right_only"}
    assert joins.join_statistics(audit).first().asDict() == {"left_rows": 5, "right_rows": 3, "keys": 5, "matched": 1, "left_only": 1, "right_only": 1, "excepted": 1, "repeated": 1}


def test_lookups_and_pointers(spark):
    rows = spark.createDataFrame([("d:1", "1"), ("d:2", "2"), ("d:3", "3")], "q string, b string")
    table = spark.createDataFrame([("d:1", "x"), ("1", "y"), ("2", "z")], "key string, v string")
    assert {r["b"]: r["v"] for r in joins.two_level(rows, table, "q", "b", "key", "v").collect()} == {"1": "x", "2": "z", "3": None}
    hits = spark.createDataFrame([("f", 0, "a", "t"), ("f", 1, "x", "t"), ("f", 2, "c", "u"), ("f", 9, "d", "t"), ("f", 3, "e", "t")], "shard string, row_index int, record_id string, document string")
    stored = spark.createDataFrame([("f", 0, "a", "t", "s"), ("f", 1, "b", "t", "s"), ("f", 2, "c", "t", "s"), ("f", 3, "e", "t", "s" * 1_000_001)], "f string, r int, record_id string, document string, content string")
    assert {r["row_index"]: r["fault"] for r in joins.hydrated(hits, stored, "f", "r").collect()} == {0: None, 1: "other_id", 2: "other_document", 9: "no_row", 3: "too_large"}


def test_requested_order_and_completion(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert [r["v"] for r in joins.requested(df, "k", ["b", "a", "b"]).collect()] == [2, 1, 2]
    with pytest.raises(Exception, match="requested"):
        joins.requested(df, "k", ["z"]).collect()
    log = spark.createDataFrame([("a", "failed"), ("b", "done")], "k string, status string")
    assert [r["k"] for r in joins.uncompleted(df, log, "k", True).collect()] == ["a"] and joins.uncompleted(df, log, "k", False).count() == 0
    assert [r["v"] for r in joins.first_per_key(spark.createDataFrame([("a", 2), ("a", 1)], "k string, v int"), "k", ["v"]).collect()] == [1]


@pytest.mark.parametrize("n", [1, 2, 9, 10])
def test_both_kinds_of_quantiles(spark, n):
    values = sorted(random.Random(n).choices(range(30), k=n))
    df = spark.createDataFrame([("g", v) for v in values] + [("g", None)], "g string, v long")
    nearest = df.groupBy("g").agg(*[measures.nearest_rank("v", q).alias(str(q)) for q in (0.5, 0.95)]).first()
    assert [nearest["0.5"], nearest["0.95"]] == [values[max(0, -(-n * 50 // 100) - 1)], values[max(0, -(-n * 95 // 100) - 1)]]
    floor = measures.floor_quantiles(df, ["g"], "v", (0.5, 0.95)).first()
    assert [floor["p50"], floor["p95"]] == [values[int(0.5 * (n - 1))], values[int(0.95 * (n - 1))]]


def test_aggregates(spark):
    df = spark.createDataFrame([("a", 3, 0), ("a", 3, 1), ("a", 1, 2)], "g string, v int, i int")
    assert df.groupBy("g").agg(measures.arg_max_first(F.col("i"), F.col("v"), F.col("i")).alias("x")).first()["x"] == 0
    hist = measures.histogram(df, "v", 5)
    assert {r["value"]: r["n"] for r in hist.collect()} == {0: 0, 1: 1, 2: 0, 3: 2, 4: 0}
    assert measures.coverage(hist).first().asDict() == {"size": 5, "seen": 2, "absent": 3, "share": 0.4}
    two = df.agg(measures.set_digest("v").alias("d")).first()["d"], df.orderBy(F.desc("i")).agg(measures.set_digest("v").alias("d")).first()["d"]
    assert two[0] == two[1]
    loss = spark.createDataFrame([([1.0, 3.0], [1.0, 1.0]), ([9.0], [2.0])], "l array<double>, w array<double>")
    assert tuple(measures.weighted_means(loss, "l", "w").first()) == (22 / 4, statistics.mean([2, 9]))


def test_gates_fail_without_a_value(spark):
    df = spark.createDataFrame([("a", 0.9, 5.0), ("b", None, 9.0)], "g string, rate double, time double")
    got = {(r["g"], r["gate"]): r["passed"] for r in measures.gates(df, ["g"], ["rate", "time"], {"min_rate": 0.5, "max_time": 6}).collect()}
    assert got == {("a", "min_rate"): True, ("a", "max_time"): True, ("b", "min_rate"): False, ("b", "max_time"): False}
    assert {r["g"]: r["passed"] for r in measures.all_passed(measures.gates(df, ["g"], ["rate"], {"min_rate": 0.5}), ["g"]).collect()} == {"a": True, "b": False}


def test_rollup_denominators(spark):
    df = spark.createDataFrame([(True, True, True, True, 2.0, None, None), (False, True, False, True, 4.0, 1.0, None), (None, False, None, False, None, None, None)], "valid boolean, render_enabled boolean, rendered boolean, succeeded boolean, latency double, ttft double, tokens_per_second double")
    r = evaluation.rollup(df).first()
    assert (r["samples"], r["validity_rate"], r["render_rate"], r["success_rate"], r["mean_latency"], r["mean_ttft"], r["mean_tokens_per_second"]) == (3, 0.333333, 0.5, 0.666667, 3.0, 1.0, None)
    assert evaluation.rollup(df.limit(0)).first()["validity_rate"] == 0.0
    assert evaluation.report(evaluation.rollup(df))[1].startswith("samples: 3")


def test_samples_and_splits_are_balanced_and_stable(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 2).alias("g"))
    draw = lambda n: sorted((r["id"], r["sample_rank"]) for r in ordered.sampled(df.repartition(n), "g", "id", 30, 7).collect())
    assert draw(2) == draw(9) and len(draw(2)) == 60
    parts = ordered.split(ordered.sampled(df, "g", "id", 30, 7), "sample_rank", {"train": 20, "test": 10}).groupBy("g", "split").count().collect()
    assert {(r["g"], r["split"]): r["count"] for r in parts} == {(g, s): n for g in (0, 1) for s, n in (("train", 20), ("test", 10))}
    assert ordered.permuted_sample(["b", "a", "c"], 2, 1) == ordered.permuted_sample(["c", "b", "a"], 2, 1)


def test_best_attempt_fold(spark):
    rows = [("r", i, s) for i, s in enumerate([1.0, 3.0, None, 2.0, 9.0])] + [("q", 0, None)]
    got = {r["run"]: tuple(r)[1:] for r in ordered.best_attempts(spark.createDataFrame(rows, "run string, p int, s double"), "run", "p", "s", 2).collect()}
    assert got == {"r": (1, 3.0, 4, True), "q": (None, None, 1, False)}


def test_token_budget_takes_prefixes_and_goes_on(spark):
    rows = [("q", 0, "a b"), ("q", 1, "c d e\nf g h i"), ("q", 2, "too many words for the rest of it"), ("q", 3, "z"), ("q", 4, None)]
    got = ordered.token_budget(spark.createDataFrame(rows, "q string, i int, t string"), "q", "i", "t", 6).collect()
    assert [(r["i"], r["kept"], r["tokens"]) for r in sorted(got, key=lambda r: r["i"])] == [(0, "a b", 2), (1, "c d e", 5), (3, "z", 6)]


def test_lineage_and_ranks(spark):
    df = spark.createDataFrame([("r", 0, "a", None), ("r", 1, "b", "a"), ("r", 2, "c", "a")], "run string, p int, own string, parent string")
    assert [(r["own"], r["expected"]) for r in ordered.lineage_faults(df, "run", "p", "own", "parent").collect()] == [("c", "b")]
    got = ordered.ranked(spark.createDataFrame([("q", 5, None), ("q", 6, 9)], "q string, s int, rank int"), ["q"], "s").collect()
    assert sorted(r["rank"] for r in got) == [1, 9]
    grouped = ordered.length_grouped(spark.range(40).withColumn("n", F.col("id") % 7), "n", "id", 1, 10).collect()
    for b in {r["bucket"] for r in grouped}:
        lengths = [r["n"] for r in sorted((r for r in grouped if r["bucket"] == b), key=lambda r: r["place"])]
        assert lengths == sorted(lengths, reverse=True)


def test_overlaps_with_zeros(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("a", "1")], "role string, sample_id string")
    assert {(r["role_a"], r["role_b"]): r["shared"] for r in sets.overlaps(df).collect()} == {("a", "b"): 1, ("a", "c"): 0, ("b", "c"): 0}


def test_nearest_is_exact_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(120, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[7] = v[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "id long, e array<double>").repartition(5)
    asked = df.where("id < 20").select(F.col("id").alias("q"), F.col("e").alias("v"))
    expected = {(q, i + 1): int(j) for q in range(20) for i, j in enumerate(sorted((j for j in range(120) if j != q), key=lambda j: (-(v[q] @ v[j]), j))[:4])}
    for block in (4096, 3):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        assert {(r["query_id"], r["rank"]): r["id"] for r in retrieval.nearest(df, asked, 4, "id", "e", "q", "v").collect()} == expected
    assert retrieval.nearest(df, asked.limit(0), 4, "id", "e", "q", "v").count() == 0
    unit = df.where("id = 3").select(retrieval.cosine(F.col("e"), retrieval.normalized(F.transform("e", lambda x: x * 5)))).first()[0]
    assert abs(unit - 1) < 1e-6
    text = spark.createDataFrame([("a b c",), ("",)], "t string").select(retrieval.hashed_embedding(F.col("t"), 16)).collect()
    assert len(text[0][0]) == 16 and text[1][0] is None


def run(**over):
    h = "a" * 64
    call = {"call_id": "c", "latency_seconds": 1.0, "prompt_tokens": 1, "completion_tokens": 1}
    attempt = lambda i, parent, k: {"attempt_id": i, "parent_id": parent, "position": k, "status": "pass", "mode": "initial" if not k else "revision", "svg_sha256": h, "target_ids": ["e1"], "model_calls": [call]}
    feedback = {"attempt_id": "b", "score": 8.0, "status": "pass", "flags": [True], "evaluations": [{"category": "c", "type": "t", "applicable": True, "score": 6.0}], "issues": [{"category": "c", "type": "t", "target_ids": ["e1"]}]}
    return {"run_id": "r", "schema_version": 3, "selected_attempt_id": "b", "accepted": True, "acceptance_score": 7.0, "attempts": [attempt("a", None, 0), attempt("b", "a", 1)], "critic_feedback": [feedback]} | over


def broken(path, value):
    r = run()
    at = r
    for p in path[:-1]:
        at = at[p]
    at[path[-1]] = value
    return r


@pytest.mark.parametrize(("record", "rules"), [
    (run(), set()), (run(schema_version=9), {"schema_version"}), (run(selected_attempt_id="z"), {"selected_attempt", "accepted_without_pass"}),
    (broken(["attempts", 1, "parent_id"], "z"), {"attempt_parent"}), (broken(["attempts", 0, "svg_sha256"], None), {"attempt_digest"}), (broken(["attempts", 0, "status"], "odd"), {"attempt_status"}),
    (broken(["attempts", 0, "position"], 4), {"attempt_position"}), (broken(["attempts", 1, "mode"], "initial"), {"attempt_mode"}), (broken(["critic_feedback", 0, "score"], 11.0), {"feedback_score"}),
    (broken(["critic_feedback", 0, "evaluations", 0, "score"], 9.0), {"issue_without_low_score"}), (broken(["critic_feedback", 0, "issues", 0, "target_ids"], ["e9"]), {"issue_target"}),
    (broken(["critic_feedback", 0, "attempt_id"], "z"), {"feedback_attempt", "issue_target", "accepted_without_pass"}), (broken(["critic_feedback", 0, "score"], 6.5), {"accepted_without_pass"}),
    (broken(["attempts", 0, "model_calls", 0, "prompt_tokens"], -1), {"call_values"}),
])
def test_integrity_rules(spark, record, rules):
    found = integrity.violations(spark.createDataFrame([record], integrity.RUN))
    assert {r["rule"] for r in found.collect()} == rules
    if rules:
        with pytest.raises(ValueError, match="integrity"):
            integrity.raise_if_any(found)


def test_scorecards(spark):
    df = spark.createDataFrame([run()["critic_feedback"][0]], "attempt_id string, score double, status string, flags array<boolean>, evaluations array<struct<category: string, type: string, applicable: boolean, score: double>>")
    assert tuple(df.select(integrity.scorecard(F.col("evaluations"), 7.0)).first()[0]) == (6.0, 1, 6.0)
    ok = lambda version, t, a: df.select(integrity.accepted(F.col("evaluations"), F.col("status"), F.col("flags"), F.col("score"), F.lit(version), t, a)).first()[0]
    assert (ok(3, 5.0, 0), ok(3, 7.0, 0), ok(2, 9.0, 9), ok(1, 9.0, 9), ok(1, 9.0, 8)) == (True, False, True, False, True)
    assert spark.range(1).select(integrity.rule_score(F.lit(3), F.lit(2)), integrity.rule_score(F.lit(1), F.lit(1))).first()[:] == (0, 6)


def test_first_accepted_spreads_rows_without_a_key(spark):
    """Nine in ten rows have no key: with broadcasts and adaptive execution off no partition holds much more than its share."""
    df = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 10 == 0, (F.col("id") % 500).cast("string")).alias("key"))
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(was, ("false", "-1", "8")):
            spark.conf.set(k, v)
        out = cascade.first_accepted(df, "key", ["id"], {"early": F.col("id") < 10}, {"late": F.col("id") == 20}, spark.createDataFrame([("30",)], "s string"))
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("count"), F.max("rejection")).collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 4_000
        rows = {r["id"]: r["rejection"] for r in out.collect()}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    seen, expected = {"30"}, {}
    for i in range(20_000):
        key = str(i % 500) if i % 10 == 0 else None
        expected[i] = "early" if i < 10 else "duplicate_svg" if key in seen else "late" if i == 20 else None
        if expected[i] is None and key is not None:
            seen.add(key)
    assert rows == expected
