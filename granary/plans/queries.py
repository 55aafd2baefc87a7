"""The registered queries of the library's own operators, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import codes, critic, fields, markup, pathcodec, text
from granary.operators import audits, cascade, evaluation, integrity, joins, measures, ordered, retrieval, sets
from granary.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WORDS = r"[^ \t\n\r]+"
_KEY_SQL = r"sha256(trim(regexp_replace(lower(text), '[ \t\n\r]+', ' ', 'g')))"


def _key(c: str) -> Column:
    return F.sha2(F.trim(F.regexp_replace(F.lower(c), r"[ \t\n\r]+", " ")), 256)


_EARLY_SQL = rf"""CASE WHEN text IS NULL OR trim(text) = '' THEN 'missing_required_field'
    WHEN len(regexp_extract_all(text, '{_WORDS}')) NOT BETWEEN 20 AND 3000 THEN 'description_length'
    WHEN key IN (SELECT {_KEY_SQL} FROM benchmark) THEN 'benchmark_exclusion'
    WHEN length(text) NOT BETWEEN 100 AND 30000 THEN 'svg_char_length' END"""
_LATE_SQL = "CASE WHEN strlen(text) > 20000 THEN 'svg_token_length' END"
_CASCADE_SQL = f"""k AS (SELECT *, {_KEY_SQL} AS key FROM documents),
    e AS (SELECT *, {_EARLY_SQL} AS early, {_LATE_SQL} AS late FROM k),
    f AS (SELECT *, min((source, doc_id)) FILTER (early IS NULL AND late IS NULL) OVER (PARTITION BY key) AS first FROM e),
    judged AS (SELECT *, coalesce(early, CASE WHEN (source, doc_id) > first THEN 'duplicate_svg' END, late) AS rejection FROM f)"""
_PREP_REASONS = ("missing_required_field", "description_length", "benchmark_exclusion", "svg_char_length", "duplicate_svg", "svg_token_length")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("key", _key("text"))
    docs = cascade.flagged(docs, table(spark, sf_dir, "benchmark").select(_key("text").alias("key")), {"key": "key"}, "leaks")
    early = {
        "missing_required_field": F.col("text").isNull() | (F.trim("text") == ""),
        "description_length": ~F.regexp_count("text", F.lit(_WORDS)).between(20, 3000),
        "benchmark_exclusion": F.col("leaks"),
        "svg_char_length": ~F.length("text").between(100, 30000),
    }
    return cascade.first_accepted(docs, "key", ["source", "doc_id"], early, {"svg_token_length": F.octet_length("text") > 20000})


@query(f"""WITH {_CASCADE_SQL}, r(reason) AS (VALUES ('accepted'), {", ".join(f"('{r}')" for r in _PREP_REASONS)})
    SELECT s.source, r.reason, (SELECT count(*) FROM judged j WHERE j.source = s.source AND coalesce(j.rejection, 'accepted') = r.reason) AS n FROM (SELECT DISTINCT source FROM documents) s, r""")
def prep_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter cascade over the corpus, counted by source and reason."""
    return cascade.reason_counts(_judged(spark, sf_dir), "source", _PREP_REASONS)


@query(f"""WITH {_CASCADE_SQL}, s AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('42|' || doc_id), doc_id) AS sample_rank FROM judged WHERE rejection IS NULL)
    SELECT source, doc_id, sample_rank::INTEGER AS sample_rank, CASE WHEN sample_rank <= 20 THEN 'train' WHEN sample_rank <= 25 THEN 'validation' ELSE 'test' END AS split FROM s WHERE sample_rank <= 30""")
def prep_selected_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A balanced sample of the accepted rows of each source, split by rank."""
    rows = _judged(spark, sf_dir).where("rejection is null").select("source", "doc_id")
    return ordered.split(ordered.sampled(rows, "source", "doc_id", 30, 42), "sample_rank", {"train": 20, "validation": 5, "test": 5})


@query(f"WITH {_CASCADE_SQL} SELECT doc_id, source, rejection FROM judged")
def exact_dedup_first_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("doc_id", "source", "rejection")


@query("SELECT c_custkey, coalesce(nullif(trim(c_mktsegment), ''), nullif(trim(c_name), '')) AS value, CASE WHEN nullif(trim(c_mktsegment), '') IS NOT NULL THEN 'c_mktsegment' WHEN nullif(trim(c_name), '') IS NOT NULL THEN 'c_name' END AS field FROM customer")
def first_text_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    return df.select("c_custkey", fields.first_text_with_field(df, ["title", "c_mktsegment", "c_name"]).alias("f")).select("c_custkey", "f.value", "f.field")


@query(r"SELECT lang, count(*) FILTER (n BETWEEN 50 AND 500) AS inside, count(*) FILTER (n NOT BETWEEN 50 AND 500) AS outside, sum(n)::BIGINT AS words FROM (SELECT lang, len(regexp_extract_all(text, '[\p{L}\p{N}_]+(?:[-''][\p{L}\p{N}_]+)*')) AS n FROM documents) GROUP BY lang")
def word_count_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = text.word_count(F.col("text"))
    return table(spark, sf_dir, "documents").select("lang", n.alias("n")).groupBy("lang").agg(F.count_if(F.col("n").between(50, 500)).alias("inside"), F.count_if(~F.col("n").between(50, 500)).alias("outside"), F.sum("n").alias("words"))


@query("SELECT doc_id, (('0x' || substr(h, 1, 16))::UBIGINT % 100)::INTEGER AS bucket, CASE WHEN ('0x' || substr(h, 1, 16))::UBIGINT % 100 < 60 THEN 'detail' ELSE 'description' END AS policy, h AS stable_key FROM (SELECT doc_id, sha256('corpus' || chr(31) || '' || chr(31) || coalesce(source, '') || chr(31) || doc_id || chr(31) || sha256(text)) AS h FROM documents)")
def stable_hash_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = text.stable_key(F.lit("corpus"), F.lit(None).cast("string"), F.col("source"), F.col("doc_id").cast("string"), F.sha2("text", 256))
    df = table(spark, sf_dir, "documents").select("doc_id", key.alias("stable_key"))
    bucket = text.hash_bucket(F.col("stable_key"))
    return df.select("doc_id", bucket.alias("bucket"), F.when(bucket < 60, "detail").otherwise("description").alias("policy"), "stable_key")


@query(f"""WITH ids AS (SELECT DISTINCT role, k FROM (SELECT lang AS role, {_KEY_SQL} AS k FROM documents UNION ALL SELECT 'benchmark', {_KEY_SQL} FROM benchmark)), roles AS (SELECT DISTINCT role FROM ids)
    SELECT a.role AS role_a, b.role AS role_b, (SELECT count(*) FROM ids x JOIN ids y USING (k) WHERE x.role = a.role AND y.role = b.role) AS shared FROM roles a JOIN roles b ON a.role < b.role""")
def leakage_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts shared between every two roles; languages and the benchmark are the roles."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("role"), _key("text").alias("sample_id"))
    return sets.overlaps(docs.unionByName(table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("role"), _key("text").alias("sample_id"))))


@query("""SELECT c_mktsegment AS domain, count(*) AS listed, count(n) AS found, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (n > 1) AS repeated
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1""")
def allowlist_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    allow = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("domain"), F.col("c_custkey").alias("id"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).join(allow, "id")
    return joins.allowlist_audit(rows, allow, "domain", "id")


@query("""WITH l AS (SELECT p_partkey AS k, count(*) AS a FROM part GROUP BY 1), r AS (SELECT l_partkey AS k, count(*) AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
    j AS (SELECT coalesce(a, 0) AS a, coalesce(b, 0) AS b, k IN (SELECT p_partkey FROM part WHERE p_size > 40) AS x FROM l FULL JOIN r USING (k)),
    s AS (SELECT *, CASE WHEN a > 1 OR b > 1 THEN 'repeated' WHEN b = 0 THEN CASE WHEN x THEN 'excepted' ELSE 'left_only' END WHEN a = 0 THEN 'right_only' ELSE 'matched' END AS t FROM j)
    SELECT sum(a)::BIGINT AS left_rows, sum(b)::BIGINT AS right_rows, count(*) AS "keys", count(*) FILTER (t = 'matched') AS matched, count(*) FILTER (t = 'left_only') AS left_only, count(*) FILTER (t = 'right_only') AS right_only, count(*) FILTER (t = 'excepted') AS excepted, count(*) FILTER (t = 'repeated') AS repeated FROM s""")
def strict_join_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_size")
    right = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k"))
    return joins.join_statistics(joins.strict_join(part.select("k"), right, "k", part.where("p_size > 40").select("k")))


@query("""SELECT lang, count(n_chars) AS n, min(n_chars) AS min_value, max(n_chars) AS max_value, sum(n_chars)::BIGINT AS sum_value, round(avg(n_chars), 6) AS mean_value, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.95) AS p95, quantile_disc(n_chars, 0.99) AS p99, count(*) FILTER (n_chars > 2048) AS over_2048, count(*) FILTER (n_chars > 8192) AS over_8192 FROM documents GROUP BY lang""")
def length_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(*measures.length_summary("n_chars", thresholds=(2048, 8192)))


@query("SELECT source, len(v)::BIGINT AS n, v[floor(0.5 * (len(v) - 1))::INTEGER + 1] AS p50, v[floor(0.95 * (len(v) - 1))::INTEGER + 1] AS p95, v[floor(0.99 * (len(v) - 1))::INTEGER + 1] AS p99 FROM (SELECT source, list_sort(list(n_chars)) AS v FROM documents GROUP BY source)")
def length_quantiles_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.floor_quantiles(table(spark, sf_dir, "documents"), ["source"], "n_chars", (0.5, 0.95, 0.99))


@query("SELECT lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def argmax_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = measures.arg_max_first(F.struct("doc_id", "n_chars"), F.col("n_chars"), F.col("doc_id"))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(row.alias("r")).select("lang", "r.doc_id", "r.n_chars")


@query("""SELECT threshold, lang, count(*) FILTER (n_chars <= threshold) AS at_most, count(*) FILTER (n_chars > threshold) AS over_count, round(count(*) FILTER (n_chars > threshold) / count(n_chars), 8) AS over_fraction FROM documents, (VALUES (2304), (4096), (8192)) AS t(threshold) GROUP BY ALL""")
def threshold_exceedance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.exceedance(table(spark, sf_dir, "documents"), ["lang"], "n_chars", [2304, 4096, 8192])


@query("""WITH h AS (SELECT v, count(l_quantity) AS n FROM range(64) AS r(v) LEFT JOIN lineitem ON l_quantity = v GROUP BY v) SELECT count(*) AS size, count(*) FILTER (n > 0) AS seen, count(*) FILTER (n = 0) AS absent, round(avg((n > 0)::INTEGER), 8) AS share FROM h""")
def histogram_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.coverage(measures.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 64))


@query("""WITH h AS (SELECT l_quantity::BIGINT AS value, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 63 GROUP BY 1),
    a AS (SELECT 'top' AS "end", row_number() OVER (ORDER BY n DESC, value) AS place, value, n FROM h), b AS (SELECT 'least' AS "end", row_number() OVER (ORDER BY n, value) AS place, value, n FROM h)
    SELECT "end", place::INTEGER AS place, value, n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE place <= 10""")
def histogram_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.extremes(measures.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 64))


@query("""WITH t AS (SELECT DISTINCT l_partkey AS v FROM lineitem WHERE l_returnflag = 'A'), e AS (SELECT l_partkey AS v, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT count(*) FILTER (v NOT IN (SELECT v FROM t)) AS unseen_values, coalesce(sum(n) FILTER (v NOT IN (SELECT v FROM t)), 0)::BIGINT AS unseen_occurrences, count(*) AS vals, sum(n)::BIGINT AS occurrences FROM e""")
def cross_split_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    counted = items.where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return sets.unseen(items.where("l_returnflag = 'A'"), counted, ["l_partkey"], "n")


@query("""SELECT lang, count(*) AS pairs, sum(b - a)::BIGINT AS added, round(sum(b) / sum(a), 6) AS ratio_of_sums, round(avg(b / a), 6) AS mean_ratio, round(max(b / a), 6) AS max_ratio, max(b - a) AS max_added FROM (SELECT lang, length(text) AS a, strlen(text) AS b FROM documents WHERE length(text) > 0) GROUP BY lang""")
def paired_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("lang", F.length("text").alias("a"), F.octet_length("text").alias("b")).where("a > 0")
    return measures.paired_lengths(df, "a", "b", ["lang"])


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS trailing FROM events")
def trailing_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(ordered.trailing_mean("value", ["user_id"], "event_id"), 4).alias("trailing"))


@query("""SELECT query_id, id, score, rank::INTEGER AS rank FROM (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) DESC, c.vec_id) AS rank
    FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id) WHERE rank <= 10""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest of every vector whose id is divisible by 20, against all."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    return retrieval.nearest(vectors, asked, 10, "vec_id", "embedding", "q", "v").withColumn("score", F.round("score", 6))


@query("""WITH h AS (SELECT q.vec_id AS query_id, c.vec_id AS id, c.label, list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
    w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM h WHERE s >= 0.1)
    SELECT query_id, id, round(s, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM w WHERE r <= 15 AND label % 2 = 0) WHERE rank <= 5""")
def retrieval_overfetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five usable hits out of fifteen over a threshold."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    hits = retrieval.nearest(vectors, asked, 15, "vec_id", "embedding", "q", "v", threshold=0.1).drop("rank")
    hits = hits.join(vectors.select(F.col("vec_id").alias("id"), "label"), "id")
    return retrieval.over_fetched(hits, ["query_id"], [F.desc("score"), F.col("id")], 5, 3, F.col("label") % 2 == 0).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 45)")
def incremental_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "lineitem").where("l_returnflag = 'N' AND l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return joins.missing(table(spark, sf_dir, "part").select("p_partkey", "p_name"), stored, "p_partkey")


@query("""SELECT conv_id, turn, own, parent, expected FROM (SELECT conv_id, turn, role AS own, CASE WHEN turn > 0 THEN CASE WHEN role = 'assistant' THEN 'user' ELSE 'assistant' END END AS parent, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS expected FROM conversations) WHERE parent IS DISTINCT FROM expected""")
def lineage_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that don't follow the other role's turn."""
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("own"), F.when(F.col("turn") > 0, F.when(F.col("role") == "assistant", "user").otherwise("assistant")).alias("parent"))
    return ordered.lineage_faults(df, "conv_id", "turn", "own", "parent")


_RESULTS = {"valid": "value > 5", "render_enabled": "event_id % 3 <> 0", "rendered": "value > 20", "succeeded": "event_type <> 'error'"}


@query("""WITH m AS (SELECT user_id % 7 AS cohort, round(avg((value > 5)::INTEGER), 6) AS validity_rate, coalesce(round(avg((value > 20)::INTEGER) FILTER (event_id % 3 <> 0), 6), 0.0) AS render_rate, round(avg(value), 6) AS mean_latency, round(avg(value / 2) FILTER (event_id % 4 = 0), 6) AS ttft, round(avg(value + 1) FILTER (event_id % 4 = 1 AND user_id % 7 <> 3), 6) AS speed FROM events GROUP BY 1)
    SELECT cohort, gate, value, threshold, coalesce(CASE WHEN gate LIKE 'min%' THEN value >= threshold ELSE value <= threshold END, false) AS passed FROM (
      SELECT cohort, 'min_validity_rate' AS gate, validity_rate AS value, 0.9::DOUBLE AS threshold FROM m UNION ALL SELECT cohort, 'min_render_rate', render_rate, 0.5 FROM m UNION ALL SELECT cohort, 'max_mean_latency', mean_latency, 30.0 FROM m UNION ALL SELECT cohort, 'max_mean_ttft', ttft, 15.0 FROM m UNION ALL SELECT cohort, 'min_mean_tokens_per_second', speed, 20.0 FROM m)""")
def eval_rollup_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ttft, speed = F.when(F.col("event_id") % 4 == 0, F.col("value") / 2), F.when((F.col("event_id") % 4 == 1) & (F.col("user_id") % 7 != 3), F.col("value") + 1)
    df = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("cohort"), F.col("value").alias("latency"), ttft.alias("ttft"), speed.alias("tokens_per_second"), *[F.expr(x).alias(n) for n, x in _RESULTS.items()])
    return evaluation.gated(df, ["cohort"], {"min_validity_rate": 0.9, "min_render_rate": 0.5, "max_mean_latency": 30.0, "max_mean_ttft": 15.0, "min_mean_tokens_per_second": 20.0})


@query("SELECT coalesce(nullif(event_type, 'view'), 'unknown') AS outcome, count(*) AS n FROM events GROUP BY 1")
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.outcome_counts(table(spark, sf_dir, "events").select(F.nullif("event_type", F.lit("view")).alias("o")), "o")


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A framed drawing sequence made of every line item: a move, a curve, a special or plain color."""
    point = lambda c: F.lit(codes.BOOK.coordinate[0]) + F.col(c) % 40000
    color = F.lit(codes.BOOK.color[0]) + (F.col("l_partkey") * 7 + F.col("l_linenumber")) % 4098
    ids = F.array(F.lit(codes.BOOK.bos), F.lit(151939), point("l_orderkey"), F.lit(151938), point("l_partkey"), point("l_suppkey"), color, F.lit(codes.BOOK.eos))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.transform(ids, lambda i: i.cast("int")).alias("ids"))


_POINTS_SQL = "SELECT unnest([l_orderkey % 40000, l_partkey % 40000, l_suppkey % 40000]) AS p, 0 AS c FROM lineitem"
_COLOR_SQL = "(l_partkey * 7 + l_linenumber) % 4098"


@query(f"""WITH p AS ({_POINTS_SQL}), parts AS (SELECT 'x' AS kind, p % 200 AS value FROM p UNION ALL SELECT 'y', p // 200 FROM p UNION ALL SELECT 'color', {_COLOR_SQL} FROM lineitem
      UNION ALL SELECT unnest(['bos', 'eos', 'command', 'command']), unnest([0, 0, 1, 0]) FROM lineitem)
    SELECT kind, value::INTEGER AS value, count(*) AS n FROM parts GROUP BY ALL""")
def token_xy_factorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.component_counts(_sequences(spark, sf_dir), "ids", codes.factorize_xy)


@query(f"""WITH p AS ({_POINTS_SQL}), c AS (SELECT {_COLOR_SQL} AS c FROM lineitem), parts AS (SELECT 'x' AS kind, p % 200 AS value FROM p UNION ALL SELECT 'y', p // 200 FROM p UNION ALL SELECT 'special_color', c FROM c WHERE c < 2
      UNION ALL SELECT unnest(['r', 'g', 'b']), unnest([((c - 2) >> 8) & 15, ((c - 2) >> 4) & 15, (c - 2) & 15]) FROM c WHERE c >= 2 UNION ALL SELECT unnest(['bos', 'eos', 'command', 'command', 'path_end']), unnest([0, 0, 1, 0, 0]) FROM lineitem)
    SELECT kind, value::INTEGER AS value, count(*) AS n FROM parts GROUP BY ALL""")
def token_rgb_factorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.component_counts(_sequences(spark, sf_dir), "ids", codes.factorize_xy_rgb)


@query("SELECT count(*) AS rows_in, count(*) AS xy_back, count(*) AS rgb_back, count(*) AS valid FROM lineitem")
def token_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both factorizations give the ids back, and all sequences keep the grammar."""
    df = _sequences(spark, sf_dir).withColumn("f", codes.sequence_features("ids"))
    ids = F.transform("ids", lambda i: i.cast("bigint"))
    back = lambda parts: F.count_if(codes.invert(parts) == ids)
    return df.agg(F.count("*").alias("rows_in"), back(codes.factorize_xy(F.col("ids"))).alias("xy_back"), back(codes.factorize_xy_rgb(F.col("ids"))).alias("rgb_back"), F.count_if(F.col("f.error").isNull()).alias("valid"))


@query("SELECT conv_id, turn, 'Request: ' || text AS prompt, 3 AS messages, (length('Request: ' || text) + 4 + length(text))::INTEGER AS chars FROM conversations WHERE text IS NOT NULL")
def prompt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "conversations").where("text is not null").withColumn("prompt", fields.brief_prompt(F.col("text")))
    df = df.withColumn("m", fields.chat("Draw", F.col("prompt"), F.col("text")))
    return df.select("conv_id", "turn", "prompt", F.size("m").alias("messages"), F.aggregate("m", F.lit(0), lambda s, x: s + F.length(x.content)).alias("chars"))


@query("""SELECT event_type, sum((props::JSON ->> '$.k')::BIGINT)::BIGINT AS total, count(*) FILTER ((props::JSON ->> '$.k') IS NOT NULL) AS present, 0::BIGINT AS absent_path FROM events GROUP BY 1""")
def json_variant_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_type", F.try_parse_json("props").alias("v"))
    k, other = fields.json_path(F.col("v"), "k", "bigint"), fields.identity(F.col("v"), ["sample_id", "id"])
    return df.groupBy("event_type").agg(F.sum(k).alias("total"), F.count(k).alias("present"), F.count(other).alias("absent_path"))


def _drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A markup text for every part; by size some have a script, an outside reference, a bad property, or don't parse."""
    extra = (
        F.when(F.col("p_size") % 7 == 1, "<script>x</script>").when(F.col("p_size") % 7 == 2, '<use href="http://a.b/c"/>').when(F.col("p_size") % 7 == 3, '<rect style="behavior:x"/>')
        .when(F.col("p_size") % 7 == 4, "<g>").when(F.col("p_size") % 7 == 5, '<g><rect fill="url(#a)"/><line/></g>').otherwise("")
    )
    body = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg"><defs><linearGradient id="a"/></defs><path d="M0 0 L'), F.col("p_size").cast("string"), F.lit(' 5 Z"/>'), extra, F.lit("</svg>"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", body.alias("svg"))


@query("""SELECT p_partkey, p_size % 7 NOT IN (1, 2, 3, 4) AS is_valid, CASE p_size % 7 WHEN 1 THEN 'unsafe_attribute,unsafe_element' WHEN 2 THEN 'external_reference' WHEN 3 THEN 'unsafe_css' WHEN 4 THEN 'xml_parse_error' ELSE '' END AS found, CASE WHEN p_size % 7 = 5 THEN 'defs,lineargradient,path,g,rect,line' WHEN p_size % 7 IN (0, 6) THEN 'defs,lineargradient,path' END AS names FROM part""")
def markup_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _drawings(spark, sf_dir).withColumn("v", markup.validate("svg"))
    codes_ = F.array_join(F.array_sort(F.array_distinct(F.transform("v.errors", lambda e: e.code))), ",")
    return df.select("p_partkey", "v.is_valid", codes_.alias("found"), F.array_join(markup.safe_names("svg"), ",").alias("names"))


@query("""SELECT role, tag, count(*) AS n FROM (SELECT unnest(['svg', 'graphics']) AS role, unnest(['svg', 'path']) AS tag FROM part WHERE p_size % 7 <> 4
    UNION ALL SELECT unnest(['group', 'graphics', 'graphics', 'resource']), unnest(['g', 'rect', 'line', 'linearGradient']) FROM part WHERE p_size % 7 = 5
    UNION ALL SELECT 'graphics', CASE p_size % 7 WHEN 2 THEN 'use' ELSE 'rect' END FROM part WHERE p_size % 7 IN (2, 3)) GROUP BY ALL""")
def markup_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled elements of every text, from a table function, by role and tag."""
    elements = _drawings(spark, sf_dir).lateralJoin(markup.LabelledElements(F.col("svg").outer()))
    return elements.groupBy("role", "tag").agg(F.count("*").alias("n"))


@query(r"""WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(text, '') AS whole, string_split(coalesce(text, ''), chr(10)) AS ls, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
    m AS (SELECT conv_id, r, n, p, len(regexp_extract_all(p, '\S+')) AS w FROM (SELECT conv_id, r, n, array_to_string(ls[1:n], chr(10)) AS p FROM (SELECT conv_id, r, ls, unnest(range(1, len(ls) + 1)) AS n FROM t)) WHERE regexp_matches(p, '\S')),
    f AS (SELECT DISTINCT conv_id, 0::BIGINT AS r, 0::BIGINT AS tokens, NULL::BIGINT AS n FROM t UNION ALL
      SELECT f.conv_id, t.r, f.tokens + coalesce((SELECT max(w) FROM m WHERE m.conv_id = t.conv_id AND m.r = t.r AND f.tokens + w <= 120), 0), (SELECT max(m.n) FROM m WHERE m.conv_id = t.conv_id AND m.r = t.r AND f.tokens + w <= 120) FROM f JOIN t ON t.conv_id = f.conv_id AND t.r = f.r + 1)
    SELECT conv_id, turn, whole AS text, p AS kept, tokens FROM f JOIN t USING (conv_id, r) JOIN m USING (conv_id, r, n)""")
def token_budget_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.token_budget(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 120)


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, length(text)::DOUBLE AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
    f AS (SELECT conv_id, r, CASE WHEN s IS NOT NULL THEN turn END AS at, s AS best, CASE WHEN s IS NULL THEN 1 ELSE 0 END AS idle FROM t WHERE r = 1
      UNION ALL SELECT f.conv_id, t.r, CASE WHEN s > best OR best IS NULL AND s IS NOT NULL THEN turn ELSE f.at END, CASE WHEN s > best OR best IS NULL THEN s ELSE best END, CASE WHEN s > best OR best IS NULL AND s IS NOT NULL THEN 0 ELSE idle + 1 END FROM f JOIN t ON t.conv_id = f.conv_id AND t.r = f.r + 1 WHERE idle < 2)
    SELECT conv_id, at AS best_position, best AS best_score, r AS used, idle >= 2 AS stopped FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY r DESC) AS k FROM f) WHERE k = 1""".replace(" AS at", ' AS "at"').replace("f.at", 'f."at"').replace("SELECT conv_id, at AS", 'SELECT conv_id, "at" AS'))
def best_attempt_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("s"))
    return ordered.best_attempts(df, "conv_id", "turn", "s", 2)


@query(f"""SELECT lang, sum(n)::BIGINT AS n, sha256(string_agg(d, chr(10) ORDER BY b)) AS digest FROM (SELECT lang, doc_id // {measures.DIGEST_BLOCK} AS b, count(*) AS n, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id)) AS d FROM documents GROUP BY ALL) GROUP BY lang""")
def ordered_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.ordered_digest(table(spark, sf_dir, "documents").select("lang", "doc_id"), ["lang"], "doc_id", "doc_id")


@query("""WITH s AS (SELECT o_orderkey AS step, round(1000.0 / (o_orderkey + 10) + o_totalprice / 1000000, 6) AS loss FROM orders)
    SELECT min(loss) AS best, (SELECT step FROM s ORDER BY loss, step LIMIT 1) AS best_step, (SELECT loss FROM s ORDER BY step LIMIT 1) AS first, (SELECT round(avg(loss), 6) FROM (SELECT loss FROM s ORDER BY step DESC LIMIT 10)) AS last_mean, round(100 * ((SELECT loss FROM s ORDER BY step LIMIT 1) - min(loss)) / (SELECT loss FROM s ORDER BY step LIMIT 1), 4) AS improvement FROM s""")
def learning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step"), F.round(F.lit(1000.0).cast("double") / (F.col("o_orderkey") + 10) + F.col("o_totalprice") / 1000000, 6).alias("loss"))
    return measures.learning_summary(steps)


@query("""WITH q AS (SELECT l_orderkey, l_linenumber, coalesce((SELECT any_value(s_name) FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > 5000), (SELECT any_value(p_name) FROM part WHERE p_partkey = l_partkey)) AS v FROM lineitem) SELECT l_orderkey, l_linenumber, v FROM q""")
def two_level_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value of the qualified key, else of the bare one."""
    keys = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("k"), F.col("s_name").alias("v"))
    keys = keys.unionByName(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("k"), F.col("p_name").alias("v")))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("q"), F.col("l_partkey").cast("string").alias("b"))
    return joins.two_level(rows, keys, "q", "b", "k", "v").select("l_orderkey", "l_linenumber", "v")


@query("""SELECT l_orderkey, round(avg(l_quantity), 6) AS score, bool_and(l_tax < 0.07) AS flag, CASE max(CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END) WHEN 2 THEN 'reject' WHEN 1 THEN 'revise' ELSE 'pass' END AS status, string_agg(i, ',' ORDER BY f, i) AS issues
    FROM (SELECT *, min(l_linenumber) OVER (PARTITION BY l_orderkey, l_linestatus) AS f, CASE WHEN row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber) = 1 THEN l_linestatus END AS i FROM lineitem) GROUP BY l_orderkey""")
def combined_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several critics' feedback on a run as one; lines of an order stand for critics."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("critic_order"), F.col("l_quantity").cast("double").alias("score"), F.when(F.col("l_returnflag") == "R", "reject").when(F.col("l_returnflag") == "A", "revise").otherwise("pass").alias("status"), (F.col("l_tax") < 0.07).alias("flag"), F.array("l_linestatus").alias("issues"))
    return integrity.combined(df, ["l_orderkey"]).withColumn("issues", F.array_join("issues", ","))


@query("SELECT event_type, round(sum(value), 6) AS read, round(sum(value * 2), 6) AS write, round(sum(value + value * 2), 6) AS total FROM events GROUP BY 1")
def latency_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_type", F.col("value").alias("read"), (F.col("value") * 2).alias("write"))
    return evaluation.latency_stages(df, ["event_type"], ["read", "write"])


@query("""SELECT c_custkey, concat_ws(chr(10), 'Name: ' || nullif(trim(c_name), ''), 'Segment: ' || nullif(trim(c_mktsegment), '')) AS search_text, lower(c_mktsegment) || ':' || c_custkey AS item_id FROM customer""")
def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    return df.select("c_custkey", fields.search_text({"Name": F.col("c_name"), "Segment": F.col("c_mktsegment")}).alias("search_text"), fields.stable_id(F.col("c_mktsegment"), F.col("c_custkey").cast("string")).alias("item_id"))


@query("SELECT lang, n_chars <= 4096 AS retained, count(*) AS n, min(n_chars) AS shortest, max(n_chars) AS longest, sum(n_chars)::BIGINT AS total FROM documents GROUP BY ALL")
def length_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows within and over a length limit."""
    df = sets.length_cohorts(table(spark, sf_dir, "documents"), "n_chars", 4096)
    return df.groupBy("lang", "retained").agg(F.count("*").alias("n"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"), F.sum("n_chars").alias("total"))


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows over events: an extension, with the code that also runs on a stream."""
    return ingest.tumbling(table(spark, sf_dir, "events"), "1 hour", "10 minutes", ["event_type"])


@query("""SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows over events: an extension."""
    return ingest.sessions(table(spark, sf_dir, "events"), "30 minutes", "10 minutes", "user_id")


@query("""WITH c AS (SELECT conv_id::VARCHAR AS run_id, conv_id::VARCHAR || '-' || turn AS own, length(text) AS n FROM conversations)
    SELECT run_id, 'attempt_digest' AS rule, own AS detail FROM c WHERE n IS NULL OR n % 2 = 1 UNION ALL SELECT run_id, 'feedback_score', (n / 100.0)::DOUBLE::VARCHAR FROM c WHERE n IS NULL OR n > 1000 UNION ALL SELECT run_id, 'evaluation_score', 'a/b' FROM c WHERE n IS NULL OR n > 1000""")
def artifact_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrity rules over run records built of conversations: odd lengths break a digest, long ones a score."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"), F.sha2("text", 256).alias("h"))
    calls = F.array(F.struct(F.lit("c").alias("call_id"), F.lit(0.5).cast("double").alias("latency_seconds"), F.lit(1).alias("prompt_tokens"), F.lit(1).alias("completion_tokens")))
    own = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    attempt = F.struct(F.col("turn").alias("k"), own.alias("attempt_id"), F.when(F.col("turn") > 0, F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))).alias("parent_id"), F.col("turn").cast("int").alias("position"), F.lit("pass").alias("status"), F.when(F.col("turn") == 0, "initial").otherwise("revision").alias("mode"), F.when(F.col("n") % 2 == 0, F.col("h")).alias("svg_sha256"), F.array(F.lit("e0001")).alias("target_ids"), calls.alias("model_calls"))
    evals = F.array(F.struct(F.lit("a").alias("category"), F.lit("b").alias("type"), F.lit(True).alias("applicable"), (F.col("n") / 100.0).cast("double").alias("score")))
    feedback = F.struct(F.col("turn").alias("k"), own.alias("attempt_id"), (F.col("n") / 100.0).cast("double").alias("score"), F.lit("pass").alias("status"), F.array(F.lit(True)).alias("flags"), evals.alias("evaluations"), F.array().cast("array<struct<category: string, type: string, target_ids: array<string>>>").alias("issues"))
    runs = turns.groupBy(F.col("conv_id").cast("string").alias("run_id")).agg(F.array_sort(F.collect_list(attempt)).alias("attempts"), F.array_sort(F.collect_list(feedback)).alias("critic_feedback"))
    return integrity.violations(runs.select("run_id", F.lit(3).alias("schema_version"), F.lit(None).cast("string").alias("selected_attempt_id"), F.lit(False).alias("accepted"), F.lit(None).cast("double").alias("acceptance_score"), "attempts", "critic_feedback"))


@query("""SELECT round(sum(s) / sum(w), 6) AS token_mean, round(avg(CASE WHEN w <> 0 THEN s / w END), 6) AS sample_mean FROM (SELECT l_orderkey % 1000 AS g, sum(l_quantity * l_linenumber)::DOUBLE AS s, sum(l_linenumber)::DOUBLE AS w FROM lineitem GROUP BY 1)""")
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean loss over all tokens by weight, and over samples; the lines of a bucket of orders are a sample's tokens."""
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 1000).alias("g")).agg(F.collect_list(F.struct("l_quantity", "l_linenumber")).alias("t"))
    means = measures.weighted_means(rows.select(F.col("t.l_quantity").alias("losses"), F.col("t.l_linenumber").alias("weights")), "losses", "weights")
    return means.select(F.round("token_mean", 6).alias("token_mean"), F.round("sample_mean", 6).alias("sample_mean"))


@query("""SELECT lang, count(*) AS n, list_sort(list(doc_id) FILTER (r <= 5))::VARCHAR AS first FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents WHERE n_chars > 3000) GROUP BY lang""")
def bounded_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All failures counted, and the first five of each group listed."""
    found = sets.first_failures(table(spark, sf_dir, "documents").where("n_chars > 3000").select("lang", "doc_id"), "lang", ["doc_id"], 5)
    ids = F.array_join(F.transform("first", lambda x: x.doc_id.cast("string")), ", ")
    return found.select("lang", "n", F.concat(F.lit("["), ids, F.lit("]")).alias("first"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A restricted path text for every part; the larger ones reach out of the box, some have a command that the codec refuses."""
    d = F.concat(F.lit("M 0 0 L "), F.col("p_size").cast("string"), F.lit(" 10 C 1 2 3 4 5 6 "), F.when(F.col("p_size") % 5 == 0, "H 3 ").otherwise("A 5 5 30 0 1 7 8 "), F.lit("Z"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 40 40"><path d="'), d, F.lit('" fill="#f80"/></svg>')).alias("svg"))


@query("SELECT p_size <= 40 AND p_size % 5 <> 0 AS encoded, count(*) AS n, sum(CASE WHEN p_size <= 40 AND p_size % 5 <> 0 THEN 20 ELSE 0 END)::BIGINT AS tokens, count(*) FILTER (p_size <= 40 AND p_size % 5 <> 0) AS decoded FROM part GROUP BY 1")
def path_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path texts encoded and decoded; on the box of the grid's own points they encode to the same tokens again."""
    df = _paths(spark, sf_dir).withColumn("t", pathcodec.encode("svg")).withColumn("back", F.replace(pathcodec.decode("t.tokens"), F.lit("0 0 200 200"), F.lit("0 0 199 199"))).withColumn("again", pathcodec.encode("back"))
    return df.groupBy(F.col("t.tokens").isNotNull().alias("encoded")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size("t.tokens"), F.lit(0))).alias("tokens"), F.count_if(F.col("again.tokens") == F.col("t.tokens")).alias("decoded"))


@query("""SELECT failure, count(*) AS n, coalesce(sum(c), 0)::BIGINT AS codec_tokens FROM (SELECT CASE WHEN l_quantity = 1 THEN 'empty_codec_target' WHEN l_linenumber = 5 THEN 'cached_framed_count_mismatch' WHEN l_returnflag = 'R' THEN 'labeled_target_count_mismatch' WHEN l_linenumber = 4 THEN 'labeled_target_id_mismatch' END AS failure, 2 AS k, CASE WHEN l_quantity = 1 OR l_linenumber IN (4, 5) OR l_returnflag = 'R' THEN NULL ELSE 2 END AS c FROM lineitem) GROUP BY failure""")
def token_record_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit codes of records made of line items."""
    ids = F.when(F.col("l_quantity") == 1, F.array().cast("array<int>")).otherwise(F.array(F.lit(10), F.lit(11)))
    labels = F.when(F.col("l_returnflag") == "R", F.array(F.lit(-100), F.lit(-100), F.lit(11))).when(F.col("l_linenumber") == 4, F.array(F.lit(-100), F.lit(11), F.lit(10))).otherwise(F.array(F.lit(-100), F.lit(10), F.lit(11)))
    df = table(spark, sf_dir, "lineitem").select(F.array(F.lit("a"), F.lit("b")).alias("tokens"), F.lit("ab").alias("target"), F.when(F.col("l_linenumber") == 5, 3).otherwise(2).alias("framed_count"), ids.alias("target_ids"), F.array(F.lit(1), F.lit(10), F.lit(11)).alias("input_ids"), labels.alias("labels"))
    return audits.record_audit(df, 10, 20).groupBy("failure").agg(F.count("*").alias("n"), F.coalesce(F.sum("codec_tokens"), F.lit(0)).alias("codec_tokens"))


@query("SELECT coalesce(lang, 'all') AS lang, count(n_chars) AS n, min(n_chars) AS min_value, max(n_chars) AS max_value, sum(n_chars)::BIGINT AS sum_value, round(avg(n_chars), 6) AS mean_value, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.95) AS p95, quantile_disc(n_chars, 0.99) AS p99, count(*) FILTER (n_chars > 2048) AS over_2048 FROM documents GROUP BY ROLLUP (lang)")
def length_summary_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length summaries by split and of all, in one rollup."""
    return audits.by_split_and_all(table(spark, sf_dir, "documents"), "lang", "n_chars", (2048,))


@query("""SELECT CASE WHEN turn > 0 AND role = 'user' THEN 'evaluation_pairs,none_applicable' WHEN role = 'assistant' THEN 'not_json' ELSE 'keys' END AS faults, count(*) AS n FROM conversations GROUP BY 1""")
def critic_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of critic answers made of conversation turns."""
    answer = F.when((F.col("turn") > 0) & (F.col("role") == "user"), '{"evaluations": [], "issues": []}').when(F.col("role") == "assistant", "no answer").otherwise('{"issues": []}')
    df = table(spark, sf_dir, "conversations").select(answer.alias("a"), F.array(F.lit("e0001")).alias("t"))
    return df.select(F.array_join(critic.contract_faults("a", "t"), ",").alias("faults")).groupBy("faults").agg(F.count("*").alias("n"))
