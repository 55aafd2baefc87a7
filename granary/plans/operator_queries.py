"""Registered queries of fields, text, joins, audits, records, sources and sinks, each beside its DuckDB SQL.

Those of sources and sinks write to sinks.scratch() and read what they wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import codecs, codes, critic, fields, markup, pathcodec, records, text
from granary.operators import artifacts, audits, cascade, integrity, joins, measures, ordered, retrieval, sets
from granary.plans.prepare import judged
from granary.plans.queries import QUERIES, SQL, _drawings, _sequences, query, table
from granary.sources import readers, sinks, tokens
from granary.sources.manifests import PrepareConfig

__all__ = ["QUERIES", "SQL"]

# Text


@query(r"SELECT doc_id, sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))) AS caption_sha256 FROM documents WHERE text IS NOT NULL")
def caption_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.caption_hash("text").alias("caption_sha256"))


@query(r"""SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS folded, substr(text, 1, 100) AS head, length(text) > 100 AS truncated, 'sha256:' || sha256(text) AS identity FROM documents WHERE text IS NOT NULL""")
def folded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, head = F.col("text"), text.bounded_prefix(F.col("text"), 100)
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.spaces_folded(t).alias("folded"), head.text.alias("head"), head.truncated.alias("truncated"), text.fallback_identity(t).alias("identity"))


@query(r"""WITH d AS (SELECT p_partkey, 'M ' || p_size || ' 2 L 3 4 c1 2 3 4 5 6 Zq' AS d, 'x' || p_name || '<svg a="' || p_size || '"><path/><path/><g></g></svg> rest <svg/>' AS m FROM part)
    SELECT p_partkey, 3 AS commands, 2 AS paths, 4 AS tags, regexp_extract(m, '<svg a.*?</svg>') AS markup, '<svg xmlns="http://www.w3.org/2000/svg" width="9" height="8" viewBox="0 0 9 8">' || p_name || '</svg>' AS wrapped FROM d JOIN part USING (p_partkey)""")
def markup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path commands (a letter beside a letter is none), substrings, tags, the first markup of a text, and a root around a fragment."""
    size = F.col("p_size").cast("string")
    d = F.concat(F.lit("M "), size, F.lit(" 2 L 3 4 c1 2 3 4 5 6 Zq"))
    m = F.concat(F.lit("x"), F.col("p_name"), F.lit('<svg a="'), size, F.lit('"><path/><path/><g></g></svg> rest <svg/>'))
    first = text.first_markup(m)
    return table(spark, sf_dir, "part").select("p_partkey", text.path_command_count(d).alias("commands"), text.count_of(m, "<path").alias("paths"), text.tag_count(first).alias("tags"), first.alias("markup"), text.wrapped(F.col("p_name"), 9, 8).alias("wrapped"))


@query(r"""WITH u AS (SELECT page_id, regexp_extract(url, '([^/]*)/*$', 1) AS n, url FROM pages)
    SELECT page_id, regexp_replace(n, '(.)\.[^.]+$', '\1') AS stem, substr(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9_.\-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS safe FROM u""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.file_stem(F.col("url")).alias("stem"), text.safe_name(F.col("url")).alias("safe"))


@query("""WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(source || '/' || doc_id)) AS s FROM documents)
    SELECT doc_id, substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || substr('89ab', (('0x' || substr(s, 17, 1))::INTEGER & 3) + 1, 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12) AS id, substr(s, 1, 40) = lower(substr(s, 1, 40)) AS is_commit FROM h""")
def name_uuids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version-5 UUIDs of names, and the check of commit ids."""
    name = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", text.uuid_of(name).alias("id"), text.is_commit(F.sha1(name.cast("binary"))).alias("is_commit"))


@query("""SELECT event_id, CASE WHEN event_id % 4 < 3 THEN (props::JSON ->> '$.k')::BIGINT ELSE -1 END AS k, sha256('{"a":' || event_id || ',"b":[1,"é"]}') AS canonical FROM events""")
def json_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects out of answers: bare, fenced, with text around; else null. And the hash of canonical JSON."""
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    around, kind = F.concat(F.lit("Here: "), F.col("props"), F.lit(" done")), F.col("event_id") % 4
    found = F.when(kind == 0, text.json_object(F.col("props"))).when(kind == 1, text.json_object(fenced)).when(kind == 2, text.json_slice(around)).otherwise(text.json_object(around))
    odd = F.concat(F.lit('{ "b" : [1, "\\u00e9"], "a": '), F.col("event_id").cast("string"), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_variant_get(found, "$.k", "bigint"), F.lit(-1)).alias("k"), text.canonical_json_hash(odd).alias("canonical"))


@query("""SELECT lang, count(*) AS n, count(*) AS same, 0::BIGINT AS longer FROM documents WHERE text IS NOT NULL GROUP BY lang""")
def compressed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts compressed where that is shorter, and back."""
    df = table(spark, sf_dir, "documents").where("text is not null").withColumn("z", text.compressed("text"))
    back = text.decompressed("z.codec", "z.data")
    return df.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(back == F.col("text")).alias("same"), F.count_if(F.octet_length("z.data") > F.octet_length("text")).alias("longer"))


@query("""SELECT count(*) AS n, count(*) AS packed_back, count(*) AS named_back, count(*) AS upstream_back FROM lineitem""")
def packed_ids_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids packed and unpacked; to names and back; to a registered vocabulary and back upstream."""
    df = _sequences(spark, sf_dir).withColumn("back", text.unpacked_ids(text.packed_ids("ids")))
    held = codes.BOOK.shifted(1000)
    names = F.transform("ids", lambda i: codes.unnamed(codes.named(i)))
    up = F.transform("ids", lambda i: codes.upstream(i + 1000, held))
    same = lambda a: F.count_if(a == F.col("ids"))
    return df.agg(F.count("*").alias("n"), same(F.col("back")).alias("packed_back"), same(names).alias("named_back"), same(up).alias("upstream_back"))


@query("""SELECT r_regionkey, '--- a' || chr(10) || '+++ b' || chr(10) || '@@ -1 +1 @@' || chr(10) || '-' || r_name || chr(10) || '+' || lower(r_name) || chr(10) AS diff, '[{"category":"' || r_name || '","change":"' || lower(r_name) || '"}]' AS changes FROM region""")
def revision_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = lambda c: F.concat(c, F.lit("\n"))
    df = table(spark, sf_dir, "region").withColumn("low", F.lower("r_name"))
    return df.select("r_regionkey", text.unified_diff(line(F.col("r_name")), line(F.col("low"))).alias("diff"), text.required_changes(F.array("r_name"), F.array("low")).alias("changes"))


@query("""SELECT r_regionkey, r_name || ' x' AS listed, r_name AS plain, trim(r_name) AS only_one FROM region""")
def listed_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details that were stored as the text of a list, and the only instruction of a list."""
    df = table(spark, sf_dir, "region").withColumn("t", F.concat(F.lit("['"), F.col("r_name"), F.lit("', 'x', ' ']"))).withColumn("p", F.col("r_name"))
    return df.select("r_regionkey", text.listed_detail("t").alias("listed"), text.listed_detail("p").alias("plain"), text.only_instruction(F.array(F.lit(" "), F.col("r_name"))).alias("only_one"))


# Fields


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_brand || ' ' || p_type END AS chosen, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'm' END AS value, CASE WHEN p_size % 5 = 0 THEN p_name WHEN p_size % 5 = 1 THEN NULL ELSE 'ds::' || p_partkey END AS id,
    CASE WHEN p_size % 2 = 0 AND p_size % 4 <> 0 THEN p_type ELSE p_name END AS instruction, CASE WHEN p_size % 4 <> 0 THEN p_type ELSE p_name END AS by_detail, p_brand AS target FROM part""")
def chosen_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First texts of candidate columns, an array among them; first values of row and metadata; qualified ids; instruction and target by mode."""
    size = F.col("p_size")
    df = table(spark, sf_dir, "part").withColumn("caption", F.when(size % 3 == 0, F.col("p_name")).otherwise("  ")).withColumn("parts", F.array(F.col("p_brand"), F.lit(" "), F.col("p_type")))
    detail, policy = F.when(size % 4 != 0, F.col("p_type")).otherwise(" "), F.when(size % 2 == 0, "detail").otherwise("description")
    own = F.when(size % 5 == 0, F.col("p_name"))
    return df.select(
        "p_partkey", fields.first_text(df, ["title", "caption", "parts"]).alias("chosen"), fields.first_value([F.when(size % 2 == 0, F.col("p_brand")), F.lit(" ")], [F.lit("m")]).alias("value"),
        fields.qualified_id(own, F.when(size % 5 != 1, F.lit("ds")), F.col("p_partkey").cast("string")).alias("id"), fields.choose_instruction(F.col("p_name"), detail, "mixed", policy).alias("instruction"),
        fields.choose_instruction(F.col("p_name"), detail, "detail").alias("by_detail"), fields.choose_target(F.col("p_brand"), F.lit(None).cast("string"), False).alias("target"),
    )


@query("""SELECT c_custkey, 'seg=' || c_mktsegment AS kept, 'odd,secret' AS unknown, '{"a":' || c_nationkey || '}' AS flat, c_nationkey::BIGINT AS restored, 'AB|' || c_nationkey AS labels, 'ds@main/f#' || c_custkey AS uri FROM customer""")
def kept_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitelisted metadata and what it drops; nested columns as JSON and back; tags; source addresses."""
    df = table(spark, sf_dir, "customer").withColumn("m", F.create_map(F.lit("seg"), F.col("c_mktsegment"), F.lit("secret"), F.lit("s"), F.lit("odd"), F.lit("o"))).withColumn("s", F.struct(F.col("c_nationkey").alias("a")))
    kept, others = fields.keep_metadata(F.col("m"), ["seg", "more"])
    flat = fields.flat_metadata(df.select("c_custkey", "s", kept.alias("kept"), others.alias("others"), "c_nationkey"), ["c_custkey", "s", "kept", "others", "c_nationkey"])
    labels = fields.tags(F.concat(F.lit(" AB | |"), F.col("c_nationkey").cast("string")))
    return flat.select(
        "c_custkey", F.concat(F.lit("seg="), F.get_json_object("kept", "$.seg")).alias("kept"), F.array_join(F.from_json("others", "array<string>"), ",").alias("unknown"), F.col("s").alias("flat"),
        F.try_variant_get(fields.restored(F.col("s")), "$.a", "bigint").alias("restored"), F.array_join(labels, "|").alias("labels"), fields.source_uri(F.lit("ds"), F.lit(None).cast("string"), F.lit("f"), F.col("c_custkey")).alias("uri"),
    )


@query("""SELECT conv_id, turn, 'References:' || chr(10) || 'Example 1:' || chr(10) || role || chr(10) || chr(10) || 'Example 2:' || chr(10) || 'x' || chr(10) || chr(10) || 'Request: ' || text AS with_context, 'Request: ' || text || chr(10) || 'Previous:' || chr(10) || role || chr(10) || 'Change:' || chr(10) || '- a' || chr(10) || '- ' || role AS revision FROM conversations WHERE text IS NOT NULL""")
def prompt_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with retrieved context, and revision prompts."""
    context = fields.numbered_context(F.array(F.col("role"), F.lit("x")))
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", fields.brief_prompt(F.col("text"), context).alias("with_context"), fields.revision_prompt(F.col("text"), F.col("role"), F.array(F.lit("a"), F.col("role"))).alias("revision"))


@query("""SELECT event_id, event_id::VARCHAR AS audit_id, CASE WHEN event_id % 2 = 0 THEN 'u' || user_id ELSE event_id::VARCHAR END AS cache_id, 'p' || event_id AS prepared FROM events""")
def record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by the key orders of audits and of caches, and of prepared records."""
    e, u = F.col("event_id").cast("string"), F.concat(F.lit("u"), F.col("user_id").cast("string"))
    v = F.try_parse_json(F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(u.alias("source_index"), F.struct(e.alias("example_id")).alias("metadata")))).otherwise(F.to_json(F.struct(e.alias("sample_id"), u.alias("svg_id")))))
    p = F.try_parse_json(F.to_json(F.struct(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("p"), e)).alias("id"), F.struct(F.concat(F.lit(" p"), e).alias("record_id")).alias("metadata"))))
    df = table(spark, sf_dir, "events")
    return df.select("event_id", records.record_id(v).alias("audit_id"), records.record_id(v, records.CACHE_KEYS).alias("cache_id"), records.prepared_id(p).alias("prepared"))


@query("""SELECT o_orderkey, '{"k":' || o_orderkey || ',"day":"' || strftime(o_orderdate, '%Y-%m-%d') || '"}' AS safe, 'Name: a ' || o_orderkey || chr(10) || 'Tags: x, ' || o_orderstatus AS search_text FROM orders""")
def safe_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns as JSON without nulls; search texts of named patterns."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("k"), F.lit(None).cast("string").alias("gone"), F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    own = records.pattern_text(F.concat(F.lit("a_"), F.col("k").cast("string")), F.lit(""), F.array(F.lit("x"), F.col("o_orderstatus")), F.array().cast("array<string>"))
    return df.select("o_orderkey", records.json_safe(df, ["k", "gone", "day"]).alias("safe"), own.alias("search_text"))


@query("""WITH r AS (SELECT *, CASE WHEN p_size % 7 IN (0, 6) THEN 'defs, lineargradient, path' ELSE 'defs, lineargradient, path, g, rect, line' END AS e, CASE WHEN p_size % 2 = 0 THEN substr(p_name, 1, 8) ELSE substr('a ' || p_brand, 1, 8) END AS d FROM part WHERE p_size % 7 IN (0, 5, 6))
    SELECT 'p' || p_partkey AS record_id, 'hf://ds/train/p' || p_partkey AS source, trim(d) AS description, CASE WHEN p_size % 2 = 0 THEN 'name' END AS caption_field, 'Description: ' || trim(d) || chr(10) || 'Tags: a, ' || p_brand || chr(10) || 'SVG elements: ' || e AS search_text FROM r""")
def prepared_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as retrievable documents: unsafe markup goes, captions are cut, tags stand in for a missing caption."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    df = _drawings(spark, sf_dir).join(part, "p_partkey").select("svg", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("name"), F.concat(F.lit("a, "), F.col("p_brand")).alias("labels"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    found = records.prepared_documents(df, "ds", "train", "r1", ["code", "svg"], ["caption", "name"], ["id"], "labels", 10_000, 8)
    return found.select("record_id", "source", "description", "caption_field", "search_text")


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'hf://clicks@r2/train/' WHEN 'view' THEN 'hf://views/train/' ELSE 'hf://' || event_type || '/train/' END || event_id AS source, CASE event_type WHEN 'click' THEN 'r2' END AS revision FROM events""")
def source_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = spark.createDataFrame([(" Click", "clicks", "r2"), ("view", "views", " ")], "dataset_type string, dataset_id string, dataset_revision string")
    return records.source_identity(table(spark, sf_dir, "events").select("event_id", "event_type"), sources, "event_type", "event_id").select("event_id", "source", "revision")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN user_id + 1 WHEN 1 THEN user_id + 1 WHEN 2 THEN user_id + 1 ELSE -1 END AS total, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE round(value, 2) END AS seconds, CASE WHEN user_id < 128 THEN 'b' ELSE 'i' END AS width FROM events""")
def coerced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids out of a counter's answers; durations that may be of any kind; the narrowest integer width."""
    u, k = F.col("user_id").cast("string"), F.col("event_id") % 6
    answer = F.concat(F.lit("["), u, F.lit(", 1]"))
    answer = F.when(k == 0, answer).when(k == 1, F.concat(F.lit("["), answer, F.lit("]"))).when(k == 2, F.concat(F.lit('{"input_ids": '), answer, F.lit("}"))).when(k == 3, F.concat(F.lit("["), answer, F.lit(", [2]]"))).when(k == 4, F.lit("[-1, 2]")).otherwise(F.lit('["a"]'))
    timing = F.try_parse_json(F.concat(F.lit('{"timing": {"s": '), F.when(F.col("event_id") % 3 == 0, F.lit("true")).otherwise(F.round("value", 2).cast("string")), F.lit("}}")))
    total = F.aggregate(records.chat_ids(answer), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(total, F.lit(-1)).alias("total"), F.round(records.seconds(timing, "$.timing.s"), 2).alias("seconds"), records.integer_width(F.lit(0).cast("bigint"), F.col("user_id")).alias("width"))


@query("""SELECT event_id, concat_ws(',', CASE WHEN event_id % 5 = 0 THEN 'attempt' END, CASE WHEN value / 50 > 1 THEN 'score' END, CASE WHEN event_id % 2 = 0 THEN 'logit' END, CASE WHEN event_id % 3 = 0 THEN 'latency' END, CASE WHEN event_id % 4 = 0 THEN 'image' END) AS faults FROM events""")
def similarity_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda n: F.col("event_id") % n == 0
    found = records.similarity_faults(F.when(at(5), " ").otherwise("a"), F.col("value") / 50, F.when(at(2), F.lit(float("nan"))).otherwise(F.lit(0.5)), F.when(at(3), -F.lit(1.0)).otherwise(F.col("value")), F.when(at(4), F.lit("x")).otherwise(F.sha2("props", 256)))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(found, ",").alias("faults"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber >= 3 THEN '{"target_attempt_id":"a","score":' || l_linenumber || ',"issues":[{"fix":"' || l_returnflag || '"}],"legacy_issues":["x"],"critic_schema_version":' || l_linenumber || ',"status":"pass","evaluations":[{"score":1}]}'
    WHEN l_linenumber = 2 THEN '{"target_attempt_id":"a","score":2,"issues":[{"fix":"' || l_returnflag || '"}],"legacy_issues":["x"],"critic_schema_version":2,"status":"pass","preserve":["k"]}' ELSE '{"target_attempt_id":"a","score":' || l_linenumber || ',"issues":["x"]}' END AS record FROM lineitem""")
def feedback_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit("a").alias("target_attempt_id"), n.alias("version"), n.alias("score"), F.lit("pass").alias("status"), F.array(F.lit("x")).alias("issues"), F.array(F.struct(F.col("l_returnflag").alias("fix"))).alias("structured"), F.array(F.lit("k")).alias("preserve"), F.array(F.struct(F.lit(1).alias("score"))).alias("evaluations"))
    return df.select("l_orderkey", "l_linenumber", records.feedback_record(df).alias("record"))


# Tokens


@query("""SELECT count(*) AS n, sum(8)::BIGINT AS tokens, (2 * count(*))::BIGINT AS structure, (3 * count(*))::BIGINT AS geometry, count(*) AS style, (2 * count(*))::BIGINT AS framing, round(sum(2 * 1.0 + 3 * 2.0 + 0.5 + 2 * 1.0), 4)::DOUBLE AS weight FROM lineitem""")
def token_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles and weights of the tokens of responses."""
    df = _sequences(spark, sf_dir).select(codes.response_roles(F.col("ids")).alias("r"))
    of = lambda name: F.sum(F.size(F.filter("r", lambda x: x == name))).alias(name)
    weights = F.aggregate(codes.role_weights(F.col("r"), {"geometry": 2.0, "style": 0.5}), F.lit(0.0), lambda a, x: a + x)
    return df.agg(F.count("*").alias("n"), F.sum(F.size("r")).alias("tokens"), *map(of, ("structure", "geometry", "style", "framing")), F.round(F.sum(weights), 4).alias("weight"))


@query("""SELECT count(*) AS n, count(*) AS whole, count(*) AS cut, count(*) AS none FROM lineitem""")
def token_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken sequences recovered to their longest prefix of whole paths: all, the first path, nothing."""
    df = _sequences(spark, sf_dir)
    broken, empty = F.concat(F.slice("ids", 1, 7), F.array(F.lit(codes.BOOK.command[0]).cast("int"))), F.slice("ids", 1, 4)
    same = lambda a: F.count_if(codes.recover(a) == F.col("ids"))
    return df.agg(F.count("*").alias("n"), same(F.col("ids")).alias("whole"), same(broken).alias("cut"), F.count_if(F.size(codes.recover(empty)) == 0).alias("none"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '-100,11,12,-100' WHEN 1 THEN '-100,-100,12,-100' ELSE '-100,-100,-100,-100' END AS labels, '10,11,12,13,0,0' AS padded FROM part""")
def label_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the tokens that lie in the target's characters, and padding to the batch's length."""
    ids = F.array(*[F.lit(i) for i in (10, 11, 12, 13)])
    starts, ends = (F.array(*[F.lit(i) for i in x]) for x in ((0, 2, 4, 6), (2, 4, 6, 6)))
    labels = codes.masked_labels(ids, starts, ends, F.when(F.col("p_size") % 3 == 0, 2).when(F.col("p_size") % 3 == 1, 3).otherwise(5), F.lit(6))
    text_of = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return table(spark, sf_dir, "part").select("p_partkey", text_of(labels).alias("labels"), text_of(codes.padded(ids, F.lit(6), 0)).alias("padded"))


@query("""SELECT p_partkey, CASE p_size % 7 WHEN 4 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 5 THEN 3 ELSE 2 END AS variants, CASE WHEN p_size % 7 IN (0, 5, 6) THEN true END AS unlabelled FROM part""")
def markup_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative variants of a markup by its children; labels put on and taken off again leave none. Unsafe texts have neither."""
    bare = markup.without_labels(markup.labelled("svg"))
    return _drawings(spark, sf_dir).select("p_partkey", F.size(markup.element_prefixes("svg")).alias("variants"), (~bare.contains("data-agent-id")).alias("unlabelled"))


@query("""SELECT p_size % 7 AS kind, count(*) AS n, count(*) FILTER (p_size % 7 <> 4) AS canonical, count(DISTINCT p_size) FILTER (p_size % 7 <> 4) AS forms, sum(CASE p_size % 7 WHEN 4 THEN 0 WHEN 5 THEN 7 WHEN 0 THEN 4 WHEN 6 THEN 4 ELSE 5 END)::BIGINT AS nodes FROM part GROUP BY 1""")
def markup_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical forms and their nodes; two spellings of one markup have one form."""
    df = _drawings(spark, sf_dir).withColumn("c", markup.canonicalize(F.when(F.col("p_partkey") % 2 == 0, F.col("svg")).otherwise(F.replace("svg", F.lit(' d="M0'), F.lit('  d = "M0')))))
    return df.groupBy((F.col("p_size") % 7).alias("kind")).agg(F.count("*").alias("n"), F.count("c.canonical").alias("canonical"), F.countDistinct("c.canonical").alias("forms"), F.coalesce(F.sum("c.nodes"), F.lit(0)).alias("nodes"))


@query("""SELECT p_partkey, CASE WHEN p_size % 7 IN (0, 6) THEN 3 ELSE 6 END AS names FROM part WHERE p_size % 7 IN (0, 5, 6) AND p_size > 10""")
def safe_fragment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus rows with a caption and safe markup."""
    df = _drawings(spark, sf_dir).withColumn("caption", F.when(F.col("p_size") > 10, "c").otherwise(" "))
    return readers.safe_fragments(df, "svg", "caption").select("p_partkey", F.size("element_names").alias("names"))


@query("""SELECT p_size <= 40 AND p_size % 5 <> 0 AS encoded, count(*) AS n FROM part GROUP BY 1""")
def codec_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path codec by its name in the registry."""
    d = F.concat(F.lit("M 0 0 L "), F.col("p_size").cast("string"), F.lit(" 10 C 1 2 3 4 5 6 "), F.when(F.col("p_size") % 5 == 0, "H 3 ").otherwise("A 5 5 30 0 1 7 8 "), F.lit("Z"))
    df = table(spark, sf_dir, "part").select(F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 40 40"><path d="'), d, F.lit('" fill="#f80"/></svg>')).alias("svg"))
    own = codecs.get("path")
    return df.select(own.encode("svg").alias("t")).groupBy(F.col("t.tokens").isNotNull().alias("encoded")).agg(F.count("*").alias("n"))


# The whole cascade


_PARTS = ("missing_detail", "description_length", "svg_char_length", "not_in_sample_allowlist", "missing_required_field", "benchmark_exclusion", "svg_validation", "svg_canonicalization", "duplicate_svg", "render", "svg_tokenization", "svg_token_length", "full_chat_token_length")


@query(f"""WITH r AS (SELECT *, p_size % 7 AS k, length(p_name) AS words FROM part),
    e AS (SELECT *, CASE WHEN p_partkey % 11 = 0 THEN 'not_in_sample_allowlist' WHEN p_partkey % 13 = 1 THEN 'missing_required_field' WHEN p_partkey % 13 = 2 THEN 'missing_detail' WHEN p_partkey % 13 = 3 THEN 'description_length' WHEN p_partkey % 13 IN (4, 5, 6) THEN 'benchmark_exclusion' WHEN p_partkey % 13 = 7 THEN 'svg_char_length'
        WHEN k IN (1, 2, 3, 4) THEN 'svg_validation' END AS early, CASE WHEN p_partkey % 17 = 0 THEN 'render' WHEN p_partkey % 17 = 1 THEN 'svg_tokenization' WHEN p_partkey % 17 = 2 THEN 'svg_token_length' WHEN p_partkey % 17 = 3 THEN 'full_chat_token_length' END AS late FROM r),
    f AS (SELECT *, min(p_partkey) FILTER (early IS NULL AND late IS NULL) OVER (PARTITION BY p_brand, p_size, p_partkey // 500) AS first FROM e),
    j AS (SELECT p_brand AS domain, coalesce(early, CASE WHEN p_partkey > first THEN 'duplicate_svg' END, late, 'accepted') AS reason FROM f)
    SELECT domain, reason, count(*) AS n FROM j GROUP BY ALL""")
def prep_full_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reason of the cascade, in its order: allowlist, fields, exclusion by id, caption and detail, markup, duplicates, and the counters given as parameters."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    at = lambda n: F.col("p_partkey") % 13 == n
    key = F.col("p_partkey").cast("string")
    mark = F.concat(F.lit(' id="'), F.floor(F.col("p_partkey") / 500).cast("string"), F.lit("b"), F.regexp_replace("p_brand", "#", ""), F.lit('"'))
    svg = F.replace("svg", F.lit("<path"), F.concat(F.lit("<path"), mark))
    rows = _drawings(spark, sf_dir).join(part, "p_partkey").select(
        F.col("p_brand").alias("domain"), key.alias("record_id"), F.when(at(1), " ").when(at(3), F.lit("one")).otherwise(F.concat(F.lit("a drawing of "), F.when(at(5), F.lit("Bad  Words")).otherwise(key))).alias("description"),
        F.when(at(2), F.lit(None).cast("string")).when(at(6), F.lit("Leaked Detail")).otherwise("some detail").alias("detail"), F.when(at(7), F.lit("x")).otherwise(svg).alias("svg"), F.lit("f").alias("source_file"), F.col("p_partkey").alias("source_row"),
    )
    allow = rows.where(F.col("source_row") % 11 != 0).select("domain", "record_id")
    hashes = spark.createDataFrame([("a drawing of bad words",), ("leaked detail",)], "t string").select(F.lit("caption").alias("kind"), F.sha2("t", 256).alias("value"))
    exclusions = rows.where(F.col("source_row") % 13 == 4).select(F.lit("id").alias("kind"), F.col("record_id").alias("value")).unionByName(hashes)
    m = F.col("source_row") % 17
    config = PrepareConfig(min_words=2, min_chars=20, require_detail=True, max_tokens=100, max_chat_tokens=100)
    found = judged(rows, config, allow, exclusions, renders=lambda c: m != 0, tokens=lambda c: F.when(m == 1, F.lit(None).cast("int")).when(m == 2, 101).otherwise(1), chat_tokens=lambda d, c: F.when(m == 3, 101).otherwise(1))
    return cascade.reason_counts(found, "domain", _PARTS).where("n > 0")


# Joins, audits, evaluation


@query("""WITH h AS (SELECT event_id, user_id, CASE WHEN event_id % 10 = 0 THEN -1 ELSE user_id END AS row_index FROM events), u AS (SELECT user_id, min(event_id) AS e FROM events GROUP BY 1)
    SELECT CASE WHEN h.row_index = -1 THEN 'no_row' WHEN h.event_id % 7 = 0 THEN 'other_id' WHEN h.event_id % 5 = 0 THEN 'other_document' END AS fault, count(*) AS n FROM h GROUP BY 1""")
def hydrated_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and the rows that they point to, with why one isn't usable."""
    e, u = F.col("event_id"), F.concat(F.lit("u"), F.col("user_id").cast("string"))
    hits = table(spark, sf_dir, "events").select("event_id", F.lit("s").alias("shard"), F.when(e % 10 == 0, F.lit(-1).cast("bigint")).otherwise(F.col("user_id")).alias("row_index"), F.when(e % 7 == 0, F.lit("x")).otherwise(u).alias("record_id"), F.when(e % 5 == 0, F.lit("y")).otherwise(u).alias("document"))
    payload = table(spark, sf_dir, "events").select("user_id").distinct().select(F.lit("s").alias("f"), F.col("user_id").alias("r"), u.alias("record_id"), u.alias("document"), F.lit("c").alias("content"))
    return joins.hydrated(hits, payload, "f", "r").groupBy("fault").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (7, 3, 11)")
def requested_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.requested(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", ["7", "3", "11"])


@query("""SELECT n_nationkey, n_name FROM (VALUES (0, 3), (1, 0), (2, 3)) AS a(asked_order, k) JOIN nation ON n_nationkey = k""")
def fetched_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows at given positions, in that order, one twice."""
    return readers.by_position(table(spark, sf_dir, "nation").select(F.col("n_nationkey"), "n_name"), "n_nationkey", [3, 0, 3])


@query("""SELECT l_orderkey % 100 AS k, 'l' AS side FROM lineitem GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT o_custkey % 100, 'o' FROM orders GROUP BY 1 HAVING count(*) > 1""")
def repeated_join_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that either side of a join repeats."""
    side = lambda name, c, mark: joins.repeated_keys(table(spark, sf_dir, name).select((F.col(c) % 100).alias("k")), "k").select("k", F.lit(mark).alias("side"))
    return side("lineitem", "l_orderkey", "l").unionByName(side("orders", "o_custkey", "o"))


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1""")
def first_of_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each id of a batch."""
    return joins.first_per_key(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS v, c_custkey % 3 = 0 AS renewed FROM customer""")
def upserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("v"), F.lit(False).alias("renewed"))
    fresh = stored.where("c_custkey % 3 = 0").select("c_custkey", (F.col("v") + 100).alias("v"), F.lit(True).alias("renewed"))
    return sinks.upserted(stored, fresh, "c_custkey")


@query("""SELECT o_orderkey, retry FROM (SELECT o_orderkey, o_orderkey % 3 AS k FROM orders), (VALUES (true), (false)) AS t(retry) WHERE k = 0 OR (retry AND k = 1)""")
def uncompleted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to do by a durable log that two calls appended to, with failures tried again and without."""
    path = sinks.scratch(spark, "log")
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    sinks.log_results(rows.where("o_orderkey % 3 = 1").select("o_orderkey", F.lit("failed").alias("status")), path)
    sinks.log_results(rows.where("o_orderkey % 3 = 2").select("o_orderkey", F.lit("done").alias("status")), path)
    log = spark.read.parquet(path)
    left = lambda retry: joins.uncompleted(rows, log, "o_orderkey", retry).withColumn("retry", F.lit(retry))
    return left(True).unionByName(left(False))


@query("""SELECT l_orderkey, min(CASE WHEN l_linenumber < 6 THEN l_quantity END) AS least, count(*) FILTER (l_linenumber < 6 AND l_quantity < 20) AS below, round(avg(l_quantity) FILTER (l_linenumber < 6), 6) AS mean,
    bool_and(l_linenumber >= 6 OR l_quantity >= 3) AS accepted, greatest(0, 10 - 3 * count(*) FILTER (l_returnflag = 'R') - count(*) FILTER (l_returnflag = 'A')) AS rule_score FROM lineitem GROUP BY l_orderkey""")
def scorecards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorecards of applicable evaluations, their acceptance, and scores by rule."""
    e = F.struct(F.lit("c").alias("category"), F.lit("t").alias("type"), (F.col("l_linenumber") < 6).alias("applicable"), F.col("l_quantity").alias("score"))
    runs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(e).alias("e"), F.count_if(F.col("l_returnflag") == "R").alias("errors"), F.count_if(F.col("l_returnflag") == "A").alias("warnings"))
    card = integrity.scorecard(F.col("e"), 20.0)
    ok = integrity.accepted(F.col("e"), F.lit("pass"), F.array(F.lit(True)), F.lit(0.0), F.lit(3), 3.0, 7.0)
    return runs.select("l_orderkey", card.least.alias("least"), card.below.cast("bigint").alias("below"), F.round(card["mean"], 6).alias("mean"), ok.alias("accepted"), integrity.rule_score(F.col("errors"), F.col("warnings")).alias("rule_score"))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem i WHERE NOT EXISTS (SELECT 1 FROM lineitem e WHERE e.l_orderkey = i.l_orderkey AND e.l_returnflag = i.l_returnflag AND e.l_linestatus = i.l_linestatus AND e.l_quantity < 10)""")
def issues_without_low_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("type"), F.col("l_quantity").alias("score"))
    return integrity.issue_faults(rows.drop("score"), rows.drop("l_linenumber"), ["l_orderkey"], 10.0).select("l_orderkey", "l_linenumber")


@query("""SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 OR source <> 'src1' OR source IS NULL""")
def isolation_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark examples that could leak into memory; documents of one source stand for the held-out split."""
    df = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3 != 0).alias("memory_eligible"), F.when(F.col("source") == "src1", "test").otherwise(F.col("source")).alias("split"))
    return integrity.isolation_faults(df).select("doc_id")


@query("""SELECT a.vec_id % 10 AS query_id, a.vec_id // 10 AS id, 1.0::DOUBLE AS score_a, 0.5::DOUBLE AS score_b FROM embeddings a WHERE a.vec_id % 6 = 0""")
def shared_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits that two indexes both give."""
    hits = lambda n, score: table(spark, sf_dir, "embeddings").where(F.col("vec_id") % n == 0).select((F.col("vec_id") % 10).alias("query_id"), F.floor(F.col("vec_id") / 10).alias("id"), F.lit(score).alias("score"))
    return retrieval.shared_items(hits(2, 1.0), hits(3, 0.5))


@query("""SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS own, greatest(-1.0, least(1.0, 1 - vec_id / 100.0))::DOUBLE AS score FROM embeddings""")
def similarity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(retrieval.cosine(v, v), 4).alias("own"), retrieval.score_of(F.col("vec_id") / 100).alias("score"))


@query("""SELECT count(*) AS n, min(n_chars) AS shortest, max(n_chars) AS longest, sum(n_chars)::BIGINT AS total, count(*) FILTER (n_chars = length(text)) AS matching, count(*) FILTER (n_chars IS DISTINCT FROM length(text)) AS differing FROM documents""")
def length_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").withColumn("declared", F.length("text"))
    return audits.length_manifest(df, "n_chars", "doc_id", "declared").drop("ids_digest")


@query("""SELECT count(*) AS n, count(*) FILTER (NOT d) AS description, count(*) FILTER (d) AS detail, count(*) FILTER (p_partkey % 2 = 0 AND p_size % 3 = 0) AS fallbacks FROM (SELECT *, p_partkey % 2 = 0 AND p_size % 3 <> 0 AS d FROM part)""")
def instruction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How instructions were chosen, and how often the chosen detail was missing."""
    df = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 2 == 0, "detail").otherwise("description").alias("policy"), F.when(F.col("p_size") % 3 != 0, F.col("p_name")).otherwise(" ").alias("detail"))
    df = df.withColumn("chosen", F.when((F.col("policy") == "detail") & (F.trim("detail") != ""), "detail").otherwise("description"))
    return audits.selection_counts(df, "chosen", "policy", "detail")


@query("""SELECT p_partkey, round((p_size + 5.0) / 510.0, 8) AS error, 7 AS constant, p_size::BIGINT AS field FROM part""")
def image_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean difference of images' bytes; prefix lengths by constant and by field."""
    a, b = F.array(F.lit(0), F.col("p_size")), F.array(F.lit(5), F.col("p_size") * 2)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(audits.mean_absolute_error(a, b), 8).alias("error"), audits.prefix_length("constant", 7).alias("constant"), audits.prefix_length("field", "p_size").alias("field"))


@query("""SELECT event_id, coalesce(CASE WHEN event_id % 5 = 0 THEN 99 END, row_number() OVER (PARTITION BY user_id ORDER BY event_id))::INTEGER AS rank FROM events""")
def given_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given ranks kept, else the place."""
    df = table(spark, sf_dir, "events").withColumn("rank", F.when(F.col("event_id") % 5 == 0, 99))
    return ordered.ranked(df, ["user_id"], "event_id").select("event_id", "rank")


@query("""SELECT event_id, event_id // 100 * 100 + row_number() OVER (PARTITION BY event_id // 100 ORDER BY sha256('42|' || event_id), event_id) - 1 AS place FROM events""")
def buffer_shuffled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows shuffled within a buffer of 100."""
    return ordered.buffer_shuffled(table(spark, sf_dir, "events").select("event_id"), "event_id", 42, 100)


@query("""SELECT source, len(v)::BIGINT AS n, v[greatest(1, floor(len(v) * 0.5 + 0.999999999999)::INTEGER)] AS p50, v[least(len(v), floor(len(v) * 0.95 + 0.999999999999)::INTEGER)] AS p95 FROM (SELECT source, list_sort(list(n_chars)) AS v FROM documents GROUP BY source)""")
def length_quantiles_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.ceiling_quantiles(table(spark, sf_dir, "documents"), ["source"], "n_chars", (0.5, 0.95))


@query("SELECT lang, median(n_chars) AS middle FROM documents GROUP BY lang")
def length_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(measures.median("n_chars").alias("middle"))


@query("""SELECT c_custkey, c_custkey % 2 = 0 AS same FROM customer""")
def same_score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two lists hold the same different items in any order."""
    df = table(spark, sf_dir, "customer").select("c_custkey", F.array("c_name", "c_mktsegment").alias("a"), F.when(F.col("c_custkey") % 2 == 0, F.array("c_mktsegment", "c_name")).otherwise(F.array("c_name", "c_name")).alias("b"))
    return df.select("c_custkey", sets.same_pairs("a", "b").alias("same"))


@query("""WITH b AS (SELECT count(DISTINCT l_partkey) AS count_before FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45), s AS (SELECT count(*) AS scanned, count(*) FILTER (p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)) AS existing FROM part),
    i AS (SELECT *, least(scanned - existing, greatest(1700 - count_before, 0)) AS indexed FROM b, s) SELECT *, count_before + indexed AS count_after FROM i""")
def indexing_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of an incremental run with a target size."""
    stored = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("k"))
    return artifacts.indexing_counts(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), stored, "k", 1700)


@query("""SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 <> 1""")
def unexcluded_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known exclusions hold only for the revisions and the split that they are bound to."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey")
    split = F.when(F.col("s_suppkey") % 4 == 1, "easy").otherwise("hard")
    listed = rows.where("s_suppkey % 4 IN (1, 2)").select("s_suppkey", F.lit("r1").alias("hf_revision"), F.lit("t1").alias("task_revision"), split.alias("source_split"))
    old = rows.where("s_suppkey % 4 = 3").select("s_suppkey", F.lit("r0").alias("hf_revision"), F.lit("t1").alias("task_revision"), F.lit("easy").alias("source_split"))
    return artifacts.unexcluded(rows, listed.unionByName(old), "s_suppkey", "r1", "t1", "easy")


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'absolute' WHEN 2 THEN 'escapes' ELSE CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE 'not_found' END END AS fault,
    CASE WHEN p_partkey % 5 > 2 THEN 'runs/' || p_partkey || '/a.svg' END AS path, CASE WHEN p_partkey % 5 > 2 AND p_partkey % 2 = 0 THEN p_size ELSE -1 END AS size FROM part""")
def artifact_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that sidecars refer to: missing, absolute, escaping and dangling references are told."""
    key = F.col("p_partkey").cast("string")
    k = F.col("p_partkey") % 5
    reference = F.when(k == 0, " ").when(k == 1, "/etc/a.svg").when(k == 2, "b/../../a.svg").when(k == 3, "./a.svg").otherwise("b/../a.svg")
    sidecars = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("runs/"), key).alias("folder"), reference.alias("reference"))
    files = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("runs/"), key, F.lit("/a.svg")).alias("path"), F.col("p_size").alias("size"))
    return artifacts.referenced(sidecars, files, "folder", "reference").select("p_partkey", "fault", "path", F.coalesce("size", F.lit(-1)).alias("size"))


@query("""SELECT conv_id::VARCHAR || '-' || turn AS sample_id, 'not_json' AS fault FROM conversations UNION ALL SELECT conv_id::VARCHAR || '-' || turn, 'instruction' FROM conversations WHERE role = 'system' UNION ALL SELECT conv_id::VARCHAR || '-' || turn, 'allowed_target_ids' FROM conversations WHERE role = 'user'""")
def critic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rows that can't be trained on."""
    own = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    df = table(spark, sf_dir, "conversations").select(own.alias("sample_id"), F.when(F.col("role") != "system", "draw").alias("instruction"), F.lit("<svg/>").alias("labeled_svg"), F.when(F.col("role") != "user", F.array(F.lit("e0001"))).alias("allowed_target_ids"), F.lit("x").alias("critic_output"))
    return critic.label_faults(df)


# Sources and sinks


@query("""SELECT item_id, count(*) AS n, 2 AS files FROM (SELECT item_id FROM benchmark UNION ALL SELECT item_id FROM benchmark) GROUP BY 1""")
def mixed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parquet and JSON lines in one scan with row pointers."""
    path = sinks.scratch(spark, "mixed")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    sinks.write_json_lines(items.coalesce(1), f"{path}/part.jsonl")
    items.coalesce(1).write.parquet(f"{path}/rest")
    rows = readers.corpus(spark, [f"{path}/rest", *readers.expand(spark, [f"{path}/part.jsonl"])], items.schema)
    return rows.groupBy("item_id").agg(F.count("*").alias("n"), F.countDistinct("source_file").cast("int").alias("files"))


@query("SELECT p_partkey AS record_id, p_name AS document_text FROM part")
def projected_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns with row pointers, after a check of ids."""
    rows = readers.projected(spark, [f"{sf_dir}/part.parquet"], "p_partkey", "p_name")
    return readers.unique_ids(rows, "record_id").select("record_id", "document_text")


@query("""SELECT DISTINCT kind, value FROM (SELECT 'id' AS kind, 'u' || user_id AS value FROM events UNION ALL SELECT 'caption', sha256(event_type) FROM events UNION ALL SELECT 'svg', 'ab' || event_type FROM events UNION ALL SELECT 'id', 'l' || user_id FROM events)""")
def exclusion_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and hashes of exclusion records under their many names."""
    user = F.col("user_id").cast("string")
    df = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), user).alias("item_id"), F.upper(F.sha2("event_type", 256)).alias("caption_hash"), F.array(F.concat(F.lit("AB"), F.col("event_type"))).alias("svg_hashes"), F.array(F.concat(F.lit("l"), user)).alias("ids"))
    return readers.exclusions(df)


@query("""SELECT 'd:' || c_custkey AS key, c_name || ',' || c_mktsegment AS retrieved FROM customer""")
def neighbour_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieved neighbours by qualified key; records that agree are one."""
    df = table(spark, sf_dir, "customer").select(F.lit("d").alias("domain"), F.col("c_custkey").alias("id"), F.array("c_name", "c_mktsegment").alias("top3"))
    return readers.neighbours(df.unionByName(df)).select("key", F.array_join("retrieved", ",").alias("retrieved"))


@query("""SELECT 'train' AS part, count(*) AS n, sum(c_custkey)::BIGINT AS total, count(*) AS declared FROM customer WHERE c_custkey % 5 > 0 UNION ALL SELECT 'test', count(*), sum(c_custkey)::BIGINT, count(*) FROM customer WHERE c_custkey % 5 = 0""")
def published_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts published in one step with their manifest, and read back."""
    rows, path = table(spark, sf_dir, "customer").select("c_custkey", "c_name"), sinks.scratch(spark, "published")
    whole = sinks.publish({"train": rows.where("c_custkey % 5 > 0"), "test": rows.where("c_custkey % 5 = 0")}, path, {"kind": "customers"}, "c_custkey")
    back = lambda name: readers.json_lines(spark, f"{path}/{name}", rows.schema).agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.sum("c_custkey").alias("total"), F.lit(whole["parts"][name]["rows"]).cast("bigint").alias("declared"))
    return back("train").unionByName(back("test"))


@query("""SELECT n_nationkey, n_name, 1 AS builds FROM nation""")
def materialized_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is built once for its settings, and a guard against others."""
    path, builds = sinks.scratch(spark, "held"), []

    def build() -> DataFrame:
        builds.append(1)
        return table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    for _ in range(2):
        df = sinks.materialized(spark, path, {"a": 1}, build)
        sinks.guard_identity(spark, f"{path}/run", {"a": 1})
    return df.withColumn("builds", F.lit(len(builds)))


@query("""SELECT item_id, text FROM benchmark""")
def checked_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of which count and digest are as its manifest says."""
    path, items = sinks.scratch(spark, "snapshot"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    sinks.write_json_lines(items.coalesce(1), path)
    file = readers.expand(spark, [f"{path}/part-*"])[0]
    return readers.checked_snapshot(spark, file, items.schema, items.count(), readers.digests(spark, file).first()["sha256"])


@query("""SELECT 'd' AS domain, count(*) AS n, min(md5(c_custkey::VARCHAR)) AS least FROM customer""")
def id_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted ids written as text with a digest, and read as an allowlist with its checks."""
    path, ids = sinks.scratch(spark, "ids"), table(spark, sf_dir, "customer").select(F.md5(F.col("c_custkey").cast("string").cast("binary")).alias("id"))
    held = sinks.write_ids(ids, "id", path)
    return readers.allowlist(spark, {"d": path}, held["count"]).groupBy("domain").agg(F.count("*").alias("n"), F.min("record_id").alias("least"))


@query("""SELECT n_nationkey AS step, n_nationkey / 10.0::DOUBLE AS loss, CASE WHEN n_nationkey % 2 = 0 THEN 'train' ELSE 'validation' END AS split FROM nation""")
def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trainer's log read and written as a curve."""
    path = sinks.scratch(spark, "curve")
    entries = [{"step": r[0], "loss": r[0] / 10} if r[0] % 2 == 0 else {"step": r[0], "eval_loss": r[0] / 10} for r in table(spark, sf_dir, "nation").select("n_nationkey").collect()]
    sinks.put_json(spark, f"{path}/state.json", {"log_history": entries})
    log = readers.trainer_log(spark, f"{path}/state.json")
    train = log.where("loss is not null").select("step", "loss", F.lit("train").alias("split"))
    sinks.write_curve(train, log.where("eval_loss is not null").select("step", F.col("eval_loss").alias("loss"), F.lit("validation").alias("split")), f"{path}/curve")
    return spark.read.option("header", True).schema("step int, loss double, split string").csv(f"{path}/curve")


@query("""SELECT n_name AS name, lower(n_name) AS text, count(*) OVER () AS files FROM nation""")
def prediction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions, each in a folder of its own, read back by name."""
    path = sinks.scratch(spark, "predictions")
    sinks.write_predictions(table(spark, sf_dir, "nation").select("n_name", F.lower("n_name").alias("t")), "n_name", "t", path)
    back = spark.read.option("wholetext", True).text(path).select("name", F.regexp_replace("value", r"\n$", "").alias("text"))
    return back.crossJoin(F.broadcast(back.agg(F.count("*").alias("files"))))


@query("""SELECT r_name AS run, 2 AS files, true AS whole, 1 AS refused FROM region WHERE r_regionkey < 2""")
def artifact_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Immutable bundles with sidecars: published once, refused the second time, read by their sidecars."""
    path, refused = sinks.scratch(spark, "bundles"), 0
    for name in ("run0", "run1"):
        files = {"a.svg": f"<svg id='{name}'/>", "b.txt": name}
        sinks.publish_bundle(spark, f"{path}/{name}", files, {"run": name})
        try:
            sinks.publish_bundle(spark, f"{path}/{name}", files, {"run": name})
        except FileExistsError:
            refused += 1
    sidecars = readers.artifacts(spark, f"{path}/*/", "run string, files map<string, string>")
    regions = table(spark, sf_dir, "region").where("r_regionkey < 2").select(F.concat(F.lit("run"), F.col("r_regionkey").cast("string")).alias("run"), "r_name")
    digests = readers.digests(spark, f"{path}/*/*").select(F.col("sha256").alias("d"))
    held = sidecars.select("run", F.explode("files").alias("name", "d")).join(digests.distinct(), "d", "left_semi").groupBy("run").agg(F.count("*").cast("int").alias("files"))
    return held.join(regions, "run").select(F.col("r_name").alias("run"), "files", (F.col("files") == 2).alias("whole"), F.lit(refused // 2).alias("refused"))


@query("""SELECT split, count(*) AS n, sum(p_size)::BIGINT AS total FROM (SELECT p_size, CASE WHEN p_partkey % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM part) GROUP BY split""")
def token_cache_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and their cached sequences one to one."""
    path = sinks.scratch(spark, "cache")
    split = F.when(F.col("p_partkey") % 4 == 0, "test").otherwise("train")
    rows = table(spark, sf_dir, "part").select(split.alias("split"), F.col("p_partkey").alias("source_line"), F.col("p_name").alias("sample_id"), "p_size")
    tokens.write_cache(rows.select(F.col("source_line").alias("sample_index"), "split", "source_line", "sample_id", F.array(F.lit(1), F.col("p_size"), F.lit(2)).alias("ids")), path)
    joined = tokens.join_cache(rows.drop("p_size"), tokens.read_split(spark, path, ["train", "test"]))
    return joined.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.get("ids", F.lit(1))).alias("total"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END AS caption FROM supplier""")
def captioned_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A landed split of a pinned revision with the captions of a landed task file, by file stem."""
    path, own = sinks.scratch(spark, "landed"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    own.select("s_suppkey", F.concat(F.lit("x/f"), F.col("s_suppkey").cast("string"), F.lit(".svg")).alias("file")).write.parquet(f"{path}/r1/easy")
    tasks = own.where("s_suppkey % 3 <> 0").select(F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("caption"))
    one = tasks.agg(F.to_json(F.collect_list(F.struct("id", "caption"))).alias("value"))
    one.coalesce(1).write.text(f"{path}/tasks")
    rows = artifacts.landed_split(spark, path, "r1", "easy").withColumn("id", text.file_stem(F.col("file")))
    return rows.join(artifacts.caption_tasks(spark, f"{path}/tasks", "id string, caption string"), "id", "left").select("s_suppkey", "caption")
