"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontam, langid, licenses, packing, quality, sharding, simhash, suffix, tokencounts, urlfilter

#: Most bytes of text in a shard.
SHARD_BYTES = 1 << 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_repeated, beside the contract's columns: bytes of repeats of PASSAGE bytes, which include passages of over 50 words under 400 bytes."""
    found = suffix.without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), also=suffix.PASSAGE)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"), SHARD_BYTES).withColumnRenamed("id", "doc_id")


def captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch day, which the table doesn't have: a day of 2024 by page_id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int")).alias("fetched_on"))


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated list, which the tables don't have: about a third of the hosts are blocked, allowed, blocked again and removed."""
    hosts = pages.select(urlfilter.host_of(F.col("url")).alias("domain")).where("domain is not null").distinct()
    digit = lambda at, n: F.conv(F.substring(F.md5(F.col("domain").cast("binary")), at, n), 16, 10).cast("int")
    day = lambda offset: F.date_add(F.lit("2024-01-01").cast("date"), digit(3, 2) + offset)
    events = F.explode(F.array(*[F.struct(F.lit(a).alias("action"), day(n).alias("dated")) for a, n in (("block", -60), ("allow", 0), ("block", 45), ("remove", 90))]))
    return hosts.where(digit(1, 2) % 3 == 0).select("domain", events.alias("e")).select("domain", "e.action", "e.dated")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    wide = spark.createDataFrame([("example.org", "block", "2024-10-01"), ("example.net", "block", "2023-01-01"), ("example.net", "remove", "2024-03-01")], "domain string, action string, dated string").withColumn("dated", F.col("dated").cast("date"))
    found = urlfilter.judge(captures(pages), list_entries(pages).unionByName(wide))
    return found.withColumnRenamed("id", "page_id")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p.getField("base"))
    starts = F.transform(base, lambda p: p.getField("start"))
    label = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda p: p.getField("label")))), ",")
    return found.select(F.col("id").alias("doc_id"), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), label(base).alias("base_labels"), label(F.col("places")).alias("labels"), "score")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), with_ids=False).withColumnRenamed("id", "doc_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_tokens(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (op1_simhash_neardup, op2_decontaminate, op3_quality, op4_suffix_dedup, op5_sharding, op6_url_filter, op7_licenses, op8_language_id, op9_packing, op10_token_counts)}


def _quality_sql() -> str:
    rates = {"symbol_rate": "1000 * n_symbols // greatest(word_chars, 1)", "dup_line_rate": "1000 * n_dup_lines // greatest(n_lines, 1)", "repeat_rate": "1000 * n_repeat_words // greatest(n_words, 1)", "word_length": "100 * word_chars // greatest(n_words, 1)"}
    far = lambda side, least: f"q10 - {quality.REACH} * greatest(q50 - q10, {least})" if side == "low" else f"q90 + {quality.REACH} * greatest(q90 - q50, {least})"
    low, high = (" ".join(f"WHEN '{m}' THEN {far(side, least)}" for m, (sides, least) in quality.METRICS.items() if side in sides.split()) for side in ("low", "high"))

    def level(name: str, keys: str, above: str, shared: str) -> str:
        by = f"{keys}, metric" if keys else "metric"
        own = ", ".join(f"c.{k}" for k in by.split(", "))
        same = " AND ".join(f"c.{k} IS NOT DISTINCT FROM p.{k}" for k in [*shared.split(", "), "metric", "bucket"] if k)
        share = f"(upto * {quality.SHARE} + {quality.PRIOR} * p.share) // (n + {quality.PRIOR})" if above else f"upto * {quality.SHARE} // n"
        return f"""{name} AS (SELECT {own}, c.bucket, {share} AS share FROM (
            SELECT {by}, bucket, sum(c) OVER (PARTITION BY {by})::BIGINT AS n, sum(c) OVER (PARTITION BY {by} ORDER BY bucket)::BIGINT AS upto FROM (
                SELECT {by}, bucket, sum(c) AS c FROM (SELECT {by}, bucket, n AS c FROM sketch
                    UNION ALL SELECT {", ".join(f"g.{k}" for k in by.split(", "))}, b.bucket, 0 FROM (SELECT DISTINCT {by} FROM sketch) g JOIN (SELECT DISTINCT metric, bucket FROM sketch) b ON g.metric = b.metric) GROUP BY {by}, bucket)) c
            {f"JOIN {above} p ON {same}" if above else ""})"""

    at = lambda tenths: f"min(bucket) FILTER (share >= {tenths * quality.SHARE // 10})"
    checks = " AND ".join(f"NOT EXISTS (SELECT 1 FROM fence f WHERE f.lang IS NOT DISTINCT FROM r.lang AND f.source IS NOT DISTINCT FROM r.source AND f.metric = '{m}' AND (r.{m} < f.low OR r.{m} > f.high))" for m in rates)
    return rf"""
    WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
    rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
    cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
    lined AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
    m AS (SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
        FROM w JOIN lined USING (doc_id) LEFT JOIN cov USING (doc_id)),
    r AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, {", ".join(f"{x} AS {m}" for m, x in rates.items())} FROM m),
    cells AS ({" UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {m} AS v FROM r WHERE NOT base_failed" for m in rates)}),
    sketch AS (SELECT lang, source, metric, (v >> s) << s AS bucket, count(*) AS n FROM (SELECT *, greatest(length(bin(v)) - {quality.BITS}, 0)::BIGINT AS s FROM cells) GROUP BY ALL),
    {level("of_all", "", "", "")}, {level("by_lang", "lang", "of_all", "")}, {level("own", "lang, source", "by_lang", "lang")},
    fence AS (SELECT lang, source, metric, CASE metric {low} END AS low, CASE metric {high} END AS high FROM (SELECT lang, source, metric, {at(1)} AS q10, {at(5)} AS q50, {at(9)} AS q90 FROM own GROUP BY ALL))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {checks}) AS kept FROM r
    """


def _licenses_sql() -> str:
    rows, texts = [], []
    for n, t in enumerate(licenses.TEMPLATES):
        rows.append(f"({n}, '{t.label}', {str(t.base).lower()}, {len(t.key)}, {t.at}, {len(t.words)})")
        texts += [f"({n}, {i}, '{w}', {str(t.at <= i < t.at + len(t.key)).lower()})" for i, w in enumerate(t.words)]
    return rf"""
    WITH templates(t, label, base, key, lead, size) AS (VALUES {", ".join(rows)}),
    wording(t, p, w, is_key) AS (VALUES {", ".join(texts)}),
    d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
    hit AS (SELECT doc_id, t, i - p AS start, count(*) AS n, count(*) FILTER (is_key) AS k FROM words JOIN wording USING (w) GROUP BY ALL),
    place AS (SELECT doc_id, start + lead AS start, label, base, n / size AS score FROM hit JOIN templates USING (t) WHERE k = key),
    found AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM place GROUP BY doc_id)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
        coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN found USING (doc_id)
    """


_SHARDING_SQL = f"""
    WITH r AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
    s AS (SELECT d, h >> (60 - d) AS q, sum(n_bytes)::BIGINT AS size, count(*) AS c FROM r, range(61) AS x(d) GROUP BY ALL),
    leaf AS (SELECT doc_id, n_bytes, h, min(d) AS depth FROM r JOIN s ON q = h >> (60 - d) WHERE size <= {SHARD_BYTES} OR c = 1 GROUP BY ALL)
    SELECT doc_id, n_bytes, depth::INTEGER AS depth, q::BIGINT AS prefix, 0::INTEGER AS page, size AS shard_bytes FROM leaf JOIN s ON d = depth AND q = h >> (60 - depth)
    """

_URL_SQL = r"""
    WITH c AS (SELECT page_id, nullif(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^/?#@\]]*\]|[^/?#:@\[\]]+)', 1), '\.+$', ''), '') AS host, (DATE '2024-01-01' + (page_id * 37 % 366)::INTEGER)::DATE AS fetched_on FROM pages),
    h AS (SELECT DISTINCT host AS domain, md5(host) AS m FROM c WHERE host IS NOT NULL),
    entry AS (SELECT domain, action, (DATE '2024-01-01' + (('0x' || substr(m, 3, 2))::INTEGER + shift)::INTEGER)::DATE AS dated FROM h, (VALUES ('block', -60), ('allow', 0), ('block', 45), ('remove', 90)) AS e(action, shift) WHERE ('0x' || substr(m, 1, 2))::INTEGER % 3 = 0
        UNION ALL VALUES ('example.org', 'block', DATE '2024-10-01'), ('example.net', 'block', DATE '2023-01-01'), ('example.net', 'remove', DATE '2024-03-01')),
    held AS (SELECT domain, action, dated AS valid_from, lead(dated) OVER (PARTITION BY domain ORDER BY dated) AS valid_to FROM entry),
    best AS (SELECT page_id, arg_max(struct_pack(a := action, d := domain, f := valid_from, t := valid_to), length(domain)) AS e FROM c JOIN held ON (host = domain OR ends_with(host, '.' || domain) AND NOT regexp_matches(host, '^(\[.*\]|[0-9]{1,3}(\.[0-9]{1,3}){3})$')) AND fetched_on >= valid_from AND (valid_to IS NULL OR fetched_on < valid_to) WHERE action <> 'remove' GROUP BY page_id)
    SELECT page_id, host, fetched_on, CASE WHEN host IS NULL THEN 'unknown' ELSE coalesce(e.a, 'none') END AS verdict, e.d AS domain, e.f AS valid_from, e.t AS valid_to FROM c LEFT JOIN best USING (page_id)
    """

ORACLE_SQL = {"op3_quality": _quality_sql(), "op5_sharding": _SHARDING_SQL, "op6_url_filter": _URL_SQL, "op7_licenses": _licenses_sql()}
