import random
import re
from collections import Counter

from granary.llm import quality
from pyspark.sql import functions as F

from tests.llm.conftest import AWKWARD, docs


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(covered))


def measured(df):
    m = df.select("doc_id", quality.measures(F.col("text")).alias("m"))
    return {r["doc_id"]: tuple(r)[1:] for r in m.select("doc_id", "m.w.n_words", "m.word_chars", "m.n_symbols", "m.l.n_lines", "m.l.n_dup_lines", "m.w.n_repeat_words").collect()}


def test_measures_match_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t ", "a", "a b c", "a b c a b c", "a a a a", "x\nx\n x\n\nx", "#*$%&|<> ä\x0b€ \x0c z", "a b c d a b c", "\x85 \xa0  "]
    texts += ["".join(rng.choice(["a", "b", "é ", " ", "\n", "#", "日", "\t"]) for _ in range(rng.randint(0, 400))) for _ in range(60)]
    texts.append(" ".join(rng.choice("abcdefghijklmnop") for _ in range(30_000)))
    assert measured(docs(spark, texts)) == {i: plain(t) for i, t in enumerate(texts)}


def test_buckets_keep_leading_bits(spark):
    got = {r[0]: r[1] for r in spark.range(0, 5000).select("id", quality.bucket(F.col("id"))).collect()}
    assert all(b <= v < b + max(1, v / 31) for v, b in got.items())
    assert all(got[v] == v for v in range(64))


def test_sketches_merge_and_bound_quantiles(spark):
    rng = random.Random(2)
    rows = [("g" if i % 3 else None, "s", int(rng.lognormvariate(5, 1))) for i in range(3000)]
    df = spark.createDataFrame(rows, "lang string, source string, v long")
    over_all = lambda sketch: quality.quantiles(quality.weighed(sketch, [], None), [])
    merged = over_all(quality.sketches(df, ["v"], ["lang", "source"]))
    one = merged.first()
    values = sorted(r[2] for r in rows)
    for q, name in ((0.1, "q10"), (0.5, "q50"), (0.9, "q90")):
        exact = values[int(q * len(values)) - 1]
        assert one[name] <= exact * 1.001 and exact <= one[name] * 33 / 32 + 1
    halves = quality.sketches(df.where("v % 2 = 0"), ["v"], ["lang", "source"]).unionByName(quality.sketches(df.where("v % 2 = 1"), ["v"], ["lang", "source"]))
    assert over_all(halves).first() == one


def test_a_group_counts_by_its_size_beside_its_parents(spark):
    """Of a group of 5 the parent's quantiles hold, of one of 5000 its own; equal to merging the counts by hand."""
    counts = [("en", "big", 900 + 32 * i, 700) for i in range(3)] + [("en", "small", 960, 5)] + [("en", "other", 10 + i, 400) for i in range(5)] + [(None, None, 33, 1)]
    sketch = spark.createDataFrame([(a, b, "v", c, n) for a, b, c, n in counts], "lang string, source string, metric string, bucket long, n long")
    got = {}
    for r in quality.weighed(sketch, ["lang", "source"], quality.weighed(sketch, ["lang"], quality.weighed(sketch, [], None))).collect():
        got[r["lang"], r["source"], r["bucket"]] = r["share"]
    buckets = sorted({c for _, _, c, _ in counts})

    def shares(rows, above):
        n = sum(x[3] for x in rows)
        upto = {b: sum(x[3] for x in rows if x[2] <= b) for b in buckets}
        return {b: (upto[b] * 10**6 + quality.PRIOR * above[b]) // (n + quality.PRIOR) if above else upto[b] * 10**6 // n for b in buckets}

    of_all = shares(counts, None)
    expected = {}
    for lang, source in {(a, b) for a, b, _, _ in counts}:
        own = shares([x for x in counts if x[:2] == (lang, source)], shares([x for x in counts if x[0] == lang], of_all))
        expected |= {(lang, source, b): v for b, v in own.items()}
    assert got == expected
    q = {r["source"]: r["q50"] for r in quality.quantiles(spark.createDataFrame([(*k, "v", v) for k, v in got.items()], "lang string, source string, bucket long, metric string, share long"), ["lang", "source"]).collect()}
    assert q["big"] >= 900 and q["other"] < 20 and q["small"] < q["big"]


def test_groups_get_fences_of_their_own_at_sf001(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = rows.select("lang", "source", quality.measures(F.col("text")).alias("m")).select("lang", "source", F.expr("100 * m.word_chars div greatest(m.w.n_words, 1L)").alias("word_length"), F.expr("0L").alias("symbol_rate"))
    found = quality.fences(quality.sketches(m, ["word_length", "symbol_rate"], ["lang", "source"])).collect()
    assert len({r["word_length_high"] for r in found}) > 5 and len({r["word_length_low"] for r in found}) > 5


def test_thresholds_follow_the_group(spark):
    rng = random.Random(3)
    prose = lambda n, symbols: " ".join(f"word{rng.randrange(10**6)}" + "#" * (symbols if rng.random() < 0.5 else 0) for _ in range(n))
    rows = [(i, prose(60, 0), "en", "plain") for i in range(300)] + [(1000 + i, prose(60, 6), "en", "code") for i in range(300)] + [(5000, prose(60, 6), "en", "plain"), (5001, prose(60, 60), "en", "code"), (5002, "word " * 80, "en", "plain"), (5003, prose(60, 0), None, None), (5004, prose(60, 60), "xx", "rare")]
    kept = {r["id"]: (r["base_failed"], r["kept"]) for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[i] == (False, True) for i in [*range(300), *range(1000, 1300), 5003])
    assert kept[5000] == (False, False) and kept[5001] == (False, False) and kept[5002] == (True, False) and kept[5004] == (False, False)


def test_awkward_rows(awkward, empty):
    rows = quality.judge(awkward).collect()
    assert len(rows) == len(AWKWARD) and not any(r["kept"] for r in rows) and all(r["base_failed"] for r in rows)
    assert quality.judge(empty).collect() == []
