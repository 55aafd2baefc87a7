import random

import xxhash
from granary.llm import components, simhash
from granary.llm._common import Tables
from pyspark.sql import functions as F

from tests.llm.conftest import AWKWARD, docs


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=2):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(prints))]


def test_fingerprint_is_that_of_the_definition():
    rng = random.Random(1)
    texts = ["", " ", None, "one", "one two", "A b\tC\nd", "É É é"] + [" ".join(rng.choice(["Ab", "c", "dé", "x"]) for _ in range(rng.randint(1, 300))) for _ in range(30)]
    for t in texts:
        assert simhash.fingerprint(t.encode() if t is not None else None) == plain_fingerprint(t)


def test_fingerprint_agrees_with_the_jvm_hash(spark):
    one = spark.range(1).select(F.xxhash64(F.lit("ab cd é"))).first()[0]
    assert one % 2**64 == xxhash.xxh64_intdigest("ab cd é".encode(), 42)


def test_tree_finds_all_within_radius():
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = base + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(5)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values[::7]:
        assert sorted(tree.within(v, 2)) == [i for i, x in enumerate(values) if (x ^ v).bit_count() <= 2]


def test_components_match_brute_force_also_in_split_shards(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") * 3 for _ in range(rng.randint(40, 90))) for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(6):
            words = b.split()
            words[rng.randrange(len(words))] = "zzz"
            texts.append(" ".join(words))
    texts += base[:4] * 3 + ["", None, ""]
    expected = plain_components([plain_fingerprint(t) for t in texts])
    for most in (4096, 3):
        got = {r["id"]: r["component_id"] for r in simhash.near_duplicates(docs(spark, texts).repartition(3), max_tree=most).collect()}
        assert [got[i] for i in range(len(texts))] == expected


def test_components_of_long_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3), (3, None), (100, 101)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long"), Tables(spark, "t")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 560)}


def test_awkward_rows(awkward, empty):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert {r["component_id"] for r in rows if r["fp"] == 0} == {2}
    assert [r["component_id"] for r in rows if r["id"] is None] == [None]
    assert simhash.near_duplicates(empty).collect() == []
    kept = simhash.one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, 1), (False, 2), (False, 5), (True, None)]
    assert simhash.one_of_each(empty).collect() == []


def test_one_row_stays_of_each_group_where_ids_repeat_or_are_null(spark):
    a, b, c, d = ("one two three four five", "alpha beta gamma delta", "red green blue grey black", "north east south west")
    rows = [(1, a, "x"), (1, b, "y"), (None, a, "z"), (None, c, "u"), (None, d, "v"), (None, d, "v"), (2, b, "w")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, a, "x"), (1, b, "y"), (None, c, "u"), (None, d, "v")], key=str)


def test_one_row_stays_of_each_group_of_unique_ids(spark):
    texts = ["a b c d", "a b c d", None, "", "e f g h"]
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs(spark, texts)).collect()) == [0, 2, 4]
