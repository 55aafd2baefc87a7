import random
import re

from granary.llm import licenses

from tests.llm.conftest import AWKWARD, docs


def plain(text, templates=licenses.TEMPLATES):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places = []
    for t in templates:
        for s in range(len(words) - len(t.key) + 1):
            if words[s : s + len(t.key)] == t.key:
                around = [words[s - t.at + k] if 0 <= s - t.at + k < len(words) else None for k in range(len(t.words))]
                places.append((s, t.label, t.base, sum(a == b for a, b in zip(around, t.words)) / len(t.words)))
    return len(words), sorted(places)


def test_places_match_brute_force(spark):
    rng = random.Random(1)
    pieces = [t.text or t.phrase for t in licenses.TEMPLATES] + ["license", "gnu general public", "CC-BY", "cc bye", "MIT\nLicense", "mit license mit license", "apache licenseé", "das", "É", "##", "by", "redistribution and use in source and binary forms with modification"]
    texts = [" ".join(rng.choice(pieces).upper() if rng.random() < 0.3 else rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(80)]
    for r in licenses.scan(docs(spark, texts)).collect():
        n, places = plain(texts[r["id"]])
        got = sorted((p["start"], p["label"], p["base"], round(p["score"], 9)) for p in r["places"])
        assert r["n_words"] == n and got == [(s, a, b, round(x, 9)) for s, a, b, x in places]
        assert abs(r["score"] - max([0, *(p[3] for p in places)])) < 1e-9


def test_many_templates_match_brute_force_in_a_plan_of_one_size(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(120)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    templates = []
    for i in range(300):
        phrase = some(rng.randint(1, 5))
        templates.append(licenses.Template(f"l{i}", phrase, f"{some(rng.randint(0, 4))} {phrase} {some(rng.randint(0, 6))}", i % 2 == 0))
    templates = tuple(templates)
    texts = [" ".join(x for _ in range(rng.randint(0, 8)) for x in (some(rng.randint(0, 6)), rng.choice(templates).text)) for _ in range(40)] + ["none here", None]
    df = docs(spark, texts)
    for r in licenses.scan(df, templates=templates).collect():
        n, places = plain(texts[r["id"]], templates)
        got = sorted((p["start"], p["label"], p["base"], round(p["score"], 9)) for p in r["places"])
        assert r["n_words"] == n and got == [(s, a, b, round(x, 9)) for s, a, b, x in places]
    nodes = lambda t: licenses.scan(df, templates=t)._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert nodes(templates) == nodes(templates[:20])


def test_rare_words_have_the_highest_idf():
    t = licenses.Template("x", "the rare common word")
    assert licenses.rare_words(t, {"the": 0.1, "rare": 5, "common": 1, "word": 2}) == ["rare", "word"]


def test_awkward_rows(awkward, empty):
    rows = licenses.scan(awkward).collect()
    assert len(rows) == len(AWKWARD) and all(r["places"] == [] and r["score"] == 0 for r in rows)
    assert licenses.scan(empty).collect() == []
