import json

import pytest
from granary.functions import critic
from granary.functions.pathcodec import PathCodec
from granary.operators import audits
from granary.sources.readers import safe_fragments
from pyspark.sql import functions as F

SVG = '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 100 50">%s</svg>'


def test_vocabulary_size():
    codec = PathCodec()
    assert len(codec.vocabulary) == len(set(codec.vocabulary)) == 44468


def test_round_trip_is_stable():
    codec = PathCodec()
    tokens = codec.encode(SVG % '<path d="M0,0L100 50 C1 1 2 2 3 3A10 5 370 0 1 50 25Z M 3 4" fill="#F80"/><path d="M1 1" fill="none"/><path d="M.5-0"/>')
    again = codec.decode(tokens)
    assert codec.encode(again.replace("0 0 200 200", "0 0 199 199")) == tokens and 'fill="#ff8800"' in again and 'fill="none"' in again and 'fill="#000000"' in again
    assert "M 0 0 L 199 199" in again and " 10 0 1 " in again
    for n in range(len(tokens)):
        assert tokens[n] in codec.allowed_next(tokens[:n])
    assert codec.allowed_next(tokens) == [codec.token("eos")]


@pytest.mark.parametrize("body", [
    '<path d="L 1 1"/>', '<path d="M 1 1 H 2"/>', '<path d="m 1 1"/>', '<path d="M 1"/>', '<path d="M 1 1 2 2"/>', '<path d="M 101 1"/>', '<path d="M 1 1 Z L 2 2"/>', '<path d="M 1 1 Z Z"/>', '<path d="M 1 1 A 0 1 0 0 0 2 2"/>', '<path d="M 1 1 A 1 1 0 2 0 2 2"/>',
    '<path d="M 1 1 A .1 .1 0 0 0 2 2"/>', '<path d="M 1 1" fill="red"/>', '<path d="M 1 1" stroke="none"/>', '<rect/>', "<path/>", "", "text", '<path d="M 1 1"><g/></path>', '<path d=""/>', "<!-- c --><path d='M 1 1'/>",
])
def test_all_else_is_refused(body):
    with pytest.raises(ValueError):
        PathCodec().encode(SVG % body)


@pytest.mark.parametrize("tokens", [[], ["eos"], ["sop", "cmd:M", "xy:00000", "cmd:F", "color:none", "eop"], ["sop", "cmd:L"], ["sop", "cmd:M", "xy:00000", "cmd:F", "color:none", "eop", "eos", "eos"], ["sop", "cmd:M", "xy:0"]])
def test_malformed_sequences(tokens):
    with pytest.raises(ValueError):
        PathCodec().decode([PathCodec.token(t) for t in tokens])


def answer(change=None):
    evaluations = [{"category": c, "type": t, "applicable": True, "score": 4, "reason": "r"} for c, t in sorted(critic.PAIRS)]
    evaluations[0] = evaluations[0] | {"score": 1}
    issue = {"category": evaluations[0]["category"], "type": evaluations[0]["type"], "scope": "part", "target_ids": ["e0001"], "observed": "o", "expected": "e", "fix": "f"}
    data = {"evaluations": evaluations, "issues": [issue]}
    if change:
        change(data)
    return json.dumps(data)


def test_critic_contract(spark):
    ask = lambda change=None, targets=("e0001",): critic.faults(answer(change), list(targets), 3)
    assert len(critic.PAIRS) == 18 and critic.scorecard(spark).count() == 18 and ask() == []
    for odd in ([], {}, ["a"], {"a": 1}, 3, None, True):
        assert "evaluation_values" in ask(lambda d, odd=odd: d["evaluations"][0].update(category=odd)) and "evaluation_values" in ask(lambda d, odd=odd: d["evaluations"][0].update(type=odd))
        for field in ("category", "type", "scope"):
            issue = {"category": "a", "type": "b", "scope": "global", "target_ids": [], "observed": "o", "expected": "e", "fix": "f"}
            assert "issue_values" in ask(lambda d, odd=odd, field=field, issue=issue: d["issues"].append({**issue, field: odd}))
    assert critic.faults("x", [], 3) == ["not_json"] and critic.faults("{}", [], 3) == ["keys"]
    assert ask(targets=()) == ["target_unknown"]
    assert ask(lambda d: d["evaluations"].pop()) == ["evaluation_pairs"]
    assert ask(lambda d: d["evaluations"][1].update(score=True)) == ["evaluation_score"]
    assert ask(lambda d: d["evaluations"][1].update(applicable=False)) == ["evaluation_score"]
    assert ask(lambda d: d["evaluations"][1].update(applicable=False, score=None)) == []
    assert ask(lambda d: d["evaluations"][1].pop("reason")) == ["evaluation_keys", "evaluation_pairs"]
    assert ask(lambda d: d["issues"].clear()) == ["issues_and_scores"]
    assert ask(lambda d: d["issues"].extend(d["issues"] * 3)) == ["issue_count"]
    assert ask(lambda d: d["issues"][0].update(category="layout", type="scale")) == ["issue_without_low_score"]
    assert ask(lambda d: d["issues"][0].update(target_ids=["E1"])) == ["target_ids"] and ask(lambda d: d["issues"][0].update(target_ids=[])) == ["target_missing"]
    assert critic.repair_faults(answer(), answer()) == [] and critic.repair_faults(answer(), answer(lambda d: d["issues"].clear())) == ["issues"]
    rows = [("a", "i", "s", ["e0001"], answer()), ("b", " ", "s", None, "x"), ("a", "i", "s", ["e0001"], answer())]
    df = spark.createDataFrame(rows, "sample_id string, instruction string, labeled_svg string, allowed_target_ids array<string>, critic_output string")
    assert sorted(tuple(r) for r in critic.label_faults(df).collect()) == [("a", "repeated"), ("b", "allowed_target_ids"), ("b", "instruction"), ("b", "not_json")]


def test_record_audit_codes(spark):
    good = (["a", "b"], "ab", 2, [10, 11], [1, 10, 11], [-100, 10, 11])
    rows = [good] + [tuple(v if i == at else x for i, x in enumerate(good)) for at, v in (
        (0, []), (0, ["a", ""]), (1, "x"), (3, []), (3, [10]), (2, 3), (3, [10, 99]), (5, [10]), (5, [-100, -100, 10]), (5, [-100, 11, 10]))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, tokens array<string>, target string, framed_count int, target_ids array<int>, input_ids array<int>, labels array<int>")
    got = audits.record_audit(df, 10, 20).orderBy("i").collect()
    assert [r["failure"] for r in got] == [None, "invalid_codec_target", "invalid_codec_target", "cached_target_serialization_mismatch", "empty_codec_target", "framed_target_count_mismatch", "cached_framed_count_mismatch", "target_contains_non_codec_ids", "input_label_length_mismatch", "labeled_target_count_mismatch", "labeled_target_id_mismatch"]
    assert (got[0]["codec_tokens"], got[0]["full_chat_tokens"], got[0]["maximum_id"], got[1]["codec_tokens"]) == (2, 3, 11, None)
    over = audits.maximum_violations(audits.record_audit(df, 10, 20), {"codec_tokens": 1, "full_chat_tokens": 5}, "i").collect()
    assert [(r["i"], r["metric"]) for r in over] == [(0, "codec_tokens")]


def test_manifests_and_counts(spark):
    df = spark.createDataFrame([("a", 3, 3, "detail", "detail", "d"), ("b", 5, 4, "description", "detail", " ")], "id string, n int, declared int, chosen string, policy string, det string")
    m = audits.length_manifest(df, "n", "id", "declared").first()
    assert (m["n"], m["shortest"], m["longest"], m["total"], m["matching"], m["differing"]) == (2, 3, 5, 8, 1, 1)
    assert audits.selection_counts(df, "chosen", "policy", "det").first().asDict() == {"n": 2, "description": 1, "detail": 1, "fallbacks": 1}
    assert df.select(audits.prefix_length("constant", 7), audits.prefix_length("field", "n")).first()[:] == (7, 3)
    with pytest.raises(Exception, match="non-negative"):
        df.select(audits.prefix_length("field", "x")).collect() if "x" in df.columns else df.withColumn("x", F.lit(-1)).select(audits.prefix_length("field", "x")).collect()
    assert audits.index_manifest_faults({"a": 1}, {"a": 2, "b": 3}, ("b",)) == ["a"]
    assert audits.registration_faults(["x", "y", "z"], [[1], [1], [2, 3]]) == ["y", "z"]
    images = spark.createDataFrame([([0, 255], [255, 255]), ([0], [1, 2])], "a array<int>, b array<int>")
    assert [r[0] for r in images.select(audits.mean_absolute_error(F.col("a"), F.col("b"))).collect()] == [0.5, None]


def test_safe_fragments(spark):
    df = spark.createDataFrame([("<path/>", "c"), ("<script/>", "c"), ("<rect/>", " "), (None, "c")], "svg string, cap string")
    assert [r["element_names"] for r in safe_fragments(df, "svg", "cap").collect()] == [["path"]]


def test_features_of_many_sequences_are_those_of_each(spark):
    """The flattened grammar against the automaton, on sound, cut, shuffled and random sequences."""
    import random

    from granary.functions import codes

    rng, b = random.Random(8), codes.BOOK
    one = lambda r: rng.randint(*r)

    def path():
        out = []
        for _ in range(rng.randint(1, 4)):
            k = rng.randrange(5)
            out += [b.command[0] + k, *[one(b.coordinate if a == "c" else b.arc) for a in b.arguments[k]]]
        return [*out, b.color[0] + rng.choice([0, 1, 2, 900])]

    rows = [None, [], [b.bos], [b.bos, b.eos], [b.bos, 5, b.eos], [5, 6, 7]]
    for _ in range(400):
        ids = [b.bos, *[i for _ in range(rng.randint(0, 4)) for i in path()], b.eos]
        kind = rng.random()
        if kind < 0.5 and len(ids) > 3:
            at = rng.randrange(len(ids))
            ids = ids[:at] + rng.choice([[], [one(b.coordinate)], [one(b.color)], [b.eos], [7], [b.command[0] + 2]]) + ids[at + rng.randint(0, 1) :]
        rows.append(ids)
    got = codes.features(rows)
    for k, x in enumerate(rows):
        expected = dict.fromkeys(codes.FEATURES.names) if x is None else codes.parse(x)
        assert {n: got[n][k] for n in got} == expected, x
    assert codes.features([]) == {n: [] for n in codes.FEATURES.names}
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, ids array<int>")
    assert {r["i"]: r["e"] for r in df.select("i", codes.sequence_features("ids").error.alias("e")).collect()} == dict(enumerate(got["error"]))


def test_codecs_have_one_name_each():
    from granary.functions import codecs

    assert codecs.names() == ["path"] and codecs.get("path").vocabulary == 44_468
    with pytest.raises(KeyError):
        codecs.get("other")
    with pytest.raises(ValueError):
        codecs.register("path", codecs.get("path"))
