import gzip
import hashlib
import re
import uuid

import pandas as pd
import pytest
from granary.functions import codes, fields, markup, text
from pyspark.sql import functions as F

SVG = '<svg xmlns="http://www.w3.org/2000/svg">%s</svg>'


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")


def one(df, c):
    return [r[0] for r in df.orderBy("i").select(c).collect()]


def test_first_text_of_scalars_lists_and_bytes(spark):
    df = spark.createDataFrame([(0, "  ", ["a", " ", "b "], b"z"), (1, " x ", None, None), (2, None, [" "], b"q"), (3, None, None, None)], "i int, a string, b array<string>, d binary")
    assert one(df, fields.first_text(df, ["none", "a", "b", "d"])) == ["a b", "x", "q", None]
    assert [tuple(x) for x in one(df, fields.first_text_with_field(df, ["a", "b", "d"]))] == [("a b", "b"), ("x", "a"), ("q", "d"), (None, None)]


def test_identity_of_rows(spark):
    df = spark.createDataFrame([(0, " s ", "d", "r"), (1, "", "d", "r"), (2, None, "d", None)], "i int, s string, d string, r string")
    assert one(df, fields.qualified_id(F.col("s"), F.col("d"), F.col("r"))) == ["s", "d::r", None]
    with pytest.raises(Exception, match="no identity"):
        df.select(fields.required(fields.qualified_id(F.col("s"), F.col("d"), F.col("r")), "no identity")).collect()


def test_json_paths_keep_booleans_and_numbers_apart(spark):
    df = column(spark, ['{"n": 3, "m": {"id": "x"}}', '{"n": true}', '{"n": "a"}', "no", None]).withColumn("v", F.try_parse_json("c"))
    assert one(df, fields.json_path(F.col("v"), "n", "int")) == [3, None, None, None, None]
    assert one(df, fields.json_path(F.col("v"), "n", "boolean")) == [None, True, None, None, None]
    df = df.withColumn("w", F.try_parse_json(F.lit('{"metadata": {"id": " k "}}')))
    assert one(df, fields.identity(F.col("w"), ["sample_id", "id"]))[0] == "k"


def test_choices_and_templates(spark):
    df = spark.createDataFrame([(0, "d", "D", "detail"), (1, "d", "D", "description"), (2, "d", " ", "detail")], "i int, a string, b string, p string")
    a, b, p = F.col("a"), F.col("b"), F.col("p")
    assert one(df, fields.choose_instruction(a, b, "description")) == ["d"] * 3
    assert one(df, fields.choose_instruction(a, b, "detail")) == ["D", "D", "d"]
    assert one(df, fields.choose_instruction(a, b, "mixed", p)) == ["D", "d", "d"]
    assert one(column(spark, ["a| b||c", "a, b,,c", "", None]), fields.tags(F.col("c"))) == [["a", "b", "c"], ["a", "b", "c"], [], []]
    assert one(df, fields.search_text({"A": a, "B": b}))[2] == "A: d"
    assert one(df, fields.numbered_context(F.array(a, b)))[0] == "Example 1:\nd\n\nExample 2:\nD"
    assert "References" not in one(df, fields.brief_prompt(a, F.lit("")))[0] and "References" in one(df, fields.brief_prompt(a, b))[0]
    kept, dropped = fields.keep_metadata(F.create_map(F.lit("x"), F.lit(1), F.lit("y"), F.lit(2)), ["x"])
    assert one(df, kept)[0] == {"x": 1} and one(df, dropped)[0] == ["y"]


def test_secrets_are_redacted():
    config = {"api_key": "k", "max_tokens": 5, "deep": [{"Auth-Token": "t", "tokenizer": "z"}], "password": None}
    assert fields.redacted(config) == {"api_key": "[redacted]", "max_tokens": 5, "deep": [{"Auth-Token": "[redacted]", "tokenizer": "z"}], "password": None}


def test_caption_hash_folds_case_fully(spark):
    values = ["Straße  x", "ﬁ Σας", "a\u001cb", "", None]
    expected = [None if v is None else hashlib.sha256(" ".join(v.casefold().split()).encode()).hexdigest() for v in values]
    assert one(column(spark, values), text.caption_hash("c")) == expected
    assert one(column(spark, [" A\t b "]), text.caption_key(F.col("c")))[0] == hashlib.sha256(b"a b").hexdigest()


def test_word_counts(spark):
    values = ["it's a well-known fact", "한국어 단어", "", "x--y 'z'", "a_b 1.5"]
    expected = [len(re.findall(text.WORD, v)) for v in values]
    assert one(column(spark, values), text.word_count(F.col("c"))) == expected
    assert one(column(spark, values), text.word_count_unicode("c")) == expected


def test_small_text_functions(spark):
    df = column(spark, ["a<SVG x>1</svg><svg>2</svg>", "none"])
    assert one(df, text.first_markup(F.col("c"))) == ["<SVG x>1</svg>", None]
    assert one(column(spark, ["a/b/c.tar.gz", ".hidden", "x", "d/"]), text.file_stem(F.col("c"))) == ["c.tar", ".hidden", "x", "d"]
    assert one(column(spark, ["M0 0 L1,2 Z", "Maximal"]), text.path_command_count(F.col("c"))) == [3, 0]
    assert one(column(spark, ["<path <path"]), text.count_of(F.col("c"), "<path")) == [2]
    assert one(column(spark, ["a" * 40, "A" * 40, None]), text.is_commit(F.col("c"))) == [True, False, False]
    assert one(column(spark, ["a b/ç?"]), text.safe_name(F.col("c"))) == ["a-b-ç"]
    assert [x is not None for x in one(column(spark, ['```json\n{"a": 1}\n```', 'x {"a": 1}', "{bad"]), text.json_object(F.col("c")).cast("string"))] == [True, False, False]
    assert one(column(spark, ['x {"a": 1} y']), text.json_slice(F.col("c")).cast("string")) == ['{"a":1}']
    assert one(column(spark, ["http://x/y", "é"]), text.uuid_of(F.col("c"))) == [str(uuid.uuid5(uuid.NAMESPACE_URL, v)) for v in ("http://x/y", "é")]
    assert tuple(one(column(spark, ["abc"]), text.bounded_prefix(F.col("c"), 2))[0]) == ("ab", True)
    assert one(column(spark, ["['a ', 'b']", "plain", "[1]", "[bad"]), text.listed_detail("c")) == ["a b", "plain", "[1]", "[bad"]
    assert one(column(spark, ['{"b": 1, "a": "é"}']), text.canonical_json_hash("c")) == [hashlib.sha256('{"a":"é","b":1}'.encode()).hexdigest()]
    assert one(spark.createDataFrame([(0, "a\nb", "a\nc")], "i int, a string, b string"), text.unified_diff("a", "b"))[0].endswith("-b+c")


def test_single_instruction(spark):
    assert one(column(spark, [[" a ", " "]], "array<string>"), text.only_instruction(F.col("c"))) == ["a"]
    with pytest.raises(Exception, match="exactly one"):
        column(spark, [["a", "b"]], "array<string>").select(text.only_instruction(F.col("c"))).collect()


def test_hash_bucket_is_unsigned(spark):
    keys = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(50)]
    assert one(column(spark, keys), text.hash_bucket(F.col("c"))) == [int(k[:16], 16) % 100 for k in keys]
    assert one(column(spark, [None]), text.stable_key(F.lit("a"), F.col("c"), F.lit("b"))) == [hashlib.sha256(b"a\x1f\x1fb").hexdigest()]


def test_payloads_and_ids_round_trip(spark):
    df = column(spark, ["x" * 1000, "ab", None]).withColumn("p", text.compressed("c"))
    assert [r[0] for r in df.orderBy("i").select("p.codec").collect()] == ["gzip+base64", "utf8", None]
    assert one(df, text.decompressed("p.codec", "p.data")) == ["x" * 1000, "ab", None]
    assert gzip.decompress(gzip.compress(b"a")) == b"a"
    ids = column(spark, [[1, 70000], [], None], "array<int>")
    assert one(ids, text.unpacked_ids(text.packed_ids("c"))) == [[1, 70000], [], None]


# Framed sequences: nine coordinates, a plain and a special color, two paths.
BOS, EOS, C, A, COLOR = 196998, 196999, 151943, 196436, 191946
IDS = [BOS, 151938, C + 1, C + 201, 151940, C, C + 39999, C + 5, COLOR + 2 + 0xABC, 151941, C + 7, A, A + 1, A + 99, C + 8, 151939, C + 9, 151942, C + 10, COLOR + 1, EOS]


def test_vocabulary_sizes():
    assert codes.BOOK.sizes() == {"contiguous": 45062, "atomic": 44205, "xy": 4605, "xy_rgb": 558}


def test_factorizations_lengthen_and_come_back(spark):
    df = column(spark, [IDS], "array<int>")
    xy, rgb = codes.factorize_xy(F.col("c")), codes.factorize_xy_rgb(F.col("c"))
    assert (len(IDS), one(df, F.size(xy))[0], one(df, F.size(rgb))[0]) == (21, 30, 34)
    assert one(df, codes.invert(xy))[0] == IDS and one(df, codes.invert(rgb))[0] == IDS
    parts = [tuple(p) for p in one(df, rgb)[0]]
    assert ("r", 0xA) in parts and ("g", 0xB) in parts and ("b", 0xC) in parts and ("special_color", 1) in parts
    f = one(df, codes.sequence_features("c"))[0]
    assert (f["coordinates"], f["rgb_colors"], f["special_colors"], f["paths"], f["commands"], f["arcs"], f["error"]) == (9, 1, 1, 2, 5, 3, None)


@pytest.mark.parametrize("parts", [[("x", 1)], [("y", 1)], [("x", 200), ("y", 0)], [("r", 1), ("g", 1), ("path_end", 0)], [("special_color", 2), ("path_end", 0)], [("path_end", 0)], [("b", 1)], [("odd", 1)], [("r", 1), ("g", 1), ("b", 1)]])
def test_malformed_parts_have_no_ids(spark, parts):
    assert one(column(spark, [parts], "array<struct<kind: string, value: int>>"), codes.invert(F.col("c"))) == [None]


@pytest.mark.parametrize(("ids", "error"), [
    ([BOS, EOS], "empty_body"), ([1, *IDS[1:]], "framing"), ([BOS, COLOR, EOS], "color_without_command"), ([BOS, C, EOS], "expected_command"), ([BOS, 151939, EOS], "truncated_command"),
    ([BOS, 151939, C, EOS], "open_path"), ([BOS, 151939, A, EOS], "argument"), ([BOS, BOS, EOS], "inner_framing"), ([BOS, 191943 + 40000, EOS], "reserved_id"),
])
def test_grammar_errors(ids, error):
    assert codes.parse(ids)["error"] == error


def test_recovery_names_roles_and_padding(spark):
    assert codes.recovered_prefix(IDS[:-3]) == [*IDS[:9], EOS] and codes.recovered_prefix([C]) == []
    df = column(spark, [IDS], "array<int>")
    assert one(df, F.transform("c", lambda i: codes.unnamed(codes.named(i))))[0] == IDS
    roles = one(df, codes.response_roles(F.col("c")))[0]
    assert roles[0] == "framing" and roles[1] == "structure" and roles[2] == "geometry" and roles[8] == "style"
    assert one(df, codes.role_weights(codes.response_roles(F.col("c")), {"style": 8}))[0][8] == 8.0
    assert one(df, codes.padded(F.col("c"), F.lit(23), 0))[0][-3:] == [EOS, 0, 0]
    assert codes.BOOK.shifted(1).bos == BOS + 1
    masked = codes.masked_labels(F.array(F.lit(5), F.lit(6)), F.array(F.lit(0), F.lit(3)), F.array(F.lit(3), F.lit(6)), F.lit(3), F.lit(9))
    assert one(df, masked)[0] == [-100, 6]


@pytest.mark.parametrize(("body", "found"), [
    ('<path d="M0 0"/>', []), ("<script/>", ["unsafe_attribute", "unsafe_element"]), ('<use href="#a"/>', []), ('<use href="http://x"/>', ["external_reference", "external_reference"]),
    ('<rect onclick="x"/>', ["unsafe_attribute"]), ('<rect style="fill:red"/>', []), ('<rect style="behavior:x"/>', ["unsafe_css"]), ('<rect style="fill:expression(1)"/>', ["unsafe_css"]),
    ('<rect fill="url(http://x)"/>', ["external_reference", "external_reference"]), ('<rect fill="url(#a)"/>', []), ('<rect a="java\nscript:x"/>', []), ('<rect a="b\\c"/>', ["unsafe_attribute"]),
    ('<x:y xmlns:x="urn:q"/>', ["invalid_namespace", "unsafe_element"]), ("<Path/>", ["unsafe_element"]), ('<g data-agent-id="e1"/>', ["reserved_label"]), ("<?pi x?>", ["unsafe_attribute"]), ("<g>", ["xml_parse_error"]),
    ('<rect base="x"/>', ["external_reference"]), ('<image src="a.png"/>', ["external_reference"]), ('<g style="@import x"/>', ["unsafe_css", "unsafe_css"]),
])
def test_validation(body, found):
    assert [c for c, _ in markup.findings(SVG % body)["errors"]] == found


def test_validation_of_whole_texts(spark):
    values = [None, " ", "<g/>", '<!DOCTYPE svg [<!ENTITY a "b">]><svg xmlns="http://www.w3.org/2000/svg"/>', "<svg/>", SVG % ""]
    got = one(column(spark, values), markup.validate("c"))
    assert [g["is_valid"] for g in got] == [False, False, False, False, True, True]
    assert got[4]["warnings"][0]["code"] == "invalid_namespace" and got[3]["errors"][0]["code"] == "unsafe_doctype"


def test_canonical_form_and_nodes(spark):
    a, b = one(column(spark, ["<svg b='1' a='2'><!-- c --><g></g></svg>", '<svg a="2" b="1"><g/></svg>']), markup.canonicalize("c"))
    assert a["canonical"] == b["canonical"] and (a["nodes"], b["nodes"]) == (3, 2)
    assert tuple(one(column(spark, ["<svg>"]), markup.canonicalize("c"))[0]) == (None, None)


def test_names_labels_and_prefixes(spark):
    assert markup.element_names("<path/><Rect/>", True) is None and markup.element_names("<path/><rect/><path/>", True) == ["path", "rect"] and markup.element_names("words", True) is None
    whole = SVG % '<title>t</title><defs><mask id="m"><use href="#n"/></mask><mask id="n"/><mask id="o"/></defs><g class="k"><rect id="r" mask="url(#m)"/>tail</g><g/>'
    out, rows = markup.label(whole)
    assert [(r[0], r[2], r[3], r[4], r[5]) for r in rows] == [
        ("s0001", "svg", None, None, "svg"), ("d0001", "mask", "m", "s0001", "resource"), ("e0001", "use", None, "d0001", "graphics"), ("d0002", "mask", "n", "s0001", "resource"),
        ("g0001", "g", None, "s0001", "group"), ("e0002", "rect", "r", "g0001", "graphics"),
    ]
    assert "title" not in out and "class" not in out and "url(#ref0001)" in out and rows[-1][1] == "/svg/g[1]/rect"
    assert len(one(column(spark, [SVG % "<g/><path/>", "bad", None]), markup.element_prefixes("c"))[0]) == 2
    assert "data-agent-id" not in one(column(spark, [out]), markup.without_labels("c"))[0]


def test_label_of_nothing(spark):
    assert pd.isna(one(column(spark, [None]), markup.labelled("c"))[0])
