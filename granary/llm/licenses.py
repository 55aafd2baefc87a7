"""Licence scans by a positional index of rare tokens; DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm._common import Tables
from granary.llm.quality import let

#: A word, A-Z as well as a-z, before the text is put in lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A licence's wording: the key phrase is mandatory and starts at word `at` of the text, first words of the licence or all of them."""

    label: str
    phrase: str
    text: str = ""
    base: bool = False

    @property
    def key(self) -> list[str]:
        return self.phrase.split()

    @property
    def words(self) -> list[str]:
        return (self.text or self.phrase).split()

    @property
    def at(self) -> int:
        n = len(self.key)
        return next(i for i in range(len(self.words)) if self.words[i : i + n] == self.key)


#: The phrases that the contract names, then wordings of further licences.
TEMPLATES = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
    Template("agpl", "gnu affero general public license"),
    Template("lgpl", "gnu lesser general public license"),
    Template("mpl", "mozilla public license"),
    Template("epl", "eclipse public license"),
    Template(
        "bsd", "redistribution and use in source and binary forms",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    Template(
        "mit", "permission is hereby granted free of charge",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    Template(
        "isc", "permission to use copy modify and or distribute this software",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    Template(
        "unlicense", "free and unencumbered software",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
        "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    Template("cc-by", "creative commons attribution"),
    Template("apache", "licensed under the apache license", "licensed under the apache license version 2 0 the license"),
)


def rare_words(template: Template, idf: dict[str, float]) -> list[str]:
    """The two words of the key phrase with the highest IDF; ties by name."""
    return sorted(set(template.key), key=lambda w: (-idf.get(w, 1e9), w))[:2]


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _index(templates: tuple[Template, ...], idf: dict[str, float], which: int) -> Column:
    """A map from a word to postings (t, at): the templates of which it is the rarest word (which: 0) or the next rarest (1), and its first place in their key phrase."""
    held: dict[str, list[Column]] = {}
    for n, t in enumerate(templates):
        word = (rare_words(t, idf) * 2)[which]
        held.setdefault(word, []).append(F.struct(F.lit(n).alias("t"), F.lit(t.key.index(word)).alias("at")))
    return F.create_map(*[c for word, postings in sorted(held.items()) for c in (F.lit(word), F.array(*postings))])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(id, n_words, places, score) of every row of docs; places: array<struct<start, words, label, base, score>>.

    Words are runs of digits, letters and non-ASCII characters, A-Z in lower case, numbered from 0. A
    place is where a template's key phrase stands; its score is the share of the template's words
    that stand at their positions around it; score is the best place's, 0 without one. Null and
    empty texts have no words; a null id stays null; repeated rows are scanned each; an empty table
    gives no rows; other columns aren't read.

    One pass splits every text, and keeps which licence words it holds and, if they can make up a
    key phrase, its words. Those give every licence word's IDF over all documents. A positional index
    of literals, which grows with the templates and not the plan, has each key phrase's two rarest
    words. A file looks up those of its words that are in it; postings of both words are intersected
    by the place where the phrase would start; and there the whole phrase is verified.
    """
    tables = Tables(docs.sparkSession, "licenses")
    vocabulary = sorted({w for t in templates for w in t.key})
    keys, wordings = F.array(*[_strings(t.key) for t in templates]), F.array(*[_strings(t.words) for t in templates])
    needs = F.array(*[_strings(sorted(set(t.key))) for t in templates])
    facts = F.array(*[F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(t.at).alias("at")) for t in templates])
    # lower() also folds non-ASCII capitals, which are word characters either way.
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))

    def kept(w: Column) -> Column:
        def with_seen(seen: Column) -> Column:
            able = (F.size(seen) > 0) & F.exists(needs, lambda k: F.size(F.array_except(k, seen)) == 0)
            return F.struct(F.size(w).cast("long").alias("n_words"), seen.alias("seen"), F.when(able, w).alias("words"))

        return let(F.array_distinct(F.filter(w, lambda x: x.isin(vocabulary))), with_seen)

    rows = tables.cut(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), let(words, kept).alias("m")))
    n = rows.count()
    df = {r["w"]: r["count"] for r in rows.select(F.explode("m.seen").alias("w")).groupBy("w").count().collect()}  # as many rows as the vocabulary
    idf = {w: math.log(1 + n / df[w]) for w in df}
    rare = sorted({w for t in templates for w in rare_words(t, idf)})

    def places(w: Column) -> Column:
        def starts(hits: Column, which: int) -> Column:
            index = _index(templates, idf, which)
            known = F.filter(hits, lambda h: F.map_contains_key(index, h.getField("w")))
            return F.flatten(F.transform(known, lambda h: F.transform(F.element_at(index, h.getField("w")), lambda p: F.struct(p.getField("t").alias("t"), (h.getField("i") - p.getField("at")).alias("start")))))

        def verified(c: Column) -> Column:
            key = F.get(keys, c.getField("t"))
            return (c.getField("start") >= 0) & (F.slice(w, F.greatest(c.getField("start"), F.lit(0)) + 1, F.size(key)) == key)

        def place(c: Column) -> Column:
            t, fact = F.get(wordings, c.getField("t")), F.get(facts, c.getField("t"))
            fit = F.size(F.filter(t, lambda x, k: F.get(w, c.getField("start") - fact.getField("at") + k).eqNullSafe(x))) / F.size(t)
            return F.struct(c.getField("start").cast("long").alias("start"), F.size(F.get(keys, c.getField("t"))).alias("words"), fact.getField("label").alias("label"), fact.getField("base").alias("base"), fit.cast("double").alias("score"))

        hits = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda h: h.getField("w").isin(rare))
        return let(hits, lambda h: F.transform(F.filter(F.array_intersect(starts(h, 0), starts(h, 1)), verified), place))

    none = F.array().cast("array<struct<start: bigint, words: int, label: string, base: boolean, score: double>>")
    found = rows.select("id", "m.n_words", F.when(F.col("m.words").isNull(), none).otherwise(let(F.col("m.words"), places)).alias("places"))
    return found.select("id", "n_words", "places", F.coalesce(F.array_max(F.transform("places", lambda p: p.getField("score"))), F.lit(0.0)).alias("score"))
