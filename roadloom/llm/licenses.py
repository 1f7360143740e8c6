"""License scans as an exact set-similarity join of text blocks with license templates.

A template is a license notice or text as a set of words; it matches where a window of consecutive words of a text, as
long as the template and a ninth more, whatever its line breaks, holds at least ``CONTAINMENT`` of the template's words.
Texts are dealt to blocks of two of the longest windows, which overlap by one, so each window lies in a block.

A first pass orders the templates' words globally by their document frequency, counted over all rows, rarest first. A
block that meets the threshold must hold one of a template's first (size - needed + 1) words, so only blocks with such a
prefix word are joined with the templates, by that word; then the block must be long enough, and the shared word's
positions in both orders must leave room for the words needed; the rest is verified exactly, window by window. Base
phrases go through the same join with whole texts as blocks and all words needed; an exact check then counts the places
where the words stand consecutively.

What is collected is one count for each word of the templates; the templates are a fixed table, so that and what is
broadcast have a fixed size. Texts are never shuffled: the join is with the broadcast prefixes, and only what is found is
put together by row.

Defined cases: a null or empty text has no words, no labels and score 0; a very long text is more blocks; ties in
frequency are ordered by the word; repeated rows and ids give a row each; an empty table gives an empty result; extra
columns are left out.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.staging import staged

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAINMENT = 0.9

# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# License notices, as they are commonly printed.
TEMPLATES = {
    "apache-2.0-notice": "licensed under the apache license version 2 0",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc-4.0-notice": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0-notice": "licensed under cc by sa 4 0",
    "gpl-3.0-notice": "this work is licensed under the gnu general public license version 3",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit-notice": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0-text": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense-text": "this is free and unencumbered software released into the public domain",
    # whole texts
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "bsd-2-clause-full": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "gpl-3.0-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program",
    "isc-full": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "mit-full": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
}


def needed(words: int, containment: float = CONTAINMENT) -> int:
    return ceil(containment * words - 1e-9)


def window(template: str, containment: float = CONTAINMENT) -> int:
    """Words in the windows of a template: its own with some others between them."""
    return ceil(len(template.split()) / containment - 1e-9)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased. The two other characters whose lower case holds an ASCII letter are put out of the way first."""
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\ue000")), F.lit("\u0130"), F.lit("\ue000")))


def _literal(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _words(docs: DataFrame) -> DataFrame:
    """doc_id, words: the words of each whole text, in order."""
    text = lower_ascii(F.coalesce(docs["text"], F.lit("")))
    return docs.select(docs["doc_id"], F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many rows each word of the vocabulary stands; at most one row a word is collected."""
    seen = _words(docs).select(F.explode(F.array_intersect("words", _literal(vocabulary))).alias("word"))
    return dict(seen.groupBy("word").count().collect())


def prefix_index(spark, order: list[str], phrases: dict[str, str], templates: dict[str, str], containment: float) -> tuple[DataFrame, list[str], list[str]]:
    """A row for each prefix word of each phrase (all words needed) and template, and the prefix words of phrases and of templates."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for base, table in ((True, phrases), (False, {label: t for label, t in templates.items()})):
        for k, (left, right) in enumerate(table.items()):
            label, text = (right, left) if base else (left, right)
            ws = sorted(set(text.split()), key=rank.get)
            need = len(ws) if base else needed(len(ws), containment)
            width = 0 if base else window(text, containment)
            rows += [(w, i, label, k if base else -1, ws, need, width) for i, w in enumerate(ws[: len(ws) - need + 1])]
    of = lambda base: sorted({r[0] for r in rows if (r[3] >= 0) == base})
    shape = T.StructType([T.StructField(n, t) for n, t in (("word", T.StringType()), ("i", T.IntegerType()), ("label", T.StringType()), ("phrase", T.IntegerType()), ("t", T.ArrayType(T.StringType())), ("need", T.IntegerType()), ("width", T.IntegerType()))])
    structs = [F.struct(F.lit(w).alias("word"), F.lit(i).alias("i"), F.lit(label).alias("label"), F.lit(k).alias("phrase"), _literal(ws).alias("t"), F.lit(need).alias("need"), F.lit(width).alias("width")) for w, i, label, k, ws, need, width in rows]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*structs).cast(T.ArrayType(shape)))), of(True), of(False)


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    vocabulary = sorted({w for t in [*templates.values(), *phrases] for w in t.split()})
    counts = frequencies(docs, vocabulary)
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    prefixes, of_phrases, of_templates = prefix_index(docs.sparkSession, order, phrases, templates, containment)

    x = _words(docs).withColumn("toks", F.array_intersect("words", _literal(vocabulary)))
    some = lambda ws: F.arrays_overlap("toks", _literal(ws))
    x = x.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.size("words").cast("long").alias("n_words"), F.when(some(of_phrases) | some(of_templates), F.struct("words", "toks")).alias("text"))
    x = staged(x, "licenses")

    near = x.where("text is not null").select("rid", "text.words", "text.toks")
    whole = near.where(some(of_phrases)).select("rid", F.lit(True).alias("whole"), "words", "toks")
    step = max(window(t, containment) for t in templates.values())
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("words") / step).cast("int") - 2, F.lit(0)))
    spans = near.where(some(of_templates)).select("rid", F.explode(F.transform(starts, lambda i: F.slice("words", i * step + 1, F.lit(2 * step)))).alias("words"))
    spans = spans.select("rid", F.lit(False).alias("whole"), "words", F.array_intersect("words", _literal(vocabulary)).alias("toks"))
    b = whole.unionByName(spans)
    # the join: by prefix word
    b = b.withColumn("b", F.array_intersect(_literal(order), F.col("toks")))
    b = b.select("rid", "whole", "words", "b", F.explode(F.array_intersect("b", F.when(F.col("whole"), _literal(of_phrases)).otherwise(_literal(of_templates)))).alias("word"))
    c = b.join(F.broadcast(prefixes), "word").where(F.col("whole") == (F.col("phrase") >= 0))
    # the length filter, then the positional one
    c = c.where(F.size("b") >= F.col("need"))
    j = F.array_position("b", F.col("word")).cast("int") - 1
    c = c.where(F.least("i", j) + 1 + F.least(F.size("t") - 1 - F.col("i"), F.size("b") - 1 - j) >= F.col("need"))
    # verification
    shared = F.size(F.array_intersect("b", F.col("t")))
    c = c.where(shared >= F.col("need"))
    inside = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - F.col("width") + 1, F.lit(1))), lambda i: F.size(F.array_intersect(F.slice("words", i, F.col("width")), F.col("t"))))
    literal = F.element_at(F.array(*[_literal(p.split()) for p in phrases]), F.greatest("phrase", F.lit(0)) + 1)
    at = F.sequence(F.lit(0), F.greatest(F.size("words") - F.size(literal), F.lit(0)))
    places = F.filter(at, lambda i: F.slice(F.col("words"), i + 1, F.size(literal)) == literal)
    c = c.select("rid", "label", "phrase", F.size("t").alias("size"), "need", F.when(F.col("whole"), F.size("t")).otherwise(F.array_max(inside)).alias("shared"), F.when(F.col("whole"), places).alias("found"))
    c = c.where((F.col("shared") >= F.col("need")) & ((F.col("phrase") < 0) | (F.size("found") > 0)))
    base = F.col("phrase") >= 0
    one = c.groupBy("rid", "label", "phrase").agg(F.max(F.col("shared") / F.col("size")).alias("share"), F.max(F.size("found")).alias("n"), F.min(F.array_min("found")).alias("first"), F.max(F.array_max("found")).alias("last"))
    per = one.groupBy("rid").agg(
        F.sum(F.when(base, F.col("n"))).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("last"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    return x.select("rid", "doc_id", "n_words").join(per, "rid", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _sql() -> str:
    words = lambda t: f"regexp_extract_all({t}, '{WORD.replace(chr(92), chr(92))}')"
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    phrases = ", ".join(f"({quoted(p.split())}, '{label}')" for p, label in PHRASES.items())
    templates = ", ".join(f"({quoted(sorted(set(t.split())))}, '{label}', {needed(len(set(t.split())))}, {window(t)})" for label, t in TEMPLATES.items())
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS text FROM documents),
w AS (SELECT *, {words("text")} AS words FROM d),
p(phrase, label) AS (VALUES {phrases}),
base AS (SELECT rid, label, list_filter(range(len(words)), lambda i: list_slice(words, i + 1, i + len(phrase)) = phrase) AS places FROM w, p WHERE list_has_all(words, phrase)),
b AS (SELECT rid, sum(len(places)) AS n_base, min(list_min(places)) AS first_word, max(list_max(places)) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base WHERE len(places) > 0 GROUP BY rid),
t(words, label, need, width) AS (VALUES {templates}),
v AS (SELECT rid, label, len(t.words) AS size, need, list_max(list_transform(range(1, greatest(len(w.words) - width + 1, 1) + 1), lambda i: len(list_intersect(list_slice(w.words, i, i + width - 1), t.words)))) AS shared
  FROM w, t WHERE len(list_intersect(w.words, t.words)) >= need),
m AS (SELECT rid, label, shared / size AS share FROM v WHERE shared >= need
  UNION ALL SELECT rid, label, 1.0 FROM base WHERE len(places) > 0),
a AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share)::DOUBLE AS score FROM m GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN b USING (rid) LEFT JOIN a USING (rid)
"""


ORACLE_SQL = _sql()
