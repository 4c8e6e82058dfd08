"""License scans by an exact set-similarity join of text blocks and notice templates, in DataFrame functions only.

A template is the token set of a license notice; a block is a run of as many consecutive words of a text as the notice
has, wherever its lines break, and a template is found where some block holds at least the threshold share of its tokens.
Texts are split into words once, and what is written of them are the places of words that any template or phrase has.
Template tokens are put in one global order, rarest first by how often the corpus has them. With need tokens wanted of n,
a block must hold one of the first n - need + 1 (the prefix): the index of prefix tokens is joined to the texts' tokens.
A text with fewer template tokens than needed (length), or with too few template tokens from the first one it has in the
global order on (position), is dropped; of the rest every block is verified by its distinct tokens. Blocks that begin with
a template token suffice: any other holds no more than the one that begins at its first such token.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.llm.common import table, written

THRESHOLD = 0.8
#: Rows of a template index beyond which it is joined by a shuffle and not broadcast (at most 20 MB of short tokens).
BROADCAST_ROWS = 200_000
#: Between words. Words: ASCII letters, digits, and everything beyond ASCII.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# The base phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Sentences and whole notices of common licenses, and the labels that they give.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "text:mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "text:mit"),
    ("released under the mit license", "notice:mit"),
    ("licensed under the apache license version 2 0", "notice:apache-2.0"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "text:apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "notice:gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "text:gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "text:lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "text:bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "text:mpl-2.0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "text:isc"),
    ("licensed under cc by nc 4 0", "notice:cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "notice:cc-by-sa-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "notice:cc-by-4.0"),
    ("this is free and unencumbered software released into the public domain", "text:unlicense"),
    ("all rights reserved", "notice:all-rights-reserved"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the "
        "software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
        "and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied "
        "including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright "
        "holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the "
        "software or the use or other dealings in the software",
        "whole:mit",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license "
        "at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on "
        "an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and "
        "limitations under the license",
        "whole:apache-2.0",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
        "foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any "
        "warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you "
        "should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses",
        "whole:gpl",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of "
        "source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above "
        "copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "whole:bsd",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and "
        "this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all "
        "implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages "
        "whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with "
        "the use or performance of this software",
        "whole:isc",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at "
        "https mozilla org mpl 2 0",
        "whole:mpl-2.0",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this "
        "software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
        "whole:zlib",
    ),
)


@dataclass(frozen=True)
class Template:
    tokens: tuple[str, ...]
    label: str
    words: int

    def need(self, threshold: float) -> int:
        return math.ceil(threshold * len(self.tokens) - 1e-9)


def words_of(text: str) -> list[str]:
    """The words of a notice or phrase; only A-Z are lower-cased."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def templates_of(notices: Sequence[tuple[str, str]]) -> list[Template]:
    """Templates of (text, label); texts without a word give none."""
    return [Template(tuple(dict.fromkeys(words)), label, len(words)) for text, label in notices if (words := words_of(text))]


def _side(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of rows that the driver holds, broadcast where its size allows."""
    made = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")
    return F.broadcast(made) if len(rows) <= BROADCAST_ROWS else made.hint("merge")


def held_words(docs: DataFrame, vocabulary: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, hits: array<struct<at, token>>, the words of the vocabulary in order."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.split(F.coalesce(F.col(text_col), F.lit("")), _BETWEEN).alias("words"))
    lead = (F.get("words", F.lit(0)) == "").cast("int")
    trail = ((F.size("words") > 1) & (F.element_at("words", -1) == "")).cast("int")

    def hit(word: Column, i: Column) -> Column:
        low = F.lower(word)  # a character beyond ASCII whose lower case is ASCII has more bytes
        return F.when(low.isin(*vocabulary) & (F.octet_length(low) == F.octet_length(word)), F.struct((i - lead).alias("at"), low.alias("token")))

    return read.select("doc_id", (F.size("words") - lead - trail).cast("long").alias("n_words"), F.array_compact(F.transform("words", hit)).alias("hits"))


def token_counts(rows: DataFrame) -> dict[str, int]:
    """How often each word of the vocabulary stands in all documents: one count for each comes to the driver."""
    counted = rows.select(F.explode("hits.token").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return {r["token"]: r["n"] for r in counted.toLocalIterator()}


def _most_tokens(occurrences: Column, words: Column) -> Column:
    """array<struct<n, at>>: of the block that begins at each occurrence, its distinct template tokens and its first word."""

    def block(first: Column, i: Column) -> Column:
        inside = F.filter(F.slice(occurrences, i + 1, words), lambda x: x["at"] < first["at"] + words)
        return F.struct(F.size(F.array_distinct(F.transform(inside, lambda x: x["place"]))).alias("n"), first["at"].alias("at"))

    return F.transform(occurrences, block)


def notices(rows: DataFrame, templates: Sequence[Template], threshold: float = THRESHOLD) -> DataFrame:
    """rows: held_words() with _row, written. One row for each template and text that has it: _row, label, share (the
    largest of a block), word (where the first block that meets the threshold begins)."""
    counts = token_counts(rows)
    index, prefix = [], []
    for number, t in enumerate(templates):
        need, n = t.need(threshold), len(t.tokens)
        for place, token in enumerate(sorted(t.tokens, key=lambda w: (counts.get(w, 0), w))):
            index.append({"token": token, "template": number, "place": place, "n": n, "need": need, "words": t.words, "label": t.label})
            if place <= n - need:
                prefix.append({"token": token, "template": number, "need": need})
    spark = rows.sparkSession
    tokens = rows.where(F.size("hits") > 0).select("_row", F.array_distinct("hits.token").alias("tokens"))
    probes = tokens.select("_row", F.size("tokens").alias("held"), F.explode("tokens").alias("token"))
    likely = probes.join(_side(spark, prefix, "token string, template int, need int"), "token").where("held >= need").select("_row", "template").distinct()
    likely, _ = written(likely)  # its size is known from here on: a small one is broadcast, and no text's words are shuffled
    spread = rows.select("_row", "hits").join(likely, "_row").select("_row", "template", F.explode("hits").alias("h")).select("_row", "template", "h.*")
    met = spread.join(_side(spark, index, "token string, template int, place int, n int, need int, words int, label string"), ["template", "token"])
    met = met.groupBy("_row", "template", "n", "need", "words", "label")
    met = met.agg(F.array_sort(F.collect_list(F.struct("at", "place"))).alias("found"), F.count_distinct("place").alias("held"), F.min("place").alias("first"))
    met = met.where((F.col("held") >= F.col("need")) & (F.col("n") - F.col("first") >= F.col("need")))
    blocks = met.select("_row", "label", "n", "need", _most_tokens(F.col("found"), F.col("words")).alias("blocks"))
    good = blocks.select("_row", "label", "n", F.filter("blocks", lambda b: b["n"] >= F.col("need")).alias("blocks")).where(F.size("blocks") > 0)
    return good.select("_row", "label", (F.array_max("blocks.n") / F.col("n")).alias("share"), F.array_min("blocks.at").cast("long").alias("word"))


def _places(phrase: Sequence[str]) -> Column:
    """Where a phrase begins: its words are hits that follow one another, in the list and in the text."""
    hits = F.col("hits")

    def here(h: Column, i: Column) -> Column:
        test = h["token"] == phrase[0]
        for k, word in enumerate(phrase[1:], 1):
            other = F.get(hits, i + k)
            test = test & F.coalesce((other["token"] == word) & (other["at"] == h["at"] + k), F.lit(False))
        return test

    return F.transform(F.filter(hits, here), lambda h: h["at"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[Template] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found.

    found lists the notices that the text has: label, share of the notice's tokens, and word, where its first block begins;
    labels joins their labels with those of the base phrases. score is 1 with a base phrase, else the largest share found,
    else 0. Null and empty texts have no words and no labels; repeated rows, null ids and long texts keep their rows and
    are scanned whole; an empty table gives none; other columns are ignored.
    """
    templates = templates_of(NOTICES) if templates is None else list(templates)
    split = [(words_of(p), label) for p, label in phrases]
    vocabulary = sorted({t for x in templates for t in x.tokens} | {w for p, _ in split for w in p})
    rows, _ = written(held_words(docs, vocabulary, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()))
    of_row, _ = written(notices(rows, templates, threshold).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("label", "share", "word"))).alias("found")))
    at = [_places(p) for p, _ in split]
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(f"at{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(split)]))))
    placed = rows.select("_row", "doc_id", "n_words", *[a.alias(f"at{i}") for i, a in enumerate(at)])
    every = F.concat(*[f"at{i}" for i in range(len(at))])
    placed = placed.select("_row", "doc_id", "n_words", every.alias("every"), base.alias("base"))
    none = F.array().cast("array<struct<label:string,share:double,word:long>>")
    out = placed.join(of_row, "_row", "left").withColumn("found", F.coalesce("found", none))
    labels = F.array_sort(F.array_distinct(F.concat("base", "found.label")))
    share = F.coalesce(F.array_max("found.share"), F.lit(0.0))
    return out.select("doc_id", "n_words", F.size("every").cast("long").alias("n_base"), F.array_min("every").cast("long").alias("first_word"), F.array_max("every").cast("long").alias("last_word"), F.concat_ws(",", "base").alias("base_labels"), F.concat_ws(",", labels).alias("labels"), F.when(F.size("base") > 0, 1.0).otherwise(share).alias("score"), "found")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("found")


def _sql() -> str:
    rows = ", ".join(f"('{text}', '{label}')" for text, label in NOTICES)
    phrases = ", ".join(f"('{' ' + text + ' '}', '{label}')" for text, label in PHRASES)
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), words AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM docs
), phrases AS (
  SELECT string_split(trim(p), ' ') AS p, label FROM (VALUES {phrases}) v(p, label)
), places AS (
  SELECT rid, i - 1 AS pos, label FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM words WHERE regexp_matches(t, 'license|by')), phrases
  WHERE w[i] = p[1] AND w[i : i + len(p) - 1] = p
), base AS (
  SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM places GROUP BY rid
), templates AS (
  SELECT row_number() OVER () AS tid, list_distinct(string_split(p, ' ')) AS p, len(string_split(p, ' ')) AS span, label FROM (VALUES {rows}) v(p, label)
), wanted AS (
  SELECT tid, label, span, len(p) AS n, 0.8 * len(p) - 1e-9 AS need, unnest(p) AS token FROM templates
), found AS (
  SELECT rid, tid, label, span, n, need, i, token, count(DISTINCT token) OVER (PARTITION BY rid, tid) AS held
  FROM (SELECT rid, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM words) JOIN wanted USING (token)
), enough AS (
  SELECT * FROM found WHERE held >= need
), met AS (
  SELECT a.rid, a.tid, any_value(a.label) AS label, count(DISTINCT b.token) / any_value(a.n)::DOUBLE AS share, count(DISTINCT b.token) >= any_value(a.need) AS ok
  FROM enough a JOIN enough b ON a.rid = b.rid AND a.tid = b.tid AND b.i >= a.i AND b.i < a.i + a.span GROUP BY a.rid, a.tid, a.i
), notice AS (
  SELECT rid, max(share) AS share, list(DISTINCT label) AS labels FROM met WHERE ok GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(b.labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(n.labels, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM words LEFT JOIN base b USING (rid) LEFT JOIN notice n USING (rid)
"""


OP8_SQL = _sql()
