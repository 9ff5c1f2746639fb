"""License notices by diagonal voting.

Every four consecutive words of a text are hashed and joined to the positions where a
notice has the same four words; phrases are looked for apart, by their pairs of words. A hit
votes for the diagonal "position in the text minus position in the template". Neighbouring
diagonals are merged, so that a word more or less does not split a notice. A span is verified
by its words: each word of the notice counts once, however often the text repeats it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.llm.common import doc_texts

# Phrases that are looked for word by word, and notices.
PHRASES = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    # whole texts
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
        BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
        OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
        ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
        LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
        CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
        SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_GRAMS = 100_000


@dataclass(frozen=True)
class Settings:
    """``gram``: words of a hash for notices. ``gap``: diagonals this far apart are one span.

    ``coverage``: share of a notice's words that a span needs.
    """

    phrases: tuple[tuple[str, str], ...] = PHRASES
    notices: tuple[tuple[str, str], ...] = NOTICES
    gram: int = 4
    gap: int = 3
    coverage: float = 0.75

    def listed(self) -> list[tuple[int, bool, str, int, list[str]]]:
        """(number, whether it is a phrase, label, words of a hash, words) of every template."""
        rows = [(True, 2, *t) for t in self.phrases] + [(False, self.gram, *t) for t in self.notices]
        found = [(n, phrase, label, k, re.findall("[a-z0-9]+", text.lower())) for n, (phrase, k, label, text) in enumerate(rows)]
        if any(len(w) < k for _, _, _, k, w in found):
            raise ValueError(f"a phrase has two words at least, a notice {self.gram}")
        return found


def words(text: Column) -> Column:
    """Words of letters and digits, A-Z in lower case.

    ``lower`` also changes other capitals, which no template has; the one sign that it
    would make an ASCII letter is put out of the way.
    """
    return F.filter(F.split(F.lower(F.replace(text, F.lit("K"), F.lit("ĸ"))), SEPARATORS), lambda w: w != "")


def _grams(w: Column, k: int) -> Column:
    """(pos, hash) of every ``k`` consecutive words."""
    each = F.transform(
        F.sequence(F.lit(0), F.size(w) - k),
        lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(k), *[F.get(w, i + d) for d in range(k)]).alias("hash")),
    )
    return F.when(F.size(w) >= k, each).otherwise(F.array().cast("array<struct<pos:int,hash:bigint>>"))


def templates(spark: SparkSession, settings: Settings = Settings()) -> DataFrame:
    """(template, label, phrase, k, n, at, hash): every gram of every template of ``n`` words."""
    rows = settings.listed()
    values = F.array(*[
        F.struct(
            F.lit(n).alias("template"), F.lit(label).alias("label"), F.lit(phrase).alias("phrase"), F.lit(k).alias("k"),
            F.lit(len(w)).alias("n"), _grams(F.split(F.lit(" ".join(w)), " "), k).alias("grams"),
        )
        for n, phrase, label, k, w in rows
    ])
    found = spark.range(1).select(F.inline(values)).select("template", "label", "phrase", "k", "n", F.inline("grams").alias("at", "hash"))
    return F.broadcast(found) if sum(len(w) for *_, w in rows) <= BROADCAST_GRAMS else found


def spans(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(row_id, doc_id, n_words, label, phrase, first, past, coverage, score) of every row and span.

    ``first`` is the word a template begins at, ``past`` the word after its last hit,
    ``coverage`` the share of the template's words that were hit, ``score`` those words by
    the longer of template and span. Rows without a span come once, with nulls. Texts are
    split once; what is shuffled are hits, summed by row, template and diagonal: the places
    in a template that were hit are at most as many as the template has words.
    """
    def grams(w: Column) -> Column:
        return F.concat(*[_grams(w, k) for k in sorted({2, settings.gram})])

    listed = doc_texts(docs).select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.inline_outer(
        F.transform(F.array(words(F.col("text"))), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), grams(w).alias("grams")))
    ))
    # a row of its own for each text: the ones without a hit stay
    none = F.array(F.struct(F.lit(None).cast("int").alias("pos"), F.lit(None).cast("bigint").alias("hash")))
    places = listed.select("row_id", "doc_id", "n_words", F.inline(F.concat(none, "grams")).alias("pos", "hash"))
    hits = places.join(templates(docs.sparkSession, settings), "hash", "left").filter(F.col("template").isNotNull() | F.col("hash").isNull())
    votes = (
        hits.groupBy("row_id", "doc_id", "n_words", "template", "label", "phrase", "k", "n", (F.col("pos") - F.col("at")).alias("diagonal"))
        .agg(F.collect_set("at").alias("ats"), F.min("pos").alias("low"), F.max("pos").alias("high"))
        .filter(F.col("template").isNull() | ~F.col("phrase") | (F.size("ats") == F.col("n") - 1))
    )
    by_row = Window.partitionBy("row_id").orderBy("template", "diagonal")
    before = lambda c: F.lag(c).over(by_row)
    follows = ~F.col("phrase") & (before("template") == F.col("template")) & (F.col("diagonal") - before("diagonal") <= settings.gap)
    numbered = votes.withColumn("new", F.when(follows, 0).otherwise(1)).withColumn("span", F.sum("new").over(by_row))
    merged = numbered.groupBy("row_id", "span").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "n_words", "label", "phrase", "k", "n")],
        F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"),
        F.min("diagonal").alias("diagonal"), F.min("low").alias("low"), F.max("high").alias("high"),
    )
    hit_words = F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + F.col("k") - 1))))
    sized = merged.withColumn("hit", F.size(hit_words)).withColumn("length", F.col("high") - F.col("low") + F.col("k"))
    # a span of one template is no longer than that template and its gaps
    fits = (F.col("hit") >= F.col("n") * settings.coverage) & (F.col("length") <= F.col("n") + settings.gap * 4)
    found = lambda c: F.when(F.coalesce(fits, F.lit(False)), c)
    return sized.select(
        "row_id", "doc_id", "n_words",
        found(F.col("label")).alias("label"), found(F.col("phrase")).alias("phrase"),
        found(F.when(F.col("phrase"), F.col("diagonal")).otherwise(F.col("low"))).cast("bigint").alias("first"),
        found(F.col("high") + F.col("k")).cast("bigint").alias("past"),
        found(F.col("hit") / F.col("n")).alias("coverage"),
        found(F.col("hit") / F.greatest("n", "length")).alias("score"),
    )


def op6_license_scan(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Licenses of every row of ``docs`` (doc_id, text).

    Null and empty texts have no word and no label. Rows that repeat are scanned each by
    itself; an empty table gives no rows. Very long texts are read whole: their hits are rows,
    not one cell. A notice is told from others by 64-bit hashes of four words.
    """
    found = spans(docs, settings)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    base = F.col("phrase")
    return found.groupBy("row_id").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined("label").alias("labels"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("score"),
    ).drop("row_id")


def op6_sql(settings: Settings = Settings()) -> str:
    """The same in SQL, word by word: runs of equal words on a diagonal in place of hashes of grams."""
    values = ", ".join(f"({n}, {phrase}, '{label}', {w})" for n, phrase, label, _, w in settings.listed())
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH texts AS (
    SELECT row_number() OVER () AS row_id, doc_id,
        list_filter(string_split_regex(translate(coalesce("text", ''), '{upper}', '{lower}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
    FROM documents),
given AS (SELECT * FROM (VALUES {values}) AS v(template, phrase, label, tw)),
heard AS (SELECT row_id, i AS pos, ws[i] AS w FROM texts, unnest(range(1, len(ws) + 1)) AS r(i)),
bases AS (
    SELECT h.row_id, label, pos - 1 AS first
    FROM heard AS h JOIN given ON phrase AND h.w = tw[1] JOIN texts AS t ON t.row_id = h.row_id
    WHERE t.ws[pos:pos + len(tw) - 1] = tw),
asked AS (SELECT template, label, len(tw) AS n, i AS nth, tw[i] AS w FROM given, unnest(range(1, len(tw) + 1)) AS r(i) WHERE NOT phrase),
equal AS (
    SELECT row_id, template, label, n, pos, nth, pos - nth AS diagonal, pos - row_number() OVER (PARTITION BY row_id, template, pos - nth ORDER BY pos) AS run
    FROM heard JOIN asked USING (w)),
long AS (SELECT * FROM equal QUALIFY count(*) OVER (PARTITION BY row_id, template, diagonal, run) >= {settings.gram}),
marked AS (
    SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY row_id, template ORDER BY diagonal, pos) <= {settings.gap} THEN 0 ELSE 1 END AS fresh
    FROM long),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY row_id, template ORDER BY diagonal, pos) AS span FROM marked),
notices AS (
    SELECT row_id, label, count(DISTINCT nth) / greatest(n, max(pos) - min(pos) + 1)::DOUBLE AS score
    FROM numbered GROUP BY row_id, template, span, label, n
    HAVING count(DISTINCT nth) >= n * {settings.coverage}::DOUBLE AND max(pos) - min(pos) + 1 <= n + {settings.gap * 4}),
spans AS (SELECT row_id, label, first, 1.0::DOUBLE AS score FROM bases UNION ALL SELECT row_id, label, NULL, score FROM notices)
SELECT any_value(doc_id) AS doc_id, any_value(len(ws)) AS n_words, count(first) AS n_base, min(first) AS first_word, max(first) AS last_word,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (first IS NOT NULL), '') AS base_labels,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(score), 0.0)::DOUBLE AS score
FROM texts LEFT JOIN spans USING (row_id) GROUP BY row_id
"""
