"""License scans by diagonal voting, in DataFrame functions only.

Every rolling k-gram of a text's words is hashed and joined with the k-grams of the license templates (a
fixed table of this module, broadcast for that reason); the words of a match are compared as well, so
a vote is never a hash collision. A vote falls on the diagonal (place in the text minus place in the
template). Votes are summed by document, template and diagonal; neighbouring diagonals are merged, which
forgives inserted or missing words. A merged span is verified on its words: its score is the share of the longer of
the template and the span that matches, so words that are scattered over a wide stretch are no license.

Whole licenses and their notices count from ``COVERAGE`` on. The short phrases and grants are templates too, and must
be met in full on one diagonal: that is exactly one place where their words stand in a row.

A sentinel k-gram in every document carries its word count through the same join, so the texts are
read and cut into words once. Null and empty texts have no words, no labels and score 0; a very long text is whole.
Of spans with equal scores each gives its label. Repeated rows are told apart by their place in the input, which must
be a stable scan, and each get a row. Other columns are not read, so their names cannot clash. No rows give no rows.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.quality import let

K = 3
NEIGHBOUR = 3
COVERAGE = 0.6
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Short grants, met in full like the phrases, but labels of the method.
GRANTS = {
    "gnu general public license version 3": "gpl-3", "gnu general public license version 2": "gpl-2", "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl",
    "the apache license": "apache-2", "mozilla public license": "mpl-2", "released under the bsd license": "bsd", "under the bsd license": "bsd", "bsd 3 clause license": "bsd", "bsd 2 clause license": "bsd",
    "the isc license": "isc", "cc by sa": "cc-by-sa", "cc by 4 0": "cc-by", "creative commons attribution sharealike": "cc-by-sa", "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution 4 0": "cc-by", "dedicated to the public domain": "public-domain",
}
# Texts of public licenses and of their notices.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without
        restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
        AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
        OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
        ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must
        retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS
        OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
        CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
        USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
        WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:""",
    "apache-2": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either
        version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "mpl-2": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
        https://mozilla.org/MPL/2.0/.""",
}
_BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _rows() -> list[tuple[str, int, int, int, str, bool, bool]]:
    """(gram, template, place, n_grams, label, phrase, exact) of all templates; ``exact`` ones must be met in full."""
    every = [(x, label, phrase, True) for table, phrase in ((PHRASES, True), (GRANTS, False)) for x, label in table.items()] + [(x, label, False, False) for label, x in TEMPLATES.items()]
    out = []
    for i, (text, label, phrase, exact) in enumerate(every):
        words = re.findall("[0-9a-z]+", text.lower())
        out += [(" ".join(words[j : j + K]), i, j, len(words) - K + 1, label, phrase, exact) for j in range(len(words) - K + 1)]
    return out


def words_of(text: Column) -> Column:
    """Words after ASCII lower-casing. U+212A, the one character that lower() turns into an ASCII letter alone, is kept apart."""
    low = F.lower(F.replace(text, F.lit("\u212a"), F.lit("\ue000")))
    return F.array_remove(F.split(low, _BREAK), "")


def _templates(spark: SparkSession) -> DataFrame:
    """:func:`_rows` with a hash of each gram. ``template`` -1 is the sentinel."""
    table = spark.createDataFrame([*_rows(), ("", -1, 0, 1, "", False, False)], "gram string, template int, place int, n_grams int, label string, phrase boolean, exact boolean")
    return table.withColumn("hash", F.xxhash64("gram"))


def votes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(rid, doc_id, n_words, template, n_grams, label, phrase, exact, diagonal, place): one row a vote, and one sentinel row a document."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), words_of(F.coalesce(F.col(text), F.lit(""))).alias("words"))

    def rolled(words: Column) -> Column:
        gram = lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(K)])
        grams = F.when(F.size(words) < K, F.array().cast("array<struct<i:int,hash:bigint,gram:string>>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(words) - K), lambda i: let(gram(i), lambda g: F.struct(i.alias("i"), F.xxhash64(g).alias("hash"), g.alias("gram"))))
        )
        mark = F.struct(F.lit(0).alias("i"), F.xxhash64(F.lit("")).alias("hash"), F.lit("").alias("gram"))
        return F.struct(F.size(words).cast("long").alias("n_words"), F.array_append(grams, mark).alias("grams"))

    rows = rows.select("rid", "doc_id", let(F.col("words"), rolled).alias("w")).select("rid", "doc_id", "w.n_words", F.inline("w.grams").alias("i", "hash", "gram"))
    found = rows.join(F.broadcast(_templates(docs.sparkSession)), ["hash", "gram"])
    return found.select("rid", "doc_id", "n_words", "template", "n_grams", "label", "phrase", "exact", (F.col("i") - F.col("place")).alias("diagonal"), "place")


def scan_licenses(docs: DataFrame, *, coverage: float = COVERAGE, neighbour: int = NEIGHBOUR, **columns: str) -> DataFrame:
    """One row a document: doc_id, n_words, places (struct of label, first word, last word, score, phrase)."""
    key = ["rid", "doc_id", "n_words", "template", "n_grams", "label", "phrase", "exact"]
    lines = votes(docs, **columns).groupBy(*key, "diagonal").agg(F.collect_set("place").alias("covered"))
    # Merge: a new span begins where the next diagonal of a template is further off than ``neighbour`` (exact ones: on every diagonal).
    order = Window.partitionBy("rid", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > F.when(F.col("exact"), 0).otherwise(neighbour), F.lit(True))
    lines = lines.withColumn("span", F.sum(fresh.cast("int")).over(order))
    lines = lines.withColumn("first", F.col("diagonal") + F.array_min("covered")).withColumn("last", F.col("diagonal") + F.array_max("covered"))
    spans = lines.groupBy(*key, "span").agg(F.array_distinct(F.flatten(F.collect_list("covered"))).alias("covered"), F.min("first").alias("first"), F.max("last").alias("last"))
    # Verify: how much of the template, and of the stretch of text, matches.
    spans = spans.withColumn("score", F.size("covered") / F.greatest("n_grams", F.col("last") - F.col("first") + 1))
    place = F.struct("label", F.col("first").cast("long").alias("first_word"), (F.col("last") + (K - 1)).cast("long").alias("last_word"), "score", "phrase")
    good = F.when(F.col("exact"), F.col("score") == 1.0).otherwise(F.col("score") >= coverage)
    best = F.max(F.when(F.col("template") >= 0, F.col("score")))
    return spans.groupBy("rid", "doc_id", "n_words").agg(F.collect_list(F.when((F.col("template") >= 0) & good, place)).alias("places"), F.coalesce(best, F.lit(0.0)).alias("score")).drop("rid")


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("places", lambda p: p["phrase"])
    named = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda p: p["label"]))), ",")
    starts = F.transform(base, lambda p: p["first_word"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        named(base).alias("base_labels"), named(F.col("places")).alias("labels"), "score",
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _op8_sql() -> str:
    rows = [f"('{g}', {i}, {j}, {n}, '{label}', {str(phrase).lower()}, {str(exact).lower()})" for g, i, j, n, label, phrase, exact in _rows()]
    capitals = reduce(lambda x, c: f"replace({x}, '{c}', '{c.lower()}')", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "coalesce(text, '')")
    return rf"""
WITH t(gram, template, place, n_grams, label, phrase, exact) AS (VALUES {", ".join(rows)}),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex({capitals}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT rid, p - 1 AS i, array_to_string(ws[p : p + {K - 1}], ' ') AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - {K - 2})) AS p FROM d WHERE len(ws) >= {K})),
v AS (SELECT DISTINCT rid, template, n_grams, label, phrase, exact, i, i - place AS diagonal, place FROM g JOIN t USING (gram)),
l AS (SELECT DISTINCT rid, template, exact, diagonal FROM v),
f AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) <= CASE WHEN exact THEN 0 ELSE {NEIGHBOUR} END THEN 0 ELSE 1 END AS fresh FROM l),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, template ORDER BY diagonal) AS span FROM f),
c AS (SELECT v.rid, v.template, v.label, v.phrase, v.exact, s.span, count(DISTINCT place) / CAST(greatest(n_grams, max(i) - min(i) + 1) AS DOUBLE) AS score, min(i) AS first
      FROM v JOIN s ON v.rid = s.rid AND v.template = s.template AND v.diagonal = s.diagonal GROUP BY v.rid, v.template, v.label, v.phrase, v.exact, s.span, n_grams),
p AS (SELECT rid, max(score) AS score, count(*) FILTER (WHERE phrase AND score = 1) AS n_base, min(first) FILTER (WHERE phrase AND score = 1) AS first_word, max(first) FILTER (WHERE phrase AND score = 1) AS last_word,
             array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE phrase AND score = 1))), ',') AS base_labels,
             array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE CASE WHEN exact THEN score = 1 ELSE score >= {COVERAGE} END))), ',') AS labels FROM c GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN p USING (rid)
"""


OP8_SQL = _op8_sql()
