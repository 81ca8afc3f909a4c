"""License scans by diagonal voting.

The hash of every run of three words of a text (and of two, for templates so short) is
joined to the places of the same run in the license templates, and a match counts only if
the words of the run are the template's too. A match votes for the diagonal text place -
template place; neighbouring diagonals, which words put in or left out set apart, are
merged into one span, and a span is verified by the share of the template's runs that it
covers. A base phrase counts where one diagonal has all its runs.

Templates are phrases of notices and whole license texts, of any length: matched runs are
kept as bits in words of 64. They are fixed, below a thousand rows, and broadcast. Matches
of one text are summed before they are shuffled; repeated rows are found to be copies by
their count and given out again at the end.

Null texts are empty; an empty text gives no words, no places, no labels and score 0.
Very long texts are handled like others. Rows with a null id keep their rows. Ties do not
arise: labels are sets, and spans stand in the order of the text. Columns other than the
id and the text are not used, whatever their names. An empty table gives no rows. Uses
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table

# The base phrases with their labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Wordings of public license notices with the labels that this scan adds.
TEMPLATES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("under the terms of the gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("has waived all copyright and related or neighboring rights to this work", "cc0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa-4.0"),
]

# Whole texts of public licenses with the labels that this scan adds.
TEXTS = [
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished "
        "to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
        "noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from "
        "out of or in connection with the software or the use or other dealings in the software",
        "mit",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice "
        "appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action "
        "of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "isc",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain "
        "the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
        "following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express "
        "or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or "
        "contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use "
        "data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way "
        "out of the use of this software even if advised of the possibility of such damage",
        "bsd-2-clause",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is "
        "granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of "
        "this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would "
        "be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed "
        "or altered from any source distribution",
        "zlib",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org "
        "licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of "
        "any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache-2.0",
    ),
]

COVERED = 0.7
NEIGHBOURS = 2
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _listed() -> list[tuple[str, str, bool]]:
    return [(p, x, True) for p, x in BASE.items()] + [(p, x, False) for p, x in TEMPLATES + TEXTS]


def templates(spark: SparkSession) -> DataFrame:
    """hash, run, k, template, base, label, runs, place: a row for each run of words of each template (of two words or three)."""
    rows = []
    for t, (phrase, label, base) in enumerate(_listed()):
        words = phrase.split()
        k = min(3, len(words))
        for i in range(len(words) - k + 1):
            run = " ".join(words[i : i + k])
            rows.append(f"(xxhash64('{run}'), '{run}', {k}, {t}, {str(base).lower()}, '{label}', {len(words) - k + 1}, {i})")
    # The row that every text matches once, so that it is there whether or not a template is.
    rows.append("(xxhash64(''), '', 0, -1, false, '', 1, 0)")
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(hash, run, k, template, base, label, runs, place)")


def votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, template, diagonal, part, mask of the matched template runs 64 * part and following, n_words and rows; template -1 stands for the text itself."""
    # U+212A is the one letter beyond ASCII whose lower case is an ASCII letter.
    text = F.lower(F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.array_remove(F.split(text, NO_WORD, -1), "").alias("words"))
    texts = texts.withColumn("n_words", F.size("words"))
    two = F.zip_with("words", F.expr("slice(words, 2, n_words)"), lambda a, b: F.concat(a, F.lit(" "), b))
    runs = texts.select("doc_id", "text_hash", "n_words", two.alias("two"), F.expr("slice(words, 3, n_words)").alias("third"))
    three = F.zip_with("two", "third", lambda h, c: F.concat(h, F.lit(" "), c))
    listed = runs.select("doc_id", "text_hash", "n_words", F.concat(F.array(F.lit("")), "two", three).alias("listed"))
    each = listed.select("doc_id", "text_hash", "n_words", F.posexplode_outer("listed").alias("at", "run"))
    # The outer form, as Spark puts a filter that makes the runs again below the plain one; no array is empty.
    # Place 0 is the text's own row, then come the runs of two words, then those of three.
    kind = F.when(F.col("at") == 0, 0).when(F.col("at") <= F.col("n_words"), 2).otherwise(3)
    start = F.when(F.col("at") == 0, 0).when(F.col("at") <= F.col("n_words"), F.col("at") - 1).otherwise(F.col("at") - 1 - F.col("n_words"))
    hashed = each.withColumn("hash", F.xxhash64("run"))
    met = hashed.join(F.broadcast(templates(docs.sparkSession)), ["hash", "run"]).where(F.col("k") == kind)
    met = met.withColumn("diagonal", start - F.col("place")).withColumn("part", F.shiftright("place", 6))
    bit = F.expr("shiftleft(1L, place & 63)")
    return met.groupBy("doc_id", "text_hash", "template", "base", "label", "runs", "diagonal", "part").agg(F.bit_or(bit).alias("mask"), F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("rows"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each span of each template in a text: its first diagonal, share of the template's runs, and the base places in it."""
    voted = votes(docs, id_col, text_col)
    # Diagonals of one text meet in one place; merging them there keeps the text's own row beside them.
    order = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal", "part")
    near = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) <= NEIGHBOURS, F.lit(False))
    parts = voted.withColumn("span", F.sum(F.when(near, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    key = ["doc_id", "text_hash", "template", "base", "label", "runs"]
    # A base phrase has one part only.
    whole = F.col("base") & (F.bit_count("mask") == F.col("runs"))
    parts = parts.groupBy(*key, "span", "part").agg(
        F.bit_or("mask").alias("mask"), F.max("n_words").alias("n_words"), F.max("rows").alias("rows"), F.min("diagonal").alias("diagonal"),
        F.sum(whole.cast("long")).alias("places"), F.min(F.when(whole, F.col("diagonal"))).alias("first"), F.max(F.when(whole, F.col("diagonal"))).alias("last"))
    merged = parts.groupBy(*key, "span").agg(
        F.sum(F.bit_count("mask")).alias("hit"), F.max("n_words").alias("n_words"), F.max("rows").alias("rows"), F.min("diagonal").alias("diagonal"),
        F.sum("places").alias("places"), F.min("first").alias("first"), F.max("last").alias("last"))
    return merged.withColumn("share", F.when(F.col("template") < 0, 0.0).otherwise(F.col("hit") / F.col("runs")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", covered: float = COVERED) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and verified spans (start, label, share) of each row of docs."""
    merged = spans(docs, id_col, text_col)
    verified = (F.col("template") >= 0) & (F.col("share") >= covered)
    based = F.when(F.col("places") > 0, F.col("label"))
    added = F.when(verified & ~F.col("base"), F.col("label"))
    found = merged.groupBy("doc_id", "text_hash").agg(
        F.max(F.when(F.col("template") < 0, F.col("n_words"))).cast("long").alias("n_words"), F.max(F.when(F.col("template") < 0, F.col("rows"))).alias("rows"),
        F.sum("places").alias("n_base"), F.min("first").cast("long").alias("first_word"), F.max("last").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(based)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.collect_set(based), F.collect_set(added))), ",").alias("labels"),
        F.max("share").alias("score"), F.sort_array(F.collect_list(F.when(verified, F.struct(F.greatest("diagonal", F.lit(0)).alias("start"), "label", "share")))).alias("spans"))
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("_copy", "rows", "text_hash")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its base places, labels and score."""
    return scan(table(spark, sf_dir, "documents")).drop("spans")


_LISTED = ", ".join(f"('{p}', '{x}', {str(base).lower()})" for p, x, base in _listed())

ORACLE_SQL = {
    "op8_license_scan": rf"""
WITH t AS (
  SELECT row_number() OVER () AS template, string_split(phrase, ' ') AS p, label, base FROM (VALUES {_LISTED}) AS v(phrase, label, base)),
tr AS (
  SELECT template, label, base, len(p) - least(3, len(p)) + 1 AS runs, i - 1 AS place, array_to_string(p[i : i + least(3, len(p)) - 1], ' ') AS run
  FROM (SELECT *, unnest(range(1, len(p) - least(3, len(p)) + 2)) AS i FROM t)),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
k AS (SELECT r, i - 1 AS start, unnest([array_to_string(w[i : i + 1], ' '), array_to_string(w[i : i + 2], ' ')]) AS run
      FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM d)),
m AS (SELECT DISTINCT r, template, label, base, runs, start - place AS diagonal, place FROM k JOIN tr USING (run)),
v AS (SELECT r, template, label, base, runs, diagonal, list(place) AS places, count(*) AS votes FROM m GROUP BY ALL),
n AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= {NEIGHBOURS} THEN 0 ELSE 1 END AS new FROM v),
s AS (SELECT *, sum(new) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM n),
g AS (
  SELECT r, template, label, base, len(list_distinct(flatten(list(places)))) / runs AS share,
         count(*) FILTER (base AND votes = runs) AS n_base, min(diagonal) FILTER (base AND votes = runs) AS f, max(diagonal) FILTER (base AND votes = runs) AS l
  FROM s GROUP BY r, template, label, base, runs, span),
a AS (
  SELECT r, sum(n_base) AS n_base, min(f) AS f, max(l) AS l, max(share) AS score,
         list(DISTINCT label) FILTER (n_base > 0) AS b, list(DISTINCT label) FILTER (n_base > 0 OR (NOT base AND share >= {COVERED})) AS x
  FROM g GROUP BY r)
SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, f AS first_word, l AS last_word,
       coalesce(array_to_string(list_sort(b), ','), '') AS base_labels, coalesce(array_to_string(list_sort(x), ','), '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN a ON d.r = a.r"""
}
