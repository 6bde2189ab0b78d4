"""Licence statements in documents, by Dice coefficient over word bigrams.

DataFrame functions only. A text is cut into lines, and into paragraphs of several lines (parted by blank lines). A unit is normalised to
lower-case words of ASCII letters and digits and compared with licence templates: twice the shared bigrams (counted with multiplicity)
over all bigrams of both. A Dice value of `least` or more needs a unit of at least least / (2 - least) and at most its inverse times
the template's bigrams, so word counts alone rule out most templates before any bigram is looked at. Bigrams then meet the (listed, hence small)
template bigrams in a broadcast join, which leaves a few rows to count; only those are shuffled.

Units without bigrams match nothing; null texts have no units. Of templates with equal value the first by name is reported. Repeated
rows are reported each. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmament.llm.common import LOWER, UPPER, lower_ascii, table
from firmament.llm.registry import query

LEAST = 0.75
#: Public licence notices: (licence, notice).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
     "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
     'to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
     "either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-3-Clause", "Redistributed under the BSD 3-Clause License"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
     "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
     "that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
     '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
     "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
     "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
     "Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
     "this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("All rights reserved", "All rights reserved"),
)


def template_bigrams(templates=TEMPLATES) -> list[tuple[int, str, str, str, int, int]]:
    """(number, licence, first word, second word, times, bigrams in all)."""
    out = []
    for k, (name, text) in enumerate(templates):
        words = re.findall("[a-z0-9]+", text.lower())
        pairs = Counter(zip(words, words[1:]))
        out += [(k, name, a, b, n, len(words) - 1) for (a, b), n in sorted(pairs.items())]
    return out


def bounds(n: Column, least: float) -> tuple[Column, Column]:
    return F.ceil(n * (least / (2 - least)) - 1e-9), F.floor(n * ((2 - least) / least) + 1e-9)


def scan_licenses(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(id, unit, unit_no, license, dice, n_bigrams) of every unit that reaches `least`."""
    rows = template_bigrams(templates)
    known = docs.sparkSession.createDataFrame(rows, "_t int, license string, _a string, _b string, _times int, _size int")
    sizes = [r[5] for r in rows]
    src = docs.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), F.col(text_col).cast("string").alias("_text"))

    def units(name: str, cut: str) -> DataFrame:
        return src.select("_id", "_row", F.lit(name).alias("unit"), F.posexplode(F.split("_text", cut)).alias("unit_no", "_unit"))

    parts = units("line", "\n").unionByName(units("paragraph", r"\n[ \t\r]*\n").where(F.instr("_unit", "\n") > 0))
    words = F.split(F.trim(F.regexp_replace(lower_ascii(F.col("_unit")), "[^a-z0-9]+", " ")), " ")
    lo, hi = int(min(sizes) * least / (2 - least)), int(max(sizes) * (2 - least) / least) + 1
    parts = parts.where(F.length("_unit") >= 2 * max(lo, 1) + 1).select("_id", "_row", "unit", "unit_no", words.alias("_w"))
    parts = parts.withColumn("n_bigrams", F.size("_w") - 1).where(F.col("n_bigrams").between(max(lo, 1), hi))
    pairs = parts.select("_id", "_row", "unit", "unit_no", "n_bigrams", F.inline(
        F.arrays_zip(F.slice("_w", F.lit(1), F.col("n_bigrams")).alias("_a"), F.slice("_w", F.lit(2), F.col("n_bigrams")).alias("_b"))).alias("_a", "_b"))
    low, high = bounds(F.col("_size"), least)
    met = pairs.join(F.broadcast(known), ["_a", "_b"]).where(F.col("n_bigrams").between(low, high))
    key = ["_id", "_row", "unit", "unit_no", "n_bigrams", "_t", "license", "_size"]
    shared = met.groupBy(*key, "_a", "_b", "_times").agg(F.count("*").alias("_n")).groupBy(*key).agg(
        F.sum(F.least("_n", "_times")).alias("_shared"))
    dice = shared.withColumn("dice", 2 * F.col("_shared") / (F.col("n_bigrams") + F.col("_size"))).where(F.col("dice") >= least)
    best = dice.groupBy("_id", "_row", "unit", "unit_no", "n_bigrams").agg(F.min(F.struct((-F.col("dice")).alias("d"), "license")).alias("m"))
    return best.select(F.col("_id").alias(id_col), "unit", F.col("unit_no").cast("long"), F.col("m.license").alias("license"),
                       (-F.col("m.d")).alias("dice"), F.col("n_bigrams").cast("long"))


def _sql() -> str:
    known = ", ".join(f"({k}, '{name}', '{a}', '{b}', {n}, {size})" for k, name, a, b, n, size in template_bigrams())
    return rf"""
WITH known(t, license, a, b, times, size) AS (VALUES {known}),
    cut AS (SELECT doc_id, 'line' AS unit, unnest(string_split(text, chr(10))) AS u, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS unit_no
            FROM documents UNION ALL
        SELECT * FROM (SELECT doc_id, 'paragraph', unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) AS u,
            generate_subscripts(regexp_split_to_array(text, '\n[ \t\r]*\n'), 1) - 1 FROM documents) WHERE contains(u, chr(10))),
    worded AS (SELECT doc_id, unit, unit_no, regexp_extract_all(translate(u, '{UPPER}', '{LOWER}'), '[a-z0-9]+') AS w FROM cut),
    pairs AS (SELECT doc_id, unit, unit_no, len(w) - 1 AS n, unnest(list_zip(w[1:-2], w[2:])) AS p FROM worded WHERE len(w) > 1),
    counted AS (SELECT doc_id, unit, unit_no, n, p[1] AS a, p[2] AS b, count(*) AS c FROM pairs GROUP BY ALL),
    shared AS (SELECT doc_id, unit, unit_no, n, t, license, size, sum(least(c, times)) AS s
        FROM counted JOIN known USING (a, b) GROUP BY ALL),
    scored AS (SELECT *, (2 * s)::DOUBLE / (n + size) AS dice FROM shared)
SELECT doc_id, unit, unit_no::BIGINT AS unit_no, license, dice, n::BIGINT AS n_bigrams FROM scored WHERE dice >= {LEAST}
QUALIFY row_number() OVER (PARTITION BY doc_id, unit, unit_no ORDER BY dice DESC, license) = 1"""


@query("op6_license_scan", sql=_sql())
def op6_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))
