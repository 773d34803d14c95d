"""Licence scans: normalised text against templates by Dice coefficient over word bigrams.

Every window of a text's words is a unit: a notice is found amid prose, wrapped over lines or in one. A text
that reaches a coefficient t with a template of m different bigrams somewhere shares at least
t / (2 - t) * m of them: this bound prunes (text, template) pairs before any window is laid. Bigrams are
looked up in one table of all templates', so that a template more costs rows of that table, not an expression.

Windows begin and end at bigrams of the template and span at most twice as many bigrams as it has. A
window's bigrams count once where they are the template's, each time where they aren't. Spark functions
alone; texts themselves aren't shuffled, only the looked-up bigrams of a text, which meet in a row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

LEAST = 0.8
# Licence texts, their standard headers and one-line grants.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "GPL-2.0": (
        "This program is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ),
    "LGPL-3.0": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MIT": (
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "ISC": (
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    "BSD-2-Clause": (
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    ),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "Proprietary": ("All rights reserved.",),
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Templates = dict[str, tuple[str, ...]]


def words_of(text: str) -> list[str]:
    return "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in text).split()


def bigrams_of(text: str) -> list[tuple[str, str]]:
    words = words_of(text)
    return sorted(set(zip(words, words[1:])))


def words(text: Column) -> Column:
    """Words of ASCII letters and digits, lower-cased; other letters belong to words of their own."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), r"[\x00-/:-`{-\x7F]+"), lambda w: w != "")


def _rows(templates: Templates, least: float) -> list[tuple[str, int, int, int, int, str, str]]:
    """(license, template, its bigrams, how many of them a text must have, bigram, its two words) for all templates of two words or more."""
    out, t = [], 0
    for name, texts in templates.items():
        for text in texts:
            grams = bigrams_of(text)
            need = math.ceil(least / (2 - least) * len(grams) - 1e-9)
            out += [(name, t, len(grams), need, b, *g) for b, g in enumerate(grams)]
            t += 1
    return out


def scan(docs: DataFrame, templates: Templates = TEMPLATES, least: float = LEAST) -> DataFrame:
    """One row a document: doc_id, license, score, first_word, n_words.

    The window that shares most bigrams with a template, of those that reach `least`; then the highest
    score, the smallest name, the earliest and shortest window. Words count from 0. Nulls where nothing
    reaches `least`, also for null and empty texts. Repeated rows are scanned each; other columns are ignored;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame(_rows(templates, least), "license string, t int, m int, need int, b int, one string, other string")
    # As long as the templates that were given: safe to send to all.
    known = known.groupBy(F.xxhash64("one", "other").alias("g")).agg(F.collect_list(F.struct("t", "m", "need", "license", "b")).alias("of"))
    text = F.col("text").cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns({"k": F.xxhash64("doc_id", "text"), "l": F.xxhash64(F.lit(1), "doc_id", "text")})
    listed = slim.select("k", "l", words(F.col("text")).alias("words")).where(F.size("words") > 1)
    grams = F.transform(F.slice("words", F.lit(1), F.size("words") - 1), lambda w, i: F.xxhash64(w, F.get("words", i + 1)))
    hits = listed.select("k", "l", F.posexplode(grams).alias("i", "g")).join(F.broadcast(known), "g")
    hits = hits.select("k", "l", "i", F.explode("of").alias("x")).select("k", "l", "x.t", "x.m", "x.need", "x.license", F.struct("i", "x.b").alias("hit"))
    # A set: equal documents have the same bigrams at the same places.
    found = hits.groupBy("k", "l", "t", "m", "need", "license").agg(F.sort_array(F.collect_set("hit")).alias("hits"))
    found = found.where(F.size(F.array_distinct(F.col("hits.b"))) >= F.col("need"))
    none = F.struct(F.lit(0).alias("minus_common"), F.lit(0.0).alias("minus_score"), F.lit(0).alias("start"), F.lit(0).alias("end"))

    def windows(x: Column, s: Column) -> Column:
        """The best window that begins at a hit."""

        def step(acc: Column, y: Column) -> Column:
            seen, n = F.array_union(acc["seen"], F.array(y["b"])), acc["n"] + 1
            span, common = y["i"] - x["i"] + 1, F.size(seen)
            score = 2.0 * common / (span - n + common + F.col("m"))
            own = F.struct((-common).alias("minus_common"), (-score).alias("minus_score"), x["i"].alias("start"), y["i"].alias("end"))
            fits = (score >= least) & (span <= 2 * F.col("m"))
            return F.struct(seen.alias("seen"), n.alias("n"), F.when(fits, F.least(acc["best"], own)).otherwise(acc["best"]).alias("best"))

        start = F.struct(F.array().cast("array<int>").alias("seen"), F.lit(0).alias("n"), none.alias("best"))
        return F.aggregate(F.slice("hits", s + 1, 2 * F.col("m")), start, step, lambda acc: acc["best"])

    best = found.select("k", "l", "license", F.array_min(F.transform("hits", windows)).alias("w")).where("w.minus_common < 0")
    top = F.min(F.struct("w.minus_common", "w.minus_score", "license", "w.start", "w.end")).alias("top")
    best = written(best.groupBy("k", "l").agg(top))
    rows = slim.select("doc_id", "k", "l").join(best, ["k", "l"], "left")
    length = (F.col("top.end") - F.col("top.start") + 2).alias("n_words")
    return rows.select("doc_id", F.col("top.license").alias("license"), (-F.col("top.minus_score")).alias("score"), F.col("top.start").alias("first_word"), length)


def scan_sql(templates: Templates = TEMPLATES, least: float = LEAST) -> str:
    """The same for DuckDB, over documents."""
    rows = ", ".join(f"('{n}', {t}, {m}, {need}, {b}, '{x} {y}')" for n, t, m, need, b, x, y in _rows(templates, least))
    return rf"""WITH t AS (SELECT * FROM (VALUES {rows}) AS v(license, t, m, need, b, g)),
  d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
  w AS (SELECT r, list_filter(string_split_regex(translate(text, '{UPPER}', '{LOWER}'), '[\x00-/:-`{{-\x7F]+'), lambda y: y <> '') AS ws FROM d),
  g AS (SELECT r, unnest(range(len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS g FROM w WHERE len(ws) > 1),
  h AS (SELECT r, license, t, m, need, i, b FROM g JOIN t USING (g)),
  n AS (SELECT r, t FROM h GROUP BY r, t, need HAVING count(DISTINCT b) >= need),
  f AS (SELECT h.* FROM h JOIN n USING (r, t)),
  x AS (SELECT a.r, a.license, a.m, a.i AS s, e.i AS e, count(*) AS hits, count(DISTINCT z.b) AS common FROM f a
    JOIN f e ON a.r = e.r AND a.t = e.t AND e.i BETWEEN a.i AND a.i + 2 * a.m - 1 JOIN f z ON z.r = a.r AND z.t = a.t AND z.i BETWEEN a.i AND e.i
    GROUP BY a.r, a.t, a.license, a.m, a.i, e.i),
  y AS (SELECT *, 2.0::DOUBLE * common / (e - s + 1 - hits + common + m) AS score FROM x),
  b AS (SELECT * FROM y WHERE score >= {least} QUALIFY row_number() OVER (PARTITION BY r ORDER BY common DESC, score DESC, license, s, e) = 1)
SELECT doc_id, license, score, CAST(s AS INTEGER) AS first_word, CAST(e - s + 2 AS INTEGER) AS n_words FROM d LEFT JOIN b USING (r)"""
