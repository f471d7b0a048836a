"""License scans: MinHash bands over overlapping word windows retrieve templates, exact containment verifies them.

Texts and templates are cut into 5-word shingles. Long templates are matched through windows of 8 shingles, every
fourth start in a text and every start in a template, so a verbatim copy of 11 shingles or more always meets an aligned
window; with 4 bands of one MinHash each, a window that shares 3 of 4 shingles collides in some band with probability
above 0.996, and a template has several windows. Templates under 11 shingles use windows of one shingle, whose MinHash is
the shingle itself, so that collision is certain. Everything on this path is a DataFrame expression, and a text never
leaves its row before verification: there is no shuffle of texts.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 5
WINDOW = 8
STRIDE = 4
BANDS = 4
CONTAINMENT = 0.8

# Public licence notices.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-3-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "bsl-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "apache-2.0-applied": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0-applied": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: Column, size: int = WORDS) -> Column:
    """Joined runs of size words; a shorter text is one shingle, one without words has none."""
    runs = F.transform(w, lambda x, i: F.concat_ws(" ", x, *[F.get(w, i + k) for k in range(1, size)]))
    return F.slice(runs, 1, F.greatest(F.size(w) - (size - 1), F.least(F.size(w), F.lit(1))))


def shingle_hashes(w: Column, size: int = WORDS) -> Column:
    """A hash of each shingle, in order."""
    runs = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, size)]))
    return F.slice(runs, 1, F.greatest(F.size(w) - (size - 1), F.least(F.size(w), F.lit(1))))


def _permuted(h: Column, band: int) -> Column:
    """The band's order of shingle hashes: rotated bits, then an exclusive-or with a constant of the band."""
    turn = 16 * band
    return F.transform(h, lambda x: (F.shiftleft(x, turn).bitwiseOR(F.shiftrightunsigned(x, 64 - turn)) if turn else x).bitwiseXOR(F.lit(0x5851F42D4C957F2D * (band + 1) % (1 << 63))))


def with_permutations(df: DataFrame) -> DataFrame:
    """Add p0, p1, ...: the shingle hashes h in each band's order, as columns of their own so that windows share them."""
    return df.select("*", *[_permuted(F.col("h"), b).alias(f"p{b}") for b in range(BANDS)])


def window_keys(stride: int) -> Column:
    """MinHashes of the long windows of p0, p1, ...; the last window is always taken. Shorter texts have none."""
    per_band = []
    for b in range(BANDS):
        p = F.col(f"p{b}")
        last = F.size(p) - WINDOW
        starts = F.sequence(F.lit(0), last + (stride - 1), F.lit(stride))
        per_band.append(F.when(last >= 0, F.transform(starts, _window(b))).otherwise(F.array().cast("array<bigint>")))
    return F.concat(*per_band)


def _window(band: int):
    p = F.col(f"p{band}")

    def minimum(i: Column) -> Column:
        return F.least(*[F.get(p, F.least(i, F.size(p) - WINDOW) + k) for k in range(WINDOW)])

    return minimum


def template_keys(spark: SparkSession, templates: dict[str, str]) -> tuple[DataFrame, list[int], list[int]]:
    """(template_id, shingles, key) of the library, and the keys of long and of short windows. Its size is the library's."""
    table = spark.createDataFrame(list(templates.items()), "template_id string, body string")
    s = table.select("template_id", words(F.col("body")).alias("words")).select("template_id", shingles(F.col("words")).alias("shingles"), shingle_hashes(F.col("words")).alias("h"))
    s = with_permutations(s)
    long = F.size("h") >= WINDOW + STRIDE - 1
    keyed = s.select("template_id", F.array_distinct("shingles").alias("shingles"), long.alias("is_long"), F.explode(F.array_distinct(F.when(long, window_keys(1)).otherwise(F.col("h")))).alias("key"))
    rows = keyed.select("is_long", "key").distinct().collect()
    return keyed, [r["key"] for r in rows if r["is_long"]], [r["key"] for r in rows if not r["is_long"]]


def _by_key(keyed: DataFrame) -> Column:
    """A literal map from each key to the templates that have it; the library is bounded by the caller."""
    rows = keyed.groupBy("key").agg(F.sort_array(F.collect_set("template_id")).alias("of")).collect()
    return F.from_json(F.lit(json.dumps({str(r["key"]): r["of"] for r in rows})), "map<string,array<string>>")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """Return (doc_id, template_id, n_shared, n_template, containment) for texts that hold a template.

    containment is the share of the template's distinct shingles in the text, at least the given bound. Null and empty
    texts match nothing; very long texts are scanned whole; rows with one doc_id, repeated or not, give one row a template,
    that of the best match; no rows give no rows. Other columns of docs are not read, so that no name can clash. The library
    is bounded by the caller: its keys are literals of the plan.
    """
    spark = docs.sparkSession
    keyed, long_keys, short_keys = template_keys(spark, templates or TEMPLATES)
    library = F.broadcast(keyed.select("template_id", F.col("shingles").alias("wanted")).dropDuplicates(["template_id"]))
    w = docs.select("doc_id", words(F.coalesce("text", F.lit(""))).alias("words"))
    s = with_permutations(w.select("doc_id", "words", shingle_hashes(F.col("words")).alias("h")))
    none = F.array().cast("array<bigint>")
    hits = F.concat(
        F.filter(window_keys(STRIDE), lambda k: k.isin(long_keys)) if long_keys else none,
        F.filter("h", lambda k: k.isin(short_keys)) if short_keys else none,
    )
    # keys become templates inside the row, so that each text is verified once against each template
    by_key = _by_key(keyed)
    of = F.array_distinct(F.flatten(F.transform(hits, lambda k: by_key[k.cast("string")])))
    candidates = s.select("doc_id", "words", F.explode(of).alias("template_id")).join(library, "template_id")
    found = candidates.withColumn("n_shared", F.size(F.array_intersect("wanted", shingles(F.col("words")))))
    found = found.select("doc_id", "template_id", F.col("n_shared").cast("long").alias("n_shared"), F.size("wanted").cast("long").alias("n_template"))
    best = found.groupBy("doc_id", "template_id", "n_template").agg(F.max("n_shared").alias("n_shared"))
    best = best.withColumn("containment", F.col("n_shared") / F.col("n_template")).where(F.col("containment") >= containment)
    return best.select("doc_id", "template_id", "n_shared", "n_template", "containment")


def _oracle() -> str:
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
    cut = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    grams = "CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
    return f"""
WITH t AS (SELECT template_id, {cut.format('body')} AS w FROM (VALUES {values}) v(template_id, body)),
ts AS (SELECT DISTINCT template_id, unnest({grams}) AS s FROM t),
n AS (SELECT template_id, count(*) AS n_template FROM ts GROUP BY 1),
d AS (SELECT doc_id, {cut.format("coalesce(text, '')")} AS w FROM documents),
ds AS (SELECT doc_id, unnest({grams}) AS s FROM d),
m AS (SELECT doc_id, template_id, count(DISTINCT ds.s) AS n_shared FROM ds JOIN ts ON ds.s = ts.s GROUP BY 1, 2)
SELECT doc_id, template_id, n_shared, n_template, n_shared::DOUBLE / n_template AS containment
FROM m JOIN n USING (template_id) WHERE n_shared::DOUBLE / n_template >= 0.8
"""


ORACLE_SQL = _oracle()
