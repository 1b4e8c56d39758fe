"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, documents, materialise, split_words
from .linededup import lines_of

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS"""

_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.
"""

_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_GNU_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU %s General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU %s General Public License for more details.
You should have received a copy of the GNU %s General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

#: Licence notices, file headers and short licences as published, by SPDX id.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License.""",
    ],
    "MIT": [
        "Released under the MIT License.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
"""
        + _AS_IS
        + """ OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", _GNU_HEADER.replace("%s ", "")],
    "LGPL-3.0": [_GNU_HEADER.replace("%s", "Lesser")],
    "AGPL-3.0": [_GNU_HEADER.replace("%s", "Affero")],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "BSD-2-Clause": [_BSD_START + _BSD_END],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        _BSD_START
        + """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission.
"""
        + _BSD_END,
    ],
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ],
}
TOKEN = "[^a-z0-9.]+"
#: How a comment line begins, and the names of licence files.
COMMENT = r"[ \t]*(?:#|//|/\*|\*|--|;|%|<!--)"
LICENCE_FILE = r"^(LICENSE|LICENCE|COPYING)(\..*)?$"


def _tokens(text):
    plain = F.regexp_replace(F.lower(text), r"\.(?=[^0-9]|$)", " ")
    return F.filter(F.split(plain, TOKEN), lambda x: x != "")


#: The bytes of tokens as they are, all others as a space.
_PLAIN = np.array([c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789." else 32 for c in range(256)], np.uint8)


def line_tokens(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The tokens of lower-case lines, as _tokens has them: (codes, where each line's begin and end, vocabulary)."""
    lines = pa.concat_arrays([lines.cast(pa.large_string())])
    offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1] if len(lines) else np.zeros(1, np.int64)
    data = _PLAIN[np.frombuffer(lines.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    # a dot without a digit behind it in its line is none of a token's
    dots = np.flatnonzero(data == ord("."))
    after = np.append(data, 32)[dots + 1]
    ends = np.searchsorted(offsets, dots + 1)
    inside = offsets[np.minimum(ends, len(offsets) - 1)] != dots + 1
    data[dots[~(inside & (after >= ord("0")) & (after <= ord("9")))]] = 32
    plain = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data))
    return split_words(plain)


def line_counts(files: DataFrame, terms: list[str]) -> DataFrame:
    """(term, df): in how many lines of the texts each of ``terms`` is; as the empty term, how many lines have tokens."""

    def run(batches):
        known = pa.array(terms, pa.string())
        for batch in chunks(batches, "text", 4_000_000):
            codes, starts, vocab = line_tokens(lines_of(batch.column(0))[0])
            place = pc.fill_null(pc.index_in(vocab, value_set=known), len(terms)).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
            line, own = np.repeat(np.arange(len(starts) - 1), np.diff(starts)), place < len(terms)
            pairs = np.unique(line[own] * len(terms) + place[own])
            df = np.bincount(pairs % max(len(terms), 1), minlength=len(terms))
            yield pa.RecordBatch.from_arrays([pa.array([*terms, ""], pa.string()), pa.array(np.append(df, (np.diff(starts) > 0).sum()).astype(np.int64))], ["term", "df"])

    return files.select(F.lower("text").alias("text")).mapInArrow(run, "term string, df long").where("df > 0").groupBy("term").agg(F.sum("df").alias("df"))


def unit_terms(files: DataFrame, rare: list[str]) -> DataFrame:
    """(path, h, block, line, term, tf): the terms of each unit that has one of ``rare``.

    A line has its number and block -2, a block line -1, a whole licence file -1 in both. Blocks
    are runs of lines without a blank one; where comment lines end, a block ends too. One of a
    single line with tokens is left to its line.
    """

    def run(batches):
        wanted = pa.array(rare, pa.string())
        for batch in chunks(batches, "text", 4_000_000):
            lines, ends = lines_of(batch.column(2))
            codes, starts, vocab = line_tokens(lines)
            count = np.diff(starts)
            text = np.repeat(np.arange(batch.num_rows), np.diff(ends))  # of each line
            comment = pc.match_substring_regex(lines, "^" + COMMENT).to_numpy(zero_copy_only=False)
            fresh = pc.match_substring_regex(lines, r"^[ \t\r]*$").to_numpy(zero_copy_only=False).astype(bool)
            fresh[1:] |= ~comment[1:] & comment[:-1]
            fresh[ends[:-1][np.diff(ends) > 0]] = True
            block = np.cumsum(fresh) - 1
            line = np.repeat(np.arange(len(count)), count)  # of each word
            hit = pc.is_in(vocab, value_set=wanted).to_numpy(zero_copy_only=False)[codes]
            licence = batch.column(3).to_numpy(zero_copy_only=False)
            several = np.bincount(block, weights=count > 0) > 1 if len(block) else np.zeros(0, bool)
            units = []
            for kind, (of, may) in enumerate(((np.arange(len(count)), None), (block, several), (text, licence))):
                has = np.zeros(of[-1] + 1 if len(of) else 0, bool)
                has[of[line[hit]]] = True
                has &= True if may is None else may[: len(has)].astype(bool)
                own = np.flatnonzero(has[of[line]])
                key, tf = np.unique(of[line[own]] * max(len(vocab), 1) + codes[own], return_counts=True)
                unit, term = key // max(len(vocab), 1), key % max(len(vocab), 1)
                at = unit if kind == 2 else text[unit if kind == 0 else np.searchsorted(block, unit)]
                none = np.full(len(unit), -1)
                units.append((at, none - 1 if kind == 0 else none if kind == 2 else unit - block[ends[at]], unit - ends[at] if kind == 0 else none, term, tf))
            at, block, line, term, tf = (np.concatenate(x).astype(np.int64) for x in zip(*units, strict=True))
            columns = [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(block.astype(np.int32)), pa.array(line.astype(np.int32)), vocab.take(pa.array(term)), pa.array(tf)]
            yield pa.RecordBatch.from_arrays(columns, ["path", "h", "block", "line", "term", "tf"])

    licence = F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE).alias("licence")
    rows = files.select("path", F.xxhash64("text").alias("h"), F.lower("text").alias("text"), licence)
    found = rows.mapInArrow(run, "path string, h long, block int, line int, term string, tf long")
    return found.groupBy("path", "h", "block", "line", "term").agg(F.sum("tf").alias("tf"))


def unit_scores(files: DataFrame, least: float = 0.6, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(path, licence, score): the best template of each file's units, if its cosine is at least ``least``.

    Units are a file's lines, its blocks (runs of lines without a blank one, such as a
    header's comment) and, of licence files, the whole text. A term's weight is its
    count in the unit times ln((1 + lines) / (1 + lines with it)) + 1, counted over all lines
    of all files; a word that no template has weighs as one that is in no other line. Ties
    go to the first licence by name.

    Only units with a rare term of a template are compared: the other terms' share of the
    template's norm is below ``least``, and so would be the cosine.
    """
    spark = files.sparkSession
    rows = [(k, n, t) for k, texts in templates.items() for n, t in enumerate(texts)]
    tf = spark.createDataFrame(rows, "licence string, n int, t string").select("licence", "n", F.explode(_tokens("t")).alias("term")).groupBy("licence", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    terms = sorted(r.term for r in tf.select("term").distinct().collect())  # of the fixed templates
    # a term's lines, and as the empty term all lines that have any
    df = materialise(line_counts(files, terms), "df")
    total = df.agg(F.coalesce(F.max(F.when(F.col("term") == "", F.col("df"))), F.lit(0)).alias("lines"))
    idf = spark.createDataFrame([(t,) for t in terms], "term string").join(df, "term", "left").crossJoin(F.broadcast(total))  # one row of totals
    idf = idf.select("term", (F.log((1 + F.col("lines")) / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf"), (F.log((1.0 + F.col("lines")) / 2) + 1).alias("rest"))
    weights = tf.join(idf, "term").select("licence", "n", "term", "idf", (F.col("tf") * F.col("idf")).alias("w"))
    weights = weights.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("licence", "n"))))

    commoner = Window.partitionBy("licence", "n").orderBy("idf", "term").rowsBetween(Window.unboundedPreceding, 0)
    share = F.sqrt(F.sum(F.col("w") * F.col("w")).over(commoner)) / F.col("norm")
    rare = sorted({r.term for r in weights.withColumn("share", share).where(F.col("share") >= least - 1e-5).select("term").collect()})  # of the fixed templates
    unit = ["path", "h", "block", "line"]
    counts = materialise(unit_terms(files, rare), "terms")  # is read twice
    # all tables below but counts have as many rows as the templates have terms
    vector = counts.join(F.broadcast(idf.select("term", "idf")), "term", "left").crossJoin(F.broadcast(idf.agg(F.max("rest").alias("rest"))))
    vector = vector.select(*unit, "term", (F.col("tf") * F.coalesce("idf", "rest")).alias("v"))
    norms = vector.groupBy(*unit).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("own"))
    dots = vector.join(F.broadcast(weights), "term").groupBy(*unit, "licence", "n", "norm").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    scores = dots.join(norms, unit).select("path", "licence", F.round(F.col("dot") / F.col("norm") / F.col("own"), 6).alias("score")).where(F.col("score") >= least)
    best = scores.groupBy("path", "licence").agg(F.max("score").alias("score"))
    return best.groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("minus"), "licence")).alias("b")).select("path", F.col("b.licence").alias("licence"), (-F.col("b.minus")).alias("score"))


def licence_scan(files: DataFrame, least: float = 0.6, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """path, licence, score and origin of every file (path, text).

    ``templates`` are texts by licence; whole licences of any length may be given.
    origin is the file itself where one of its lines, blocks or (a licence file) its whole
    text matches, else the path of the nearest directory above it that has a licence file
    (named LICENSE, LICENCE or COPYING, with any ending) that matches; licence, score and
    origin are null if there is none. Of several licence files in a directory the first by
    name counts.

    Null and empty texts match nothing; null paths get no licence. Repeated paths are one
    file of several texts and keep one row for each. Very long texts are compared whole.
    Other columns are ignored. Empty table: empty result.
    """
    files = files.select("path", "text")
    found = materialise(unit_scores(files.where(F.col("path").isNotNull() & F.col("text").isNotNull()), least, templates), "licences")
    parts = F.split("path", "/")
    depth = F.size("parts")
    declared = found.withColumn("parts", parts).where(F.element_at("parts", -1).rlike(LICENCE_FILE))
    declared = declared.select(F.array_join(F.slice("parts", 1, depth - 1), "/").alias("dir"), "path", "licence", "score")
    declared = declared.groupBy("dir").agg(F.min(F.struct("path", "licence", "score")).alias("d"))
    need = files.select("path").distinct().join(found, "path", "left_anti").withColumn("parts", parts)
    above = need.select("path", F.explode(F.sequence(F.lit(0), depth - 1)).alias("level"), "parts")
    above = above.select("path", "level", F.array_join(F.slice("parts", F.lit(1), F.col("level")), "/").alias("dir"))
    near = above.join(declared, "dir").groupBy("path").agg(F.max(F.struct("level", "dir", "d")).alias("n"))
    near = near.select("path", F.col("n.d.licence").alias("licence"), F.col("n.d.score").alias("score"), F.col("n.dir").alias("origin"))
    return files.select("path").join(found.withColumn("origin", F.col("path")).unionByName(near), "path", "left")


def laid_out(docs: DataFrame) -> DataFrame:
    """doc_id, path and text: documents have no paths, so they are laid out as source/hundreds/doc_id.txt.

    Ids that end in 4 are licence files of their directory, ids that end in 9 of their
    source. Null sources are "-", null ids have no path.
    """
    source, hundred, name = F.coalesce("source", F.lit("-")), F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string")
    last = F.pmod("doc_id", F.lit(10))
    licence = F.concat(F.lit("LICENSE."), name)
    path = F.when(last == 9, F.concat_ws("/", source, licence)).when(last == 4, F.concat_ws("/", source, hundred, licence))
    path = path.otherwise(F.concat_ws("/", source, hundred, F.concat(name, F.lit(".txt"))))
    return docs.select("doc_id", F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text")


def op3_licence_scan(spark, sf_dir: str) -> DataFrame:
    """Licences of all documents, which are laid out in directories by laid_out."""
    paths = laid_out(documents(spark, sf_dir))
    return paths.select("doc_id", "path").join(licence_scan(paths.select("path", "text")).dropDuplicates(["path"]), "path", "left")


_SQL_TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(t), '\.([^0-9])', ' \1', 'g'), '\.$', ' '), '[^a-z0-9.]+'), lambda x: x <> '')"

OP3_SQL = r"""
WITH templates(licence, n, t) AS (VALUES %s),
files AS (
  SELECT doc_id, text, CASE WHEN doc_id IS NULL THEN NULL ELSE coalesce(source, '-') || '/' || CASE doc_id %% 10
           WHEN 9 THEN 'LICENSE.' || doc_id WHEN 4 THEN (doc_id // 100) || '/LICENSE.' || doc_id ELSE (doc_id // 100) || '/' || doc_id || '.txt' END END AS path
  FROM documents
), texts AS (SELECT DISTINCT path, text FROM files WHERE path IS NOT NULL AND text IS NOT NULL
), numbered AS (SELECT path, md5(text) AS h, string_split(text, chr(10)) AS lines FROM texts
), split_lines AS (
  SELECT path, h, unnest(lines) AS t, unnest(range(len(lines))) AS line FROM numbered
), flags AS (
  SELECT *, regexp_matches(t, '^[ \t]*(#|//|/\*|\*|--|;|%%|<!--)') AS comment, regexp_matches(t, '^[ \t\r]*$') AS blank FROM split_lines
), begins AS (
  SELECT *, blank OR (NOT comment AND coalesce(lag(comment) OVER (PARTITION BY path, h ORDER BY line), false)) AS fresh FROM flags
), lines AS (
  SELECT path, h, line, sum(fresh::int) OVER (PARTITION BY path, h ORDER BY line) AS block, %s AS tokens FROM begins
), used AS (SELECT * FROM lines WHERE len(tokens) > 0
), tt AS (
  SELECT licence, n, term, count(*) AS tf FROM (SELECT licence, n, unnest(%s) AS term FROM (SELECT licence, n, replace(t, chr(10), ' ') AS t FROM templates)) GROUP BY ALL
), df AS (
  SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM used) WHERE term IN (SELECT term FROM tt) GROUP BY term
), n AS (SELECT count(*) AS lines FROM used
), idf AS (
  SELECT term, ln((1 + lines) / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT term FROM tt) LEFT JOIN df USING (term), n
), w AS (
  SELECT licence, n, term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY licence, n)) AS norm FROM tt JOIN idf USING (term)
), words AS (SELECT path, h, line, block, unnest(tokens) AS term FROM used
), counts AS (
  SELECT path, h, 'line ' || line AS unit, term, count(*) AS tf FROM words GROUP BY ALL
  UNION ALL SELECT path, h, 'block ' || block, term, count(*) FROM words GROUP BY ALL
  UNION ALL SELECT path, h, 'whole', term, count(*) FROM words WHERE regexp_matches(path, '/LICENSE[^/]*$') GROUP BY ALL
), vec AS (
  SELECT path, h, unit, term, tf * coalesce(idf, ln((1.0 + lines) / 2) + 1) AS v FROM counts LEFT JOIN idf USING (term), n
), norms AS (SELECT path, h, unit, sqrt(sum(v * v)) AS own FROM vec GROUP BY ALL
), scores AS (
  SELECT path, licence, round(sum(v * w) / norm / own, 6) AS score FROM vec JOIN w USING (term) JOIN norms USING (path, h, unit) GROUP BY path, h, unit, licence, n, norm, own
), found AS (
  SELECT path, licence, score FROM scores WHERE score >= 0.6
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, licence) = 1
), declared AS (
  SELECT regexp_replace(path, '/[^/]*$', '') AS dir, arg_min(licence, path) AS licence, arg_min(score, path) AS score
  FROM found WHERE regexp_matches(path, '/LICENSE[^/]*$') GROUP BY 1
), own AS (
  SELECT doc_id, f.path, licence, score, regexp_replace(f.path, '/[^/]*$', '') AS near, split_part(f.path, '/', 1) AS far
  FROM files f LEFT JOIN found USING (path)
)
SELECT doc_id, path, coalesce(own.licence, a.licence, b.licence) AS licence, coalesce(own.score, a.score, b.score) AS score,
       CASE WHEN own.licence IS NOT NULL THEN path ELSE coalesce(a.dir, b.dir) END AS origin
FROM own LEFT JOIN declared a ON own.licence IS NULL AND a.dir = near LEFT JOIN declared b ON own.licence IS NULL AND b.dir = far
""" % (", ".join(f"('{k}', {n}, '{t}')" for k, texts in TEMPLATES.items() for n, t in enumerate(texts)), _SQL_TOKENS, _SQL_TOKENS)
