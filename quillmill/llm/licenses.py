"""License scan by canonical digests of entire texts.

Only DataFrame functions. A text is brought to a canonical form (case, copyright lines, punctuation, white space,
equivalent spellings) and its SHA-256 is hash-joined to the digests of known licence texts. Those are TEXTS and, on
request, a table of further whole texts (`more`, for instance text_files of a folder of licence files); up to
MAX_BROADCAST digests are broadcast, more are joined by shuffle. Lines that speak of a licence are looked up the same way
among known one-line notices. Every pattern is linear in the text.

Null text counts as empty; a text that is empty in canonical form matches nothing and has a null digest. Repeated rows
each give a row. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, whole_text

#: Known digests that may be broadcast (under 10 MB).
MAX_BROADCAST = 100_000

#: A line that only claims copyright, and the phrase that goes with it.
COPYRIGHT_LINE = r"(?m)^[ \t\-*#/;]*(?:copyright\b|\(c\)|©)[^\n]*$"
RESERVED = r"all rights reserved"
PUNCTUATION = r"[^\p{L}\p{N}]+"
#: Equivalent spellings, on words parted by one space.
SPELLINGS = (
    (r"\blicenc(e|ed|es|ing|ee|or)\b", r"licens$1"),
    (r"\b(sub|non) (licens|commercial|infring)", r"$1$2"),
    (r"\b(author|organ|util|recogn|real|custom|maxim|minim|initial|optim|emphas|categor|character|general|summar)is(e|ed|es|ing|ation|ations)\b", r"$1iz$2"),
    (r"\b(fav|lab|hon|behavi)our", r"$1or"),
    (r"\bcopyright owner", r"copyright holder"),
    (r"\b(judg|acknowledg)ement", r"$1ment"),
    (r"\bper cent\b", r"percent"),
    (r"\bwhilst\b", r"while"),
    (r"\bhttps\b", r"http"),
)

_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
#: Public licence texts, without copyright lines, by SPDX identifier.
TEXTS = (
    ("MIT", f"MIT License\n\n{_MIT_GRANT}\n\n{_WARRANTY}"),
    ("MIT", f"{_MIT_GRANT}\n\n{_WARRANTY}"),
    ("ISC", f"ISC License\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}"),
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_WARRANTY}"),
    ("BSD-2-Clause", f"{_BSD_CONDITIONS}\n\n{_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD_CONDITIONS}\n\n{_BSD_NAME}\n\n{_BSD_WARRANTY}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <http://www.gnu.org/licenses/>."),
)
#: One-line notices; each has NOTICE_MARK in it.
NOTICE_MARK = "licen"
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
)


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    c = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    c = F.regexp_replace(F.regexp_replace(c, RESERVED, " "), PUNCTUATION, " ")
    for pattern, instead in SPELLINGS:
        c = F.regexp_replace(c, pattern, instead)
    return F.trim(c)


def digest(text: Column) -> Column:
    return F.nullif(F.sha2(canonical(text), 256), F.sha2(F.lit(""), 256))


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """license_id (a file's name without .txt) and text of the files in a folder."""
    name = F.regexp_replace(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1), r"\.txt$", "")
    return spark.read.text(folder, wholetext=True).select(F.url_decode(name).alias("license_id"), F.col("value").alias("text"))


def known(spark: SparkSession, texts: tuple[tuple[str, str], ...] = TEXTS, more: DataFrame | None = None) -> DataFrame:
    """license_id and text_digest of the known texts; one row per digest."""
    rows = spark.createDataFrame([(k, t) for k, t in texts], "license_id string, text string")
    if more is not None:
        rows = rows.unionByName(more.select("license_id", "text"))
    return rows.select("license_id", digest(F.col("text")).alias("text_digest")).where("text_digest is not null").groupBy("text_digest").agg(F.min("license_id").alias("license_id"))


def licenses(docs: DataFrame, texts: tuple[tuple[str, str], ...] = TEXTS, notices: tuple[tuple[str, str], ...] = NOTICES, more: DataFrame | None = None) -> DataFrame:
    """One row per row of docs: doc_id, text_digest, license_id (null: not a known licence), notice_ids (sorted, of its lines).

    more: license_id and text of further whole texts that count as known.
    """
    if any(NOTICE_MARK not in t.lower() for _, t in notices):
        raise ValueError(f"a notice without {NOTICE_MARK!r}")
    lines = F.filter(F.split(F.lower(whole_text()), "\n", -1), lambda line: F.contains(line, F.lit(NOTICE_MARK)))
    marked = docs.select("doc_id", digest(whole_text()).alias("text_digest"), F.transform(lines, digest).alias("lines"))
    notice_of = known(docs.sparkSession, notices).agg(F.map_from_entries(F.collect_list(F.struct("text_digest", "license_id"))).alias("m")).scalar()
    found = F.array_compact(F.transform(F.array_compact("lines"), lambda d: F.try_element_at("notice_of", d)))
    whole = known(docs.sparkSession, texts, more)
    small = more is None or whole.count() <= MAX_BROADCAST
    matched = marked.withColumn("notice_of", notice_of).join(F.broadcast(whole) if small else whole, "text_digest", "left")
    return matched.select("doc_id", "text_digest", "license_id", F.concat_ws(",", F.array_sort(F.array_distinct(found))).alias("notice_ids"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(documents(spark, sf_dir))


def _sql_canonical(text: str) -> str:
    # DuckDB's pattern of the line keeps to the ASCII classes that both dialects share.
    c = f"lower({text})"
    for pattern, instead in ((COPYRIGHT_LINE, " "), (RESERVED, " "), (PUNCTUATION, " "), *SPELLINGS):
        c = f"regexp_replace({c}, '{pattern}', '{instead.replace('$', chr(92))}', 'g')"
    return f"trim({c})"


def _values(rows: tuple[tuple[str, str], ...]) -> str:
    return ", ".join("('" + k + "', '" + t.replace("'", "''") + "')" for k, t in rows)


def _sql_digest(text: str) -> str:
    return f"nullif(sha256({_sql_canonical(text)}), sha256(''))"


ORACLE = f"""
WITH texts AS (SELECT {_sql_digest('t')} AS d, min(k) AS k FROM (VALUES {_values(TEXTS)}) v(k, t) GROUP BY 1),
notices AS (SELECT {_sql_digest('t')} AS d, min(k) AS k FROM (VALUES {_values(NOTICES)}) v(k, t) GROUP BY 1),
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
said AS (
  SELECT doc_id, string_agg(DISTINCT k, ',' ORDER BY k) AS ids
  FROM (SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS line FROM docs WHERE contains(lower(text), '{NOTICE_MARK}')) l
  JOIN notices ON notices.d = {_sql_digest('line')} GROUP BY doc_id),
digests AS (SELECT doc_id, {_sql_digest('text')} AS text_digest FROM docs)
SELECT g.doc_id, g.text_digest, texts.k AS license_id, coalesce(said.ids, '') AS notice_ids
FROM digests g LEFT JOIN texts ON texts.d = g.text_digest LEFT JOIN said ON said.doc_id = g.doc_id
"""
