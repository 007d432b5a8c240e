"""License scans by canonical digest.

A text is brought to a canonical form (case, punctuation, white space, copyright
lines and equivalent spellings are gone), hashed, and joined with the digests of
known licence texts. Two things count as entire texts: a whole document, and a
whole line of it (a licence notice). All of it is DataFrame functions; the table
of known digests has some hundred rows, so both look-ups carry it to the rows.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that mean the same, applied in this order to lower-case words that
#: each stand between two spaces of their own.
SPELLINGS = (
    (" licences? | licenses ", " license "),
    (" licenced ", " licensed "),
    (" sublicence ", " sublicense "),
    (" authorisation ", " authorization "),
    (" organisation ", " organization "),
    (" recognise ", " recognize "),
    (" merchantibility ", " merchantability "),
    (" noncommercial ", " non  commercial "),
    (" gpl ", " general  public  license "),
    (" copyright  owner ", " copyright  holder "),
    (" creative  commons ", " cc "),
    (" https? ", " "),
    (" version | v ", " "),
    (" v([0-9]+) ", " $1 "),
)
#: A line that names a copyright holder or reserves rights says nothing about the licence.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(copyright[^\p{L}\n]|\(c\)|©)[^\n]*([0-9]{4}|\(c\)|©)[^\n]*$|^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$"
#: Each known text below holds one of these; where all do, rows and lines without one need no canonical form.
MARK = r"(?i)licen[sc]|gpl|public domain|creative|cc0|software|(^|[^a-z])cc([^a-z]|$)"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_0BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

#: Whole licence texts, with and without a title line.
TEXTS = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n" + _ISC),
    ("0BSD", _0BSD),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("Zlib", _ZLIB),
    ("Apache-2.0", _APACHE_NOTICE),
)
_NAMES = (
    ("MIT", "the MIT License"),
    ("Apache-2.0", "the Apache License, Version 2.0"),
    ("GPL-2.0", "the GNU General Public License, version 2"),
    ("GPL-3.0", "the GNU General Public License, version 3"),
    ("LGPL-3.0", "the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "the Mozilla Public License, version 2.0"),
    ("BSD-2-Clause", "the BSD 2-Clause License"),
    ("BSD-3-Clause", "the BSD 3-Clause License"),
    ("ISC", "the ISC License"),
    *((f"CC-{k.upper().replace(' ', '-')}-{v}", f"CC {k} {v}") for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("3.0", "4.0")),
    ("CC0-1.0", "CC0 1.0"),
)
#: One-line notices: each licence in the usual phrases.
NOTICES = tuple((k, f"{lead} {name}.") for k, name in _NAMES for lead in ("Released under", "Licensed under", "This work is licensed under", "This software is licensed under", "Distributed under", "This project is licensed under")) + (
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: SHA-256 of the canonical form of long standard texts; where there are
#: two of a licence, the second ends at "END OF TERMS AND CONDITIONS".
DIGESTS = (
    ("Apache-2.0", "ce3afb3b3d6c185d5f823c6ce533a688c32d81d2f922c91ab77785128cba87aa"),
    ("Apache-2.0", "7091b73f21a707f0ce59def7022052ea6ea456fc4ceeaa765b996107a3f4d4b1"),
    ("Artistic-1.0-Perl", "f9f3ee8e3210392adfceee30bedc10031df16e1887e5909bf0b984aee599f69a"),
    ("CC0-1.0", "56496162e7349930272f3ed697a8056f846b08d4d4491896cb5c14b8a05206a5"),
    ("GFDL-1.2", "7839cc4390a6b9965083ce9bc24e322e3e0b1f16662e29e3c43e1447891a651e"),
    ("GFDL-1.3", "b9031c213f88960bb5805fb3e1cf452c30e66e6db015723f20d19da737d52674"),
    ("GPL-1.0", "85cce7440aaac060a44fb059e73242d6c9900827362d13a95a854b1776976632"),
    ("GPL-1.0", "14e6777013b7abfb5fd879f3c610386f1cec7ccb08b045e3f50a8f9683312081"),
    ("GPL-2.0", "17c25bd50c0b2e17a4e66340002e41662cd681fadf46836b95d7d5f6485aa297"),
    ("GPL-2.0", "2c95ecc0613b08bf0ce834708064308e62b7be435fcc19cecfe5ecbd345d157f"),
    ("GPL-3.0", "d2fb1fe0247cd6a0ff38b0e30add8617ad0c6b57637b07ff54ba7c9909bbee01"),
    ("GPL-3.0", "b3b83cc493632f1b9db1b9ec54364c422874b70d5074b85a6341401bb3189c06"),
    ("LGPL-2.0", "d039d388a3550191ccef2d72a8d2a3f6b1029bc4d3897bc37dcc56994e9a2347"),
    ("LGPL-2.0", "be1ed67e43c855405a027597f453350954329024ae30a3bb6339e230c7d839b2"),
    ("LGPL-2.1", "51a9e292e78fb85d08d0c3fee3f51a7913f8ac70efeff5a2c0e01d52be6635e5"),
    ("LGPL-2.1", "3e287b3edcef8aa8b32e8ffeebbe4834f9e3cd8bb060b9c3ee9eb850ef902441"),
    ("LGPL-3.0", "7ef00c0f04342b412618efeb142f653376848227b4ea96525e424f34ac7ef75d"),
    ("MPL-1.1", "c22ea3f1ee1c9c849b95884f9bf85623cb49a7c62b9ea39c579a002140a85a35"),
    ("MPL-2.0", "21d6b82754af30258a89866dda20e6c5f9135846b93cb6bbd9a981389406577f"),
)


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, one spelling, letters and digits with single spaces (null: null)."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    out = F.concat(F.lit(" "), F.regexp_replace(out, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    for pattern, put in SPELLINGS:
        out = F.regexp_replace(out, pattern, put)
    return F.trim(F.regexp_replace(out, " +", " "))


def known_digests(spark: SparkSession, texts=TEXTS + NOTICES, digests=DIGESTS) -> DataFrame:
    """`license_digest` and `license_id` of known (id, text) and (id, canonical digest) pairs; a digest stands once."""
    rows = spark.createDataFrame(list(texts), "license_id string, text string").select(F.sha2(canonical(F.col("text")).cast("binary"), 256).alias("license_digest"), "license_id")
    rows = rows.union(spark.createDataFrame([(d, i) for i, d in digests], "license_digest string, license_id string"))
    return rows.groupBy("license_digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, texts=TEXTS + NOTICES, digests=DIGESTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of `docs`: `id_col`, `license_id` and `n_notices`.

    `license_id` is the known licence whose canonical text is the whole document;
    else that of the document's notice lines (several: the first by name); else
    null. `n_notices` (long) counts lines that are a known text by themselves. A
    null or empty text, or one of punctuation and copyright lines alone, has no
    licence and no notices. Rows are independent: repeated rows and null ids stay,
    extra columns are ignored, an empty table gives no rows. Where a text lacks
    MARK, or other `digests` are given, every row and line takes its canonical form.
    """
    known = known_digests(docs.sparkSession, texts, digests)
    pairs = known.collect()  # as many as `texts` and `digests`
    by_digest = F.create_map(*[F.lit(x) for r in pairs for x in (r.license_digest, r.license_id)])
    digest = lambda x: F.sha2(canonical(x).cast("binary"), 256)
    marked = set(digests) <= set(DIGESTS) and all(re.search(MARK, t) for _, t in texts)
    has_mark = lambda x: x.rlike(MARK) if marked else x.isNotNull()
    text = F.col(f"`{text_col}`").cast("string")
    lines = F.filter(F.split(F.coalesce(F.when(has_mark(text), text), F.lit("")), "\n"), has_mark)
    rows = docs.select(
        F.col(f"`{id_col}`").alias("__id"),
        F.when(has_mark(text), digest(text)).alias("license_digest"),
        F.filter(F.transform(lines, lambda x: F.element_at(by_digest, digest(x))), lambda x: x.isNotNull()).alias("__found"),
    )
    rows = rows.join(F.broadcast(known.withColumnRenamed("license_id", "__text")), "license_digest", "left")
    return rows.select(F.col("__id").alias(id_col), F.coalesce("__text", F.array_min("__found")).alias("license_id"), F.size("__found").cast("long").alias("n_notices"))


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql(column: str) -> str:
    out = f"regexp_replace(lower({column}), {_quoted(COPYRIGHT_LINE)}, ' ', 'g')"
    out = rf"' ' || regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', '  ', 'g') || ' '"
    for pattern, put in SPELLINGS:
        out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(put.replace('$', chr(92)))}, 'g')"
    return f"sha256(trim(regexp_replace({out}, ' +', ' ', 'g')))"


SQL = f"""
WITH known AS (SELECT {_sql("t")} AS k, min(id) AS id FROM (VALUES {", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in TEXTS + NOTICES)}) v(id, t) GROUP BY 1
  UNION ALL VALUES {", ".join(f"({_quoted(d)}, {_quoted(i)})" for i, d in DIGESTS)}),
d AS (SELECT doc_id, {_sql("text")} AS k FROM documents),
l AS (SELECT doc_id, {_sql("l")} AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE regexp_matches(l, {_quoted(MARK)})),
n AS (SELECT doc_id, min(id) AS id, count(*) AS n FROM l JOIN known USING (k) GROUP BY doc_id)
SELECT d.doc_id, coalesce(known.id, n.id) AS license_id, coalesce(n.n, 0)::BIGINT AS n_notices
FROM d LEFT JOIN known USING (k) LEFT JOIN n ON n.doc_id = d.doc_id
"""
