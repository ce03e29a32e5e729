"""Licence scan by canonical digest: normalise a whole text, hash it, join the digest with those of known licences.

Normalisation, in this order: A-Z to lower case; copyright lines (``copyright`` followed by a mark, year, holder sign or
``by``, or a line that starts with a copyright mark) and ``all rights reserved`` go; everything but letters and digits
becomes one blank; equivalent spellings get one form. So line wrapping, bullets, quotes and the holder's name don't
matter, while any other changed word does. Texts are compared entire: a licence inside a longer text is not a match.

A copyright line goes whole: a licence that follows the holder's name on the same line goes with it and is not found.

Defined results: a null text has the digest of the empty text and no licence, as has a text without letters or digits.
Every row gets a row; rows may repeat. Texts of any length are hashed whole. An empty table gives an empty one. Columns other than id and text,
whatever their names, are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: Equivalent spellings and the form that stands for them.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("artefact", "artifact"), ("authorised", "authorized"),
    ("behaviour", "behavior"), ("favour", "favor"), ("fulfil", "fulfill"), ("licence", "license"), ("licenced", "licensed"),
    ("modelling", "modeling"), ("noncommercial", "non commercial"), ("organisation", "organization"),
    ("organisations", "organizations"), ("recognise", "recognize"), ("sub license", "sublicense"), ("whilst", "while"), ("wilful", "willful"),
]
COPYRIGHT_LINE = "(?m)^[^a-z0-9\\n]*(copyright[ \\t]*([(]c[)]|©|[0-9]|<|[\\[]|:|by )|[(]c[)]|©|all rights reserved)[^\\n]*$"
#: At most so many known licences are broadcast.
BROADCAST_KNOWN = 100_000

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: {n1} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. {n2} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_THIRD = "{n3} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_NUM, _DOT = {"n1": "1.", "n2": "2.", "n3": "3."}, {"n1": "*", "n2": "*", "n3": "*"}
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
_APACHE_NOTICE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
#: (licence, text): full texts with and without their title, usual notices, and one-line notices. Callers pass their own.
KNOWN = [
    ("MIT", _MIT), ("MIT", "MIT License " + _MIT), ("MIT", "The MIT License (MIT) " + _MIT),
    ("ISC", _ISC + _AS_IS), ("ISC", "ISC License " + _ISC + _AS_IS),
    ("0BSD", _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "") + _AS_IS),
    *[(n, t + _BSD_HEAD.format(**m) + third.format(**m) + _BSD_TAIL) for n, title, third in (("BSD-2-Clause", "BSD 2-Clause License ", ""), ("BSD-3-Clause", "BSD 3-Clause License ", _BSD_THIRD)) for t in ("", title) for m in (_NUM, _DOT)],
    ("Apache-2.0", _APACHE_NOTICE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]

#: Digests of the canonical forms of whole licences too long to stand here, as their stewards publish them (title, preamble and appendix included).
KNOWN_DIGESTS = [
    ("Apache-2.0", "045649cdaf85384ba827242062f2f3b36409835c98d297e25177cb1faf7c2847"),
    ("Artistic-1.0", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0", "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a"),
    ("GPL-2.0", "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "1cfb6cca26abe2169c9c61164807107b2d4a0b64955a2cf2de46fad3483acda1"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
]
#: Any spelling that has an equivalent. A text without one is left as it is by all replacements in turn.
_ANY_SPELLING = "\\b(?:" + "|".join(a for a, _ in SPELLINGS) + ")\\b"


def canonical(text: Column) -> Column:
    """The normal form that is hashed."""
    c = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    c = F.trim(F.regexp_replace(c, "[^\\p{L}\\p{N}]+", " "))
    # inside a lambda, so that the text is worked out once
    return F.transform(F.array(c), lambda x: F.when(F.regexp_like(x, F.lit(_ANY_SPELLING)), reduce(lambda y, s: F.regexp_replace(y, f"\\b{s[0]}\\b", s[1]), SPELLINGS, x)).otherwise(x))[0]


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def scan_licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: list[tuple[str, str]] = KNOWN_DIGESTS) -> DataFrame:
    """(id, digest, license): license is null where the whole text is no known licence. known: (license, text); digests: (license, digest) of further ones.

    The digest side is unique per digest (the first name in order stands), so rows are never multiplied; a digest that a
    third of all texts share meets a broadcast table, or is split by the adaptive join when the table is too long for it.
    """
    table_ = known.where(F.trim(canonical(F.col("text"))) != "").select(digest(F.col("text")).alias("digest"), "license")
    table_ = table_.union(known.sparkSession.createDataFrame([(d, n) for n, d in digests], "digest string, license string")).groupBy("digest").agg(F.min("license").alias("license"))
    if known.limit(BROADCAST_KNOWN + 1).count() <= BROADCAST_KNOWN:
        table_ = F.broadcast(table_)
    return docs.select(F.col(id_col), digest(F.col(text_col)).alias("digest")).join(table_, "digest", "left").select(id_col, "digest", "license")


def op5_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), spark.createDataFrame(KNOWN, "license string, text string"))


def _sql(column: str) -> str:
    quoted = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    c = f"trim(regexp_replace(regexp_replace(translate(coalesce({column}, ''), {quoted}), '{COPYRIGHT_LINE.replace(chr(92) * 2, chr(92))}', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    for a, b in SPELLINGS:
        c = f"regexp_replace({c}, '\\b{a}\\b', '{b}', 'g')"
    return c


OP5_SQL = f"""
WITH known(license, text) AS (VALUES {", ".join("('" + a + "', '" + b.replace("'", "''") + "')" for a, b in KNOWN)}),
k AS (SELECT digest, min(license) AS license FROM (SELECT sha256({_sql("text")}) AS digest, license FROM known UNION ALL VALUES {", ".join(f"('{d}', '{n}')" for n, d in KNOWN_DIGESTS)}) GROUP BY 1),
d AS (SELECT doc_id, sha256({_sql("text")}) AS digest FROM documents)
SELECT d.doc_id, d.digest, k.license FROM d LEFT JOIN k ON d.digest = k.digest
"""
