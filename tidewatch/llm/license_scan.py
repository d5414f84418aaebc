"""License scans by canonical digests, in DataFrame functions only.

A text is normalised (lower case, no copyright lines, letters and digits alone, one spelling for words that licences spell
in several ways) and its SHA-256 is joined with the digests of known texts, normalised alike. The same is done for each
line, which finds one-line notices in longer documents.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that licence texts use for one another, and the spelling taken for both.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "centre": "center",
    "favour": "favor",
    "fulfilment": "fulfillment",
    "https": "http",
    "initialise": "initialize",
    "judgement": "judgment",
    "labour": "labor",
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "merchantibility": "merchantability",
    "noncommercial": "non commercial",
    "organisation": "organization",
    "owner": "holder",
    "owners": "holders",
    "recognised": "recognized",
    "sublicence": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

#: Known texts by SPDX identifier, short ones, then notices of one line; the long ones are files in licenses/.
KNOWN = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC + "\n\n" + _ISC_END),
    ("ISC", "ISC License\n\n" + _ISC + "\n\n" + _ISC_END),
    ("0BSD", _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "") + "\n\n" + _ISC_END),
    ("BSD-2-Clause", _BSD + "\n\n" + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD + "\n\n" + _BSD_END),
    ("BSD-3-Clause", _BSD + "\n" + _BSD_3 + "\n\n" + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD + "\n" + _BSD_3 + "\n\n" + _BSD_END),
    ("Zlib", _ZLIB),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
]
#: Digests up to which they are broadcast; beyond, Spark chooses how to join them.
FEW_KNOWN = 100_000
#: A line that begins with a copyright notice: a sign, year or name follows. (Lines of prose in capitals that begin with
#: the word, as wrapped texts have, are none.)
COPYRIGHT = r"(^|\n)[^\p{L}\p{N}\n]*((?i:portions[ \t]+)?((?i:copyright)[ \t:]*((?i:\(c\))|©|[0-9]|\[|<|(?i:by[ \t]))|(Copyright|copyright)[ \t:]+\p{Lu})|\([cC]\)[ \t]*[0-9]|©[ \t]*[0-9]|(?i:all rights reserved))[^\n]*"
#: Where the terms of some long texts end and advice on their use begins; both forms are known.
TERMS_END = "END OF TERMS AND CONDITIONS"
MARKS = r"[^\p{L}\p{N}\n]+"


@lru_cache(1)
def known_texts() -> list[tuple[str, str]]:
    """All known texts by identifier. Read on the driver."""
    out = list(KNOWN)
    for p in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        text = p.read_text(encoding="utf-8")
        out.append((p.stem, text))
        if TERMS_END in text:
            out.append((p.stem, text.split(TERMS_END)[0] + TERMS_END))
            out.append((p.stem, text.split(TERMS_END)[0]))
    return out


def normal(text: Column) -> Column:
    """The normalised text, its lines still apart."""
    t = F.lower(F.regexp_replace(text, COPYRIGHT, "\n"))
    t = F.regexp_replace(t, MARKS, " ")
    # each word between blanks of its own, so that neighbours can both be replaced
    t = F.concat(F.lit(" "), F.replace(F.replace(t, F.lit(" "), F.lit("  ")), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    t = reduce(lambda x, w: F.replace(x, F.lit(f" {w[0]} "), F.lit(f" {w[1]} ")), SPELLINGS.items(), t)
    return F.regexp_replace(t, " +", " ")


def _lines(t: Column) -> Column:
    return F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def known_digests(spark, known=None) -> DataFrame:
    """(license_id, digest, size) of the known texts; one row a digest, ties to the first identifier by name."""
    known = known_texts() if known is None else known
    rows = spark.createDataFrame(known, "license_id string, text string")
    whole = F.concat_ws(" ", _lines(normal(F.col("text"))))
    return rows.withColumn("t", whole).groupBy(F.sha2("t", 256).alias("digest")).agg(F.min("license_id").alias("license_id"), F.max(F.length("t")).alias("size"))


def scan(docs: DataFrame, known=None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, license_id, n_license_lines, line_licenses: one row for each id and normalised text.

    license_id: the known licence that the entire text is, or null. line_licenses: the licences whose text is a whole line,
    distinct, in order, joined by commas (null if there are none). Null text: null digest, no licence. Empty text: the
    digest of nothing. Rows with the same id and normalised text count once. An empty table gives an empty result.
    """
    table = known_digests(docs.sparkSession, known)
    known = known_texts() if known is None else known
    small = F.broadcast if len(known) <= FEW_KNOWN else lambda t: t
    t = docs.select(F.col(f"`{id_col}`").alias("doc_id"), _lines(normal(F.col(f"`{text_col}`"))).alias("lines"))
    t = t.select("doc_id", "lines", F.when(F.col("lines").isNotNull(), F.sha2(F.concat_ws(" ", "lines"), 256)).alias("digest"))
    longest = table.agg(F.max("size")).first()[0] or 0
    short = F.coalesce(F.filter("lines", lambda x: F.length(x) <= longest), F.array().cast("array<string>"))
    # every document has one null unit, so that none is lost
    units = t.select("doc_id", "digest", F.explode(F.concat(F.array(F.lit(None).cast("string")), short)).alias("unit"))
    line = small(table.select(F.col("digest").alias("unit_digest"), F.col("license_id").alias("line_license")))
    hits = units.withColumn("unit_digest", F.sha2("unit", 256)).join(line, "unit_digest", "left").filter(F.col("unit").isNull() | F.col("line_license").isNotNull())
    copies = F.sum(F.col("unit").isNull().cast("long"))
    found = hits.groupBy("doc_id", "digest").agg(
        (F.count("line_license") / copies).cast("long").alias("n_license_lines"),
        F.array_sort(F.collect_set("line_license")).alias("names"),
    )
    whole = small(table.select("digest", "license_id"))
    names = F.when(F.size("names") > 0, F.concat_ws(",", "names"))
    return found.join(whole, "digest", "left").select("doc_id", "digest", "license_id", "n_license_lines", names.alias("line_licenses"))


def oracle(known=None) -> str:
    """The query over documents in DuckDB's SQL."""
    known = known_texts() if known is None else known
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def norm(col: str) -> str:
        t = f"lower(regexp_replace({col}, {quote(COPYRIGHT)}, chr(10), 'g'))"
        t = f"regexp_replace({t}, {quote(MARKS)}, ' ', 'g')"
        t = f"' ' || replace(replace({t}, ' ', '  '), chr(10), ' ' || chr(10) || ' ') || ' '"
        for a, b in SPELLINGS.items():
            t = f"replace({t}, ' {a} ', ' {b} ')"
        return f"regexp_replace({t}, ' +', ' ', 'g')"

    values = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in known)
    return f"""
WITH known_text AS (SELECT row_number() OVER () AS k, license_id, {norm("text")} AS t FROM (VALUES {values}) v(license_id, text)),
known_line AS (SELECT k, license_id, i, trim(string_split(t, chr(10))[i]) AS line FROM (SELECT *, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM known_text)),
known_whole AS (SELECT k, min(license_id) AS license_id, string_agg(line, ' ' ORDER BY i) AS t FROM known_line WHERE line <> '' GROUP BY k),
known AS (SELECT sha256(t) AS digest, min(license_id) AS license_id FROM known_whole GROUP BY 1),
d AS (SELECT doc_id, text, {norm("text")} AS t FROM documents),
lines AS (SELECT doc_id, i, trim(string_split(t, chr(10))[i]) AS line FROM (SELECT doc_id, t, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM d)),
whole AS (SELECT doc_id, string_agg(line, ' ' ORDER BY i) AS t FROM lines WHERE line <> '' GROUP BY doc_id),
hits AS (SELECT l.doc_id, count(*) AS n, string_agg(DISTINCT k.license_id, ',' ORDER BY k.license_id) AS names FROM lines l JOIN known k ON sha256(l.line) = k.digest WHERE l.line <> '' GROUP BY l.doc_id),
base AS (SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(w.t, '')) END AS digest FROM d LEFT JOIN whole w ON d.doc_id = w.doc_id)
SELECT b.doc_id, b.digest, k.license_id, coalesce(h.n, 0)::BIGINT AS n_license_lines, h.names AS line_licenses
FROM base b LEFT JOIN known k ON b.digest = k.digest LEFT JOIN hits h ON b.doc_id = h.doc_id"""
