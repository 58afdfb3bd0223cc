"""Licence scans by canonical digest, in DataFrame operations only.

A text is brought to a canonical form (case, copyright lines, equivalent
spellings, punctuation and white space), and the digest of the whole form is
hash-joined with the digests of known licences.  Its paragraphs and single lines
are looked up by the same join, so that a notice inside other text is found too.

The catalogue is a table: full licence texts (the files of license_texts, copies as
distributed with operating systems, and short ones below) and the notices by which
documents refer to them.  Callers can pass their own, of any size: up to
BROADCAST_ROWS digests it is broadcast, beyond that joined by a shuffle.

A null or empty text has the digest of the empty form and no licence; a licence
whose form is empty is not in the lookup; of licences with one form the first by name
counts.  A very long text has one digest for the whole and one for each paragraph and
line.  Repeat rows, null ids and extra columns need no care: each row is judged on its
own text.  Empty tables give no rows, or no licences.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import bounded, store, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that names a holder or a year, as opposed to a sentence that speaks of copyright.
COPYRIGHT = r"(?m)^[ \t*#/;]*(copyright[ \t]+(\(c\)|©|[0-9]{4}|<|\[|by )|copyright:|\(c\)[ \t]|©|all rights reserved)[^\n]*$"
#: Spellings that licence texts use for one another, as matching guidelines for licence texts list them.
EQUIVALENT = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("copyright owner", "copyright holder"),
    ("merchantibility", "merchantability"),
    ("acknowledgement", "acknowledgment"),
    ("authorisation", "authorization"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("http://", "https://"),
    ("per cent", "percent"),
    ("©", "(c)"),
    ("&", " and "),
)
NOT_WORD = r"[^\p{L}\p{N}\n]+"
#: A lookup of up to this many digests (about 10 MB) is broadcast.
BROADCAST_ROWS = 100_000


def canonical(text: Column) -> Column:
    """The canonical form: a line per line of words, a form feed between paragraphs."""
    x = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    x = F.regexp_replace(x, COPYRIGHT, "")
    for a, b in EQUIVALENT:
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.regexp_replace(x, NOT_WORD, " ")
    x = F.regexp_replace(x, r" ?\n *\n[ \n]*", "\f")
    return F.trim(F.regexp_replace(x, r" ?\n *", "\n"))


def whole(form: Column) -> Column:
    """Line breaks carry no meaning in a whole text, nor in a paragraph."""
    return F.trim(F.translate(form, "\n\f", "  "))


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
def _files() -> list[tuple[str, str]]:
    """Full texts by licence. Copies often end where the terms do, without the advice on how to apply them."""
    out = []
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        text, end = path.read_text("utf-8"), "END OF TERMS AND CONDITIONS"
        out.append((path.stem, text))
        if end in text:
            out += [(path.stem, text[: text.index(end) + len(end)]), (path.stem, text[: text.index(end)])]
    return out


#: (licence, text): full licences, and the notices by which documents refer to longer ones.
KNOWN = (
    *_files(),
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("ISC", f"{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{ISC_END}"),
    ("ISC", f"ISC License\n\n{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{ISC_END}"),
    ("0BSD", f"{ISC_GRANT}.\n\n{ISC_END}"),
    ("BSD-2-Clause", BSD_START + BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD_START + BSD_END),
    ("BSD-3-Clause", BSD_START + BSD_NAMES + BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD_START + BSD_NAMES + BSD_END),
    ("Zlib", ZLIB),
    ("Zlib", "zlib License\n\n" + ZLIB),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "Licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
)


def known(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(a).alias("license"), F.lit(b).alias("text")) for a, b in KNOWN])
    return spark.range(1).select(F.inline(rows))


def digests(licenses: DataFrame) -> DataFrame:
    """(digest, license) of known licences; of two with one form the first by name counts."""
    form = whole(canonical(F.col("text")))
    rows = licenses.select(form.alias("form"), "license").where("form <> ''")
    return rows.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, licenses: DataFrame) -> DataFrame:
    """doc_id, the digest of the whole text, the licence that the whole text is (or
    null), and the licences that single paragraphs or lines of it name, in order and
    joined by commas.

    A text, its paragraphs and its lines are units of one hash join; what is stored of
    it is a row per document and a row per hit, and only hits are grouped."""
    lookup = store(digests(licenses), "license-lookup", files=1)
    near = F.broadcast if bounded(lookup, BROADCAST_ROWS) else lambda x: x
    form = docs.select("doc_id", F.xxhash64("text").alias("text_key"), canonical(F.col("text")).alias("form"))
    own = F.array(F.sha2(whole(F.col("form")), 256))
    inner = F.concat(F.transform(F.split("form", "\f"), lambda x: whole(x)), F.split("form", "[\f\n]"))
    units = form.select("doc_id", "text_key", F.posexplode(F.concat(own, F.transform(F.array_distinct(inner), lambda x: F.sha2(x, 256)))).alias("unit", "digest"))
    found = units.join(near(lookup), "digest", "left").where("unit = 0 or license is not null")
    found = store(found.select("doc_id", "text_key", "unit", "digest", "license"), "license-units", scanned=True)
    names = found.where("unit > 0").groupBy("text_key").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    rows = found.where("unit = 0").join(names, "text_key", "left")
    return rows.select("doc_id", "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), known(spark))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_form(text: str) -> str:
    x = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
    x = f"regexp_replace({x}, {_quoted(COPYRIGHT)}, '', 'g')"
    for a, b in EQUIVALENT:
        x = f"replace({x}, {_quoted(a)}, {_quoted(b)})"
    x = f"regexp_replace({x}, {_quoted(NOT_WORD)}, ' ', 'g')"
    x = f"regexp_replace({x}, ' ?\\n *\\n[ \\n]*', chr(12), 'g')"
    return f"trim(regexp_replace({x}, ' ?\\n *', chr(10), 'g'))"


def _sql_whole(form: str) -> str:
    return f"trim(translate({form}, chr(10) || chr(12), '  '))"


SQL = f"""
with known(license, text) as (values {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in KNOWN)}),
     lookup as (select sha256({_sql_whole("form")}) as digest, min(license) as license from (select license, {_sql_form("text")} as form from known) k where form <> '' group by 1),
     form as (select rowid_ as r, doc_id, {_sql_form("text")} as form from (select *, row_number() over () as rowid_ from documents)),
     unit as (select r, unnest(string_split_regex(form, '[\\f\\n]')) as u from form union all select r, {_sql_whole("p")} as u from (select r, unnest(string_split(form, chr(12))) as p from form) x),
     named as (select r, string_agg(distinct license, ',' order by license) as notices from (select r, sha256(u) as digest from unit) y join lookup using (digest) group by r)
select doc_id, sha256({_sql_whole("form")}) as digest, license, coalesce(notices, '') as notices
from form left join named using (r) left join lookup on lookup.digest = sha256({_sql_whole("form")})
"""
