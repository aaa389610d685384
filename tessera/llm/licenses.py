"""License scans (operator 8): canonical digests of whole texts, hash-joined to those of known licences.

A unit is a document's whole text or one of its lines. Its canonical form is lower case (A to Z), without copyright notices
(lines that begin with the word, (c) or the sign and hold a year, a sign or a name; lines that merely begin with the word,
or with (c) as a list mark, belong to the text), with punctuation and white space as single spaces and equivalent spellings made one. Of whole texts,
what numbers or marks a list (single letters, numbers of one or two digits) and "all rights reserved" go too, so neither
wrapping nor bullets matter. Units whose canonical SHA-256 is that of a known licence text or notice are its copies. The
known digests are a small fixed table, which is broadcast: short texts and plain notices are listed here, long texts lie in
licence_texts. Units that lack every key word of the known texts can't be equal to one and are not canonicalised.

Edge cases: a null or empty text has no licence; null and repeated doc_ids need no care, as results belong to the text (by
its digest); a text of any length is read whole; a digest that two licences share goes to the first by code point; further
columns, whatever their names, are neither read nor returned; an empty table gives no rows.
"""

from __future__ import annotations

import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, table, written

_MIT_BODY = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
    "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
    "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR "
    "A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

_BSD_ADVERT = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
    "for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
    "public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all "
    "present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this "
    "software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim "
    "that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as "
    "such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, "
    "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software "
    "and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless "
    "such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
    "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_PARTIES = (("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDER OR CONTRIBUTORS"), ("REGENTS AND CONTRIBUTORS", "REGENTS OR CONTRIBUTORS"), ("AUTHOR AND CONTRIBUTORS", "AUTHOR OR CONTRIBUTORS"), ("AUTHOR", "AUTHOR"), ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDERS OR CONTRIBUTORS"))


def _bsd(*clauses: str) -> list[str]:
    """A BSD text with these clauses, with the parties that its warranty is known to name."""
    (giver, bearer), *_ = _BSD_PARTIES
    return ["\n\n".join([_BSD_HEAD, *clauses, _BSD_WARRANTY.replace(giver, a).replace(bearer, b)]) for a, b in _BSD_PARTIES]


#: Public licence texts (without title and copyright line; a title is added by rule below).
TEXTS = [
    ("MIT", "MIT License", f"{_MIT_BODY}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_MIT_WARRANTY}"),
    ("MIT-0", "MIT No Attribution", f"{_MIT_BODY}.\n\n{_MIT_WARRANTY}"),
    ("ISC", "ISC License", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}"),
    ("0BSD", "BSD Zero Clause License", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n{_ISC_WARRANTY}"),
    *[("BSD-1-Clause", "BSD 1-Clause License", t) for t in _bsd(_BSD_1)],
    *[("BSD-2-Clause", "BSD 2-Clause License", t) for t in _bsd(_BSD_1, _BSD_2)],
    *[("BSD-3-Clause", "BSD 3-Clause License", t) for t in _bsd(_BSD_1, _BSD_2, _BSD_3)],
    *[("BSD-4-Clause", "BSD 4-Clause License", t) for t in _bsd(_BSD_1, _BSD_2, _BSD_ADVERT, _BSD_3)],
    ("Unlicense", "The Unlicense", _UNLICENSE),
    ("Unlicense", "The Unlicense", f"{_UNLICENSE}\n\nFor more information, please refer to <https://unlicense.org>"),
    ("Unlicense", "The Unlicense", f"{_UNLICENSE}\n\nFor more information, please refer to <http://unlicense.org/>"),
    ("Zlib", "zlib License", _ZLIB),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003", _BOOST),
]

#: Names by which notices call a licence.
NAMES = [
    ("Apache-2.0", ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License")),
    ("MIT", ("MIT License",)),
    ("BSD-2-Clause", ("BSD 2-Clause License",)),
    ("BSD-3-Clause", ("BSD 3-Clause License",)),
    ("ISC", ("ISC License",)),
    ("MPL-2.0", ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0")),
    ("GPL-2.0", ("GNU General Public License, version 2", "GNU GPL version 2", "GNU GPL v2")),
    ("GPL-3.0", ("GNU General Public License, version 3", "GNU GPL version 3", "GNU GPL v3")),
    ("LGPL-3.0", ("GNU Lesser General Public License, version 3", "GNU LGPL version 3")),
    ("AGPL-3.0", ("GNU Affero General Public License, version 3", "GNU AGPL version 3")),
    ("CC0-1.0", ("CC0 1.0", "Creative Commons CC0 1.0 Universal License")),
    ("CC-BY-4.0", ("CC BY 4.0", "Creative Commons Attribution 4.0 International License")),
    ("CC-BY-SA-4.0", ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License")),
    ("CC-BY-NC-4.0", ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License")),
]

#: How notices begin.
OPENINGS = ("Licensed under", "Licensed under the", "Released under", "Released under the", "Distributed under", "Distributed under the", "Available under the", "This work is licensed under the", "This work is licensed under", "This software is licensed under the", "This project is licensed under the", "This program is licensed under the", "SPDX-License-Identifier")

#: Equivalent spellings, as (pattern, common form).
EQUIVALENT = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"),
    ("noncommercial", "non commercial"), ("judgement", "judgment"), ("initialise", "initialize"), ("labelling", "labeling"), ("organisation", "organization"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
    ("per cent", "percent"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"),
]

#: One of these is in every known text; what has none is not a licence.
KEYWORDS = "licen|permission|redistribution|released|distributed|available|misrepresented"


def known() -> list[tuple[str, str]]:
    """(licence, text) of all known units: whole texts with and without their title, and one-line notices."""
    whole = [(i, t) for i, title, text in TEXTS for t in (text, f"{title}\n\n{text}", f"The {title}\n\n{text}")]
    names = [(i, f"{o} {n}") for i, ns in NAMES for n in (*ns, i) for o in OPENINGS]
    return whole + names


#: SPDX identifiers of which -only and -or-later are told apart.
VERSIONED = ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "GFDL-1.2", "GFDL-1.3")

#: Lines of standard headers that name their licence, beside opening and name.
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\");"
HEADERS = [
    ("Apache-2.0", f"{_APACHE} you may not use this file except in compliance with the License."),
    ("Apache-2.0", f"{_APACHE} you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "License, v. 2.0. If a copy of the MPL was not distributed with this"),
]

_ADDRESS = re.compile(r"51 Franklin St(?:reet)?, Fifth Floor,\s+Boston,? MA\s+02110-1301,?\s+USA")
_ADDRESSES = ("59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA", "675 Mass Ave, Cambridge, MA 02139, USA")


def long_texts() -> list[tuple[str, str]]:
    """(licence, text) of the long texts as they are in use: with and without appendix, with old addresses, http for https."""
    out = {}
    for file in files("tessera.llm").joinpath("licence_texts").iterdir():
        text = file.read_text(encoding="utf-8")
        terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        for t in (text, *((terms, terms + end) if end else ())):
            for a in (t, *(_ADDRESS.sub(x, t) for x in _ADDRESSES)):
                for u in (a, a.replace("https://", "http://"), a.replace("http://", "https://")):
                    out[u] = file.name.removesuffix(".txt")
    return [(i, t) for t, i in out.items()]


def more_known() -> list[tuple[str, str]]:
    """(licence, text) of the known units that the SQL doesn't list: long texts, standard header lines, further identifiers."""
    long = long_texts()
    headers = [(i, f'{o} {n} (the "License")') for i, ns in NAMES for n in ns for o in OPENINGS[:-1]]
    ids = sorted({i for i, _ in long} | {i for i, _, _ in TEXTS} | {i for i, _ in NAMES} | set(VERSIONED)) + [f"{i}-{x}" for i in VERSIONED for x in ("only", "or-later")]
    return long + headers + HEADERS + [(i, f"SPDX-License-Identifier: {i}") for i in ids]


#: A line that begins as a copyright notice does, and what must not follow for a name to stand there.
_NOTICE = r"^[^a-z0-9]*copyright"
_SIGNED = r"^[^a-z0-9]*(copyright.*(\(c\)|©|\b(19|20)[0-9][0-9]\b|<year>|\[year\]|yyyy)|©|\(c\).*\b(19|20)[0-9][0-9]\b)"
_PROSE = r"^[^a-z0-9]*copyright[^a-z0-9]*(notices?|holders?|owners?|licen[cs]es?|laws?|interests?|statements?|permissions?|and|or|in|on|to|of|is|as|are|may|must|shall|will|the|this|that|with|by the|rights?|materials?|treat(y|ies)|protections?|disclaimers?|status|ownership|infringements?|restrictions?|legends?|terms|$)\b"
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F©“”‘’–—•]+"
#: List marks as words of their own, and the phrase that notices end in.
_MARK = r"\b([a-z]|[0-9]{1,2}|all rights reserved)\b"


def _notice(line: Column) -> Column:
    """Whether a line (in lower case) is a copyright notice."""
    return line.rlike(_SIGNED) | (line.rlike(_NOTICE) & ~line.rlike(_PROSE) & (F.length(line) <= 100))


def canonical(text: Column) -> Column:
    """Of one-line units."""
    lines = F.filter(F.split(ascii_lower(text), "\n"), lambda x: ~_notice(x))
    out = F.trim(F.regexp_replace(F.array_join(lines, "\n"), _NOT_WORD, " "))
    for spelling, common in EQUIVALENT:
        out = F.regexp_replace(out, rf"\b{spelling}\b", common)
    return out


def canonical_whole(text: Column) -> Column:
    """Of whole texts: without list marks besides."""
    return F.trim(F.regexp_replace(F.regexp_replace(canonical(text), _MARK, ""), " +", " "))


def _canon(whole: Column, unit: Column) -> Column:
    return F.sha2(F.when(whole, F.concat(F.lit("whole "), canonical_whole(unit))).otherwise(canonical(unit)), 256)


def known_digests(spark: SparkSession) -> DataFrame:
    """canon (SHA-256) and license of every known unit, as a whole text and as a line."""
    rows = spark.createDataFrame(known() + more_known(), "license string, text string").withColumn("whole", F.explode(F.array(F.lit(True), F.lit(False))))
    return rows.groupBy(_canon(F.col("whole"), F.col("text")).alias("canon")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, license (of the whole text), n_notices (lines that are one) and notices (their licences, comma-joined)."""
    spark = docs.sparkSession
    texts = docs.select("text", F.md5("text").alias("digest")).filter(ascii_lower(F.col("text")).rlike(KEYWORDS))
    lines = F.filter(F.split("text", "\n"), lambda x: ascii_lower(x).rlike(KEYWORDS))
    units = F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.lit(0).alias("n"), F.col("text").alias("unit"))), F.transform(lines, lambda x, i: F.struct(F.lit(False).alias("whole"), i.alias("n"), x.alias("unit"))))
    each = texts.select("digest", F.explode(units).alias("u")).select("digest", "u.whole", "u.n", _canon(F.col("u.whole"), F.col("u.unit")).alias("canon"))
    found = each.join(F.broadcast(known_digests(spark)), "canon")  # a fixed table of less than a thousand rows
    by_text = found.groupBy("digest").agg(
        F.max(F.when(F.col("whole"), F.col("license"))).alias("license"),
        F.collect_set(F.when(~F.col("whole"), F.struct("n", "license"))).alias("lines"),
    )
    by_text = by_text.select("digest", "license", F.size("lines").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct(F.transform("lines", lambda x: x["license"]))), ",").alias("notices"))
    by_text = written(by_text, "text-licenses")  # joined by itself, so that a text with very many copies can be split
    rows = docs.select("doc_id", F.md5("text").alias("digest")).join(by_text, "digest", "left")
    return rows.select("doc_id", "license", F.coalesce("n_notices", F.lit(0).cast("long")).alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))


def op8_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 over all documents."""
    return scan(table(spark, sf_dir, "documents"))


def _sql_canonical(x: str, whole: bool) -> str:
    lines = f"string_split(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10))"
    notice = f"(regexp_matches(l, '{_SIGNED}') OR (regexp_matches(l, '{_NOTICE}') AND NOT regexp_matches(l, '{_PROSE}') AND length(l) <= 100))"
    out = f"trim(regexp_replace(array_to_string(list_filter({lines}, lambda l: NOT {notice}), chr(10)), '{_NOT_WORD}', ' ', 'g'))"
    for spelling, common in EQUIVALENT:
        out = f"regexp_replace({out}, '\\b{spelling}\\b', '{common}', 'g')"
    if whole:
        out = f"'whole ' || trim(regexp_replace(regexp_replace({out}, '{_MARK}', '', 'g'), ' +', ' ', 'g'))"
    return f"sha256({out})"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


OP8_SQL = f"""
WITH v(license, t) AS (VALUES {", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in known())}),
kw AS (SELECT {_sql_canonical("t", True)} AS canon, min(license) AS license FROM v GROUP BY ALL),
kl AS (SELECT {_sql_canonical("t", False)} AS canon, min(license) AS license FROM v GROUP BY ALL),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
whole AS (SELECT r, license FROM (SELECT r, text FROM d WHERE regexp_matches(text, '(?i){KEYWORDS}')) JOIN kw ON {_sql_canonical("text", True)} = canon),
line AS (SELECT r, unnest(string_split(text, chr(10))) AS t FROM d),
hit AS (SELECT r, license FROM (SELECT r, t FROM line WHERE regexp_matches(t, '(?i){KEYWORDS}')) JOIN kl ON {_sql_canonical("t", False)} = canon),
named AS (SELECT r, count(*)::BIGINT AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS ids FROM hit GROUP BY r)
SELECT doc_id, whole.license AS license, coalesce(n, 0)::BIGINT AS n_notices, coalesce(ids, '') AS notices
FROM d LEFT JOIN whole USING (r) LEFT JOIN named USING (r)
"""
