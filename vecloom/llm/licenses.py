"""Licence scan by canonical digests.

A text and each of its lines are brought to a canonical form - ASCII lower case, copyright lines gone, equivalent spellings made one,
punctuation and white space one blank - and their SHA-256 is looked up among the digests of known texts by a hash join. Only whole
units match: a licence text that fills a document, or a notice that fills a line.

Nulls and texts without words match nothing, and known texts without words are left out. Repeated rows give repeated hits; null ids
are kept. Columns besides doc_id and text are not read. Native: DataFrame functions only, one pass, no shuffle of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that count as the same word.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalisations", "capitalizations"), ("catalogue", "catalog"),
    ("categorise", "categorize"), ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"),
    ("licenced", "licensed"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"),
    ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"),
    ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("noncommercial", "non commercial"), ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"), ("sub license", "sublicense"), ("per cent", "percent"),
]

_MIT_BODY = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_BODY = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{0}.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TERMS = [
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission.",
]
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute "
    "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\n"
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
    "public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this "
    "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
    "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\n"
    "For more information, please refer to <{0}://unlicense.org{1}>"
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the "
    "use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
    "redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you "
    "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
    "required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
    "3. This notice may not be removed or altered from any source distribution."
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
    "this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the "
    "Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\n"
    "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must "
    "be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are "
    "solely in the form of machine-executable object code generated by a source language processor.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR "
    "ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE."
)
_APACHE_NOTICE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of "
    "the License at\n\n{0}://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the "
    "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
    "language governing permissions and limitations under the License."
)
_MPL_NOTICE = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
    "obtain one at {0}://mozilla.org/MPL/2.0/."
)
_GNU_NOTICE = (
    "This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, "
    "either version {version} of the License, or (at your option) any later version.\n\nThis {work} is distributed in the hope that it will be useful, but "
    "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.\n\n"
    "You should have received a copy of the GNU {name} along with this {work}. If not, see <{web}://www.gnu.org/licenses/>."
)


def _bsd(clauses: int) -> list[str]:
    """Numbered and with marks, with and without a heading."""
    terms = _BSD_TERMS[:clauses]
    bodies = ["\n\n".join([_BSD_HEAD, *(f"{i}. {t}" if numbers else t for i, t in enumerate(terms, 1)), _BSD_TAIL]) for numbers in (True, False)]
    heads = ["", f"BSD {clauses}-Clause License\n", f"The {clauses}-Clause BSD License\n", f"The BSD {clauses}-Clause License\n"]
    return [h + b for h in heads for b in bodies]


_GNU = [
    ("GPL-3.0-or-later", "General Public License", "3", ("program", "file")), ("AGPL-3.0-or-later", "Affero General Public License", "3", ("program",)),
    ("LGPL-3.0-or-later", "Lesser General Public License", "3", ("program", "library")), ("GPL-2.0-or-later", "General Public License", "2", ("program",)),
    ("LGPL-2.1-or-later", "Lesser General Public License", "2.1", ("library", "program")),
]
_WEB = ("http", "https")
# Known licence texts and notices. A caller's own table (license_id, text) can be used instead.
KNOWN = [
    ("MIT", _MIT_BODY), ("MIT", "MIT License\n" + _MIT_BODY), ("MIT", "The MIT License (MIT)\n" + _MIT_BODY),
    ("ISC", _ISC_BODY.format(", provided that the above copyright notice and this permission notice appear in all copies")),
    ("ISC", "ISC License\n" + _ISC_BODY.format(", provided that the above copyright notice and this permission notice appear in all copies")),
    ("0BSD", _ISC_BODY.format("")), ("0BSD", "Zero-Clause BSD\n" + _ISC_BODY.format("")),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."), ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."), ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"), ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"), ("ISC", "SPDX-License-Identifier: ISC"),
    *(("BSD-2-Clause", t) for t in _bsd(2)), *(("BSD-3-Clause", t) for t in _bsd(3)),
    *(("Unlicense", _UNLICENSE.format(w, end)) for w in _WEB for end in ("", "/")), ("Zlib", _ZLIB), ("Zlib", "zlib License\n" + _ZLIB), ("Zlib", "The zlib License\n" + _ZLIB),
    ("BSL-1.0", _BOOST), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n" + _BOOST), ("MIT-0", _MIT_BODY.split(", subject to", 1)[0] + ".\n\n" + _MIT_BODY.rsplit("\n\n", 1)[1]),
    ("MIT-0", "MIT No Attribution\n" + _MIT_BODY.split(", subject to", 1)[0] + ".\n\n" + _MIT_BODY.rsplit("\n\n", 1)[1]),
    *(("Apache-2.0", _APACHE_NOTICE.format(w)) for w in _WEB), *(("MPL-2.0", _MPL_NOTICE.format(w)) for w in _WEB),
    *((i, _GNU_NOTICE.format(work=work, name=name, version=v, web=w)) for i, name, v, works in _GNU for work in works for w in _WEB),
    *((i, f"SPDX-License-Identifier: {i}") for i in ("Unlicense", "Zlib", "BSL-1.0", "MIT-0", "0BSD", "CC0-1.0", "CC-BY-4.0", "GPL-2.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only", *(x[0] for x in _GNU))),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that only claims copyright, after comment marks: with a sign or year first, or with a year last.
COPYRIGHT = r"^[^a-z0-9]*(copyright|copr|\(c\)|\x{a9})[^a-z]*[0-9\x{a9}(].*$|^[^a-z0-9]*(copyright|copr) .{1,80}(19|20)[0-9][0-9][^a-z0-9]*$|^[^a-z0-9]*all rights reserved[^a-z0-9]*$"
#: Or names of one to five words without a year, unless there are words of the licences' own sentences among them.
BARE, OWN = r"^[^a-z0-9]*copyright( by)?( [^ 0-9]+){1,5}[^a-z0-9]*$", r"holder|owner|notice|law|licen|interest|author|contribut| and this| or "
#: The runs that become one blank.
GAPS = r"[\x00-\x2f\x3a-\x60\x7b-\x7f\x{a9}\x{2013}\x{2014}\x{2018}\x{2019}\x{201c}\x{201d}]+"
VARIANTS = rf"(^| )({'|'.join(a for a, _ in SPELLINGS)})( |$)"


def canonical_line(line: Column) -> Column:
    """Canonical form of a line, empty for a copyright line."""
    low = F.translate(line, UPPER, LOWER)
    flat = F.concat(F.lit(" "), F.trim(F.regexp_replace(low, GAPS, " ")), F.lit(" "))
    spelt = flat
    for a, b in SPELLINGS * 2:  # of two neighbours, the first turn sees one
        spelt = F.replace(spelt, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(F.when(low.rlike(COPYRIGHT) | (low.rlike(BARE) & ~low.rlike(OWN)), F.lit("")).when(flat.rlike(VARIANTS), spelt).otherwise(flat))


def units(docs: DataFrame, key: str) -> DataFrame:
    """(key, line_no, form): the text (line_no null) and its lines from 0, in canonical form, without empty ones. Linear in the lines."""
    forms = docs.select(key, F.transform(F.split("text", "\n", -1), canonical_line).alias("lines"))
    # used twice below, so that they are columns and not made anew for each line
    kept = forms.select(key, "lines", F.array_remove("lines", "").alias("kept"))
    several = kept.select(key, "lines", (F.size("kept") > 1).alias("several"), F.when(F.size("kept") > 1, F.concat_ws(" ", "kept")).alias("whole"))
    rows = several.select(key, "several", "whole", F.posexplode(F.array_append("lines", F.col("whole"))).alias("line_no", "form"), F.size("lines").alias("n"))
    # a text of one line is that line; it counts once, as the text
    line_no = F.when(F.col("several") & (F.col("line_no") < F.col("n")), F.col("line_no"))
    return rows.where("form <> ''").select(key, line_no.alias("line_no"), "form")


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """(license_id, digest), a row a digest. The table in this module has a fixed size and is broadcast; for another, Spark decides."""
    table = spark.createDataFrame(KNOWN, "license_id string, text string") if known is None else known.select("license_id", "text")
    whole = units(table, "license_id").where("line_no IS NULL")
    out = whole.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))
    return F.broadcast(out) if known is None else out


def license_hits(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, line_no, license_id, digest): line_no null where the whole text matches."""
    found = units(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id").select("doc_id", "line_no", F.sha2("form", 256).alias("digest"))
    return found.join(known_digests(docs.sparkSession, known), "digest").select("doc_id", "line_no", "license_id", "digest")


def license_hits_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def units_sql(table: str, key: str) -> str:
        spelt = "f"
        for a, b in SPELLINGS * 2:
            spelt = f"replace({spelt}, ' {a} ', ' {b} ')"
        low = f"SELECT {key}, i - 1 AS i, translate(l[i], '{UPPER}', '{LOWER}') AS x FROM (SELECT {key}, l, unnest(range(1, len(l) + 1)) AS i, r FROM (SELECT {key}, string_split(text, chr(10)) AS l, row_number() OVER () AS r FROM {table}))"
        low = low.replace(" AS x FROM", " AS x, r FROM", 1)
        flat = f"SELECT {key}, r, i, x, ' ' || trim(regexp_replace(x, '{GAPS}', ' ', 'g')) || ' ' AS f FROM ({low})"
        form = f"SELECT {key}, r, i, trim(CASE WHEN regexp_matches(x, '{COPYRIGHT}') OR regexp_matches(x, '{BARE}') AND NOT regexp_matches(x, '{OWN}') THEN '' ELSE {spelt} END) AS form FROM ({flat})"
        some = f"SELECT *, count(*) OVER (PARTITION BY r) AS n FROM ({form}) WHERE form <> ''"
        return f"SELECT {key}, CASE WHEN n > 1 THEN CAST(i AS INT) END AS line_no, form FROM ({some}) UNION ALL SELECT any_value({key}), NULL, string_agg(form, ' ' ORDER BY i) FROM ({some}) WHERE n > 1 GROUP BY r"

    known = "SELECT * FROM (VALUES " + ", ".join(f"({quote(i)}, {quote(t)})" for i, t in KNOWN) + ") v(license_id, text)"
    return f"""WITH k AS (SELECT sha256(form) AS digest, min(license_id) AS license_id FROM ({units_sql(f"({known})", "license_id")}) WHERE line_no IS NULL GROUP BY 1)
SELECT doc_id, line_no, license_id, digest FROM (SELECT doc_id, line_no, sha256(form) AS digest FROM ({units_sql("documents", "doc_id")})) JOIN k USING (digest)"""
