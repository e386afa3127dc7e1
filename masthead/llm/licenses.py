"""Operator 2: licence scan by canonical digests.

A text is normalised (case, copyright lines, equivalent spellings, punctuation,
comment leaders, white space) and its SHA-256 is looked up among the digests of known licences by
a hash join.  Units are the whole text and each of its lines, each taken entire.
The built-in table of known digests is fixed by this module (under 400 rows), so it
is broadcast; the scan is one narrow stage without a shuffle.  It covers the texts
and declarations below and the digests of FULL_DIGESTS; full texts of AGPL-3.0 and of
the Creative Commons licences but CC0 are not in it and need a table of their own.
The SQL has the table without FULL_DIGESTS.

Defined results: one row for each unit that is a known licence, with the unit
(``text`` or ``line``) and the line's number from 0 (null for the whole text); a
text of one line counts as ``text`` only.  Null and empty texts match nothing;
repeated rows give repeated matches; other columns are not carried.
"""

from __future__ import annotations

import functools
import hashlib
import re
from functools import cache
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rewrites in order, in a form that Java, Python and RE2 read alike (fixed values).
#: A copyright line has a sign, a year or a place for one, after any comment leader; other lines that begin with the word are text.
COPYRIGHT_LINE = r"(?m)^[ \t/*#;%!.-]*(portions )?(copyright[ \t:]*(\(c\)|©|[\[<{]|[12][0-9]{3})|copyright[^\n]*[ ,][12][0-9]{3}\b|\(c\)[ \t]*(copyright|[12][0-9]{3})|©)[^\n]*$"
REWRITES = [
    (COPYRIGHT_LINE, " "),
    (r"https://", "http://"),
    (r"[^a-z0-9]+", " "),
    (r"\b(all rights reserved)\b", " "),
    (r"\blicence", "license"),
    (r"\bsub licen", "sublicen"),
    (r"\bnon commercial", "noncommercial"),
    (r"\bwhilst\b", "while"),
    (r"\bfavour", "favor"),
    (r"\borganisation", "organization"),
    (r"\backnowledgement", "acknowledgment"),
    (r"\bcopyright (owner|holder)", "copyright holder"),
    (r" +", " "),
]

_PERMISSION = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
_MIT_DISCLAIMER = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_DISCLAIMER = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Whole licence texts (fixed values; copyright lines and titles may be present or not).
TEXTS = {
    "MIT": [_PERMISSION + _MIT_DISCLAIMER, "MIT License\n\n" + _PERMISSION + _MIT_DISCLAIMER, "The MIT License (MIT)\n\n" + _PERMISSION + _MIT_DISCLAIMER],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_DISCLAIMER],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_DISCLAIMER],
    "BSD-2-Clause": [_BSD_HEAD + _BSD_DISCLAIMER, "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_DISCLAIMER],
    "BSD-3-Clause": [_BSD_HEAD + _BSD_THIRD + _BSD_DISCLAIMER, "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_DISCLAIMER],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "GPL-3.0-or-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License along with this program. If not, see <http://www.gnu.org/licenses/>."],
}
#: Declarations of one sentence: an opening and a licence's name (fixed values).
OPENINGS = ["Released under", "Licensed under", "Distributed under", "Published under", "Available under", "This work is licensed under", "This software is licensed under", "This project is licensed under"]
NAMES = {
    "MIT": ["the MIT License", "the terms of the MIT License"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache-2.0"],
    "GPL-3.0-only": ["the GNU General Public License, version 3", "the GNU GPL v3", "GPL-3.0"],
    "GPL-2.0-only": ["the GNU General Public License, version 2", "the GNU GPL v2"],
    "LGPL-3.0-only": ["the GNU Lesser General Public License, version 3"],
    "AGPL-3.0-only": ["the GNU Affero General Public License, version 3"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"],
    "BSD-3-Clause": ["the BSD 3-Clause License"],
    "BSD-2-Clause": ["the BSD 2-Clause License"],
    "ISC": ["the ISC License"],
    "CC0-1.0": ["CC0 1.0", "the CC0 1.0 Universal license"],
    "CC-BY-4.0": ["CC BY 4.0", "the Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0"],
}

#: Digests of whole legal texts, with and without the appendix on how to apply them (fixed values).
FULL_DIGESTS = {
    "Apache-2.0": ["036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b", "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe"],
    "BSD-3-Clause": ["21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"],
    "CC0-1.0": ["96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"],
    "GFDL-1.2-only": ["15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"],
    "GFDL-1.3-only": ["2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"],
    "GPL-1.0-only": ["8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"],
    "GPL-2.0-only": ["efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"],
    "GPL-3.0-only": ["eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"],
    "LGPL-2.0-only": ["61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"],
    "LGPL-2.1-only": ["4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"],
    "LGPL-3.0-only": ["aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"],
    "MPL-1.1": ["cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"],
    "MPL-2.0": ["6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"],
    "Unlicense": ["e2380bdfe57ca73b01d0b1848a4ee630998d729b260e63082b9267100b4a7229"],
}


def canonical(text: str) -> str:
    """The normal form, for the known texts."""
    text = text.lower()
    for pattern, to in REWRITES:
        text = re.sub(pattern, to, text)
    return text.strip(" ")


def canonical_column(text: Column) -> Column:
    text = F.lower(text)
    for pattern, to in REWRITES:
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


@cache
def known() -> list[tuple[str, str]]:
    """(digest, licence) of the texts in this module, as the SQL has them."""
    pairs = [(t, name) for name, texts in TEXTS.items() for t in texts]
    pairs += [(f"{o} {n}", name) for o, (name, forms) in product(OPENINGS, NAMES.items()) for n in forms]
    found: dict[str, str] = {}
    for text, name in pairs:
        found.setdefault(hashlib.sha256(canonical(text).encode()).hexdigest(), name)
    return sorted(found.items())


@cache
def all_known() -> list[tuple[str, str]]:
    """(digest, licence) of all known texts: those of the SQL and the whole legal texts."""
    return sorted({**{d: name for name, of in FULL_DIGESTS.items() for d in of}, **dict(known())}.items())


@cache
def markers() -> list[str]:
    """Words of which every known text has at least one, and that no rewrite makes or changes.

    A text that lacks them all in lower case can't have a known digest, so it needs
    no normalising; the texts of FULL_DIGESTS have some too. Chosen greedily: the word that covers the most texts first.
    """
    texts = {canonical(t) for of in TEXTS.values() for t in of}
    texts |= {canonical(f"{o} {n}") for o, forms in product(OPENINGS, NAMES.values()) for n in forms}
    made = " ".join(to for _, to in REWRITES) + " licence reserved rights organisation acknowledgement owner"
    left, chosen = {t: {w for w in t.split() if len(w) >= 5 and w.isalpha() and w not in made and not any(m in w for m in ("licen", "favo", "commercial"))} for t in texts}, []
    while left:
        best = min({w for words in left.values() for w in words}, key=lambda w: (-sum(w in words for words in left.values()), w))
        chosen.append(best)
        left = {t: words for t, words in left.items() if best not in words}
    return chosen


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: DataFrame | None = None) -> DataFrame:
    """doc_id, unit, line_no, license_id and digest of each match.

    table: known texts as (text, license_id), or their digests as (digest,
    license_id), to look up in place of the built-in ones; every text is then
    normalised, and a digest of several licences gives a row for each.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if table is None:
        table = F.broadcast(spark.createDataFrame(all_known(), "digest string, license_id string"))
        marked = lambda: functools.reduce(lambda a, b: a | b, [F.contains(F.lower("text"), F.lit(m)) for m in markers()])
    else:
        digest = F.col("digest") if "digest" in table.columns else F.sha2(canonical_column(F.col("text")), 256)
        table = table.select(digest.alias("digest"), "license_id").distinct()
        marked = lambda: F.lit(True)
    rows = rows.filter(marked())
    whole = rows.select("doc_id", F.lit("text").alias("unit"), F.lit(None).cast("int").alias("line_no"), "text")
    lines = F.split("text", "\n")
    each = rows.filter(F.contains("text", F.lit("\n"))).select("doc_id", F.lit("line").alias("unit"), F.posexplode(lines).alias("line_no", "text")).filter(marked())
    units = whole.unionByName(each).select("doc_id", "unit", "line_no", F.sha2(canonical_column(F.col("text")), 256).alias("digest"))
    return units.join(table, "digest").select("doc_id", "unit", "line_no", "license_id", "digest")


def oracle() -> str:
    values = ", ".join(f"('{d}', '{name}')" for d, name in known())
    text = "lower(text)"
    for pattern, to in REWRITES:
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    return f"""
WITH known(digest, license_id) AS (VALUES {values}),
units AS (
  SELECT doc_id, 'text' AS unit, NULL::INTEGER AS line_no, text FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, 'line', (n - 1)::INTEGER, parts[n] FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE contains(text, chr(10))), unnest(range(1, len(parts) + 1)) AS u(n)
),
digests AS (SELECT doc_id, unit, line_no, sha256(trim({text}, ' ')) AS digest FROM units)
SELECT doc_id, unit, line_no, license_id, digest FROM digests JOIN known USING (digest)
"""
