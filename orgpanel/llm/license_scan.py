"""Licence scan by canonical digest lookup.

A text is brought to a canonical form: lower case, copyright lines, "All rights reserved" lines and the title at its head out,
equivalent spellings made one, punctuation to spaces, white space collapsed. Its md5 is joined with the digests of known licences. The whole text of each document is looked up, and each of its lines on
its own, as short notices stand within longer texts. The table of known digests comes from this module and the texts in
``licenses``, so its broadcast has a fixed size. A text of several lines within a longer document is not found. All known forms hold one of the
words in ``GATE``, so texts and lines without them are not brought to their form.

Edge cases: null and empty texts have an empty form, which no licence has; repeated rows count once for each
doc_id; null doc_ids are left out; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts of licences and of customary notices, as their authors publish them; longer ones are in the folder ``licenses``.
LICENSES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}

_GNU = """{this} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{version}.
{this} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.
You should have received a copy of the GNU {name} along with {it}. If not, see <https://www.gnu.org/licenses/>."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
{0}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
{1}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{2}THIS SOFTWARE IS PROVIDED BY THE {4} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE {3} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_NEITHER = "Neither the name of {0} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"


def _families() -> list[tuple[str, str]]:
    """BSD texts numbered and with bullets, headers of the GNU licences with and without later versions."""
    out = []
    for marks in (("1. ", "2. ", "3. "), ("* ", "* ", "* ")):
        for who, by in (("COPYRIGHT HOLDER OR CONTRIBUTORS", "COPYRIGHT HOLDERS AND CONTRIBUTORS"), ("REGENTS OR CONTRIBUTORS", "REGENTS AND CONTRIBUTORS")):
            out.append(("BSD-2-Clause", _BSD.format(*marks[:2], "", who, by)))
            for name in ("the copyright holder", "the University"):
                out.append(("BSD-3-Clause", _BSD.format(*marks[:2], marks[2] + _NEITHER.format(name), who, by)))
    for short, name, versions in (("GPL", "General Public License", ("2", "3")), ("LGPL", "Lesser General Public License", ("2.1", "3")), ("AGPL", "Affero General Public License", ("3",))):
        for v in versions:
            only = {"2": "2.0", "3": "3.0"}.get(v, v)
            forms = {f", version {v}": "only", f"; version {v}": "only", f", either version {v} of the License, or (at your option) any later version": "or-later", f"; either version {v} of the License, or (at your option) any later version": "or-later"}
            for version, kind in forms.items():
                for this, it in (("This program", "this program"), ("This library", "this library"), ("This library", "this program")):
                    out.append((f"{short}-{only}-{kind}-header", _GNU.format(this=this, it=it, colon=":", name=name, version=version)))
    return out


def license_texts() -> list[tuple[str, str]]:
    """(name, text) of every known licence; those with an appendix also without it."""
    out = list(LICENSES.items()) + _families()
    for path in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        text = path.read_text()
        end = text.find("END OF TERMS AND CONDITIONS")
        out += [(path.stem, text)] + ([(path.stem, text[: end + 27]), (path.stem, text[:end])] if end > 0 else [])
    return out


#: Lines that are nothing but a title, at the head of a text.
_TITLE = [
    r"(?:the )?mit license(?: \(mit\))?",
    r"(?:the )?(?:isc|zlib|unlicense|(?:new |modified |simplified |revised )?bsd)(?: license)?",
    r"(?:the )?(?:bsd )?[23][ -]clause (?:bsd )?license",
    r'bsd 3-clause "(?:new|revised)"(?: or "(?:new|revised)")? license',
    r"apache license(?:,? version 2\.0)?(?:,? january 2004)?",
    r"version 2\.0, january 2004",
    r"(?:www\.)?apache\.org/licenses/?",
    r"gnu (?:lesser |library |affero )?general public license",
    r"version [123](?:\.[01])?, (?:[0-9]+ )?(?:february|june|november) [0-9]{4}",
    r"(?:51 franklin|59 temple|675 mass)[^\n]*",
    r"mozilla public license,? version (?:1\.1|2\.0)",
    r"mozilla public license",
    r"version 2\.0",
    r"creative commons legal code",
    r"cc0 1\.0 universal",
    r"boost software license - version 1\.0 - august 17th, 2003",
]
TITLES = r"^(?:[^a-z0-9]*(?:" + "|".join(_TITLE) + r")[^a-z0-9\n]*(?:\n|$))+"

#: (pattern, replacement) in order, in the syntax that Java, Python and RE2 share.
RULES = [
    (r"copyright[^a-z0-9]+(?:notices?|holders?|owners?|ownership|laws?|licen[cs]es?|line|disclaimer|interests?|permission|treaty|statement|patent|doctrines|the (?:software|library|program)|and|or|on|if|is|are|also|like|those)[^a-z0-9]", "protected\n"),
    (r"(?m)^[^\n]*(?:copyright \(c\)|copyright ©|copyright [0-9]|©)[^\n]*$", " "),
    (r"(^|\n)[^a-z0-9\n]*(?:portions )?(?:copyright[^a-z0-9]|\(c\)[^a-z0-9\n]*[0-9]{4})[^\n]*", "\n"),
    (r"(^|\n)[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*(\n|$)", "\n"),
    (r"https?://", ""),
    (r"licence", "license"),
    (TITLES, ""),
    (r"sub-licen[sc]e", "sublicense"),
    (r"merchantibility", "merchantability"),
    (r"non-infringement", "noninfringement"),
    (r"non-commercial", "noncommercial"),
    (r"acknowledgement", "acknowledgment"),
    (r"[^a-z0-9]+", " "),
]


def canonical(text: Column) -> Column:
    form = F.lower(F.coalesce(text, F.lit("")))
    for pattern, to in RULES:
        form = F.regexp_replace(form, pattern, to)
    return F.trim(form)


def canonical_text(text: str) -> str:
    form = text.lower()
    for pattern, to in RULES:
        form = re.sub(pattern, to, form)
    return form.strip(" ")


#: Each known form holds one of these; both spellings of the first.
GATE = "licen[cs]e|permission|public domain|redistribut"


def known_digests() -> list[tuple[str, str]]:
    """Each digest once; of texts with one canonical form the first gives the name."""
    known: dict[str, str] = {}
    for name, text in license_texts():
        known.setdefault(hashlib.md5(canonical_text(text).encode()).hexdigest(), name)
    return list(known.items())


def license_matches(docs: DataFrame) -> DataFrame:
    """doc_id, whole (the licence that the whole text is, or null), licenses (all found, comma-joined), n_lines (lines that are a known notice)."""
    values = ", ".join(f"('{d}', '{n}')" for d, n in known_digests())
    known = F.broadcast(docs.sparkSession.sql(f"select * from values {values} as t(digest, license)"))
    texts = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.lower("text").rlike(GATE))
    whole = texts.select("doc_id", F.lit(True).alias("whole"), F.md5(canonical(F.col("text")).cast("binary")).alias("digest"))
    lines = texts.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.lower("line").rlike(GATE))
    lines = lines.select("doc_id", F.lit(False).alias("whole"), F.md5(canonical(F.col("line")).cast("binary")).alias("digest"))
    found = whole.join(known, "digest").unionAll(lines.join(known, "digest"))
    return found.groupBy("doc_id").agg(
        F.max(F.when(F.col("whole"), F.col("license"))).alias("whole"),
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
        F.count_if(~F.col("whole")).alias("n_lines"),
    )


def license_sql() -> str:
    """The same in DuckDB's SQL."""

    def form(column: str) -> str:
        out = f"lower(coalesce({column}, ''))"
        for pattern, to in RULES:
            out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
        return f"md5(trim({out}, ' '))"

    values = ", ".join(f"('{d}', '{n}')" for d, n in known_digests())
    return f"""
        WITH known(digest, license) AS (VALUES {values}),
        units AS (
            SELECT doc_id, true AS w, {form('text')} AS digest FROM documents WHERE doc_id IS NOT NULL
            UNION ALL
            SELECT doc_id, false, {form('line')} FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents WHERE doc_id IS NOT NULL))
        SELECT doc_id, max(CASE WHEN w THEN license END) AS whole, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
               count(*) FILTER (NOT w) AS n_lines
        FROM units JOIN known USING (digest) GROUP BY doc_id"""
