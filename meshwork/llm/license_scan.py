"""License scans by canonical digest lookup.

A text is made canonical (case, copyright lines, equivalent spellings, punctuation and spacing) and its digest is
looked up among the digests of known licence texts. Whole texts are compared, so a licence inside a longer text isn't
reported. Built-in functions only; the known digests are one row per licence. ``known_licenses`` has a few short
licences; ``license_files`` reads a folder of them, such as those that come with an operating system.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that licences use for each other.
EQUIVALENT = [
    ("https", "http"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authorisation", "authorization"), ("behaviour", "behavior"),
    ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"), ("customisation", "customization"), ("defence", "defense"),
    ("favour", "favor"), ("fulfil", "fulfill"), ("honour", "honor"), ("judgement", "judgment"), ("labour", "labor"), ("licence", "license"),
    ("merchantability", "merchantibility"), ("non commercial", "noncommercial"), ("organisation", "organization"), ("per cent", "percent"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("sub license", "sublicense"), ("utilisation", "utilization"),
    ("while", "whilst"), ("copyright owner", "copyright holder"),
]
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{}.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.\n\n{}"
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
    "DAMAGE."
)
#: Known licence texts. A cluster passes its own, larger table to ``scanned``.
KNOWN = {
    "MIT": (
        "MIT License\n\nCopyright (c) <year> <holder>\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions "
        f"of the Software.\n\n{_AS_IS}"
    ),
    "ISC": "ISC License\n\nCopyright (c) <year> <holder>\n\n" + _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies"),
    "0BSD": "BSD Zero Clause License\n\nCopyright (c) <year> <holder>\n\n" + _ISC.format(""),
    "BSD-2-Clause": "BSD 2-Clause License\n\nCopyright (c) <year>, <holder>\n\n" + _BSD.format(""),
    "BSD-3-Clause": "BSD 3-Clause License\n\nCopyright (c) <year>, <holder>\n\n"
    + _BSD.format(
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission.\n\n"
    ),
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy '
        "of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under "
        'the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "MIT-0": (
        "MIT No Attribution\n\nCopyright <year> <holder>\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        f"modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n\n{_AS_IS}"
    ),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
        "obtain one at https://mozilla.org/MPL/2.0/."
    ),
    **{
        f"{name}-{version}-or-later-notice": (
            f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the "
            f"Free Software Foundation, either version {version[0]} of the License, or (at your option) any later version.\n\nThis program is distributed in the hope "
            "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
            f"{kind}General Public License for more details.\n\nYou should have received a copy of the GNU {kind}General Public License along with this program. If not, "
            "see <https://www.gnu.org/licenses/>."
        )
        for name, version, kind in (("GPL", "2.0", ""), ("GPL", "3.0", ""), ("LGPL", "3.0", "Lesser "), ("AGPL", "3.0", "Affero "))
    },
    "Zlib": (
        "zlib License\n\nCopyright (c) <year> <holder>\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors "
        "be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
        "documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as "
        "being the original software.\n3. This notice may not be removed or altered from any source distribution."
    ),
}
#: What makes a text canonical: pattern, replacement, in order, on lower-cased text. RE2 and Java read them alike. A
#: copyright line begins with a sign, or with the word and has a sign, a placeholder or a year; other lines that begin
#: with the word are a licence's own ("copyright notice, this list ...").
STEPS = [
    (r"(^|\n)[ \t]*(\(c\)|©|copyright[ \t]*(\(c\)|©|[<\[{])|copyright[^\n]*[12][0-9][0-9][0-9])[^\n]*", "\n"),
    (r"all rights reserved\.?", " "),
    (r"[^a-z0-9\u0080-\U0010ffff]+", " "),
]


def canonical(text: Column) -> Column:
    """The canonical form of a text; null stays null."""
    out = F.lower(text)
    for pattern, new in STEPS:
        out = F.regexp_replace(out, pattern.replace(r"\u0080-\U0010ffff", "\u0080-\U0010ffff"), new)
    # Each word between two spaces of its own, so that neighbours and ends are replaced too.
    out = F.concat(F.lit(" "), F.replace(F.trim(out), F.lit(" "), F.lit("  ")), F.lit(" "))
    for old, new in EQUIVALENT:
        out = F.replace(out, F.lit(_spaced(old)), F.lit(_spaced(new)))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def _spaced(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def license_files(spark: SparkSession, path: str) -> DataFrame:
    """Known licences from the files of a folder, one each: license_id is the file's name without ``.txt``."""
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.txt$", "")
    return spark.read.text(path, wholetext=True).select(name.alias("license_id"), F.col("value").alias("license_text"))


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOWN.items()), "license_id string, license_text string")


def scanned(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The licence that each whole text is: id, canonical_bytes, digest, license_id (null: none).

    ``known`` has license_id and license_text; licences with one canonical text are one, under the first name. A text
    that is null, or empty once canonical, has no licence (null text: null digest and bytes). Repeated rows are
    reported each; an empty table gives no rows; other columns are dropped. Spark broadcasts the known digests only
    while their size is under its own threshold.
    """
    rows = docs.select(F.col(id_col), canonical(F.col(text_col)).alias("canonical")).select(
        id_col, F.octet_length("canonical").cast("long").alias("canonical_bytes"), F.sha2("canonical", 256).alias("digest")
    )
    digests = (
        known.select(F.sha2(canonical(F.col("license_text")), 256).alias("digest"), "license_id")
        .where(F.col("digest") != F.sha2(F.lit(""), 256))
        .groupBy("digest")
        .agg(F.min("license_id").alias("license_id"))
    )
    return rows.join(digests, "digest", "left").select(id_col, "canonical_bytes", "digest", "license_id")


def oracle() -> str:
    """DuckDB SQL for ``scanned`` on documents with the known licences."""

    def form(text: str) -> str:
        out = f"lower({text})"
        for pattern, new in STEPS:
            duck = pattern.replace(r"\u0080-\U0010ffff", r"\x{80}-\x{10ffff}")
            out = f"regexp_replace({out}, '{duck}', {_quoted(new)}, 'g')"
        out = f"' ' || replace(trim({out}, ' '), ' ', '  ') || ' '"
        for old, new in EQUIVALENT:
            out = f"replace({out}, '{_spaced(old)}', '{_spaced(new)}')"
        return f"trim(replace({out}, '  ', ' '), ' ')"

    known = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in KNOWN.items())
    return f"""
with known(license_id, license_text) as (values {known}),
digests as (select sha256({form('license_text')}) digest, min(license_id) license_id from known group by 1),
rows as (select doc_id, {form('text')} c from documents)
select doc_id, cast(strlen(c) as bigint) canonical_bytes, sha256(c) digest, license_id from rows left join digests on sha256(c) = digest"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "'||chr(10)||'") + "'"
