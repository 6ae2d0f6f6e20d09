"""Licence scans by canonical digest lookup, in SQL functions only.

A text is brought to a canonical form (case, copyright lines, punctuation, equivalent
spellings and white space are levelled), and its SHA-256 is hash-joined with the digests
of known licence texts, as it is and, for license_id alone, without further lines that begin
like a copyright line; every single line in canonical form is looked up among known
licence notices. The known side is a fixed list, far below any broadcast limit, so the
scan is one pass without a shuffle.

Defined results: null, empty or white-space texts match nothing and have a null digest,
as has a text of nothing but copyright lines; every row is looked up by itself, so repeated
rows and null ids change nothing; a hot licence is no hot key, as the known side is sent.
"""

from __future__ import annotations

import re
from functools import cache
from importlib.resources import files

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Licence texts and notices as published, with their SPDX identifiers.
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
""" + _AS_IS
_MIT_0 = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.
""" + _AS_IS
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL3_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
KNOWN_TEXTS = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("MIT-0", _MIT_0),
    ("MIT-0", "MIT No Attribution\n" + _MIT_0),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_WARRANTY),
    ("ISC", "ISC License\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_WARRANTY),
    ("0BSD", _ISC_GRANT + ".\n" + _ISC_WARRANTY),
    ("0BSD", "BSD Zero Clause License\n" + _ISC_GRANT + ".\n" + _ISC_WARRANTY),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("Apache-2.0", _APACHE_HEADER),
    ("GPL-3.0-or-later", _GPL3_HEADER),
]
#: What ends the terms of a long text; an appendix on how to apply them may follow.
TERMS_END = "END OF TERMS AND CONDITIONS"


@cache
def full_texts() -> list[tuple[str, str]]:
    """The long licence texts beside this file (an edition of one has its number after a plus
    sign), each whole, without its appendix, without its first line, and without a
    copyright line that is to be filled in."""
    out = []
    for file in sorted(files(__package__).joinpath("license_texts").iterdir(), key=lambda f: f.name):
        name = file.name.removesuffix(".txt").partition("+")[0]
        text = file.read_text("utf-8").strip()
        terms, end, _ = text.partition(TERMS_END)
        forms = [text] + ([terms, terms + end] if end else [])
        forms += [x.partition("\n")[2] for x in forms]
        forms += [re.sub(r"(?m)^ *Copyright \[yyyy\].*$", "", x) for x in forms]
        out += [(name, x) for x in dict.fromkeys(forms)]
    return out


KNOWN_NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("ISC", "SPDX-License-Identifier: ISC"),
]
# Spellings that count as equal: British forms and hyphenations of the matching guidelines.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("favour", "favor"),
    ("fulfil ", "fulfill "),
    ("initialise", "initialize"),
    ("labour", "labor"),
    ("licence", "license"),
    ("modelled", "modeled"),
    ("offence", "offense"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("recognise", "recognize"),
    ("sub license", "sublicense"),
    ("unauthorised", "unauthorized"),
    ("wilful", "willful"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("copyright owner", "copyright holder"),
    ("https", "http"),
]
PUNCTUATION = "[^a-z0-9\\n\\x{80}-\\x{10FFFF}]+"
#: A year or a sign must follow: wrapped licence texts have lines that begin with the word.
COPYRIGHT_LINE = "^(copyright (c|©|by|[0-9]{4})( |$)|c copyright|©|c [0-9]{4}|all rights reserved$)"


#: Any line that begins like a copyright line, and how many of its words tell it from wrapped licence text.
LIKE_COPYRIGHT, PHRASE_WORDS = "^((some )?portions (of this software )?(are )?)?(c )?copyright( |$)", 4


def canonical_lines(text):
    """A text's lines in canonical form, without copyright lines and empty ones."""
    plain = F.regexp_replace(F.lower(text), PUNCTUATION, " ")
    for other, usual in SPELLINGS:
        plain = F.replace(plain, F.lit(other), F.lit(usual))
    return F.filter(F.transform(F.split(plain, "\n"), lambda x: F.btrim(x)), lambda x: (x != "") & ~x.rlike(COPYRIGHT_LINE))


def whole_digest(lines):
    return F.when(F.size(lines) > 0, F.sha2(F.array_join(lines, " "), 256))


def copyright_phrases(spark: SparkSession, entries: list[tuple[str, str]]) -> list[str]:
    """What the known texts say from the word copyright on, in up to PHRASE_WORDS words."""
    made = spark.createDataFrame(entries, "license_id string, text string").select(F.array_join(canonical_lines(F.col("text")), " ").alias("text"))
    found = set()
    for row in made.distinct().collect():  # the fixed list
        words = row.text.split(" ")
        for i, word in enumerate(words):
            if word == "copyright":
                found |= {" ".join(words[i : i + n]) for n in range(1, PHRASE_WORDS + 1)}
    return sorted(found)


def bare_lines(lines, phrases: list[str]):
    """Canonical lines without those that begin like a copyright line, with a name or anything
    else, and not like known licence text that was wrapped there."""
    return F.filter(lines, lambda x: ~x.rlike(LIKE_COPYRIGHT) | F.substring_index(x, " ", PHRASE_WORDS).isin(phrases))


def known(spark: SparkSession, entries: list[tuple[str, str]]) -> DataFrame:
    """(license_id, digest) of the known entries; one row for each digest."""
    lines = canonical_lines(F.col("text"))
    made = spark.createDataFrame(entries, "license_id string, text string").select("license_id", whole_digest(lines).alias("digest"))
    return made.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def notice_ids(spark: SparkSession, entries: list[tuple[str, str]]):
    """A map column from a notice in canonical form to its id."""
    made = spark.createDataFrame(entries, "license_id string, text string").select("license_id", F.explode(canonical_lines(F.col("text"))).alias("line"))
    rows = made.groupBy("line").agg(F.min("license_id").alias("license_id")).orderBy("line").collect()  # the fixed list
    return F.create_map(*[F.lit(x) for r in rows for x in (r.line, r.license_id)]) if rows else F.lit(None).cast("map<string,string>")


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", texts: list[tuple[str, str]] | None = None, notices: list[tuple[str, str]] = KNOWN_NOTICES) -> DataFrame:
    """One row per input row: doc_id, digest, license_id (of the entire text, else null),
    n_notices (lines that are a known notice) and notice_ids (their ids, in order, once each).

    Without ``texts`` the known ones are KNOWN_TEXTS and full_texts()."""
    spark = docs.sparkSession
    texts = [*KNOWN_TEXTS, *full_texts()] if texts is None else texts
    slim = docs.select(F.col(id_col).alias("doc_id"), canonical_lines(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("lines"))
    bare = slim.select("doc_id", "lines", bare_lines(F.col("lines"), copyright_phrases(spark, texts)).alias("bare"))
    # A second digest only where a line more is a copyright line; no known text loses one.
    other = F.when(F.size("bare") < F.size("lines"), whole_digest(F.col("bare")))
    ids = notice_ids(spark, notices)
    hits = F.filter(F.transform("lines", lambda x: F.try_element_at(ids, x)), lambda x: x.isNotNull())
    found = bare.select("doc_id", whole_digest(F.col("lines")).alias("digest"), other.alias("bare_digest"), hits.alias("hits"))
    of_text = known(spark, texts)
    of_bare = of_text.select(F.col("digest").alias("bare_digest"), F.col("license_id").alias("bare_id"))
    out = found.join(F.broadcast(of_text), "digest", "left").join(F.broadcast(of_bare), "bare_digest", "left")
    return out.select("doc_id", "digest", F.coalesce("license_id", "bare_id").alias("license_id"), F.size("hits").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("hits")), ",").alias("notice_ids"))
