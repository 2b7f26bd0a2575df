"""Licence scans: canonical digests of entire texts, joined to those of known licences. DataFrame functions only.

A canonical form has no copyright lines, no list marks and no punctuation, and one spelling for each word. The
text is taken apart into words once, and a word is looked up in a set of constant size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The wording of well-known short licences, as published.
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
KNOWN = {
    "MIT": "MIT License\n\nCopyright (c) <year> <copyright holders>\n\n" + _MIT_GRANT,
    "ISC": "ISC License\n\nCopyright (c) <year> <owner>\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_DISCLAIMER,
    "0BSD": "BSD Zero Clause License\n\nCopyright (c) <year> <owner>\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_DISCLAIMER,
    "BSD-2-Clause": "BSD 2-Clause License\n\nCopyright (c) <year>, <owner>\n\n" + _BSD_HEAD + _BSD_DISCLAIMER,
    "BSD-3-Clause": "BSD 3-Clause License\n\nCopyright (c) <year>, <owner>\n\n" + _BSD_HEAD + _BSD_NAMES + _BSD_DISCLAIMER,
    "Zlib": """zlib License

Copyright (c) <year> <copyright holders>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
}

#: Spellings that count as equal (after lower-casing): spelling -> the one that stands for both; a plural s may follow one word. Fixed values.
EQUIVALENT = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "capitalisations": "capitalizations",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "copyright owner": "copyright holder",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "https": "http",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "licencing": "licensing",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "noncommercial": "non commercial",
    "noninfringement": "non infringement",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "per cent": "percent",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sub license": "sublicense",
    "sublicence": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}
#: Lines that begin with a copyright mark and name someone or a year, or that reserve all rights, are not part of the licence;
#: characters of comments may stand before them.
NO_PART = r"(^|\n)[ \t/*#;-]*(all rights reserved|(copyright|\(c\)|\x{a9})[ \t:,]*(\(c\)|\x{a9}|[0-9<\[]|by |[^\n]*(19|20)[0-9][0-9]))[^\n]*"
#: The number or letter of a list's entry.
LIST_MARK = r"(^|\n)[ \t/*#;-]*\(?([0-9]{1,2}|[a-z]|[ivx]{1,4})[.)][ \t]+"
NO_WORD = r"[^\p{L}\p{N}]+"
#: Digests of the canonical forms of long licences, whole and, where they have one, up to the end of their terms. Fixed values.
KNOWN_DIGESTS: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("72083b058d325a216c948b17cd4a94aebe681e1c5b51a7106e6d5cb106b15480", "4b7bf538613ad74324b8d88607299656873ed7b49b6f3b5b38c9e913571e248c",),
    "Artistic-1.0-Perl": ("b06eda62b7e0c69e6f8a5960610095b69349654af941a79eca834edcd5e64e49",),
    "CC0-1.0": ("fc3b7547cd22a69f533f8dc61ce0b9bba032990bd8d72935ddd5cf7045643f54",),
    "GFDL-1.2": ("11b443626816c538e555b7fb60eaba9f2a83a9ecb67ad4a1663e07c118b8e550",),
    "GFDL-1.3": ("cc84a6c6a2b84e8cde0619ed37d987e1a9b39e53ddcaf34f4735e2138dfe6e4a",),
    "GPL-1.0": ("d12bf436716562844f9a1fa4b2d7f3d40b9a3958451bc802147a9b1f72b26449", "d7aceb17a2c2dd23444118f2a4f564bc44b82289e8c3d716e2a0aa51477e2a60",),
    "GPL-2.0": ("5fbaf82c679588b288227e6fa2348731ce4db7888a791bdf8a007da45db6d110", "53c45912d872de7563a67955bca147dbe241ad9f7d6b9c6cc1b0428b44382526",),
    "GPL-3.0": ("3695e90f7fe4b461853cec533de5675ab2b6b1fcafcb504d6c64ded76f675d64", "a7d16b580457c566303df373fd362c5bfbfbc013734bed4e4cf732a569a5598e",),
    "LGPL-2.0": ("4a1b1cb15d45262f049457ae26945909d0e5af93e2e3fb5de82c9f72ac6bebe2", "9445838f80c534db1f71155f4c93f1464bf680d2a091792f3f2146f5cefef806",),
    "LGPL-2.1": ("f2755dc4b609b314faab32d30ca6d0466b60adc931cece2ea4f0b61f483bfc98", "70a277553f5f0e974016dfc6aed9adda07c554792c5f1f3d75acb63053de3f89",),
    "LGPL-3.0": ("cb8c0f424bdd5c42a0b18285893829d988e9fb9a00d0cd604a59ebe8da7eeb45",),
    "MPL-1.1": ("a1ea0c4b634aa7b4256d56525c941092a1facf7d3e96c4ecb68ba71bc6744f7d",),
    "MPL-2.0": ("8dce888cb942d93cebeb8e0fea8afac43e084f54254ac4d9b99cfde68a62468b",),
}


def _one_word() -> dict[str, str]:
    pairs = {k: v for k, v in EQUIVALENT.items() if " " not in k}
    return pairs | {f"{k}s": f"{v}s" for k, v in pairs.items()}


def _two_words() -> dict[str, str]:
    """In a text whose words are two spaces apart and have one at both ends."""
    pairs = {k: v for k, v in EQUIVALENT.items() if " " in k}
    return {f" {k.replace(' ', '  ')}{s} ": f" {v.replace(' ', '  ')}{s} " for k, v in pairs.items() for s in ("", "s")}


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, words of letters and digits one space apart, one spelling for each word."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), NO_PART, "\n"), LIST_MARK, "\n")
    out = F.concat(F.lit(" "), F.btrim(F.regexp_replace(out, NO_WORD, "  ")), F.lit(" "))
    for spelling, other in _two_words().items():
        out = F.replace(out, F.lit(spelling), F.lit(other))
    spellings = _one_word()
    table = F.create_map(*[F.lit(x) for kv in spellings.items() for x in kv])
    word = lambda w: F.when(w.isin(*spellings), F.element_at(table, w)).otherwise(w)
    return F.array_join(F.transform(F.split(F.btrim(out), "  "), word), " ")


def known_digests(spark: SparkSession, known: dict[str, str] | None = None) -> DataFrame:
    """digest, license_id of each known text, with and without its first line where that is a title; the fixed digests where none are given."""
    rows = []
    for name, text in (KNOWN if known is None else known).items():
        head, _, rest = text.partition("\n")
        rows.append((name, text))
        if rest.strip() and len(head) < 80:
            rows.append((name, rest))
    table = spark.createDataFrame(rows, "license_id string, text string")
    digests = table.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license_id")
    if known is None:
        fixed = [(digest, name) for name, own in KNOWN_DIGESTS.items() for digest in own]
        digests = digests.unionByName(spark.createDataFrame(fixed, "digest string, license_id string"))
    return digests.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def license_scan(docs: DataFrame, known: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, canonical_chars (long), digest (hex SHA-256 of the canonical text), license_id (null if unknown).

    The whole text is one licence or none. A null text is an empty one; a text without a letter or digit
    outside copyright lines has an empty canonical form and no licence. Known texts are a fixed list, so
    they are joined by broadcast. Ids (null too) and repeated rows are passed through; other columns are not
    read, whatever their names.
    """
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), canonical(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("text"))
    digests = base.select("doc_id", F.char_length("text").cast("long").alias("canonical_chars"), F.sha2("text", 256).alias("digest"))
    return digests.join(F.broadcast(known_digests(docs.sparkSession, known)), "digest", "left").select("doc_id", "canonical_chars", "digest", "license_id")


def variants(docs: DataFrame) -> DataFrame:
    """doc_id, text: every row's text in place of a licence's where its id leaves none, else a known licence in one of six dresses."""
    names = list(KNOWN)
    table = docs.sparkSession.createDataFrame([(i, KNOWN[n]) for i, n in enumerate(names)], "place int, licence string")
    rows = docs.select("doc_id", "text", (F.col("doc_id") % (len(names) + 1)).cast("int").alias("place"), (F.floor(F.col("doc_id") / (len(names) + 1)) % 6).cast("int").alias("dress"))
    text = F.col("licence")
    dressed = (
        F.when(F.col("dress") == 0, text)
        .when(F.col("dress") == 1, F.upper(text))
        .when(F.col("dress") == 2, F.concat(F.lit("Copyright Jane Doe 2015\nAll rights reserved.\n\n"), text))
        .when(F.col("dress") == 3, F.replace(F.replace(text, F.lit("\n1. "), F.lit("\n* ")), F.lit("\n2. "), F.lit("\n* ")))
        .when(F.col("dress") == 4, F.replace(F.replace(text, F.lit("license"), F.lit("licence")), F.lit("\n"), F.lit("\n# ")))
        .otherwise(F.concat(text, F.lit(" and more")))
    )
    return rows.join(F.broadcast(table), "place", "left").select("doc_id", F.when(F.col("licence").isNull(), F.col("text")).otherwise(dressed).alias("text"))


_VARIANTS_SQL = """
select d.doc_id, case when k.licence is null then d.text else case d.doc_id // {n} % 6 when 0 then licence when 1 then upper(licence)
  when 2 then 'Copyright Jane Doe 2015' || chr(10) || 'All rights reserved.' || chr(10) || chr(10) || licence
  when 3 then replace(replace(licence, chr(10) || '1. ', chr(10) || '* '), chr(10) || '2. ', chr(10) || '* ')
  when 4 then replace(replace(licence, 'license', 'licence'), chr(10), chr(10) || '# ') else licence || ' and more' end end as text
from documents d left join (values {values}) as k(place, licence) on k.place = d.doc_id % {n}"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def variants_sql() -> str:
    return _VARIANTS_SQL.format(n=len(KNOWN) + 1, values=", ".join(f"({i}, {_quoted(t)})" for i, t in enumerate(KNOWN.values())))


def oracle(table: str = "documents") -> str:
    """The same scan as DuckDB SQL."""

    def form(column: str) -> str:
        out = f"regexp_replace(regexp_replace(lower({column}), {_quoted(NO_PART)}, chr(10), 'g'), {_quoted(LIST_MARK)}, chr(10), 'g')"
        out = f"' ' || trim(regexp_replace({out}, {_quoted(NO_WORD)}, '  ', 'g'), ' ') || ' '"
        for spelling, other in _two_words().items():
            out = f"replace({out}, {_quoted(spelling)}, {_quoted(other)})"
        pairs = _one_word()
        table = f"map([{', '.join(map(_quoted, pairs))}], [{', '.join(map(_quoted, pairs.values()))}])"
        return f"array_to_string(list_transform(string_split(trim({out}, ' '), '  '), lambda w: coalesce({table}[w], w)), ' ')"

    values = []
    for name, text in KNOWN.items():
        head, _, rest = text.partition("\n")
        values.append(f"({_quoted(name)}, {_quoted(text)})")
        if rest.strip() and len(head) < 80:
            values.append(f"({_quoted(name)}, {_quoted(rest)})")
    fixed = ", ".join(f"({_quoted(digest)}, {_quoted(name)})" for name, own in KNOWN_DIGESTS.items() for digest in own)
    return f"""
with known as (
  select digest, min(name) as license_id
  from (select sha256({form("body")}) as digest, name from (values {", ".join(values)}) as k(name, body) union all select * from (values {fixed}) as f(digest, name)) u group by 1),
forms as (select doc_id, {form("coalesce(text, '')")} as form from {table} t)
select f.doc_id, cast(length(f.form) as bigint) as canonical_chars, sha256(f.form) as digest, k.license_id
from forms f left join known k on k.digest = sha256(f.form)"""
