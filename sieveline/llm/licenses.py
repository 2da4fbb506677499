"""Licence scans by a hash join of canonical digests, in DataFrame operations alone.

A text is normalised as licence matchers do: lines that state a copyright or reserve rights are
dropped, also inside comments; the rest is lower-cased, everything but letters and digits becomes
single spaces, whatever the line breaks and comment marks, and equivalent spellings are made
one. The SHA-256 digest of the whole result is hash-joined with the digests of known licences.
Each line is normalised likewise and its digest joined with those of known notices, so that a
licence named inside a longer document is found too; equal lines of a document count once.

The registry is a list in this module and the public texts beside it: a bounded table, of which
both joins broadcast the digests. A first pass writes each row's digest and those of its lines
that are as long as a known text, the only ones that can equal one; a very long text is one row of it.

A statement of copyright is a line that begins (but for comment marks) with a copyright sign or
the word, followed by a sign, a year or a place for a name, by a holder and a year, or by
nothing but a capitalised name. Lines of a licence's body that happen to begin with the word stay.

Defined results: a null text has no digest, no licence and no notices; a text that is empty after
normalising has the digest of the empty string, which no licence has; a document that matches
several notices lists each once, in order; rows with the same doc_id, or none, are kept apart; an
empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import common

# Equivalent spellings and their common form, in order, on words between single spaces.
SPELLINGS = [
    (" licence", " license"), (" licenc", " licens"), (" sub licens", " sublicens"), (" non commercial", " noncommercial"), (" per cent ", " percent "), (" copyright owner", " copyright holder"), (" organis", " organiz"),
    (" authoris", " authoriz"), (" recognis", " recogniz"), (" modernis", " moderniz"), (" initialis", " initializ"), (" utilis", " utiliz"), (" favour", " favor"), (" behaviour", " behavior"), (" colour", " color"), (" labour", " labor"),
    (" honour", " honor"), (" centre ", " center "), (" defence", " defense"), (" fulfil ", " fulfill "), (" wilful", " willful"), (" whilst ", " while "), (" programme ", " program "), (" judgement", " judgment"), (" acknowledgement", " acknowledgment"),
    (" analogue", " analog"), (" catalogue", " catalog"), (" https ", " "), (" http ", " "),
]

# Texts of public licences.
_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_BODY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB_BODY = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT_0 = _MIT_BODY.replace(", subject to the following conditions:", ".").replace("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n", "")
_0BSD = _ISC_BODY.replace(", provided that the above copyright notice and this permission notice appear in all copies.", ".")
_BSD_ADVERT = """3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the University of California, Berkeley and its contributors.
4. Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_REGENTS = _BSD_TAIL.replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE REGENTS AND CONTRIBUTORS").replace("THE COPYRIGHT HOLDER OR", "THE REGENTS OR")


def _stored() -> list[tuple[str, str]]:
    """The public texts beside this module, each also without what follows its terms."""
    found = []
    for path in sorted((Path(__file__).parent / "licences").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        found.append((path.stem, text))
        terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        found += [(path.stem, terms + end), (path.stem, terms)] if end else []
    return found


KNOWN = [
    ("MIT", "MIT License\n" + _MIT_BODY), ("MIT", "The MIT License (MIT)\n" + _MIT_BODY), ("MIT", _MIT_BODY),
    ("ISC", "ISC License\n" + _ISC_BODY), ("ISC", _ISC_BODY),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_TAIL), ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL), ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("Zlib", "zlib License\n" + _ZLIB_BODY), ("Zlib", _ZLIB_BODY), ("Unlicense", _UNLICENSE),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Released under CC0 1.0."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n" + _BOOST), ("BSL-1.0", _BOOST), ("MIT-0", "MIT No Attribution\n" + _MIT_0), ("MIT-0", _MIT_0), ("0BSD", "BSD Zero Clause License\n" + _0BSD), ("0BSD", _0BSD),
    ("BSD-4-Clause-UC", _BSD_HEAD + _BSD_ADVERT + _BSD_REGENTS), ("BSD-3-Clause", "The 3-Clause BSD License\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL), ("BSD-2-Clause", "The 2-Clause BSD License\n" + _BSD_HEAD + _BSD_TAIL),
    *_stored(),
]
KNOWN += [(i, f"SPDX-License-Identifier: {i}") for i in sorted({i for i, _ in KNOWN})]

#: Lower-cased lines that state a copyright or that rights are reserved, and what such a line must hold.
STATEMENT = (
    r"^[^\p{L}\p{N}(©]*(copyright[^\p{L}]*([(]c[)]|©|(19|20)[0-9][0-9])|copyright[ \t:]*[<\[{]|copyright( by)?( [^ 0-9]+){0,5},? [(]?(19|20)[0-9][0-9]([-–, ]+[0-9]+)*[).,; \r]*$|[(]c[)][ \t]*(copyright|(19|20)[0-9][0-9])|©)"
    r"|^[^\p{L}\p{N}]*all rights reserved[^\p{L}\p{N}]*$"
)
HINTS = ("copyright", "(c)", "©", "all rights reserved")
#: A line of nothing but the word and a capitalised name, and words that are no name.
NAMED, NO_NAME = r"^[^\p{L}\p{N}(©]*Copyright:?( by)?( \p{Lu}[\p{L}.'’-]*,?)( [&\p{Lu}][\p{L}.'’-]*,?){0,5}[ \t\r]*$", "Holder|Owner|Notice|Licen[cs]e|Law|Act|Statement|Disclaimer|Patent"
OTHER = r"[^\p{L}\p{N}\n]+"


def _worded(text: Column) -> Column:
    """Lower-cased words between single spaces, lines kept apart by line breaks, without statements of copyright."""
    low = F.lower(text)
    stated = lambda x: F.lower(x).rlike(STATEMENT) | (x.rlike(NAMED) & ~x.rlike(NO_NAME))
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~stated(x)), "\n")
    hinted = F.lit(False)
    for hint in HINTS:
        hinted = hinted | F.contains(low, F.lit(hint))
    words = F.regexp_replace(F.lower(F.when(hinted, kept).otherwise(text)), OTHER, " ")
    return F.concat(F.lit(" "), F.replace(words, F.lit("\n"), F.lit(" \n ")), F.lit(" "))


def _spelled(words: Column) -> Column:
    for pattern, to in SPELLINGS:
        words = F.replace(words, F.lit(pattern), F.lit(to))
    return words


def _whole(words: Column) -> Column:
    return F.trim(_spelled(F.regexp_replace(words, r"\s+", " ")))


def _lines(words: Column) -> Column:
    return F.array_distinct(F.transform(F.split(_spelled(words), "\n"), lambda x: F.trim(x)))


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    return _whole(_worded(text))


def canonical_sql(text: str) -> tuple[str, str]:
    """DuckDB's SQL for the canonical form of a text and for the list of its lines' forms."""
    stated = f"(regexp_matches(lower(x), '{STATEMENT}') or (regexp_matches(x, '{NAMED.replace(chr(39), chr(39) * 2)}') and not regexp_matches(x, '{NO_NAME}')))"
    kept = f"array_to_string(list_filter(string_split({text}, chr(10)), lambda x: not {stated}), chr(10))"
    words = f"(' ' || replace(regexp_replace(lower({kept}), '{OTHER}', ' ', 'g'), chr(10), ' ' || chr(10) || ' ') || ' ')"

    def spelled(out: str) -> str:
        for pattern, to in SPELLINGS:
            out = f"replace({out}, '{pattern}', '{to}')"
        return out

    single = f"regexp_replace({words}, '[ \n]+', ' ', 'g')"
    return f"trim({spelled(single)})", f"list_distinct(list_transform(string_split({spelled(words)}, chr(10)), lambda x: trim(x)))"


def registry(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """digest, license_id and length of the canonical forms of the known licences, each once; no more rows than ``known``."""
    rows = spark.createDataFrame(known, "license_id string, text string").select("license_id", canonical(F.col("text")).alias("form"))
    return rows.groupBy(F.sha2("form", 256).alias("digest"), F.length("form").alias("length")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """doc_id, digest, license_id (of the whole text) and notices (of its lines, joined by ``;``) of each document."""
    spark = docs.sparkSession
    found = registry(spark, known).collect()  # at most ``known``
    table = F.broadcast(spark.createDataFrame([(r["digest"], r["license_id"]) for r in found], "digest string, license_id string"))
    lengths = sorted({r["length"] for r in found})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", _worded(F.col("text")).alias("words"))
    candidates = F.transform(F.filter(_lines(F.col("words")), lambda x: F.length(x).isin(lengths)), lambda x: F.sha2(x, 256))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2(_whole(F.col("words")), 256).alias("digest"), candidates.alias("lines"))
    rows = common.table(rows, "digests")
    notices = rows.select("row", F.explode("lines").alias("digest")).join(table, "digest").groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ";").alias("notices"))
    out = rows.select("row", "doc_id", "digest").join(table, "digest", "left").join(notices, "row", "left")
    return out.select("doc_id", "digest", "license_id", F.when(F.col("digest").isNotNull(), F.coalesce("notices", F.lit(""))).alias("notices"))


def _oracle() -> str:
    known = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
    whole, lines = canonical_sql("text")
    return f"""
with known as (select sha256({whole}) digest, min(license_id) license_id from (values {known}) as k(license_id, text) group by 1),
texts as (select row_number() over () as row_key, doc_id, text, sha256({whole}) digest, {lines} lines from documents),
found as (select distinct row_key, sha256(line) line_digest from (select row_key, unnest(lines) line from texts)),
notices as (select row_key, string_agg(distinct license_id, ';' order by license_id) notices from found join known on line_digest = digest group by 1)
select doc_id, texts.digest, license_id, case when text is null then null else coalesce(notices, '') end notices
from texts left join known on texts.digest = known.digest left join notices using (row_key)
"""


ORACLE = _oracle()
