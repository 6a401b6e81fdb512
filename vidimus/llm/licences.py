"""Licence scan by canonical digests: whole texts, and whole lines, looked up among known licences.

Two spellings of one licence meet after normalising: case, punctuation and white space, copyright
lines, and words that stand for each other. What is left is hashed and joined by the digest; there is
no partial or fuzzy match.
"""
from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of licences by SPDX identifier.
NAMES = {
    "0BSD": ["BSD Zero Clause License"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "Modified BSD License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "EPL-2.0": ["Eclipse Public License 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2"],
    "GPL-3.0": ["GNU General Public License, version 3"],
    "ISC": ["ISC License"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0"],
    "Zlib": ["zlib License"],
}
#: The notices in which these names stand.
NOTICES = [
    "{}", "the {}", "Licensed under {}.", "Licensed under the {}.", "Released under {}.", "Released under the {}.", "Distributed under the {}.",
    "This work is licensed under {}.", "This work is licensed under the {}.", "This work is licensed under a {}.",
]
_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted"""
_NO_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.

"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Long licences are files beside this module, and how many lines that are not blank their title may have.
FILES = {"Apache-2.0": [3], "CC-BY-SA-4.0": [2], "CC0-1.0": [1, 2], "EPL-2.0": [1], "GPL-2.0": [2], "GPL-3.0": [2], "LGPL-3.0": [2], "MPL-2.0": [2]}
#: Full texts, the short ones without a title.
TEXTS = {k: resources.files(__package__).joinpath("licence_texts", f"{k}.txt").read_text("utf-8") for k in FILES} | {
    "0BSD": f"{_GRANT}.\n\n{_NO_WARRANTY}",
    "BSD-2-Clause": f"{_BSD}{_BSD_END}",
    "BSD-3-Clause": f"{_BSD}{_BSD_THIRD}{_BSD_END}",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "ISC": f"{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_NO_WARRANTY}",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}
#: Spellings that stand for each other, as they are once punctuation is gone.
EQUIVALENT = [
    ("licen[cs]e", "license"), ("licen[cs]ed", "licensed"), ("licen[cs]es", "licenses"), ("sub licen[cs]e", "sublicense"), ("sublicen[cs]e", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("analog", "analogue"), ("artifact", "artefact"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("calibre", "caliber"), ("catalog", "catalogue"), ("center", "centre"), ("favor", "favour"), ("favorite", "favourite"), ("fulfil", "fulfill"),
    ("merchantability", "merchantability"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("organisation", "organization"),
    ("per cent", "percent"), ("recognise", "recognize"), ("share alike", "sharealike"), ("copyright owner", "copyright holder"), ("v ([0-9])", "version $1"), ("v([0-9])", "version $1"),
]
#: What stands behind "copyright" within a licence, where a line may be broken before or behind it: no holder's name.
INSIDE = sorted({rf"{a}(?:[^a-z\n]+{b}\b|[^a-z\n]*$)" for t in TEXTS.values() for a, b in re.findall(r"copyright[\s:,]+([a-z]+)[^a-z]+([a-z]+)", t.lower())})
#: A line that begins as a copyright line and names a year or the sign.
COPYRIGHT = r"^[ \t*#/;-]*(?:copyright|\(c\)|\x{A9})[^\n]*(?:[0-9]{4}|\(c\)|\x{A9})[^\n]*$"
#: A line that names a holder without a year, and one that reserves all rights.
HOLDER = (
    rf"^[ \t*#/;-]*(?:(?:copyright[ \t:,]+(?!{'|'.join(INSIDE)})|\x{{A9}}[ \t]*)[a-z<\[{{\x{{80}}-\x{{10FFFF}}][^\n]*|all rights reserved[ \t.!]*)$"
)
PUNCTUATION = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
#: White space and punctuation outside ASCII, and the spaces that PUNCTUATION has left beside them.
WIDE_PUNCTUATION = r"[ \x{A0}\x{A9}\x{AB}\x{BB}\x{2013}\x{2014}\x{2018}\x{2019}\x{201C}\x{201D}]+"


def _plain_line(line: Column) -> Column:
    """One line without case, punctuation, and all of it if it is a copyright line."""
    low = F.lower(line)
    said = low.contains("copyright") | low.contains("(c)") | low.contains("\u00a9") | low.contains("rights reserved")
    bare = F.when(said, F.regexp_replace(F.regexp_replace(low, COPYRIGHT, ""), HOLDER, "")).otherwise(low)
    flat = F.regexp_replace(bare, PUNCTUATION, " ")
    return F.trim(F.when(F.octet_length(line) > F.length(line), F.regexp_replace(flat, WIDE_PUNCTUATION, " ")).otherwise(flat))


def _spelled(text: Column) -> Column:
    """One of each equivalent spellings; matters only where a licence may be named."""
    def replaced(t: Column) -> Column:
        one = t
        for words, to in EQUIVALENT:
            one = F.regexp_replace(one, rf"\b{words}\b", to)
        return F.when(functools.reduce(lambda a, b: a | b, [t.contains(h) for h in HINTS]), one).otherwise(t)

    # over a one-element array, for two dozen expressions make a generated method too long to be compiled
    return F.get(F.transform(F.array(text), replaced), F.lit(0))


def digests(texts: DataFrame) -> DataFrame:
    """The rows of texts without `text`, and for each whole text (line -1) and each of its lines
    (line from 0) a row with its digest.

    Every text is normalised once, line by line; the whole text is its lines put together again.
    """
    keys = [c for c in texts.columns if c != "text"]
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), _plain_line)
    cut = texts.select(*keys, lines.alias("lines"))
    whole = F.struct(F.lit(-1).alias("line"), F.array_join(F.filter("lines", lambda x: x != ""), " ").alias("t"))
    each = F.transform("lines", lambda x, i: F.struct(i.alias("line"), x.alias("t")))
    rows = cut.select(*keys, F.explode(F.concat(F.array(whole), each)).alias("x")).select(*keys, "x.line", "x.t")
    return rows.select(*keys, "line", F.sha2(F.encode(_spelled(F.col("t")), "UTF-8"), 256).alias("digest"))


#: Every canonical notice has one of these; no other text can be a known licence.
HINTS = ["licen", "cc by", "cc0", "copyright", "permission"]


def known_texts() -> Iterator[tuple[str, str]]:
    """(licence, text) of every form that is known as a whole: with and without its title, its numbers
    of clauses (BSD), and what is said behind the end of its terms."""
    for k, text in TEXTS.items():
        lines = [x for x in text.split("\n") if x.strip()]
        plain = [text] + (["\n".join(re.sub(r"^\d\. ", "", x) for x in lines)] if k.startswith("BSD") else [])
        titles = [t for name in NAMES[k] for t in (name, f"The {name}", f"{name} ({k})", f"The {name} ({k})")] if k not in FILES else []
        for form in [*plain, *("\n".join(lines[n:]) for n in FILES.get(k, [])), *(f"{t}\n{p}" for t in titles for p in plain)]:
            yield k, form
            terms, end, _ = form.partition("END OF TERMS AND CONDITIONS")
            if end:
                yield k, terms
                yield k, terms + end


def known_licences(spark: SparkSession) -> DataFrame:
    """(licence, digest) of the built-in texts; one row a digest. Callers may join any such table."""
    rows = [(k, n.format(name)) for k, names in NAMES.items() for name in names for n in NOTICES] + list(known_texts())
    made = digests(spark.createDataFrame(rows, "licence string, text string")).filter("line = -1").groupBy("digest").agg(F.min("licence").alias("licence"))
    # some hundred rows of two short strings, written into the plan, so that joins know their size
    values = ", ".join("('{}', '{}')".format(r["digest"], r["licence"]) for r in made.collect())
    return spark.sql(f"SELECT * FROM VALUES {values} AS known(digest, licence)")


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, licence, line_licences, n_licence_lines) for every row of docs.

    licence: the known licence that the whole text is, or null. line_licences: those that a whole line
    is, sorted, joined by commas, empty where none; n_licence_lines counts such lines. Null and empty
    texts match nothing. Each row has what its own text says, whatever its doc_id: rows that repeat an
    id or have none are told apart by a 128-bit hash of their texts. Other columns are not read; an empty
    table gives no rows.
    """
    text = F.col("text").cast("string")
    keys = [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]
    hits = digests(docs.select(*keys, text.alias("text"))).join(known, "digest")
    is_line = F.col("line") >= 0
    found = hits.groupBy("h1", "h2").agg(
        F.min(F.when(~is_line, F.col("licence"))).alias("licence"), F.concat_ws(",", F.array_sort(F.collect_set(F.when(is_line, F.col("licence"))))).alias("line_licences"),
        F.count_distinct(F.when(is_line, F.col("line"))).alias("n_licence_lines"),  # equal texts bring each line more than once
    )
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keys)
    return ids.join(found, ["h1", "h2"], "left").select(
        "doc_id", "licence", F.coalesce("line_licences", F.lit("")).alias("line_licences"), F.coalesce("n_licence_lines", F.lit(0)).cast("long").alias("n_licence_lines")
    )
