"""Licence scan: normalised text against licence templates by Dice coefficient over word bigrams, in DataFrame expressions only.

Units of a text are its lines, its paragraphs of two lines or more (parted by blank lines) and, if it has several paragraphs, the whole of it. The full texts are
also looked for in every run of 2 to RUN consecutive lines, so a licence of several paragraphs, or one hard against other lines, is found inside a longer text; of all
runs each template's best match counts once. A notice inside a longer line is not found.
Normal form: lower case, every run of other characters than letters and digits as one blank. Bigrams are counted with their repeats:
Dice = 2 * common / (bigrams of the unit + bigrams of the template). A unit matches a template at 0.8 or more.

Two prunings lose nothing. Size: such a match needs a unit of t/(2-t) to (2-t)/t times the template's bigrams, so units look at templates
of like size only, and a unit longer than all bounds is dropped by counting its blanks. Words: it also shares t/(2-t) of the template's
bigrams at least, so a unit without any of a set of words that touches all but fewer of them cannot match (``required`` checks this for
every template); texts in which none of these words occurs are passed over before they are cut up.

Null and empty texts, and units of fewer than two words, have no match. Each row is worked on alone: repeated rows, null ids and empty tables
need no rule, extra columns of any name are ignored, and nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.shared import own_columns

LEAST = 0.8
#: Lines of the longest run that is compared with the full texts; wrapped at 70 characters the longest of them has 28.
RUN = 40

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER
OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You
may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that
it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
General Public License for more details. You should have received a copy of the GNU General Public License along with this program."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one at http://mozilla.org/MPL/2.0/."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not
claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be
appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software. 3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""

#: Licence and notice texts, by identifier. Public texts, stated as they are.
TEXTS: list[tuple[str, str]] = [
    ("MIT", _MIT),
    ("BSD-2-Clause", f"{_BSD_2} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_2} {_BSD_3} {_BSD_END}"),
    ("ISC", _ISC),
    ("Apache-2.0", _APACHE),
    ("GPL-2.0", _GPL.format(2)),
    ("GPL-3.0", _GPL.format(3)),
    ("LGPL-3.0", _GPL.format(3).replace("GNU General", "GNU Lesser General")),
    ("AGPL-3.0", _GPL.format(3).replace("GNU General", "GNU Affero General")),
    ("MPL-2.0", _MPL),
    ("Zlib", _ZLIB),
    ("Unlicense", _UNLICENSE),
]
#: Names and versions as one-line notices state them.
_NAMED = {
    "MIT": ["the MIT License"],
    "Apache-2.0": ["the Apache License, Version 2.0", "Apache 2.0"],
    "GPL-2.0": ["the GNU General Public License, version 2"],
    "GPL-3.0": ["the GNU General Public License, version 3"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0"],
    "BSD-2-Clause": ["the BSD 2-Clause License"],
    "BSD-3-Clause": ["the BSD 3-Clause License"],
    "ISC": ["the ISC License"],
    "CC0-1.0": ["CC0 1.0"],
    **{f"CC-{k}-4.0": [f"CC {k} 4.0", f"the Creative Commons {long} 4.0 International License"] for k, long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))},
}


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def numbered(words: list[str]) -> list[str]:
    """Word bigrams, each with the number of its occurrence, so that set operations count repeats."""
    seen: Counter = Counter()
    out = []
    for a, b in zip(words, words[1:], strict=False):
        seen[a, b] += 1
        out.append(f"{a} {b} {seen[a, b]}")
    return out


@cache
def templates() -> list[tuple[int, str, list[str]]]:
    """(number, licence, words) of all templates: full texts, and one-line notices made from the names by rule."""
    lines = [(k, f"{start} {name}") for k, names in _NAMED.items() for name in names for start in ("Licensed under", "Released under", "This work is licensed under", "This project is licensed under the terms of")]
    lines += [(k, f"SPDX-License-Identifier: {k}") for k in dict.fromkeys([*(k for k, _ in TEXTS), *_NAMED])]
    return [(i, k, words_of(t)) for i, (k, t) in enumerate([*TEXTS, *lines])]


def bounds(bigrams: int, least: float = LEAST) -> tuple[int, int]:
    """The numbers of bigrams a unit can have to reach ``least`` against a template of so many."""
    return math.ceil(bigrams * least / (2 - least) - 1e-9), math.floor(bigrams * (2 - least) / least + 1e-9)


@cache
def required(least: float = LEAST, full: bool = False) -> list[str]:
    """Words of which every matching unit has one: for each template, the bigrams without any of them are too few for a match. ``full``: for the full texts alone."""
    chosen: list[str] = []
    for _, _, words in templates()[: len(TEXTS) if full else None]:
        need = bounds(len(words) - 1, least)[0]
        pairs = list(zip(words, words[1:], strict=False))
        common = ("by", "the", "of", "in", "to", "and", "or", "is", "a")
        said = {w for _, _, line in templates()[len(TEXTS) :] for w in line} if full else set()  # words of one-line notices tell no full text
        for word in sorted(set(words), key=lambda w: (w not in chosen, w in said, not full and not w.startswith("licen"), w in common, -len(w), w)):
            if sum(a not in chosen and b not in chosen for a, b in pairs) < need:
                break
            if word not in chosen:
                chosen.append(word)
        assert sum(a not in chosen and b not in chosen for a, b in pairs) < need
    return chosen


def _span(known: list[tuple[int, str, list[str]]], least: float) -> tuple[int, int]:
    """The least and the greatest number of bigrams at which a unit can match one of the templates."""
    return min(bounds(len(w) - 1, least)[0] for _, _, w in known), max(bounds(len(w) - 1, least)[1] for _, _, w in known)


def _let(value: Column, then) -> Column:
    return F.transform(F.array(value), then)[0]


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _units(text: Column) -> Column:
    lines = F.split(text, "\n")
    paragraphs = F.split(text, r"\n[ \t\r]*\n\s*")
    several = F.filter(paragraphs, lambda p: F.contains(F.trim(p), F.lit("\n")))
    return F.concat(lines, several, F.when(F.size(paragraphs) > 1, F.array(text)).otherwise(F.array().cast("array<string>")))


def _blanks(u: Column) -> Column:
    """As many as bigrams of a normal form."""
    return F.length(u) - F.length(F.replace(u, F.lit(" ")))


def _bigrams(w: Column) -> Column:
    """As ``numbered``."""
    pairs = F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return _let(F.array_sort(pairs), lambda s: F.transform(s, lambda x, k: F.concat_ws(" ", x, (k - F.array_position(s, x) + 2).cast("string"))))


def _compared(b: Column, known: list[tuple[int, str, list[str]]], least: float) -> Column:
    """(dice, template number) of the templates that numbered bigrams match."""
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(len(w) - 1).alias("n"), F.lit(bounds(len(w) - 1, least)[0]).alias("lo"), F.lit(bounds(len(w) - 1, least)[1]).alias("hi"), F.array(*[F.lit(b) for b in numbered(w)]).alias("b")) for i, _, w in known])
    near = F.filter(rows, lambda t: F.size(b).between(t["lo"], t["hi"]))
    scored = F.transform(near, lambda t: F.struct((F.lit(2.0) * F.size(F.array_intersect(b, t["b"])) / (F.size(b) + t["n"])).alias("dice"), t["i"].alias("i")))
    return F.filter(scored, lambda m: m["dice"] >= least)


def _words(names: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in names])


def _matches(text: Column, least: float) -> Column:
    """All (dice, template number) of a text's units."""
    known = templates()
    low, high = _span(known, least)
    normal = F.transform(_units(text), _normal)
    sized = F.filter(normal, lambda u: _blanks(u).between(low, high))
    worded = F.filter(F.transform(sized, lambda u: F.split(u, " ")), lambda w: F.arrays_overlap(w, _words(required(least))))
    return F.flatten(F.transform(F.transform(worded, _bigrams), lambda b: _compared(b, known, least)))


def _pairs(w: Column) -> Column:
    return F.zip_with(F.slice(w, 1, F.greatest(F.lit(0), F.size(w) - 1)), F.slice(w, 2, F.greatest(F.lit(0), F.size(w) - 1)), lambda a, b: F.concat_ws(" ", a, b))


def _run_matches(text: Column, least: float) -> Column:
    """The best (dice, template number) of each full text over all runs of lines.

    A run shares with a template at most the bigrams that its lines share with it, repeats in a line added, and those across line ends. These are counted once a line,
    so runs whose sum is too small for a match are passed over by arithmetic, and none is put together that has no required word nearby."""
    known = templates()[: len(TEXTS)]
    empty = F.array().cast("array<struct<dice:double,i:int>>")
    adding = lambda i: lambda total, x: total + F.get(x["common"], F.lit(i))

    def line(u: Column) -> Column:
        words = F.split(u, " ")
        shares = lambda b: F.array(*[F.size(F.array_intersect(b, F.array(*[F.lit(f"{x} {y}") for x, y in dict.fromkeys(zip(w, w[1:], strict=False))]))) + F.size(b) - F.size(F.array_distinct(b)) for _, _, w in known])
        return F.struct(u.alias("u"), F.when(u == "", 0).otherwise(_blanks(u) + 1).alias("n"), F.arrays_overlap(words, _words(required(least, True))).alias("has"), _let(_pairs(words), shares).alias("common"))

    def runs_at(lines: Column, i: Column) -> Column:
        """Of the runs that begin with line i, by their number of lines."""
        ahead = F.slice(lines, i, F.lit(RUN))

        def matches(k: Column) -> Column:
            run = F.slice(ahead, F.lit(1), k)
            size = F.reduce(run, F.lit(-1), lambda t, x: t + x["n"])
            joints = F.size(F.filter(run, lambda x: x["n"] > 0)) - 1
            may = F.lit(False)
            for i, _, w in known:
                low, high = bounds(len(w) - 1, least)
                most = F.reduce(run, joints, adding(i))
                may = may | (size.between(low, high) & (most * 2.0 >= least * (size + (len(w) - 1)) - 1e-6))
            joined = F.array_join(F.filter(F.transform(run, lambda x: x["u"]), lambda u: u != ""), " ")
            return F.when((F.get(ahead, k - 1)["n"] > 0) & may, _compared(_bigrams(F.split(joined, " ")), known, least)).otherwise(empty)

        found = F.flatten(F.transform(F.sequence(F.lit(2), F.size(ahead)), matches))
        return F.when((F.size(ahead) > 1) & (F.get(lines, i - 1)["n"] > 0) & F.exists(ahead, lambda x: x["has"]), found).otherwise(empty)

    found = _let(F.transform(F.transform(F.split(text, "\n"), _normal), line), lambda lines: F.flatten(F.transform(F.sequence(F.lit(1), F.size(lines)), lambda i: runs_at(lines, i))))
    best = lambda m: F.transform(F.array_distinct(F.transform(m, lambda x: x["i"])), lambda i: F.array_max(F.filter(m, lambda x: x["i"] == i)))
    return _let(found, best)


def _possible(text: Column, names: list[str]) -> Column:
    """Whether some of the words may occur in the text."""
    out, low = F.lit(False), F.lower(text)
    for word in sorted(names, key=len, reverse=True):
        out = out | (F.contains(low, F.lit(word)) if len(word) > 3 else F.rlike(low, F.lit(rf"(?<![\p{{L}}\p{{N}}]){word}(?![\p{{L}}\p{{N}}])")))
    return out


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """key, license (of the best match, ties to the first template), dice (0 without a match), n_matches (pairs of unit and template, and templates with a run of
    lines) and matches (dice, license) of every row."""
    names = F.array(*[F.lit(k) for _, k, _ in templates()])
    none = F.array().cast("array<struct<dice:double,i:int>>")
    rows = own_columns(docs, key, text).toDF("k", "t")
    units = F.when(F.col("t").isNotNull() & _possible(F.col("t"), required(least)), _matches(F.col("t"), least)).otherwise(none)
    runs = F.when(F.col("t").isNotNull() & _possible(F.col("t"), required(least, True)), _run_matches(F.col("t"), least)).otherwise(none)
    found = rows.select(F.col("k").alias(key), F.concat(units, runs).alias("m"))
    best = F.reduce("m", F.struct(F.lit(0.0).alias("dice"), F.lit(-1).alias("i")), lambda a, x: F.when((x["dice"] > a["dice"]) | ((x["dice"] == a["dice"]) & (x["i"] < a["i"])), x).otherwise(a))
    found = found.withColumn("best", best)
    return found.select(key, F.when(F.col("best.i") >= 0, F.get(names, F.col("best.i"))).alias("license"), F.col("best.dice").alias("dice"), F.size("m").cast("long").alias("n_matches"), F.transform("m", lambda m: F.struct(m["dice"].alias("dice"), F.get(names, m["i"]).alias("license"))).alias("matches"))


def oracle_sql(least: float = LEAST) -> str:
    """The same in SQL, by joining bigram counts, without either pruning by words or early exits."""
    low, high = _span(templates()[: len(TEXTS)], least)
    values = ", ".join(f"({i}, '{k}', {len(w) - 1}, '{b}')" for i, k, w in templates() for b in numbered(w))
    return f"""
WITH t(i, license, n, b) AS (VALUES {values}),
units AS (
  SELECT doc_id, u FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS u FROM documents)
  UNION ALL
  SELECT doc_id, u FROM (SELECT doc_id, unnest(string_split_regex(text, '\\n[ \\t\\r]*\\n\\s*')) AS u FROM documents) WHERE contains(trim(u), chr(10))
  UNION ALL
  SELECT doc_id, text FROM documents WHERE len(string_split_regex(text, '\\n[ \\t\\r]*\\n\\s*')) > 1),
w AS (SELECT row_number() OVER () AS unit, doc_id, string_split(trim(regexp_replace(lower(u), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS words FROM units),
p AS (SELECT unit, doc_id, len(words) - 1 AS n, unnest(list_transform(range(1, len(words)), lambda k: words[k] || ' ' || words[k + 1])) AS pair FROM w WHERE len(words) > 1),
l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) AS ls FROM documents WHERE text IS NOT NULL),
i AS (SELECT doc_id, ls, unnest(range(1, len(ls))) AS i FROM l),
k AS (SELECT doc_id, ls, i, unnest(range(2, least({RUN}, len(ls) - i + 1) + 1)) AS k FROM i WHERE ls[i] <> ''),
rw AS (SELECT row_number() OVER () AS unit, doc_id, string_split(array_to_string(list_filter(ls[i:i + k - 1], lambda x: x <> ''), ' '), ' ') AS words FROM k WHERE ls[i + k - 1] <> ''),
rp AS (SELECT unit, doc_id, len(words) - 1 AS n, unnest(list_transform(range(1, len(words)), lambda k: words[k] || ' ' || words[k + 1])) AS pair FROM rw WHERE len(words) - 1 BETWEEN {low} AND {high}),
rb AS (SELECT unit, doc_id, n, pair || ' ' || row_number() OVER (PARTITION BY unit, pair) AS b FROM rp),
rm AS (SELECT rb.doc_id, rb.unit, t.i, t.license, 2.0::DOUBLE * count(*) / (rb.n + t.n) AS dice FROM rb JOIN t ON rb.b = t.b WHERE t.i < {len(TEXTS)} GROUP BY rb.doc_id, rb.unit, rb.n, t.i, t.license, t.n HAVING 2.0::DOUBLE * count(*) / (rb.n + t.n) >= {least}),
b AS (SELECT unit, doc_id, n, pair || ' ' || row_number() OVER (PARTITION BY unit, pair) AS b FROM p),
m AS (SELECT b.doc_id, b.unit, t.i, t.license, 2.0::DOUBLE * count(*) / (b.n + t.n) AS dice FROM b JOIN t ON b.b = t.b GROUP BY b.doc_id, b.unit, b.n, t.i, t.license, t.n HAVING 2.0::DOUBLE * count(*) / (b.n + t.n) >= {least}),
a AS (SELECT doc_id, i, license, dice FROM m UNION ALL SELECT doc_id, i, license, max(dice) FROM rm GROUP BY ALL),
best AS (SELECT doc_id, license, dice, count(*) OVER (PARTITION BY doc_id) AS n_matches, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, i) AS k FROM a)
SELECT d.doc_id, best.license, coalesce(best.dice, 0.0::DOUBLE) AS dice, coalesce(best.n_matches, 0)::BIGINT AS n_matches
FROM documents d LEFT JOIN best ON d.doc_id = best.doc_id AND best.k = 1"""
