"""Licence scans: sparse TF-IDF cosine to templates, inherited along paths.

Every line of every file is a unit. A unit's vector has a weight per word,
term frequency times ln((N + 1) / (df + 1)) + 1, where N counts all units
and df the units with the word; words outside the templates have df 0. A
unit's licence is the template of the largest cosine, if that reaches
``threshold``. A file's own licence is the best of its units (ties: first
line, then licence name).

Licence texts and longer headers (``bodies``) are compared with blocks: the
whole file, its paragraphs, its leading paragraphs together, and two to four
lines in a row; the lines' templates are compared with blocks too, as a
header may be wrapped. A block that matches a body decides before any line
(a BSD text also has the line "All rights reserved."), a wrapped header only
where no line does. Words weigh the same as in lines. A file of whose words at least ``file_share``
stand in licence units is a licence file and speaks for its directory. A
file without a licence of its own inherits that of the nearest ancestor
directory with a licence file (of several files in one directory the best
cosine, then the smallest id, decides).

Only DataFrame operations are used. Document frequencies are counted for
template words alone (a few hundred rows at most). Units that cannot reach
the threshold are left out exactly, not by a guess: the template words are
sorted by weight, and a unit without any of a template's heaviest words,
the rest of which fall short of the threshold together, cannot match it.
Likewise a file, and then a block, is left out if for every template the
weights of the words it has of it fall short together.
Other texts are not shuffled. They are read for the word counts, the lines, the
blocks, the directories and the result; only the words of files that may have a
matching block travel, once, to be cut into blocks.

Defined results: null and empty texts have no units; a null path has no
directory and inherits nothing; null ids come first in ties; equal rows get
equal answers; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textctl.session import prepare

from .common import saved

# The usual header lines of common licences.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Proprietary": ["All rights reserved."],
}
_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution. "
)


def _gnu(name: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, "
        f"either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, "
        f"but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. "
        f"You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
    )


# Whole texts of short licences, the longer headers and the openings of long ones.
BODIES = {
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of '
        "the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License "
        'is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language '
        "governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions.",
    ],
    "BSD-2-Clause": [_BSD + _AS_IS],
    "BSD-3-Clause": [
        _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission. " + _AS_IS
    ],
    "GPL-2.0": [_gnu("GNU General Public License", "2"), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc."],
    "GPL-3.0": [_gnu("GNU General Public License", "3"), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>"],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
        'notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
        "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ],
    "LGPL-3.0": [_gnu("GNU Lesser General Public License", "3"), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>"],
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in '
        "the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
        'permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one "
        "at https://mozilla.org/MPL/2.0/."
    ],
}
_SPLIT = r"[^\p{L}\p{N}]+"
MAX_TEMPLATE_WORDS = 5000


@dataclass(frozen=True)
class Params:
    templates: Mapping[str, list[str]] = field(default_factory=lambda: TEMPLATES)
    bodies: Mapping[str, list[str]] = field(default_factory=lambda: BODIES)
    threshold: float = 0.8
    file_share: float = 0.25


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _unit_words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), _SPLIT), lambda w: w != "")


def _units(files: DataFrame) -> DataFrame:
    """(id, mark, pos, words) of every line with words."""
    lines = files.select("id", "mark", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("id", "mark", "pos", _unit_words(F.col("line")).alias("words")).filter(F.size("words") > 0)


def _frequencies(units: DataFrame, *templates: Mapping) -> tuple[dict, int]:
    """The number of units with each template word, and of all units. One
    count for all templates; one number per word comes to the driver."""
    known = sorted({w for t in templates for texts in t.values() for line in texts for w in words(line)})
    if len(known) > MAX_TEMPLATE_WORDS:
        raise ValueError("too many template words")
    vocabulary = F.array(*[F.lit(w) for w in known]) if known else F.array().cast("array<string>")
    seen = units.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect("words", vocabulary))).alias("word"))
    df = {r["word"]: r["count"] for r in seen.groupBy("word").count().collect()}
    return df, df.pop("", 0)


def _weights(frequencies: tuple[dict, int], templates: Mapping) -> tuple[dict, dict, float]:
    """Template vectors of unit length, inverse document frequencies of their
    words, and that of a word outside."""
    df, n = frequencies
    counts = {(name, i): _count(words(t)) for name, texts in templates.items() for i, t in enumerate(texts)}
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 for w in sorted({w for c in counts.values() for w in c})}
    vectors = {}
    for key, c in counts.items():
        v = {w: f * idf[w] for w, f in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors[key] = {w: x / norm for w, x in v.items()} if norm else {}
    return vectors, idf, math.log(n + 1) + 1


def _count(seen: list[str]) -> dict[str, int]:
    return {w: seen.count(w) for w in sorted(set(seen))}


def _needed(vectors: dict, threshold: float) -> list[str]:
    """Words of which a unit must have one to reach the threshold."""
    out = set()
    for v in vectors.values():
        rest = 0.0
        for w, x in sorted(v.items(), key=lambda e: (e[1], e[0])):
            rest += x * x
            if math.sqrt(rest) >= threshold - 1e-9:
                out.add(w)  # this word and all heavier ones
    return sorted(out)


def frequencies(files: DataFrame, p: Params = Params()) -> tuple[dict, int]:
    """What ``matches`` and ``block_matches`` weigh words by."""
    return _frequencies(_units(files), p.templates, p.bodies)


def matches(files: DataFrame, p: Params = Params(), known: tuple[dict, int] | None = None) -> DataFrame:
    """(id, mark, pos, licence, cosine, n_words) of the units that reach the
    threshold, from (id, mark, text)."""
    vectors, idf, outside = _weights(known or frequencies(files, p), p.templates)
    return _scored(_units(files), vectors, idf, outside, p)


def _scored(units: DataFrame, vectors: dict, idf: dict, outside: float, p: Params) -> DataFrame:
    needed = _needed(vectors, p.threshold)
    spark = units.sparkSession
    rows = [(name, i, w, x) for (name, i), v in vectors.items() for w, x in v.items()]
    template = F.broadcast(spark.createDataFrame(rows, "licence string, variant int, word string, weight double"))
    known = F.broadcast(spark.createDataFrame(sorted(idf.items()), "word string, idf double"))
    able = units.filter(F.arrays_overlap("words", F.array(*[F.lit(w) for w in needed]))) if needed else units.limit(0)
    terms = able.select("id", "mark", "pos", F.size("words").alias("n_words"), F.explode("words").alias("word"))
    terms = terms.groupBy("id", "mark", "pos", "n_words", "word").agg(F.count(F.lit(1)).alias("tf"))
    unit = ["id", "mark", "pos", "n_words"]
    # blocks come dealt by file, so none of these sums moves their terms
    terms = terms.join(known, "word", "left").select(*unit, "word", (F.col("tf") * F.coalesce("idf", F.lit(outside))).alias("w"))
    normed = terms.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*unit))))
    dots = normed.join(template, "word").groupBy(*unit, "norm", "licence", "variant").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.select(*unit, "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine"))
    best = scored.filter(F.col("cosine") >= p.threshold).groupBy(*unit).agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "licence")).alias("b"))
    return best.select("id", "mark", "pos", F.col("b.licence").alias("licence"), (-F.col("b.minus")).alias("cosine"), "n_words")


def _able(seen: Column, vectors: dict, threshold: float) -> Column:
    """Whether the words that ``seen`` has of some template weigh enough: the
    cosine is at most the length of that part of the template. The words are
    first cut down to the templates', once for all templates."""
    every = sorted({w for v in vectors.values() for w in v})
    if not every:
        return F.lit(False)

    def enough(known: Column) -> Column:
        out = F.lit(False)
        for v in vectors.values():
            if v:
                weight = F.create_map(*[x for w, y in sorted(v.items()) for x in (F.lit(w), F.lit(y * y))])
                have = F.aggregate(F.array_intersect(known, F.array(*[F.lit(w) for w in sorted(v)])), F.lit(0.0), lambda total, w: total + F.try_element_at(weight, w))
                out = out | (F.sqrt(have) >= threshold - 1e-9)
        return out

    # bound by a lambda, so that it is evaluated once
    return F.exists(F.array(F.array_intersect(seen, F.array(*[F.lit(w) for w in every]))), enough)


def _runs(parts: str, size: int) -> Column:
    """Every ``size`` parts in a row, as one."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - size + 1))
    return F.transform(starts, lambda i: F.flatten(F.slice(parts, i, size)))


def block_matches(files: DataFrame, p: Params = Params(), known: tuple[dict, int] | None = None) -> DataFrame:
    """(id, mark, licence, body, cosine, n_words) of each file's best block
    that reaches the threshold, one of a body before one of a header."""
    templates = {(True, k): v for k, v in p.bodies.items()} | {(False, k): v for k, v in p.templates.items()}
    vectors, idf, outside = _weights(known or frequencies(files, p), templates)
    # the lines' templates are told from bodies by their names
    vectors = {(("B" if body else "H") + name, i): v for ((body, name), i), v in vectors.items()}
    needed = F.array(*[F.lit(w) for w in _needed(vectors, p.threshold)]).cast("array<string>")
    whole = files.withColumn("words", _unit_words(F.col("text"))).filter(F.arrays_overlap("words", needed))
    whole = whole.filter(_able(F.col("words"), vectors, p.threshold))
    split = lambda by: F.filter(F.transform(F.split("text", by), _unit_words), lambda w: F.size(w) > 0)
    # dealt before they are cut into blocks: texts are split once, each text
    # travels once, and the terms of its blocks stay where they are made
    whole = whole.select("id", "mark", "words", split("\n").alias("lines"), split(r"\n[ \t\r]*\n").alias("paragraphs")).repartition("id", "mark")
    runs = [_runs("lines", n) for n in (2, 3, 4)]
    leading = F.transform(F.sequence(F.lit(2), F.lit(12)), lambda n: F.flatten(F.slice("paragraphs", F.lit(1), n)))
    blocks = F.concat(F.array("words"), F.col("paragraphs"), leading, *runs)
    units = whole.select("id", "mark", F.posexplode(F.array_distinct(blocks)).alias("pos", "words"))
    found = _scored(units.filter(_able(F.col("words"), vectors, p.threshold)), vectors, idf, outside, p)
    best = F.min(F.struct((F.substring("licence", 1, 1) != "B").alias("header"), (-F.col("cosine")).alias("minus"), (-F.col("n_words")).alias("short"), "licence"))
    best = found.groupBy("id", "mark").agg(best.alias("b"))
    return best.select("id", "mark", F.expr("substring(b.licence, 2)").alias("licence"), (~F.col("b.header")).alias("body"), (-F.col("b.minus")).alias("cosine"), (-F.col("b.short")).alias("n_words"))


def directory(path: Column) -> Column:
    """What precedes the last slash; null without one."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", ""))


def scan(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", path_col: str = "path") -> DataFrame:
    """Per row of ``docs``: the id, path, ``licence``, ``how`` (own,
    inherited or none), ``cosine`` (of the unit that decided) and
    ``from_dir`` (the directory inherited from)."""
    prepare(docs.sparkSession)
    text = F.col(text_col)
    files = docs.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("mark"), text.alias("text"))
    known = frequencies(files, p)
    found = saved(matches(files, p, known), "licence-units")
    own = found.dropDuplicates(["id", "mark", "pos"]).groupBy("id", "mark").agg(
        F.min(F.struct((-F.col("cosine")).alias("minus"), "pos", "licence")).alias("b"), F.sum("n_words").alias("in_licence")
    )
    own = own.select("id", "mark", F.col("b.licence").alias("own"), (-F.col("b.minus")).alias("cosine"), "in_licence")
    blocks = saved(block_matches(files, p, known), "licence-blocks").select("id", "mark", "body", F.struct(F.col("licence").alias("own"), "cosine", F.col("n_words").cast("long").alias("in_licence")).alias("block"))
    both = own.alias("o").join(blocks.alias("k"), F.col("o.id").eqNullSafe(F.col("k.id")) & (F.col("o.mark") == F.col("k.mark")), "full")
    line = F.when(F.col("o.mark").isNotNull(), F.struct("o.own", "o.cosine", "o.in_licence"))
    own = both.select(
        F.when(F.col("o.mark").isNotNull(), F.col("o.id")).otherwise(F.col("k.id")).alias("__id"),
        F.coalesce("o.mark", "k.mark").alias("__mark"),
        F.when(F.col("k.body"), F.col("k.block")).otherwise(F.coalesce(line, F.col("k.block"))).alias("found"),
    ).select("__id", "__mark", "found.*")
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark"))
    # words are counted before the join, as it would move every text
    counted = files.select("id", "path", "mark", F.size(_unit_words(F.col("text"))).alias("all"))
    narrow = saved(counted.join(own, same, "left").select("id", "path", "own", "cosine", "in_licence", "all"), "licence-own")
    speaking = narrow.filter((F.col("in_licence") >= p.file_share * F.col("all")) & F.col("path").isNotNull())
    by_dir = speaking.groupBy(directory(F.col("path")).alias("ancestor")).agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "id", "own")).alias("b"))
    by_dir = saved(by_dir.filter("ancestor IS NOT NULL").select("ancestor", F.col("b.own").alias("given"), (-F.col("b.minus")).alias("given_cosine")), "licence-dirs")

    dirs = narrow.select(directory(F.col("path")).alias("dir")).filter("dir IS NOT NULL").distinct()
    parts = F.split("dir", "/")
    up = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("ancestor")))).alias("a")).select("dir", "a.*")
    nearest = up.join(by_dir, "ancestor").groupBy("dir").agg(F.max(F.struct("depth", "ancestor", "given", "given_cosine")).alias("n"))
    nearest = nearest.select(F.col("dir").alias("__dir"), "n.ancestor", "n.given", "n.given_cosine")
    out = narrow.select("id", "path", "own", "cosine").join(nearest, directory(F.col("path")) == F.col("__dir"), "left")
    inherits = F.col("own").isNull() & F.col("given").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        "path",
        F.coalesce("own", "given").alias("licence"),
        F.when(F.col("own").isNotNull(), "own").when(inherits, "inherited").otherwise("none").alias("how"),
        F.when(inherits, F.col("given_cosine")).otherwise(F.col("cosine")).alias("cosine"),
        F.when(inherits, F.col("ancestor")).alias("from_dir"),
    )
