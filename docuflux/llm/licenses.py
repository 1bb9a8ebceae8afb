"""License scans: normalised text is compared to licence templates by the Dice coefficient over
distinct word bigrams, 2 |A and B| / (|A| + |B|).

Units are lines, whole texts, and windows of a template's length laid so that a lead word of the
template meets its place in it, so that notices inside longer lines, wrapped over lines or within
larger files are found too.

DataFrame functions only, row by row, without a shuffle. Size bounds prune: a unit of m bigrams
reaches t with a template of n only if m is within n t / (2 - t) and n (2 - t) / t. A text or line
is looked at closer only if it has a lead word: the leads of each template leave so few of its
bigrams without one that a unit without leads can't reach t. Both prunings are exact.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8
#: Fixed licence notices, by SPDX name.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]


#: Words that make poor leads, as do those of up to three letters, which other languages have too; they are taken last.
COMMON = set("a all an and any are be been by can do for from have if in is it may more must no not of on one only or other our shall should some such than that the their them then there these they this those to under was were when where whether which will with without would you your".split())


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def grams_of(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def template_rows(templates=TEMPLATES) -> list[tuple[int, str, int, list[str]]]:
    """(template, license, number of words, distinct bigrams)."""
    return [(i, name, len(words_of(text)), grams_of(words_of(text))) for i, (name, text) in enumerate(templates)]


def leads(least: float, templates=TEMPLATES) -> list[tuple[str, int, int]]:
    """(word, template, place in it) of words of which any unit that reaches `least` with the
    template has one at least."""
    chosen: set[str] = set()
    for _, text in templates:
        words = words_of(text)
        grams = set(zip(words, words[1:]))
        need = math.ceil(least / (2 - least) * len(grams) - 1e-9)
        while len(left := [g for g in grams if not chosen & set(g)]) >= max(1, need):
            counts = {w: sum(w in g for g in left) for g in left for w in g}
            chosen.add(max(counts, key=lambda w: (w not in COMMON and len(w) > 3, w not in COMMON, counts[w], len(w), w)))
    return [(w, i, q) for i, (_, text) in enumerate(templates) for q, w in enumerate(words_of(text)) if w in chosen]


def normal(text: Column) -> Column:
    """A-Z lowered, what is no ASCII letter or digit to single spaces, trimmed."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lowered, "[^a-z0-9]+", " "))


def let(value: Column, use) -> Column:
    """use(value) with value made once, also inside a lambda."""
    return F.transform(F.array(value), use)[0]


def bigrams(w: Column) -> Column:
    """Distinct bigrams of an array of words."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat(F.get(w, i - 1), F.lit(" "), F.get(w, i)))
    return F.array_distinct(F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<string>")))


def found_in(text: Column, least: float, templates) -> Column:
    """array of (unit, template, license, dice) of the units that reach least, as units(); text must be a column."""
    known, low = template_rows(templates), least / (2 - least)
    some = leads(least, templates)
    names = sorted({w for w, _, _ in some})
    lead = F.lit("(?i)(?<![A-Za-z0-9])(?:" + "|".join(names) + ")(?![A-Za-z0-9])")
    table = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.lit(len(g)).alias("n"), F.array(*map(F.lit, g)).alias("g")) for i, name, _, g in known])
    at = F.create_map(*[x for w in names for x in (F.lit(w), F.array(*[F.struct(F.lit(i).alias("template"), F.lit(q).alias("q"), F.lit(known[i][2]).alias("size")) for v, i, q in some if v == w]))])
    smallest = math.ceil(low * min(len(g) for *_, g in known) - 1e-9)

    def dice(g: Column, t: Column) -> Column:
        return 2 * F.size(F.array_intersect(g, t["g"])) / (F.size(g) + t["n"])

    def row(unit: Column, t: Column, value: Column) -> Column:
        return F.struct(unit.alias("unit"), t["template"].alias("template"), t["license"].alias("license"), value.alias("dice"))

    def best(unit: Column, words: Column) -> Column:
        """The unit's best template, in an array that is empty below least."""
        def of(g: Column) -> Column:
            fit = F.filter(table, lambda t: (F.size(g) >= t["n"] * low - 1e-9) & (F.size(g) * low <= t["n"] + 1e-9))
            rows = F.filter(F.transform(fit, lambda t: row(unit, t, dice(g, t))), lambda r: r["dice"] >= least - 1e-12)
            return F.slice(F.array_sort(rows, lambda x, y: F.when(x["dice"] > y["dice"], -1).when(x["dice"] < y["dice"], 1).otherwise(x["template"] - y["template"])), 1, 1)

        return F.when((F.size(words) - 1 >= smallest), let(bigrams(words), of)).otherwise(F.array().cast(KIND))

    def windows(w: Column) -> Column:
        hits = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda h: h["w"].isin(*names))
        laid = F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(at, h["w"]), lambda y: F.struct(
            y["template"].alias("template"), F.greatest(h["i"] - y["q"], F.lit(0)).alias("a"), F.least(h["i"] - y["q"] + y["size"], F.size(w)).alias("b")))))

        def of(s: Column) -> Column:
            t = F.element_at(table, s["template"] + 1)
            return let(bigrams(F.slice(w, s["a"] + 1, s["b"] - s["a"])), lambda g: row(F.lit(-2) - s["a"], t, dice(g, t)))

        return F.filter(F.transform(F.array_distinct(laid), of), lambda r: r["dice"] >= least - 1e-12)

    words = lambda x: F.split(normal(x), " ")
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("unit"), x.alias("x"))), lambda u: F.rlike(u["x"], lead))
    by_line = F.flatten(F.transform(lines, lambda u: let(words(u["x"]), lambda w: best(u["unit"], w))))
    whole = lambda w: F.when(F.contains(text, F.lit("\n")), best(F.lit(-1), w)).otherwise(F.array().cast(KIND))
    of_text = let(words(text), lambda w: F.concat(whole(w), windows(w)))
    return F.when(F.rlike(text, lead), F.concat(by_line, of_text)).otherwise(F.array().cast(KIND))


KIND = "array<struct<unit:int,template:int,license:string,dice:double>>"


def matches(docs: DataFrame, least: float = LEAST, templates=TEMPLATES) -> DataFrame:
    """doc_id, unit (line from 0; -1: the whole text; -2 - w: the window from word w), template,
    license and dice of each unit that reaches least: its best template, or a window's own."""
    rows = docs.select(F.col("doc_id"), F.explode(found_in(F.col("text"), least, templates)).alias("m"))
    return rows.select("doc_id", "m.*")


def scan(docs: DataFrame, least: float = LEAST, templates=TEMPLATES) -> DataFrame:
    """For each row of docs: doc_id, n_units (lines and whole texts that match), n_windows,
    licenses (of all matches, sorted, comma-joined), best_license and best_dice (null without a match).

    docs: doc_id, text; further columns are ignored. Null and empty texts match nothing. A unit
    counts for its best template; ties go to the earlier one. Rows that repeat give a row each;
    an empty table gives none.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # a generator, so that the matches are made once whatever reads them
    rows = docs.select(F.col("doc_id"), F.explode(F.array(found_in(text, least, templates))).alias("m"))
    first = F.array_min(F.transform("m", lambda x: F.struct((-x["dice"]).alias("d"), x["template"].alias("t"), x["license"].alias("l"))))
    return rows.select(
        "doc_id",
        F.size(F.filter("m", lambda x: x["unit"] >= -1)).cast("long").alias("n_units"),
        F.size(F.filter("m", lambda x: x["unit"] < -1)).cast("long").alias("n_windows"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("m", lambda x: x["license"]))), ",").alias("licenses"),
        first["l"].alias("best_license"), F.round(-first["d"], 6).alias("best_dice"),
    )
