"""License scans with DataFrame functions only.

A text's lines, the text as a whole, and windows of as many words as a template has (wherever lines
end) are normalised and compared with licence templates by the Dice coefficient over sets of word
bigrams. ``Dice >= t`` needs the sizes of the two sets to be within a factor of ``(2 - t) / t``, so
a template is a candidate for units of such sizes only; and it needs some of any template's bigrams
but the rarest, so units without such an anchor are never made.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Notices by which works state their licence, by identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 2.1."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("proprietary", "All rights reserved."),
    ("MIT", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", "
        "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")),
    ("ISC", (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
        "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")),
    ("BSD-2-Clause", (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.")),
    ("Apache-2.0", (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.")),
    ("GPL-3.0", (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details.")),
]


def normalized(x: Column) -> Column:
    """A-Z lower-cased; every run of other characters than a-z and 0-9 is one blank; trimmed."""
    low = F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def bigrams(norm: Column) -> Column:
    """The set of word bigrams of a normalised text; a single word is its own; none: empty."""
    w = F.split(norm, " ")
    pairs = F.array_distinct(F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat_ws(" ", a, b)))
    return F.when(norm == "", F.array().cast("array<string>")).when(F.size(w) == 1, w).otherwise(pairs)


def template_words(text: str) -> list[str]:
    return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    w = template_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))) or w


def anchors(s: list[str], threshold: float = THRESHOLD) -> list[str]:
    """Bigrams of a template of which every unit that matches it contains at least one.

    ``Dice >= t`` needs ``t / (2 - t)`` of a template's bigrams at least, so of any set of more than
    the rest a match has one. The longest ones are taken: they are the least likely elsewhere.
    """
    least = -int(-(threshold * len(s) / (2 - threshold) - 1e-9) // 1)
    return sorted(s, key=lambda b: (-len(b), b))[: max(1, len(s) - least + 1)]


def telling(sets: list[list[str]], threshold: float = THRESHOLD) -> list[str]:
    """A few words and bigrams of which every unit that matches some template contains at least one.

    A match has ``t / (2 - t)`` of a template's bigrams at least, so parts that leave fewer bigrams
    of it untouched will do. Long words that serve many templates are taken first; a template of
    short words gives its longest bigrams.
    """
    chosen: list[str] = []
    left = [(set(s), -int(-(threshold * len(s) / (2 - threshold) - 1e-9) // 1)) for s in sets]
    while left:
        gain: dict[str, int] = {}
        for s, _ in left:
            for b in s:
                for w in {x for x in b.split(" ") if len(x) > 5}:
                    gain[w] = gain.get(w, 0) + len(w)
        part = max(gain, key=lambda w: (gain[w], w)) if gain else max(left[0][0], key=lambda b: (len(b), b))
        chosen.append(part)
        left = [({b for b in s if part != b and part not in b.split(" ")}, need) for s, need in left]
        left = [(s, need) for s, need in left if len(s) >= need]
    return sorted(chosen)


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``template_no``, ``license``, ``dice``, ``unit``, ``position``: the best unit of
    each row and template that is similar enough.

    A ``line`` has its number, from 1, as position; ``text`` is the whole text at 0, where it has
    more than one line; a ``window`` has as many words as the template, from the word numbered by
    its position (from 0), in texts of more words than that. Of equally similar units a line comes
    before the text and that before a window, then the first one. Null and empty texts match
    nothing; repeated rows give repeated matches.
    """
    sets = [(i, template_bigrams(t), len(template_words(t))) for i, (_, t) in enumerate(templates)]
    sets = [x for x in sets if x[1]]
    spread = (2 - threshold) / threshold
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # made in a generator, so that the filter doesn't normalise once more for each word
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array(F.struct(text.alias("text"), normalized(text).alias("norm")))).alias("x")).select("doc_id", "x.text", "x.norm")
    parts = telling([s for _, s, _ in sets], threshold)
    any_word = lambda x: functools.reduce(lambda a, b: a | b, [x.contains(w) for w in parts])
    df = df.where(any_word(F.col("norm")))
    score_of = {i: (s, F.array(*[F.lit(x) for x in s])) for i, s, _ in sets}

    def dice(grams: Column, i: int) -> Column:
        s, lit = score_of[i]
        both = F.size(F.array_intersect(grams, lit))
        return (2 * both).cast("double") / (F.size(grams) + len(s)).cast("double")

    def fits(grams: Column, i: int) -> Column:
        n = len(score_of[i][0])
        return F.size(grams).between(int(n / spread - 1e-9), int(n * spread + 1e-9))

    kind = "struct<template_no:int,minus:double,kind:int,position:int>"

    # lines, and the text where it has several
    lines = F.split("text", "\n", -1)
    units = F.concat(F.array(F.when(F.size(lines) > 1, F.col("norm")).otherwise(F.lit(""))), F.transform(lines, normalized))
    numbered = F.transform(units, lambda x, i: F.struct(i.alias("i"), x.alias("norm")))
    sized = F.transform(F.filter(numbered, lambda x: any_word(x["norm"])), lambda x: F.struct(x["i"].alias("i"), bigrams(x["norm"]).alias("b")))
    by_unit = F.flatten(F.transform(sized, lambda x: F.filter(F.array(*[F.when(fits(x["b"], i), F.struct(F.lit(i).alias("template_no"), (-dice(x["b"], i)).alias("minus"), F.when(x["i"] > 0, 0).otherwise(1).alias("kind"), x["i"].cast("int").alias("position"))) for i, _, _ in sets]), lambda h: h.isNotNull() & (h["minus"] <= -threshold))))
    # windows around the places of a template's anchors
    words = F.split("norm", " ")
    df = df.withColumn("w", words).withColumn("g", F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.concat_ws(" ", a, b)))

    def windows(i: int, s: list[str], n: int) -> Column:
        mine, single, span = anchors(s, threshold), n == 1, max(1, n - 1)  # a window has so many bigrams
        own, present = F.array(*[F.lit(b) for b in mine]), F.lit(False)
        for b in mine:
            present = present | F.col("norm").contains(b)
        at = F.filter(F.transform("w" if single else "g", lambda g, j: F.when(F.array_contains(own, g), j)), lambda j: j.isNotNull())
        starts = F.array_distinct(F.flatten(F.transform(at, lambda j: F.sequence(F.greatest(j - (span - 1), F.lit(0)), F.least(j, F.size("w") - n)))))

        def tried(p: Column) -> Column:
            grams = F.slice("w", p + 1, F.lit(1)) if single else F.array_distinct(F.slice("g", p + 1, F.lit(span)))
            return F.struct(F.lit(i).alias("template_no"), (-dice(grams, i)).alias("minus"), F.lit(2).alias("kind"), p.cast("int").alias("position"))

        close = F.filter(F.transform(starts, tried), lambda h: h["minus"] <= -threshold)
        return F.when((F.size("w") > n) & present, close).otherwise(F.array()).cast(f"array<{kind}>")

    found = [by_unit.cast(f"array<{kind}>"), *[windows(*x) for x in sets]]
    every = F.array_sort(F.concat(*found))
    best = F.filter("m", lambda h, j: (j == 0) | (F.get("m", j - 1)["template_no"] != h["template_no"]))
    df = df.select("doc_id", every.alias("m")).select("doc_id", F.explode(best).alias("x"))
    names = F.array(*[F.lit(n) for n, _ in templates])
    kinds = F.array(F.lit("line"), F.lit("text"), F.lit("window"))
    return df.select("doc_id", F.col("x.template_no").cast("long").alias("template_no"), names[F.col("x.template_no")].alias("license"), (-F.col("x.minus")).alias("dice"), kinds[F.col("x.kind")].alias("unit"), F.col("x.position").cast("long").alias("position"))


def oracle_sql(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same scan as SQL for DuckDB: every line, text and window against the templates of which
    the text has so many bigrams that some unit could be similar enough, without anchors."""
    quoted = ", ".join(f"({i}, '{n}', '{t.replace(chr(39), chr(39) * 2)}')" for i, (n, t) in enumerate(templates))
    norm = "trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))"
    pairs = "list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])"
    grams = "case when w = [''] then [] when len(w) = 1 then w else list_distinct(" + pairs.format(w="w") + ") end"
    return f"""
        with t as (select no, license, string_split({norm.format("t")}, ' ') as w from (values {quoted}) v(no, license, t)),
             tb as (select no, license, len(w) as n, {grams} as g from t where w <> ['']),
             d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as l from documents),
             dw as (select r, doc_id, text, l, string_split({norm.format("text")}, ' ') as w from d),
             dg as (select *, {grams} as all_g, case when len(w) > 1 then {pairs.format(w="w")} else w end as g from dw),
             c as (select dg.r, dg.doc_id, dg.w, dg.g, dg.text, dg.l, tb.no, tb.license, tb.n, tb.g as tg from dg join tb on list_has_any(dg.all_g, tb.g) and 2 * len(list_intersect(dg.all_g, tb.g)) >= {threshold} * (len(tb.g) + len(list_intersect(dg.all_g, tb.g))) - 1e-9),
             u as (select r, doc_id, no, license, tg, 0 as kind, unnest(range(1, len(l) + 1)) as position, unnest(l) as line from c
                   union all select r, doc_id, no, license, tg, 1, 0, text from c where len(l) > 1),
             uw as (select *, string_split({norm.format("line")}, ' ') as w from u),
             ub as (select r, doc_id, no, license, tg, kind, position, {grams} as g from uw),
             s as (select r, doc_id, no, license, kind, position, (2 * len(list_intersect(g, tg)))::double / (len(g) + len(tg))::double as dice from ub where len(g) > 0
                   union all
                   select r, doc_id, no, license, 2, p, (2 * len(list_intersect(list_distinct(g[p + 1:p + greatest(1, n - 1)]), tg)))::double / (len(list_distinct(g[p + 1:p + greatest(1, n - 1)])) + len(tg))::double
                   from (select *, unnest(range(0, len(w) - n + 1)) as p from c where len(w) > n)),
             k as (select *, row_number() over (partition by r, no order by dice desc, kind, position) as k from s where dice >= {threshold})
        select doc_id::bigint as doc_id, no::bigint as template_no, license, dice, ['line', 'text', 'window'][kind + 1] as unit, position::bigint as position from k where k = 1"""
