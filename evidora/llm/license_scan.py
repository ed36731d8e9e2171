"""Licence scan: lines and paragraphs against licence templates by the Dice coefficient over word bigrams.

Native: DataFrame functions only. A unit is a single line, or a paragraph: a whole run of two or more lines that hold words, so a
grant or a licence wrapped over lines is one unit, whatever marks (such as '#' or ' * ') begin its lines. Text is lower-cased,
everything but letters and digits becomes a space, and a unit is compared as the set of its word bigrams. A template with t bigrams
can reach a coefficient of at least tau only with units of t*tau/(2-tau) to t*(2-tau)/tau bigrams, so a unit's size alone picks its
candidate templates. Before that, texts and units without any of the words that such a match must hold (cover_words, a lossless
bound) are passed over.

scan_licences judges whole units. scan_windows judges runs of consecutive words of the whole text, wherever lines end, against the
same templates; it needs Python, for texts that hold a cover word only.

Defined results: null and empty texts have no units and no rows; a text of any length is judged whole; a repeated document or doc_id
is scanned row by row; a template tie goes to the smaller template id; an empty table gives no rows; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_text_batches

MIN_DICE = 0.8
#: Public licence grants and notices, in their common wording.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit-released", "Released under the MIT License."),
    ("mit-licensed", "This project is licensed under the MIT License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("gpl-2.0-line", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0-line", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0-work", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced without permission."),
)


_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_REST = " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_REST = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

#: Whole permission texts.
FULL_TEXTS: tuple[tuple[str, str], ...] = (
    ("mit-permission", _MIT),
    ("mit-text", _MIT + _MIT_REST),
    ("bsd-2-clause-text", _BSD + _BSD_REST),
    ("bsd-3-clause-text", _BSD + _BSD_3 + _BSD_REST),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
)


def normal_words(line: Column) -> Column:
    """Words of a line: lower case, runs of letters and digits."""
    return F.filter(F.split(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def bigrams(words: Column) -> Column:
    """The distinct bigrams of a word array; a single word counts as one bigram with itself."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.when(F.size(words) == 1, F.array(F.concat_ws(" ", words[0], words[0]))).otherwise(pairs))


def size_bounds(n: int, min_dice: float = MIN_DICE) -> tuple[int, int]:
    """The numbers of bigrams that a set can have to reach min_dice with one of n."""
    return max(1, math.ceil(n * min_dice / (2 - min_dice) - 1e-9)), math.floor(n * (2 - min_dice) / min_dice + 1e-9)


#: Words that many lines hold; a cover made of others passes fewer lines.
COMMON = frozenset("a an and any are as be by for free from in is it may no not of on or part that the this to under use with without work you".split())


def cover_words(grams: list[str], min_dice: float = MIN_DICE) -> list[str]:
    """Words of which a line must hold at least one to reach min_dice with a template of these bigrams.

    Such a line shares at least n * min_dice / (2 - min_dice) of the n bigrams; so of any set of more bigrams than it may miss it
    holds one, and with it the bigram's words. Long words that together touch so many bigrams are taken, common ones last.
    """
    misses = len(grams) - math.ceil(len(grams) * min_dice / (2 - min_dice) - 1e-9)
    words, touched = [], set()
    for w in sorted({w for g in grams for w in g.split(" ")}, key=lambda w: (w in COMMON, w.isdigit(), -len(w), w)):
        if len(touched) > misses:
            break
        words.append(w)
        touched |= {g for g in grams if w in g.split(" ")}
    return words


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """template, grams, n_template: a list given by the caller, which becomes part of the plan."""
    rows = spark.createDataFrame([tuple(t) for t in templates], "template string, wording string")
    return rows.select("template", bigrams(normal_words(F.col("wording"))).alias("grams")).withColumn("n_template", F.size("grams"))


def units(text: Column) -> Column:
    """[(line, n_lines, words)] of a text: each line that holds words, and each run of two or more such lines."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " ")))
    single = F.transform(lines, lambda x, i: F.struct(i.alias("line"), F.lit(1).alias("n_lines"), x.alias("words")))
    # runs between blank lines: their ends, then the lines of each
    joined = F.split(F.array_join(F.transform(lines, lambda x, i: F.when(x == "", "\n").otherwise(F.concat(i.cast("string"), F.lit("\t"), x, F.lit("\t")))), ""), "\n")
    runs = F.filter(F.transform(joined, lambda r: F.split(r, "\t")), lambda r: F.size(r) > 4)
    several = F.transform(runs, lambda r: F.struct(r[0].cast("int").alias("line"), F.floor(F.size(r) / 2).cast("int").alias("n_lines"), F.array_join(F.filter(r, lambda x, i: i % 2 == 1), " ").alias("words")))
    return F.concat(F.filter(single, lambda u: u["words"] != ""), several)


def scan_licences(docs: DataFrame, templates=TEMPLATES + FULL_TEXTS, min_dice: float = MIN_DICE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each unit that reaches min_dice: doc_id, line (its first, from 0), n_lines, template (its best), dice, n_grams."""
    spark = docs.sparkSession
    by_size = template_table(spark, templates).where("n_template > 0").collect()  # a short list given by the caller
    bounds = {t.template: size_bounds(t.n_template, min_dice) for t in by_size}
    sizes = sorted({k for low, high in bounds.values() for k in range(low, high + 1)})
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    if not sizes:
        return rows.select(F.col("_id").alias(doc_id), F.lit(0).alias("line"), F.lit(1).alias("n_lines"), F.lit("").alias("template"), F.lit(0.0).alias("dice"), F.lit(0).alias("n_grams")).where("false")
    # lossless: texts and units without any cover word can't reach min_dice with any template
    words = "|".join(sorted({w for t in by_size for w in cover_words(list(t.grams), min_dice)}))
    rows = rows.where(F.lower("_text").rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{words})(?![\p{{L}}\p{{N}}])"))
    found = rows.select("_id", F.explode(units(F.col("_text"))).alias("_u")).select("_id", "_u.line", "_u.n_lines", "_u.words")
    found = found.where(F.col("words").rlike(rf"(?:^| )(?:{words})(?: |$)")).withColumn("words", F.split("words", " "))
    found = found.withColumn("_grams", bigrams(F.col("words"))).withColumn("n_grams", F.size("_grams")).where(F.col("n_grams").isin(sizes))
    structs = [
        F.when(F.col("n_grams").between(*bounds[t.template]), F.struct((2.0 * F.size(F.array_intersect("_grams", F.array(*[F.lit(g) for g in t.grams]))) / (F.col("n_grams") + F.lit(t.n_template))).alias("dice"), F.lit(-i).alias("order"), F.lit(t.template).alias("template")))
        for i, t in enumerate(sorted(by_size, key=lambda t: t.template))
    ]
    hits = found.withColumn("_best", F.array_max(F.array(*structs))).where(F.col("_best.dice") >= min_dice)
    return hits.select(F.col("_id").alias(doc_id), "line", "n_lines", F.col("_best.template").alias("template"), F.round("_best.dice", 6).alias("dice"), "n_grams")


def windows(words: list[str], templates: list[tuple[str, frozenset]], min_dice: float = MIN_DICE) -> list[tuple[int, int, str, float]]:
    """(first word, words, template, dice): each template's best windows that do not overlap, the best first (then the earliest, the shortest).

    A bigram at an end that is not the template's can be cut off without lowering the coefficient, so windows from one bigram of
    the template to another are all that count; a window ends where it holds more distinct bigrams than min_dice allows.
    """
    grams = [f"{a} {b}" for a, b in zip(words, words[1:])] if len(words) > 1 else [f"{w} {w}" for w in words]
    have, out = set(grams), []
    for name, own in templates:
        low, high = size_bounds(len(own), min_dice)
        if len(have & own) < low:  # it shares at least so many
            continue
        hits = [i for i, g in enumerate(grams) if g in own]
        found = []
        for i in hits:
            seen, shared = set(), 0
            for j in range(i, len(grams)):
                g = grams[j]
                if g in seen and g not in own:
                    continue
                if g not in seen:
                    seen.add(g)
                    shared += g in own
                    if len(seen) > high:
                        break
                    if g in own and 2 * shared / (len(seen) + len(own)) >= min_dice - 1e-12:
                        found.append((-2 * shared / (len(seen) + len(own)), i, j))
        taken: list[tuple[int, int]] = []
        for d, i, j in sorted(found):
            if all(j < a or i > b for a, b in taken):
                taken.append((i, j))
                out.append((i, min(len(words), j - i + 2), name, round(-d, 6)))
    return out


def _windows(batches: Iterator[pa.RecordBatch], templates, min_dice: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, rows = [], []
        for i, w in enumerate(b.column(1).to_pylist()):
            got = windows(w, templates, min_dice)
            at += [i] * len(got)
            rows += got
        cols = [pa.array([r[k] for r in rows], schema.field(k + 1).type) for k in range(4)]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *cols], names=schema.names)


def scan_windows(docs: DataFrame, templates=TEMPLATES + FULL_TEXTS, min_dice: float = MIN_DICE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each window that reaches min_dice: doc_id, word (its first, from 0), n_words, template, dice.

    A licence may stand in a window for its text and in another for a sentence of it: each template has its own rows.
    """
    by_name = template_table(docs.sparkSession, templates).where("n_template > 0").collect()  # a short list given by the caller
    own = sorted((t.template, frozenset(t.grams)) for t in by_name)
    schema = pa.schema([("id", pa.int64()), ("word", pa.int32()), ("n_words", pa.int32()), ("template", pa.string()), ("dice", pa.float64())])
    cover = "|".join(sorted({w for t in by_name for w in cover_words(list(t.grams), min_dice)}))
    if cover:
        docs = docs.where(F.lower(F.col(text)).rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{cover})(?![\p{{L}}\p{{N}}])"))
    small_text_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("id"), normal_words(F.col(text)).alias("words"))
    out = rows.mapInArrow(lambda x: _windows(x, own, min_dice, schema), f"id {dict(rows.dtypes)['id']}, word int, n_words int, template string, dice double")
    return out.withColumnRenamed("id", doc_id)
