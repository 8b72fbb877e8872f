"""Licence scan: a trained paragraph classifier, confirmed against templates.

The classifier is a multinomial logistic regression over the presence of word n-grams (one to
three words) of the templates, with a class for unknown text and a temperature fitted on examples kept
apart. It is trained on the driver from the fixed templates and altered copies of them, without a
row of the data. On the data everything is DataFrame expressions: paragraphs are cut into n-grams, joined with the
tables of weights and of templates, whose sizes the templates bound, and summed by paragraph.
A prediction counts if its probability is ``SURE`` or more and the paragraph covers a template of that
family, or a template most of the paragraph.

A paragraph is a line, or the lines between two blank ones, as texts are wrapped (reported where no line of it
tells the same). Most hold no n-gram of a template and are left out before that. The filter is no word list: it
follows from the shares that confirmation asks for. A template of four words or more can't be covered to ``COVERED``, nor
a paragraph of six words or more to ``NEAR``, without a common n-gram of three words; shorter ones need one of two words. So each
paragraph that could be confirmed passes; single words name no licence, and a text with one word a line isn't seen as a block.

Defined results: null and empty texts have no paragraph; a null doc_id is carried through; repeated
rows give repeated results; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import let, text_of

# Wording of public licences and of the notes that name them, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "SPDX-License-Identifier: MIT",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "SPDX-License-Identifier: Zlib",
    ),
    "bsl-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software.",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "agpl-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the MPL",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-nd": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "cc-by-nc-sa": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "cc-by-nc-nd": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    "cc0": (
        "Released under CC0 1.0 Universal, a public domain dedication.",
        "To the extent possible under law, the authors have waived all copyright and related or neighboring rights to this work under CC0.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "all-rights-reserved": ("All rights reserved.", "Copyright 2020 the authors. All rights reserved."),
}
# Texts that look like licences and are none.
UNKNOWN = (
    "The licence was issued by the city and must be renewed every year.",
    "He lost his driving license after the third offence.",
    "You need written permission to enter the building after hours.",
    "The copyright debate went on for several years in parliament.",
    "Hunting is permitted with a valid license only.",
    "All rights and duties are set out in the contract.",
    "The version of the report released in March was redistributed to members.",
    "Licensed premises must close at midnight under the new rules.",
    "Terms of use and privacy policy are found at the end of this page.",
    "The software comes with a warranty of two years.",
    "Licensed under terms that the seller will state on request.",
    "The commons were closed to the public for most of the creative season.",
    "The apache helicopter and its version two were shown at the fair.",
    "In no event will the match be played before the end of the month.",
    "The foundation published the terms of the agreement with the library.",
    "A copy of this file was sent to the authors with the following conditions.",
    "The general public was free to use the library without restriction.",
    "She had the right to use the name of the copyright holder in her book.",
    "The names of its contributors were read out without prior notice.",
    "Students at MIT built a source of light out of binary switches.",
)
WORDS = r"[^a-z0-9.+]+"
N_GRAM = 3
COVERED, NEAR, SURE = 0.8, 0.75, 0.5
UNKNOWN_CLASS = "unknown"


def words_of(text: str) -> list[str]:
    """As _words does it in Spark: lower-case ASCII letters, digits, inner points and pluses."""
    cut = (w.strip(".") for w in re.split(WORDS, text.lower()))
    return [w for w in cut if w]


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, N_GRAM + 1) for i in range(len(words) - n + 1)}


@dataclass(frozen=True)
class Classifier:
    classes: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    temperature: float

    def predict(self, text: str) -> tuple[str, float]:
        z = np.array(self.bias)
        for g in grams(words_of(text)):
            if g in self.weights:
                z = z + np.array(self.weights[g])
        p = np.exp((z - z.max()) / self.temperature)
        return self.classes[int(p.argmax())], float(p.max() / p.sum())


def _examples(seed: int, copies: int) -> list[tuple[set[str], int]]:
    """Grams and class of templates and altered copies: words left out, words of other texts around."""
    random = np.random.RandomState(seed)
    classes = [*TEMPLATES, UNKNOWN_CLASS]
    other = [words_of(t) for t in UNKNOWN]
    out = [(grams(words_of(t)), classes.index(f)) for f, ts in TEMPLATES.items() for t in ts]
    out += [(grams(w), len(classes) - 1) for w in other]
    for family, texts in TEMPLATES.items():
        for text in texts:
            for _ in range(copies):
                words = [w for w in words_of(text) if random.rand() > 0.06]
                before, after = (other[random.randint(len(other))][: random.randint(6)] for _ in "ab")
                out.append((grams([*before, *words, *after]), classes.index(family)))
            whole = words_of(text)
            for _ in range(copies if len(whole) > 3 else 0):  # a wrapped line, or a note without its beginning
                size = random.randint(min(6, len(whole) - 1), min(14, len(whole))) if len(whole) > 6 else len(whole) - 1
                start = random.randint(len(whole) - size + 1)
                piece = whole[start : start + size] if len(whole) > 6 else whole[random.randint(1, len(whole) - 2) :]
                out.append((grams(piece), classes.index(family)))
    for _ in range(copies * 12):
        a, b = (other[random.randint(len(other))] for _ in "ab")
        words = [w for w in [*a[random.randint(4) :], *b[: random.randint(8)]] if random.rand() > 0.1]
        out.append((grams(words), len(classes) - 1))
        texts = [t for ts in TEMPLATES.values() for t in ts]
        cut = words_of(texts[random.randint(len(texts))])
        out.append((grams(cut[: random.randint(1, 3)]), len(classes) - 1))  # a word or two name no licence
    return out


@lru_cache(maxsize=1)
def classifier() -> Classifier:
    classes = (*TEMPLATES, UNKNOWN_CLASS)
    train, apart = _examples(1, 12), _examples(2, 4)
    vocabulary = sorted(set().union(*(g for g, _ in train)))
    place = {g: i for i, g in enumerate(vocabulary)}

    def matrix(rows):
        x = np.zeros((len(rows), len(vocabulary) + 1), "f4")
        x[:, -1] = 1
        for r, (gs, _) in enumerate(rows):
            x[r, [place[g] for g in gs if g in place]] = 1
        return x, np.array([c for _, c in rows])

    def chances(z):
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    x, y = matrix(train)
    w = np.zeros((x.shape[1], len(classes)), "f4")
    want = np.eye(len(classes), dtype="f4")[y]
    for _ in range(250):
        w -= np.float32(0.05) * (x.T @ (chances(x @ w) - want) / np.float32(math.sqrt(len(y))) + np.float32(1e-3) * w)
    xa, ya = matrix(apart)
    loss = {t: -np.log(chances(xa @ w / t)[np.arange(len(ya)), ya] + 1e-12).mean() for t in np.linspace(0.3, 4, 38)}
    w = w.astype("f8")
    rows = {g: tuple(w[i].round(6).tolist()) for g, i in place.items()}
    return Classifier(classes, rows, tuple(w[-1].round(6).tolist()), float(min(loss, key=loss.get)))


def template_grams() -> list[tuple[str, str, str, int]]:
    """(gram, family, template, number of the template's grams)."""
    return [(g, f, f"{f}/{k}", len(gs)) for f, ts in TEMPLATES.items() for k, t in enumerate(ts) for gs in [grams(words_of(t))] for g in sorted(gs)]


@lru_cache(maxsize=1)
def telling() -> tuple[list[str], list[str], list[str]]:
    """N-grams of the templates, one of which each paragraph that can be confirmed holds: of three words, of two, and of two from templates of three."""
    cut = [words_of(t) for ts in TEMPLATES.values() for t in ts]
    of = lambda n, texts: sorted({" ".join(w[i : i + n]) for w in texts for i in range(len(w) - n + 1)})
    return of(3, cut), of(2, cut), of(2, [w for w in cut if len(w) < 4])


def may_tell(words: list[str]) -> bool:
    """The filter in plain Python, for tests."""
    three, two, short = (set(x) for x in telling())
    held = lambda n: {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}
    return bool(held(2) & two) if len(words) < 6 else bool(held(3) & three or held(2) & short)


def _words(text: Column) -> Column:
    cut = F.split(F.lower(text), WORDS)
    return F.filter(F.transform(cut, lambda w: F.trim(w, F.lit("."))), lambda w: w != "")


def _grams(words: Column, n: int) -> Column:
    cut = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]))
    return F.when(F.size(words) >= n, cut).otherwise(F.array().cast("array<string>"))


def _may_tell(line: Column) -> Column:
    """may_tell as a column. The places of words that begin a telling n-gram come first, so that few n-grams are made."""
    three, two, short = telling()
    begins = sorted({g.split(" ")[0] for g in (*three, *two)})

    def of(words: Column) -> Column:
        at = F.filter(F.transform(words, lambda w, i: F.when(w.isin(begins), i)), lambda i: i.isNotNull())
        gram = lambda i, n: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)])
        whole = lambda i, n: i + n <= F.size(words)
        long = F.exists(at, lambda i: (whole(i, 3) & gram(i, 3).isin(three)) | (whole(i, 2) & gram(i, 2).isin(short)))
        return F.when(F.size(words) < 6, F.exists(at, lambda i: whole(i, 2) & gram(i, 2).isin(two))).otherwise(long)

    return let(_words(line), of)


def _paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, row, paragraph (its first line's number), lines, block (the first line of the block around), text, copies: those that may name a licence."""
    text = text_of(docs)
    lines = F.split(text, "\n")
    rows = docs.select("doc_id", F.xxhash64(text).alias("row"), lines.alias("l")).filter(F.exists("l", _may_tell))
    rows = rows.groupBy("doc_id", "row", "l").agg(F.count("*").alias("copies"))
    full = lambda i: F.coalesce(F.get("l", i).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    starts = F.filter(F.sequence(F.lit(0), F.size("l") - 1), lambda i: full(i) & ~full(i - 1))
    apart = r"\n[\x20\x09\x0B-\x0D]*+\n[\x20\x09-\x0D]*+"  # a line's end, and blank lines up to the next word
    pieces = F.filter(F.split(F.concat(F.lit("\n\n"), F.array_join("l", "\n"), F.lit("\n\n")), apart), lambda x: x != "")
    rows = rows.withColumn("b", F.explode(F.arrays_zip(starts.alias("s"), pieces.alias("t"))))
    rows = rows.select("doc_id", "row", "copies", F.col("b.s").alias("block"), F.split("b.t", "\n").alias("own"))
    unit = lambda at, n, t: F.struct(at.alias("paragraph"), n.alias("lines"), t.alias("text"))
    tagged = F.transform("own", lambda t, i: F.struct(_may_tell(t).alias("tells"), unit(F.col("block") + i, F.lit(1), t).alias("u")))
    # A line that tells nothing is dropped inside one expression, which is evaluated once a block.
    rows = rows.select("doc_id", "row", "copies", "block", "own", F.filter(tagged, lambda x: x["tells"]).alias("single"))
    rows = rows.withColumn("single", F.explode(F.array("single"))).filter(F.size("single") > 0)
    whole = F.when(F.size("own") > 1, F.array(unit(F.col("block"), F.size("own"), F.array_join("own", "\n"))))
    units = F.concat(F.transform("single", lambda x: x["u"]), F.coalesce(whole, F.transform(F.slice("single", 1, 0), lambda x: x["u"])))
    return rows.select("doc_id", "row", "copies", "block", F.explode(units).alias("u")).select("doc_id", "row", "copies", "block", "u.*")


def licences(docs: DataFrame) -> DataFrame:
    """A row per paragraph that may name a licence: doc_id, row, paragraph, lines, family, probability, template, similarity.

    row tells rows with the same doc_id apart. family is ``unknown`` without a confirmed prediction; blocks
    of several lines come only with a family that none of their lines has.
    """
    model, spark = classifier(), docs.sparkSession
    at = ["doc_id", "row", "paragraph", "lines", "block", "copies"]
    # Words and n-grams are one expression: the optimizer copies filters below a projection, words and all.
    grams_of = let(_words(F.col("text")), lambda w: F.array_distinct(F.concat(*[_grams(w, n) for n in range(1, N_GRAM + 1)])))
    found = _paragraphs(docs).select(*at, grams_of.alias("g")).select(*at, F.size("g").alias("n"), F.explode_outer("g").alias("gram"))
    count = len(model.classes)
    weights = spark.createDataFrame([(g, list(w)) for g, w in model.weights.items()], "gram string, weights array<double>")
    templates = spark.createDataFrame(template_grams(), "gram string, family string, template string, size int")
    scored = found.join(F.broadcast(weights), "gram", "left").groupBy(*at).agg(  # as many rows as the templates have n-grams
        *[(F.coalesce(F.sum(F.get("weights", F.lit(k))), F.lit(0.0)) + model.bias[k]).alias(f"z{k}") for k in range(count)]
    )
    scaled = [(F.col(f"z{k}") / model.temperature) for k in range(count)]
    top = F.greatest(*scaled)
    total = sum((F.exp(z - top) for z in scaled[1:]), F.exp(scaled[0] - top))
    best = F.coalesce(*[F.when(z == top, F.lit(c)) for z, c in zip(scaled, model.classes, strict=True)])
    predicted = scored.select(*at, best.alias("predicted"), F.round(1 / total, 6).alias("probability"))
    shared = found.join(F.broadcast(templates), "gram").groupBy(*at, "family", "template", "size", "n").agg(F.count("*").alias("both"))
    covers, near = F.col("both") / F.col("size"), F.col("both") / F.col("n")
    close = shared.select(*at, "family", "template", F.round(F.greatest(covers, near), 6).alias("similarity"), ((covers >= COVERED) | (near >= NEAR)).alias("sure"))
    confirmed = close.filter("sure").groupBy(*at, F.col("family").alias("predicted")).agg(F.max(F.struct("similarity", "template")).alias("best"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"c.{c}")) for c in at] + [F.col("p.predicted") == F.col("c.predicted")]
    joined = predicted.alias("p").join(confirmed.alias("c"), same, "left").select(*[F.col(f"p.{c}") for c in (*at, "predicted", "probability")], "best")
    sure = F.col("best").isNotNull() & (F.col("probability") >= SURE) & (F.col("predicted") != UNKNOWN_CLASS)
    judged = joined.withColumn("family", F.when(sure, F.col("predicted")).otherwise(UNKNOWN_CLASS)).withColumn("best", F.when(sure, F.col("best")))
    by_line = F.max((F.col("lines") == 1) & sure).over(Window.partitionBy("doc_id", "row", "block", "family"))  # units of one block
    rows = judged.withColumn("by_line", by_line).filter("lines = 1 or family <> 'unknown' and not by_line")
    return rows.select(
        "doc_id", "row", "paragraph", "lines", "family", "probability", F.col("best.template").alias("template"),
        F.coalesce("best.similarity", F.lit(0.0)).alias("similarity"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    ).drop("copy")
