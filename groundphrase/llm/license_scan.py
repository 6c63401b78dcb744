"""License scans: a trained paragraph classifier, confirmed by templates. DataFrame functions only.

A paragraph ends at a blank line, or at a line's end after a full stop; other line ends are spaces, so wrapped
notices stay whole. Word n-grams of notices and licence bodies train a sparse logistic regression over licence
families and an unknown class. Unknown is learned from prose, from licences of other families and from known
notices whose names are replaced; a temperature and a bias of the unknown class are then calibrated on wordings
and on families that training has not seen. Training runs on the driver over fixed tables and is no part of the data's path.

Only n-grams that hold one of STEMS may speak for a family against unknown (training projects all other weights),
so a paragraph without a stem is unknown whatever else it holds: leaving such paragraphs out loses nothing. The
others are classified by a broadcast join on n-grams (the vocabulary is that of the notices, so its size is
fixed) and compared with the templates of the predicted family.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundphrase.llm.common import stored, table

#: Notices of each family, after the words that name it there, and paragraphs of its text (fixed values).
FAMILIES_OF = {
    "MIT": (("mit",), (
        "Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the terms of the MIT license.", "Distributed under the MIT License, see LICENSE for details.", "SPDX-License-Identifier: MIT", "The MIT License (MIT)",
    ), (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    )),
    "Apache-2.0": (("apache",), (
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ), (
        "you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    )),
    "GPL-2.0": (("gpl", "gnu"), (
        "This work is licensed under the GNU General Public License, version 2.", "Released under the GPL version 2.", "SPDX-License-Identifier: GPL-2.0-only", "You may redistribute this program under the terms of the GNU General Public License version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ), ()),
    "GPL-3.0": (("gpl", "gnu"), (
        "This work is licensed under the GNU General Public License, version 3.", "Released under the GPL version 3.", "Licensed under the GNU GPL v3.", "SPDX-License-Identifier: GPL-3.0-or-later", "You may redistribute this program under the terms of the GNU General Public License version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ), ()),
    "LGPL": (("lgpl", "lesser", "gnu"), (
        "Licensed under the GNU Lesser General Public License, version 2.1.", "Released under the LGPL version 3.", "SPDX-License-Identifier: LGPL-2.1-only",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ), ()),
    "AGPL-3.0": (("agpl", "affero", "gnu"), (
        "Licensed under the GNU Affero General Public License, version 3.", "Released under the AGPL version 3.", "SPDX-License-Identifier: AGPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ), ()),
    "BSD": (("bsd",), (
        "Released under the BSD License.", "Licensed under the 3-clause BSD license.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause",
    ), (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    )),
    "MPL-2.0": (("mpl", "mozilla"), (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Released under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0",
    ), ()),
    "ISC": (("isc",), (
        "Released under the ISC License.", "Licensed under the ISC license.", "SPDX-License-Identifier: ISC",
    ), (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    )),
    "CC-BY": (("cc", "creative", "commons", "attribution"), (
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0",
    ), ()),
    "CC-BY-SA": (("cc", "creative", "commons", "attribution"), (
        "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0",
    ), ()),
    "CC-BY-NC": (("cc", "creative", "commons", "attribution"), (
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0",
    ), ()),
    "CC0": (("cc0",), (
        "Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright under CC0.", "SPDX-License-Identifier: CC0-1.0",
    ), ()),
    "Proprietary": (("reserved", "proprietary"), (
        "All rights reserved.", "Copyright 2020 Example. All rights reserved.", "This software is proprietary and confidential.",
    ), ()),
}
#: Notices of other families (fixed values): unknown in training, and unknown in calibration.
OTHERS = (
    "Released under the Artistic License 2.0.", "Licensed under the zlib license.", "Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: BSL-1.0", "This work is licensed under the Academic Free License, version 3.0.",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "The plate of the car was out of date and the driver had no license.", "You need the written permission of your parents to take part.", "The copyright of the photographs belongs to the museum.", "The warranty covers parts and labour for two years.", "She got her pilot license in spring.", "The table was reserved for eight.",
)
CALIBRATION = (
    "Licensed under the European Union Public Licence, version 1.2.", "Released under the SIL Open Font License 1.1.", "SPDX-License-Identifier: EUPL-1.2", "SPDX-License-Identifier: OFL-1.1", "This font software is licensed under the SIL Open Font License, Version 1.1.",
    "Permission is hereby granted by the council to hold the market in the square.", "The shop has a license to sell wine and the guests had reserved all rooms.", "The makers give no warranty and take no liability for damages.",
)
UNKNOWN = "unknown"
FAMILIES = (*FAMILIES_OF, UNKNOWN)
#: A paragraph without any of these, in small letters, is unknown; n-grams without them never speak for a family.
STEMS = ("licen", "copyright", "permission", "redistribut", "warrant", "reserved", "proprietary", "spdx", "gpl", "cc0", "gnu", "affero", "apache", "mozilla", "commons", "bsd")
#: N-grams, and how much of a template's word pairs a paragraph must hold to confirm a prediction.
GRAMS, CONFIRM, LEAST_PROBABILITY = (1, 2, 3), 0.6, 0.5
PARAGRAPH_END = r"\n[ \t\r]*\n\s*|(?<=[.!?])[ \t\r]*\n"
#: Longer paragraphs are read in parts of so many words, each with so many of the next one.
PART, SHARED = 1000, 200
#: The least distance by which unknown leads where nothing is said.
LEAD = 0.05


def plain_words(text: str) -> list[str]:
    """ASCII letters and digits in small letters; all else parts words."""
    return "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in text).split()


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in GRAMS for i in range(len(words) - n + 1)}


def training_rows(each: int = 24, seed: int = 11, others: tuple = OTHERS) -> tuple[list[set[str]], list[int]]:
    """Notices and bodies in many wordings, the notices with other names (unknown), and paragraphs that are none; at
    most `each` for a text."""
    rng = random.Random(seed)
    filler = "the a this that project file code text note see for more of and in is about we use it was with over year city plate driver book page company letter study rain field public school general version work term source".split()
    every = sorted({w for _, ts, bs in FAMILIES_OF.values() for t in (*ts, *bs) for w in plain_words(t)})
    lead = ["", "", "", "Copyright 2021 Someone.", "Note:", "Notice -", "This file is", "The text below is"]
    name = lambda: "".join(rng.choices("bcdfghklmnprstvz", k=1) + rng.choices("aeiou", k=1) + rng.choices("bcdfghklmnprstvz", k=3))
    x, y = [], []

    def vary(t: str, k: int, i: int, names: tuple = ()) -> None:
        w = plain_words(rng.choice(lead) + " " + t if i else t)
        if names:
            w = [name() if v in names else v for v in w]
        for _ in range(len(w) // 12 + 1 if i else 0):
            if len(w) > 5 and rng.random() < 0.3:
                v = rng.randrange(len(w))
                if w[v] not in FAMILIES_OF.get(FAMILIES[k], ((),))[0]:
                    del w[v]
        if i and rng.random() < 0.4:
            w += rng.choices(filler, k=rng.randint(1, 8))
        x.append(grams(w))
        y.append(k)

    for k, (names, notices, bodies) in enumerate(FAMILIES_OF.values()):
        for t in (*notices, *bodies):
            for i in range(each):
                vary(t, k, i)
        for t in notices:
            for i in range(each):
                vary(t, len(FAMILIES) - 1, i, names)
    for t in others:
        for i in range(each):
            vary(t, len(FAMILIES) - 1, i)
    for _ in range(each * 40):
        w = rng.choices(filler, k=rng.randint(3, 25)) + rng.choices(every, k=rng.randint(0, 6))
        rng.shuffle(w)
        x.append(grams(w))
        y.append(len(FAMILIES) - 1)
    return x, y


class _Rows:
    """Sparse rows of n-gram sets, for sums over rows and over n-grams."""

    def __init__(self, x: list[set[str]], index: dict[str, int]):
        at = [[index[g] for g in xs if g in index] for xs in x]
        self.row, self.col = np.repeat(np.arange(len(x)), [*map(len, at)]), np.array([i for a in at for i in a], np.int64)
        self.n, self.by_col = len(x), np.argsort(self.col, kind="stable")
        self.cols, self.starts = np.unique(self.col[self.by_col], return_index=True)

    def logits(self, w: np.ndarray) -> np.ndarray:
        """Sums of the weights of each row's n-grams."""
        total = np.concatenate([np.zeros((1, w.shape[1])), np.cumsum(w[self.col], axis=0)])
        ends = np.searchsorted(self.row, np.arange(self.n + 1))
        return total[ends[1:]] - total[ends[:-1]]

    def gradient(self, e: np.ndarray, size: int) -> np.ndarray:
        g = np.zeros((size, e.shape[1]))
        g[self.cols] = np.add.reduceat(e[self.row[self.by_col]], self.starts, axis=0)
        return g


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


@lru_cache(1)
def model() -> tuple[dict[str, list[float]], list[float], float]:
    """Weights of each n-gram for each family, the families' biases, and the temperature."""
    x, y = training_rows()
    vocabulary = sorted({g for _, ts, bs in FAMILIES_OF.values() for t in (*ts, *bs) for g in grams(plain_words(t))} | {w for xs in x for w in xs if " " not in w})
    index, k = {g: i for i, g in enumerate(vocabulary)}, len(FAMILIES)
    rows, target = _Rows(x, index), np.eye(k)[y]
    mute = np.array([not any(s in g for s in STEMS) for g in vocabulary])
    w, b = np.zeros((len(index), k)), np.r_[np.full(k - 1, -LEAD), 0.0]
    m, v = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
    for t in range(1, 401):
        e = (_softmax(rows.logits(w) + b) - target) / rows.n
        for i, (p, g) in enumerate(((w, rows.gradient(e, len(index)) + 2e-5 * w), (b, e.sum(0)))):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            p -= 0.05 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
        w[mute, :-1] = np.minimum(w[mute, :-1], w[mute, -1:])
        b[:-1] = np.minimum(b[:-1], b[-1] - LEAD)
    # Wordings of another seed and families that training has not seen set the temperature and the unknown bias.
    x, y = training_rows(6, seed=12, others=CALIBRATION * 3)
    z, y = _Rows(x, index).logits(w) + b, np.array(y)
    loss = lambda s, u: float(-np.log(np.maximum(_softmax((z + np.r_[np.zeros(k - 1), u]) / s)[np.arange(len(y)), y], 1e-12)).mean())
    _, temperature, extra = min((loss(s, u), s, u) for s in (0.25 * i for i in range(1, 17)) for u in (0.25 * i for i in range(13)))
    b[-1] += extra
    return {g: [round(float(a), 6) for a in w[i]] for g, i in index.items()}, [round(float(a), 6) for a in b], temperature


@lru_cache(1)
def templates() -> list[tuple[str, int, list[str]]]:
    """(family, number, word pairs) of each notice and paragraph of a licence."""
    return [(f, i, sorted({" ".join(w[j : j + 2]) for j in range(max(1, len(w) - 1))})) for f, (_, ts, bs) in FAMILIES_OF.items() for i, w in enumerate(map(plain_words, (*ts, *bs)))]


def _stemmed(c):
    """Column: one of STEMS is there."""
    out = F.lit(False)
    for s in STEMS:
        out = out | F.lower(c).contains(s)
    return out


def candidates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, doc_id, paragraph, part, words) of all paragraphs that hold a stem."""
    text = F.col(text).cast("string")
    rows = df.where(_stemmed(text)).select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, PARAGRAPH_END)).alias("paragraph", "x")).where(_stemmed(F.col("x")))
    words = F.filter(F.split(F.lower(F.regexp_replace("x", "[^A-Za-z0-9]+", " ")), " "), lambda w: w != "")
    rows = rows.select("doc_id", "paragraph", words.alias("w"))
    rows = rows.select("doc_id", "paragraph", "w", F.explode(F.sequence(F.lit(0), F.greatest((F.size("w") - 1 - SHARED) / PART, F.lit(0)).cast("int"))).alias("part"))
    return rows.select(F.monotonically_increasing_id().alias("key"), "doc_id", "paragraph", "part", F.slice("w", F.col("part") * PART + 1, PART + SHARED).alias("words"))


def runs(n: int):
    """Column: the n-grams of `words`."""
    return F.expr(f"transform(sequence(0, greatest(size(words) - {n}, 0)), i -> array_join(slice(words, i + 1, {n}), ' '))")


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", unknown: bool = False) -> DataFrame:
    """A row for each paragraph that the classifier gives a family: doc_id, paragraph and part (numbers from 0; part
    counts windows of a paragraph of over PART words), family, probability, template, similarity (share of
    the template's word pairs that it holds) and confirmed.

    confirmed: the calibrated probability is LEAST_PROBABILITY or more, and a template of the family is held to
    CONFIRM or more. unknown: also the unknown paragraphs that hold a stem. Null and empty texts have no rows; null
    ids and repeated rows are scanned like any other; of equally similar templates the first is given; other columns aren't carried.
    """
    spark = df.sparkSession
    weights, bias, temperature = model()
    found, _ = stored(candidates(df, doc_id, text), "licenses")
    # Fixed tables, as large as the notices make them.
    vocabulary = F.broadcast(spark.createDataFrame([(g, *w) for g, w in weights.items()], "gram string, " + ", ".join(f"w{k} double" for k in range(len(FAMILIES)))))
    pairs = F.broadcast(spark.createDataFrame(templates(), "family string, template int, pairs array<string>"))
    each = found.select("key", F.explode(F.array_distinct(F.concat(*(F.when(F.size("words") >= n, runs(n)).otherwise(F.array().cast("array<string>")) for n in GRAMS)))).alias("gram"))
    sums = each.join(vocabulary, "gram").groupBy("key").agg(*(F.round(F.sum(f"w{k}"), 6).alias(f"w{k}") for k in range(len(FAMILIES))))
    logits = found.join(sums, "key", "left").withColumn("z", F.array(*((F.coalesce(f"w{k}", F.lit(0.0)) + b) / temperature for k, b in enumerate(bias))))
    logits = logits.select("key", "doc_id", "paragraph", "part", "words", "z", F.array_max("z").alias("top"))
    best = logits.withColumn("family", F.element_at(F.array(*map(F.lit, FAMILIES)), F.array_position("z", F.col("top")).cast("int")))
    best = best.withColumn("probability", F.round(F.expr("1 / aggregate(transform(z, v -> exp(v - top)), 0D, (a, v) -> a + v)"), 6))
    best = best if unknown else best.where(F.col("family") != UNKNOWN)
    compared = best.join(pairs, "family", "left").withColumn("own", F.when(F.size("words") > 1, runs(2)).otherwise(F.col("words")))
    compared = compared.withColumn("similarity", F.round(F.size(F.array_intersect("pairs", "own")) / F.size("pairs"), 6))
    top = compared.groupBy("key").agg(F.max_by(F.struct("doc_id", "paragraph", "part", "family", "probability", "template", "similarity"), F.struct(F.coalesce("similarity", F.lit(-1.0)), -F.coalesce("template", F.lit(0)))).alias("b"))
    confirmed = F.coalesce((F.col("b.family") != UNKNOWN) & (F.col("b.probability") >= LEAST_PROBABILITY) & (F.col("b.similarity") >= CONFIRM), F.lit(False))
    return top.select("b.doc_id", "b.paragraph", "b.part", "b.family", "b.probability", "b.template", "b.similarity", confirmed.alias("confirmed"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph of every document that is of a known licence family; see scan for nulls, ties and repeats."""
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op2_licenses": op2_licenses}
ORACLE_SQL: dict[str, str] = {}
