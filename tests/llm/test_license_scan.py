import re

import numpy as np
import pytest

from groundphrase.llm import license_scan as L

SCHEMA = "doc_id long, text string, line string, words int"
MIT = "\n\n".join(L.FAMILIES_OF["MIT"][2])


def classified(words):
    weights, bias, temperature = L.model()
    z = np.round(np.sum([weights[g] for g in L.grams(words) if g in weights] or [[0] * len(bias)], axis=0), 6) + bias
    p = np.exp((z - max(z)) / temperature)
    return L.FAMILIES[int(np.argmax(p))], 1 / p.sum()


def brute(rows):
    """All paragraphs by the model itself: no stem, nothing else, is asked for first."""
    out = []
    for doc, text, *_ in rows:
        for i, paragraph in enumerate(re.split(L.PARAGRAPH_END, text or "")):
            words = L.plain_words(paragraph)
            for j in range(max(0, (len(words) - 1 - L.SHARED) // L.PART) + 1):
                w = words[j * L.PART : (j + 1) * L.PART + L.SHARED]
                family, prob = classified(w)
                if family != L.UNKNOWN:
                    own = {" ".join(w[k : k + 2]) for k in range(max(1, len(w) - 1))}
                    sim, nth = max((round(len(own & set(ps)) / len(ps), 6), -i) for f, i, ps in L.templates() if f == family)
                    out.append((doc, i, j, family, round(prob, 4), -nth, round(sim, 4), prob >= L.LEAST_PROBABILITY and sim >= L.CONFIRM))
    return sorted(out, key=str)


def plain(df):
    return sorted(((r.doc_id, r.paragraph, r.part, r.family, round(r.probability, 4), r.template, round(r.similarity, 4), r.confirmed) for r in L.scan(df).collect()), key=str)


def test_against_brute_force_without_the_stems(spark):
    texts = [t for _, ts, bs in L.FAMILIES_OF.values() for t in (*ts, *bs)]
    rows = [(i, f"some prose. And more.\n{t}\n\nlast", None, 1) for i, t in enumerate(texts)]
    rows += [(500 + i, t, None, 1) for i, t in enumerate((*L.OTHERS, *L.CALIBRATION))]
    rows += [(100, None, None, 1), (None, "Released under the MIT License. It rains.", None, 1), (102, "", None, 1), (103, "mit der und von. Mit uns. MIT", None, 1), (104, "the license plate of an apache helicopter in the city", None, 1), (104, "Released under the MIT License.", None, 1), (104, "Released under the MIT License.", None, 1), (105, "word. " * 50_000 + "Licensed under CC BY-NC 4.0.", None, 1), (106, MIT + "\r\n\r\n" + MIT.upper(), None, 1), (107, "ſoftware licenſe MİT License K GPL", None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = plain(df)
    assert got == brute(rows) and sum(x[-1] for x in got) >= 60
    assert L.scan(df.limit(0)).count() == 0
    assert {r.family for r in L.scan(df, unknown=True).collect()} == set(L.FAMILIES)


def test_no_stem_means_unknown():
    weights, bias, _ = L.model()
    assert all(max(w[:-1]) <= w[-1] for g, w in weights.items() if not any(s in g for s in L.STEMS))
    assert max(bias[:-1]) < bias[-1] - 0.01


def test_every_notice_and_body_is_confirmed(spark):
    want = {t: f for f, (_, ts, bs) in L.FAMILIES_OF.items() for t in (*ts, *bs)}
    df = spark.createDataFrame([(i, t, None, 1) for i, t in enumerate(want)], SCHEMA)
    got = {r.doc_id: r.family for r in L.scan(df).collect() if r.confirmed}
    assert [got.get(i) for i in range(len(want))] == [*want.values()]


def test_wrapped_notices_stay_whole(spark):
    text = "x = 1\n\n// Licensed under the Apache\n// License, Version 2.0 (the License); you may\n// not use this file except in compliance with the License.\n\ny"
    got = L.scan(spark.createDataFrame([(1, text, None, 1)], SCHEMA)).collect()
    assert [(r.paragraph, r.family, r.confirmed) for r in got] == [(1, "Apache-2.0", True)] and got[0].similarity > 0.95


@pytest.mark.parametrize("text", ["Released under the Eclipse Public License 2.0.", "SPDX-License-Identifier: CDDL-1.0", "Distributed under the Open Software License 3.0.", "Licensed under the Microsoft Public License.", "This Source Code Form is subject to the terms of the Common Development and Distribution License, v. 1.0.", "Licensed under the Server Side Public License, version 1."])
def test_families_that_nothing_was_fitted_on_are_unknown(text):
    assert classified(L.plain_words(text))[0] == L.UNKNOWN


def test_held_out_wordings():
    weights, bias, _ = L.model()
    x, y = L.training_rows(10, seed=77)
    z = [np.sum([weights[g] for g in xs if g in weights] or [[0] * len(bias)], axis=0) + bias for xs in x]
    assert np.mean(np.argmax(z, 1) == np.array(y)) > 0.95


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r.doc_id, r.family) for r in L.op2_licenses(spark, "/root/testdata/sf0.01").collect() if r.confirmed}
    names = {"GNU General Public License, version 3": "GPL-3.0", "CC BY-NC": "CC-BY-NC", "MIT License": "MIT", "Apache License": "Apache-2.0", "All rights reserved": "Proprietary"}
    lines = [(r.doc_id, x) for r in docs.collect() for x in r.text.split("\n") if re.match("(This work is licensed|Licensed|Released) under|All rights reserved.$", x)]
    want = {(i, f) for i, x in lines for n, f in names.items() if n in x}
    assert want and got == want


def test_no_python_on_the_path(spark, capsys):
    L.op2_licenses(spark, "/root/testdata/sf0.001").explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


@pytest.mark.parametrize("text,words", [("A-b, C3 é", ["a", "b", "c3"]), ("", [])])
def test_words(text, words):
    assert L.plain_words(text) == words
