"""Places of words and phrases: the map of normalization, finding and hiding surfaces, containment both ways."""

import unicodedata

import numpy as np
from pyspark.sql import functions as F

from groundphrase.functions import offsets
from groundphrase.functions import text as tx
from groundphrase.operators import mentions as mn

TEXTS = ["", None, "  a  b ", "آب‌از  سرِش گذشت!", "élève É", "ـ ـ", "x" * 5000 + " ​ y", "١٢٣ ۴۵", "«quoted», (text).", "́mark first", "İstanbul ß", "a b\tc\n\nd"]


def test_map_of_normalization(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "id int, text string, tokens string")
    got = {r.id: r for r in offsets.intake(df).withColumn("plain", F.coalesce(tx.retrieval(F.col("text"), compose=True), F.lit(""))).collect()}
    for i, t in enumerate(TEXTS):
        r, raw = got[i], t or ""
        if "İ" not in raw:  # its small form holds a mark that only one of the two drops
            assert r.normalized == r.plain, raw
        assert len(r.starts) == len(r.ends) == len(r.normalized) and r.compact == r.normalized.replace(" ", "")
        for x in r.tokens:
            assert raw[x.raw_start : x.raw_end] == x.text and r.normalized[x.start : x.end] == x.normalized
            again = unicodedata.normalize("NFC", x.text)
            assert x.normalized[0] in again.lower() or x.normalized[0].isdigit() or x.normalized[0] in "ایک"
        assert " ".join(x.normalized for x in r.tokens) == r.normalized


def test_raw_span(spark):
    df = offsets.intake(spark.createDataFrame([("  Ab,  c!",)], "text string"))
    at = lambda a, b: df.select(offsets.raw_span(F.col("starts"), F.col("ends"), F.lit(a), F.lit(b)).alias("s")).first().s
    assert tuple(at(0, 2)) == (2, 4) and tuple(at(3, 4)) == (7, 8) and tuple(at(0, 4)) == (2, 8) and tuple(at(4, 4)) == (8, 8) and tuple(at(0, 0)) == (2, 2) and tuple(at(2, 3)) == (4, 7)


def one_after_the_other(text, surfaces, mark):
    for s in sorted(surfaces, key=lambda s: (-len(s), s)):
        text = text.replace(s, mark)
    return text


def test_hiding_all_surfaces(spark):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("ab "), n))
    surfaces = sorted({s for s in (word(int(n)).strip() for n in rng.integers(4, 9, 30)) if len(s) >= 4})
    texts = [(i, word(int(n))) for i, n in enumerate(rng.integers(0, 60, 150))] + [(999, None)]
    v = spark.createDataFrame([(s,) for s in surfaces], "text string")
    t = spark.createDataFrame(texts, "id int, text string")
    for dictionary in (1 << 20, 0):  # by an automaton, and by a join
        got = {r.id: r.text for r in mn.redact(t, mn.surfaces(v), "id", mark="[x]", dictionary=dictionary).collect()}
        assert got == {i: None if x is None else one_after_the_other(x, surfaces, "[x]") for i, x in texts}
        leaks = {(r.id, r.surface): r.n for r in mn.leaks(t, mn.surfaces(v), "id", dictionary=dictionary).collect()}
        assert leaks == {(i, s): n for i, x in texts if x for s in surfaces if (n := sum(x.startswith(s, k) for k in range(len(x))))}


def test_either_inside(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abc"), int(rng.integers(0, 7))))
    a, b = [(i, word()) for i in range(60)] + [(61, None)], [(i, word()) for i in range(50)]
    got = mn.either_inside(spark.createDataFrame(a, "p int, text string"), spark.createDataFrame(b, "q int, text string"), "p", "q").collect()
    assert sorted(map(tuple, got)) == sorted((i, j, x in y, y in x) for i, x in a for j, y in b if x and y and (x in y or y in x))
    none = spark.createDataFrame([], "p int, text string")
    assert mn.either_inside(none, spark.createDataFrame(b, "q int, text string"), "p", "q").count() == 0


def test_mentions_in_raw_places(spark):
    t = spark.createDataFrame([(1, "He said: «آبِ  از سَر» and آب از سرد."), (2, "آب از سر، آب از سر"), (3, None)], "id int, text string")
    v = spark.createDataFrame([(7, "f1", "آب از سر"), (8, "f2", "said")], "doc_id int, family_id string, text string")
    for dictionary in (1 << 20, 0):  # by an automaton, and by a join
        rows = mn.mentions(t, v, "id", dictionary=dictionary).collect()
        assert sorted((r.id, r.doc_id, r.raw) for r in rows) == [(1, 7, "آبِ  از سَر"), (1, 8, "said"), (2, 7, "آب از سر"), (2, 7, "آب از سر")]
        assert sorted((r.id, r.start, r.end, r.raw_start, r.raw_end) for r in rows if r.id == 2) == [(2, 0, 8, 0, 8), (2, 9, 17, 10, 18)]
