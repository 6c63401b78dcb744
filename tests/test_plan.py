import pytest
from pyspark.sql import functions as F

from groundphrase.functions import cues, stems
from groundphrase.operators import plan, restore


def column(spark, texts, f):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.x for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def test_stems(spark):
    got = column(spark, ["زبون", "کتابشان", "نمیشه", "می‌روند", "دستش", "گفتم", "خودش", "گرفته"], lambda c: F.get(F.transform(F.array(F.replace(c, F.lit("‌"))), stems.stem), F.lit(0)))
    assert got == ["زبان", "کتاب", "شدن", "روند", "دست", "گفتن", "خود", "گرفتن"]
    assert column(spark, ["زبون را گفتم a", "", "و که از"], stems.signature) == [["زبان"], [], []]


def test_single_anchor_restores(spark):
    v = spark.createDataFrame([(0, "f1", "کلاغ سفید پرواز"), (1, "f2", "باران بهار سبزه")], "doc_id long, family_id string, text string")
    q = spark.createDataFrame([("a", "کلاغ"), ("b", "باران بهار"), ("c", "هیچ")], "query_id string, text string")
    got = {r.query_id: r for r in restore.base_restore(q, v).collect()}
    assert got["a"].score == 0.94 and got["a"].accepted and got["a"].family_id == "f1"
    assert not got["b"].accepted and "c" not in got


def test_prefix_completion(spark):
    v = spark.createDataFrame([(0, "f1", "abe bce cde def efg fgh ghi"), (1, "f2", "abe bce cde def xyz yzx zxy"), (2, "f3", "one two three four five six seven")], "doc_id long, family_id string, text string")
    q = spark.createDataFrame([("a", "abe bce cde def"), ("b", "one two three four"), ("c", "one two three"), ("d", "one two three four five")], "query_id string, text string")
    got = {r.query_id: (r.family_id, r.reason.split("-")[0]) for r in restore.complete_prefix(q, v, restore.long_tokens).collect()}
    assert got == {"a": (None, "ambiguous"), "b": ("f3", "explicit")}


def test_render_and_leaks(spark):
    one = lambda *row: spark.createDataFrame([row], "t string, s array<string>")
    assert one("say [[1]] and [[2]].", ["x y", "z"]).select(plan.render(F.col("t"), F.col("s")).alias("x")).first().x == "say x y and z."
    with pytest.raises(Exception, match="slots don't match"):
        one("say [[1]].", ["x", "z"]).select(plan.render(F.col("t"), F.col("s"))).collect()
    surfaces = F.array(F.lit("good day"), F.lit("bad day"))
    assert column(spark, ["A good day, not a bad day!", "agood day"], lambda c: plan.leaked(c, surfaces, F.array(F.lit("good day")))) == [["bad day"], []]


def test_views_keep_order_and_drop_repeats(spark):
    df = spark.createDataFrame([("f1", "g", "c", ["k", "l"], ["situation: g", "s2"], None, [""])], "family_id string, gloss string, canonical string, keywords array<string>, scenarios array<string>, paraphrases array<string>, usage_notes array<string>")
    got = [(r.view, r.text) for r in plan.views(df).orderBy("n").collect()]
    assert got == [("gloss", "g"), ("scenario-from-gloss", "situation: g"), ("canonical-plus-gloss", "phrase: c\ng"), ("reviewed-keywords", "k, l"), ("reviewed-scenario-2", "s2")]


def test_suitability(spark):
    df = spark.createDataFrame([("گه خورد", "یک مثل"), ("گه خورد", "یک مثل خیلی عامیانه"), ("نان و نمک", "مثل")], "p string, r string")
    assert [r.x for r in df.select(cues.unsuitable(F.col("p"), F.col("r")).alias("x")).collect()] == [True, False, False]
