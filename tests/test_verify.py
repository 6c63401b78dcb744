from pyspark.sql import functions as F

from groundphrase.functions import text as tx
from groundphrase.operators import engine, verify


def test_payload(spark):
    rows = {'{"verdict": "SUPPORTED", "reason": "x"}': ("SUPPORTED", "x", None), '{"verdict": "UNCERTAIN"}': ("UNCERTAIN", "", None), None: (None, None, "no answer"), "": (None, None, "invalid JSON"), "[]": (None, None, "not an object"), "{}": (None, None, "no verdict"), '{"verdict": 1}': (None, None, "unknown verdict"), '{"verdict": null}': (None, None, "unknown verdict"), '{"b": 1, "a": 2, "verdict": "SUPPORTED"}': (None, None, "forbidden a,b")}
    df = spark.createDataFrame([(k,) for k in rows], "c string").select("c", verify.payload(F.col("c")).alias("p"))
    assert {r.c: tuple(r.p) for r in df.collect()} == rows


def test_unsuitable_pairs_are_never_asked(spark):
    pairs = spark.createDataFrame([("q", "f1", "یه مثل بگو", "حرف گه زدن", "g"), ("q", "f2", "یه مثل بگو", "حرف زدن", "g"), ("r", "f1", "یه مثل رکیک بگو", "حرف گه زدن", "g"), ("s", "f1", None, None, None)], "query_id string, family_id string, text string, phrase string, gloss string")
    asked = []

    def verifier(df):
        assert "phrase" not in df.columns
        asked.extend((r.query_id, r.family_id) for r in df.collect())
        return df.where("query_id <> 's'").selectExpr("query_id", "family_id", """'{"verdict": "SUPPORTED"}' as content""")

    got = {(r.query_id, r.family_id): (r.verdict, r.verifier_id, r.reason) for r in verify.verify(pairs, verifier, "v").collect()}
    assert got == {("q", "f1"): ("NOT_SUPPORTED", "v+recommendation-policy", "unsuitable-register"), ("q", "f2"): ("SUPPORTED", "v", ""), ("r", "f1"): ("SUPPORTED", "v", ""), ("s", "f1"): ("UNCERTAIN", "v", "verifier-error:no answer")}
    assert ("q", "f1") not in asked and len(asked) == 3


def test_alternatives_and_wrappers(spark):
    c = spark.createDataFrame([(1, "b", 5), (1, "a", 5), (1, "c", 1), (1, "d", 9), (2, "a", 1)], "query_id int, family_id string, first_pos int")
    assert [tuple(r) for r in verify.alternatives(c).collect()] == [(1, 4, ["c", "a", "b"])]
    q = spark.createDataFrame([(1, "یادم رفته «آب از سر گذشت» چی بود"), (2, "یادم رفته «آب» یا «آب از سر گذشت»"), (3, "«آب از سر گذشت» یا «نوش دارو» چی بود"), (4, "«آب از سر گذشت»"), (5, None)], "query_id int, text string")
    assert {r.query_id: r.text for r in engine.unwrapped(q).collect()} == {1: "آب از سر گذشت", 2: "آب از سر گذشت", 3: "«آب از سر گذشت» یا «نوش دارو» چی بود", 4: "«آب از سر گذشت»", 5: None}
    assert spark.range(1).select(tx.single_quoted(F.lit('say "abc" and "abcdefg"'), "say", 6)).first()[0] == "abcdefg"
