"""Staged verification of meaning candidates, and wordings that never quote what was not accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidates that each stage verifies, the window of agreement between views, and the ledger's length.
RAW, HINT, CROSS, CROSS_WINDOW, LEDGER = 2, 2, 1, 8, 20


def ledger(raw: DataFrame, hint: DataFrame, verdicts: DataFrame, raw_n: int = RAW, hint_n: int = HINT, cross_n: int = CROSS, window: int = CROSS_WINDOW, size: int = LEDGER) -> DataFrame:
    """(query_id, rank, family_id, phase, verdict): candidates in the order in which they are looked at.

    raw and hint are rankings (query_id, family_id, rank), each family once; verdicts (query_id, family_id,
    verdict) answer for any pair, and a missing one is UNCERTAIN. The first raw_n of raw are verified until one
    is supported; if none is, hint_n new families of hint; if none is, cross_n families that both views rank
    within the window. What follows is kept unverified (verdict null), raw before hint.
    """
    both = raw.select("query_id", "family_id", F.col("rank").alias("raw_rank")).join(hint.select("query_id", "family_id", F.col("rank").alias("hint_rank")), ["query_id", "family_id"], "full_outer")
    c = both.join(verdicts, ["query_id", "family_id"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("UNCERTAIN")))
    q = Window.partitionBy("query_id")
    ok = F.col("verdict") == "SUPPORTED"
    # Stage one takes all its candidates, verified or not; one support among them ends the search.
    c = c.withColumn("one", F.coalesce(F.col("raw_rank") <= raw_n, F.lit(False)))
    c = c.withColumn("done1", F.max((F.col("one") & ok).cast("int")).over(q) == 1)
    # Stage two: the next families of hint.
    late = ~F.col("one") & F.col("hint_rank").isNotNull()
    c = c.withColumn("nth2", F.when(late, F.row_number().over(Window.partitionBy("query_id", late).orderBy("hint_rank"))))
    two = ~F.col("done1") & (F.col("nth2") <= hint_n)
    first2 = F.min(F.when(two & ok, F.col("nth2"))).over(q)
    c = c.withColumn("two", F.coalesce(two & (F.col("nth2") <= F.coalesce(first2, F.col("nth2"))), F.lit(False)))
    c = c.withColumn("done2", F.col("done1") | (F.max((F.col("two") & ok).cast("int")).over(q) == 1))
    # Stage three: families that both views hold near the top.
    agree = ~F.col("one") & ~F.col("two") & (F.col("raw_rank") <= window) & (F.col("hint_rank") <= window)
    c = c.withColumn("agree", F.coalesce(agree, F.lit(False)))
    c = c.withColumn("nth3", F.when(F.col("agree"), F.row_number().over(Window.partitionBy("query_id", "agree").orderBy(F.col("raw_rank") + F.col("hint_rank"), "raw_rank", "hint_rank"))))
    three = ~F.col("done2") & (F.col("nth3") <= cross_n)
    first3 = F.min(F.when(three & ok, F.col("nth3"))).over(q)
    c = c.withColumn("three", F.coalesce(three & (F.col("nth3") <= F.coalesce(first3, F.col("nth3"))), F.lit(False)))
    phase = F.when(F.col("one"), "raw-primary").when(F.col("two"), "semantic-hint-rescue").when(F.col("three"), "cross-view-consensus-rescue").when(F.col("raw_rank").isNotNull(), "raw-unverified-tail").otherwise("hint-unverified-tail")
    stage = F.when(F.col("one"), 1).when(F.col("two"), 2).when(F.col("three"), 3).when(F.col("raw_rank").isNotNull(), 4).otherwise(5)
    turn = F.when(stage == 2, F.col("nth2").cast("long")).when(stage == 3, F.col("nth3").cast("long")).when(stage == 5, F.col("hint_rank")).otherwise(F.col("raw_rank"))
    c = c.withColumn("phase", phase).withColumn("rank", F.row_number().over(q.orderBy(stage, turn)).cast("long")).where(F.col("rank") <= size)
    first1 = F.min(F.when(F.col("one") & ok, F.col("raw_rank"))).over(q)
    seen = F.col("two") | F.col("three") | (F.col("one") & (F.col("raw_rank") <= F.coalesce(first1, F.col("raw_rank"))))
    return c.withColumn("verdict", F.when(seen, F.col("verdict"))).select("query_id", "rank", "family_id", "phase", "verdict")


def window_is_specific(n_window: Column, n_candidate: Column, token_support: Column, char_support: Column) -> Column:
    """Three tokens or more, or two that a short candidate holds entirely."""
    return (n_window >= 3) | ((n_window == 2) & (n_candidate <= 3) & (token_support >= 1.0) & (char_support >= 0.95))


def wrapped(start: Column, end: Column, text: Column, n_query: Column, n_candidate: Column, n_window: Column, n_after: Column) -> Column:
    """A window stands inside other words, so that accepting it is not accepting the whole request."""
    before, after = F.trim(F.substring(text, F.lit(1), start)) != "", F.trim(F.substring(text, end + 1, F.length(text))) != ""
    safe = ~before & (n_after >= 2) & (n_candidate > 0) & (n_window / n_candidate < 0.60)
    return ((n_query != n_candidate) | safe) & (before | after)


def compose(decision: Column, texts: Column, glosses: Column, action: Column, draft: Column, draft_ok: Column) -> Column:
    """The answer's text: null for requests that pass through, fixed sentences where nothing is accepted, a checked draft
    if there is one, else the stored wording (with its meaning if that was asked for)."""
    stored = F.when(action == "EXPLAIN", F.array_join(F.zip_with(texts, glosses, lambda t, g: F.concat(t, F.lit(": "), g)), "\n")).otherwise(F.array_join(texts, "\n"))
    return (
        F.when(decision == "PASS_THROUGH", F.lit(None).cast("string"))
        .when(decision == "CLARIFY", "More than one reading is possible; please say which phrase or meaning you mean.")
        .when(decision == "NOT_ATTESTED_IN_CURRENT_CORPUS", "This wording is not in the current corpus.")
        .when(decision == "ACCEPT", F.coalesce(F.when(draft_ok, draft), stored))
        .otherwise("No grounded answer was found.")
    )
