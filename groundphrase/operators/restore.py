"""Restoring a misremembered phrase by the tokens it shares with the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundphrase.functions import stems
from groundphrase.functions import text as tx

ACCEPT, MARGIN, ANCHOR = 0.88, 0.12, 0.94
#: A prefix completion has so many tokens, and its continuation so many more.
LEAST_PREFIX, LEAST_MORE = 4, 3


def long_tokens(text: Column) -> Column:
    return F.filter(tx.tokens(tx.retrieval(text)), lambda t: F.length(t) > 1)


def base_restore(requests: DataFrame, variants: DataFrame, accept: float = ACCEPT, margin: float = MARGIN, items=stems.signature) -> DataFrame:
    """(query_id, family_id, score, accepted): the best family by shared items, 0.55 of the request's and 0.45
    of the variant's; accepted if good enough and far enough before the next.

    A request of one item that only one family holds scores ANCHOR at least.
    """
    q = requests.select("query_id", F.array_distinct(items(F.col("text"))).alias("t")).select("query_id", F.size("t").alias("nq"), F.explode("t").alias("k"))
    v = variants.select("doc_id", "family_id", F.array_distinct(items(F.col("text"))).alias("t")).select("doc_id", "family_id", F.size("t").alias("nv"), F.explode("t").alias("k"))
    lone = v.groupBy("k").agg(F.count_distinct("family_id").alias("families"))
    hits = q.join(v.join(lone, "k"), "k").groupBy("query_id", "doc_id", "family_id", "nq", "nv").agg(F.count(F.lit(1)).alias("n"), F.min("families").alias("families"))
    part = 0.55 * F.col("n") / F.col("nq") + 0.45 * F.col("n") / F.col("nv")
    s = hits.groupBy("query_id", "family_id").agg(F.max(F.when((F.col("nq") == 1) & (F.col("families") == 1), F.greatest(part, F.lit(ANCHOR))).otherwise(part)).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "family_id")
    s = s.withColumn("rank", F.row_number().over(w)).withColumn("next", F.coalesce(F.lead("score").over(w), F.lit(0.0))).where("rank = 1")
    return s.select("query_id", "family_id", "score", ((F.col("score") >= accept) & (F.col("score") - F.col("next") >= margin)).alias("accepted"))


def complete_prefix(requests: DataFrame, variants: DataFrame, items=stems.signature) -> DataFrame:
    """(query_id, family_id, extension, reason): the family with the longest continuation of a request that is
    the beginning of one of its variants; none if two are equally long."""
    q = requests.select("query_id", items(F.col("text")).alias("q")).where(F.size("q") >= LEAST_PREFIX).withColumn("k", F.get("q", F.lit(0)))
    v = variants.select("family_id", items(F.col("text")).alias("v")).withColumn("k", F.get("v", F.lit(0)))
    longer = q.join(v, "k").where(F.expr(f"size(v) >= size(q) + {LEAST_MORE} AND slice(v, 1, size(q)) = q"))
    best = longer.groupBy("query_id", "family_id").agg(F.max(F.size("v") - F.size("q")).alias("extension"))
    w = Window.partitionBy("query_id").orderBy(F.desc("extension"), "family_id")
    r = best.withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("extension").over(w)).where("rank = 1")
    tie = F.coalesce(F.col("next") == F.col("extension"), F.lit(False))
    return r.select("query_id", F.when(~tie, F.col("family_id")).alias("family_id"), "extension", F.when(tie, "ambiguous-long-prefix-completion").otherwise("explicit-long-prefix-completion").alias("reason"))


#: A variant that differs by one word counts as so good, if so much else agrees.
NEAR, NEAR_SHARED, NEAR_ITEMS, NEAR_PART, NEAR_DISTINCTIVE = 0.90, 3, 4, 0.75, 2


def fuzzy_restore(requests: DataFrame, variants: DataFrame, accept: float = ACCEPT, margin: float = MARGIN, items=stems.wide_signature) -> DataFrame:
    """(query_id, family_id, score, margin, reason) of every request: the best family by shared stems.

    As base_restore, and a variant with all but one of its stems in place, two of them distinctive (in two families
    at most), scores NEAR at least. family_id is null unless the score and the lead are enough. A request without
    stems or without a candidate has a score of 0. Restoring attests nothing.
    """
    sig = requests.select("query_id", F.array_distinct(items(F.col("text"))).alias("t"))
    q = sig.select("query_id", F.size("t").alias("nq"), F.explode("t").alias("k"))
    v = variants.select("doc_id", "family_id", F.array_distinct(items(F.col("text"))).alias("t")).select("doc_id", "family_id", F.size("t").alias("nv"), F.explode("t").alias("k"))
    held = v.groupBy("k").agg(F.count_distinct("family_id").alias("families"))
    hits = q.join(v.join(held, "k"), "k").groupBy("query_id", "doc_id", "family_id", "nq", "nv").agg(F.count(F.lit(1)).alias("n"), F.min("families").alias("families"), F.count_if(F.col("families") <= 2).alias("distinctive"))
    qc, vc = F.col("n") / F.col("nq"), F.col("n") / F.col("nv")
    base = 0.55 * qc + 0.45 * vc
    base = F.when((F.col("nq") == 1) & (F.col("families") == 1), F.greatest(base, F.lit(ANCHOR))).otherwise(base)
    near = (F.col("n") >= NEAR_SHARED) & (F.least("nq", "nv") >= NEAR_ITEMS) & (qc >= NEAR_PART) & (vc >= NEAR_PART)
    score = F.when(near & (F.col("distinctive") >= NEAR_DISTINCTIVE), F.greatest(base, F.lit(NEAR))).otherwise(base)
    hits = hits.withColumn("score", score).withColumn("alike", (F.col("n") >= NEAR_SHARED) & (qc >= NEAR_PART) & (vc >= NEAR_PART))
    best = hits.groupBy("query_id", "family_id").agg(F.max_by(F.struct("score", "alike"), F.struct(F.round("score", 9), -F.col("doc_id"))).alias("b")).select("query_id", "family_id", "b.*")
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "family_id")
    r = best.withColumn("rank", F.row_number().over(w)).withColumn("margin", F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0))).where("rank = 1").drop("rank")
    r = sig.select("query_id", (F.size("t") == 0).alias("blank")).join(r, "query_id", "left")
    ok = (F.col("score") >= accept) & (F.col("margin") >= margin)
    reason = F.when(F.col("blank"), "empty-normalized-surface").when(F.col("score").isNull(), "no-lexical-rescue-candidate").when(~ok, "restore-rescue-threshold-not-met")
    reason = reason.when((F.col("score") >= NEAR) & F.col("alike"), "morphology-distinctive-near-match-rescue").otherwise("morphology-and-distinctive-token-rescue")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return r.select("query_id", F.when(ok, F.col("family_id")).alias("family_id"), zero("score"), zero("margin"), reason.alias("reason"))
