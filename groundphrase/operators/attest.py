"""Attestation: whole normalized surfaces only, never similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundphrase.functions import text as tx

LEAST_COMPACT, SUGGEST_FROM, SUGGESTIONS = 4, 0.45, 3


def keys(variants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first stored variant of each normalized form and of each compact form."""
    v = variants.select("doc_id", tx.retrieval(F.col("text")).alias("r")).withColumn("c", tx.compact(F.col("r")))
    one = lambda key, name: v.groupBy(F.col(key).alias(f"{name}_key")).agg(F.min("doc_id").alias(name))
    return one("r", "by_form"), one("c", "by_compact")


def attest(requests: DataFrame, variants: DataFrame) -> DataFrame:
    """(query_id, status, reason, doc_id) of each request."""
    by_form, by_compact = keys(variants)
    q = requests.select("query_id", tx.retrieval(F.col("text")).alias("r")).withColumn("c", tx.compact(F.col("r")))
    q = q.join(by_form, q["r"] == by_form["by_form_key"], "left").join(by_compact, q["c"] == by_compact["by_compact_key"], "left")
    empty, short = F.col("c") == "", F.length("c") < LEAST_COMPACT
    hit = lambda yes, form, other, no: F.when(empty | short, yes).when(F.col("by_form").isNotNull(), form).when(F.col("by_compact").isNotNull(), other).otherwise(no)
    return q.select(
        "query_id",
        hit(F.lit("NEEDS_CLARIFICATION"), F.lit("ATTESTED"), F.lit("ATTESTED"), F.lit("NOT_ATTESTED")).alias("status"),
        hit(F.when(empty, "empty-expression").otherwise("expression-too-short"), F.lit("normalized-corpus-match"), F.lit("compact-corpus-match"), F.lit("no-corpus-match")).alias("reason"),
        F.when(~empty & ~short, F.coalesce("by_form", "by_compact")).alias("doc_id"),
    )


def suggestions(attested: DataFrame, ranking: DataFrame) -> DataFrame:
    """(query_id, doc_id, rank, score): the best few of a ranking for what isn't attested, if the first is good enough."""
    r = attested.where("status = 'NOT_ATTESTED'").select("query_id").join(ranking.where(F.col("rank") <= SUGGESTIONS), "query_id")
    good = ranking.where((F.col("rank") == 1) & (F.col("score") >= SUGGEST_FROM)).select("query_id")
    return r.join(good, "query_id", "left_semi").select("query_id", "doc_id", "rank", "score")


def resolve(pointers: DataFrame, variants: DataFrame, sources: DataFrame) -> DataFrame:
    """Corpus text and source of accepted pointers (doc_id); a variant without a reference takes its source's."""
    v = pointers.join(variants, "doc_id").join(sources, "source_id")
    return v.withColumn("source_ref", F.coalesce(F.when(F.col("source_ref") != "", F.col("source_ref")), F.col("ref"))).drop("ref")
