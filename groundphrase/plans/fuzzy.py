"""Queries that need Python kernels on candidate pairs; SQL can't express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundphrase.operators import index, lexical, local
from groundphrase.plans import bindings as b


def _ranked(spark, sf):
    return index.ranked(lexical.fused(b.requests(spark, sf), b.variants(spark, sf)))


def fuzzy_rerank(spark, sf):
    got = local.fuzzy_rerank(_ranked(spark, sf), b.requests(spark, sf), b.variants(spark, sf))
    return got.where("rank <= 5").select("query_id", "doc_id", F.round("fuzzy", 6).alias("fuzzy"), F.round("score", 6).alias("score"), "rank")


def local_alignment(spark, sf):
    return local.align(_ranked(spark, sf), b.requests(spark, sf), b.variants(spark, sf)).withColumn("score", F.round("score", 6))


def restore_ordered(spark, sf):
    return local.ordered_restore(b.requests(spark, sf), b.variants(spark, sf)).withColumn("ratio", F.round("ratio", 6))


QUERIES = {f.__name__: f for f in (fuzzy_rerank, local_alignment, restore_ordered)}
ORACLE_SQL: dict[str, str] = {}
