"""Data quality as queries: each returns what breaks a rule of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundphrase.functions import text as tx


def duplicate_surfaces(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(surface, n, first_id) of normalized texts that come more than once."""
    return df.groupBy(tx.retrieval(F.col(text)).alias("surface")).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id")).where("n > 1")


def missing_keys(df: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rows whose key the target table does not have."""
    return df.join(target.select(key), key, "left_anti")


def sequential(variants: DataFrame, parent: str, variant: str) -> DataFrame:
    """Each variant's place in its expression, and whether its id says otherwise."""
    nth = F.row_number().over(Window.partitionBy(parent).orderBy(variant)).cast("long")
    return variants.withColumn("nth", nth).withColumn("wrong", F.col(variant) != F.concat(F.col(parent), F.lit("-v"), F.col("nth").cast("string")))


def corpus_counts(variants: DataFrame, glosses: DataFrame) -> DataFrame:
    g = glosses.where("text <> ''").select("family_id", F.lit(True).alias("has")).distinct()
    v = variants.join(g, "family_id", "left")
    return v.agg(F.count_distinct("expression_id").alias("expressions"), F.count(F.lit(1)).alias("variants"), F.count_distinct(F.when(F.col("has"), F.col("family_id"))).alias("glossed"))


def variant_violations(variants: DataFrame) -> DataFrame:
    """(variant_id, violation) of texts with editorial marks, malformed ids and empty surfaces."""
    v = F.when(F.col("text").rlike(r"[()\[\]{}<>]|//|\n"), "editorial-marker").when(~F.col("expression_id").rlike(r"^p\d{4,}$"), "expression-id").when(tx.retrieval(F.col("text")) == "", "empty-surface")
    return variants.select("variant_id", v.alias("violation")).where("violation is not null")


def gloss_violations(glosses: DataFrame) -> DataFrame:
    """(family_id, violation) of glosses that are empty, have several lines, no full stop, or a length out of 16 to 110."""
    t = tx.display(F.col("text"))
    v = F.when(t == "", "empty").when(t.contains("\n"), "several-lines").when(~t.endswith("."), "no-full-stop").when(~F.length(t).between(16, 110), "length")
    return glosses.select("family_id", v.alias("violation")).where("violation is not null")
