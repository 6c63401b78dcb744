"""The corpus pipeline: quality rules, toxicity, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundphrase.llm import near_copies, packing, quality, secret_scan, toxicity
from groundphrase.llm.common import stored, table


def _held(docs: DataFrame) -> DataFrame:
    """text, and all other columns inside `_row`, where no operator's column can clash with them."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("_row"), "text")


def _released(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*("text" if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in cols))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose base rules hold and whose posterior quality is one half or more. Null texts have no words and go;
    repeated rows stay or go together; an empty table stays empty."""
    return _released(quality.judge(_held(docs)).where("kept"), docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier does not call toxic; it is learned from what reached this stage. A score of exactly one
    half goes; null texts score like empty ones; repeated rows stay or go together; an empty table stays empty."""
    model = toxicity.fit(toxicity.sample(docs, table(spark, sf_dir, "labels")))
    return _released(toxicity.score(_held(docs), model).where("score < 0.5"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of texts linked by five-word similarities of 0.8 or more.

    That is the row with the smallest id, null last, then the smallest text. Ids link nothing: different texts
    under one id, or under none, are different documents.
    """
    groups, _ = stored(near_copies.groups(docs), "groups")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "node")).alias("best")
    best, _ = stored(groups.groupBy("component").agg(best).select("best.doc_id", "best.node"), "kept")
    rows = near_copies.with_node(_held(docs)).withColumn("doc_id", F.col("_row.doc_id"))
    rows = rows.alias("r").join(best.alias("k"), F.expr("r.node = k.node and r.doc_id <=> k.doc_id"), "left_semi")
    nth = F.row_number().over(Window.partitionBy("node", "doc_id").orderBy("text", F.xxhash64("_row")))
    return _released(rows.withColumn("_nth", nth).where("_nth = 1"), docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mark in place of every secret; n_chars is that of the new text (null for a null text, which stays null). Repeated rows
    change alike."""
    clean = secret_scan.redact(docs)
    return clean.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed sequences: a row for each piece of a document. Null texts count as empty, repeated rows are pieces of their own; no
    document gives no bin."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality_rules), ("toxicity", toxic), ("near duplicates", near_duplicates), ("secrets", secrets), ("packing", pack)]

#: The stages are learned or iterative, so SQL can't express them; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on what the one before has kept, written and read again between them."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, _ = stored(docs, f"stage-{k}")
    return docs
