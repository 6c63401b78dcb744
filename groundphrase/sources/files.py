"""Readers and writers of the engine's files: strict, with the place of what is wrong."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VARIANT = "struct<variant_id:string,text:string,source_id:string,source_ref:string>"
SCHEMAS = {
    "sources": "source_id string, source_name string, license_tag string, snapshot string, ref string, provenance_status string, review_status string",
    "expressions": f"expression_id string, family_id string, expression_type string, gloss string, canonical_variant_id string, variants array<{VARIANT}>",
    "enrichment": "family_id string, keywords array<string>, scenarios array<string>, paraphrases array<string>, usage_notes array<string>, provenance string, review_status string",
    "overlay": "query_id string, family_id string, label string, rationale string, adjudication_source string, annotator_count int",
    "benchmark": "id string, category string, prompt string, expected_response_decision string, expected_runtime_decision string, expected_route string, expected_actions_any array<string>, target_family_ids array<string>, comparison_scope string",
}


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; blank lines are skipped, anything malformed fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_errors(spark: SparkSession, path: str, schema: str, required: list[str] | None = None) -> DataFrame:
    """(file, record, problem) of lines that are no object, lack a field or have one too many."""
    fields = T.StructType.fromDDL(schema).names
    need = fields if required is None else required
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value")).where(F.trim("value") != "")
    keys = F.json_object_keys("value")
    missing, extra = F.array_except(F.array(*map(F.lit, need)), keys), F.array_except(keys, F.array(*map(F.lit, fields)))
    listed = lambda label, a: F.concat(F.lit(label), F.array_join(a, ","))
    problem = F.when(keys.isNull(), "not an object").when(F.size(missing) > 0, listed("missing ", missing)).when(F.size(extra) > 0, listed("unknown ", extra))
    return lines.select("file", F.left("value", F.lit(200)).alias("record"), problem.alias("problem")).where("problem is not null")


def variants_of(expressions: DataFrame, sources: DataFrame) -> DataFrame:
    """A row for each stored variant with its source, numbered in corpus order."""
    v = expressions.select("expression_id", "family_id", "canonical_variant_id", F.posexplode("variants").alias("at", "v"))
    v = v.select("expression_id", "family_id", "canonical_variant_id", "at", "v.*").join(sources.drop("snapshot"), "source_id")
    return v.withColumn("source_ref", F.coalesce(F.when(F.col("source_ref") != "", F.col("source_ref")), F.col("ref")))


def corpus_violations(expressions: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, violation) of every rule of the corpus that a record breaks. An accepted corpus has none."""
    from groundphrase.functions import text as tx

    gloss = tx.display(F.col("gloss"))
    v = expressions.select("expression_id", F.posexplode("variants").alias("at", "v")).select("expression_id", "at", "v.*")
    rules = [
        (sources, "source_id", F.col("review_status") != "human-reviewed", "source-not-reviewed"),
        (expressions, "expression_id", ~F.col("expression_id").rlike(r"^p\d{4}$"), "expression-id"),
        (expressions, "expression_id", ~F.col("family_id").rlike(r"^f\d{4}$"), "family-id"),
        (expressions, "expression_id", F.col("expression_type") != "fixed_expression", "expression-type"),
        (expressions, "expression_id", gloss.contains("\n") | ~gloss.endswith(".") | ~F.length(gloss).between(16, 110), "gloss"),
        (expressions, "expression_id", F.size("variants") < 1, "no-variant"),
        (expressions, "expression_id", F.col("canonical_variant_id") != F.concat("expression_id", F.lit("-v1")), "canonical-variant"),
        (v, "variant_id", F.col("variant_id") != F.concat("expression_id", F.lit("-v"), (F.col("at") + 1).cast("string")), "variant-id"),
        (v, "variant_id", F.regexp_replace("text", " / ", " ").rlike(r"[()\[\]{}<>/\n]"), "editorial-marker"),
        (v, "variant_id", tx.retrieval(F.col("text")) == "", "empty-surface"),
        (v.join(sources.select("source_id"), "source_id", "left_anti"), "variant_id", F.lit(True), "unknown-source"),
    ]
    for table, key, name in ((sources, "source_id", "duplicate-source"), (expressions, "expression_id", "duplicate-expression"), (expressions, "family_id", "duplicate-family"), (v, "variant_id", "duplicate-variant")):
        rules.append((table.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, F.col("n") > 1, name))
    surfaces = v.groupBy(tx.retrieval(F.col("text")).alias("surface")).agg(F.count(F.lit(1)).alias("n"))
    rules.append((surfaces, "surface", F.col("n") > 1, "duplicate-surface"))
    out = None
    for table, key, bad, name in rules:
        part = table.where(bad).select(F.col(key).alias("id"), F.lit(name).alias("violation"))
        out = part if out is None else out.unionByName(part)
    return out


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_review_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, several-line cells and perhaps a byte order mark; all columns are text."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*(c.removeprefix("﻿") for c in df.columns))


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(frames: list[DataFrame], path: str) -> None:
    """Rows of several frames under the union of their columns; nested values as JSON text."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    nested = {f.name for f in out.schema if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))}
    out.select(*(F.to_json(c).alias(c) if c in nested else F.col(c) for c in out.columns)).write.mode("overwrite").option("header", True).csv(path)


def write_one_json(df: DataFrame, path: str) -> None:
    """The only row of a summary as pretty JSON at a local path."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"a summary has one row, not {len(rows)} or more")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rows[0].asDict(recursive=True), f, ensure_ascii=False, indent=2, default=str)


def unfinished(cases: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Cases that no PASS is on record for, so that a stopped run goes on where it was."""
    return cases.join(done.where("status = 'PASS'").select(key).distinct(), key, "left_anti")
