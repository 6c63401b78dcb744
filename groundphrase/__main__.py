"""python -m groundphrase TASK --requests FILE --expressions FILE --sources FILE --out FOLDER

Requests are lines of JSON with query_id and text; the answers are written as lines of JSON. TASK: attest,
surface, meaning or auto."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from groundphrase.operators.engine import Engine
from groundphrase.sources import files


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="groundphrase")
    ap.add_argument("task", choices=("attest", "surface", "meaning", "auto"))
    for name in ("requests", "expressions", "sources", "out"):
        ap.add_argument(f"--{name}", required=True)
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName("groundphrase").getOrCreate()
    expressions, sources = (files.read_jsonl(spark, getattr(a, k), files.SCHEMAS[k]) for k in ("expressions", "sources"))
    bad = files.corpus_violations(expressions, sources).limit(20).collect()
    if bad:
        raise SystemExit("the corpus breaks its rules: " + "; ".join(f"{r.id}: {r.violation}" for r in bad))
    variants = files.variants_of(expressions, sources).withColumn("doc_id", F.xxhash64("expression_id", "variant_id"))
    glosses = expressions.select(F.xxhash64("expression_id").alias("doc_id"), "family_id", F.col("gloss").alias("text"))
    requests = files.read_jsonl(spark, a.requests, "query_id string, text string")
    files.write_jsonl(getattr(Engine(variants, glosses), a.task)(requests), a.out)


if __name__ == "__main__":
    main()
