"""Strict scans of JSON lines: every fault with its file and line, unknown and missing fields, kinds, defaults, repeats.

Files are split over tasks as usual. A line's number is the number of lines in the splits of its file before its
own, by sums over splits (one row each), and its place in its split; no task reads a file whole.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Kinds of fields, as the types a value may have in JSON (fixed values).
KINDS = {"string": ("STRING",), "int": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}
TYPES = {"string": "string", "int": "long", "number": "double", "boolean": "boolean", "array": "string", "object": "string"}


@dataclass(frozen=True)
class Rules:
    """Fields of a record: required ones and optional ones with their defaults, each with a kind; what names a record."""

    required: dict[str, str]
    optional: dict[str, tuple[str, object]] = field(default_factory=dict)
    key: str | None = None

    def kinds(self) -> dict[str, str]:
        return self.required | {k: v[0] for k, v in self.optional.items()}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files; lines count from 1 in each file, blank ones too."""
    meta = F.col("_metadata")
    t = spark.read.text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    per = t.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("file", "block", "first", ahead.alias("ahead"))  # one row for each split
    return t.join(per, ["file", "block"]).select("file", (F.col("ahead") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def _kind(v: Column, name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))


def _problem(rules: Rules) -> Column:
    keys, known = F.col("keys"), rules.kinds()
    listed = lambda label, a: F.concat(F.lit(label), F.array_join(a, ","))
    missing = F.array_except(F.array(*map(F.lit, rules.required)), keys)
    extra = F.array_sort(F.array_except(keys, F.array(*map(F.lit, known))))
    out = F.when(F.col("v").isNull(), "invalid JSON").when(keys.isNull(), "not an object").when(F.size(missing) > 0, listed("missing ", missing)).when(F.size(extra) > 0, listed("unknown ", extra))
    for name, kind in known.items():
        found = _kind(F.col("v"), name)
        fits = F.lit(False)
        for k in KINDS[kind]:
            fits = fits | found.startswith(k)
        if name in rules.optional:
            fits = fits | found.isNull() | (found == "VOID")
        out = out.when(~F.coalesce(fits, F.lit(False)), f"{name} is no {kind}")
    return out


def scan(spark: SparkSession, path: str, rules: Rules) -> DataFrame:
    """(file, line, problem, fields...): every line that isn't blank; problem is null for good records, whose fields are
    filled, optional ones with their defaults. A record whose key an earlier good one has (by file, then line)
    is a fault too. Field names are letters, digits and underscores."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    read = lines.select("file", "line", F.try_parse_json("value").alias("v"), F.json_object_keys("value").alias("keys")).withColumn("problem", _problem(rules))
    fields = []
    for name, kind in rules.kinds().items():
        value = F.try_variant_get("v", f"$.{name}", TYPES[kind])
        if name in rules.optional:
            default = rules.optional[name][1]
            value = F.coalesce(value, F.lit(json.dumps(default) if isinstance(default, (list, dict)) else default))
        fields.append(F.when(F.col("problem").isNull(), value).alias(name))
    out = read.select("file", "line", "problem", *fields)
    if rules.key is None:
        return out
    key = F.col(rules.key)
    # Lines without a key are dealt by their place, else they would all meet under null.
    out = out.withColumn("_salt", F.when(key.isNull(), F.xxhash64("file", "line")).otherwise(F.lit(0)))
    first = out.where("problem is null").groupBy(key.alias("_key")).agg(F.min(F.struct("file", "line")).alias("_first"), F.count(F.lit(1)).alias("_n"), F.min("_salt").alias("_none")).where("_n > 1")
    both = out.join(first, (key == F.col("_key")) & (F.col("_salt") == F.col("_none")), "left")
    again = F.col("problem").isNull() & (F.col("_first") < F.struct("file", "line"))
    problem = F.when(again, F.concat(F.lit("repeats line "), F.col("_first.line").cast("string"))).otherwise(F.col("problem"))
    return both.select("file", "line", problem.alias("problem"), *(F.when(~F.coalesce(again, F.lit(False)), F.col(n)).alias(n) for n in rules.kinds()))


def require(scanned: DataFrame) -> DataFrame:
    """The good records; the first fault, by file and line, ends the job with its place."""
    bad = scanned.where("problem is not null").orderBy("file", "line").select("file", "line", "problem").take(1)
    if bad:
        raise ValueError(f"{bad[0].problem} at {bad[0].file}:{bad[0].line}")
    return scanned.drop("file", "line", "problem")


def unknown_keys(records: DataFrame, reference: DataFrame, column: str, key: str) -> DataFrame:
    """Records whose column names nothing in a reference table; null names nothing and is none of them."""
    return records.where(F.col(column).isNotNull()).join(reference.select(F.col(key).alias(column)).distinct(), column, "left_anti")
