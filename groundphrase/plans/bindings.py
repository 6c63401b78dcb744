"""The engine's concepts over the given tables, as DataFrames and as the same views in SQL.

The surface corpus comes from `benchmark` (the first eight and the first five words of an item are two variants
of its family); requests come from it in four forms and from what users say in `conversations`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Letters whose capitals are alike in all engines.
SMALL = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _items(spark: SparkSession, sf: str) -> DataFrame:
    words = F.filter(F.split("text", r"[ \t\n\r]+"), lambda x: x != "")
    return table(spark, sf, "benchmark").select("item_id", words.alias("t"))


def _id(letter: str):
    return F.concat(F.lit(letter), F.lpad(F.col("item_id").cast("string"), 4, "0"))


def _first(n: int, sep: str = " "):
    return F.array_join(F.slice("t", 1, n), sep)


def variants(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, item_id, expression_id, family_id, variant_id, source_id, source_ref, text."""
    i = _items(spark, sf)
    one = lambda k, n: i.select(
        (F.col("item_id") * 2 + k).alias("doc_id"), "item_id", _id("p").alias("expression_id"), _id("f").alias("family_id"), F.concat(_id("p"), F.lit(f"-v{k + 1}")).alias("variant_id"),
        (F.col("item_id") % 25).alias("source_id"), F.when(F.col("item_id") % 3 == 0, "").otherwise(F.concat(F.lit("r"), F.col("item_id").cast("string"))).alias("source_ref"), _first(n).alias("text"),
    )
    return one(0, 8).unionByName(one(1, 5))


def glosses(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id (the item), family_id, text: the words after the eighth."""
    return _items(spark, sf).select(F.col("item_id").alias("doc_id"), _id("f").alias("family_id"), F.array_join(F.expr("slice(t, 9, greatest(size(t), 1))"), " ").alias("text"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, text: exact in other case and with marks (e), without spaces (c), cut short (p), with a wrong
    word (w), user turns (u), and some empty or short ones (z)."""
    i = _items(spark, sf)
    one = lambda k, text: i.select(F.concat(F.lit(k), F.col("item_id").cast("string")).alias("query_id"), text.alias("text"))
    wrong = F.array_join(F.concat(F.slice("t", 1, 4), F.array(F.lit("zzzz")), F.slice("t", 6, 3)), " ")
    users = table(spark, sf, "conversations").where("role = 'user'").select(F.concat(F.lit("u"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("query_id"), "text")
    few = spark.createDataFrame([("z1", ""), ("z2", " .. "), ("z3", "abc"), ("z4", "nothing like it at all")], "query_id string, text string")
    parts = [one("e", F.concat(F.translate(_first(8), SMALL, SMALL.upper()), F.lit("!"))), one("c", _first(8, "")), one("p", _first(6)), one("w", wrong), users, few]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sources(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("source_id"), F.col("n_name").alias("source_name"), F.concat(F.lit("ref-"), F.col("n_name")).alias("ref"))


VIEWS = r"""
items AS (SELECT item_id, list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda x: x <> '') AS t FROM benchmark),
variants AS (
  SELECT item_id * 2 + k AS doc_id, item_id, 'p' || lpad(item_id::VARCHAR, 4, '0') AS expression_id, 'f' || lpad(item_id::VARCHAR, 4, '0') AS family_id,
    'p' || lpad(item_id::VARCHAR, 4, '0') || '-v' || (k + 1)::VARCHAR AS variant_id, item_id % 25 AS source_id, CASE WHEN item_id % 3 = 0 THEN '' ELSE 'r' || item_id::VARCHAR END AS source_ref,
    array_to_string(CASE WHEN k = 0 THEN t[1:8] ELSE t[1:5] END, ' ') AS text
  FROM items, (SELECT unnest([0, 1])::BIGINT AS k)),
glosses AS (SELECT item_id AS doc_id, 'f' || lpad(item_id::VARCHAR, 4, '0') AS family_id, array_to_string(t[9:], ' ') AS text FROM items),
requests AS (
  SELECT 'e' || item_id::VARCHAR AS query_id, translate(array_to_string(t[1:8], ' '), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || '!' AS text FROM items
  UNION ALL SELECT 'c' || item_id::VARCHAR, array_to_string(t[1:8], '') FROM items
  UNION ALL SELECT 'p' || item_id::VARCHAR, array_to_string(t[1:6], ' ') FROM items
  UNION ALL SELECT 'w' || item_id::VARCHAR, array_to_string(list_concat(list_concat(t[1:4], ['zzzz']), t[6:8]), ' ') FROM items
  UNION ALL SELECT 'u' || conv_id::VARCHAR || '-' || turn::VARCHAR, text FROM conversations WHERE role = 'user'
  UNION ALL SELECT * FROM (VALUES ('z1', ''), ('z2', ' .. '), ('z3', 'abc'), ('z4', 'nothing like it at all'))),
sources AS (SELECT n_nationkey::BIGINT AS source_id, n_name AS source_name, 'ref-' || n_name AS ref FROM nation)
"""


#: For each small Latin letter a letter of the requests' own script, none of which is folded or part of a cue.
SCRIPT = "ابپتثجچحخدذرزژسلصضطظعغفقکگ"


def in_script(c):
    """A Latin text's letters in the requests' own script."""
    return F.translate(c, SMALL + SMALL.upper(), SCRIPT * 2)


def in_script_sql(c: str) -> str:
    return f"translate({c}, '{SMALL + SMALL.upper()}', '{SCRIPT * 2}')"


def words(spark: SparkSession, sf: str) -> DataFrame:
    """item_id, w: the items' words of four letters or more, in the requests' script and nothing else."""
    plain = F.regexp_replace(F.lower("text"), "[^a-z ]", "")
    w = F.filter(F.split(in_script(plain), " "), lambda x: F.length(x) > 3)
    return table(spark, sf, "benchmark").select("item_id", w.alias("w"))


WORDS = f"words AS (SELECT item_id, list_filter(string_split({in_script_sql("regexp_replace(lower(text), '[^a-z ]', '', 'g')")}, ' '), lambda x: length(x) > 3) AS w FROM benchmark)"


def norm(c: str) -> str:
    """retrieval() in SQL, for texts without letters that fold."""
    return rf"trim(regexp_replace(lower(regexp_replace(regexp_replace({c}, '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}} ]', '', 'g')), ' +', ' ', 'g'))"


def compact(c: str) -> str:
    return f"replace({norm(c)}, ' ', '')"


def grams(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) = 0 THEN [] ELSE list_transform(range(1, greatest(length({c}) - {n} + 1, 1) + 1), lambda i: substr({c}, i, {n})) END"
