"""Queries over files and streams that Spark writes from the given tables and reads back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundphrase.functions import json_search
from groundphrase.operators import store
from groundphrase.plans import bindings as b
from groundphrase.sources import strict
from groundphrase.streaming import cases, sessions

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


EVENTS = strict.Rules({"event_id": "int", "user_id": "int", "value": "number", "props": "object"}, {"event_type": ("string", "unknown"), "tags": ("array", [])}, key="event_id")


def _damaged(e: DataFrame) -> DataFrame:
    """(part, event_id, value): events as JSON lines, some with a fault that their number gives them."""
    kind = F.col("event_id") % 23
    record = F.concat(
        F.lit('{"event_id":'), F.when(kind == 7, F.col("event_id") - 4).otherwise(F.col("event_id")).cast("string"), F.when(kind == 6, F.lit("")).otherwise(F.concat(F.lit(',"event_type":"'), "event_type", F.lit('"'))),
        F.lit(',"user_id":'), F.when(kind == 4, F.concat(F.lit('"'), F.col("user_id").cast("string"), F.lit('"'))).otherwise(F.col("user_id").cast("string")),
        F.when(kind == 2, F.lit("")).otherwise(F.concat(F.lit(',"value":'), F.col("value").cast("decimal(18,2)").cast("string"))), F.lit(',"props":'), F.col("props"), F.when(kind == 1, F.lit(',"extra":1,"also":null')).otherwise(F.lit("")), F.when(kind == 8, F.lit(',"tags":["a","b"]')).otherwise(F.lit("")), F.lit("}"),
    )
    text = F.when(kind == 0, F.expr("left(r, length(r) - 1)")).when(kind == 3, F.lit("[1, 2]")).when(kind == 5, F.lit("  ")).otherwise(F.col("r"))
    return e.withColumn("r", record).select((F.col("event_id") % 4).alias("part"), "event_id", text.alias("value"))


@query(
    "WITH e AS (SELECT *, event_id % 23 AS k, event_id % 4 AS part, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) AS line FROM events), o AS (SELECT * FROM e WHERE event_id % 23 NOT IN (0, 1, 2, 3, 4, 5, 7))"
    " SELECT e.part, e.line, CASE e.k WHEN 0 THEN 'invalid JSON' WHEN 1 THEN 'unknown also,extra' WHEN 2 THEN 'missing value' WHEN 3 THEN 'not an object' WHEN 4 THEN 'user_id is no int' WHEN 7 THEN CASE WHEN o.line IS NOT NULL THEN 'repeats line ' || o.line::VARCHAR END END AS problem,"
    " CASE WHEN e.k NOT IN (0, 1, 2, 3, 4) AND NOT (e.k = 7 AND o.line IS NOT NULL) THEN CASE WHEN e.k = 7 THEN e.event_id - 4 ELSE e.event_id END END AS event_id, CASE WHEN e.k NOT IN (0, 1, 2, 3, 4) AND NOT (e.k = 7 AND o.line IS NOT NULL) THEN CASE WHEN e.k = 6 THEN 'unknown' ELSE e.event_type END END AS event_type,"
    " CASE WHEN e.k NOT IN (0, 1, 2, 3, 4) AND NOT (e.k = 7 AND o.line IS NOT NULL) THEN CASE WHEN e.k = 8 THEN '[\"a\",\"b\"]' ELSE '[]' END END AS tags FROM e LEFT JOIN o ON e.k = 7 AND o.event_id = e.event_id - 4 WHERE e.k <> 5"
)
def strict_scan(spark, sf):
    """Every line of damaged files of events: its file and line, what is wrong with it, or its record with defaults."""
    path = store.new_path(spark, "lines")
    d = _damaged(b.table(spark, sf, "events"))
    d.repartition("part").sortWithinPartitions("part", "event_id").select("value", "part").write.partitionBy("part").text(path)
    got = strict.scan(spark, path, EVENTS)
    return got.select(F.regexp_extract("file", "part=([0-9]+)", 1).cast("long").alias("part"), F.col("line").cast("long").alias("line"), "problem", "event_id", "event_type", "tags")


SHAPES = "d AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '{\"a\":[1,{\"K\":' || event_id || '}],\"b\":' || props || '}' WHEN 2 THEN '{\"x\":{\"y\":[' || props || ',{\"k\":null}]},\"Note\":\"' || event_type || '\"}' WHEN 3 THEN '[{\"m\":1},\"k\",{\"deep\":{\"er\":{\"nOTE\":' || props || '}}}]' ELSE '{\"key\":[[],{}],\"of\":\"k\"}' END AS j FROM events)"


@query(f"WITH {SHAPES} SELECT d.event_id, h.path, h.value FROM d LEFT JOIN (SELECT event_id, arg_min(fullkey, (parent, id)) AS path, arg_min(value::VARCHAR, (parent, id)) AS value FROM (SELECT event_id, t.fullkey, t.value, t.parent, t.id FROM d, json_tree(d.j) t WHERE lower(t.key) IN ('k', 'note')) GROUP BY 1) h USING (event_id)")
def json_find(spark, sf):
    """The first hit of two keys in JSON of many shapes."""
    i, p = F.col("event_id"), F.col("props")
    s = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    j = F.when(i % 5 == 0, p).when(i % 5 == 1, s('{"a":[1,{"K":', i.cast("string"), '}],"b":', p, "}")).when(i % 5 == 2, s('{"x":{"y":[', p, ',{"k":null}]},"Note":"', F.col("event_type"), '"}')).when(i % 5 == 3, s('[{"m":1},"k",{"deep":{"er":{"nOTE":', p, "}}}]")).otherwise('{"key":[[],{}],"of":"k"}')
    e = b.table(spark, sf, "events").select("event_id", j.alias("j")).withColumn("h", json_search.find_key(F.col("j"), ["K", "note"]))
    return e.select("event_id", "h.path", "h.value")


RESULT = "id long, status string, spent double"


class Stopped(RuntimeError):
    """What ends a run on purpose."""


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 = 7 THEN 'FAIL' ELSE 'PASS' END AS status, round(o_totalprice, 2) AS spent FROM orders")
def resumed_cases(spark, sf):
    """Every order put through a run that stops in its third batch and is then repeated."""
    at = store.new_path(spark, "cases")
    b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice").repartition(5).write.parquet(f"{at}/in")
    stream = spark.readStream.schema("id long, o_totalprice double").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    calls = []

    def work(df: DataFrame) -> DataFrame:
        calls.append(1)
        if len(calls) == 3:
            raise Stopped
        return df.select("id", F.when(F.col("id") % 50 == 7, "FAIL").otherwise("PASS").alias("status"), F.round("o_totalprice", 2).alias("spent"))

    try:
        cases.run(stream, work, f"{at}/out", RESULT)
    except Exception as e:  # the stream's error holds the message of what stopped it
        if "Stopped" not in str(e):
            raise
    cases.run(stream, work, f"{at}/out", RESULT)
    return cases.results(spark, f"{at}/out", RESULT)


def replayed(spark: SparkSession, sf: str, parts: int = 3) -> DataFrame:
    """Conversations as a stream of files in the order of turns; a turn is a minute, conversations start apart. What a
    part holds of a conversation is in one file, and later parts are later files."""
    at = store.new_path(spark, "turns")
    c = b.table(spark, sf, "conversations").withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("conv_id") % 1000 * 36 + F.col("turn") * 60))
    c = c.select("conv_id", "ts", "turn", "role", "text")
    for k in range(parts):
        c.where(F.least(F.floor(F.col("turn") / 3), F.lit(parts - 1)) == k).repartition("conv_id").write.mode("append").parquet(at)
    return spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 4).parquet(at)


@query("WITH s AS (SELECT conv_id AS session, turn, text, (count(*) FILTER (trim(text) <> '') OVER w)::BIGINT AS n_queries, (count(*) OVER w)::BIGINT AS n_rows FROM conversations WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING)) SELECT session, 's' || session || '-' || lpad(n_queries::VARCHAR, 5, '0') AS query_id, text, n_queries, n_rows FROM s WHERE trim(text) <> ''")
def session_queries(spark, sf):
    """Users' turns replayed as a stream: each query with its number in its session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = store.new_path(spark, "sessions")
    got = sessions.numbered(replayed(spark, sf).where("role = 'user'"), "conv_id", "ts", "text", late="30 days")
    got.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")).option("checkpointLocation", f"{out}/checkpoint").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(sessions.OUT).parquet(f"{out}/rows")
    return rows.where("not closed").select("session", "query_id", "text", "n_queries", "n_rows")
