"""Requests as a stream: attested against a static corpus, once each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from groundphrase.functions import text as tx
from groundphrase.operators.attest import LEAST_COMPACT, keys


def attested(stream: DataFrame, variants: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(query_id, ts, status, doc_id) of a stream (query_id, ts, text); a repeated id within `late` counts once."""
    by_form, by_compact = keys(variants)
    q = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["query_id"])
    q = q.withColumn("r", tx.retrieval(F.col("text"))).withColumn("c", tx.compact(F.col("r")))
    q = q.join(by_form, q["r"] == by_form["by_form_key"], "left").join(by_compact, q["c"] == by_compact["by_compact_key"], "left")
    doc = F.coalesce("by_form", "by_compact")
    short = F.length("c") < LEAST_COMPACT
    status = F.when(short, "NEEDS_CLARIFICATION").when(doc.isNotNull(), "ATTESTED").otherwise("NOT_ATTESTED")
    return q.select("query_id", "ts", status.alias("status"), F.when(~short, doc).alias("doc_id"))


def counted(events: DataFrame, by: str, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Counts in tumbling windows, final once the watermark has passed them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def write(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, going on after a restart where the checkpoint says."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
