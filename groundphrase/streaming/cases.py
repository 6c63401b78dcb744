"""Runs over cases that may be stopped at any point and go on where they were."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundphrase.operators.store import exists


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of finished batches: those that the manifest names, whatever else lies in the folder."""
    if not exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], schema)
    done = spark.read.parquet(f"{path}/manifest").select("batch")
    rows = spark.read.schema(f"{schema}, batch long").option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return rows.join(F.broadcast(done), "batch", "left_semi").drop("batch")


def run(cases: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, schema: str, key: str = "id") -> None:
    """Put every case of a stream of files through `work` once it has no PASS on record, and keep what it gives.

    A batch's rows are written to its own folder, then its manifest entry; both replace what a stopped try may have left,
    so a batch that is replayed after a failure counts once. Cases with a PASS from an earlier run (another
    checkpoint, another day) are left out by an anti join; those that failed come again.
    work: cases in, rows of `schema` (with the key and status) out.
    """
    spark = cases.sparkSession

    def batch(df: DataFrame, n: int) -> None:
        earlier = results(df.sparkSession, path, schema).where("status = 'PASS'").select(key).distinct()
        todo = df.dropDuplicates([key]).join(earlier, key, "left_anti")
        work(todo).select(*(f"`{c}`" for c in columns)).write.mode("overwrite").parquet(f"{path}/rows/batch={n}")
        df.sparkSession.createDataFrame([(n,)], "batch long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/entry={n}")

    columns = spark.createDataFrame([], schema).columns
    query = cases.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def latest(rows: DataFrame, key: str = "id") -> DataFrame:
    """One row for each case: a PASS if it has any."""
    best = F.max_by(F.struct(*rows.columns), (F.col("status") == "PASS").cast("int"))
    return rows.groupBy(key).agg(best.alias("_r")).select("_r.*")
