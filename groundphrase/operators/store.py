"""Tables in the shared folder, and running counts in order without a task that sees everything."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where that is unset (as in tests), one of this machine."""
    if at := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return at.rstrip("/")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="groundphrase-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there, and nobody computes it twice."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/groundphrase/{what}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the application may be gone already
            return


def before(counts: DataFrame, value: str, n: str = "n", by: list[str] | None = None, out: str = "before") -> DataFrame:
    """Add to rows (by..., value, n), each value once, how much of n smaller values of the group have.

    Rows are dealt by ranges; sums run inside a range, and what the ranges before it hold is added. So no
    task sees a whole group, however large it is.
    """
    by = by or []
    rows = stored(counts.repartitionByRange(*by, value).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_range", *by).agg(F.sum(n).alias("_n"))  # one row for each range and group
    ahead = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", *(F.col(c).alias(f"_{c}") for c in by), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    rows = rows.alias("r").join(totals.alias("t"), F.expr(" and ".join(["r._range = t._range", *(f"r.`{c}` <=> t.`_{c}`" for c in by)])))
    return rows.select("r.*", "t._ahead").withColumn(out, F.coalesce(F.sum(n).over(inside), F.lit(0)) + F.col("_ahead")).drop("_range", "_ahead")


def order_statistics(df: DataFrame, value: str, ranks: list, by: list[str] | None = None) -> DataFrame:
    """(by..., n, s0, s1, ...): for each of `ranks` (columns of n, from 0, clipped to the group) the value there."""
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    placed = before(counts, value, "n", by)
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_total")).select(*(F.col(c).alias(f"_{c}") for c in by), "_total")
    on = " and ".join(f"p.`{c}` <=> t.`_{c}`" for c in by) if by else "true"
    p = placed.alias("p").join(totals.alias("t"), F.expr(on)).select("p.*", F.col("t._total"))
    picked = []
    for i, r in enumerate(ranks):
        at = F.greatest(F.lit(0), F.least(F.col("_total") - 1, r(F.col("_total"))))
        picked.append(F.max(F.when((F.col("before") <= at) & (at < F.col("before") + F.col("n")), F.col(value))).alias(f"s{i}"))
    return p.groupBy(*by).agg(F.max("_total").alias("total"), *picked).withColumnRenamed("total", "n")
