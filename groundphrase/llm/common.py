"""What the operators of this subpackage share: Arrow passes over a text column, tables in the shared
folder, joins that stand one very frequent key, and connected components."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch. Texts may be very long, so both are small.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers: Arrow batches of a few megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def map_text(df: DataFrame, text: str, fields: str, make: Callable[[], Callable[[list], list]], keep: list[str] | None = None, raw: bool = False) -> DataFrame:
    """Add the columns `fields` (DDL) to df with one Arrow pass over the column `text`.

    make() runs once for each task and returns a function of a list of bytes (UTF-8; None for null) that
    returns one list or Arrow array for each field. raw: the column is binary already. Columns of df that clash with a field give way to it.
    """
    small_batches(df.sparkSession)
    out = T.StructType.fromDDL(fields)
    new = {f.name.lower() for f in out}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    names = [f"c{i}" for i in range(len(keep))]
    source = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)), (F.col(f"`{text}`") if raw else F.col(f"`{text}`").cast("string").cast("binary")).alias("t"))
    schema = T.StructType([*(T.StructField(n, df.schema[c].dataType) for c, n in zip(keep, names, strict=True)), *out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        f = make()
        kinds = [to_arrow_type(x.dataType) for x in out]
        for b in batches:
            got = f(b.column(b.num_columns - 1).to_pylist())
            cols = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, k) for x, k in zip(got, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=[*names, *out.names])

    return source.mapInArrow(run, schema).select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), *out.names)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset (as in tests), one of this machine."""
    sc = spark.sparkContext
    if at := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return at.rstrip("/")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="groundphrase-"))
    return sc.getCheckpointDir().rstrip("/")


_made: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/groundphrase/{what}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme: one without is on the cluster's default file system, not on a machine's own disk."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return str(p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString())


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _made[:] = [x for x in _made if x[1] != path]


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the application may be gone already
            return


def stored(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """df written as a table in the shared folder and read back (its lineage ends there), and the path."""
    spark, path = df.sparkSession, new_path(df.sparkSession, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, *paths: str) -> None:
    """Remove tables that nobody reads any more, and let the driver forget finished shuffles: their files lie on the
    executors' disks until it has collected what refers to them."""
    for path in paths:
        remove(spark, path)
    gc.collect()
    spark._jvm.System.gc()


#: A key is hot if it has at least 1 of HOT_SHARE rows; so there are HOT_SHARE hot keys at most.
HOT_SHARE = 1000


def join_counted(left: DataFrame, right: DataFrame, key: str, n: str) -> DataFrame:
    """left join right on key, right having one row for each key and in `n` the rows that left has of it.

    Hot keys (HOT_SHARE at most, by definition) are joined by broadcast, so that no task gets all
    rows of a key; the others are shuffled.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    is_hot = F.col(n) * HOT_SHARE >= F.lit(int(total)) if total > HOT_SHARE else F.lit(False)
    hot = F.broadcast(right.where(is_hot).drop(n))
    rest = left.join(hot.select(key), key, "left_anti").join(right.where(~is_hot).drop(n), key, "left")
    return left.join(hot, key).unionByName(rest)


def _least(edges: DataFrame) -> tuple[DataFrame, str]:
    """(u, m, n): the smallest neighbour of each node, and how many edges it has."""
    return stored(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges between longs: (node, component), the smallest node of each.

    Alternating large-star and small-star steps; each ends in a table of the shared folder. A centre with very many
    neighbours is joined apart, so no task gets all of them. Nodes without an edge do not appear. Edges with a null end and loops are left out.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e, path = stored(e, "edges")
    while True:
        # Stars are reached when nobody has two centres and no centre has one itself.
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("centre")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("centre")))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("centre").alias("centre")).where("up > 1 or (up = 1 and centre = 1)").isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, path_0 = _least(both)
        large = join_counted(both, least, "u", "n").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u != v")
        large, path_1 = stored(large, "edges")
        least, path_2 = _least(large)
        small = join_counted(large, least, "u", "n").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new, new_path_ = stored(small, "edges")
        for x in (path, path_0, path_1, path_2):
            remove(spark, x)
        e, path = new, new_path_
    stars = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
