"""Centroid clustering of whole-number vectors by Lloyd's rounds over distinct vectors.

Components become whole numbers, so equal vectors meet in one row with the number of their copies, however many
there are, and all later work is on distinct vectors: tasks assign them to the nearest of a fixed number of
centroids and add up weighted sums, Spark adds up the tasks' sums, and the driver gets one number for each
centroid and component. Everything is exact whole-number arithmetic, so neither the order of rows nor the
partitioning shows in the result. At the end the assignments are joined back to the ids.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundphrase.llm.common import join_counted, small_batches, stored, table

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SALT = 64, 16, 3, 64, "1"
#: Components below this give exact sums of products in doubles (64 * 4 * 2 ** 44 is under 2 ** 53).
SMALL = 1 << 22
#: Sums travel as digits of so many bits, so that adding up those of all tasks stays within a long.
DIGIT = 40
#: The narrowest kind that holds a vector's components is its form, so equal vectors have equal bytes.
KINDS = {b"b": np.int8, b"h": np.int16, b"i": np.int32}


def pack(vectors: np.ndarray) -> list[bytes]:
    """Whole-number form of rows of doubles: floor(SCALE * x) of each component, exactly."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors * SCALE)
    low, high = scaled.min(1, initial=0), scaled.max(1, initial=0)
    out: list[bytes] = [b""] * len(vectors)
    open_ = np.ones(len(vectors), bool)
    for mark, kind in KINDS.items():
        most = min(np.iinfo(kind).max, SMALL - 1)
        fits = open_ & (low >= -most) & (high <= most)
        for i, row in zip(np.flatnonzero(fits), scaled[fits].astype(np.dtype(kind).newbyteorder("<")), strict=True):
            out[i] = mark + row.tobytes()
        open_ &= ~fits
    for i in np.flatnonzero(open_):  # doubles of this size: int() is exact, and so is the product
        out[i] = b"t" + ",".join(str(int(x) * SCALE if abs(x) >= 1 << 53 else math.floor(x * SCALE)) for x in vectors[i].tolist()).encode()
    return out


def unpack(packed: bytes) -> list[int]:
    if packed[:1] == b"t":
        return [int(x) for x in packed[1:].split(b",")]
    return np.frombuffer(packed, np.dtype(KINDS[packed[:1]]).newbyteorder("<"), offset=1).tolist()


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each row; of ties the smaller number."""
    if vectors.dtype != object and centroids.dtype != object:
        v = vectors.astype(float)
        d = (v * v).sum(1)[:, None] - 2 * v @ centroids.T.astype(float) + (centroids.astype(float) ** 2).sum(1)
    else:
        d = np.stack([((vectors.astype(object) - c) ** 2).sum(1) for c in centroids.astype(object)], 1)
    at = d.argmin(1)
    return at, d[np.arange(len(d)), at]


def matrix(rows: list[list[int]]) -> np.ndarray:
    """Whole numbers as longs where products of them are exact in doubles, else as Python's."""
    return np.array(rows, np.int64 if all(-SMALL < x < SMALL for r in rows for x in r) else object)


def _parts(packed: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) of a batch, one part for each form."""
    marks = np.array([p[0] for p in packed], np.uint8)
    for mark in np.unique(marks):
        at = np.flatnonzero(marks == mark)
        if (kind := KINDS.get(bytes([mark]))) is None:
            yield at, np.array([unpack(packed[i]) for i in at], object)
        else:
            yield at, np.frombuffer(b"".join(packed[i][1:] for i in at), np.dtype(kind).newbyteorder("<")).reshape(len(at), -1).astype(np.int64)


def digits(x: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of a whole number in base 2 ** DIGIT, every digit with the number's sign."""
    sign, rest, place = (-1 if x < 0 else 1), abs(x), 0
    while rest:
        yield place, sign * (rest & (1 << DIGIT) - 1)
        rest, place = rest >> DIGIT, place + 1


def sums(distinct: DataFrame, centroids: list[list[int]]) -> dict[tuple[int, int], int]:
    """{(cluster, component): weighted sum}, and the number of vectors at component -1; at most one entry for each
    centroid and component comes to the driver."""
    c, k = matrix(centroids), len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for b in batches:
            n = b.column(1).to_numpy(zero_copy_only=False)
            for at, v in _parts(b.column(0).to_pylist()):
                to, w = nearest(v, c)[0], n[at]
                for j in range(k):
                    if (of := to == j).any():
                        exact = v[of].astype(object) * w[of].astype(object)[:, None] if v.dtype == object or int(w[of].max()) >= 1 << 30 else v[of] * w[of][:, None]
                        for i, x in enumerate((*exact.sum(0).tolist(), int(w[of].sum()))):
                            i = -1 if i == v.shape[1] else i
                            total[j, i] = total.get((j, i), 0) + int(x)
        out = [(j, i, p, d) for (j, i), x in total.items() for p, d in digits(x)]
        yield pa.RecordBatch.from_arrays([pa.array([r[q] for r in out], t) for q, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["cluster", "i", "place", "digit"])

    parts = distinct.select("vec", "n").mapInArrow(run, "cluster int, i int, place int, digit long")
    got: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("cluster", "i", "place").agg(F.sum("digit").alias("digit")).collect():
        got[r.cluster, r.i] = got.get((r.cluster, r.i), 0) + (r.digit << DIGIT * r.place)
    return got


def assign(distinct: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec, n, cluster, distance); a distance that no long holds is null."""
    c = matrix(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to, far = np.zeros(b.num_rows, np.int32), [None] * b.num_rows
            for at, v in _parts(b.column(0).to_pylist()):
                j, d = nearest(v, c)
                to[at] = j
                for i, x in zip(at, d.tolist(), strict=True):
                    far[i] = int(x) if x < 1 << 63 else None
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to), pa.array(far, pa.int64())], names=["vec", "n", "cluster", "distance"])

    return distinct.select("vec", "n").mapInArrow(run, "vec binary, n long, cluster int, distance long")


def quantised(df: DataFrame, id_col: str, vector: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, vec) of the vectors with exactly so many components, none of them null or not finite."""
    small_batches(df.sparkSession)
    x = F.col(f"`{vector}`").cast("array<double>")
    good = (F.size(x) == dimensions) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), x.alias("x")).where(good)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pack(v), pa.binary())], names=["id", "vec"])

    return rows.mapInArrow(run, "id long, vec binary")


def cluster(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, salt: str = SALT) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector that is kept.

    Kept are vectors with `dimensions` components, none null or not finite; others (null and empty ones too)
    have no row. The first centroids are the k kept rows with the smallest SHA-256 of `salt:id`; rows whose id
    is null come last there (by their bytes), and so do equal hashes: repeated rows may start several equal
    centroids, of which the smallest number gets all. Fewer rows than k give fewer centroids. A centroid
    that loses all vectors stays. Repeated rows come back as often as they are there; other columns are not
    carried, whatever they are called. An empty table gives an empty result. Distances and inertias that no
    long holds are null; sums behind centroids are exact at any size.
    """
    rows, _ = stored(quantised(df, id_col, vector, dimensions), "vectors")
    distinct, _ = stored(rows.groupBy("vec").agg(F.count(F.lit(1)).alias("n")), "distinct")
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256).asc_nulls_last()
    centroids = [unpack(bytes(r.vec)) for r in rows.orderBy(order, "vec").limit(k).collect()]
    for _ in range(rounds if centroids else 0):
        got = sums(distinct, centroids)
        centroids = [[got.get((j, i), 0) // n for i in range(dimensions)] if (n := got.get((j, -1), 0)) else c for j, c in enumerate(centroids)]
    named, _ = stored(assign(distinct, centroids) if centroids else distinct.selectExpr("vec", "n", "0 as cluster", "0L as distance"), "assigned")
    far = F.col("distance").cast("decimal(19,0)") * F.col("n").cast("decimal(18,0)")
    per = {r.cluster: int(r.x) if r.whole and r.x is not None else None for r in named.groupBy("cluster").agg(F.sum(far).alias("x"), (F.count("distance") == F.count(F.lit(1))).alias("whole")).collect()}
    long_ = lambda x: F.lit(x if x is not None and x < 1 << 63 else None).cast("long")
    total = None if None in per.values() else sum(per.values())
    of = lambda xs: F.get(F.array(*xs), F.col("cluster"))  # noqa: E731  # k numbers at most
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    j = range(max(1, len(centroids)))
    return join_counted(rows, named, "vec", "n").select(
        F.col("id").alias(id_col), "cluster", "distance", of([long_(per.get(i, 0)) for i in j]).alias("cluster_inertia"), long_(total).alias("inertia"), of([F.lit(h) for h in hashes] or [F.lit("")]).alias("centroid_sha256"),
    )


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of `embeddings` that cluster() keeps, with its cluster; see there for nulls, ties and repeats."""
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql(k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    near = "SELECT vec_id, v, arg_min(c, d * 64 + c) AS c, min(d) AS d FROM (SELECT q.vec_id, q.v, m.c, list_sum(list_transform(list_zip(q.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::HUGEINT AS d FROM q, {m} m) GROUP BY vec_id, v"
    mean = "SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM (SELECT c, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM a{r}) GROUP BY c, i) GROUP BY c"
    parts = [
        "q AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"m0 AS (SELECT c, v FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR)) - 1 AS c, v FROM q) WHERE c < {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS ({near.format(m=f'm{r}')})")
        parts.append(f"n{r} AS ({mean.format(r=r)})")
        parts.append(f"m{r + 1} AS (SELECT m{r}.c, coalesce(n{r}.v, m{r}.v) AS v FROM m{r} LEFT JOIN n{r} USING (c))")
    last = f"SELECT vec_id, a.c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m{rounds}.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN m{rounds} USING (c)"
    return f"WITH {', '.join(parts)} {last}"


QUERIES = {"op11_centroids": op11_centroids}
ORACLE_SQL: dict[str, str] = {"op11_centroids": _sql()}
