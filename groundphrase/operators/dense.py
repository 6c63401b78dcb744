"""Dense retrieval over array<float> columns, rank fusion and evidence lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K, CHANNEL_K = 60, 20
#: Query vectors in a block, and documents in one: two blocks meet in one matrix product. What a block of documents keeps for each
#: query is a small share of it only where it is large.
BLOCK, DOCUMENTS = 1024, 4096


def unit(vector: Column) -> Column:
    """L2-normalized doubles; a zero vector is an error."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(F.raise_error(F.lit("zero vector"))))


def _filled(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[pa.RecordBatch]]:
    """Pieces of batches, `rows` rows together (the last may have fewer), however small the batches are."""
    parts, n = [], 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            c = b.slice(at, rows - n)
            parts.append(c)
            at, n = at + c.num_rows, n + c.num_rows
            if n == rows:
                yield parts
                parts, n = [], 0
    if parts:
        yield parts


def _blocks(df: DataFrame, key: str, group: str | None = None, rows: int = BLOCK) -> DataFrame:
    """Rows of unit vectors in blocks: (ids, groups, n, m), m being a matrix of doubles in bytes. Null vectors are out."""
    cols = [F.col(key), (F.lit(None) if group is None else F.col(group)).cast("string")]
    source = df.where(F.col("v").isNotNull() & F.col(key).isNotNull()).select(cols[0].cast("long").alias("i"), cols[1].alias("g"), unit(F.col("v")).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _filled(batches, rows):
            ids, groups = ([x for c in parts for x in c.column(i).to_pylist()] for i in (0, 1))
            m = b"".join(np.ascontiguousarray(c.column(2).flatten().to_numpy(zero_copy_only=False), np.float64).tobytes() for c in parts)
            one = [pa.array([ids], pa.list_(pa.int64())), pa.array([groups], pa.list_(pa.string())), pa.array([len(ids)], pa.int32()), pa.array([m], pa.binary())]
            yield pa.RecordBatch.from_arrays(one, names=["ids", "groups", "n", "m"])

    return source.mapInArrow(run, "ids array<long>, groups array<string>, n int, m binary")


def _met(queries: DataFrame, docs: DataFrame, group: str | None, rows: int) -> DataFrame:
    """Every block of queries beside every block of documents: a stated query set against all rows, in blocks. Neither
    side comes to the driver."""
    q = _blocks(queries, "query_id", rows=rows).select(*(F.col(c).alias(f"q_{c}") for c in ("ids", "n", "m")))
    return _blocks(docs, "doc_id", group, DOCUMENTS).crossJoin(q).select("q_ids", "q_n", "q_m", "ids", "groups", "n", "m")


def _similarities(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list, np.ndarray]]:
    for b in batches:
        q_ids, q_n, q_m, ids, groups, n, m = (b.column(i) for i in range(7))
        for i in range(b.num_rows):
            left = np.frombuffer(q_m[i].as_py()).reshape(q_n[i].as_py(), -1)
            right = np.frombuffer(m[i].as_py()).reshape(n[i].as_py(), -1)
            yield np.array(q_ids[i].as_py(), np.int64), np.array(ids[i].as_py(), np.int64), groups[i].as_py(), left @ right.T


def cosine_topk(queries: DataFrame, docs: DataFrame, k: int, n_queries_block: int = BLOCK) -> DataFrame:
    """(query_id, doc_id, sim, rank) of the k nearest documents of each query; ties go to the smaller id.

    queries (query_id, v) and docs (doc_id, v) hold vectors of one length; rows without an id or a vector are left
    out, zero vectors fail. Each block of queries meets each block of documents in one matrix product that keeps
    its best k; the best of all blocks are merged by key.
    """
    if k < 1:
        return queries.sparkSession.createDataFrame([], "query_id long, doc_id long, sim double, rank long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, doc, _, sims in _similarities(batches):
            # All that may be among the best k once rounded, ties too; only these are put in order.
            least = np.partition(sims, -min(k, sims.shape[1]), axis=1)[:, -min(k, sims.shape[1])] - 2e-9
            rows, cols = np.nonzero(sims >= least[:, None])
            order = np.lexsort((doc[cols], -np.round(sims[rows, cols], 9), rows))
            rows, cols = rows[order], cols[order]
            nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
            rows, cols = rows[nth < k], cols[nth < k]
            yield pa.RecordBatch.from_arrays([pa.array(q[rows]), pa.array(doc[cols]), pa.array(sims[rows, cols])], names=["query_id", "doc_id", "sim"])

    out = _met(queries, docs, None, n_queries_block).mapInArrow(run, "query_id long, doc_id long, sim double")
    w = Window.partitionBy("query_id").orderBy(F.round("sim", 9).desc(), "doc_id")
    return out.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def cosine_families(queries: DataFrame, docs: DataFrame, family: str = "family_id", n_queries_block: int = BLOCK) -> DataFrame:
    """(query_id, family, sim, view): each family's best document for each query, the smallest id on ties. A block
    keeps one row for each query and family, so no pair of a query and a document is ever a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, doc, groups, sims in _similarities(batches):
            names, at = np.unique(np.array([g if g is not None else "" for g in groups], object).astype(str), return_inverse=True)
            by = np.lexsort((doc, at))
            starts = np.searchsorted(at[by], np.arange(len(names)))
            s = np.round(sims, 9)[:, by]
            top = np.repeat(np.maximum.reduceat(s, starts, axis=1), np.diff([*starts, len(by)]), axis=1)
            first = by[np.minimum.reduceat(np.where(s == top, np.arange(len(by)), len(by)), starts, axis=1)]  # so the smallest id
            rows = np.repeat(np.arange(len(q)), len(names))
            cols = [q[rows], pa.array(names.tolist() * len(q), pa.string()), sims[rows, first.ravel()], doc[first.ravel()]]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], names=["query_id", family, "sim", "view"])

    rows = _met(queries, docs.where(F.col(family).isNotNull()), family, n_queries_block).mapInArrow(run, f"query_id long, `{family}` string, sim double, view long")
    best = F.max_by(F.struct("sim", "view"), F.struct(F.round("sim", 9), -F.col("view"))).alias("b")
    return rows.groupBy("query_id", family).agg(best).select("query_id", family, "b.sim", "b.view")


def cosine_pairs(pairs: DataFrame, a: str = "qv", b: str = "dv") -> DataFrame:
    """Add sim to rows that hold both vectors."""
    dot = F.aggregate(F.zip_with(unit(F.col(a)), unit(F.col(b)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return pairs.withColumn("sim", dot)


def max_over_views(sims: DataFrame, family: str = "family_id", view: str = "doc_id") -> DataFrame:
    """(query_id, family, sim, view) of each family's best view, the smallest on ties."""
    best = F.max_by(F.struct("sim", F.col(view).alias("view")), F.struct(F.round("sim", 9), -F.col(view))).alias("b")
    return sims.groupBy("query_id", family).agg(best).select("query_id", family, "b.sim", "b.view")


def rrf(lexical: DataFrame, dense: DataFrame, key: str = "family_id", k: int = RRF_K, channel: int = CHANNEL_K) -> DataFrame:
    """Reciprocal rank fusion of two rankings (query_id, key, rank), with their ranks, and the score over the
    query's best."""
    cut = lambda d, name: d.where(F.col("rank") <= channel).select("query_id", key, F.col("rank").alias(name))
    both = cut(lexical, "lexical_rank").join(cut(dense, "dense_rank"), ["query_id", key], "full_outer")
    part = lambda r: F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0))
    both = both.withColumn("rrf", part("lexical_rank") + part("dense_rank"))
    return both.withColumn("score", F.col("rrf") / F.max("rrf").over(Window.partitionBy("query_id")))


def interleave(a: DataFrame, b: DataFrame, limit: int, key: str = "family_id") -> DataFrame:
    """Two rankings in turn by rank, the first first, each key once, ranked anew up to limit."""
    both = a.select("query_id", key, "rank", F.lit(0).alias("src")).unionByName(b.select("query_id", key, "rank", F.lit(1).alias("src")))
    one = both.groupBy("query_id", key).agg(F.min(F.struct("rank", "src")).alias("m"))
    w = Window.partitionBy("query_id").orderBy("m.rank", "m.src", key)
    return one.select("query_id", key, F.row_number().over(w).cast("long").alias("rank"), F.col("m.src").alias("src")).where(F.col("rank") <= limit)


def cross_view_consensus(raw: DataFrame, hint: DataFrame, seen: DataFrame, window: int = 8, limit: int = 1, key: str = "family_id") -> DataFrame:
    """Keys in the first `window` of both rankings and not seen, by rank sum, then either rank."""
    cut = lambda d, name: d.where(F.col("rank") <= window).select("query_id", key, F.col("rank").alias(name))
    both = cut(raw, "raw_rank").join(cut(hint, "hint_rank"), ["query_id", key]).join(seen, ["query_id", key], "left_anti")
    w = Window.partitionBy("query_id").orderBy(F.col("raw_rank") + F.col("hint_rank"), "raw_rank", "hint_rank")
    return both.withColumn("nth", F.row_number().over(w).cast("long")).where(F.col("nth") <= limit)


def early_stop(ranked: DataFrame, verdict: str = "verdict", most: int = 2) -> DataFrame:
    """Verdicts in rank order until the first SUPPORTED, at most `most` of them; later ones are unknown."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max((F.col(verdict) == "SUPPORTED").cast("int")).over(w), F.lit(0)) == 1
    return ranked.withColumn("consulted", ~done & (F.col("rank") <= most)).withColumn("seen_verdict", F.when(F.col("consulted"), F.col(verdict)))


def exactly_n(ranked: DataFrame, n: int, verdict: str = "verdict") -> DataFrame:
    """The first n SUPPORTED within the budget min(20, max(2, 2n)), or nothing for the query."""
    ok = ranked.where((F.col("rank") <= min(20, max(2, 2 * n))) & (F.col(verdict) == "SUPPORTED"))
    w = Window.partitionBy("query_id")
    ok = ok.withColumn("nth", F.row_number().over(w.orderBy("rank")).cast("long")).withColumn("found", F.count(F.lit(1)).over(w))
    return ok.where((F.col("nth") <= n) & (F.col("found") >= n)).drop("found")
