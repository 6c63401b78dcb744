"""Blocks of vectors: full whatever the batches, and the same best documents as all pairs in order."""

import numpy as np

from groundphrase.operators import dense


def test_few_kept_of_large_blocks(spark):
    rng = np.random.default_rng(4)
    v = rng.integers(-2, 3, (2500, 4)).astype(float)  # many ties
    v[(v == 0).all(1)] = 1.0
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, v array<double>").coalesce(1)
    q = d.where("doc_id % 50 = 0").select(d.doc_id.alias("query_id"), "v")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        assert sorted(r.n for r in dense._blocks(d, "doc_id", rows=1000).collect()) == [500, 1000, 1000]
        assert dense._met(q, d, None, dense.BLOCK).count() == 1  # ten times as many rows were kept in blocks of 256
        got = [tuple(r) for r in dense.cosine_topk(q, d, 7).orderBy("query_id", "rank").select("query_id", "doc_id", "rank").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    u = v / np.sqrt((v * v).sum(1, keepdims=True))
    expected = [(i, int(j), n + 1) for i in range(0, 2500, 50) for n, j in enumerate(np.lexsort((np.arange(2500), -np.round(u @ u[i], 9)))[:7])]
    assert got == expected
