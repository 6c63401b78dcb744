"""Lexical indexes over (doc_id, text) as DataFrames keyed by gram or token, and the scores they give.

Queries are (query_id, text). Nothing here is broadcast by hand: the optimizer sends a side only where its
measured size is under the session's threshold, so a large corpus or a large query log shuffles instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundphrase.functions import text as tx

K1, B = 1.2, 0.75
#: A query whose compact form is shorter has no coverage.
LEAST_COMPACT = 8


def _counted(df: DataFrame, key: str, items, name: str) -> DataFrame:
    return df.select(key, F.explode(items).alias(name)).groupBy(key, name).agg(F.count(F.lit(1)).alias("tf"))


def trigram_index(docs: DataFrame) -> DataFrame:
    """(gram, doc_id, tf, df, idf, weight, norm) with idf = ln(1 + N / (1 + df))."""
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    tf = _counted(docs, "doc_id", tx.char_ngrams(tx.retrieval(F.col("text"))), "gram")
    df = tf.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).crossJoin(n)  # n is one row
    idf = df.select("gram", "df", F.log(1 + F.col("n_docs") / (1 + F.col("df"))).alias("idf"))
    w = tf.join(idf, "gram").withColumn("weight", F.col("tf") * F.col("idf"))
    norm = w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return w.join(norm, "doc_id")


def _met(q: DataFrame, index: DataFrame, key: str, pairs: DataFrame | None) -> DataFrame:
    """Query items beside the index's rows of theirs; only of the documents in pairs (query_id, doc_id), if given."""
    return q.join(index, key) if pairs is None else q.join(pairs.select("query_id", "doc_id"), "query_id").join(index, [key, "doc_id"])


def tfidf(queries: DataFrame, index: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score): cosine; grams outside the corpus count for nothing. pairs: the only ones wanted."""
    idf = index.select("gram", "idf").distinct()
    q = _counted(queries, "query_id", tx.char_ngrams(tx.retrieval(F.col("text"))), "gram").join(idf, "gram").withColumn("qw", F.col("tf") * F.col("idf")).select("query_id", "gram", "qw")
    q_norm = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("q_norm"))
    dots = _met(q, index.select("gram", "doc_id", "weight", "norm"), "gram", pairs).groupBy("query_id", "doc_id").agg(F.sum(F.col("qw") * F.col("weight")).alias("dot"), F.first("norm").alias("norm"))
    return dots.join(q_norm, "query_id").select("query_id", "doc_id", (F.col("dot") / (F.col("q_norm") * F.col("norm"))).alias("score"))


def bigram_index(docs: DataFrame) -> DataFrame:
    """(gram, doc_id, idf) over sets of bigrams of the compact text."""
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    sets = docs.select("doc_id", F.explode(tx.bigram_set(tx.compact(tx.retrieval(F.col("text"))))).alias("gram"))
    df = sets.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).crossJoin(n)
    return sets.join(df.select("gram", F.log(1 + F.col("n_docs") / (1 + F.col("df"))).alias("idf")), "gram")


def coverage(queries: DataFrame, index: DataFrame, n_docs: int, pairs: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, coverage): share of the query's bigram weight that a document holds; unknown bigrams
    weigh ln(1 + N). Only queries of LEAST_COMPACT letters and pairs that share a bigram have a row."""
    q = queries.select("query_id", tx.compact(tx.retrieval(F.col("text"))).alias("c")).where(F.length("c") >= LEAST_COMPACT)
    q = q.select("query_id", F.explode(tx.bigram_set(F.col("c"))).alias("gram"))
    weighed = q.join(index.select("gram", "idf").distinct(), "gram", "left").withColumn("idf", F.coalesce("idf", F.log(F.lit(1.0 + n_docs))))
    total = weighed.groupBy("query_id").agg(F.sum("idf").alias("total"))
    got = _met(q, index, "gram", pairs).groupBy("query_id", "doc_id").agg(F.sum("idf").alias("got"))
    return got.join(total, "query_id").select("query_id", "doc_id", (F.col("got") / F.col("total")).alias("coverage"))


def token_index(docs: DataFrame) -> DataFrame:
    """(token, doc_id, tf, dl, avgdl, idf) with idf = ln(1 + (N - df + .5) / (df + .5))."""
    toks = docs.select("doc_id", tx.tokens(tx.retrieval(F.col("text"))).alias("toks")).withColumn("dl", F.size("toks"))
    n = toks.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    tf = toks.select("doc_id", "dl", F.explode("toks").alias("token")).groupBy("doc_id", "dl", "token").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df")).crossJoin(n)
    return tf.join(df.select("token", "avgdl", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), "token")


def bm25(queries: DataFrame, index: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, raw, evidence): evidence is raw over the known terms' idf, 1 at most, and 0.15 at most
    where fewer than two terms match."""
    q = queries.select("query_id", F.explode(F.array_distinct(tx.tokens(tx.retrieval(F.col("text"))))).alias("token"))
    known = q.join(index.select("token", "idf").distinct(), "token").groupBy("query_id").agg(F.sum("idf").alias("total"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    got = _met(q, index, "token", pairs).groupBy("query_id", "doc_id").agg(F.sum(part).alias("raw"), F.count(F.lit(1)).alias("terms"))
    e = F.least(F.lit(1.0), F.col("raw") / F.col("total"))
    return got.join(known, "query_id").select("query_id", "doc_id", "raw", F.when(F.col("terms") < 2, F.least(e, F.lit(0.15))).otherwise(e).alias("evidence"))


def postings(docs: DataFrame, signals: str = "tcb") -> DataFrame:
    """(item, doc_id, idf, t, norm, c, b): what each trigram (t), bigram (c) and token (b) of a document adds to the sums of a
    query that holds it, items marked by their signal: to the dot product (for each time the query has it), to what is
    covered, and to BM25."""
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    made = {"t": lambda: (trigram_index(docs), "gram", {"t": F.col("idf") * F.col("weight"), "norm": F.col("norm")}), "c": lambda: (bigram_index(docs), "gram", {"c": F.col("idf")}), "b": lambda: (token_index(docs), "token", {"b": part})}
    out = None
    for s in signals:
        rows, item, adds = made[s]()
        rows = rows.select(F.concat(F.lit(s), item).alias("item"), "doc_id", "idf", *(adds.get(c, F.lit(None)).cast("double").alias(c) for c in ("t", "norm", "c", "b")))
        out = rows if out is None else out.unionByName(rows)
    return out


def token_families(variants: DataFrame) -> DataFrame:
    """(token, n_families, distinctive, unique)."""
    t = variants.select("family_id", F.explode(tx.tokens(tx.retrieval(F.col("text")))).alias("token"))
    n = t.groupBy("token").agg(F.count_distinct("family_id").alias("n_families"))
    return n.select("token", "n_families", (F.col("n_families") <= 2).alias("distinctive"), (F.col("n_families") == 1).alias("unique_family"))


def ranked(scores: DataFrame, score: str = "score", k: int | None = None, key: str = "query_id", tie: str = "doc_id") -> DataFrame:
    """Add rank by score (9 places), then id; keep k of each query if asked for. A k under 1 keeps none."""
    w = Window.partitionBy(key).orderBy(F.round(F.col(score), 9).desc(), tie)
    out = scores.withColumn("rank", F.row_number().over(w).cast("long"))
    return out if k is None else out.where(F.col("rank") <= k)
