"""Surface retrieval: exact, partial and contained matches, fused evidence, rescoring, one result a family."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundphrase.functions import text as tx
from groundphrase.operators import index as ix
from groundphrase.operators import store

EXACT, PARTIAL = 1.0, 0.99
WEIGHTS = {"tfidf": 1.0, "coverage": 0.30, "bm25": 0.35, "fuzzy": 0.40}
#: Candidates of each signal that fusion keeps.
POOL = 128


def _compact(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, tx.compact(tx.retrieval(F.col("text"))).alias("c"))


def exact(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of equal compact forms."""
    q, d = _compact(queries, "query_id").where("c <> ''"), _compact(docs, "doc_id")
    return q.join(d, "c").select("query_id", "doc_id", F.lit(EXACT).alias("score"))


def partial(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of queries inside a document's compact form.

    Whatever holds a query holds its rarest trigram, so an equi-join on that finds all candidates.
    """
    q, d = _compact(queries, "query_id").where(F.length("c") >= ix.LEAST_COMPACT), _compact(docs, "doc_id")
    grams = d.select("doc_id", F.col("c").alias("d"), F.explode(F.array_distinct(tx.char_ngrams(F.col("c")))).alias("gram"))
    df = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    each = q.select("query_id", "c", F.explode(F.array_distinct(tx.char_ngrams(F.col("c")))).alias("gram")).join(df, "gram", "left")
    rare = each.groupBy("query_id", "c").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("r")).where("r.df > 0")
    hits = rare.select("query_id", "c", "r.gram").join(grams, "gram").where(F.expr("instr(d, c) > 0"))
    return hits.select("query_id", "doc_id", F.lit(PARTIAL).alias("score"))


def surface(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Exact matches; partial ones only for queries without any."""
    e = exact(queries, docs)
    return e.unionByName(partial(queries, docs).join(e.select("query_id").distinct(), "query_id", "left_anti"))


#: Letters of all variants together up to which every worker holds an automaton of them; beyond, texts meet variants
#: by a join on their first letters.
DICTIONARY = 8 << 20


def contained(texts: DataFrame, variants: DataFrame, key: str = "query_id", dictionary: int = DICTIONARY) -> DataFrame:
    """(key, family_id, first_pos): families one of whose variants (LEAST_COMPACT letters or more) stands in a
    text, with the first place (from 1). A text that is a variant itself has only its own families.

    Texts never meet variants all with all: one pass of an automaton finds them, or, where the variants' checked
    size is over `dictionary` letters, a join on first letters does.
    """
    n = ix.LEAST_COMPACT
    t = _compact(texts, key)
    v = variants.select("family_id", tx.compact(tx.retrieval(F.col("text"))).alias("v")).where(F.length("v") >= n).distinct()
    if (v.agg(F.sum(F.length("v"))).first()[0] or 0) <= dictionary:
        return _found(t, v, key)
    v = v.withColumn("head", F.substring("v", 1, n))
    own = t.join(v, t["c"] == v["v"]).select(key, "family_id", F.lit(1).alias("pos"))
    heads = t.join(own.select(key).distinct(), key, "left_anti").select(key, "c", F.posexplode(tx.char_ngrams(F.col("c"), n)).alias("at", "head"))
    inside = heads.join(v, "head").where(F.expr("substring(c, at + 1, length(v)) = v")).select(key, "family_id", (F.col("at") + 1).alias("pos"))
    return own.unionByName(inside).groupBy(key, "family_id").agg(F.min("pos").cast("long").alias("first_pos"))


def _found(t: DataFrame, v: DataFrame, key: str) -> DataFrame:
    families: dict[str, list[str]] = {}
    for r in v.collect():  # checked: DICTIONARY letters at most
        families.setdefault(r.v, []).append(r.family_id)
    kind = t.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for x, fs in families.items():
            machine.add_word(x, (len(x), fs))
        if families:
            machine.make_automaton()
        for b in batches:
            rows, keys, fams, places = b.column(0), [], [], []
            for i, c in enumerate(b.column(1).to_pylist()):
                if not c or not families:
                    continue
                first: dict[str, int] = {f: 1 for f in families.get(c, ())}
                if not first:
                    for last, (n, fs) in machine.iter(c):
                        for f in fs:
                            first[f] = min(first.get(f, last - n + 2), last - n + 2)
                keys += [i] * len(first)
                fams += first
                places += first.values()
            yield pa.RecordBatch.from_arrays([rows.take(pa.array(keys, pa.int32())), pa.array(fams, pa.string()), pa.array(places, pa.int64())], names=[key, "family_id", "first_pos"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("family_id", T.StringType()), T.StructField("first_pos", T.LongType())])
    return t.mapInArrow(run, schema).groupBy(key, "family_id").agg(F.min("first_pos").alias("first_pos"))


def noisy_or(**evidence: Column) -> Column:
    out = F.lit(1.0)
    for name, e in evidence.items():
        out *= 1 - WEIGHTS[name] * F.coalesce(e, F.lit(0.0))
    return 1 - out


def consensus(score: Column, t: Column, c: Column, b: Column, f: Column, n_compact: Column, n_tokens: Column) -> Column:
    """Lift a score where independent signals agree."""
    target = lambda *xs: F.least(F.lit(1.0), 0.86 + 0.06 * sum(xs[1:], xs[0]) / len(xs))
    rules = (
        F.when((t >= 0.28) & (c >= 0.82) & (f >= 0.90), target(t, c, f)),
        F.when((n_tokens >= 2) & (t >= 0.28) & (c >= 0.68) & (b >= 0.90) & (f >= 0.85), target(t, c, b, f)),
        F.when((n_compact >= 12) & (n_tokens >= 3) & (t >= 0.60) & (c >= 0.75) & (b >= 0.78), target(t, c, b)),
    )
    return F.when(n_compact >= ix.LEAST_COMPACT, F.greatest(score, *rules)).otherwise(score)


class Indexes:
    """A corpus's indexes, each made and written once, for all steps that look something up in it."""

    def __init__(self, docs: DataFrame):
        self.docs, self._made = docs, {}

    def _once(self, name: str, make):
        if name not in self._made:
            self._made[name] = make(self.docs)
        return self._made[name]

    def postings(self, signals: str) -> tuple[DataFrame, int]:
        """The postings of some signals, and how many there are."""

        def make(docs):
            p = store.stored(ix.postings(docs, signals), "index")
            return p, p.count()

        return self._once(signals, make)

    @property
    def n(self) -> int:
        return self._once("n", lambda docs: docs.count())


#: Postings in a block of documents, which every task holds, and pairs of a query and a document that one task scores.
POSTINGS, PAIRS = 1 << 18, 100_000


def _items(rows: DataFrame, keys: list[str], signals: str) -> DataFrame:
    """(keys..., item, tf): trigrams, bigrams and tokens of `text`, marked by their signal."""
    r = rows.select(*keys, tx.retrieval(F.col("text")).alias("_r")).withColumn("_c", tx.compact(F.col("_r")))
    none = F.array().cast("array<string>")
    of = {"t": tx.char_ngrams(F.col("_r")), "c": F.when(F.length("_c") >= ix.LEAST_COMPACT, tx.bigram_set(F.col("_c"))), "b": F.array_distinct(tx.tokens(F.col("_r")))}
    marked = lambda s: F.transform(F.coalesce(of[s], none), lambda g: F.concat(F.lit(s), g))
    return r.select(*keys, F.explode(F.concat(*map(marked, signals))).alias("item")).groupBy(*keys, "item").agg(F.count(F.lit(1)).alias("tf"))


def _constants(n_docs: int) -> list[Column]:
    """What a query's scores are divided by, over its items and their idf (null outside the corpus)."""
    of = lambda s, x: F.sum(F.when(F.substring("item", 1, 1) == s, x))
    w = F.col("tf") * F.col("idf")
    return [F.sqrt(of("t", w * w)).alias("_q_norm"), of("c", F.coalesce("idf", F.log(F.lit(1.0 + n_docs)))).alias("_total"), of("b", F.col("idf")).alias("_known")]


_SUMS = [F.sum, F.max, F.sum, F.sum, F.count]
_WHAT = ["_dot", "_norm", "_got", "raw", "_terms"]


def _sums() -> list[Column]:
    return [f(c).alias(name) for f, c, name in zip(_SUMS, (F.col("tf") * F.col("t"), F.col("norm"), F.col("c"), F.col("b"), F.col("b")), _WHAT, strict=True)]


def _scores() -> list[Column]:
    e = F.least(F.lit(1.0), F.col("raw") / F.col("_known"))
    bm25 = F.when(F.col("_terms") > 0, F.when(F.col("_terms") < 2, F.least(e, F.lit(0.15))).otherwise(e))
    return [(F.col("_dot") / (F.col("_q_norm") * F.col("_norm"))).alias("tfidf"), (F.col("_got") / F.col("_total")).alias("coverage"), F.when(bm25 > 0, bm25).alias("bm25"), "raw"]


def scores(queries: DataFrame, docs: DataFrame, signals: str = "tcb", keep: Callable[[DataFrame], DataFrame] | None = None, indexes: Indexes | None = None) -> DataFrame:
    """(query_id, doc_id, tfidf, coverage, bm25, raw) of every pair that shares an item; a score is null where it has none.

    signals: t (trigrams' cosine), c (bigrams' coverage), b (BM25). Requests are dealt by their ids once, as texts;
    documents come to them in blocks of a bounded size, so neither items nor pairs are ever shuffled. keep, if
    given, is put to the pairs of each block and then to what all blocks have kept (as the best few of a query are).
    """
    found = indexes or Indexes(docs)
    postings, size = found.postings(signals)
    blocks = max(1, -(-size // POSTINGS))
    q = queries.select("query_id", "text")
    parts = -(-q.count() * found.n // (blocks * PAIRS))
    q = q.repartition(max(int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts), "query_id")
    items = _items(q, ["query_id"], signals)
    known = postings.select("item", "idf").distinct()
    constants = items.join(F.broadcast(known) if blocks == 1 else known, "item", "left").groupBy("query_id").agg(*_constants(found.n))
    out = None
    for k in range(blocks):
        block = postings if blocks == 1 else postings.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == k)
        pairs = items.join(F.broadcast(block), "item").groupBy("query_id", "doc_id").agg(*_sums())
        pairs = pairs.join(constants, "query_id").select("query_id", "doc_id", *_scores())
        pairs = pairs if keep is None else keep(pairs)
        out = pairs if out is None else out.unionByName(pairs)
    return out if keep is None or blocks == 1 else keep(out)


def tfidf(queries: DataFrame, docs: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) by the cosine of trigrams; k: the best of each query."""
    best = lambda s: ix.ranked(s.drop("rank"), "tfidf", k)
    s = scores(queries, docs, "t", None if k is None else best)
    return (best(s) if k is None else s).select("query_id", "doc_id", F.col("tfidf").alias("score"), "rank")


def paired(rows: DataFrame, keys: list[str], indexes: Indexes) -> DataFrame:
    """(keys..., tfidf, coverage, bm25, 0 where there is none) of rows that hold a text and, among their keys, the only
    document (doc_id) that it meets. Rows stay in their partitions if these go by one of the keys."""
    postings, size = indexes.postings("tcb")
    near = F.broadcast if size <= POSTINGS else lambda df: df
    items = _items(rows, keys, "tcb").join(near(postings.select("item", "idf").distinct()), "item", "left")
    met = items.join(near(postings.drop("idf")), ["item", "doc_id"], "left")
    zero = lambda x: F.coalesce(x, F.lit(0.0)).alias(x)
    got = met.groupBy(*keys).agg(*_constants(indexes.n), *_sums()).select(*keys, *_scores())
    # Coverage counts only where trigrams or words agree.
    return got.select(*keys, zero("tfidf"), F.when(F.col("tfidf").isNull(), 0.0).otherwise(F.coalesce("coverage", F.lit(0.0))).alias("coverage"), zero("bm25"))


def evidence(queries: DataFrame, docs: DataFrame, pool: int | None = POOL, pairs: DataFrame | None = None, indexes: Indexes | None = None) -> DataFrame:
    """(query_id, doc_id, tfidf, coverage, bm25): candidates are the best of TF-IDF and of BM25; coverage counts
    only for documents that TF-IDF found. pairs (query_id, doc_id): the only ones that are wanted."""
    found = indexes or Indexes(docs)
    if pairs is not None:
        rows = pairs.select("query_id", "doc_id").distinct().join(queries.select("query_id", "text"), "query_id")
        return paired(rows, ["query_id", "doc_id"], found).where("tfidf > 0 or bm25 > 0")

    def best(s: DataFrame) -> DataFrame:
        for name in ("tfidf", "bm25") if pool is not None else ():
            w = Window.partitionBy("query_id").orderBy(F.round(name, 9).desc(), "doc_id")
            s = s.withColumn("_nth", F.row_number().over(w)).withColumn(name, F.when(F.col("_nth") <= pool, F.col(name))).drop("_nth")
        return s.where("tfidf is not null or bm25 is not null")

    both = scores(queries, docs, "tcb", best, found)
    zero = lambda x: F.coalesce(x, F.lit(0.0)).alias(x)
    return both.select("query_id", "doc_id", zero("tfidf"), F.when(F.col("tfidf").isNull(), 0.0).otherwise(F.coalesce("coverage", F.lit(0.0))).alias("coverage"), zero("bm25"))


def fused(queries: DataFrame, docs: DataFrame, pool: int = POOL, indexes: Indexes | None = None) -> DataFrame:
    """Evidence with its noisy-or, lifted by consensus (without fuzzy evidence; see fuzzy.rerank)."""
    e = evidence(queries, docs, pool, indexes=indexes)
    q = queries.select("query_id", tx.retrieval(F.col("text")).alias("r")).select("query_id", F.length(tx.compact(F.col("r"))).alias("n_compact"), F.size(tx.tokens(F.col("r"))).alias("n_tokens"))
    e = e.join(q, "query_id")
    score = noisy_or(tfidf=F.col("tfidf"), coverage=F.col("coverage"), bm25=F.col("bm25"))
    return e.withColumn("score", consensus(score, F.col("tfidf"), F.col("coverage"), F.col("bm25"), F.lit(0.0), F.col("n_compact"), F.col("n_tokens")))


def rescore(base: Column, evidence_: Column, weight: float) -> Column:
    return F.least(F.lit(1.0), base + weight * evidence_ * (1 - base))


def best_of_family(ranked: DataFrame, variants: DataFrame, k: int | None = None) -> DataFrame:
    """The first row of each family in rank order, ranked anew."""
    r = ranked.join(variants.select("doc_id", "family_id"), "doc_id")
    first = r.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "family_id").orderBy("rank"))).where("nth = 1").drop("nth")
    out = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long"))
    return out if k is None else out.where(F.col("rank") <= k)


def top_two(ranked: DataFrame, score: str = "score") -> DataFrame:
    """(query_id, doc_id, top, margin): the best row and its lead over the second (over 0 if there is none)."""
    w = Window.partitionBy("query_id").orderBy("rank")
    r = ranked.withColumn("next", F.lead(score).over(w)).where("rank = 1")
    return r.select("query_id", "doc_id", F.col(score).alias("top"), F.greatest(F.lit(0.0), F.col(score) - F.coalesce("next", F.lit(0.0))).alias("margin"))
