"""Queries over the lexical and dense indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundphrase.functions import text as tx
from groundphrase.operators import dense, index, lexical
from groundphrase.operators.attest import SUGGESTIONS, attest, suggestions
from groundphrase.plans import bindings as b
from groundphrase.plans.bindings import VIEWS, compact, grams, norm

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def six(c: str):
    return F.round(c, 6).alias(c)


ATTEST = f"""rq AS (SELECT query_id, {norm('text')} AS r, {compact('text')} AS c FROM requests),
vr AS (SELECT {norm('text')} AS r, min(doc_id) AS by_form FROM variants GROUP BY 1), vc AS (SELECT {compact('text')} AS c, min(doc_id) AS by_compact FROM variants GROUP BY 1),
attested AS (SELECT query_id,
  CASE WHEN length(c) < 4 THEN 'NEEDS_CLARIFICATION' WHEN by_form IS NOT NULL OR by_compact IS NOT NULL THEN 'ATTESTED' ELSE 'NOT_ATTESTED' END AS status,
  CASE WHEN c = '' THEN 'empty-expression' WHEN length(c) < 4 THEN 'expression-too-short' WHEN by_form IS NOT NULL THEN 'normalized-corpus-match' WHEN by_compact IS NOT NULL THEN 'compact-corpus-match' ELSE 'no-corpus-match' END AS reason,
  CASE WHEN length(c) >= 4 THEN coalesce(by_form, by_compact) END AS doc_id FROM rq LEFT JOIN vr USING (r) LEFT JOIN vc USING (c))"""
TRI = f"""ndocs AS (SELECT count(*) AS n FROM variants), dtf AS (SELECT doc_id, g, count(*) AS tf FROM (SELECT doc_id, unnest({grams(norm('text'), 3)}) AS g FROM variants) GROUP BY 1, 2),
idf AS (SELECT g, count(*) AS df, ln(1 + any_value(n) / (1 + count(*))) AS idf FROM dtf, ndocs GROUP BY g),
dw AS (SELECT doc_id, g, tf * idf AS w FROM dtf JOIN idf USING (g)), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM dw GROUP BY 1),
qw AS (SELECT query_id, g, tf * idf AS w FROM (SELECT query_id, g, count(*) AS tf FROM (SELECT query_id, unnest({grams(norm('text'), 3)}) AS g FROM requests) GROUP BY 1, 2) JOIN idf USING (g)),
qn AS (SELECT query_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY 1),
tfidf AS (SELECT query_id, doc_id, dot / (qn.norm * dn.norm) AS tfidf FROM (SELECT query_id, doc_id, sum(qw.w * dw.w) AS dot FROM qw JOIN dw USING (g) GROUP BY 1, 2) JOIN qn USING (query_id) JOIN dn USING (doc_id)),
trank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(tfidf, 9) DESC, doc_id) AS rank FROM tfidf)"""
COV = f"""bset AS (SELECT doc_id, unnest(list_distinct({grams(compact('text'), 2)})) AS g FROM variants), bidf AS (SELECT g, ln(1 + any_value(n) / (1 + count(*))) AS idf FROM bset, ndocs GROUP BY g),
qset AS (SELECT query_id, unnest(list_distinct({grams(compact('text'), 2)})) AS g FROM requests WHERE length({compact('text')}) >= 8),
qtot AS (SELECT query_id, sum(coalesce(idf, ln(1 + n))) AS total FROM qset LEFT JOIN bidf USING (g), ndocs GROUP BY 1),
cov AS (SELECT query_id, doc_id, sum(idf) / any_value(total) AS coverage FROM qset JOIN bset USING (g) JOIN bidf USING (g) JOIN qtot USING (query_id) GROUP BY 1, 2)"""
BM = f"""vt AS (SELECT doc_id, list_filter(string_split({norm('text')}, ' '), lambda x: x <> '') AS t FROM variants), avgdl AS (SELECT avg(len(t)) AS a, count(*) AS n FROM vt),
vtf AS (SELECT doc_id, dl, k, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS k FROM vt) GROUP BY 1, 2, 3),
kidf AS (SELECT k, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM vtf, avgdl GROUP BY k),
qk AS (SELECT query_id, unnest(list_distinct(list_filter(string_split({norm('text')}, ' '), lambda x: x <> ''))) AS k FROM requests),
qknown AS (SELECT query_id, sum(idf) AS total FROM qk JOIN kidf USING (k) GROUP BY 1),
bm AS (SELECT query_id, doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS raw, count(*) AS terms FROM qk JOIN vtf USING (k) JOIN kidf USING (k), avgdl GROUP BY 1, 2),
bme AS (SELECT query_id, doc_id, raw, CASE WHEN terms < 2 THEN least(least(1.0, raw / total), 0.15) ELSE least(1.0, raw / total) END AS bm25 FROM bm JOIN qknown USING (query_id)),
brank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, doc_id) AS rank FROM bme WHERE bm25 > 0)"""
SURFACE = f"""qc AS (SELECT query_id, {compact('text')} AS c FROM requests), vcc AS (SELECT doc_id, {compact('text')} AS d FROM variants),
ex AS (SELECT query_id, doc_id, 1.0::DOUBLE AS score FROM qc JOIN vcc ON c = d WHERE c <> ''),
pa AS (SELECT query_id, doc_id, 0.99::DOUBLE AS score FROM qc, vcc WHERE length(c) >= 8 AND contains(d, c))"""
FUSED = f"""t128 AS (SELECT query_id, doc_id, tfidf FROM trank WHERE rank <= 128), b128 AS (SELECT query_id, doc_id, bm25 FROM brank WHERE rank <= 128),
ev AS (SELECT query_id, doc_id, coalesce(tfidf, 0) AS tfidf, CASE WHEN tfidf IS NULL THEN 0 ELSE coalesce(coverage, 0) END AS coverage, coalesce(bm25, 0) AS bm25 FROM t128 FULL JOIN b128 USING (query_id, doc_id) LEFT JOIN cov USING (query_id, doc_id)),
fs AS (SELECT *, 1 - (1 - tfidf) * (1 - 0.3 * coverage) * (1 - 0.35 * bm25) AS raw FROM ev JOIN (SELECT query_id, length({compact('text')}) AS nc, len(list_filter(string_split({norm('text')}, ' '), lambda x: x <> '')) AS nt FROM requests) USING (query_id)),
fused AS (SELECT query_id, doc_id, tfidf, coverage, bm25, CASE WHEN nc >= 12 AND nt >= 3 AND tfidf >= 0.6 AND coverage >= 0.75 AND bm25 >= 0.78 THEN greatest(raw, least(1.0, 0.86 + 0.06 * (tfidf + coverage + bm25) / 3)) ELSE raw END AS score FROM fs),
frank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM fused)"""
LEX = f"{VIEWS}, {TRI}, {COV}, {BM}, {FUSED}"


def _fused(spark, sf):
    return index.ranked(lexical.fused(b.requests(spark, sf), b.variants(spark, sf)))


@query(f"WITH {VIEWS}, {ATTEST} SELECT * FROM attested")
def attestation_status(spark, sf):
    return attest(b.requests(spark, sf), b.variants(spark, sf))


@query(f"WITH {VIEWS}, {ATTEST}, {TRI} SELECT query_id, doc_id, rank, round(tfidf, 6) AS score FROM trank WHERE rank <= 3 AND query_id IN (SELECT query_id FROM attested WHERE status = 'NOT_ATTESTED') AND query_id IN (SELECT query_id FROM trank WHERE rank = 1 AND tfidf >= 0.45)")
def attestation_suggestions(spark, sf):
    r, v = b.requests(spark, sf), b.variants(spark, sf)
    return suggestions(attest(r, v), lexical.tfidf(r, v, SUGGESTIONS)).withColumn("score", F.round("score", 6))


@query(f"WITH {VIEWS}, {TRI} SELECT g AS gram, df::BIGINT AS df, round(idf, 6) AS idf FROM idf")
def trigram_df_idf(spark, sf):
    return index.trigram_index(b.variants(spark, sf)).select("gram", "df", six("idf")).distinct()


@query(f"WITH {VIEWS}, {TRI} SELECT doc_id, round(norm, 6) AS norm FROM dn")
def doc_norms(spark, sf):
    return index.trigram_index(b.variants(spark, sf)).groupBy("doc_id").agg(F.round(F.max("norm"), 6).alias("norm"))


@query(f"WITH {VIEWS}, {BM} SELECT k AS token, round(idf, 6) AS idf, round(a, 6) AS avgdl FROM kidf, avgdl")
def bm25_stats(spark, sf):
    return index.token_index(b.variants(spark, sf)).select("token", six("idf"), six("avgdl")).distinct()


@query(f"WITH {VIEWS}, t AS (SELECT family_id, unnest(list_filter(string_split({norm('text')}, ' '), lambda x: x <> '')) AS token FROM variants) SELECT token, count(DISTINCT family_id)::BIGINT AS n_families, count(DISTINCT family_id) <= 2 AS distinctive, count(DISTINCT family_id) = 1 AS unique_family FROM t GROUP BY 1")
def token_family_index(spark, sf):
    return index.token_families(b.variants(spark, sf))


@query(f"WITH {VIEWS}, {SURFACE} SELECT * FROM ex")
def exact_compact(spark, sf):
    return lexical.exact(b.requests(spark, sf), b.variants(spark, sf))


@query(f"WITH {VIEWS}, {SURFACE} SELECT * FROM pa")
def partial_substring(spark, sf):
    return lexical.partial(b.requests(spark, sf), b.variants(spark, sf))


@query(f"WITH {VIEWS}, {SURFACE} SELECT * FROM ex UNION ALL SELECT * FROM pa WHERE query_id NOT IN (SELECT query_id FROM ex)")
def surface_search(spark, sf):
    return lexical.surface(b.requests(spark, sf), b.variants(spark, sf))


@query(f"WITH {VIEWS}, d AS (SELECT doc_id, {compact('text')} AS c FROM documents), v AS (SELECT DISTINCT family_id, {compact('text')} AS v FROM variants WHERE length({compact('text')}) >= 8) SELECT doc_id, family_id, min(instr(c, v))::BIGINT AS first_pos FROM d JOIN v ON contains(c, v) GROUP BY 1, 2")
def contained_families(spark, sf):
    return lexical.contained(b.table(spark, sf, "documents").select("doc_id", "text"), b.variants(spark, sf), "doc_id")


@query(f"WITH {VIEWS}, {TRI} SELECT query_id, doc_id, round(tfidf, 6) AS score, rank FROM trank WHERE rank <= 5")
def tfidf_topk(spark, sf):
    return lexical.tfidf(b.requests(spark, sf), b.variants(spark, sf), 5).withColumn("score", F.round("score", 6)).select("query_id", "doc_id", "score", "rank")


@query(f"WITH {VIEWS}, {TRI}, {COV} SELECT query_id, doc_id, round(coverage, 6) AS coverage FROM cov WHERE coverage >= 0.2")
def coverage_scores(spark, sf):
    v = b.variants(spark, sf)
    return index.coverage(b.requests(spark, sf), index.bigram_index(v), v.count()).where("coverage >= 0.2").withColumn("coverage", F.round("coverage", 6))


@query(f"WITH {VIEWS}, {BM} SELECT query_id, doc_id, round(raw, 6) AS raw, round(bm25, 6) AS evidence, rank FROM brank WHERE rank <= 5")
def bm25_topk(spark, sf):
    e = index.bm25(b.requests(spark, sf), index.token_index(b.variants(spark, sf))).where("evidence > 0")
    return index.ranked(e, "evidence", 5).select("query_id", "doc_id", six("raw"), six("evidence"), "rank")


@query(f"WITH {LEX} SELECT query_id, doc_id, round(tfidf, 6) AS tfidf, round(coverage, 6) AS coverage, round(bm25, 6) AS bm25, round(score, 6) AS score, rank FROM frank WHERE rank <= 5")
def noisy_or_fusion(spark, sf):
    return _fused(spark, sf).where("rank <= 5").select("query_id", "doc_id", six("tfidf"), six("coverage"), six("bm25"), six("score"), "rank")


@query(f"WITH {LEX} SELECT query_id, doc_id, round(least(1.0, a + 0.35 * bm25 * (1 - a)), 6) AS score FROM (SELECT query_id, doc_id, least(1.0, tfidf + 0.3 * coverage * (1 - tfidf)) AS a, bm25 FROM ev)")
def rescore_chain(spark, sf):
    e = lexical.evidence(b.requests(spark, sf), b.variants(spark, sf))
    return e.select("query_id", "doc_id", F.round(lexical.rescore(lexical.rescore(F.col("tfidf"), F.col("coverage"), 0.30), F.col("bm25"), 0.35), 6).alias("score"))


@query(f"WITH {LEX}, one AS (SELECT *, row_number() OVER (PARTITION BY query_id, family_id ORDER BY rank) AS nth FROM frank JOIN (SELECT doc_id, family_id FROM variants) USING (doc_id)), re AS (SELECT query_id, family_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM one WHERE nth = 1) SELECT query_id, family_id, doc_id, round(score, 6) AS score, rank FROM re WHERE rank <= 3")
def family_dedupe_topk(spark, sf):
    return lexical.best_of_family(_fused(spark, sf), b.variants(spark, sf), 3).select("query_id", "family_id", "doc_id", six("score"), "rank")


@query(f"WITH {LEX} SELECT query_id, doc_id, round(score, 6) AS top, round(greatest(0.0, score - coalesce(nxt, 0)), 6) AS margin FROM (SELECT *, lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS nxt FROM frank) WHERE rank = 1")
def margin_top2(spark, sf):
    return lexical.top_two(_fused(spark, sf)).select("query_id", "doc_id", six("top"), six("margin"))


GLOSS = TRI.replace("FROM variants", "FROM glosses")


@query(f"WITH {VIEWS}, {GLOSS} SELECT query_id, doc_id, round(tfidf, 6) AS score, rank FROM trank WHERE rank <= 3")
def gloss_search(spark, sf):
    return lexical.tfidf(b.requests(spark, sf), b.glosses(spark, sf), 3).select("query_id", "doc_id", six("score"), "rank")


@query(
    f"WITH {VIEWS}, vs AS (SELECT doc_id, family_id, list_distinct(list_filter(string_split({norm('text')}, ' '), lambda x: length(x) > 1)) AS t FROM variants), qs AS (SELECT query_id, list_distinct(list_filter(string_split({norm('text')}, ' '), lambda x: length(x) > 1)) AS t FROM requests),"
    " vk AS (SELECT doc_id, family_id, unnest(t) AS k FROM vs), lone AS (SELECT k, count(DISTINCT family_id) AS families FROM vk GROUP BY 1),"
    " hits AS (SELECT query_id, doc_id, count(*) AS n, min(families) AS families FROM (SELECT query_id, unnest(t) AS k FROM qs) JOIN vk USING (k) JOIN lone USING (k) GROUP BY 1, 2),"
    " s AS (SELECT query_id, family_id, max(CASE WHEN len(qs.t) = 1 AND families = 1 THEN greatest(0.94, 0.55 * n / len(qs.t) + 0.45 * n / len(vs.t)) ELSE 0.55 * n / len(qs.t) + 0.45 * n / len(vs.t) END) AS score FROM hits JOIN qs USING (query_id) JOIN vs USING (doc_id) GROUP BY 1, 2),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, family_id) AS rank, lead(score) OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, family_id) AS nxt FROM s)"
    " SELECT query_id, family_id, round(score, 6) AS score, (score >= 0.88 AND score - coalesce(nxt, 0) >= 0.12) AS accepted FROM r WHERE rank = 1"
)
def restore_base(spark, sf):
    from groundphrase.operators.restore import base_restore, long_tokens

    return base_restore(b.requests(spark, sf), b.variants(spark, sf), items=long_tokens).withColumn("score", F.round("score", 6))


# Dense: vectors whose id is divisible by 50 are queries against all rows; labels are families.
VEC = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT vec_id AS doc_id, 'l' || label::VARCHAR AS family_id, embedding::DOUBLE[] AS v FROM embeddings),
sims AS (SELECT query_id, doc_id, family_id, list_dot_product(q.v, d.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(d.v, d.v)) AS sim FROM q, d),
srank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, doc_id) AS rank FROM sims)"""
FAM = "fam AS (SELECT query_id, family_id, max(sim) AS sim FROM sims GROUP BY 1, 2), famrank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, family_id) AS rank FROM fam)"
ALT = "alt AS (SELECT query_id, family_id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, family_id) AS rank FROM (SELECT query_id, family_id, count(*) AS n FROM srank WHERE rank <= 50 GROUP BY 1, 2))"


def _vectors(spark, sf):
    e = b.table(spark, sf, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    d = e.select(F.col("vec_id").alias("doc_id"), F.concat(F.lit("l"), F.col("label").cast("string")).alias("family_id"), F.col("embedding").alias("v"))
    return q, d


def _families(spark, sf):
    return index.ranked(dense.cosine_families(*_vectors(spark, sf)), "sim", tie="family_id")


def _counted(spark, sf):
    q, d = _vectors(spark, sf)
    n = dense.cosine_topk(q, d, 50).join(d.select("doc_id", "family_id"), "doc_id").groupBy("query_id", "family_id").agg(F.count(F.lit(1)).alias("n"))
    return index.ranked(n, "n", tie="family_id").select("query_id", "family_id", "rank")


@query(f"WITH {VEC} SELECT query_id, doc_id, round(sim, 6) AS sim, rank FROM srank WHERE rank <= 10")
def dense_cosine_topk(spark, sf):
    q, d = _vectors(spark, sf)
    return dense.cosine_topk(q, d, 10).withColumn("sim", F.round("sim", 6))


@query(f"WITH {VEC}, {FAM} SELECT query_id, family_id, round(sim, 6) AS sim, rank FROM famrank")
def max_over_views(spark, sf):
    return _families(spark, sf).select("query_id", "family_id", six("sim"), "rank")


@query(f"WITH {VEC}, {FAM} SELECT family_id, round(max(sim), 6) AS sim, count(*)::BIGINT AS n_queries FROM fam GROUP BY 1")
def multi_query_max(spark, sf):
    return _families(spark, sf).groupBy("family_id").agg(F.round(F.max("sim"), 6).alias("sim"), F.count(F.lit(1)).alias("n_queries"))


@query(f"WITH {VEC}, {FAM}, {ALT}, f AS (SELECT query_id, family_id, a.rank AS lexical_rank, b.rank AS dense_rank, coalesce(1.0 / (60 + a.rank), 0)::DOUBLE + coalesce(1.0 / (60 + b.rank), 0)::DOUBLE AS rrf FROM (SELECT * FROM alt WHERE rank <= 20) a FULL JOIN (SELECT * FROM famrank WHERE rank <= 20) b USING (query_id, family_id)) SELECT query_id, family_id, lexical_rank, dense_rank, round(rrf, 6) AS rrf, round(rrf / max(rrf) OVER (PARTITION BY query_id), 6) AS score FROM f")
def rrf_hybrid(spark, sf):
    return dense.rrf(_counted(spark, sf), _families(spark, sf)).select("query_id", "family_id", "lexical_rank", "dense_rank", six("rrf"), six("score"))


@query(f"WITH {VEC}, {FAM}, {ALT}, u AS (SELECT query_id, family_id, rank, 0 AS src FROM alt UNION ALL SELECT query_id, family_id, rank, 1 FROM famrank), m AS (SELECT query_id, family_id, min(rank * 2 + src) AS m FROM u GROUP BY 1, 2), r AS (SELECT query_id, family_id, row_number() OVER (PARTITION BY query_id ORDER BY m, family_id) AS rank, (m % 2)::INTEGER AS src FROM m) SELECT * FROM r WHERE rank <= 6")
def round_robin_interleave(spark, sf):
    return dense.interleave(_counted(spark, sf), _families(spark, sf), 6)


@query(f"WITH {VEC}, {FAM}, {ALT}, c AS (SELECT query_id, family_id, a.rank AS raw_rank, b.rank AS hint_rank FROM alt a JOIN famrank b USING (query_id, family_id) WHERE a.rank <= 8 AND b.rank <= 8 AND NOT (a.rank = 1)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_rank + hint_rank, raw_rank, hint_rank) AS nth FROM c) SELECT * FROM r WHERE nth <= 2")
def cross_view_consensus(spark, sf):
    a = _counted(spark, sf)
    return dense.cross_view_consensus(a, _families(spark, sf), a.where("rank = 1").select("query_id", "family_id"), limit=2)
