"""Queries over decisions, routes, verification and state rules."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from groundphrase.functions import text as tx
from groundphrase.operators import decide, dense, engine, index, lexical
from groundphrase.operators.attest import attest
from groundphrase.plans import bindings as b
from groundphrase.plans import retrieval as r
from groundphrase.plans.bindings import VIEWS, compact, norm

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


CONT = f"""vd AS (SELECT DISTINCT family_id, {compact('text')} AS v FROM variants WHERE length({compact('text')}) >= 8), own AS (SELECT query_id, family_id FROM rc JOIN vd ON c = v),
ins AS (SELECT query_id, family_id FROM rc JOIN vd ON contains(c, v) WHERE query_id NOT IN (SELECT query_id FROM own)), fam AS (SELECT query_id, count(DISTINCT family_id) AS families FROM (SELECT * FROM own UNION ALL SELECT * FROM ins) GROUP BY 1)"""
TOPS = f"""rc AS (SELECT query_id, text, {norm('text')} AS r, {compact('text')} AS c FROM requests), {CONT},
nx AS (SELECT *, greatest(0.0, score - coalesce(lead(score) OVER (PARTITION BY query_id ORDER BY rank), 0)) AS margin FROM frank), tops AS (SELECT * FROM nx WHERE rank = 1),
sup AS (SELECT rc.query_id, len(list_filter(string_split(rc.r, ' '), lambda x: x <> '' AND NOT list_contains(string_split({norm('v.text')}, ' '), x))) = 0 AS supported FROM rc JOIN tops USING (query_id) JOIN variants v USING (doc_id)),
sd AS (SELECT rc.query_id, rc.c, rc.r, score, margin, doc_id, CASE WHEN trim(text) = '' THEN 'empty-query' WHEN score IS NULL THEN 'no-overlap' WHEN coalesce(families, 0) >= 2 THEN 'multiple-attested-expressions' WHEN score >= 0.86 AND margin >= 0.03 THEN 'score-and-margin-passed'
  WHEN score >= 0.6 AND margin >= 0.1 AND length(c) >= 8 AND supported AND len(list_filter(string_split(r, ' '), lambda x: x <> '')) >= 3 AND tfidf >= 0.35 AND coverage >= 0.6 AND bm25 >= 0.6 THEN 'surface-evidence-agreement'
  WHEN score >= 0.86 THEN 'small-ranking-margin' ELSE 'insufficient-surface-evidence' END AS reason FROM rc LEFT JOIN tops USING (query_id) LEFT JOIN fam USING (query_id) LEFT JOIN sup USING (query_id)),
sdec AS (SELECT *, CASE WHEN reason IN ('score-and-margin-passed', 'surface-evidence-agreement') THEN 'ACCEPT' WHEN reason IN ('multiple-attested-expressions', 'small-ranking-margin') THEN 'CLARIFY' ELSE 'ABSTAIN' END AS decision FROM sd)"""
SURF = f"{r.LEX}, {TOPS}"


def surface_decisions(q, v):
    ranked = index.ranked(lexical.fused(q, v))
    tops = lexical.top_two(ranked).join(ranked.where("rank = 1").select("query_id", "tfidf", "coverage", "bm25"), "query_id").join(v.select("doc_id", F.col("text").alias("found")), "doc_id")
    fams = lexical.contained(q, v).groupBy("query_id").agg(F.count_distinct("family_id").alias("families"))
    d = q.join(tops, "query_id", "left").join(fams, "query_id", "left").withColumn("r", tx.retrieval(F.col("text")))
    toks = tx.tokens(F.col("r"))
    n_compact, supported = F.length(tx.compact(F.col("r"))), F.size(F.array_except(toks, tx.tokens(tx.retrieval(F.col("found"))))) == 0
    agree = decide.surface_agreement(F.col("top"), F.col("margin"), n_compact, F.size(toks), F.col("tfidf"), F.col("coverage"), F.col("bm25"), F.lit(0.0), supported)
    reason = decide.surface_reason(F.trim("text") == "", F.col("top"), F.col("margin"), F.coalesce("families", F.lit(0)), agree, F.lit(False), F.lit(False))
    return d.select("query_id", "text", "doc_id", "top", "margin", F.size(toks).alias("n_tokens"), reason.alias("reason")).withColumn("decision", decide.decision(F.col("reason")))


@query(f"WITH {SURF} SELECT query_id, reason, decision FROM sdec")
def surface_decision(spark, sf):
    return surface_decisions(b.requests(spark, sf), b.variants(spark, sf)).select("query_id", "reason", "decision")


MEAN = f"""mt AS (SELECT *, greatest(0.0, tfidf - coalesce(lead(tfidf) OVER (PARTITION BY query_id ORDER BY rank), 0)) AS margin FROM trank), m1 AS (SELECT * FROM mt WHERE rank = 1),
md AS (SELECT q.query_id, tfidf AS score, CASE WHEN trim(q.text) = '' THEN 'empty-query' WHEN tfidf IS NULL THEN 'no-overlap' WHEN tfidf >= 0.3 AND NOT list_has_any(string_split({norm('q.text')}, ' '), list_filter(string_split({norm('g.text')}, ' '), lambda x: length(x) > 1)) THEN 'insufficient-meaning-content-anchor'
  WHEN tfidf >= 0.3 AND margin >= 0.05 THEN 'score-and-margin-passed' WHEN tfidf >= 0.3 THEN 'small-ranking-margin' ELSE 'low-score' END AS reason FROM requests q LEFT JOIN m1 USING (query_id) LEFT JOIN glosses g USING (doc_id)),
mdec AS (SELECT *, CASE reason WHEN 'score-and-margin-passed' THEN 'ACCEPT' WHEN 'small-ranking-margin' THEN 'CLARIFY' ELSE 'ABSTAIN' END AS decision FROM md)"""


def meaning_decisions(q, g):
    ranked = lexical.tfidf(q, g, 2)
    d = q.join(lexical.top_two(ranked), "query_id", "left").join(g.select("doc_id", F.col("text").alias("gloss")), "doc_id", "left")
    anchored = F.arrays_overlap(tx.tokens(tx.retrieval(F.col("text"))), F.filter(tx.tokens(tx.retrieval(F.col("gloss"))), lambda t: F.length(t) > 1))
    reason = decide.meaning_reason(F.trim("text") == "", F.col("top"), F.col("margin"), anchored)
    return d.select("query_id", "top", reason.alias("reason")).withColumn("decision", decide.decision(F.col("reason")))


@query(f"WITH {VIEWS}, {r.GLOSS}, {MEAN} SELECT query_id, reason, decision FROM mdec")
def meaning_decision(spark, sf):
    return meaning_decisions(b.requests(spark, sf), b.glosses(spark, sf)).select("query_id", "reason", "decision")


@query(r"""SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'CLARIFY:empty-query' WHEN a THEN 'ATTESTATION:explicit-cue' WHEN s AND NOT m THEN 'SURFACE:explicit-cue' WHEN m AND NOT s THEN 'MEANING:explicit-cue' WHEN s AND m THEN 'CLARIFY:conflicting-explicit-task-cues' WHEN t THEN 'CLARIFY:technical-out-of-domain-guard' END AS route
FROM (SELECT *, regexp_matches(text, '(?i)\breal\b') AS a, regexp_matches(text, '(?i)\b(complete|finish)\b') AS s, regexp_matches(text, '(?i)\b(mean|about)\b') AS m, regexp_matches(text, '\d') AS t FROM conversations)""")
def route_explicit(spark, sf):
    t = F.col("text")
    route = decide.explicit_route(F.trim(t) == "", t.rlike(r"(?i)\breal\b"), t.rlike(r"(?i)\b(complete|finish)\b"), t.rlike(r"(?i)\b(mean|about)\b"), t.rlike(r"\d"))
    return b.table(spark, sf, "conversations").select("conv_id", "turn", route.alias("route"))


@query(
    "WITH g AS (SELECT event_id, event_id % 12 + 1 AS n, (event_id * 37 % 101) / 100.0::DOUBLE AS s, (event_id * 53 % 103) / 102.0::DOUBLE AS m, (event_id * 11 % 20) / 100.0::DOUBLE AS sm, CASE event_id % 3 WHEN 0 THEN 'ACCEPT' WHEN 1 THEN 'CLARIFY' ELSE 'ABSTAIN' END AS sd, CASE (event_id // 3) % 3 WHEN 0 THEN 'ACCEPT' WHEN 1 THEN 'CLARIFY' ELSE 'ABSTAIN' END AS md, event_id % 5 = 0 AS sc FROM events)"
    " SELECT event_id, CASE WHEN n <= 10 AND s >= 0.75 AND s >= m + 0.15 THEN 'SURFACE:surface-strong-probe' WHEN sd = 'ACCEPT' AND md <> 'ACCEPT' THEN 'SURFACE:surface-only-accept' WHEN md = 'ACCEPT' AND sd <> 'ACCEPT' THEN 'MEANING:meaning-only-accept' WHEN sd = 'ACCEPT' AND md = 'ACCEPT' AND n <= 10 AND s >= 0.6 THEN 'SURFACE:surface-phrase-both-accept' WHEN sd = 'ACCEPT' AND md = 'ACCEPT' THEN 'CLARIFY:both-tasks-accept'"
    " WHEN sd = 'CLARIFY' AND md = 'ABSTAIN' THEN 'SURFACE:surface-only-clarify' WHEN md = 'CLARIFY' AND sd = 'ABSTAIN' AND ((n >= 6 AND sc) OR (m >= 0.5 AND m >= s + 0.15)) THEN 'MEANING:meaning-clarify-probe' WHEN md = 'CLARIFY' AND sd = 'ABSTAIN' AND n <= 6 AND s >= 0.6 AND s >= m + 0.2 THEN 'SURFACE:surface-fragment-over-weak-meaning' WHEN md = 'CLARIFY' AND sd = 'ABSTAIN' THEN 'CLARIFY:weak-meaning-clarify'"
    " WHEN n <= 6 AND s >= 0.55 AND s >= m + 0.15 AND (sm >= 0.08 OR s >= 0.7) THEN 'SURFACE:surface-fragment-probe' ELSE 'CLARIFY:insufficient-task-evidence' END AS route FROM g"
)
def route_probe(spark, sf):
    e, i = b.table(spark, sf, "events"), F.col("event_id")
    of = lambda k: F.element_at(F.array(F.lit("ACCEPT"), F.lit("CLARIFY"), F.lit("ABSTAIN")), (k % 3 + 1).cast("int"))
    route = decide.probe_route(i % 12 + 1, (i * 37 % 101) / 100.0, of(i), (i * 11 % 20) / 100.0, (i * 53 % 103) / 102.0, of(F.floor(i / 3)), i % 5 == 0)
    return e.select("event_id", route.alias("route"))


VERDICT = "CASE q WHEN 1 THEN 'SUPPORTED' WHEN 0 THEN 'NOT_SUPPORTED' END"


@query(f"SELECT doc_id, quality, toxic, CASE WHEN p IS NULL THEN 'UNCERTAIN' WHEN p <> 'SUPPORTED' THEN p WHEN v = 'SUPPORTED' THEN 'SUPPORTED' ELSE 'UNCERTAIN' END AS verdict FROM (SELECT doc_id, quality, toxic, {VERDICT.replace('q', 'quality')} AS p, {VERDICT.replace('q', '(1 - toxic)')} AS v FROM documents LEFT JOIN labels USING (doc_id))".replace("CASE quality", "CASE quality").replace("CASE (1 - toxic)", "CASE (1 - toxic)"))
def gate_truth_table(spark, sf):
    d = b.table(spark, sf, "documents").select("doc_id").join(b.table(spark, sf, "labels"), "doc_id", "left")
    of = lambda c: F.when(c == 1, "SUPPORTED").when(c == 0, "NOT_SUPPORTED")
    return d.select("doc_id", "quality", "toxic", decide.gate(of(F.col("quality")), of(1 - F.col("toxic"))).alias("verdict"))


@query("SELECT doc_id, CASE quality WHEN 1 THEN 'ACCEPTABLE' WHEN 0 THEN 'NOT_ACCEPTABLE' ELSE 'UNCERTAIN' END AS verdict FROM documents LEFT JOIN labels USING (doc_id)")
def overlay_verify(spark, sf):
    d = b.table(spark, sf, "documents").select("doc_id").join(b.table(spark, sf, "labels"), "doc_id", "left")
    return d.select("doc_id", F.when(F.col("quality") == 1, "ACCEPTABLE").when(F.col("quality") == 0, "NOT_ACCEPTABLE").otherwise("UNCERTAIN").alias("verdict"))


RANKED = "rk AS (SELECT conv_id AS query_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END AS verdict FROM conversations)"


def _ranked(spark, sf):
    c = b.table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), "turn", F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, "SUPPORTED").otherwise("NOT_SUPPORTED").alias("verdict"))
    return index.ranked(c.withColumn("score", -F.col("turn").cast("double")), tie="turn").drop("score")


@query(f"WITH {RANKED}, s AS (SELECT *, coalesce(max((verdict = 'SUPPORTED')::INT) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS done FROM rk) SELECT query_id, turn, rank, (NOT done AND rank <= 2) AS consulted, CASE WHEN NOT done AND rank <= 2 THEN verdict END AS seen_verdict FROM s")
def early_stop_verify(spark, sf):
    return dense.early_stop(_ranked(spark, sf)).select("query_id", "turn", "rank", "consulted", "seen_verdict")


@query(f"WITH {RANKED}, s AS (SELECT query_id, turn, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth, count(*) OVER (PARTITION BY query_id) AS found FROM rk WHERE rank <= 4 AND verdict = 'SUPPORTED') SELECT query_id, turn, rank, nth FROM s WHERE nth <= 2 AND found >= 2")
def search_many_exact_n(spark, sf):
    return dense.exactly_n(_ranked(spark, sf), 2).select("query_id", "turn", "rank", "nth")


@query(f"WITH {RANKED} SELECT query_id, count(*) FILTER (verdict = 'SUPPORTED')::BIGINT AS n_supported, CASE WHEN count(*) FILTER (verdict = 'SUPPORTED') = 1 THEN 'ACCEPT' WHEN count(*) FILTER (verdict = 'SUPPORTED') > 1 THEN 'CLARIFY' ELSE 'ABSTAIN' END AS decision FROM rk GROUP BY 1")
def resolver_decision(spark, sf):
    n = _ranked(spark, sf).groupBy("query_id").agg(F.count_if(F.col("verdict") == "SUPPORTED").alias("n_supported"))
    return n.withColumn("decision", decide.resolve(F.col("n_supported")))


@query("SELECT o_orderkey, CASE WHEN d = 'ACCEPT' AND NOT m THEN 'accept-without-match' WHEN d = 'CLARIFY' AND n = 0 THEN 'clarify-without-alternatives' WHEN d = 'CLARIFY' AND m THEN 'clarify-with-match' WHEN d = 'ABSTAIN' AND (m OR n > 0) THEN 'abstain-with-content' END AS violation FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'ACCEPT' WHEN 1 THEN 'CLARIFY' ELSE 'ABSTAIN' END AS d, o_orderstatus = 'F' AS m, o_custkey % 3 AS n FROM orders)")
def state_violations(spark, sf):
    o, i = b.table(spark, sf, "orders"), F.col("o_orderkey")
    d = F.when(i % 3 == 0, "ACCEPT").when(i % 3 == 1, "CLARIFY").otherwise("ABSTAIN")
    return o.select("o_orderkey", decide.search_violation(d, F.col("o_orderstatus") == "F", F.col("o_custkey") % 3).alias("violation"))


GM = re.sub(r"\b(ndocs|dtf|idf|dw|dn|qw|qn|tfidf|trank)\b", r"g_\1", f"{r.GLOSS}, {MEAN}")
#: What is added to requests in their own script, by the rest of their number modulo 8: the wording of a task, of two,
#: a meaning's scaffold, or nothing.
ADDED = {1: ("", " چی بود"), 2: ("", " چی می‌گن"), 3: ("", " چی بود چی می‌گن"), 4: ("«", "» واقعی است"), 5: ("", " وقتی که حالتی"), 6: ("", " code")}


def _kind(sql: bool):
    """A number from 0 to 7 of a request, by lengths."""
    return "(length(text) + length(query_id)) % 8" if sql else (F.length("text") + F.length("query_id")) % 8


def _spoken(spark, sf):
    """(requests, variants, glosses) in the requests' own script, requests with cues."""
    q, v, g = (f(spark, sf).withColumn("text", b.in_script(F.col("text"))) for f in (b.requests, b.variants, b.glosses))
    text = F.col("text")
    for k, (x, y) in ADDED.items():
        text = F.when((_kind(False) == k) & (F.trim("text") != ""), F.concat(F.lit(x), F.col("text"), F.lit(y))).otherwise(text)
    return q.select("query_id", text.alias("text")), v, g


_VIEWS = VIEWS
for _v in ("variants", "glosses", "requests"):
    _VIEWS = _VIEWS.replace(f"{_v} AS (", f"latin_{_v} AS (")
_CASES = " ".join(f"WHEN {k} THEN '{x}' || t || '{y}'" for k, (x, y) in ADDED.items())
SPOKEN = f"""{_VIEWS}, variants AS (SELECT * REPLACE ({b.in_script_sql("text")} AS text) FROM latin_variants), glosses AS (SELECT * REPLACE ({b.in_script_sql("text")} AS text) FROM latin_glosses),
asked AS (SELECT query_id, {b.in_script_sql("text")} AS t, CASE WHEN trim(text) = '' THEN 0 ELSE {_kind(True)} END AS k FROM latin_requests), requests AS (SELECT query_id, k, CASE k {_CASES} ELSE t END AS text FROM asked)"""
AUTO = r"""rt AS (SELECT query_id, k = 5 AS scaffold, CASE WHEN trim(text) = '' THEN 'CLARIFY:empty-query' WHEN k = 4 THEN 'ATTESTATION:explicit-cue' WHEN k = 1 THEN 'SURFACE:explicit-cue' WHEN k = 2 THEN 'MEANING:explicit-cue' WHEN k = 3 THEN 'CLARIFY:conflicting-explicit-task-cues' WHEN k = 6 OR regexp_matches(' ' || text || ' ', ' [A-Za-z0-9]+[.,;:!?]* ') THEN 'CLARIFY:technical-out-of-domain-guard' END AS explicit FROM requests),
pr AS (SELECT query_id, explicit, scaffold, len(list_filter(string_split(sdec.r, ' '), lambda x: x <> '')) AS n, coalesce(sdec.score, 0) AS s, coalesce(mdec.score, 0) AS m, coalesce(margin, 0) AS sm, sdec.decision AS sd, mdec.decision AS md, status FROM rt JOIN sdec USING (query_id) JOIN mdec USING (query_id) JOIN attested USING (query_id)),
ro AS (SELECT *, coalesce(explicit, CASE WHEN n <= 10 AND s >= 0.75 AND s >= m + 0.15 THEN 'SURFACE:surface-strong-probe' WHEN sd = 'ACCEPT' AND md <> 'ACCEPT' THEN 'SURFACE:surface-only-accept' WHEN md = 'ACCEPT' AND sd <> 'ACCEPT' THEN 'MEANING:meaning-only-accept' WHEN sd = 'ACCEPT' AND md = 'ACCEPT' AND n <= 10 AND s >= 0.6 THEN 'SURFACE:surface-phrase-both-accept' WHEN sd = 'ACCEPT' AND md = 'ACCEPT' THEN 'CLARIFY:both-tasks-accept'
  WHEN sd = 'CLARIFY' AND md = 'ABSTAIN' THEN 'SURFACE:surface-only-clarify' WHEN md = 'CLARIFY' AND sd = 'ABSTAIN' AND (n >= 6 AND scaffold OR m >= 0.5 AND m >= s + 0.15) THEN 'MEANING:meaning-clarify-probe' WHEN md = 'CLARIFY' AND sd = 'ABSTAIN' AND n <= 6 AND s >= 0.6 AND s >= m + 0.2 THEN 'SURFACE:surface-fragment-over-weak-meaning' WHEN md = 'CLARIFY' AND sd = 'ABSTAIN' THEN 'CLARIFY:weak-meaning-clarify'
  WHEN n <= 6 AND s >= 0.55 AND s >= m + 0.15 AND (sm >= 0.08 OR s >= 0.7) THEN 'SURFACE:surface-fragment-probe' ELSE 'CLARIFY:insufficient-task-evidence' END) AS route FROM pr)
SELECT query_id, string_split(route, ':')[1] AS task, string_split(route, ':')[2] AS reason, CASE string_split(route, ':')[1] WHEN 'ATTESTATION' THEN CASE status WHEN 'ATTESTED' THEN 'ACCEPT' WHEN 'NEEDS_CLARIFICATION' THEN 'CLARIFY' ELSE 'NOT_ATTESTED_IN_CURRENT_CORPUS' END WHEN 'SURFACE' THEN sd WHEN 'MEANING' THEN md ELSE 'CLARIFY' END AS decision FROM ro"""


@query(f"WITH {SURF.replace(VIEWS, SPOKEN)}, {GM}, {r.ATTEST.replace('rq AS', 'arq AS').replace('FROM rq', 'FROM arq')}, {AUTO}")
def auto_dispatch(spark, sf):
    """Every request, in its own script and with cues, through the wording's own task, both probes and attestation."""
    q, v, g = _spoken(spark, sf)
    s, m = surface_decisions(q, v), meaning_decisions(q, g)
    return engine.auto(q, s.withColumnRenamed("top", "score"), m.withColumnRenamed("top", "score"), attest(q, v))


@query()
def surface_verified(spark, sf):
    """All branches: exact, partial and fuzzy retrieval, fillers, and windows for what stays open."""
    q, v = b.requests(spark, sf), b.variants(spark, sf)
    return engine.Engine(v, b.glosses(spark, sf)).surface(q).select("query_id", "reason", "decision", "doc_id", F.round("score", 6).alias("score"))


@query(
    f"WITH {VIEWS}, {r.GLOSS}, {r.BM.replace('FROM variants', 'FROM glosses')}, u AS (SELECT query_id, doc_id, coalesce(tfidf, 0) AS t, coalesce(bm25, 0) AS b FROM tfidf LEFT JOIN bme USING (query_id, doc_id)), s AS (SELECT *, least(1.0, t + 0.05 * b * (1 - t)) AS score FROM u), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE score > 0) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM k WHERE rank <= 3"
)
def gloss_rescored(spark, sf):
    k = engine.meaning_ranking(b.requests(spark, sf), b.glosses(spark, sf), 3)
    return k.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")
