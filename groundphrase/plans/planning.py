"""Queries over intents, plans, dispatch, views, completion and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundphrase.operators import plan
from groundphrase.operators.restore import complete_prefix, long_tokens
from groundphrase.plans import bindings as b
from groundphrase.plans.bindings import VIEWS, norm

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Truth tables come from the digits of order keys, so that all rules are met.
def _bit(i: int):
    return F.col("o_orderkey").bitwiseAND(1 << i) != 0


def bit(i: int) -> str:
    return f"(o_orderkey & {1 << i}) <> 0"


@query(
    f"SELECT o_orderkey, CASE WHEN ({bit(9)} AND {bit(10)}) OR ({bit(8)} AND {bit(9)}) THEN 'NONE' WHEN {bit(7)} AND {bit(8)} THEN 'FORCE_GENERAL' WHEN {bit(6)} AND {bit(7)} THEN 'RETRIEVE_EXAMPLES' WHEN NOT ({bit(0)}) AND {bit(6)} THEN 'FORCE_GENERAL'"
    f" WHEN {bit(0)} AND {bit(5)} THEN 'ATTEST' WHEN {bit(0)} AND {bit(4)} THEN 'RESTORE_SURFACE' WHEN {bit(0)} AND {bit(3)} THEN 'ATTEST' WHEN {bit(0)} AND {bit(2)} THEN 'EXPLAIN' WHEN ({bit(1)} AND {bit(2)} AND {bit(3)}) OR ({bit(4)} AND {bit(5)}) THEN 'SEARCH_BY_MEANING' ELSE 'NONE' END AS signal FROM orders"
)
def intent_signals(spark, sf):
    t = _bit
    s = plan.intent(t(9) & t(10), t(8) & t(9), t(7) & t(8), t(6) & t(7), t(6), t(0).cast("int"), t(5), t(4), t(3), t(2), t(1), t(2), t(3), t(4) & t(5))
    return b.table(spark, sf, "orders").select("o_orderkey", s.alias("signal"))


ACTIONS = ("ATTEST", "EXPLAIN", "RESTORE_SURFACE", "SEARCH_BY_MEANING", "RETRIEVE_EXAMPLES")


def _drafts(spark, sf):
    o, k = b.table(spark, sf, "orders"), F.col("o_orderkey")
    pick = lambda i: F.element_at(F.array(*map(F.lit, ACTIONS)), (i % 5 + 1).cast("int"))
    route = F.element_at(F.array(*map(F.lit, ("GENERAL", "CLARIFY", "FFE_REQUIRED"))), (k % 3 + 1).cast("int"))
    actions = F.when(route != "FFE_REQUIRED", F.array().cast("array<string>")).when(_bit(4), F.array(pick(k))).when(_bit(5), F.array(F.lit("ATTEST"), F.lit("EXPLAIN"))).when(_bit(6), F.array(pick(k), F.lit("RESTORE_SURFACE"))).otherwise(F.array().cast("array<string>"))
    signal = F.element_at(F.array(*map(F.lit, ("NONE", "ATTEST", "EXPLAIN", "RESTORE_SURFACE", "SEARCH_BY_MEANING", "FORCE_GENERAL", "NONE"))), (k % 7 + 1).cast("int"))
    return o.select("o_orderkey", "o_custkey", route.alias("route"), actions.alias("actions"), signal.alias("signal"))


DRAFTS = f"""dr AS (SELECT o_orderkey, o_custkey, ['GENERAL', 'CLARIFY', 'FFE_REQUIRED'][o_orderkey % 3 + 1] AS route,
  CASE WHEN o_orderkey % 3 <> 2 THEN []::VARCHAR[] WHEN {bit(4)} THEN [{list(ACTIONS)}[o_orderkey % 5 + 1]] WHEN {bit(5)} THEN ['ATTEST', 'EXPLAIN'] WHEN {bit(6)} THEN [{list(ACTIONS)}[o_orderkey % 5 + 1], 'RESTORE_SURFACE'] ELSE []::VARCHAR[] END AS actions,
  ['NONE', 'ATTEST', 'EXPLAIN', 'RESTORE_SURFACE', 'SEARCH_BY_MEANING', 'FORCE_GENERAL', 'NONE'][o_orderkey % 7 + 1] AS signal FROM orders)"""
SPAN = "['ATTEST', 'RESTORE_SURFACE', 'EXPLAIN']"


@query(
    f"WITH {DRAFTS}, d AS (SELECT *, {bit(7)} AS exact, (o_custkey % 3)::INT AS families, {bit(8)} AS bt, {bit(9)} AS one, CASE WHEN {bit(10)} THEN 'x' END AS target FROM dr) SELECT o_orderkey, CASE WHEN signal = 'FORCE_GENERAL' THEN 'GENERAL' WHEN exact AND route <> 'GENERAL' THEN 'FFE_REQUIRED:ATTEST' WHEN signal = 'RESTORE_SURFACE' AND families > 0 AND NOT exact THEN 'FFE_REQUIRED:RESTORE_SURFACE'"
    f" WHEN route = 'CLARIFY' AND families >= 2 AND list_contains({SPAN}, signal) AND bt AND NOT one THEN 'FFE_REQUIRED:' || signal WHEN route = 'GENERAL' AND signal <> 'NONE' THEN 'FFE_REQUIRED:' || signal"
    f" WHEN route = 'FFE_REQUIRED' AND len(actions) = 1 AND actions[1] <> 'RETRIEVE_EXAMPLES' AND signal <> 'NONE' AND actions[1] <> signal AND (NOT list_contains({SPAN}, signal) OR target IS NOT NULL OR families > 0) THEN 'FFE_REQUIRED:' || signal"
    f" WHEN route IN ('GENERAL', 'CLARIFY') THEN route WHEN list_has_any(actions, {SPAN}) AND NOT (target IS NOT NULL OR families > 0) THEN 'CLARIFY' ELSE 'FFE_REQUIRED:' || coalesce(array_to_string(actions, '+'), '') END AS plan FROM d"
)
def plan_finalization(spark, sf):
    d = _drafts(spark, sf)
    p = plan.finalize(F.col("route"), F.col("actions"), F.col("signal"), _bit(7), F.col("o_custkey") % 3, _bit(8), _bit(9), F.when(_bit(10), "x"))
    return d.select("o_orderkey", p.alias("plan"))


@query(
    f"WITH {DRAFTS} SELECT o_orderkey, CASE WHEN {bit(9)} AND {bit(8)} THEN 'ABSTAIN' WHEN route = 'GENERAL' THEN 'PASS_THROUGH' WHEN route = 'CLARIFY' THEN 'CLARIFY' WHEN len(actions) = 0 THEN 'ABSTAIN' WHEN len(actions) = 2 AND list_contains(actions, 'ATTEST') AND list_contains(actions, 'EXPLAIN') THEN 'attest' WHEN len(actions) > 1 THEN 'ABSTAIN'"
    " WHEN actions[1] = 'SEARCH_BY_MEANING' THEN 'meaning-search' WHEN actions[1] = 'RETRIEVE_EXAMPLES' THEN 'exactly-n' WHEN actions[1] = 'RESTORE_SURFACE' THEN 'restore' WHEN actions[1] = 'ATTEST' THEN 'attest' WHEN actions[1] = 'EXPLAIN' THEN 'explain' ELSE 'ABSTAIN' END AS path FROM dr"
)
def plan_dispatch(spark, sf):
    return _drafts(spark, sf).select("o_orderkey", plan.dispatch(F.col("route"), F.col("actions"), _bit(9) & _bit(8), F.lit(True)).alias("path"))


@query(f"SELECT o_orderkey, CASE WHEN o_custkey % 4 < 2 THEN 'NOT_APPLICABLE' WHEN {bit(0)} THEN 'CLARIFY' WHEN {bit(1)} THEN 'ACCEPT_ALL' WHEN {bit(2)} THEN 'CLARIFY' ELSE 'ACCEPT_SELECTED' END AS outcome FROM orders")
def multi_surface_outcome(spark, sf):
    o = plan.multi_surface(F.col("o_custkey") % 4, _bit(1), _bit(0), F.when(~_bit(2), "SELECTED"))
    return b.table(spark, sf, "orders").select("o_orderkey", o.alias("outcome"))


@query(f"WITH {VIEWS} SELECT family_id, view, n, text FROM (SELECT g.family_id, g.text AS gloss, v.text AS canonical FROM glosses g JOIN variants v ON g.family_id = v.family_id AND v.variant_id LIKE '%-v1'), (VALUES ('gloss', 0::BIGINT), ('scenario-from-gloss', 1::BIGINT), ('canonical-plus-gloss', 2::BIGINT)) t(view, n), LATERAL (SELECT CASE n WHEN 0 THEN trim(gloss) WHEN 1 THEN trim('situation: ' || gloss) ELSE trim('phrase: ' || canonical || chr(10) || gloss) END AS text)")
def semantic_views(spark, sf):
    v = b.variants(spark, sf).where("variant_id like '%-v1'").select("family_id", F.col("text").alias("canonical"))
    return plan.views(b.glosses(spark, sf).select("family_id", F.col("text").alias("gloss")).join(v, "family_id"))


@query(
    f"WITH {VIEWS}, q AS (SELECT 'h' || item_id::VARCHAR AS query_id, list_filter(string_split({norm(chr(39) + chr(39) + ' || array_to_string(t[1:5], ' + chr(39) + ' ' + chr(39) + ')')}, ' '), lambda x: length(x) > 1) AS q FROM items), v AS (SELECT family_id, list_filter(string_split({norm('text')}, ' '), lambda x: length(x) > 1) AS v FROM variants),"
    " l AS (SELECT query_id, family_id, max(len(v) - len(q)) AS extension FROM q JOIN v ON len(q) >= 4 AND len(v) >= len(q) + 3 AND v[1:len(q)] = q GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY extension DESC, family_id) AS rank, lead(extension) OVER (PARTITION BY query_id ORDER BY extension DESC, family_id) AS nxt FROM l)"
    " SELECT query_id, CASE WHEN coalesce(nxt = extension, FALSE) THEN NULL ELSE family_id END AS family_id, extension::INTEGER AS extension, CASE WHEN coalesce(nxt = extension, FALSE) THEN 'ambiguous-long-prefix-completion' ELSE 'explicit-long-prefix-completion' END AS reason FROM r WHERE rank = 1"
)
def prefix_completion(spark, sf):
    q = b._items(spark, sf).select(F.concat(F.lit("h"), F.col("item_id").cast("string")).alias("query_id"), F.array_join(F.slice("t", 1, 5), " ").alias("text"))
    return complete_prefix(q, b.variants(spark, sf), long_tokens)


@query(
    f"WITH {DRAFTS}, s AS (SELECT o_orderkey, {bit(0)} AS d, {bit(1)} AS r, route = 'FFE_REQUIRED' AS t, (NOT ({bit(2)}) OR list_contains(actions, 'ATTEST')) AS a, CASE WHEN {bit(3)} THEN o_custkey % 2 = 0 END AS f FROM dr) SELECT o_orderkey, d AS decision_match, r AS runtime_match, t AS route_match, a AS action_match, f AS family_match, d AND r AND t AND a AND coalesce(f, TRUE) AS automatic_e2e FROM s"
)
def case_scores(spark, sf):
    d = _drafts(spark, sf)
    of = lambda i: F.when(_bit(i), "ACCEPT").otherwise("ABSTAIN")
    none = F.array().cast("array<string>")
    runs = d.select(
        "o_orderkey", of(0).alias("decision"), F.lit("ACCEPT").alias("expected_response_decision"), of(1).alias("runtime_decision"), F.lit("ACCEPT").alias("expected_runtime_decision"), "route", F.lit("FFE_REQUIRED").alias("expected_route"),
        "actions", F.when(_bit(2), F.array(F.lit("ATTEST"))).otherwise(none).alias("expected_actions_any"), F.array((F.col("o_custkey") % 2).cast("string")).alias("families"), F.when(_bit(3), F.array(F.lit("0"))).otherwise(none).alias("target_family_ids"),
    )
    return plan.scored(runs).select("o_orderkey", "decision_match", "runtime_match", "route_match", "action_match", "family_match", "automatic_e2e")


@query("SELECT event_id, CASE WHEN k = 'search' AND s = 'ACCEPT' OR k = 'attest' AND s = 'ATTESTED' THEN 'ACCEPT' WHEN k = 'search' AND s = 'CLARIFY' OR k = 'attest' AND s = 'NEEDS_CLARIFICATION' THEN 'CLARIFY' WHEN k = 'attest' THEN 'NOT_ATTESTED_IN_CURRENT_CORPUS' ELSE 'ABSTAIN' END AS state FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'search' ELSE 'attest' END AS k, ['ACCEPT', 'CLARIFY', 'ABSTAIN', 'ATTESTED', 'NEEDS_CLARIFICATION', 'NOT_ATTESTED'][event_id % 6 + 1] AS s FROM events)")
def runtime_states(spark, sf):
    s = F.element_at(F.array(*map(F.lit, ("ACCEPT", "CLARIFY", "ABSTAIN", "ATTESTED", "NEEDS_CLARIFICATION", "NOT_ATTESTED"))), (F.col("event_id") % 6 + 1).cast("int"))
    k = F.when(F.col("event_id") % 2 == 0, "search").otherwise("attest")
    return b.table(spark, sf, "events").select("event_id", plan.runtime_state(k, s).alias("state"))


@query("SELECT l_orderkey, l_linenumber, round(greatest(0, least(a + 10, c + d) - greatest(a, c)) / greatest(1, least(10, d)), 6) AS overlap FROM (SELECT l_orderkey, l_linenumber, l_partkey % 20 AS a, l_suppkey % 20 AS c, l_linenumber % 5 + 1 AS d FROM lineitem)")
def span_overlaps(spark, sf):
    a, c, d = F.col("l_partkey") % 20, F.col("l_suppkey") % 20, F.col("l_linenumber") % 5 + 1
    return b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(plan.spans_overlap(a, a + 10, c, c + d), 6).alias("overlap"))
