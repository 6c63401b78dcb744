"""Evaluation queries over the given fact tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundphrase.operators import evaluate as ev
from groundphrase.plans.bindings import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = halves(sql)
        return f

    return add


#: Of a last place, what goes up: a bit less than half, so that engines agree on halves that doubles only come near.
HALF = 0.50001


def near(c, places: int):
    return F.floor(c * float(10**places) + HALF) / float(10**places)


def near_sql(c: str, places: int) -> str:
    return f"floor(({c}) * 1e{places} + {HALF}) / 1e{places}"


def rnd(c, places: int):
    return near(F.col(c) if isinstance(c, str) else c, places)


def halves(sql: str) -> str:
    """SQL whose round(x, n) follow near()."""
    while (at := sql.find(" round(")) >= 0 or (at := sql.find("(round(")) >= 0:
        depth, end = 0, at + 6
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
            if not depth:
                break
        x, _, places = sql[at + 7 : end - 1].rpartition(", ")
        sql = sql[: at + 1] + near_sql(x, int(places)) + sql[end:]
    return sql


def rounded(df, places: int = 6):
    return df.select(*(near(F.col(c), places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(
    "SELECT o_orderpriority, coalesce(sum(a::INT), 0)::BIGINT AS route_correct, count(a)::BIGINT AS route_total, round(avg(a::INT), 6) AS route_accuracy, coalesce(sum(f::INT), 0)::BIGINT AS family_correct, count(f)::BIGINT AS family_total, round(avg(f::INT), 6) AS family_accuracy"
    " FROM (SELECT o_orderpriority, o_orderstatus = 'F' AS a, CASE WHEN o_custkey % 4 <> 0 THEN o_totalprice > 100000 END AS f FROM orders) GROUP BY GROUPING SETS ((), (o_orderpriority))"
)
def metric_block(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", (F.col("o_orderstatus") == "F").alias("route"), F.when(F.col("o_custkey") % 4 != 0, F.col("o_totalprice") > 100000).alias("family"))
    return rounded(ev.metric_block(o, "o_orderpriority", ["route", "family"]))


@query("SELECT l_returnflag AS system, k AS metric, count(a)::BIGINT AS n, round(avg(a), 6) AS rate FROM (SELECT l_returnflag, 'authentic' AS k, CASE l_linenumber % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS a FROM lineitem UNION ALL SELECT l_returnflag, 'fulfilled', CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END FROM lineitem) GROUP BY 1, 2")
def blind_rates(spark, sf):
    third = F.col("l_linenumber") % 3
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("system"), F.when(third == 0, "yes").when(third == 1, "no").otherwise("n/a").alias("authentic"), F.when(F.col("l_quantity") > 25, "Y").otherwise("N").alias("fulfilled"))
    long = li.unpivot(["system"], ["authentic", "fulfilled"], "metric", "answer").withColumn("answer", ev.review(F.col("answer")))
    return rounded(ev.positive_rates(long, ["system", "metric"], "answer"))


@query("SELECT count(*) FILTER (o_orderstatus = 'F')::BIGINT AS wins, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS losses, count(*) FILTER (o_orderstatus NOT IN ('F', 'O') OR o_orderstatus IS NULL)::BIGINT AS ties, round(count(*) FILTER (o_orderstatus = 'F') / count(*) FILTER (o_orderstatus IN ('F', 'O')), 6) AS decisive_rate FROM orders")
def pairwise_wins(spark, sf):
    return rounded(ev.pairwise(table(spark, sf, "orders"), "o_orderstatus", "F", "O"))


PAIRED = "p AS (SELECT o_orderkey, o_orderpriority, o_totalprice AS base_value, s AS system_value FROM orders JOIN (SELECT l_orderkey AS o_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) USING (o_orderkey) WHERE o_totalprice > 0)"


def _paired(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    s = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("v"))
    return ev.paired(o, s, "o_orderkey", "v")


@query(f"WITH {PAIRED} SELECT o_orderkey, round(base_value, 2) AS base_value, round(system_value, 2) AS system_value, round(system_value - base_value, 2) AS overhead, round(system_value / base_value, 4) AS ratio FROM p")
def paired_latency(spark, sf):
    return _paired(spark, sf).select("o_orderkey", *(rnd(c, 2).alias(c) for c in ("base_value", "system_value", "overhead")), rnd("ratio", 4).alias("ratio"))


DIST = ", ".join(f"round(quantile_cont({{v}}, {q}), 4) AS {n}" for q, n in ((0.5, "median"), (0.75, "p75"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99")))


@query(f"SELECT event_type, count(value)::BIGINT AS n, round(avg(value), 4) AS mean, {DIST.format(v='value')}, round(min(value), 4) AS min, round(max(value), 4) AS max, round(coalesce(stddev_samp(value), 0), 4) AS stdev FROM events WHERE isfinite(value) GROUP BY 1")
def latency_distribution(spark, sf):
    return rounded(ev.distribution(table(spark, sf, "events"), "value", ["event_type"]), 4)


@query(f"WITH {PAIRED} SELECT o_orderpriority, count(*)::BIGINT AS n, round(median(base_value), 3) AS base_median, round(median(system_value), 3) AS system_median, round(median(system_value - base_value), 3) AS overhead_median, round(median(system_value / base_value), 4) AS ratio_median, round(quantile_cont(base_value, 0.95), 3) AS base_p95, round(quantile_cont(system_value, 0.95), 3) AS system_p95 FROM p GROUP BY 1")
def latency_by_group(spark, sf):
    p = _paired(spark, sf).join(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")
    g = ev.latency_groups(p, "o_orderpriority")
    return g.select("o_orderpriority", "n", *(rnd(c, 4 if c == "ratio_median" else 3).alias(c) for c in g.columns[2:]))


GOLD = "gold AS (SELECT o_orderpriority AS category, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus = 'F' END AS route, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 3 = o_orderkey % 3 END AS action, CASE WHEN o_orderkey % 4 = 3 THEN NULL WHEN o_orderkey % 4 = 2 THEN o_custkey % 2 = 0 ELSE o_custkey % 2 = 1 OR o_orderkey % 4 = 1 AND o_custkey % 2 = 0 END AS decision, CASE WHEN o_custkey % 4 <> 0 THEN o_totalprice > 100000 END AS family FROM orders)"


@query(f"WITH {GOLD} SELECT category, " + ", ".join(f"coalesce(sum({m}::INT), 0)::BIGINT AS {m}_correct, count({m})::BIGINT AS {m}_total, round(avg({m}::INT), 6) AS {m}_accuracy" for m in ("route", "action", "decision", "family")) + " FROM gold GROUP BY GROUPING SETS ((), (category))")
def gold_metrics(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    none = F.array().cast("array<string>")
    runs = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("route"), F.when(k % 7 != 0, "F").alias("expected_route"), F.array((c % 3).cast("string")).alias("actions"),
        F.when(k % 5 != 0, F.array((k % 3).cast("string"))).otherwise(none).alias("expected_actions_any"), F.when(c % 2 == 0, "A").otherwise("B").alias("decision"),
        F.when(k % 4 < 2, "B").alias("expected_response_decision"), F.when(k % 4 == 1, "A").when(k % 4 == 2, "A").alias("expected_runtime_decision"),
        F.when(F.col("o_totalprice") > 100000, F.array(F.lit("f"))).otherwise(none).alias("families"), F.when(c % 4 != 0, F.array(F.lit("f"))).otherwise(none).alias("target_family_ids"),
    )
    return rounded(ev.gold_rates(runs))


@query("SELECT o_orderstatus, count(*)::BIGINT AS n, round(median(o_totalprice), 4) AS median FROM orders GROUP BY 1")
def median_by_preference(spark, sf):
    d = ev.distribution(table(spark, sf, "orders"), "o_totalprice", ["o_orderstatus"])
    return d.select("o_orderstatus", "n", rnd("median", 4).alias("median"))


@query("SELECT event_id, event_type, turn FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS turn FROM events) ORDER BY turn, event_type, event_id LIMIT 30")
def balanced_subset(spark, sf):
    return ev.balanced_subset(table(spark, sf, "events"), "event_type", F.col("value"), 30, "event_id").select("event_id", "event_type", "turn")


@query("SELECT o_orderkey, o_orderpriority, turn FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('7:' || o_orderkey::VARCHAR), o_orderkey) AS turn FROM orders) ORDER BY turn, o_orderpriority, o_orderkey LIMIT 200")
def seeded_subset(spark, sf):
    """Round-robin over categories, each in a seeded order."""
    return ev.balanced_subset(table(spark, sf, "orders"), "o_orderpriority", ev.seeded("o_orderkey", 7), 200, "o_orderkey").select("o_orderkey", "o_orderpriority", "turn")


SPLITS = "s AS (SELECT 'priority ' || o_orderpriority AS part, o_orderstatus AS r FROM orders UNION ALL SELECT 'customer ' || (o_custkey % 97)::VARCHAR, o_orderstatus FROM orders UNION ALL SELECT 'year ' || year(o_orderdate)::VARCHAR, CASE WHEN o_totalprice > 150000 THEN 'F' ELSE 'O' END FROM orders), w AS (SELECT part, count(*) FILTER (r = 'F') AS wins, count(*) FILTER (r = 'O') AS losses FROM s GROUP BY 1)"
_TERMS = "list_sum(list_transform(range(0, {k} + 1), lambda i: exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2))))"


@query(f"WITH {SPLITS} SELECT part, wins::BIGINT AS wins, losses::BIGINT AS losses, round(CASE WHEN wins + losses = 0 THEN 1 ELSE least(1.0, 2 * {_TERMS.format(k='least(wins, losses)')}) END, 6) AS p_two_sided, round(CASE WHEN wins + losses > 0 THEN coalesce({_TERMS.format(k='losses')}, 0) END, 6) AS p_more FROM w")
def sign_tests(spark, sf):
    """Exact binomial p-values of many splits, small and large."""
    o = table(spark, sf, "orders")
    one = lambda part, r: o.select(part.alias("part"), r.alias("r"))
    status = F.col("o_orderstatus")
    parts = one(F.concat(F.lit("priority "), "o_orderpriority"), status).unionByName(one(F.concat(F.lit("customer "), (F.col("o_custkey") % 97).cast("string")), status))
    parts = parts.unionByName(one(F.concat(F.lit("year "), F.year("o_orderdate").cast("string")), F.when(F.col("o_totalprice") > 150000, "F").otherwise("O")))
    w = parts.groupBy("part").agg(F.count_if(F.col("r") == "F").alias("wins"), F.count_if(F.col("r") == "O").alias("losses"))
    return rounded(w.select("part", "wins", "losses", ev.sign_test(F.col("wins"), F.col("losses")).alias("p_two_sided"), ev.more_wins(F.col("wins"), F.col("losses")).alias("p_more")))


_BOUNDS = " + ".join(f"(u >= {x!r})::INT" for x in ev.poisson_bounds())


@query(
    f"WITH h AS (SELECT o_orderpriority, o_totalprice AS v, b, md5('42:' || b::VARCHAR || ':' || o_orderkey::VARCHAR) AS h FROM orders, (SELECT unnest(range(25)) AS b)), u AS (SELECT o_orderpriority, v, b * 4 + j AS r, ('0x' || substr(h, 8 * j + 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM h, (SELECT unnest(range(4)) AS j)),"
    f" m AS (SELECT o_orderpriority, r, sum(({_BOUNDS}) * v) / sum({_BOUNDS}) AS m FROM u GROUP BY 1, 2), e AS (SELECT o_orderpriority, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY 1) SELECT o_orderpriority, n, round(estimate, 4) AS estimate, round(low, 4) AS low, round(high, 4) AS high FROM e JOIN (SELECT o_orderpriority, count(*)::BIGINT AS n, avg(o_totalprice) AS estimate FROM orders GROUP BY 1) USING (o_orderpriority)"
)
def bootstrap_means(spark, sf):
    """Mean order values with intervals by a Poisson bootstrap of 100 replicates over all rows."""
    return rounded(ev.bootstrap_means(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", "o_orderkey", 100), 4)


@query("SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1")
def category_histogram(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PAIRED}, d AS (SELECT round(system_value - base_value, 2) AS d FROM p WHERE round(system_value - base_value, 2) <> 0), r AS (SELECT d, (rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0)::DOUBLE AS r FROM d) SELECT round(coalesce(sum(r) FILTER (d > 0), 0), 1) AS w_plus, round(coalesce(sum(r) FILTER (d < 0), 0), 1) AS w_minus, count(*)::BIGINT AS n FROM r")
def wilcoxon(spark, sf):
    d = _paired(spark, sf).select(rnd("overhead", 2).alias("d"))
    return ev.wilcoxon(d, "d").select(rnd(F.col("w_plus").cast("double"), 1).alias("w_plus"), rnd(F.col("w_minus").cast("double"), 1).alias("w_minus"), "n")


@query(
    "WITH o AS (SELECT o_orderstatus, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) - 1 AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders), c AS (SELECT *, 1.959963984540054::DOUBLE * sqrt(n) / 2 AS h FROM o)"
    " SELECT o_orderstatus, any_value(n)::BIGINT AS n, round((max(v) FILTER (k = floor((n - 1) / 2)) + max(v) FILTER (k = ceil((n - 1) / 2))) / 2, 4) AS estimate, round(max(v) FILTER (k = greatest(0, floor((n - 1) / 2 - h))), 4) AS low, round(max(v) FILTER (k = least(n - 1, ceil((n - 1) / 2 + h))), 4) AS high FROM c GROUP BY 1"
)
def bootstrap_ci(spark, sf):
    return rounded(ev.bootstrap_ci(table(spark, sf, "orders"), "o_orderstatus", "o_totalprice"), 4)


@query()
def bootstrap_seeded(spark, sf):
    """Mean length of the benchmark's items by kind of first letter, with all rounds."""
    items = table(spark, sf, "benchmark").select("item_id", F.length("text").alias("n"), F.when(F.substring("text", 1, 1) < "m", "a-l").otherwise("m-z").alias("part"))
    return ev.bootstrap_groups(items, "part", "n", "item_id")


@query(
    "WITH r AS (SELECT event_type, {'plan': value, 'search': value / 2} AS t, {'calls': event_id % 5} AS c FROM events WHERE event_id % 10 <> 0), l AS (SELECT 'timing_ms' AS kind, 'plan' AS name, t.plan AS v FROM r UNION ALL SELECT 'timing_ms', 'search', t.search FROM r UNION ALL SELECT 'counts', 'calls', c.calls FROM r)"
    f" SELECT kind, name, count(v)::BIGINT AS n, round(avg(v), 4) AS mean, {DIST.format(v='v')}, round(min(v), 4) AS min, round(max(v), 4) AS max, round(coalesce(stddev_samp(v), 0), 4) AS stdev FROM l GROUP BY 1, 2"
)
def stage_profile(spark, sf):
    v = F.col("value").cast("double")
    r = table(spark, sf, "events").select(F.when(F.col("event_id") % 10 != 0, "PASS").otherwise("ERROR").alias("status"), F.create_map(F.lit("plan"), v, F.lit("search"), v / 2).alias("timing_ms"), F.create_map(F.lit("calls"), (F.col("event_id") % 5).cast("double")).alias("counts"))
    return rounded(ev.stage_profile(r), 4)


def _sides(n: int) -> list[bool]:
    import random

    rng = random.Random(42)
    return [rng.random() < 0.5 for _ in range(n)]


#: The first sides of the seeded sequence, as 1 (the system is a) and 0.
SIDES = "".join("01"[x] for x in _sides(64))


def _sheet(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("prompt"), F.concat(F.lit("base "), "n_name").alias("base"), F.when(F.col("n_nationkey") % 6 != 0, F.concat(F.lit("system "), "n_name")).alias("system"))
    return ev.blind_sheet(n, "id", "id", "base", "system")


@query(f"WITH s AS (SELECT n_nationkey::BIGINT AS id, n_name AS prompt, 'base ' || n_name AS base, CASE WHEN n_nationkey % 6 <> 0 THEN 'system ' || n_name ELSE '' END AS system, substr('{SIDES}', n_nationkey + 1, 1) = '1' AS a FROM nation) SELECT id, prompt, CASE WHEN a THEN system ELSE base END AS response_a, CASE WHEN a THEN base ELSE system END AS response_b, CASE WHEN a THEN 'SYSTEM' ELSE 'BASE' END AS a FROM s")
def blind_sheet(spark, sf):
    sheet, key = _sheet(spark, sf)
    return sheet.join(key, "id").select("id", "prompt", "response_a", "response_b", F.col("A").alias("a"))


@query(f"WITH s AS (SELECT n_nationkey AS id, substr('{SIDES}', n_nationkey + 1, 1) = '1' AS a FROM nation), w AS (SELECT CASE id % 4 WHEN 0 THEN CASE WHEN a THEN 'SYSTEM' ELSE 'BASE' END WHEN 1 THEN CASE WHEN a THEN 'BASE' ELSE 'SYSTEM' END WHEN 2 THEN 'TIE' END AS winner FROM s) SELECT winner, count(*)::BIGINT AS n FROM w GROUP BY 1")
def unblinded_wins(spark, sf):
    sheet, key = _sheet(spark, sf)
    filled = sheet.withColumn("better_response", F.when(F.col("id") % 4 == 0, " a").when(F.col("id") % 4 == 1, "B").when(F.col("id") % 4 == 2, "=").otherwise(""))
    return ev.unblinded(filled, key, "id")[1].groupBy("winner").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH s AS (SELECT n_nationkey AS id, substr('{SIDES}', n_nationkey + 1, 1) = '1' AS a FROM nation), l AS (SELECT CASE WHEN a THEN 'SYSTEM' ELSE 'BASE' END AS system, CASE id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS x FROM s) SELECT system, 'authentic' AS metric, count(x)::BIGINT AS n, round(avg(x), 6) AS rate FROM l GROUP BY 1")
def unblinded_rates(spark, sf):
    sheet, key = _sheet(spark, sf)
    filled = sheet.withColumn("authentic_a", F.when(F.col("id") % 3 == 0, "yes").when(F.col("id") % 3 == 1, "N").otherwise("n/a"))
    long = ev.unblinded(filled, key, "id")[0]
    sides = key.select(F.col("A").alias("system")).groupBy("system").count()
    got = rounded(ev.positive_rates(long.where("metric = 'authentic'"), ["system", "metric"], "answer"))
    return got.join(sides.select("system"), "system", "left_semi")


@query("WITH p AS (SELECT p_name AS id, count(*) AS k FROM part GROUP BY 1) SELECT * FROM (SELECT 'repeated-id' AS violation, sum(k - 1)::BIGINT AS n FROM p WHERE k > 1 UNION ALL SELECT 'wrong-number', abs(sum(k) - 200)::BIGINT FROM p) WHERE n > 0")
def sealed_cases(spark, sf):
    return ev.seal_violations(table(spark, sf, "part"), "p_name", 200)


@query("SELECT event_id, 'a=' || event_type || ';b=' || (CASE WHEN event_id % 2 = 0 THEN 'late' ELSE 'early' END) AS merged FROM events")
def merged_maps(spark, sf):
    """The later of two maps wins; keys come out in order."""
    m = F.map_concat(F.map_filter(F.create_map(F.lit("a"), F.col("event_type"), F.lit("b"), F.lit("early")), lambda k, v: (k != "b") | (F.col("event_id") % 2 != 0)), F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("b"), F.lit("late"))).otherwise(F.create_map().cast("map<string,string>")))
    text = F.array_join(F.transform(F.array_sort(F.map_keys(m)), lambda k: F.concat(k, F.lit("="), F.element_at(m, k))), ";")
    return table(spark, sf, "events").select("event_id", text.alias("merged"))
