"""Evaluation: metrics, distributions, paired comparisons, seeded resampling."""

from __future__ import annotations

import math
import random
import statistics
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundphrase.operators import store

PERCENTS = (0.75, 0.90, 0.95, 0.99)


def metric_block(cases: DataFrame, category: str, metrics: list[str]) -> DataFrame:
    """Correct, total and accuracy of boolean columns, for each category and for all (category null).

    Nulls count neither as right nor in the total; an empty total has a null accuracy.
    """
    aggs = []
    for m in metrics:
        n, ok = F.count(m), F.coalesce(F.sum(F.col(m).cast("long")), F.lit(0).cast("long"))
        aggs += [ok.alias(f"{m}_correct"), n.alias(f"{m}_total"), F.when(n > 0, ok / n).alias(f"{m}_accuracy")]
    return cases.rollup(category).agg(*aggs)


def percentiles(df: DataFrame, value: str, qs: tuple[float, ...], by: list[str] | None = None) -> DataFrame:
    """(by..., p0, p1, ...): interpolated percentiles of a column that isn't null. They come from order statistics
    over ranges, so no task holds a group's values, however many different ones it has."""
    ranks = [f for q in qs for f in (lambda n, q=q: F.floor((n - 1) * q), lambda n, q=q: F.ceil((n - 1) * q))]
    got = store.order_statistics(df, value, ranks, by)
    at = lambda q: (F.col("n") - 1) * q
    between = lambda i, q: F.col(f"s{2 * i}") + (F.col(f"s{2 * i + 1}") - F.col(f"s{2 * i}")) * (at(q) - F.floor(at(q)))
    return got.select(*(by or []), *(between(i, q).alias(f"p{i}") for i, q in enumerate(qs)))


def _beside(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """a with b's columns, both having one row for each value of by (nulls alike); without by, one row each."""
    names = [c for c in b.columns if c not in by]
    b = b.select(*(F.col(c).alias(f"_{c}") for c in by), *names)
    on = F.expr(" and ".join(f"x.`{c}` <=> y.`_{c}`" for c in by)) if by else F.lit(True)
    return a.alias("x").join(b.alias("y"), on).select("x.*", *(f"y.`{c}`" for c in names))


def distribution(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, mean, median, percentiles (interpolated), min, max and sample deviation (0 for one) of finite values."""
    by, v = by or [], F.col(value).cast("double")
    d = df.select(*by, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") != F.lit(float("inf"))))
    stats = d.groupBy(*by).agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.coalesce(F.stddev_samp("_v"), F.lit(0.0)).alias("stdev"))
    both = _beside(stats, percentiles(d, "_v", (0.5, *PERCENTS), by), by)
    return both.select(*by, "n", "mean", F.col("p0").alias("median"), *(F.col(f"p{i + 1}").alias(f"p{int(100 * q)}") for i, q in enumerate(PERCENTS)), "min", "max", "stdev")


def paired(base: DataFrame, system: DataFrame, key: str, value: str) -> DataFrame:
    """Overhead, relative percent and ratio of two runs of the same cases; a base of 0 or less is left out."""
    b, s = F.col("base_value"), F.col("system_value")
    both = base.select(key, F.col(value).alias("base_value")).join(system.select(key, F.col(value).alias("system_value")), key).where(b > 0)
    return both.withColumns({"overhead": s - b, "relative_pct": 100.0 * (s - b) / b, "ratio": s / b})


def positive_rates(long: DataFrame, by: list[str], answer: str) -> DataFrame:
    """n and rate of YES among YES and NO; other answers (NA) don't count."""
    yes = F.when(F.col(answer) == "YES", 1).when(F.col(answer) == "NO", 0)
    return long.groupBy(*by).agg(F.count(yes).alias("n"), F.avg(yes).alias("rate"))


def pairwise(df: DataFrame, winner: str, a: str, b: str) -> DataFrame:
    """Wins, losses and ties of a against b, and a's share of the decided ones."""
    n = lambda v: F.count_if(F.col(winner) == v)
    d = df.agg(n(a).alias("wins"), n(b).alias("losses"), F.count_if(~F.col(winner).isin(a, b) | F.col(winner).isNull()).alias("ties"))
    return d.withColumn("decisive_rate", F.when(F.col("wins") + F.col("losses") > 0, F.col("wins") / (F.col("wins") + F.col("losses"))))


def review(value: Column) -> Column:
    """YES, NO or NA from free spellings; anything else is an error."""
    v = F.upper(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(v.isin("YES", "Y", "TRUE", "1"), "YES").when(v.isin("NO", "N", "FALSE", "0"), "NO").when(v.isin("NA", "N/A", ""), "NA").otherwise(F.raise_error(F.concat(F.lit("not a review value: "), v)))


def seeded(id_col: str, seed: int = 42) -> Column:
    """A seeded order of rows by their id: whoever sorts by it needs no sorted whole."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")), 256)


def balanced_subset(df: DataFrame, category: str, order: Column, n: int, id_col: str) -> DataFrame:
    """n rows with their turn, round-robin over categories, each in the given order, then by id. A limit is the feature here.

    The n-th place of each category comes from order statistics over ranges, so n rows of a category move at most,
    and no task sees a whole one.
    """
    d = df.withColumn("_place", F.struct(order.alias("o"), F.col(id_col).alias("i")))
    last = store.order_statistics(d.select(category, "_place"), "_place", [lambda total: F.least(total, F.lit(n)) - 1], [category]).select(F.col(category).alias("_c"), F.col("s0").alias("_last"))
    some = d.alias("d").join(last.alias("l"), F.expr(f"d.`{category}` <=> l._c and d._place <= l._last")).select("d.*")
    r = some.withColumn("turn", F.row_number().over(Window.partitionBy(category).orderBy("_place")).cast("long")).drop("_place")
    return r.orderBy("turn", category, id_col).limit(n)


def percentile(xs: list[float], q: float) -> float | None:
    """The interpolated percentile of values, null of none."""
    if not xs:
        return None
    ys = sorted(xs)
    at = (len(ys) - 1) * q
    low, high = math.floor(at), math.ceil(at)
    return ys[low] if low == high else ys[low] * (high - at) + ys[high] * (at - low)


def bootstrap(values: list[float], statistic: Callable = statistics.median, iterations: int = 5000, seed: int = 42, level: float = 0.95) -> dict:
    """n, estimate and percentile interval of a statistic of finite values, by seeded resampling in their order."""
    xs = [float(x) for x in values if x is not None and math.isfinite(x)]
    if not xs:
        return {"n": 0, "estimate": None, "low": None, "high": None}
    rng, n = random.Random(seed), len(xs)
    got = [float(statistic([xs[rng.randrange(n)] for _ in range(n)])) for _ in range(iterations)]
    return {"n": n, "estimate": float(statistic(xs)), "low": percentile(got, (1 - level) / 2), "high": percentile(got, (1 + level) / 2)}


def bootstrap_groups(df: DataFrame, by: str, value: str, order: str, statistic: Callable = statistics.median, iterations: int = 5000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(by, n, estimate, low, high) of any statistic: for sets of cases that a task holds (hundreds to some
    thousands). The median of tables of any size is bootstrap_ci's."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = bootstrap(pdf.sort_values("_o", kind="stable")["_v"].tolist(), statistic, iterations, seed, level)
        return pd.DataFrame({by: [pdf[by].iloc[0]], **{k: [v] for k, v in got.items()}})

    rows = df.select(by, F.col(value).cast("double").alias("_v"), F.col(order).alias("_o")).where(F.col("_v").isNotNull())
    return rows.groupBy(by).applyInPandas(run, f"`{by}` {dict(df.dtypes)[by]}, n long, estimate double, low double, high double")


def bootstrap_ci(df: DataFrame, by: str, value: str, z: float = 1.959963984540054) -> DataFrame:
    """(by, n, estimate, low, high): the median and the interval that resampling without end would give.

    A resample's median is at most the k-th smallest value if half of it falls there: a binomial event, by
    its normal approximation the bounds are the values z standard deviations (half the root of n) around the
    middle. Only order statistics are needed, so groups may have any size. Nulls don't count.
    """
    half = lambda n: z * F.sqrt(n.cast("double")) / 2
    ranks = [lambda n: F.floor((n - 1) / 2), lambda n: F.ceil((n - 1) / 2), lambda n: F.floor((n - 1) / 2 - half(n)), lambda n: F.ceil((n - 1) / 2 + half(n))]
    got = store.order_statistics(df.select(by, F.col(value).cast("double").alias("v")), "v", ranks, [by])
    return got.select(by, "n", ((F.col("s0") + F.col("s1")) / 2).alias("estimate"), F.col("s2").alias("low"), F.col("s3").alias("high"))


def wilcoxon(df: DataFrame, diff: str) -> DataFrame:
    """Signed-rank statistic of differences (zeros left out, ties share ranks) with its normal approximation."""
    d = df.select(F.col(diff).alias("d")).where("d <> 0").withColumn("a", F.abs("d"))
    per = d.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("plus"))
    per = store.before(per, "a").withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)
    t = per.agg(F.sum(F.col("rank") * F.col("plus")).alias("w_plus"), F.sum(F.col("rank") * (F.col("n") - F.col("plus"))).alias("w_minus"), F.sum("n").alias("n"))
    n = F.col("n").cast("double")
    return t.withColumn("z", (F.least("w_plus", "w_minus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24))


def latency_groups(pairs: DataFrame, by: str) -> DataFrame:
    """For each group (null: UNKNOWN) of paired runs: n, medians of base, system, overhead and ratio, and the
    95th percentiles of base and system, interpolated."""
    names = ["base_value", "system_value", "overhead", "ratio"]
    d = pairs.select(F.coalesce(F.col(by).cast("string"), F.lit("UNKNOWN")).alias(by), *names)
    p = percentiles(d.unpivot([by], names, "_name", "_v"), "_v", (0.5, 0.95), [by, "_name"])
    of = lambda name, c: F.max(F.when(F.col("_name") == f"{name}", F.col(c)))
    wide = p.groupBy(by).agg(*(of(x, "p0").alias(f"{x.removesuffix('_value')}_median") for x in names), *(of(x, "p1").alias(f"{x.removesuffix('_value')}_p95") for x in names[:2]))
    return _beside(d.groupBy(by).agg(F.count(F.lit(1)).alias("n")), wide, [by])


def gold_rates(runs: DataFrame, category: str = "category") -> DataFrame:
    """Route, action, decision and family counts and rates against gold, for each category and for all (null).

    runs: route, actions, decision, families beside expected_route, expected_actions_any,
    expected_response_decision, expected_runtime_decision, target_family_ids. What gold leaves open isn't counted.
    """
    c = F.col
    wanted = F.coalesce("expected_response_decision", "expected_runtime_decision")
    marks = {
        "route": F.when(c("expected_route").isNotNull(), c("route").eqNullSafe(c("expected_route"))),
        "action": F.when(F.size("expected_actions_any") > 0, F.coalesce(F.arrays_overlap("actions", "expected_actions_any"), F.lit(False))),
        "decision": F.when(wanted.isNotNull(), F.coalesce((c("decision") == wanted) | (c("decision") == c("expected_runtime_decision")), F.lit(False))),
        "family": F.when(F.size("target_family_ids") > 0, F.coalesce(F.arrays_overlap("families", "target_family_ids"), F.lit(False))),
    }
    return metric_block(runs.select(category, *(v.alias(k) for k, v in marks.items())), category, list(marks))


def stage_profile(records: DataFrame) -> DataFrame:
    """(kind, name, n, mean, ...): the distribution of every timing and count in the maps timing_ms and counts of
    records with status PASS."""
    ok = records.where("status = 'PASS'")
    long = ok.select(F.explode("timing_ms").alias("name", "v")).withColumn("kind", F.lit("timing_ms")).unionByName(ok.select(F.explode("counts").alias("name", "v")).withColumn("kind", F.lit("counts")))
    return distribution(long, "v", ["kind", "name"])


def blind_sides(cases: DataFrame, id_col: str, order: str, seed: int = 42) -> DataFrame:
    """Add system_is_a: sides dealt by a seeded sequence over the cases in order. The sequence is the feature, so the
    set of cases is one that people review: their ids alone come to the driver."""
    rng = random.Random(seed)
    ids = [r[0] for r in cases.select(id_col, order).orderBy(order, id_col).collect()]
    kind = dict(cases.dtypes)[id_col]
    sides = cases.sparkSession.createDataFrame([(i, rng.random() < 0.5) for i in ids], f"`{id_col}` {kind}, system_is_a boolean")
    return cases.join(sides, id_col)


def blind_sheet(cases: DataFrame, id_col: str, order: str, base: str, system: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The reviewers' sheet (responses a and b, empty answers), and the key that says whose they are."""
    s = blind_sides(cases, id_col, order, seed)
    a, text = F.col("system_is_a"), lambda c: F.coalesce(F.col(c), F.lit(""))
    side = lambda yes, no: F.when(a, yes).otherwise(no)
    asked = [F.lit("").alias(f"{q}_{x}") for x in "ab" for q in ("task_fulfilled", "authentic", "appropriate", "fabricated")]
    sheet = s.select(id_col, *(c for c in ("category", "prompt") if c in cases.columns), side(text(system), text(base)).alias("response_a"), side(text(base), text(system)).alias("response_b"), *asked, F.lit("").alias("better_response"), F.lit("").alias("notes"))
    return sheet, s.select(id_col, side(F.lit("SYSTEM"), F.lit("BASE")).alias("A"), side(F.lit("BASE"), F.lit("SYSTEM")).alias("B"))


def unblinded(sheet: DataFrame, key: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(system, metric, answer) of a filled sheet, and the winner of each case (SYSTEM, BASE, TIE or null if it
    was left open). A case without a key and a side that isn't one fail."""
    both = sheet.join(key, id_col, "left").withColumn("A", F.coalesce("A", F.raise_error(F.concat(F.lit("no key for "), F.col(id_col).cast("string")))))
    long = None
    for side in "ab":
        for q in ("task_fulfilled", "authentic", "appropriate", "fabricated"):
            part = both.select(F.col(side.upper()).alias("system"), F.lit(q).alias("metric"), review(F.col(f"{q}_{side}")).alias("answer"))
            long = part if long is None else long.unionByName(part)
    better = F.upper(F.trim(F.coalesce("better_response", F.lit(""))))
    winner = F.when(better == "A", F.col("A")).when(better == "B", F.col("B")).when(better.isin("TIE", "T", "="), "TIE").when(better == "", F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("not a side: "), better)))
    return long, both.select(id_col, winner.alias("winner"))


def seal_violations(cases: DataFrame, id_col: str, n: int) -> DataFrame:
    """(violation, n) of what breaks a sealed set of cases: a missing id, a repeated one, another number of cases."""
    c = cases.select(F.col(id_col).cast("string").alias("id"))
    per = c.groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    bad = per.agg(F.sum(F.when(F.coalesce("id", F.lit("")) == "", F.col("k")).otherwise(0)).alias("missing-id"), F.sum(F.when((F.col("id") != "") & (F.col("k") > 1), F.col("k") - 1).otherwise(0)).alias("repeated-id"), F.abs(F.coalesce(F.sum("k"), F.lit(0)) - n).alias("wrong-number"))
    return bad.unpivot([], ["missing-id", "repeated-id", "wrong-number"], "violation", "n").where("n > 0")


def binomial_p(wins: int, losses: int) -> float:
    """Exact two-sided probability of a split at least so uneven under even odds."""
    n, k = wins + losses, min(wins, losses)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0


def log_gamma(x: Column) -> Column:
    """ln Gamma of a positive column: Stirling's series ten places up, and the product back to it."""
    y = x + 10
    z = 1 / (y * y)
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    product = x
    for i in range(1, 10):
        product = product * (x + i)
    return series - F.log(product)


def _lower_tail(n: Column, k: Column) -> Column:
    """P(X <= k) of n fair coins for a k of half of n at most: the largest term by log_gamma, the others by their ratios,
    as many as a double can tell (some dozen standard deviations)."""
    top = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) - n * math.log(2)
    terms = F.greatest(F.lit(0), F.least(k, F.ceil(12 * F.sqrt(n)) + 60).cast("int"))

    def add(a: Column, i: Column) -> Column:
        term = a["term"] * (k - i) / (n - k + i + 1)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    steps = F.when(terms > 0, F.sequence(F.lit(0), F.greatest(terms - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(steps, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), add, lambda a: a["sum"])
    return F.when(k < 0, 0.0).otherwise(F.exp(top) * tail)


def sign_test(wins: Column, losses: Column) -> Column:
    """The exact two-sided p-value of columns of counts, of any size."""
    n, k = (wins + losses).cast("double"), F.least(wins, losses).cast("double")
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * _lower_tail(n, k)))


def more_wins(wins: Column, losses: Column) -> Column:
    """The exact one-sided p-value: that fair coins give so many wins or more; null without any."""
    n, k = (wins + losses).cast("double"), F.least(losses, wins - 1).cast("double")
    tail = _lower_tail(n, F.greatest(k, F.lit(0.0)))
    p = F.when(losses < wins, tail).when(wins == 0, 1.0).otherwise(1 - tail)
    return F.when(n > 0, p)


def poisson_bounds(most: int = 12) -> list[float]:
    """What a uniform number must reach for a Poisson count of 1, 2, ... (mean 1)."""
    terms = [math.exp(-1) / math.factorial(i) for i in range(most)]
    return [sum(terms[: i + 1]) for i in range(most)]


def bootstrap_means(df: DataFrame, by: str, value: str, id_col: str, replicates: int = 200, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(by, n, estimate, low, high) of a mean, for groups of any size: a replicate counts each row a Poisson number of
    times, drawn from a hash of seed, replicate and id. Rows add their counts up where they are, so a group is one row for each
    replicate when it moves. replicates: a multiple of 4. Nulls don't count."""
    rows = df.select(by, F.col(value).cast("double").alias("_v"), F.col(id_col).cast("string").alias("_i")).where("_v is not null")
    each = rows.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(replicates // 4 - 1))))
    hashed = each.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_b").cast("string"), "_i")))
    sums = []
    for j in range(4):
        u = F.conv(F.substring("_h", 8 * j + 1, 8), 16, 10).cast("double") / float(1 << 32)
        w = sum((F.when(u >= x, 1).otherwise(0) for x in poisson_bounds()[1:]), F.when(u >= poisson_bounds()[0], 1).otherwise(0))
        sums += [F.sum(w).alias(f"n{j}"), F.sum(w * F.col("_v")).alias(f"v{j}")]
    per = hashed.groupBy(by, "_b").agg(*sums)
    means = per.select(by, F.explode(F.array(*(F.when(F.col(f"n{j}") > 0, F.col(f"v{j}") / F.col(f"n{j}")) for j in range(4)))).alias("m")).where("m is not null")
    edges = percentiles(means, "m", ((1 - level) / 2, (1 + level) / 2), [by]).withColumnsRenamed({"p0": "low", "p1": "high"})
    return _beside(rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("estimate")), edges, [by])
