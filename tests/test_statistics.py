"""Statistics that no task needs a whole group for, against plain versions."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundphrase.operators import evaluate as ev


def test_percentiles_and_distribution(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(np.round(x, 1))) for g in ("a", "b", None) for x in rng.normal(0, 3, 57)] + [("c", 2.0), ("a", float("nan")), ("a", None), ("b", float("inf"))]
    got = {r.g: r for r in ev.distribution(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).collect()}
    for g in ("a", "b", None, "c"):
        xs = [v for k, v in rows if k == g and v is not None and math.isfinite(v)]
        r = got[g]
        assert (r.n, r.min, r.max) == (len(xs), min(xs), max(xs)) and abs(r.mean - statistics.fmean(xs)) < 1e-9
        for q, v in ((50, r["median"]), (75, r.p75), (90, r.p90), (95, r.p95), (99, r.p99)):
            assert abs(v - np.percentile(xs, q)) < 1e-9
        assert abs(r.stdev - (statistics.stdev(xs) if len(xs) > 1 else 0)) < 1e-9
    assert ev.distribution(spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "v double"), "v").first()["median"] == 2.0
    assert ev.distribution(spark.createDataFrame([], "g string, v double"), "v", ["g"]).count() == 0


@pytest.mark.parametrize("n", [7, 1000])
def test_balanced_subset(spark, n):
    rng = np.random.default_rng(2)
    rows = [(i, str(rng.choice(["a", "b", "b", "b"])), int(rng.integers(0, 5))) for i in range(90)] + [(100, None, 1), (101, None, 1)]
    df = spark.createDataFrame(rows, "id int, c string, o int")
    got = [(r.turn, r.c, r.id) for r in ev.balanced_subset(df, "c", F.col("o"), n, "id").collect()]
    want = []
    for c in {r[1] for r in rows}:
        mine = sorted((o, i) for i, k, o in rows if k == c)
        want += [(t + 1, c, i) for t, (_, i) in enumerate(mine)]
    want = sorted(want, key=lambda x: (x[0], x[1] is not None, x[1] or "", x[2]))[:n]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_exact_binomial(spark):
    pairs = [(0, 0), (1, 0), (0, 1), (5, 5), (3, 9), (9, 3), (60, 41), (41, 60), (500, 430), (5000, 5200), (10**6, 10**6 + 3000), (10**9, 10**9 + 60_000)]
    got = spark.createDataFrame(pairs, "w long, l long").select("w", "l", ev.sign_test(F.col("w"), F.col("l")).alias("p"), ev.more_wins(F.col("w"), F.col("l")).alias("m")).collect()
    for r in got:
        n = r.w + r.l
        if n < 20_000:
            assert abs(r.p - ev.binomial_p(r.w, r.l)) < 1e-9
            more = sum(math.comb(n, i) for i in range(r.w, n + 1)) / 2**n if n else None
            assert r.m is None if more is None else abs(r.m - more) < 1e-9
        else:
            z = (abs(r.w - r.l) - 1) / math.sqrt(n)
            assert abs(r.p - math.erfc(z / math.sqrt(2))) < 2e-3
    x = [0.5, 1.0, 2.0, 10.5, 1e3, 1e9]
    lg = spark.createDataFrame([(v,) for v in x], "x double").select(ev.log_gamma(F.col("x")).alias("g")).collect()
    assert all(abs(r.g - math.lgamma(v)) <= 1e-10 * max(1, abs(math.lgamma(v))) for r, v in zip(lg, x, strict=True))


def test_poisson_bootstrap_is_near_the_normal_interval(spark):
    rng = np.random.default_rng(3)
    xs = rng.exponential(10, 4000)
    df = spark.createDataFrame([(i, "a" if i % 4 else "b", float(x)) for i, x in enumerate(xs)] + [(9999, "a", None)], "id int, g string, v double")
    for r in ev.bootstrap_means(df, "g", "v", "id", 800).collect():
        mine = [x for i, x in enumerate(xs) if bool(i % 4) == (r.g == "a")]
        half = 1.96 * statistics.stdev(mine) / math.sqrt(len(mine))
        assert r.n == len(mine) and abs(r.estimate - statistics.fmean(mine)) < 1e-9
        assert abs(r.estimate - r.low - half) < 0.2 * half and abs(r.high - r.estimate - half) < 0.2 * half
    assert abs(ev.poisson_bounds()[1] - 2 / math.e) < 1e-12
