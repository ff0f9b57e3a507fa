"""Exact random counts against their laws, resampling against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from catalens.operators import draws as dr
from catalens.operators import statistics as stt


def binomial(k, p, x):
    return math.comb(k, x) * p**x * (1 - p) ** (k - x)


@pytest.mark.parametrize("k, s", [(1, 1), (5, 0), (5, 5), (7, 2), (40, 3), (300, 299)])
def test_every_uniform_number_gives_its_binomial_count(spark, k, s):
    rows = [(float(u), k, s) for u in [0.0, 1e-9, *(i / 997 for i in range(1, 997)), 1 - 2**-52]]
    got = dr.binomial_draws(spark.createDataFrame(rows, "u double, k long, s long"), "k", "s", F.col("u")).select("u", "drawn").collect()
    assert len(got) == len(rows)
    for u, x in got:
        cdf = sum(binomial(k, s / k, i) for i in range(x + 1))
        assert cdf > u - 1e-9 and cdf - binomial(k, s / k, x) <= u + 1e-9


def test_every_uniform_number_gives_its_poisson_count(spark):
    rows = [(i / 501, m) for i in range(501) for m in (1, 2, 30, 700)]
    got = dr.poisson_draws(spark.createDataFrame(rows, "u double, m long"), "m", F.col("u")).collect()
    assert len(got) == len(rows)
    for r in got:
        pmf = lambda x: math.exp(x * math.log(r.m) - r.m - math.lgamma(x + 1))  # noqa: B023, E731
        cdf = sum(pmf(i) for i in range(r.drawn + 1))
        assert cdf > r.u - 1e-9 and cdf - pmf(r.drawn) <= r.u + 1e-9


def test_large_counts_stay_narrow(spark):
    df = spark.range(2000).select(F.lit(10**9).alias("k"), F.lit(3 * 10**8).alias("s"), dr.uniform52(F.col("id").cast("string")).alias("u"))
    mean, deviation = dr.binomial_draws(df, "k", "s", F.col("u")).agg(F.avg("drawn"), F.stddev("drawn")).first()
    assert abs(mean - 3e8) < 1500 and abs(deviation / math.sqrt(2.1e8) - 1) < 0.1


def test_cluster_interval_equals_single_draws(spark):
    """m clusters alike weigh Poisson(m) together: against a Poisson(1) weight for every cluster."""
    random.seed(1)
    clusters = [(random.choice([0, 1, 2]), random.choice([2, 3, 8])) for _ in range(400)]
    rows = [(str(c), i < num) for c, (num, den) in enumerate(clusters) for i in range(den)]
    got = stt.bootstrap_cluster(spark.createDataFrame(rows, "c string, f boolean"), {"q": (F.col("f"), F.lit(True))}, "c", 10_000, 3).first()
    values = []
    for _ in range(4000):
        w = [poisson(random.random()) for _ in clusters]
        values.append(100.0 * sum(a * x[0] for a, x in zip(w, clusters)) / sum(a * x[1] for a, x in zip(w, clusters)))
    values.sort()
    assert abs(got.ci95_low - values[100]) < 0.35 and abs(got.ci95_high - values[3899]) < 0.35


CDF = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(15)]


def poisson(u):
    return next((i for i, c in enumerate(CDF) if u < c), len(CDF))


def test_mask_cube_serves_every_share(spark):
    df = spark.range(600).select((F.col("id") % 7).alias("c"), (F.col("id") % 2 == 0).alias("a"), (F.col("id") % 3 == 0).alias("b"), F.lit(True).alias("all"))
    cube = stt.mask_cube(df, {"a": F.col("a"), "b": F.col("b"), "all": F.col("all")}, "c")
    got = {r.quantity: (r.value_pct, r.n) for r in stt.cluster_intervals(
        cube, ["a", "b", "all"], {"a of all": (["a"], ["all"]), "a of b": (["a"], ["b"]), "both of all": (["a", "b"], ["all"])}, 200, 1).collect()}
    assert got == {"a of all": (50.0, 600), "a of b": (50.0, 200), "both of all": (16.7, 600)}
    with pytest.raises(ValueError):
        stt.mask_cube(df, {str(i): F.lit(True) for i in range(63)}, "c")


def test_rank_interval_equals_ranks_of_every_replicate(spark):
    """The draws of every replicate anew, ranked by sorting."""
    random.seed(2)
    rows = [(float(random.choice([1, 1, 2, 3, 9, 27])), float(random.choice([0, 0, 1, 5, 5.5]))) for _ in range(80)]
    n, seed = 60, 5
    got = stt.bootstrap_spearman(spark.createDataFrame([*rows, (None, 1.0), (1.0, None)], "a double, b double"), "a", "b", n, seed).first()
    cells = sorted({(p, rows.count(p)) for p in rows})
    drawn = spark.createDataFrame([(x, y, m, r) for (x, y), m in cells for r in range(n)], "x double, y double, m long, r int")
    key = [F.lit(str(seed)), F.col("x").cast("string"), F.col("y").cast("string"), F.col("r").cast("string")]
    weights = dr.poisson_draws(drawn, "m", dr.uniform52(*key), "w").collect()
    values = []
    for r in range(n):
        flat = [(w.x, w.y) for w in weights if w.r == r for _ in range(w.w)]
        rank = lambda v: [sum(o < x for o in v) + (v.count(x) + 1) / 2 for x in v]
        a, b = rank([p[0] for p in flat]), rank([p[1] for p in flat])
        ma, mb = sum(a) / len(a), sum(b) / len(b)
        values.append(sum((x - ma) * (y - mb) for x, y in zip(a, b)) / math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b)))
    values.sort()
    assert (got.ci95_low, got.ci95_high, got.n) == (round(values[1], 3), round(values[57], 3), 80)


def test_interval_parts_are_stored_one_by_one(spark):
    rows = spark.range(60).select((F.col("id") % 3 == 0).alias("f"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 4).cast("double").alias("b"))
    share = lambda q: stt.bootstrap_proportion(rows, {q: F.col("f")}, 200, 1)
    ranks = stt.bootstrap_spearman(rows, "a", "b", 200, 1).select(F.lit("r").alias("quantity"), F.col("value").alias("value_pct"), "ci95_low", "ci95_high", "n")
    got = stt.interval_table([(share("p"), "x"), (share("q"), F.upper("quantity"))], [(ranks, "y")])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 3
    assert sorted((r.quantity, r.basis, r.n, r.worst_half_width_pct) for r in got.collect()) == [("p", "x", 60, 12.7), ("q", "Q", 60, 12.7), ("r", "y", 60, None)]
