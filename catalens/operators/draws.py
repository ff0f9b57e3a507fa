"""Exact random counts by inversion: one hashed uniform number per draw, looked up in the law's cumulative probabilities.

A law's probabilities come from the ratios of neighbours, summed as logarithms over the counts that 52 bits can tell from
impossible; that range grows with the root of the law's variance. Cumulative probabilities are cut into equal buckets of (0, 1), so a
draw meets its count through an equi-join on (law, bucket).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKETS = 512
#: Standard deviations of a law on both sides, and counts besides; what lies beyond has a probability below 2^-52.
SIDES, BESIDES = 12.0, 40


def uniform52(*parts: Column) -> Column:
    """A uniform number in [0, 1) from 52 bits of the md5 of the parts, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _table(laws: DataFrame, law: list[str], low: Column, high: Column, step: Callable[[Column], Column]) -> DataFrame:
    """law, _x, _from, _to, _bucket; step(x): logarithm of the probability of x + 1 over that of x."""
    order = Window.partitionBy(*law).orderBy("_x")
    upto, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*law)
    points = laws.withColumn("_low", low.cast("long")).withColumn("_high", high.cast("long")).withColumn(
        "_x", F.explode(F.sequence("_low", "_high")))
    x = F.col("_x")
    logs = points.withColumn("_g", F.sum(F.when(x > F.col("_low"), step(x - 1)).otherwise(0.0)).over(upto))
    weighed = logs.withColumn("_w", F.exp(F.col("_g") - F.max("_g").over(whole)))
    placed = weighed.withColumn("_to", F.when(x == F.col("_high"), 2.0).otherwise(F.sum("_w").over(upto) / F.sum("_w").over(whole)))
    placed = placed.withColumn("_from", F.coalesce(F.lag("_to").over(order), F.lit(0.0))).where(F.col("_from") < F.col("_to"))
    last = F.lit(BUCKETS - 1)
    first_bucket = F.least(F.floor(F.col("_from") * BUCKETS), last)
    buckets = F.sequence(first_bucket, F.least(F.floor(F.col("_to") * BUCKETS), last))
    return placed.select(*law, "_x", "_from", "_to", F.explode(buckets).alias("_bucket"))


def _drawn(draws: DataFrame, law: list[str], table: DataFrame, out: str) -> DataFrame:
    met = draws.withColumn("_bucket", F.floor(F.col("_u") * BUCKETS)).join(table, [*law, "_bucket"])
    return met.where((F.col("_u") >= F.col("_from")) & (F.col("_u") < F.col("_to"))).withColumnRenamed("_x", out).drop(
        "_u", "_bucket", "_from", "_to")


def binomial_draws(draws: DataFrame, trials: str, hits: str, u: Column, out: str = "drawn", laws: DataFrame | None = None) -> DataFrame:
    """Every row with a binomial count of `trials` draws that succeed with probability hits / trials (trials > 0).

    `laws` is a smaller frame that holds all of the two columns' values, if there is one."""
    k, s = F.col(trials), F.col(hits)
    side = F.ceil(F.lit(SIDES) * F.sqrt(s * (1 - s / k))) + F.when((s > 0) & (s < k), BESIDES).otherwise(0)
    odds = s / F.nullif(k - s, F.lit(0))
    laws = (draws if laws is None else laws).select(trials, hits).distinct()
    table = _table(laws, [trials, hits], F.greatest(F.lit(0), s - side), F.least(k, s + side), lambda x: F.ln((k - x) / (x + 1) * odds))
    return _drawn(draws.withColumn("_u", u), [trials, hits], table, out)


def poisson_draws(draws: DataFrame, mean: str, u: Column, out: str = "drawn", laws: DataFrame | None = None) -> DataFrame:
    """Every row with a Poisson count of the whole-number mean in a column: the summed weights of so many units.

    `laws` is a smaller frame that holds all of the column's values, if there is one."""
    m = F.col(mean)
    side = F.ceil(F.lit(SIDES) * F.sqrt(m)) + BESIDES
    laws = (draws if laws is None else laws).select(mean).distinct()
    table = _table(laws, [mean], F.greatest(F.lit(0), m - side), m + side, lambda x: F.ln(m / (x + 1)))
    return _drawn(draws.withColumn("_u", u), [mean], table, out)
