"""Rank correlation and resampling intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from catalens.operators.draws import binomial_draws, poisson_draws, uniform52
from catalens.operators.metric import value_positions
from catalens.session import materialise


def _pearson(x: Column, y: Column, w: Column) -> Column:
    """Weighted correlation from sums; null when one side is constant."""
    sw, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
    sxy, sxx, syy = F.sum(w * x * y), F.sum(w * x * x), F.sum(w * y * y)
    vx, vy = sw * sxx - sx * sx, sw * syy - sy * sy
    return F.when((vx > 0) & (vy > 0), (sw * sxy - sx * sy) / F.sqrt(vx) / F.sqrt(vy))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman correlation with average ranks, as one row `rho`.

    Rows are first reduced to distinct value pairs with counts; ranks come from the distinct values of
    each side, scaled to (0, 1) so that the sums stay exact enough at any row count.
    """
    return _spearman(_value_pairs(df, a, b, "c"))


def _value_pairs(df: DataFrame, a: str, b: str, count: str) -> DataFrame:
    """x, y and their number of rows; rows with a null on either side are left out."""
    return (
        df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .groupBy(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
        .agg(F.count(F.lit(1)).alias(count))
    )


def _spearman(pairs: DataFrame) -> DataFrame:
    """The correlation from distinct value pairs x, y that occur c times."""

    def ranks(side: str) -> DataFrame:
        placed = value_positions(pairs, side, weight="c")
        centred = (F.col("below") + (F.col("c") + 1) / 2.0) / F.col("n") - (F.col("n") + 1) / (2.0 * F.col("n"))
        return placed.select(F.col("v").alias(side), centred.alias(f"r{side}"))

    ranked = pairs.join(ranks("x"), "x").join(ranks("y"), "y")
    return ranked.agg(_pearson(F.col("rx"), F.col("ry"), F.col("c").cast("double")).alias("rho"))


def index_percentile_interval(draws: DataFrame, draw: str, by: tuple[str, ...] = ()) -> DataFrame:
    """95% percentile interval picked by position: the floor(0.025 n)-th draw and the one before the
    floor(0.975 n)-th. Draws are one narrow row per replicate, so each group's sort is bounded by n."""
    order = Window.partitionBy(*by).orderBy(draw)
    placed = draws.where(F.col(draw).isNotNull()).withColumn("pos", F.row_number().over(order) - 1).withColumn(
        "n", F.count(F.lit(1)).over(Window.partitionBy(*by))
    )
    at_low = F.floor(F.lit(0.025) * F.col("n"))
    at_high = F.floor(F.lit(0.975) * F.col("n")) - 1
    return placed.groupBy(*by).agg(
        F.max(F.when(F.col("pos") == at_low, F.col(draw))).alias("low"),
        F.max(F.when(F.col("pos") == at_high, F.col(draw))).alias("high"),
    )


#: Tasks for work that multiplies few cells by many replicates; adaptive execution would merge such small inputs into one.
SPREAD = 32
#: Bins of values in which weighted ranks are summed up, per side.
RANK_BINS = 32

Flag = Column | tuple[Column, Column]


def _replicates(cells: DataFrame, n: int) -> DataFrame:
    """Every cell with every replicate; blocks of replicates are the unit of work."""
    blocks = cells.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // 100)))).repartition(SPREAD, "_block")
    first = F.col("_block") * 100
    return blocks.withColumn("replicate", F.explode(F.sequence(first, F.least(first + 99, F.lit(n - 1))))).drop("_block")


def bootstrap_proportion(df: DataFrame, flags: dict[str, Flag], n: int = 10_000, seed: int = 0) -> DataFrame:
    """Percentile bootstrap of shares: quantity, value, low, high, n; all quantities in one pass.

    A flag is a condition, or a condition and the one that rows must meet to count at all. Resampling k yes/no rows only
    depends on k and the number s of yes rows: the replicate's count is binomial, and one exact draw gives it.
    """
    parts = [f if isinstance(f, tuple) else (f, F.lit(True)) for f in flags.values()]
    wide = df.agg(*[c for i, (num, den) in enumerate(parts) for c in (
        F.count_if(den).alias(f"k{i}"), F.count_if(num & den).alias(f"s{i}"))])
    totals = materialise(wide.select(F.inline(F.array(*[
        F.struct(F.lit(label).alias("quantity"), F.col(f"k{i}").alias("k"), F.col(f"s{i}").alias("s")) for i, label in enumerate(flags)]))), "totals")
    draws = totals.where(F.col("k") > 0).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    u = uniform52(F.lit(str(seed)), F.col("quantity"), F.col("replicate").cast("string"))
    shares = binomial_draws(draws, "k", "s", u, laws=totals.where("k > 0")).select("quantity", (100.0 * F.col("drawn") / F.col("k")).alias("draw"))
    interval = index_percentile_interval(shares, "draw", ("quantity",))
    return totals.join(interval, "quantity").select(
        "quantity",
        F.bround(100.0 * F.col("s") / F.col("k"), 1).alias("value_pct"),
        F.bround("low", 1).alias("ci95_low"), F.bround("high", 1).alias("ci95_high"), F.col("k").alias("n"),
    )


def mask_cube(df: DataFrame, conditions: dict[str, Column], cluster: str) -> DataFrame:
    """cluster, mask, c: rows per cluster and set of conditions they meet (bit i: the i-th condition), from one pass.

    Any share of rows, and any basis that conditions describe, can be read from the cube without the rows. At most 62 conditions.
    """
    if len(conditions) > 62:
        raise ValueError("at most 62 conditions")
    bits = [F.when(c, F.lit(1 << i).cast("long")).otherwise(0) for i, c in enumerate(conditions.values())]
    mask = sum(bits[1:], bits[0])
    return df.groupBy(F.col(cluster).cast("string").alias("cluster"), mask.alias("mask")).agg(F.count(F.lit(1)).alias("c"))


def cluster_intervals(
    cube: DataFrame, names: list[str], quantities: dict[str, tuple[list[str], list[str]]], n: int = 10_000, seed: int = 0
) -> DataFrame:
    """Cluster bootstrap of shares read from a mask cube: quantity, value_pct, ci95_low, ci95_high, n.

    names: the cube's conditions in order; a quantity is the share of rows that meet all of its first list among those that meet all of
    its second (rows of the first list have to meet both). Whole clusters are resampled, so repeated rows of one key move
    together: each has a Poisson(1) weight per replicate. m clusters with the same counts together weigh Poisson(m), which is one
    exact draw; work follows the distinct counts, not the clusters.
    """
    def met(wanted: list[str]) -> Column:
        bits = sum(1 << names.index(w) for w in set(wanted))
        return F.col("mask").bitwiseAND(F.lit(bits).cast("long")) == F.lit(bits)

    per_cluster = cube.groupBy("cluster").agg(*[c for i, (num, den) in enumerate(quantities.values()) for c in (
        F.sum(F.when(met(num + den), F.col("c")).otherwise(0)).alias(f"num{i}"), F.sum(F.when(met(den), F.col("c")).otherwise(0)).alias(f"den{i}"))])
    long = per_cluster.select(F.inline(F.array(*[
        F.struct(F.lit(label).alias("quantity"), F.col(f"num{i}").alias("num"), F.col(f"den{i}").alias("den")) for i, label in enumerate(quantities)])))
    cells = materialise(long.groupBy("quantity", "num", "den").agg(F.count(F.lit(1)).alias("m")), "clusters")
    key = [F.lit(str(seed)), F.col("quantity"), *[F.col(c).cast("string") for c in ("num", "den", "replicate")]]
    counted = cells.where("den > 0")
    weighed = poisson_draws(_replicates(counted, n), "m", uniform52(*key), "w", laws=counted).where("w > 0")
    draws = weighed.groupBy("quantity", "replicate").agg(
        (100.0 * F.sum(F.col("num") * F.col("w")) / F.sum(F.col("den") * F.col("w"))).alias("draw"))
    interval = index_percentile_interval(draws, "draw", ("quantity",))
    point = cells.groupBy("quantity").agg(F.sum(F.col("num") * F.col("m")).alias("num"), F.sum(F.col("den") * F.col("m")).alias("n"))
    value = F.when(F.col("n") > 0, F.bround(100.0 * F.col("num") / F.nullif("n", F.lit(0)), 1))
    return point.join(interval, "quantity").select(
        "quantity", value.alias("value_pct"), F.bround("low", 1).alias("ci95_low"), F.bround("high", 1).alias("ci95_high"), "n")


def bootstrap_cluster(
    df: DataFrame, flags: dict[str, tuple[Column, Column]], cluster: str, n: int = 10_000, seed: int = 0
) -> DataFrame:
    """Cluster bootstrap of shares; `flags` maps a label to (numerator condition, denominator condition). See `cluster_intervals`."""
    conditions = {f"{kind}{i}": c for i, pair in enumerate(flags.values()) for kind, c in zip(("num", "den"), pair)}
    quantities = {label: ([f"num{i}"], [f"den{i}"]) for i, label in enumerate(flags)}
    return cluster_intervals(mask_cube(df, conditions, cluster), list(conditions), quantities, n, seed)


def bootstrap_spearman(df: DataFrame, a: str, b: str, n: int = 10_000, seed: int = 0) -> DataFrame:
    """Interval of the rank correlation: value, ci95_low, ci95_high, n.

    Rows are reduced to distinct value pairs; the m rows of a pair together weigh Poisson(m) in a replicate, one exact draw. Ranks are
    weighted average ranks inside the replicate, found in two levels: weights of the values below come from RANK_BINS sums per
    replicate, and from the values of the same bin, so no replicate is sorted in one task. Bins hold about equally many rows.
    Replicates with a constant side are skipped; rows with a null on either side are left out.
    """
    pairs = materialise(_value_pairs(df, a, b, "m"), "pairs")

    def bins(side: str) -> DataFrame:
        bin_ = F.floor(F.col("below") * RANK_BINS / F.col("n")).cast("int")
        return value_positions(pairs, side, weight="m").select(F.col("v").alias(side), bin_.alias(f"b{side}"))

    cells = materialise(pairs.join(bins("x"), "x").join(bins("y"), "y"), "cells")
    key = [F.lit(str(seed)), F.col("x").cast("string"), F.col("y").cast("string"), F.col("replicate").cast("string")]
    weighed = poisson_draws(_replicates(cells, n), "m", uniform52(*key), "w", laws=cells).where("w > 0")
    # Weights per replicate and bin of either side, then the weight below every bin as an array; no row of values is involved.
    sides = F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"b{s}").alias("bin")) for s in ("x", "y")]))
    binned = weighed.select("replicate", "w", sides).groupBy("replicate", "side", "bin").agg(F.sum("w").alias("w"))
    listed = binned.groupBy("replicate", "side").agg(F.sum("w").alias("all"), F.collect_list(F.struct("bin", "w")).alias("bins"))
    below = F.transform(F.sequence(F.lit(0), F.lit(RANK_BINS - 1)), lambda i: F.aggregate(
        F.filter("bins", lambda e: e["bin"] < i), F.lit(0).cast("long"), lambda acc, e: acc + e["w"]))
    listed = listed.withColumn("below", below)
    sums = listed.groupBy("replicate").agg(
        F.max("all").alias("all"), *[F.max(F.when(F.col("side") == s, F.col("below"))).alias(f"below_{s}") for s in ("x", "y")])
    placed = weighed.join(sums, "replicate")
    for side in ("x", "y"):
        inside = Window.partitionBy("replicate", f"b{side}").orderBy(side)  # default frame: ties included
        ties = F.sum("w").over(Window.partitionBy("replicate", f"b{side}", side))
        rank = F.get(F.col(f"below_{side}"), F.col(f"b{side}")) + F.sum("w").over(inside) - (ties - 1) / 2.0
        placed = placed.withColumn(f"r{side}", rank / F.col("all") - (F.col("all") + 1) / (2.0 * F.col("all")))
    draws = materialise(placed.groupBy("replicate").agg(_pearson(F.col("rx"), F.col("ry"), F.col("w").cast("double")).alias("draw")), "draws")
    interval = index_percentile_interval(draws, "draw")
    return interval.select(
        F.bround(_spearman(pairs.withColumnRenamed("m", "c")).scalar(), 3).alias("value"),
        F.bround("low", 3).alias("ci95_low"), F.bround("high", 3).alias("ci95_high"),
        pairs.agg(F.sum("m")).scalar().alias("n"),
    )


def interval_table(parts: list[tuple[DataFrame, str | Column]], others: list[tuple[DataFrame, str | Column]] = ()) -> DataFrame:
    """Interval outputs with the basis they were computed on and, for shares, the worst-case half-width in percent points.

    `others` are intervals of quantities that are no shares: their half-width is null. Each part is stored before the next one is
    planned, so that the driver holds the plan of one part, not of all."""
    width = F.bround(100.0 * 1.96 * F.sqrt(F.lit(0.25) / F.col("n")), 1)
    labelled = [
        materialise(df.withColumn("basis", basis if isinstance(basis, Column) else F.lit(basis)).withColumn("worst_half_width_pct", w), "intervals")
        for group, w in ((parts, width), (others, F.lit(None).cast("double"))) for df, basis in group
    ]
    return reduce(DataFrame.unionByName, labelled)
