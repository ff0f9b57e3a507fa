"""Building blocks shared by the reports: one-pass metric tables, exact quantiles, ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from catalens.functions.numeric import col, pct


def rows_of(df: DataFrame) -> Column:
    """Row count of a frame as a scalar subquery, to be used as a denominator."""
    return df.agg(F.count(F.lit(1))).scalar()


def long_form(wide: DataFrame, cells: Sequence[tuple[str, Sequence[Column]]], label: str, columns: Sequence[str]):
    """Turn a one-row frame into one row per (label, cells...)."""
    entries = [
        F.struct(F.lit(name).alias(label), *[c.alias(n) for c, n in zip(values, columns)]) for name, values in cells
    ]
    return wide.select(F.inline(F.array(*entries)))


def metric_block(
    df: DataFrame,
    metrics: Sequence[tuple[str, Column, bool]],
    total: Column | None = None,
    digits: int = 1,
    names: tuple[str, str, str] = ("metric", "value", "share_pct"),
) -> DataFrame:
    """Many metrics in a single aggregation pass, one row each.

    `metrics` holds (label, aggregate, with_share); the share is taken of `total` (rows by default)
    and null where `with_share` is false.
    """
    total = F.count(F.lit(1)) if total is None else total
    aggs = [agg.cast("double").alias(f"m{i}") for i, (_, agg, _) in enumerate(metrics)]
    wide = df.agg(total.cast("double").alias("total"), *aggs)
    cells = [
        (
            label,
            (
                F.col(f"m{i}"),
                pct(F.col(f"m{i}"), F.col("total"), digits) if share else F.lit(None).cast("double"),
            ),
        )
        for i, (label, _, share) in enumerate(metrics)
    ]
    return long_form(wide, cells, names[0], names[1:])


def keyed_counts(df: DataFrame, key: str, flags: dict[str, Column]) -> DataFrame:
    """Row counts per key for each flag: the map-side combine that makes key-level metrics cheap.

    Rows of the result are one per key, so 'keys with at least one flagged row' needs no count-distinct
    (which would multiply every row once per distinct expression).
    """
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(flag).alias(name) for name, flag in flags.items()]
    )


def distribution(
    df: DataFrame,
    attribute,
    key: str | None,
    names: tuple[str, str, str, str] = ("value", "rows", "keys", "rows_pct"),
    total: Column | None = None,
    drop_null: bool = True,
) -> DataFrame:
    """Rows, distinct keys and share of rows per value of an attribute."""
    value, rows, keys, share = names
    base = df.select(col(attribute).alias(value), *([F.col(key).alias("_key")] if key else []))
    counted = F.when(F.col(value).isNotNull(), F.col("_key")) if drop_null else F.col("_key")
    aggs = [F.count(F.lit(1)).alias(rows)] + ([F.count_distinct(counted).alias(keys)] if key else [])
    # The rows without a value are one more group, so the total comes from the groups and the data is read once.
    total = F.sum(rows).over(Window.partitionBy()) if total is None else total
    shared = base.groupBy(value).agg(*aggs).withColumn(share, pct(F.col(rows), total))
    return shared.where(F.col(value).isNotNull()) if drop_null else shared


def magnitude_bin(c: Column) -> Column:
    """Order-preserving bin of a number, a 6,000th of its magnitude wide: about 4,096 bins per factor of two."""
    size = F.floor(F.log2(F.abs(c)) * 4096) + 5_000_000
    return F.when(c == 0, 0).when(c > 0, size).otherwise(-size).cast("bigint")


def value_positions(df: DataFrame, value, by: Sequence[str] = (), weight=None, sums: dict[str, Column] | None = None) -> DataFrame:
    """Distinct values with their count, the rows below them and the group size.

    The running count is built in two levels (offsets per bin, then inside each bin), so the sorted
    domain is never gathered into one task: the top level holds bins, not rows. `sums` are added up per value.
    """
    by, sums = list(by), sums or {}
    weight = F.lit(1) if weight is None else col(weight)
    counted = (
        df.where(col(value).isNotNull())
        .groupBy(*by, col(value).cast("double").alias("v"))
        .agg(F.sum(weight.cast("bigint")).alias("c"), *[F.sum(c).alias(name) for name, c in sums.items()])
        .withColumn("bin", magnitude_bin(F.col("v")))
    )
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        counted.groupBy(*by, "bin")
        .agg(F.sum("c").alias("bin_rows"))
        .withColumn("offset", F.coalesce(F.sum("bin_rows").over(upto), F.lit(0)))
        .withColumn("n", F.sum("bin_rows").over(whole))
        .drop("bin_rows")
    )
    inside = Window.partitionBy(*by, "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    return (
        counted.join(bins, [*by, "bin"])
        .withColumn("below", F.col("offset") + F.coalesce(F.sum("c").over(inside), F.lit(0)))
        .select(*by, "v", "c", "below", "n", *sums)
    )


def exact_quantiles(df: DataFrame, value, probabilities: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolated quantiles, one column per entry of `probabilities`; a row per group."""
    by = list(by)
    picks, results = quantile_columns(probabilities)
    out = value_positions(df, value, by).groupBy(*by).agg(F.max("n").alias("n"), *picks)
    return out.select(*by, *results)


def quantile_columns(probabilities: dict[str, float]) -> tuple[list[Column], list[Column]]:
    """Aggregates over value positions, and the quantiles made of them next to a column n of the group size."""
    picks = []
    for name, p in probabilities.items():
        rank = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.floor(rank), F.ceil(rank)
        for suffix, at in (("lo", low), ("hi", high)):
            hit = (F.col("below") <= at) & (at < F.col("below") + F.col("c"))
            picks.append(F.max(F.when(hit, F.col("v"))).alias(f"{name}_{suffix}"))
    results = []
    for name, p in probabilities.items():
        rank = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        results.append((lo + (hi - lo) * (rank - F.floor(rank))).alias(name))
    return picks, results
