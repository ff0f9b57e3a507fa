"""Reproducible samples: order by a seeded hash instead of a stateful generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from catalens.functions.numeric import seeded_order
from catalens.operators.keys import _first_per
from catalens.operators.metric import rows_of


def seeded_sample(df: DataFrame, key: str, n: int, seed) -> DataFrame:
    """Simple random sample of n rows, with population and sample size (a top-n by hash: every task keeps
    its own n smallest, nothing is sorted globally)."""
    population = rows_of(df)
    sample = df.withColumn("_h", seeded_order(seed, key)).orderBy("_h", key).limit(n).drop("_h")
    return sample.select(
        "*", population.alias("population_size"), F.least(F.lit(n).cast("bigint"), population).alias("sample_size")
    )


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed) -> DataFrame:
    """Proportional sample: each stratum gets its rounded share, at least one row; a surplus is trimmed and a
    deficit topped up by the global hash order.

    Only the first 2n rows of every stratum can be chosen by either step, so the rank filter bounds what
    leaves the map side before the quotas are known.
    """
    hashed = df.withColumn("_h", seeded_order(seed, key))
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_size"))
    share = F.col("_size") / sizes.agg(F.sum("_size")).scalar()
    quota = F.least(F.greatest(F.lit(1), F.bround(share * n, 0).cast("bigint")), F.col("_size"))
    quotas = sizes.select(F.col(stratum).alias("_stratum"), quota.alias("_quota"))
    heads = _first_per(hashed, [stratum], [F.col("_h").asc(), F.col(key).asc()], 2 * n)
    marked = heads.join(quotas, heads[stratum].eqNullSafe(quotas["_stratum"])).withColumn(
        "_picked", F.col("_rank") <= F.col("_quota")
    )
    return marked.orderBy(F.desc("_picked"), "_h", key).limit(n).drop("_h", "_rank", "_stratum", "_quota", "_picked")


def with_item_ids(sample: DataFrame, prefix: str, order: list[str], n: int) -> DataFrame:
    """Consecutive item ids (B001, B002, ...) over a sample of at most n rows."""
    bounded = sample.orderBy(*order).limit(n)
    return bounded.withColumn("_i", F.row_number().over(Window.orderBy(*order))).withColumn(
        "item_id", F.format_string(f"{prefix}%03d", F.col("_i"))
    ).drop("_i")


def rater_subset(b: DataFrame, c: DataFrame, n: int, b_target: str, c_target: str) -> DataFrame:
    """Items a second rater codes: the first half of n from part B, the rest from part C."""
    half = n // 2
    number = F.regexp_extract("item_id", r"(\d+)$", 1).cast("long")  # B1000 comes after B101
    left = b.orderBy(number, "item_id").limit(half).select("item_id", F.lit("B").alias("part"), F.col(b_target).alias("target"))
    right = c.orderBy(number, "item_id").limit(n - half).select(
        "item_id", F.lit("C").alias("part"), F.col(c_target).alias("target")
    )
    return left.unionByName(right)
