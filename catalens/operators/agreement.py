"""Inter-rater agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from catalens.functions.vocab import kappa_band


def cohens_kappa(pairs: DataFrame, by: Sequence[str] = ("field",), a: str = "a", b: str = "b") -> DataFrame:
    """Cohen's kappa per group: items, observed and expected agreement, kappa (null when expected is 1).

    Pairs are reduced to label-pair counts first; both margins then come from unfolding each cell into its
    two labels, so no join between the margins is needed.
    """
    by = list(by)
    cells = pairs.groupBy(*by, F.col(a).alias("la"), F.col(b).alias("lb")).agg(F.count(F.lit(1)).alias("c"))
    sides = cells.select(
        *by,
        F.inline(F.array(
            F.struct(F.col("la").alias("label"), F.col("c").alias("ca"), F.lit(0).cast("bigint").alias("cb"),
                     F.when(F.col("la") == F.col("lb"), F.col("c")).otherwise(0).alias("same")),
            F.struct(F.col("lb").alias("label"), F.lit(0).cast("bigint").alias("ca"), F.col("c").alias("cb"),
                     F.lit(0).cast("bigint").alias("same")),
        )),
    )
    margins = sides.groupBy(*by, "label").agg(
        F.sum("ca").alias("ca"), F.sum("cb").alias("cb"), F.sum("same").alias("same")
    )
    sums = margins.groupBy(*by).agg(
        F.sum("ca").alias("items"), F.sum("same").alias("same"),
        F.sum(F.col("ca").cast("double") * F.col("cb")).alias("products"),
    )
    n = F.col("items").cast("double")
    observed, expected = F.col("same") / n, F.col("products") / (n * n)
    return sums.select(
        *by, "items", observed.alias("observed"), expected.alias("expected"),
        F.when(expected < 1.0, (observed - expected) / (1.0 - expected)).alias("kappa"),
    )


def agreement_table(pairs: DataFrame, by: Sequence[str] = ("field",), digits: int = 3) -> DataFrame:
    """Kappa table rounded for reporting, with the Landis-Koch band of the unrounded value."""
    k = cohens_kappa(pairs, by)
    return k.select(
        *by, "items",
        F.bround("observed", digits).alias("observed_agreement"),
        F.bround("expected", digits).alias("expected_agreement"),
        F.bround("kappa", digits).alias("cohens_kappa"), kappa_band("kappa").alias("band"),
    )


def agreement_report(
    pairs: DataFrame,
    variants: dict[str, tuple],
    exclude: DataFrame | None = None,
    item: str = "item_id",
    by: Sequence[str] = ("field",),
) -> DataFrame:
    """Agreement under several readings of the same pairs.

    `variants` maps a name to (transform of a, transform of b); `exclude` lists items (optionally with a
    field) whose answer was known in advance, and adds a variant without them. The pairs are read once:
    every pair is unfolded into its variants.
    """
    source = pairs
    known: Column = F.lit(False)
    if exclude is not None:
        on = [c for c in (item, "field") if c in exclude.columns]
        marks = exclude.select(*on, F.lit(True).alias("_known")).distinct()
        source = pairs.join(marks, on, "left")
        known = F.coalesce(F.col("_known"), F.lit(False))
    entries = [
        F.struct(F.lit(name).alias("variant"), fa(F.col("a")).alias("a"), fb(F.col("b")).alias("b"),
                 F.lit(True).alias("keep"))
        for name, (fa, fb) in variants.items()
    ]
    if exclude is not None:
        entries.append(F.struct(
            F.lit("without excluded items").alias("variant"), F.col("a").alias("a"), F.col("b").alias("b"),
            (~known).alias("keep"),
        ))
    unfolded = source.select(*by, F.inline(F.array(*entries))).where("keep")
    return agreement_table(unfolded, ["variant", *by])
