"""Mixing sources to target weights by repetition rates (DataFrame functions only).

Words are summed per source; targets share a total by weight, and no source gives more than max_repeat times what it
has: the excess is shared again by weight among the others until none is above. The rate of a source is target over
size. A document is taken floor(rate) times, plus once more if a uniform number hashed from seed and doc_id is below
the rate's fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalens.llm.common import stored, unit, word_count

#: Weights that sources, ordered by code point with null last, take in turn.
WEIGHTS = (1, 2, 3)


def source_targets(sizes: DataFrame, weight: Column | None = None, max_repeat: int = 3, share: float = 1.0) -> DataFrame:
    """From rows (source, size) the table source, source_size, target; one row per source, also a null one.

    weight: a column of the grouped table (source, source_size, place from 0 in code-point order, null last); by
    default 1, 2, 3 in turn. The capped sources are those with the least size per weight, so the common level of the
    others follows from prefix sums over one row per source. Sources without any word get target 0.
    """
    if weight is None:
        weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    grouped = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ratio = F.lit(float(max_repeat)) * F.col("source_size") / F.col("weight")
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    capped = F.coalesce(F.sum(F.lit(max_repeat) * F.col("source_size")).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy()
    return (grouped.withColumn("place", F.row_number().over(order) - 1)
            .withColumn("weight", weight).withColumn("ratio", ratio)
            .withColumn("total", F.sum("source_size").over(every) * F.lit(share))
            .withColumn("level", (F.col("total") - capped) / open_weight)
            .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every))
            .select("source", "source_size", F.when(F.col("ratio") < F.col("level"), F.lit(max_repeat) * F.col("source_size"))
                    .otherwise(F.col("level") * F.col("weight")).cast("double").alias("target")))


def mixing_plan(docs: DataFrame, seed: int = 42, max_repeat: int = 3) -> DataFrame:
    """docs with _size, _source_size, _target and _copies (how often the mix takes the document).

    Null and empty texts have size 0; a null source is a source of its own. Rows that repeat a doc_id are drawn alike.
    """
    sized = docs.withColumn("_size", word_count(F.col("text")))
    targets = source_targets(sized.select("source", F.col("_size").alias("size")), max_repeat=max_repeat)
    targets = stored(targets.select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"),
                                    F.col("target").alias("_target")), "targets")
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    extra = (unit(seed, F.col("doc_id")) < F.col("_rate") - F.floor("_rate")).cast("long")
    return (sized.join(targets, sized["source"].eqNullSafe(F.col("_source"))).drop("_source")
            .withColumn("_rate", rate).withColumn("_copies", F.floor("_rate") + extra).drop("_rate"))


def mix(docs: DataFrame, seed: int = 42, max_repeat: int = 3) -> DataFrame:
    """The mixed table itself: every document as many times as the plan takes it, with the columns of docs."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_document"), "doc_id", "source", "text")
    plan = mixing_plan(packed, seed, max_repeat).filter("_copies > 0")
    return plan.select("_document", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_document.*")
