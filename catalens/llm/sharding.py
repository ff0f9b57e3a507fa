"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their stratum; the rank r of n rows becomes the fraction
(r + 0.5) / n. Sorting all rows by this fraction interleaves the strata in proportion, so that cutting the order into
equal runs gives every shard the mixture of the whole table, with row counts at most one apart.

No stratum is sorted in one task: ranks come from fixed-size hash buckets within the stratum plus the number of rows in
the buckets before, and the global order is ranked in the same two levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from catalens.llm.common import stored

#: Rows that one window task ranks, about.
BUCKET_ROWS = 20_000


def interleave(rows: DataFrame, shards: int, id_col: str, stratum_col: str, seed: int = 42,
               bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add shard (0 to shards-1) and slot (gapless from 0 in each shard) to rows.

    rows should be slim: identifiers, stratum and whatever else is to be kept. A null stratum is a stratum of its own.
    Rows with equal identifiers, null ones too, are ordered by their remaining columns; rows equal in all columns take
    neighbouring places. An empty table gives an empty result. Columns of the caller may have any name except shard
    and slot, which are replaced.
    """
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    fields = [T.StructField(n, t, False) for n, t in (("_frac", T.DoubleType()), ("_tie", T.StringType()))]
    total = rows.count()
    if total == 0:
        return rows.select(*kept, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    buckets = total // bucket_rows + 1
    packed = rows.select(
        F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]).alias("_row"),
        F.when(F.col(f"`{stratum_col}`").isNull(), F.lit("-"))
        .otherwise(F.concat(F.lit("+"), F.col(f"`{stratum_col}`").cast("string"))).alias("_tie"),
        F.xxhash64(F.lit(seed), F.col(f"`{id_col}`")).alias("_hash"),
    ).withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))
    before = Window.partitionBy("_tie").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (packed.groupBy("_tie", "_bucket").agg(F.count("*").alias("_n"))
               .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
               .withColumn("_all", F.sum("_n").over(Window.partitionBy("_tie"))).drop("_n"))
    local = F.row_number().over(Window.partitionBy("_tie", "_bucket").orderBy("_hash", "_row"))
    ranked = packed.withColumn("_local", local).join(offsets, ["_tie", "_bucket"])
    ranked = stored(ranked.select(
        "_row", "_tie", ((F.col("_before") + F.col("_local") - F.lit(0.5)) / F.col("_all")).alias(fields[0].name),
    ).withColumn("_bucket", F.floor(F.col("_frac") * buckets)), "shard-ranks")
    ahead = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    places = (ranked.groupBy("_bucket").agg(F.count("*").alias("_n"))
              .withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n"))
    local = F.row_number().over(Window.partitionBy("_bucket").orderBy("_frac", "_tie", "_row"))
    place = F.col("_before") + F.col("_local") - 1
    return (ranked.withColumn("_local", local).join(places, "_bucket").withColumn("_place", place)
            .withColumn("_shard", F.expr(f"(_place * {shards}L) div {total}L").cast("int"))
            .withColumn("_slot", F.col("_place") - F.expr(f"(_shard * {total}L + {shards - 1}L) div {shards}L"))
            .select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(kept)],
                    F.col("_shard").alias("shard"), F.col("_slot").cast("long").alias("slot")))


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 42) -> DataFrame:
    """doc_id, source, size (bytes of the text plus 1), text_crc32, shard and slot of every document; rows law.

    A null text has size 1 and a null checksum; an empty text size 1 and checksum 0.
    """
    slim = docs.select(
        "doc_id", "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    return interleave(slim, shards, "doc_id", "source", seed)
