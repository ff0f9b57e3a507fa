"""Key resolution, deduplication, joins and set comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from catalens.functions.numeric import col
from catalens.functions.text import is_present, parse_repo_url, text_or_empty, to_time


def _first_per(df: DataFrame, keys: Sequence, order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows per key. The rank filter prunes on the map side, so a key that holds a large
    part of the data sends only n rows per input partition to its reducer."""
    place = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(place)).where(F.col("_rank") <= n)


def latest_per_key(df: DataFrame, key: str, flag: str, ts: str, ordinal: str) -> DataFrame:
    """Latest row per key: flagged rows first, then the greatest timestamp, then the earliest ordinal."""
    order = [F.coalesce(F.col(flag), F.lit(False)).desc(), text_or_empty(ts).desc(), F.col(ordinal).asc()]
    return _first_per(df.where(is_present(key)), [key], order).drop("_rank")


def collect_targets(
    packages: DataFrame,
    type_col: str,
    id_col: str,
    ordinal: Sequence[str],
    include: Sequence[str] | None = None,
    latest_flag: str | None = None,
) -> DataFrame:
    """First row per (type, identifier) under an allow list and, optionally, latest rows only."""
    df = packages.where(is_present(F.col(type_col).cast("string")) & is_present(F.col(id_col).cast("string")))
    if latest_flag:
        df = df.where(F.coalesce(F.col(latest_flag), F.lit(False)))
    if include is not None:
        df = df.where(F.col(type_col).isin(*include))
    return _first_per(df, [type_col, id_col], [F.col(c).asc() for c in ordinal]).drop("_rank")


def collect_repos(
    versions: DataFrame, url: str, key: str, ordinal: str, latest_flag: str | None = None
) -> DataFrame:
    """Distinct repositories with the first key that declares each of them."""
    df = versions if latest_flag is None else versions.where(F.coalesce(F.col(latest_flag), F.lit(False)))
    parsed = df.select(
        parse_repo_url(url).alias("r"), F.col(key).alias("declared_by"), F.col(url).alias("declared_url"),
        F.col(ordinal).alias("_ordinal"),
    ).select("r.*", "declared_by", "declared_url", "_ordinal")
    parsed = parsed.where(F.col("owner").isNotNull() & F.col("repo").isNotNull())
    return _first_per(parsed, ["owner", "repo"], [F.col("_ordinal").asc()]).select(
        F.concat_ws("/", "owner", "repo").alias("repo_full_name"),
        F.col("owner").alias("repo_owner"), F.col("repo").alias("repo_name"), "declared_by", "declared_url",
    )


def richness(description, has_schema) -> Column:
    """Score of an extracted definition: description length, plus a bonus for a schema."""
    return F.length(text_or_empty(description)) + F.when(F.coalesce(col(has_schema), F.lit(False)), 50).otherwise(0)


def dedupe_richest(df: DataFrame, keys: Sequence[str], score: Column, ordinal: Sequence[str]) -> DataFrame:
    """Richest duplicate per key; equal scores keep the first."""
    scored = df.withColumn("_score", score)
    order = [F.col("_score").desc(), *[F.col(c).asc() for c in ordinal]]
    return _first_per(scored, list(keys), order).drop("_rank", "_score")


def attach_counts(versions: DataFrame, latest: DataFrame, key: str, ts: str) -> DataFrame:
    """Add version_count and first_published_at to a one-row-per-key frame (left join, missing counts are 1)."""
    counts = versions.groupBy(key).agg(
        F.count(F.lit(1)).alias("version_count"), F.min(to_time(ts)).alias("first_published_at")
    )
    return latest.join(counts, key, "left").withColumn(
        "version_count", F.coalesce(F.col("version_count"), F.lit(1)).cast("bigint")
    )


def latest_with_counts(df: DataFrame, key: str, flag: str, ts: str, ordinal: str) -> DataFrame:
    """`latest_per_key` and `attach_counts` in a single aggregation: one shuffle, combined on the map side."""
    ranked = F.struct(
        F.coalesce(F.col(flag), F.lit(False)), text_or_empty(ts), -F.col(ordinal).cast("bigint")
    )
    return (
        df.where(is_present(key))
        .groupBy(key)
        .agg(
            F.max_by(F.struct(*[c for c in df.columns if c != key]), ranked).alias("_row"),
            F.count(F.lit(1)).alias("version_count"),
            F.min(to_time(ts)).alias("first_published_at"),
        )
        .select(key, "_row.*", "version_count", "first_published_at")
    )


def attach_child_aggs(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, aggs: dict[str, Column]):
    """Aggregates of a child table joined to its parent; parents without children keep nulls."""
    grouped = child.groupBy(F.col(child_key).alias("_child_key")).agg(*[a.alias(n) for n, a in aggs.items()])
    return parent.join(grouped, parent[parent_key] == grouped["_child_key"], "left").drop("_child_key")


def zero_fill_counts(
    left: DataFrame, events: DataFrame, resolved: DataFrame, key: str, count_name: str = "events"
) -> DataFrame:
    """Event counts for the rows whose key was resolved; keys without events count 0 and stay."""
    counts = events.groupBy(key).agg(F.count(F.lit(1)).alias(count_name))
    return (
        left.join(resolved.select(key), key, "left_semi")
        .join(counts, key, "left")
        .withColumn(count_name, F.coalesce(F.col(count_name), F.lit(0)).cast("bigint"))
    )


def merge_codes(base: DataFrame, coded: DataFrame, key: str, take: Sequence[str]) -> DataFrame:
    """Coded rows with the automated columns of `base`; `key_matched` marks keys the base knows."""
    automated = base.select(key, *take, F.lit(True).alias("key_matched"))
    return coded.join(automated, key, "left").withColumn(
        "key_matched", F.coalesce(F.col("key_matched"), F.lit(False))
    )


def outer_merge_zero(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Full outer join of two keyed series; the missing side becomes 0."""
    values = [c for c in a.columns + b.columns if c != on]
    return a.join(b, on, "full_outer").fillna(0, subset=values)


def rater_pairs(
    a: DataFrame,
    b: DataFrame,
    item: str,
    fields: dict[str, str | None],
    part: str | None = None,
    include_blank: bool = False,
) -> DataFrame:
    """Values of two coders per item and field.

    `fields` maps a field to the part of the code book it belongs to (None: any). Pairs are limited to the
    field's own part, so blank cells of the other part cannot inflate agreement; `include_blank` restores
    them. The join runs once per item, the fields are unfolded afterwards.
    """
    left = a.select(item, *([part] if part else []), F.struct(*fields).alias("_a"))
    right = b.select(item, F.struct(*fields).alias("_b"))
    entries = []
    for name, own in fields.items():
        keep = F.lit(True) if own is None or part is None or include_blank else F.col(part) == own
        entries.append(
            F.struct(
                F.lit(name).alias("field"),
                F.trim(text_or_empty(F.col(f"_a.{name}").cast("string"))).alias("a"),
                F.trim(text_or_empty(F.col(f"_b.{name}").cast("string"))).alias("b"),
                F.coalesce(keep, F.lit(False)).alias("_keep"),
            )
        )
    return (
        left.join(right, item)
        .select(item, *([part] if part else []), F.inline(F.array(*entries)))
        .where("_keep")
        .drop("_keep")
    )


def disagreements(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return pairs.where(~F.col(a).eqNullSafe(F.col(b)))


def extractor_agreement(
    a: DataFrame, b: DataFrame, key: str, item: str, names: int = 12, scanned: DataFrame | None = None
) -> DataFrame:
    """Two extractors compared as sets per key: sizes, one-sided counts and the first one-sided names.

    Comparable means that the second extractor looked at the key at all; otherwise its columns stay empty. `scanned` says
    so for every key in question (key, parsed), also for keys where neither found anything; without it, a key counts as
    looked at if the second extractor found something.
    """
    tagged = a.select(key, item, F.lit(True).alias("_in_a")).unionByName(
        b.select(key, item, F.lit(False).alias("_in_a"))
    )
    flags = tagged.groupBy(key, item).agg(
        F.bool_or("_in_a").alias("_a"), F.bool_or(~F.col("_in_a")).alias("_b")
    )
    has = F.col(item).isNotNull()
    sizes = flags.groupBy(key).agg(
        F.bool_or("_b").alias("comparable"),
        F.count_if(F.col("_a") & has).alias("items_a"),
        F.count_if(F.col("_b") & has).alias("items_b"),
        F.count_if(F.col("_a") & ~F.col("_b") & has).alias("only_a"),
        F.count_if(F.col("_b") & ~F.col("_a") & has).alias("only_b"),
    )
    # No filter on the item here: it would be pushed below the grouping, and the shuffle could not be shared.
    one_sided = flags.where(F.col("_a") != F.col("_b"))
    listed = _first_per(one_sided, [key, "_a"], [F.col(item).asc_nulls_last()], names).groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("_a"), F.col(item)))), "|").alias("only_a_names"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("_b"), F.col(item)))), "|").alias("only_b_names"),
    )
    known = F.col("comparable")
    if scanned is not None:
        sizes = scanned.select(key, F.col("parsed").alias("comparable")).join(sizes.drop("comparable"), key, "left").na.fill(
            0, ["items_a", "items_b", "only_a", "only_b"])
    return sizes.join(listed, key, "left").select(
        key, "comparable", "items_a",
        F.when(known, F.col("items_b")).alias("items_b"),
        F.when(known, F.col("only_a")).otherwise(0).cast("bigint").alias("only_a"),
        F.when(known, F.col("only_b")).otherwise(0).cast("bigint").alias("only_b"),
        F.when(known, text_or_empty("only_a_names")).otherwise("").alias("only_a_names"),
        F.when(known, text_or_empty("only_b_names")).otherwise("").alias("only_b_names"),
    )


def siblings(df: DataFrame, parent: str, item: str, n: int) -> DataFrame:
    """Other items of the same parent: their number and the first n in name order.

    Only the first n + 1 names of a parent can ever be shown, so no parent is collected whole.
    """
    distinct = df.select(parent, item).distinct()
    counts = distinct.groupBy(parent).agg(F.count(F.lit(1)).alias("_members"))
    heads = _first_per(distinct, [parent], [F.col(item).asc()], n + 1).groupBy(parent).agg(
        F.array_sort(F.collect_list(item)).alias("_head")
    )
    return (
        distinct.join(counts.join(heads, parent), parent)
        .select(
            parent, item,
            (F.col("_members") - 1).alias("sibling_count"),
            F.slice(F.array_remove(F.col("_head"), F.col(item)), 1, n).alias("siblings"),
        )
    )


def set_diff(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct values with the side they occur on: left, right or both."""
    both = a.select(F.col(column), F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        b.select(F.col(column), F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    grouped = both.groupBy(column).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    side = F.when((F.col("_l") == 1) & (F.col("_r") == 1), "both").when(F.col("_l") == 1, "left").otherwise("right")
    return grouped.select(column, side.alias("side"))


def pending(targets: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Targets whose key is not finished yet (null-safe keys)."""
    d = done.select(*[F.col(k).alias(f"_done_{k}") for k in keys]).distinct()
    match = None
    for k in keys:
        same = targets[k].eqNullSafe(d[f"_done_{k}"])
        match = same if match is None else match & same
    return targets.join(d, match, "left_anti")


def pending_counts(targets: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many targets there are, how many of them are done and how many are pending."""
    flagged = targets.select(*keys, F.lit(1).alias("_t"), F.lit(0).alias("_d")).unionByName(
        done.select(*keys, F.lit(0).alias("_t"), F.lit(1).alias("_d"))
    )
    per_key = flagged.groupBy(*keys).agg(F.sum("_t").alias("_t"), F.max("_d").alias("_d"))
    zero = F.lit(0)
    return per_key.agg(
        F.coalesce(F.sum("_t"), zero).cast("bigint").alias("targets"),
        F.coalesce(F.sum(F.when(F.col("_d") == 1, F.col("_t"))), zero).cast("bigint").alias("done"),
        F.coalesce(F.sum(F.when(F.col("_d") == 0, F.col("_t"))), zero).cast("bigint").alias("pending"),
    )
