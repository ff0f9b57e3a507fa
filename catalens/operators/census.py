"""Census reports: totals, completeness, concentration, growth, descriptions and names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from catalens import fixed_values as fx
from catalens.functions.numeric import col, pct
from catalens.functions.text import (
    month_of, name_flags, namespace, text_or_empty, to_time, url_flags, url_host, word_count,
)
from catalens.operators.keys import outer_merge_zero
from catalens.operators.metric import distribution, long_form, metric_block, quantile_columns, rows_of, value_positions


def census_overview(versions: DataFrame, latest: DataFrame) -> DataFrame:
    """Headline counts: one aggregate per input, the version total enters as a scalar subquery."""
    total_versions = rows_of(versions)
    one = F.lit(1)
    # Distinct namespaces by a first aggregation per namespace, so no count-distinct expands the rows.
    flags = {
        "with_packages": F.col("has_packages"), "with_remotes": F.col("has_remotes"),
        "with_repository": F.col("has_repository"), "deprecated": F.col("status") == "deprecated",
    }
    per_namespace = latest.groupBy(namespace("name").alias("ns")).agg(
        F.count(one).alias("servers"), *[F.count_if(c).alias(n) for n, c in flags.items()]
    )
    sums = per_namespace.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).cast("double").alias(n) for n in ("servers", *flags)],
        F.count(one).cast("double").alias("namespaces"),
    )
    wide = sums.select("*", total_versions.cast("double").alias("versions"))
    servers, nothing = F.col("servers"), F.lit(None).cast("double")
    mean = F.when(servers > 0, F.bround(F.col("versions") / servers, 2)).otherwise(0.0)
    cells = [
        ("published_server_names", (servers, F.lit(100.0))),
        ("published_versions", (F.col("versions"), nothing)),
        ("versions_per_server_mean", (mean, nothing)),
        ("servers_with_packages", (F.col("with_packages"), pct("with_packages", servers))),
        ("servers_with_remote_endpoint", (F.col("with_remotes"), pct("with_remotes", servers))),
        ("servers_with_repository", (F.col("with_repository"), pct("with_repository", servers))),
        ("servers_deprecated", (F.col("deprecated"), pct("deprecated", servers))),
        ("distinct_namespaces", (F.col("namespaces"), nothing)),
    ]
    return long_form(wide, cells, "metric", ("value", "share_of_servers_pct"))


def field_completeness(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Present, missing and present share per field; `fields` maps a label to its presence condition."""
    wide = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(f"f{i}") for i, c in enumerate(fields.values())]
    )
    cells = [
        (label, (F.col(f"f{i}"), F.col("n") - F.col(f"f{i}"), pct(F.col(f"f{i}"), F.col("n"))))
        for i, label in enumerate(fields)
    ]
    out = long_form(wide, cells, "field", ("present", "missing", "present_pct"))
    return out.orderBy(F.desc("present_pct"), "field")


def namespace_members(latest: DataFrame, name: str = "name", min_servers: int = 3) -> DataFrame:
    """Members and rows per namespace, with the recurring flag."""
    return (
        latest.groupBy(namespace(name).alias("namespace"))
        .agg(F.count_distinct(name).alias("servers"), F.count(F.lit(1)).alias("versions"))
        .withColumn("recurring", F.col("servers") >= min_servers)
    )


def namespace_concentration(latest: DataFrame, name: str = "name", top_n: int = 25, min_servers: int = 3) -> DataFrame:
    """Largest namespaces."""
    return namespace_members(latest, name, min_servers).orderBy(F.desc("servers"), "namespace").limit(top_n)


def recurring_share(latest: DataFrame, name: str = "name", min_servers: int = 3) -> DataFrame:
    """How many namespaces recur and which share of all servers they hold."""
    return namespace_members(latest, name, min_servers).agg(
        F.count_if("recurring").alias("recurring_namespaces"),
        F.coalesce(F.sum(F.when(F.col("recurring"), F.col("servers"))), F.lit(0)).alias("servers_held"),
        pct(F.sum(F.when(F.col("recurring"), F.col("servers")).otherwise(0)), F.sum("servers")).alias("share_pct"),
    )


def multivalue_distribution(df: DataFrame, values, key: str, names=("value", "rows", "keys", "rows_pct")) -> DataFrame:
    """Distribution of a multi-valued attribute; the share is of all rows, not of the unfolded ones."""
    unfolded = df.select(F.explode(col(values)).alias(names[0]), F.col(key)).where(F.col(names[0]) != "")
    return distribution(unfolded, names[0], key, names, total=rows_of(df))


def category_distribution(df: DataFrame, attribute, key: str | None = None, names=("value", "rows", "keys", "rows_pct")):
    """Distribution of a single-valued attribute."""
    return distribution(df, attribute, key, names)


def schema_adoption(df: DataFrame, schema: str, key: str) -> DataFrame:
    """Rows and keys per revision date named in the schema address; anything else is 'unknown'."""
    revision = F.nullif(F.regexp_extract(text_or_empty(schema), fx.REVISION_PATTERN, 1), F.lit(""))
    return distribution(
        df, F.coalesce(revision, F.lit("unknown")), key, ("schema_version", "versions", "servers", "versions_pct")
    )


def publishing_timeline(df: DataFrame, key: str, ts: str) -> DataFrame:
    """New rows, new keys and both running totals per month."""
    dated = df.select(F.col(key).alias("k"), month_of(ts).alias("month")).where(F.col("month").isNotNull())
    # One narrow table per (key, month) feeds both series.
    monthly = dated.groupBy("k", "month").agg(F.count(F.lit(1)).alias("c"))
    new_rows = monthly.groupBy("month").agg(F.sum("c").alias("new_versions"))
    first = monthly.where(F.col("k").isNotNull()).groupBy("k").agg(F.min("month").alias("month"))
    new_keys = first.groupBy("month").agg(F.count(F.lit(1)).alias("new_servers"))
    months = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)  # one row per month
    return (
        outer_merge_zero(new_rows, new_keys, "month")
        .withColumn("cumulative_servers", F.sum("new_servers").over(months))
        .withColumn("cumulative_versions", F.sum("new_versions").over(months))
    )


def count_distribution(df: DataFrame, c: str, names=("versions_published", "servers", "servers_pct")) -> DataFrame:
    """Frequency of frequencies."""
    counts = df.groupBy(F.col(c).alias(names[0])).agg(F.count(F.lit(1)).alias(names[1]))
    shared = counts.withColumn(names[2], pct(F.col(names[1]), F.sum(names[1]).over(Window.partitionBy())))
    return shared.where(F.col(names[0]).isNotNull()).orderBy(names[0])


def capped_histogram(df: DataFrame, c: str, cap: int = 20, names=("bucket", "rows")) -> DataFrame:
    """Histogram with one overflow bucket above the cap (cap + 1 means 'more than cap')."""
    bucket = F.least(F.col(c), F.lit(cap + 1)).cast("bigint")
    return (
        df.where(F.col(c).isNotNull()).groupBy(bucket.alias(names[0])).agg(F.count(F.lit(1)).alias(names[1]))
        .orderBy(names[0])
    )


def description_issues(df: DataFrame, description: str, title: str) -> DataFrame:
    """Missing, too short and title-repeating descriptions; null text counts as empty text."""
    text = text_or_empty(description)
    same = F.lower(F.trim(text)) == F.lower(F.trim(text_or_empty(title)))
    return metric_block(
        df,
        [
            ("missing description", F.count_if(text == ""), True),
            ("fewer than 5 words", F.count_if(word_count(description) < 5), True),
            ("identical to title", F.count_if(same), True),
        ],
        names=("issue", "servers", "servers_pct"),
    )


def description_stats(df: DataFrame, description: str) -> DataFrame:
    """Mean, median and 90th percentile of the length, mean word count."""
    lengths = df.select(F.length(text_or_empty(description)).alias("len"), word_count(description).alias("words"))
    picks, quantiles = quantile_columns({"p50": 0.5, "p90": 0.9})
    rows = F.sum("c").cast("double")
    wide = value_positions(lengths, "len", sums={"words": F.col("words")}).agg(
        F.max("n").alias("n"), (F.sum(F.col("v") * F.col("c")) / rows).alias("mean_len"), (F.sum("words") / rows).alias("mean_words"), *picks
    ).select("mean_len", "mean_words", *quantiles)
    cells = [
        ("description length (chars)", (F.bround("mean_len", 1),)),
        ("description length p50", (F.bround("p50", 1),)),
        ("description length p90", (F.bround("p90", 1),)),
        ("description words (mean)", (F.bround("mean_words", 1),)),
    ]
    return long_form(wide, cells, "statistic", ("value",))


def naming_conventions(df: DataFrame, name: str) -> DataFrame:
    """Violations of the reverse-DNS naming convention."""
    flagged = df.select(name_flags(name).alias("f"))
    return metric_block(
        flagged,
        [
            ("no slash separator", F.count_if(~F.col("f.has_namespace")), True),
            ("namespace without dot (not reverse-DNS)", F.count_if("f.namespace_without_dot"), True),
            ("uppercase in server segment", F.count_if("f.local_upper"), True),
            ("space in server segment", F.count_if("f.local_space"), True),
            ("underscore in server segment", F.count_if("f.local_underscore"), True),
        ],
        names=("pattern", "servers", "servers_pct"),
    )


def group_compare(df: DataFrame, predicates: dict[str, Column], value: str, flagged: Column) -> DataFrame:
    """Size, median, mean and flagged share of overlapping groups, one row per predicate; zeros for an empty group."""
    labels = F.array_compact(F.array(*[F.when(p, F.lit(label)) for label, p in predicates.items()]))
    # Unfolding happens after the rows are reduced to (groups, value, flag) cells with counts.
    cells = (
        df.select(labels.alias("labels"), F.col(value).cast("double").alias("v"), flagged.alias("hit"))
        .groupBy("labels", "v", "hit").agg(F.count(F.lit(1)).alias("c"))
        .select(F.explode("labels").alias("group"), "v", "hit", "c")
    )
    picks, quantiles = quantile_columns({"median_versions": 0.5})
    hits = F.when(F.col("hit"), F.col("c")).otherwise(0)
    placed = value_positions(cells, "v", ["group"], weight="c", sums={"hits": hits})
    found = placed.groupBy("group").agg(
        F.max("n").alias("n"), F.sum("c").alias("servers"), F.sum(F.col("v") * F.col("c")).alias("total"), F.sum("hits").alias("hits"), *picks
    ).select("group", "servers", *quantiles, F.bround(F.col("total") / F.col("servers"), 2).alias("mean_versions"),
             pct("hits", "servers").alias("share_deprecated_pct"))
    labelled = df.sparkSession.createDataFrame([(label,) for label in predicates], "group string")
    return labelled.join(found, "group", "left").na.fill(0)


def endpoint_hygiene(df: DataFrame, url: str, key: str, strict_compat: bool = False) -> DataFrame:
    """Scheme and host facts of endpoints. The share of distinct hosts and servers is left empty."""
    base = df.select(
        F.col(key).alias("k"), url_host(url, strict_compat).alias("host"), url_flags(url, strict_compat).alias("f")
    )
    names = ("plaintext", "bare_ip", "localhost")
    # Cells per (host, key) first: both distinct counts then come from small tables.
    cells = base.groupBy("host", "k").agg(
        F.count(F.lit(1)).alias("c"), *[F.count_if(F.col(f"f.{n}")).alias(n) for n in names]
    )
    keys = cells.where(F.col("k").isNotNull()).select("k").distinct()
    hosts = cells.where(F.col("host").isNotNull()).select("host").distinct()
    wide = cells.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).cast("double").alias(n) for n in ("c", *names)]
    ).select(
        "*", rows_of(keys).cast("double").alias("keys"), rows_of(hosts).cast("double").alias("hosts")
    )
    nothing = F.lit(None).cast("double")
    return long_form(
        wide,
        [
            ("remote endpoints", (F.col("c"), pct("c", "c"))),
            ("servers with a remote endpoint", (F.col("keys"), nothing)),
            ("plaintext http endpoints", (F.col("plaintext"), pct("plaintext", "c"))),
            ("endpoints on a bare IP address", (F.col("bare_ip"), pct("bare_ip", "c"))),
            ("endpoints pointing at localhost", (F.col("localhost"), pct("localhost", "c"))),
            ("distinct hosts", (F.col("hosts"), nothing)),
        ],
        "metric", ("value", "share_pct"),
    )


def top_hosts(df: DataFrame, url: str, key: str, n: int = 30, strict_compat: bool = False) -> DataFrame:
    """Hosts by number of distinct keys."""
    return (
        df.select(url_host(url, strict_compat).alias("host"), F.col(key).alias("k"))
        .where(F.col("host").isNotNull())
        .groupBy("host").agg(F.count(F.lit(1)).alias("endpoints"), F.count_distinct("k").alias("servers"))
        .orderBy(F.desc("servers"), "host").limit(n)
    )


def release_gaps(df: DataFrame, key: str, ts: str, bucket: str = "yyyy-MM-dd") -> DataFrame:
    """Days between consecutive rows of a key.

    A key is split into calendar buckets, so even a key that owns a third of all rows is sorted in many
    tasks. Gaps across a bucket border come from the first and last time of the buckets, one row each.
    """
    dated = df.select(F.col(key).alias("k"), to_time(ts).alias("t")).where(
        F.col("k").isNotNull() & F.col("t").isNotNull()
    ).withColumn("b", F.date_format("t", bucket))
    inside = dated.select(
        "k", "t", F.lag("t").over(Window.partitionBy("k", "b").orderBy("t")).alias("prev")
    )
    edges = dated.groupBy("k", "b").agg(F.min("t").alias("t"), F.max("t").alias("last"))
    across = edges.select(
        "k", "t", F.lag("last").over(Window.partitionBy("k").orderBy("b")).alias("prev")
    )
    return inside.unionByName(across).where(F.col("prev").isNotNull()).select(
        F.col("k").alias(key),
        ((F.unix_micros("t") - F.unix_micros("prev")).cast("double") / F.lit(86_400_000_000.0)).alias("gap_days"),
    )


def release_cadence(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Gap statistics: number, mean, median, 90th percentile, short and long gaps."""
    gaps = release_gaps(df, key, ts)
    picks, quantiles = quantile_columns({"p50": 0.5, "p90": 0.9})
    counted = lambda when: F.coalesce(F.sum(F.when(when, F.col("c"))), F.lit(0)).cast("double")
    wide = value_positions(gaps, "gap_days").agg(
        counted(F.lit(True)).alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"),
        counted(F.col("v") < 1).alias("short"), counted(F.col("v") > 180).alias("long"), *picks,
    ).select("n", "mean", "short", "long", *quantiles)
    cells = [
        ("release-to-release gaps", (F.col("n"),)),
        ("mean gap (days)", (F.bround("mean", 1),)),
        ("median gap (days)", (F.bround("p50", 1),)),
        ("p90 gap (days)", (F.bround("p90", 1),)),
        ("gaps under 1 day", (F.col("short"),)),
        ("gaps over 180 days", (F.col("long"),)),
    ]
    return long_form(wide, cells, "statistic", ("value",))


STALENESS_BUCKETS = (
    "single version, never updated again",
    "multiple versions, last publish <= 30 days",
    "multiple versions, 31-90 days",
    "multiple versions, 91-180 days",
    "multiple versions, 181-365 days",
    "multiple versions, > 365 days",
)


def staleness(latest: DataFrame, as_of: str, ts: str = "published_at", count: str = "version_count") -> DataFrame:
    """Servers per staleness bucket relative to a fixed date; all buckets are listed.

    A publish time after `as_of` (negative age) belongs to the first multi-version bucket.
    """
    single = F.coalesce(F.col(count), F.lit(1)) <= 1
    age = (
        F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(to_time(ts))
    ).cast("double") / F.lit(86_400_000_000.0)
    limits = [(None, 30), (30, 90), (90, 180), (180, 365), (365, None)]
    conditions = [single]
    for low, high in limits:
        inside = ~single & age.isNotNull()
        if low is not None:
            inside = inside & (age > low)
        if high is not None:
            inside = inside & (age <= high)
        conditions.append(inside)
    return metric_block(
        latest,
        [(label, F.count_if(c), True) for label, c in zip(STALENESS_BUCKETS, conditions)],
        names=("bucket", "servers", "servers_pct"),
    )


def deprecations(latest: DataFrame) -> DataFrame:
    """Withdrawn latest rows."""
    return latest.where(F.col("is_latest") & (F.col("status") == "deprecated")).select(
        F.col("name").alias("server_name"), F.col("version").alias("last_version"), "published_at",
        "status_changed_at", F.col("version_count").alias("versions_published"),
    )


def churn_concentration(df: DataFrame, group, ks: Sequence[int] = fx.TOP_K) -> DataFrame:
    """Share of rows held by the k largest groups and by the smaller half of the groups.

    Only the number of groups per group size is needed: a table with one row per distinct size, so no
    ranking over all groups takes place.
    """
    sizes = df.groupBy(col(group).alias("g")).agg(F.count(F.lit(1)).alias("size"))
    freq = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("groups"))
    everything = Window.partitionBy()
    above = Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        freq.withColumn("above", F.coalesce(F.sum("groups").over(above), F.lit(0)))
        .withColumn("below", F.coalesce(F.sum("groups").over(below), F.lit(0)))
        .withColumn("all_groups", F.sum("groups").over(everything))
    )
    half = F.greatest(F.lit(1), F.floor(F.col("all_groups") / 2))

    def taken(limit: Column, before: str) -> Column:
        return F.sum(F.col("size") * F.greatest(F.lit(0), F.least(F.col("groups"), limit - F.col(before))))

    wide = placed.agg(
        F.sum(F.col("size") * F.col("groups")).alias("total"),
        F.max(half).alias("half"),
        *[taken(F.lit(k), "above").alias(f"k{k}") for k in ks],
        taken(half, "below").alias("bottom"),
    )
    entries = [(F.lit(str(k)), F.col(f"k{k}")) for k in ks]
    entries.append((F.format_string("bottom 50%% of namespaces (%d)", F.col("half")), F.col("bottom")))
    rows = [
        F.struct(label.alias("top_k_namespaces"), v.cast("bigint").alias("versions"), pct(v, F.col("total")).alias(
            "share_of_versions_pct")) for label, v in entries
    ]
    return wide.where(F.col("total").isNotNull()).select(F.inline(F.array(*rows)))
