"""Temporal list join: which entries of dated URL lists were in force when a page was fetched (DataFrame functions only).

List entries are dated additions and removals of a rule. Per rule they become validity intervals [valid_from, valid_to).
A capture is looked up under every rule that could cover its URL: the host itself, every parent domain, and every path
prefix below the host; the as-of join picks of each rule the interval that holds at the fetch date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalens.llm.common import stored

#: Hosts that are addresses, not names.
ADDRESS = r"^([0-9]+([.][0-9]+){3}|\[.*)$"


def host_of(url: Column) -> Column:
    """Lower-case host without credentials, port and closing dot; null if the URL has no authority."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^:/?#]*)", 1)
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(F.length(host) > 0, host)


def path_of(url: Column) -> Column:
    """Path without query and fragment; at least a slash."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def rule_keys(url: Column) -> Column:
    """All rules that could cover the URL: d:domain for the host and its parents, p:host/path/ by depth; whole lengths.

    An address (four numbers, or in brackets) has no parents and is looked up whole.
    """
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    parents = F.when(host.rlike(ADDRESS), F.lit(1)).otherwise(F.size(labels))
    domains = F.transform(F.sequence(F.lit(1), parents), lambda i: F.concat(
        F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    prefixes = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(
        F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"))))
    empty = F.array().cast("array<string>")
    return F.when(host.isNull(), empty).otherwise(F.concat(domains, F.coalesce(prefixes, empty)))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """list_name, rule, valid_from, valid_to (null: still in force) from dated entries list_name, rule, action, listed_on.

    action is add or remove. Of entries of one rule and day a removal wins. An addition of a rule in force and a removal
    of one that is not change nothing. Entries without list, rule, action or date are void. Grouping by day first bounds
    the window of a rule by the days of the calendar, however often the rule is listed.
    """
    known = entries.filter(F.col("action").isin("add", "remove")).dropna(subset=["list_name", "rule", "listed_on"])
    days = known.groupBy("list_name", "rule", F.col("listed_on").cast("date").alias("day")).agg(
        F.min((F.col("action") == "add").cast("int")).alias("on"))
    rule = Window.partitionBy("list_name", "rule").orderBy("day")
    changes = (days.withColumn("was", F.coalesce(F.lag("on").over(rule), F.lit(0))).filter("on <> was"))
    return (changes.withColumn("valid_to", F.lead("day").over(rule)).filter("on = 1")
            .select("list_name", "rule", F.col("day").alias("valid_from"), "valid_to"))


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Every capture (page_id, url, fetched_on) with the list entries in force at its date.

    Returns page_id, url, fetched_on, host, captures (rows that repeat page_id, url and date), n_active (entries in
    force), lists (their names, sorted, comma between), rule (the longest rule in force, of equals the last by code point),
    valid_from and valid_to of that rule's interval, blocked. URLs without a host and captures without a date match
    nothing. The intervals of a rule are few (days of the calendar times lists) and join as one row per rule, so that
    a host with a third of all captures is never sorted against its entries; only captures with a listed rule are grouped.
    """
    ids = ["page_id", "url", "fetched_on"]
    captured = captures.groupBy(*ids).agg(F.count("*").alias("captures"))
    by_rule = validity_intervals(entries).groupBy("rule").agg(
        F.array_sort(F.collect_list(F.struct("valid_from", "valid_to", "list_name"))).alias("intervals"))
    keyed = captured.select(*ids, F.explode(rule_keys(F.col("url"))).alias("rule"))
    day = F.col("fetched_on").cast("date")
    holds = F.filter("intervals", lambda x: (x["valid_from"] <= day) & (x["valid_to"].isNull() | (day < x["valid_to"])))
    found = (keyed.join(stored(by_rule, "url-rules"), "rule").withColumn("active", holds).filter(F.size("active") > 0))
    longest = found.groupBy(*ids).agg(
        F.sum(F.size("active")).alias("n_active"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.col("active.list_name"))))), ",").alias("lists"),
        F.max_by(F.struct("rule", F.col("active")[0].alias("first")), F.struct(F.length("rule"), F.col("rule"))).alias("top"))
    longest = longest.withColumnsRenamed({c: f"_{c}" for c in ids})
    same = F.col("page_id").eqNullSafe(F.col("_page_id")) & F.col("url").eqNullSafe(F.col("_url"))
    joined = captured.join(longest, same & F.col("fetched_on").eqNullSafe(F.col("_fetched_on")), "left")
    return joined.select(
        *ids, host_of(F.col("url")).alias("host"), "captures",
        F.coalesce(F.col("n_active"), F.lit(0)).cast("long").alias("n_active"), F.coalesce("lists", F.lit("")).alias("lists"),
        F.col("top.rule").alias("rule"), F.col("top.first.valid_from").alias("valid_from"),
        F.col("top.first.valid_to").alias("valid_to"), F.col("top").isNotNull().alias("blocked"))
