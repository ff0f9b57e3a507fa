"""Reports on extracted definitions, packages and repositories, and comparisons of two signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from catalens import fixed_values as fx
from catalens.functions.numeric import col, pct
from catalens.functions.text import identifier_flags, text_or_empty, to_time, word_count
from catalens.operators.keys import _first_per
from catalens.operators.metric import exact_quantiles, keyed_counts, long_form, metric_block
from catalens.operators.statistics import spearman


def tool_interface_profile(
    tools: DataFrame, name: str = "tool_name", description: str = "tool_description", schema: str = "has_schema",
    server: str = "server_name",
) -> DataFrame:
    """Ten metrics over extracted definitions; counts of items and servers carry no share."""
    style = identifier_flags(name)
    flags = {
        "described": text_or_empty(description) != "",
        "short": word_count(description) < 5,
        "when": F.lower(text_or_empty(description)).rlike(fx.WHEN_TO_USE),
        "schema": F.coalesce(F.col(schema), F.lit(False)),
        "snake": style["underscore"], "camel": style["camel"], "kebab": style["dash"],
    }
    per_server = keyed_counts(tools, server, flags)
    wide = per_server.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).cast("double").alias(n) for n in ("rows", *flags)],
        F.count(server).cast("double").alias("servers"),
    )
    nothing = F.lit(None).cast("double")
    mean = F.bround(F.col("rows") / F.greatest(F.lit(1.0), F.col("servers")), 1)
    cells = [
        ("extracted tool definitions", (F.col("rows"), nothing)),
        ("servers represented", (F.col("servers"), nothing)),
        ("tools per server (mean)", (mean, nothing)),
    ] + [
        (label, (F.col(c), pct(c, "rows")))
        for label, c in (
            ("tools with a description", "described"),
            ("descriptions under 5 words", "short"),
            ("descriptions that state when to use the tool", "when"),
            ("tools declaring an input schema", "schema"),
            ("snake_case names", "snake"),
            ("camelCase names", "camel"),
            ("kebab-case names", "kebab"),
        )
    ]
    return long_form(wide, cells, "metric", ("value", "share_pct"))


def tools_per_server(
    tools: DataFrame, description: str = "tool_description", schema: str = "has_schema", server: str = "server_name"
) -> DataFrame:
    return (
        tools.where(F.col(server).isNotNull()).groupBy(server)
        .agg(
            F.count(F.lit(1)).alias("tools"),
            F.count_if(text_or_empty(description) != "").alias("with_description"),
            F.count_if(F.coalesce(F.col(schema), F.lit(False))).alias("with_schema"),
            F.bround(F.avg(word_count(description)), 1).alias("mean_desc_words"),
        )
    )


def tool_outcome(
    records: DataFrame, description: str = "tool_description", schema: str = "has_schema",
    language: str = "language", server: str = "server_name",
) -> DataFrame:
    """Per server: items, described items, items with a schema, sorted set of languages."""
    return records.groupBy(server).agg(
        F.count(F.lit(1)).alias("tools"),
        F.count_if(text_or_empty(description) != "").alias("with_description"),
        F.count_if(F.coalesce(F.col(schema), F.lit(False))).alias("with_schema"),
        F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(language), F.lit("")))), "|").alias("languages"),
    )


def extraction_coverage(cov: DataFrame, status: str = "status", found: str = "tools_found", ok: str = "ok"):
    """Funnel: attempted, parsed, yielding at least one item."""
    parsed = F.coalesce(F.col(status) == ok, F.lit(False))
    return metric_block(
        cov,
        [
            ("packages attempted", F.count(F.lit(1)), True),
            ("packages parsed successfully", F.count_if(parsed), True),
            ("packages yielding >= 1 tool", F.count_if(parsed & (F.coalesce(F.col(found), F.lit(0)) > 0)), True),
        ],
        names=("metric", "value", "share_of_attempted_pct"),
    )


def _medians(df: DataFrame, values: dict[str, Column]) -> Column:
    """Scalar subquery with the exact medians of several columns as one struct."""
    unfolded = df.select(
        F.inline(F.array(*[
            F.struct(F.lit(n).alias("q"), c.cast("double").alias("x")) for n, c in values.items()
        ]))
    )
    medians = exact_quantiles(unfolded, "x", {"p50": 0.5}, by=["q"])
    return medians.agg(
        F.struct(*[F.max(F.when(F.col("q") == n, F.col("p50"))).alias(n) for n in values])
    ).scalar()


def package_profile(enriched: DataFrame) -> DataFrame:
    """Licence, maintenance and adoption facts of enriched packages."""
    npm, pypi = F.col("registry_type") == "npm", F.col("registry_type") == "pypi"
    downloads, people = F.col("npm_monthly_downloads"), F.col("npm_maintainer_count")
    zero = F.lit(0)
    medians = _medians(
        enriched.where(npm), {"versions": F.col("npm_version_count"), "downloads": F.col("npm_monthly_downloads")}
    )
    counted = enriched.agg(
        F.count(F.lit(1)).cast("double").alias("rows"),
        *[F.count_if(c).cast("double").alias(n) for n, c in {
            "npm": npm, "pypi": pypi,
            "npm_licence": npm & F.col("npm_license").isNotNull(),
            "npm_deprecated": npm & F.coalesce(F.col("npm_deprecated"), F.lit(False)),
            "npm_single": npm & F.coalesce(people == 1, F.lit(False)),
            "npm_nobody": npm & (F.coalesce(people, zero) == 0),
            "npm_unused": npm & (F.coalesce(downloads, zero) == 0),
            "pypi_licence": pypi & F.col("pypi_license").isNotNull(),
            "pypi_yanked": pypi & F.coalesce(F.col("pypi_yanked"), F.lit(False)),
        }.items()],
    ).select("*", medians.alias("med"))
    rows = [
        ("packages enriched", F.col("rows")), ("npm packages", F.col("npm")), ("PyPI packages", F.col("pypi")),
        ("npm: with a licence declared", F.col("npm_licence")), ("npm: deprecated", F.col("npm_deprecated")),
        ("npm: single maintainer", F.col("npm_single")), ("npm: no maintainer recorded", F.col("npm_nobody")),
        ("npm: median versions published", F.coalesce("med.versions", F.lit(0.0))),
        ("npm: median monthly downloads", F.coalesce("med.downloads", F.lit(0.0))),
        ("npm: zero downloads in last month", F.col("npm_unused")),
        ("PyPI: with a licence declared", F.col("pypi_licence")), ("PyPI: yanked releases", F.col("pypi_yanked")),
    ]
    # Medians are not parts of a whole: their share stays empty.
    cells = [
        (label, (v, F.lit(None).cast("double") if "median" in label else pct(v, "rows"))) for label, v in rows
    ]
    return long_form(counted, cells, "metric", ("value", "share_pct"))


def licence_distribution(df: DataFrame, registry: str, licence: str, n: int = 20, per_registry: bool = True):
    """Most common licences, ranked inside each registry (or over all of them)."""
    counts = df.where(F.col(licence).isNotNull()).groupBy(
        F.col(registry).alias("registry"), F.col(licence).alias("licence")
    ).agg(F.count(F.lit(1)).alias("count"))
    order = [F.desc("count"), F.col("licence").asc()]
    if per_registry:
        return _first_per(counts, ["registry"], order, n).drop("_rank")
    return counts.orderBy(*order, "registry").limit(n)


def repository_profile(repos: DataFrame, as_of: str, status: str | None = "status") -> DataFrame:
    """Repository health relative to a fixed date."""
    if status:
        repos = repos.where(F.col(status) == "ok")
    moment = F.unix_micros(F.lit(as_of).cast("timestamp"))
    day = F.lit(86_400_000_000.0)
    age = (moment - F.unix_micros(to_time("repo_created_at"))).cast("double") / day
    idle = (moment - F.unix_micros(to_time("repo_pushed_at"))).cast("double") / day
    stars = F.coalesce(F.col("repo_stars"), F.lit(0))
    licence = F.coalesce(F.col("repo_license"), F.lit(fx.NO_LICENCE[0]))
    medians = _medians(repos, {"stars": F.col("repo_stars"), "age": age})
    counted = repos.agg(
        F.count(F.lit(1)).cast("double").alias("rows"),
        *[F.count_if(c).cast("double").alias(n) for n, c in {
            "unlicensed": licence.isin(*fx.NO_LICENCE),
            "archived": F.coalesce(F.col("repo_archived"), F.lit(False)),
            "forks": F.coalesce(F.col("repo_is_fork"), F.lit(False)),
            "unstarred": stars == 0, "popular": stars >= 100, "idle": idle > 180,
        }.items()],
    ).select("*", medians.alias("med"))
    rows = [
        ("repositories resolved", F.col("rows"), True), ("no licence declared", F.col("unlicensed"), True),
        ("archived", F.col("archived"), True), ("forks", F.col("forks"), True),
        ("with no stars", F.col("unstarred"), True), ("with >= 100 stars", F.col("popular"), True),
        ("no push in 180 days", F.col("idle"), True),
        ("median stars", F.coalesce("med.stars", F.lit(0.0)), False),
        ("median age (days)", F.bround(F.coalesce("med.age", F.lit(0.0)), 0), False),
    ]
    cells = [(label, (v, pct(v, "rows") if share else F.lit(None).cast("double"))) for label, v, share in rows]
    return long_form(counted, cells, "metric", ("value", "share_pct"))


def by_language(repos: DataFrame, language: str, stars: str, n: int = 15) -> DataFrame:
    """Repositories per language with the median of their stars, most common first."""
    named = repos.where(F.col(language).isNotNull())
    top = named.groupBy(language).agg(F.count(F.lit(1)).alias("repos")).orderBy(F.desc("repos"), language).limit(n)
    medians = exact_quantiles(named, stars, {"median_stars": 0.5}, by=[language])
    return top.join(medians, language, "left")


def signal_comparison(df: DataFrame, a: str, b: str, labels: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Two counts per item compared: medians, means, order relations and rank correlation."""
    la, lb = labels
    medians = _medians(df, {"a": col(a), "b": col(b)})
    wide = df.agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.count_if(col(a) > 0).cast("double").alias("with_a"),
        F.count_if(col(b) == 0).cast("double").alias("zero_b"),
        F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"),
        F.count_if(col(b) > col(a)).cast("double").alias("b_more"),
        F.count_if(col(a) == col(b)).cast("double").alias("equal"),
        F.count_if(col(a) > col(b)).cast("double").alias("a_more"),
    ).select("*", medians.alias("med"), spearman(df, a, b).scalar().alias("rho"))
    rows = [
        ("items compared", F.col("n")),
        (f"... with at least one {la}", F.col("with_a")),
        (f"... with zero {lb}", F.col("zero_b")),
        (f"share with zero {lb} (%)", pct("zero_b", "n")),
        (f"median {la}", F.col("med.a")), (f"median {lb}", F.col("med.b")),
        (f"mean {la}", F.bround("mean_a", 2)), (f"mean {lb}", F.bround("mean_b", 2)),
        (f"items where {lb} > {la}", F.col("b_more")), ("items where the counts are equal", F.col("equal")),
        (f"items where {la} > {lb}", F.col("a_more")),
        ("Spearman correlation between the counts", F.bround("rho", 3)),
    ]
    return long_form(wide, [(label, (v.cast("double"),)) for label, v in rows], "metric", ("value",))


def agreement_bands(df: DataFrame, a: str, b: str, labels: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Order relations of two counts; the last band overlaps the first by design."""
    la, lb = labels
    floor = F.when(col(a) == 0, 1).otherwise(col(a))
    return metric_block(
        df,
        [
            (f"{lb} exceed {la}", F.count_if(col(b) > col(a)), True),
            ("counts agree exactly", F.count_if(col(a) == col(b)), True),
            (f"{la} exceed {lb}", F.count_if(col(a) > col(b)), True),
            (f"{la} understate by 2x or more", F.count_if(col(b) >= 2 * floor), True),
        ],
        names=("pattern", "servers", "share_pct"),
    )


def extraction_quality(agreement: DataFrame) -> DataFrame:
    """Recall of the first extractor against the second and its candidate false-positive rate."""
    seen = F.col("comparable")

    def total(c: str) -> Column:
        return F.coalesce(F.sum(F.when(seen, F.col(c))), F.lit(0)).cast("double")

    wide = agreement.agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.count_if(seen).cast("double").alias("comparable"),
        total("items_a").alias("a"), total("items_b").alias("b"),
        total("only_a").alias("only_a"), total("only_b").alias("only_b"),
    ).withColumn("shared", F.col("b") - F.col("only_b"))
    one = F.lit(1.0)
    rows = [
        ("validation sample size", F.col("n")),
        ("packages comparable", F.col("comparable")),
        ("items found by the first extractor", F.col("a")),
        ("items found by the second extractor", F.col("b")),
        ("items agreed by both", F.col("shared")),
        ("first only (candidate false positives)", F.col("only_a")),
        ("second only (extractor misses)", F.col("only_b")),
        ("estimated recall on comparable packages (%)", pct("shared", F.greatest(one, F.col("b")))),
        ("candidate false positive rate (%)", pct("only_a", F.greatest(one, F.col("a")))),
    ]
    return long_form(wide, [(label, (v,)) for label, v in rows], "metric", ("value",))
