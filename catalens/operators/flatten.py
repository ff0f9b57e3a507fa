"""Nested catalogue entries to relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from catalens.functions.text import is_present


def _meta(suffix: str) -> Column:
    """The metadata block whose key ends with `suffix` (the publisher prefix of the key is not fixed)."""
    values = F.map_values(F.map_filter("_meta", lambda k, _: k.endswith(suffix)))
    return F.get(values, 0)


def _flag(c) -> Column:
    return F.coalesce(c, F.lit(False))


def _size(name: str) -> Column:
    return F.coalesce(F.size(F.col(name)), F.lit(0)).cast("bigint")


def _names(values: Column) -> Column:
    """Sorted distinct non-empty strings."""
    return F.array_sort(F.array_distinct(F.filter(values, lambda x: F.coalesce(x, F.lit("")) != "")))


def flatten_entries(df: DataFrame, meta_suffix: str = "/official") -> DataFrame:
    """One row per published version, 22 columns; `registry_types` and `transports` stay arrays."""
    empty = F.array().cast("array<string>")
    packages, remotes = F.col("server.packages"), F.col("server.remotes")
    meta = df.withColumn("_m", _meta(meta_suffix))
    package_transports = F.coalesce(F.transform(packages, lambda p: p["transport"]["type"]), empty)
    remote_types = F.coalesce(F.transform(remotes, lambda r: r["type"]), empty)
    declared = F.transform(packages, lambda p: F.coalesce(F.size(p["environmentVariables"]), F.lit(0)))
    return meta.select(
        *[F.col(f"server.{c}").alias(c) for c in ("name", "title", "description", "version")],
        F.col("server.`$schema`").alias("schema"),
        F.col("server.repository.url").alias("repository_url"),
        F.col("server.repository.source").alias("repository_source"),
        F.col("server.websiteUrl").alias("website_url"),
        F.col("_m.status").alias("status"),
        _flag(F.col("_m.isLatest")).alias("is_latest"),
        F.col("_m.publishedAt").alias("published_at"),
        F.col("_m.updatedAt").alias("updated_at"),
        F.col("_m.statusChangedAt").alias("status_changed_at"),
        _size("server.packages").alias("package_count"),
        _size("server.remotes").alias("remote_count"),
        _names(F.coalesce(F.transform(packages, lambda p: p["registryType"]), empty)).alias("registry_types"),
        _names(F.concat(package_transports, remote_types)).alias("transports"),
        F.coalesce(F.aggregate(declared, F.lit(0), lambda acc, x: acc + x), F.lit(0)).cast("bigint").alias(
            "env_var_count"
        ),
        (_size("server.packages") > 0).alias("has_packages"),
        (_size("server.remotes") > 0).alias("has_remotes"),
        is_present("server.repository.url").alias("has_repository"),
        is_present("server.websiteUrl").alias("has_website"),
    )


def _unfolded(df: DataFrame, array: str, alias: str, meta_suffix: str) -> DataFrame:
    return df.select(
        F.col("server.name").alias("server_name"),
        F.col("server.version").alias("server_version"),
        _meta(meta_suffix).alias("_m"),
        F.explode(array).alias(alias),
    )


def extract_packages(df: DataFrame, meta_suffix: str = "/official") -> DataFrame:
    """One row per (version, package)."""
    return _unfolded(df, "server.packages", "p", meta_suffix).select(
        "server_name", "server_version",
        _flag(F.col("_m.isLatest")).alias("is_latest"),
        F.col("_m.status").alias("status"),
        F.col("_m.publishedAt").alias("published_at"),
        F.col("p.registryType").alias("registry_type"),
        F.col("p.registryBaseUrl").alias("registry_base_url"),
        F.col("p.identifier").alias("identifier"),
        F.col("p.version").alias("package_version"),
        F.col("p.transport.type").alias("transport_type"),
        F.col("p.transport.url").alias("transport_url"),
        F.col("p.runtimeHint").alias("runtime_hint"),
        (_size("p.runtimeArguments") > 0).alias("has_runtime_args"),
        (_size("p.packageArguments") > 0).alias("has_package_args"),
    )


def extract_env_vars(df: DataFrame, meta_suffix: str = "/official") -> DataFrame:
    """One row per declared variable, two nesting levels down."""
    return (
        _unfolded(df, "server.packages", "p", meta_suffix)
        .select("*", F.explode("p.environmentVariables").alias("v"))
        .select(
            "server_name", "server_version",
            _flag(F.col("_m.isLatest")).alias("is_latest"),
            F.col("p.registryType").alias("registry_type"),
            F.col("p.identifier").alias("identifier"),
            F.col("v.name").alias("var_name"),
            F.col("v.description").alias("var_description"),
            _flag(F.col("v.isRequired")).alias("is_required"),
            _flag(F.col("v.isSecret")).alias("is_secret"),
            F.col("v.default").alias("default_value"),
            F.col("v.format").alias("format"),
            F.col("v.choices").alias("choices"),
        )
    )


def extract_remotes(df: DataFrame, meta_suffix: str = "/official") -> DataFrame:
    """One row per declared endpoint."""
    return _unfolded(df, "server.remotes", "r", meta_suffix).select(
        "server_name", "server_version",
        _flag(F.col("_m.isLatest")).alias("is_latest"),
        F.col("r.type").alias("remote_type"),
        F.col("r.url").alias("remote_url"),
    )
