"""Projections of landed API payloads (JSON text) to flat facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from catalens import schemas
from catalens.functions.text import is_present


def _map_size(c) -> Column:
    return F.coalesce(F.size(c), F.lit(0)).cast("bigint")


def _error(j: str) -> Column:
    return F.col(f"{j}.__http_error__")


def _unless_error(j: str, **facts: Column) -> list[Column]:
    """Facts are null for a payload that is only an error marker."""
    ok = _error(j).isNull()
    return [F.when(ok, value).alias(name) for name, value in facts.items()]


def project_npm(payloads: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """npm metadata to 13 facts, or an error marker. Parsed once with a declared schema; the polymorphic
    fields (maintainers, repository) are read as text and looked at by their first character."""
    j = payloads.select(*keep, F.from_json(payload, schemas.NPM).alias("j"))
    j = j.withColumn("latest", F.col("j.dist-tags.latest")).withColumn(
        "v", F.try_element_at("j.versions", F.coalesce(F.col("latest"), F.lit("")))
    )
    people = F.col("j.maintainers")
    people_count = (
        F.when(people.startswith("["), F.size(F.from_json(people, "array<string>")))
        .when(people.startswith("{") & (people != "{}"), 1)
        .otherwise(0)
    )
    repo = F.col("v.repository")
    has_repo = F.when(repo.startswith("{"), is_present(F.get_json_object(repo, "$.url"))).otherwise(is_present(repo))
    deprecated = F.col("v.deprecated")
    facts = dict(
        npm_name=F.col("j.name"),
        npm_latest_version=F.col("latest"),
        npm_created=F.try_element_at("j.time", F.lit("created")),
        npm_modified=F.try_element_at("j.time", F.lit("modified")),
        npm_version_count=_map_size("j.versions"),
        npm_license=F.coalesce(F.nullif("v.license", F.lit("")), F.col("j.license")),
        npm_deprecated=is_present(deprecated) & (deprecated != "false"),
        npm_maintainer_count=people_count.cast("bigint"),
        npm_has_repository=has_repo,
        npm_dependencies=_map_size("v.dependencies"),
        npm_dev_dependencies=_map_size("v.devDependencies"),
        npm_scripts=F.coalesce(F.array_join(F.array_sort(F.map_keys("v.scripts")), "|"), F.lit("")),
        npm_tarball=F.col("v.dist.tarball"),
    )
    return j.select(*keep, *_unless_error("j", **facts), _error("j").cast("bigint").alias("error"))


def project_downloads(payloads: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """Download count, null for an error marker."""
    j = payloads.select(*keep, F.from_json(payload, "downloads string, __http_error__ int").alias("j"))
    return j.select(*keep, *_unless_error("j", npm_monthly_downloads=F.col("j.downloads").try_cast("bigint")))


def project_pypi(payloads: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """PyPI metadata to 10 facts; yanked when any file of any release is."""
    j = payloads.select(*keep, F.from_json(payload, schemas.PYPI).alias("j"))
    files = F.flatten(F.filter(F.map_values("j.releases"), lambda x: x.isNotNull()))
    facts = dict(
        **{f"pypi_{n}": F.col(f"j.info.{f}") for n, f in (
            ("name", "name"), ("latest_version", "version"), ("summary", "summary"), ("license", "license"),
            ("requires_python", "requires_python"))},
        pypi_release_count=_map_size("j.releases"),
        pypi_author=F.col("j.info.author"),
        pypi_project_urls=F.coalesce(F.array_join(F.array_sort(F.map_keys("j.info.project_urls")), "|"), F.lit("")),
        pypi_requires_dist=_map_size("j.info.requires_dist"),
        pypi_yanked=F.coalesce(F.exists(files, lambda f: F.coalesce(f["yanked"], F.lit(False))), F.lit(False)),
    )
    return j.select(*keep, *_unless_error("j", **facts), _error("j").cast("bigint").alias("error"))


def project_repo(payloads: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """Repository object to 20 columns."""
    j = payloads.select(*keep, F.from_json(payload, schemas.REPO).alias("j"))
    plain = {
        "full_name": "full_name", "owner": "owner.login", "name": "name", "url": "html_url",
        "description": "description", "stars": "stargazers_count", "forks": "forks_count",
        "watchers": "subscribers_count", "open_issues": "open_issues_count", "language": "language",
        "license": "license.spdx_id", "created_at": "created_at", "pushed_at": "pushed_at",
        "updated_at": "updated_at", "size_kb": "size", "default_branch": "default_branch",
    }
    flags = {"is_fork": "fork", "archived": "archived", "has_issues": "has_issues"}
    topics = F.coalesce(F.array_join("j.topics", "|"), F.lit(""))
    return j.where(_error("j").isNull()).select(
        *keep,
        *[F.col(f"j.{f}").alias(f"repo_{n}") for n, f in plain.items()],
        topics.alias("repo_topics"),
        *[F.coalesce(F.col(f"j.{f}"), F.lit(False)).alias(f"repo_{n}") for n, f in flags.items()],
    )


def project_releases(payloads: DataFrame, repo: str, payload: str = "payload") -> DataFrame:
    """Release list to one row per release; an error marker yields none."""
    rel = payloads.where(F.ltrim(payload).startswith("[")).select(
        F.col(repo).alias("repo_full_name"), F.explode(F.from_json(payload, schemas.RELEASES)).alias("r")
    )
    return rel.select(
        "repo_full_name",
        F.col("r.tag_name").alias("release_tag"),
        F.col("r.name").alias("release_name"),
        F.col("r.published_at").alias("release_published_at"),
        F.coalesce("r.prerelease", F.lit(False)).alias("release_prerelease"),
        F.coalesce("r.draft", F.lit(False)).alias("release_draft"),
        _map_size("r.assets").alias("release_assets"),
    )


def pick_sdist(payloads: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """First source distribution of a release, else its first file."""
    j = payloads.select(*keep, F.from_json(payload, schemas.PYPI).alias("j"))
    sdist = F.get(F.filter("j.urls", lambda f: f["packagetype"] == "sdist"), 0)
    chosen = F.when(_error("j").isNull(), F.coalesce(sdist, F.get("j.urls", 0)))
    return j.select(*keep, chosen["packagetype"].alias("packagetype"), chosen["url"].alias("url"))
