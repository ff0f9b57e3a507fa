"""Text, name, URL and time expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from catalens import fixed_values as fx
from catalens.functions.numeric import col


def text_or_empty(c) -> Column:
    return F.coalesce(col(c), F.lit(""))


def is_present(c) -> Column:
    """Neither null nor the empty string."""
    return text_or_empty(c) != ""


def word_count(c) -> Column:
    """Number of whitespace-separated words; null text has none."""
    return F.regexp_count(text_or_empty(c), F.lit(r"(?U)\S+"))


def squeeze(c) -> Column:
    """Collapse whitespace runs to single blanks and trim."""
    return F.trim(F.regexp_replace(text_or_empty(c), r"(?U)\s+", " "))


def clean_description(c, cap: int | None = None) -> Column:
    """Resolve string escapes and squeeze whitespace; a caller may keep at most `cap` characters."""
    out = text_or_empty(c)
    for escaped, plain in (
        ("\\n", " "), ("\\t", " "), ("\\r", " "), ('\\"', '"'), ("\\'", "'"), ("\\\\", "\\"),
    ):
        out = F.replace(out, F.lit(escaped), F.lit(plain))
    return squeeze(out) if cap is None else F.left(squeeze(out), F.lit(cap))


def to_time(c) -> Column:
    """Timestamp of ISO text (or of a timestamp column); unreadable text gives null."""
    return col(c).try_cast("timestamp")


def month_of(c) -> Column:
    return F.date_format(to_time(c), "yyyy-MM")


def days_between(later, earlier) -> Column:
    return (F.unix_micros(col(later).cast("timestamp")) - F.unix_micros(col(earlier).cast("timestamp"))).cast(
        "double"
    ) / F.lit(86_400_000_000.0)


def namespace(c) -> Column:
    return F.substring_index(text_or_empty(c), "/", 1)


def local_part(c) -> Column:
    return F.substring_index(text_or_empty(c), "/", -1)


def name_parts(c) -> Column:
    return F.struct(namespace(c).alias("namespace"), local_part(c).alias("local_part"))


def name_flags(c) -> Column:
    """Naming-convention predicates of a published name."""
    name = text_or_empty(c)
    slash = F.contains(name, F.lit("/"))
    local = local_part(c)
    return F.struct(
        slash.alias("has_namespace"),
        (slash & ~F.contains(namespace(c), F.lit("."))).alias("namespace_without_dot"),
        local.rlike("[A-Z]").alias("local_upper"),
        F.contains(local, F.lit(" ")).alias("local_space"),
        F.contains(local, F.lit("_")).alias("local_underscore"),
    )


def identifier_flags(c) -> Column:
    """Spelling-style predicates of an identifier."""
    name = text_or_empty(c)
    return F.struct(
        F.contains(name, F.lit("_")).alias("underscore"),
        name.rlike("[a-z][A-Z]").alias("camel"),
        F.contains(name, F.lit("-")).alias("dash"),
        name.rlike(r"^[a-z]+[_\-][a-z]").alias("verb_noun"),
    )


def url_scheme(c) -> Column:
    return F.nullif(F.regexp_extract(text_or_empty(c), r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1), F.lit(""))


def url_host(c, strict_compat: bool = False) -> Column:
    """Host of a URL. `strict_compat` keeps a query string that follows the host without a slash."""
    pattern = r"://([^/:]+)" if strict_compat else r"://([^/:?#]+)"
    return F.nullif(F.regexp_extract(text_or_empty(c), pattern, 1), F.lit(""))


def url_flags(c, strict_compat: bool = False) -> Column:
    host = text_or_empty(url_host(c, strict_compat))
    return F.struct(
        (F.lower(text_or_empty(url_scheme(c))) == "http").alias("plaintext"),
        host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$").alias("bare_ip"),
        host.isin(*fx.LOCAL_HOSTS).alias("localhost"),
    )


def parse_repo_url(c) -> Column:
    """Struct of owner and repo of a repository URL; both null when it is not one."""
    url = F.trim(text_or_empty(c))
    hit = url.rlike(fx.REPOSITORY_PATTERN)
    repo = F.regexp_replace(F.regexp_extract(url, fx.REPOSITORY_PATTERN, 2), r"\.git$", "")
    return F.struct(
        F.when(hit, F.regexp_extract(url, fx.REPOSITORY_PATTERN, 1)).alias("owner"),
        F.when(hit, F.nullif(repo, F.lit(""))).alias("repo"),
    )


def repo_key(c) -> Column:
    parsed = parse_repo_url(c)
    return F.concat(parsed["owner"], F.lit("/"), parsed["repo"])


def list_items(c, sep: str = r"\|") -> Column:
    """Items of a separated cell, blanks left out."""
    return F.filter(F.split(text_or_empty(c), sep), lambda x: F.trim(x) != "")


def list_count(c, sep: str = r"\|") -> Column:
    return F.size(list_items(c, sep))


def any_of(c, words) -> Column:
    """True when the lower-cased text holds any of the words as a substring.

    One compact expression on purpose: a chain of `contains` would make the generated method too long for the
    JVM to compile.
    """
    # A word that contains another one of the list adds nothing.
    needed = [w for w in words if not any(v != w and v in w for v in words)]
    return F.lower(text_or_empty(c)).rlike("|".join(needed))
