"""Definitions extracted from source text.

A file is one row, so scanning needs no shuffle at all: one pass over the text finds the hits of every idiom with their arguments
or bodies (see `functions.scanner`), and what a hit says is read from these by column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from catalens import fixed_values as fx
from catalens.functions import scanner
from catalens.functions.numeric import col
from catalens.functions.text import clean_description, squeeze, text_or_empty
from catalens.operators.keys import _first_per, dedupe_richest, richness
from catalens.session import materialise

FLAGS = "(?sU)"  # a dot spans lines; letters, digits and blanks are Unicode classes


def _group(c, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null when there is none or it is empty."""
    return F.nullif(F.regexp_extract(col(c), FLAGS + pattern, group), F.lit(""))


def language_of(path, registry_type=None) -> Column:
    """Language from the file extension, else from the package registry."""
    ext = F.lower(F.regexp_extract(F.substring_index(col(path), "/", -1), r".(\.[^.]*)$", 1))
    out = None
    for e, language in fx.LANGUAGE_OF_EXTENSION.items():
        out = F.when(ext == e, language) if out is None else out.when(ext == e, language)
    if registry_type is not None:
        kind = col(registry_type)
        out = out.when(kind == "pypi", "python").when(kind == "npm", "javascript")
    return out


def select_source_files(
    files: DataFrame, package: str = "package_key", path: str = "path", size: str = "bytes",
    registry_type: str | None = "registry_type", max_bytes: int | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """Files worth scanning: a known language, outside vendored and test trees, not minified.

    All such files are kept, whatever their number and size; a caller may set a largest size in bytes and a number
    of files per package, which takes the first in path order."""
    dirs = F.split(F.regexp_replace(F.col(path), "/?[^/]*$", ""), "/")
    kept = files.withColumn("language", language_of(path, registry_type)).where(
        F.col("language").isNotNull()
        & ~F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in fx.SKIPPED_DIRS]))
        & ~F.col(path).rlike("(" + "|".join(s.replace(".", r"\.") for s in fx.SKIPPED_SUFFIXES) + ")$")
    )
    if max_bytes is not None:
        kept = kept.where(F.col(size) <= max_bytes)
    if max_files is None:
        return kept
    # Only packages with more files than allowed need a cut, found from names alone: the text column is not read for it.
    cuts = materialise(
        _first_per(kept.select(package, path), [package], [F.col(path).asc()], max_files)
        .where(F.col("_rank") == max_files).select(package, F.col(path).alias("_last")), "cuts"
    )
    return kept.join(cuts, package, "left").where(
        F.col("_last").isNull() | (F.col(path) <= F.col("_last"))
    ).drop("_last")


JS, PYTHON = ("typescript", "javascript"), ("python",)
PATTERN_ORDER = ("ts_server_tool", "ts_server_tool_object", "ts_tool_literal", "py_decorator", "py_tool_ctor")


def _read_hits(found: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Name, description and schema flag of every hit; each idiom's reading runs on its own hits only.

    What follows the next function of a decorator is staged as a column of its own, since several readings use it.
    """
    kind, body, after = F.col("extraction_pattern"), F.col("body"), F.col("after")
    with_body, literal, decorator, ctor = (kind == p for p in PATTERN_ORDER[1:])
    given = F.nullif(F.trim("name"), F.lit(""))
    staged = found.select(
        "*", F.when(decorator, F.regexp_extract(after, FLAGS + fx.PY_NEXT_DEF + "(.*)", 2)).alias("_after_def"),
        F.when(decorator, F.coalesce(_group(body, fx.PY_NAME_ARGUMENT), _group(after, fx.PY_NEXT_DEF)))
        .when(ctor, _group(body, fx.PY_NAME_ARGUMENT)).otherwise(given).alias("tool_name"),
    )
    private = decorator & F.col("tool_name").startswith("_")
    described = staged.where((text_or_empty("tool_name") != "") & ~private).select(
        "*",
        F.when(literal, F.nullif(squeeze("description"), F.lit("")))
        .when(decorator | ctor, _group(body, fx.PY_DESCRIPTION_ARGUMENT))
        .otherwise(F.nullif("description", F.lit(""))).alias("_own"),
        F.when(with_body | literal, _group(body, fx.JS_DESCRIPTION))
        .when(decorator, squeeze(F.regexp_extract("_after_def", FLAGS + fx.PY_DOCSTRING, 2))).alias("_inner"),
        F.when(with_body, body.rlike(fx.JS_SCHEMA))
        .when(literal, F.when(body != "", body).otherwise(after).rlike(fx.JS_SCHEMA))
        .when(ctor, body.rlike(fx.PY_SCHEMA_ARGUMENT)).otherwise(False).alias("has_schema"),
    )
    description = F.when(ctor, text_or_empty("_own")).otherwise(
        clean_description(F.coalesce("_own", "_inner"))
    )
    return described.select(
        *keep, "tool_name", description.alias("tool_description"), "has_schema", "extraction_pattern", "position"
    )


def scan_files(
    files: DataFrame, keep: Sequence[str], patterns: Sequence[str] = PATTERN_ORDER, text: str = "text",
    language: str = "language",
) -> DataFrame:
    """All idioms over all files in one pass over the text, before deduplication. A file is only searched for
    the idioms of its own language; decorated private functions are left out. Arguments and bodies end at their own
    closing bracket, whatever their length; an argument list that is never closed is no hit. A null or empty text has none."""
    wanted = files.where(F.col(language).isin(*{k for p in patterns for k in (PYTHON if p.startswith("py_") else JS)}))
    hits = scanner.registrations(F.col(text), F.col(language), patterns)
    return _read_hits(wanted.select(*keep, F.explode(hits).alias("h")).select(*keep, "h.*"), keep)


def extract_calls_js(files: DataFrame, keep: Sequence[str], **columns: str) -> DataFrame:
    """JavaScript and TypeScript registrations: call with a description, call with an object body, object literal."""
    return scan_files(files, keep, PATTERN_ORDER[:3], **columns)


def extract_decorators(files: DataFrame, keep: Sequence[str], **columns: str) -> DataFrame:
    """Python decorators: name argument or the next function, description argument or its docstring."""
    return scan_files(files, keep, PATTERN_ORDER[3:4], **columns)


def extract_ctors(files: DataFrame, keep: Sequence[str], **columns: str) -> DataFrame:
    """Python constructor calls with a name argument."""
    return scan_files(files, keep, PATTERN_ORDER[4:], **columns)


def extract_tools(
    files: DataFrame, package: str = "package_key", server: str = "server_name", path: str = "path"
) -> DataFrame:
    """The whole extraction: every idiom, tagged with its origin, richest definition per package and name."""
    found = scan_files(files, [package, server, "language", path])
    rank = F.array_position(F.array(*[F.lit(p) for p in PATTERN_ORDER]), F.col("extraction_pattern"))
    return dedupe_richest(
        found.withColumn("_pattern", rank), [package, server, "tool_name"], richness("tool_description", "has_schema"),
        [path, "_pattern", "position"],
    ).drop("_pattern")


def scan_coverage(files: DataFrame, tools: DataFrame, package: str = "package_key") -> DataFrame:
    """Files scanned and definitions kept per package."""
    scanned = files.groupBy(package).agg(F.count(F.lit(1)).alias("files_scanned"))
    found = tools.groupBy(package).agg(F.count(F.lit(1)).alias("tools_found"))
    return scanned.join(found, package, "left").withColumn(
        "tools_found", F.coalesce("tools_found", F.lit(0)).cast("bigint")
    )


def extract_strict(files: DataFrame, keep: Sequence[str], text: str = "text", language: str = "language") -> DataFrame:
    """Independent second opinion for Python: decorators above a function, whose arguments may span lines, and constructor
    calls, both outside strings and comments, with the name given on the call's own level. A name is private only if the
    function is private too."""
    hits = scanner.strict_registrations(F.col(text), F.col(language))
    found = files.where(F.col(language) == "python").select(*keep, F.explode(hits).alias("h"))
    return found.select(*keep, "h.extraction_pattern", "h.position", F.col("h.name").alias("tool_name"))


def snippets(
    files: DataFrame, terms: DataFrame, package: str = "package_key", path: str = "path", text: str = "text",
    before: int = 1, after: int = 3, n: int = 6, width: int = 300,
) -> DataFrame:
    """First n source excerpts per package around lines that mention one of the package's terms.

    `terms` has one array column `terms` per package. Hits are found first, as (file, line), and only the first n of a file
    and of a package go on; then the text of the files that won is read once more. Terms and winners are stored, so both
    joins send the small side while it is small, and no text is shuffled then. A file is one (package, path).
    """
    terms = materialise(terms.select(package, "terms"), "terms")
    lines = files.join(terms, package).withColumn("lines", F.split(text, "\n"))
    hit = F.filter(
        F.sequence(F.lit(0), F.size("lines") - 1),
        lambda i: F.exists("terms", lambda t: (t != "") & F.contains(F.get("lines", i), t)),
    )
    found = lines.select(package, path, F.explode(F.slice(hit, 1, n)).alias("i"))
    first = _first_per(found, [package], [F.col(path).asc(), F.col("i").asc()], n).withColumnRenamed("_rank", "rank")
    won = materialise(first.groupBy(package, path).agg(F.collect_list(F.struct("i", "rank")).alias("won")), "won")
    start = F.greatest(F.lit(0), F.col("i") - before)
    texts = files.select(package, path, text).join(won, [package, path]).dropDuplicates([package, path])
    return texts.select(package, path, F.split(text, "\n").alias("lines"), F.inline("won")).select(
        package, path, (F.col("i") + 1).cast("bigint").alias("line_no"),
        F.left(
            F.regexp_replace(F.array_join(F.slice("lines", start + 1, F.col("i") + after + 1 - start), "\n"), r"^\s+|\s+$", ""),
            F.lit(width),
        ).alias("snippet"), "rank",
    )


def first_terms(tools: DataFrame, package: str, item: str, n: int = 8) -> DataFrame:
    """The first n names per package as an array."""
    return _first_per(tools.select(package, item).distinct(), [package], [F.col(item).asc()], n).groupBy(package).agg(
        F.array_sort(F.collect_list(item)).alias("terms")
    )
