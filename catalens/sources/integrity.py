"""Digest manifests of files and rows, and their verification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LARGEST_HASHED = 2_000_000_000  # a binary cell holds less than 2 GiB
CHUNK = 1 << 20  # bytes read at a time from files beyond that


def chunked_digest(path: Column) -> Column:
    """SHA-256 of the file at a path, read chunk by chunk inside the task, so that a file of any size fits."""
    size = CHUNK

    @F.arrow_udf("string")
    def run(paths):
        import hashlib
        from urllib.parse import quote

        import pyarrow as pa
        from pyarrow import fs

        def one(path: str) -> str:
            if path.startswith("file:"):
                system, inside = fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
            else:
                system, inside = fs.FileSystem.from_uri(quote(path, safe="/:@"))
            sha = hashlib.sha256()
            with system.open_input_stream(inside) as source:
                while block := source.read(size):
                    sha.update(block)
            return sha.hexdigest()

        return pa.array([one(p) for p in paths.to_pylist()], pa.string())

    return run(path)


def digest_files(
    spark: SparkSession, path: str, root: str = "", exclude_suffixes: Sequence[str] = (),
    exclude_dirs: Sequence[str] = ("__pycache__", "cache"), glob: str | None = None,
    largest_cell: int = LARGEST_HASHED,
) -> DataFrame:
    """Path, bytes and SHA-256 of every file below a folder; a file is one row, so hashing runs in parallel.

    Files too large for one cell are read chunk by chunk in their task, one file per partition; their folder has to be an
    address that pyarrow's file systems know. The two size ranges are separate scans because the size filter is pushed into
    the listing: oversized content never becomes a cell.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    keep = F.lit(True)
    for suffix in exclude_suffixes:
        keep = keep & ~F.col("path").endswith(suffix)
    for folder in exclude_dirs:
        keep = keep & ~F.contains(F.col("path"), F.lit(f"/{folder}/"))
    relative = F.regexp_replace("path", "^.*?" + root, "") if root else F.col("path")
    hashed = files.where((F.col("length") <= largest_cell) & keep).select(
        relative.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")
    )
    oversized = files.where((F.col("length") > largest_cell) & keep).select(
        relative.alias("path"), F.col("length").alias("bytes"), chunked_digest(F.col("path")).alias("sha256")
    )
    return hashed.unionByName(oversized)


def manifest_totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"))


def digest_rows(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """SHA-256 per row over the named columns; a null cell has a mark of its own, so it differs from an empty one."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in columns]
    return df.select(key, F.sha2(F.concat_ws("\u0001", *cells), 256).alias("sha256"))


def verify_manifest(manifest: DataFrame, actual: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """Status per manifest entry: ok, MISSING, MISMATCH, or UNVERIFIED where either side has no digest."""
    found = actual.select(key, F.col(digest).alias("_actual"), F.lit(True).alias("_there"))
    status = (
        F.when(F.col("_there").isNull(), "MISSING")
        .when(F.col(digest).isNull() | F.col("_actual").isNull(), "UNVERIFIED")
        .when(F.col(digest) == F.col("_actual"), "ok")
        .otherwise("MISMATCH")
    )
    return manifest.join(found, key, "left").select(key, status.alias("status"))


def verification_counts(verified: DataFrame) -> DataFrame:
    return verified.agg(
        F.count_if(F.col("status") == "ok").alias("verified"),
        F.count_if(F.col("status") == "MISSING").alias("missing"),
        F.count_if(F.col("status") == "MISMATCH").alias("mismatched"),
        F.count_if(F.col("status") == "UNVERIFIED").alias("unverified"),
    )
