"""Result-table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F


def save_table(df: DataFrame, path: str, fmt: str = "csv") -> int:
    """Write a result table and return its row count, observed during the write itself (no second pass)."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
    return seen.get["rows"]


def save_jsonl(df: DataFrame, path: str) -> int:
    """Write rows as gzip-compressed JSON lines and return their number; null fields are written out.

    Field names and nulls repeat in every line, so compressed files are a small part of the text. A task writes a file and a task
    reads it whole."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("ignoreNullFields", False).json(path, compression="gzip")
    return seen.get["rows"]
