"""Readers for landed text: JSON lines and hand-returned CSV sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalens.schemas import ENTRY

CORRUPT = "_corrupt"


def read_entries(spark: SparkSession, path: str, schema: str = ENTRY) -> DataFrame:
    """Nested catalogue entries, one JSON object per line; blank lines are skipped, a malformed line fails the read.

    `read_jsonl` sets malformed lines apart instead.
    """
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines) of a JSON-lines file."""
    parsed = (
        spark.read.text(path).where(F.trim("value") != "")
        .select("value", F.from_json(
            "value", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
        ).alias("j"))
    )
    bad = F.col(f"j.{CORRUPT}").isNotNull()
    return parsed.where(~bad).select("j.*").drop(CORRUPT), parsed.where(bad).select(F.col("value").alias("line"))


# A record ends at a line break outside quotes; a cell is quoted, with doubled quotes inside, or plain.
_RECORD = r'(?:[^"\n]++|"(?:[^"]++|"")*+")++'
_CELL = r'(\s*"(?:[^"]++|"")*+"\s*|[^,]*+),'


def _cells(record: Column) -> Column:
    """Trimmed cells of a record; a quoted cell loses its quotes."""
    def plain(cell: Column) -> Column:
        inner = F.regexp_replace(F.regexp_extract(cell, r'(?s)^"(.*)"$', 1), '""', '"')
        return F.when(cell.startswith('"'), F.trim(inner)).otherwise(cell)

    return F.transform(F.regexp_extract_all(F.concat(record, F.lit(",")), F.lit(_CELL), F.lit(1)), lambda c: plain(F.trim(c)))


def read_coded_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Hand-returned CSV sheets, all columns text, by the names in each sheet's header whatever their order.

    Byte-order marks, Markdown fences and blank lines are left out; a quoted cell may hold commas and line breaks. A
    column that a sheet lacks is empty, one that is not asked for is left out. A sheet is a file and read as one row.
    """
    text = F.regexp_replace(F.regexp_replace("value", "﻿", ""), "\r\n?", "\n")
    text = F.regexp_replace(text, r"(?m)^[ \t]*```.*$", "")
    records = F.filter(F.regexp_extract_all(text, F.lit(_RECORD), F.lit(0)), lambda r: F.trim(r) != "")
    sheets = spark.read.text(path, wholetext=True).select(records.alias("records")).where(F.size("records") > 0)
    rows = sheets.select(
        _cells(F.col("records")[0]).alias("header"), F.explode(F.slice("records", F.lit(2), F.size("records"))).alias("record")
    ).select("header", _cells(F.col("record")).alias("cells"))
    place = lambda c: F.array_position("header", F.lit(c)).cast("int")
    return rows.select(*[
        F.when(place(c) > 0, F.coalesce(F.get("cells", place(c) - 1), F.lit(""))).otherwise("").alias(c) for c in columns
    ])


def repair_arity(df: DataFrame, line: str, columns: list[str], at: int, when: Column | None = None) -> DataFrame:
    """Rows of comma-separated cells where one cell was lost: when exactly one is missing (and `when` holds over
    the array column `cells`), an empty cell is put back at 0-based position `at`; shorter rows are padded. Cells beyond the expected number stay
    in the array column `surplus`."""
    expected = len(columns)
    cells = df.withColumn("cells", F.split(line, ","))
    lost = F.size("cells") == expected - 1
    if when is not None:
        lost = lost & when
    repaired = F.when(lost, F.array_insert("cells", at + 1, F.lit(""))).otherwise(F.col("cells"))
    kept = [c for c in df.columns if c != line]
    return cells.select(*kept, repaired.alias("cells"), lost.alias("repaired")).select(
        *kept, *[F.coalesce(F.get("cells", i), F.lit("")).alias(c) for i, c in enumerate(columns)], "repaired",
        F.slice("cells", F.lit(expected + 1), F.greatest(F.size("cells") - expected, F.lit(0))).alias("surplus"),
    )
