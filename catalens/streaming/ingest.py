"""Resumable page ingest: each run appends only the pages that arrived since the last one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def ingest_pages(
    spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, schema, fmt: str = "json",
    glob: str | None = None, pages_per_batch: int | None = None,
) -> DataFrame:
    """Append new page files to a Parquet table and return the table.

    The stream's checkpoint is the cursor: a lost executor or a restarted driver replays at most the current
    batch, and the sink's commit log keeps the append exactly-once. `availableNow` ends the run when every
    page present at its start is ingested.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if pages_per_batch:
        reader = reader.option("maxFilesPerTrigger", pages_per_batch)
    query = (
        reader.load(in_dir).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).option("path", out_dir)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(schema).parquet(out_dir)


def ingest_known_pages(
    spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, schema: str | StructType, glob: str | None = None,
    pages_per_batch: int | None = None,
) -> DataFrame:
    """Like `ingest_pages` for pages of JSON lines, but a page is known by its content: landed again under another name, in the
    same run or a later one, it is not appended again.

    A page is read as one cell, its SHA-256 is looked up in the stream's state, and only then it is cut into lines. The state lives in
    the checkpoint and holds one digest per page ever seen, spread over the shuffle partitions; rows that repeat inside a page
    stay repeated. Blank lines give no row, a line that is no object a row of nulls. An empty page gives nothing.
    """
    reader = spark.readStream.format("text").option("wholetext", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if pages_per_batch:
        reader = reader.option("maxFilesPerTrigger", pages_per_batch)
    pages = reader.load(in_dir).withColumn("digest", F.sha2("value", 256)).dropDuplicates(["digest"])
    lines = pages.select(F.explode(F.split("value", "\r?\n")).alias("line")).where(F.trim("line") != "")
    query = (
        lines.select(F.from_json("line", schema).alias("row")).select("row.*").writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).option("path", out_dir).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(schema).parquet(out_dir)
