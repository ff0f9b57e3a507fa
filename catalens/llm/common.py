"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.session import materialise

#: A word is a maximal run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows per Arrow batch: texts can be long, so batches stay small.
BATCH_ROWS = 500

__all__ = ["BATCH_ROWS", "WORD", "batched", "lower_words", "ship_with_tasks", "split_words", "stored", "table", "unit", "word_bytes",
           "word_count", "words_in"]


def ship_with_tasks(module: str) -> None:
    """Send the functions of a module to the tasks by value, so that executors need not have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship_with_tasks(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batched(spark: SparkSession) -> SparkSession:
    """Bound the rows of an Arrow batch, so that a batch of the longest texts still fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame written once to the shared folder and read back: cuts the lineage and serves several readers."""
    return materialise(df, f"llm-{label}")


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(seed: int, key: Column) -> Column:
    """Uniform double in [0, 1) from the first 52 bits of md5(seed:key); a null key counts as the word null."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def lower_words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text with A-Z lower-cased: bytes.lower() and bytes.split() know ASCII only."""
    return text.lower().split() if text else []


def split_words(column):
    """The words of an Arrow binary column, as lower_words gives them: an Arrow binary array of all, and their number in each row."""
    import numpy as np
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.binary())
    rows = len(column)
    if not rows or column.nbytes == 0:
        return pa.array([], pa.binary()), np.zeros(rows, np.int64)
    column = column.fill_null(b"")
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + rows + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[edges[0]:edges[-1]]
    edges -= edges[0]
    codes = np.arange(256, dtype=np.uint8)
    codes[65:91] += 32
    kept = np.ones(256, bool)
    kept[[9, 10, 11, 12, 13, 32]] = False
    inside = kept[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    tops = edges[:-1][edges[:-1] < len(data)]
    begins[tops] = inside[tops]
    letters = codes[data[inside]]
    at = np.append(np.flatnonzero(begins[inside]), len(letters)).astype(np.int32)
    upto = np.concatenate(([0], np.cumsum(begins)))
    words = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(letters)])
    return words, np.diff(upto[edges])


def word_bytes(words):
    """Edges and bytes of an Arrow binary array without nulls."""
    import numpy as np

    edges = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
    return edges, np.frombuffer(words.buffers()[2] or b"", np.uint8)


def words_in(column) -> Iterator[list[bytes]]:
    """The lower-cased words of each text of an Arrow string column."""
    import pyarrow as pa

    for value in column.cast(pa.binary()):
        yield lower_words(value.as_py())
