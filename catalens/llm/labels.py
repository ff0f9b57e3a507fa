"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalens.llm.common import stored


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; for a null doc_id that of an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, train: Column, rows: int) -> DataFrame:
    """doc_id, text and label of at most `rows` labelled training documents of each class, first in hash order.

    train is a condition on doc_id that keeps held-out rows away. Rows without text, label or doc_id are left out, also
    documents with contradicting labels; repeated label rows count once. The first rows come from a window with a limit,
    which Spark cuts in every task before it shuffles. At most 2 * rows ids are sent to the scan of the texts.
    """
    marks = (labels.select("doc_id", F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)")
             .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_most")).filter("label = _most").drop("_most"))
    ids = docs.select("doc_id").filter(train).join(marks, "doc_id").distinct()
    first = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = ids.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= rows).drop("_n")
    texts = docs.select("doc_id", "text").filter(train).filter("text is not null")
    return stored(texts.join(F.broadcast(picked), "doc_id"), f"train-{label_col}")
