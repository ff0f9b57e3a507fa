"""Quality classifier: logistic regression over hashed word n-grams, fitted by follow-the-regularised-leader updates.

Words and runs of punctuation are the tokens; every token and every pair of neighbours is hashed to one of BUCKETS
weights, a token that comes again at once or after one other to one common pair. A text is the sparse vector of its n-gram counts over its
number of tokens, scaled by SCALE, so long and short texts weigh alike; its score is the logistic of the dot product
with the weights.

Fitting runs in Spark: a bounded sample of labelled rows is dealt into SHARDS groups by hash, every group makes PASSES
passes of per-coordinate FTRL-proximal updates, and the weights are averaged.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens.llm.common import batched, ship_with_tasks

ship_with_tasks(__name__)

BUCKETS = 1 << 18
#: Most labelled rows of each class that a model is fitted on, the first in hash order.
CLASS_ROWS = 6000
#: Groups that fit on their own; a group holds 2 * CLASS_ROWS / SHARDS rows, about.
SHARDS = 6
PASSES = 3
SCALE = 20.0
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
#: Tokens hashed at once.
CHUNK = 1_000_000
TOKENS = re.compile(r"\w+|[^\w\s]+")


def token_hashes(texts: list[str | None], seen: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token of the texts one after the other, and the number of tokens of each text."""
    found = [TOKENS.findall(t) if t else [] for t in texts]
    if len(seen) > 150_000:
        seen.clear()
    for token in set().union(*found).difference(seen):
        seen[token] = zlib.crc32(token.encode("utf-8", "surrogatepass"))
    flat = np.fromiter((seen[x] for tokens in found for x in tokens), np.uint64)
    return flat, np.fromiter(map(len, found), np.int64, len(found))


def ngram_buckets(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of single tokens and of pairs; a pair at a text's end gets bucket 0 of the pairs' start mark."""
    mask, odd = np.uint64(BUCKETS - 1), np.uint64(0x9E3779B97F4A7C15)
    single = (flat * odd >> np.uint64(40)) & mask
    after, later = np.roll(flat, -1), np.roll(flat, -2)
    if len(flat):
        ends = np.cumsum(sizes)[sizes > 0] - 1
        after[ends] = later[ends] = np.uint64(1 << 40)
        later[np.maximum(ends - 1, 0)] = np.uint64(1 << 40)
    mixed = (flat ^ (after * np.uint64(0xBF58476D1CE4E5B9))) * odd
    pair = np.where((flat == after) | (flat == later), np.uint64(1), (mixed >> np.uint64(38)) & mask)
    return single.astype(np.int32), pair.astype(np.int32)


def dot_products(texts: list[str | None], weights: np.ndarray, seen: dict[str, int]) -> np.ndarray:
    """Sparse dot product of every whole text with the weights (the last one is the constant's)."""
    out, chars = np.full(len(texts), float(weights[-1])), np.cumsum([len(t or "") for t in texts])
    edges = np.searchsorted(chars, np.arange(0, int(chars[-1]) if len(chars) else 0, CHUNK * 4), "left")
    edges = [*dict.fromkeys(edges.tolist()), len(texts)]
    for a, b in zip(edges, edges[1:]):
        flat, sizes = token_hashes(texts[a:b], seen)
        if len(flat):
            single, pair = ngram_buckets(flat, sizes)
            total = np.concatenate(([0.0], np.cumsum(weights[single] + weights[pair], dtype=np.float64)))
            ends = np.cumsum(sizes)
            out[a:b] += SCALE * (total[ends] - total[ends - sizes]) / np.maximum(sizes, 1)
    return out


def ftrl(texts: list[str], labels: np.ndarray, class_weight: np.ndarray) -> np.ndarray:
    """FTRL-proximal passes over the rows in the given order; returns the weights, the constant's last."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    seen: dict[str, int] = {}
    rows = []
    for text in texts:
        single, pair = ngram_buckets(*token_hashes([text], seen))
        ids, counts = np.unique(np.concatenate((single, pair)), return_counts=True)
        rows.append((np.append(ids, BUCKETS), np.append(SCALE * counts / max(len(single), 1), 1.0)))

    def at(ids: np.ndarray) -> np.ndarray:
        zi = z[ids]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[ids])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    for _ in range(PASSES):
        for (ids, x), y in zip(rows, labels):
            w = at(ids)
            g = class_weight[y] * (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            grown = n[ids] + g * g
            z[ids] += g - (np.sqrt(grown) - np.sqrt(n[ids])) / ALPHA * w
            n[ids] = grown
    return at(np.arange(BUCKETS + 1))


def fit(rows: DataFrame) -> np.ndarray:
    """Weights from rows (doc_id, text, label), label 1 good; zeros, which score 0.5, without rows of both classes.

    Classes count by their own sizes, so the score is the share of good texts among such as this in the sample.
    """
    if {r["label"] for r in rows.select("label").distinct().collect()} != {0, 1}:
        return np.zeros(BUCKETS + 1)

    def part(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(order=[zlib.crc32(f"order:{i}".encode()) for i in group["doc_id"]]).sort_values(["order", "doc_id"])
        weights = ftrl(group["text"].tolist(), group["label"].to_numpy(), np.ones(2))
        kept = np.flatnonzero(weights)
        return pd.DataFrame({"bucket": kept, "w": weights[kept]})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), F.col("doc_id")), F.lit(SHARDS)))
    averaged = (dealt.groupBy("shard").applyInPandas(part, "bucket long, w double")
                .groupBy("bucket").agg((F.sum(F.round("w", 9).cast("decimal(20,9)")) / SHARDS).cast("double").alias("w")).collect())
    weights = np.zeros(BUCKETS + 1)
    for r in averaged:
        weights[r["bucket"]] = r["w"]
    return weights


def score_documents(docs: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """keep columns and score (0 to 1, higher: better text) of every whole text; null and empty texts score the constant."""
    import pyarrow as pa

    spark = batched(docs.sparkSession)
    shipped = spark.sparkContext.broadcast(weights)
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, seen = shipped.value, {}
        for batch in batches:
            dots = dot_products(batch.column(batch.num_columns - 1).to_pylist(), w, seen)
            score = pa.array(1.0 / (1.0 + np.exp(-np.clip(dots, -500, 500))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], score], [f.name for f in schema.fields])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)
