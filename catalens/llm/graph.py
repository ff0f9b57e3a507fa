"""Connected components of a link table, without any task or the driver holding the graph."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.llm.common import ship_with_tasks, stored

ship_with_tasks(__name__)


def find_root(parent: dict, x):
    """Root of x in a union-find forest, halving paths on the way."""
    while (up := parent.setdefault(x, x)) != x:
        parent[x] = parent.setdefault(up, up)
        x = up
    return x


def join_sets(parent: dict, a, b) -> bool:
    """Unite two sets under the smaller root; whether they were apart."""
    a, b = find_root(parent, a), find_root(parent, b)
    if a != b:
        parent[max(a, b)] = min(a, b)
    return a != b


def local_forests(edges: DataFrame) -> DataFrame:
    """Union-find inside each partition: every node's edge to its root there, so long chains shrink before a shuffle."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                join_sets(parent, a, b)
        pairs = [(x, find_root(parent, x)) for x in list(parent)]
        pairs = [p for p in pairs if p[0] != p[1]]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, component (smallest node reachable) for every node of edges (a, b); longs, no nulls.

    Large-star and small-star rounds over the edge table until it is a set of stars; each round is written to the shared
    folder. A round moves every edge to the least neighbour of its ends, so the number of rounds grows with the logarithm
    of the longest path. Hot nodes are aggregated before the shuffle and joined as equi-joins, which Spark may split.
    """
    links = stored(local_forests(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b"))
                   .distinct(), label)
    before = None
    while True:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
                 .union(least.select("u", "m")).filter("a <> b").distinct())
        links = stored(small, label)
        state = links.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if state == before:
            break
        before = state
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
