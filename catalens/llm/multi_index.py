"""Approximate nearest neighbours by largest inner product with an inverted multi-index.

Both halves of the vectors are quantised on their own; a row lies in the cell of its pair of centroids. A query visits
cells in order of summed half inner products, taken from a heap that grows from the best pair, until the visited cells
hold enough different vectors; the rows of these cells are ranked by their exact inner product.

How many are enough is measured: for a fixed number of queries the true neighbours are found by comparison with all rows,
and the visit goes as far as RECALL of these neighbours need. Codebooks come from a bounded sample; every row is indexed.
Cells are gathered into groups of about GROUP_ROWS rows, and a cell larger than that is split; queries are dealt into blocks of
about QUERY_ROWS, and every block meets the rows of every group on its own. So no call holds more of either, but for chance.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalens.llm.common import ship_with_tasks, stored

ship_with_tasks(__name__)

#: Centroids of each half, and rows of the sample they are fitted on.
CENTROIDS, SAMPLE = 64, 8192
#: Queries compared with all rows to set the length of a visit, and the share of their neighbours it must reach.
MEASURED, RECALL = 128, 0.96
#: Rows of a group and queries of a block, about.
GROUP_ROWS, QUERY_ROWS = 4096, 16_384


def k_means(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of the points, started from every len/k-th of them."""
    centers = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(points, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=len(centers))
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (2.0 * points @ centers.T - (centers * centers).sum(axis=1)).argmax(axis=1)


def visit(query: np.ndarray, books: tuple[np.ndarray, np.ndarray], weights: np.ndarray, enough: float) -> list[int]:
    """Cells with rows in order of summed inner products, until their weights reach `enough`."""
    half = books[0].shape[1]
    first, second = books[0] @ query[:half], books[1] @ query[half:]
    by_first, by_second = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    a, b = first[by_first].tolist(), second[by_second].tolist()
    width, out, total = len(b), [], 0.0
    heap = [(-(a[0] + b[0]), 0, 0)]
    while heap and total < enough:
        _, i, j = heapq.heappop(heap)
        cell = by_first[i] * width + by_second[j]
        if weights[cell]:
            out.append(cell)
            total += weights[cell]
        if j + 1 < width:
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
    return out


def best_of(ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, own: int, k: int) -> list[tuple[int, float]]:
    """The k rows of largest inner product, ties to the smaller id; own id left out, a repeated id counted once.

    Sums run along each row by itself, so equal vectors get equal scores.
    """
    rough = vectors @ query
    keep = ids != own
    if keep.sum() > 2 * k:
        edge = np.partition(rough[keep], -k)[-k]
        # Rows that repeat an id may fill the first k places; then look at all.
        close = keep & (rough >= edge - 1e-9 * (1.0 + abs(edge)))
        if len(np.unique(ids[close])) >= k:
            keep = close
    ids, scores = ids[keep], (vectors[keep] * query).sum(axis=1)
    out: dict[int, float] = {}
    for at in np.lexsort((ids, -scores)):
        if len(out) == k:
            break
        out.setdefault(int(ids[at]), float(scores[at]))
    return list(out.items())


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vector (doubles) of the rows that take part: an id, and finite components, not all zero, of the usual number.

    The usual number of components is the most frequent one, the greater of equals. Repeated rows count once.
    """
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    good = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), vector.alias("vector")).filter(
        F.col("id").isNotNull() & (F.size("vector") > 0)
        & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
        & F.exists("vector", lambda x: x != 0))
    sizes = good.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return good.filter(F.size("vector") == (sizes["size"] if sizes else 0)).dropDuplicates(["id", "vector"])


def _matrix(column, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if len(column) else np.empty((0, width))


def nearest_neighbours(rows: DataFrame, is_query: Column | str, k: int = 20, id_col: str = "vec_id",
                       vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, id, score: the k found neighbours of every row that is_query (a condition on the column id) picks.

    Unusable rows are neither queries nor candidates; an empty table gives an empty result.
    """
    import pyarrow as pa

    spark = rows.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, id long, score double")
    clean = stored(usable(rows, id_col, vector_col), "vectors")
    sample = clean.select(F.xxhash64("id").alias("h"), "id", "vector").orderBy("h", "id").limit(SAMPLE).collect()
    if not sample:
        return empty
    points = np.array([r["vector"] for r in sample])
    width, half = points.shape[1], points.shape[1] // 2
    books = (k_means(points[:, :half], CENTROIDS), k_means(points[:, half:], CENTROIDS))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(pa.chunked_array([batch.column(1)]), width)
            cell = nearest(v[:, :half], books[0]) * len(books[1]) + nearest(v[:, half:], books[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], ["id", "vector", "cell"])

    index = stored(clean.select("id", "vector").mapInArrow(place, "id long, vector array<double>, cell int"), "cells")
    counted = index.groupBy("cell", F.xxhash64("vector").alias("h")).agg(F.count("*").alias("n")).groupBy("cell").agg(
        F.count("*").alias("different"), F.sum("n").alias("n")).collect()  # at most CENTROIDS squared rows
    weights, sizes = np.zeros(len(books[0]) * len(books[1])), np.zeros(len(books[0]) * len(books[1]), np.int64)
    for r in counted:
        weights[r["cell"]], sizes[r["cell"]] = r["different"], r["n"]
    group = (np.cumsum(sizes) - sizes) // GROUP_ROWS
    parts = np.maximum(1, -(-sizes // GROUP_ROWS))

    queries = index.filter(is_query).select(F.col("id").alias("query_id"), "vector")
    # At least k different vectors besides the query's own, so that k rows are found wherever there are as many.
    enough = max(k + 2.0, _visit_length(index, queries, books, weights, k, recall))
    blocks = max(1, -(-queries.count() // QUERY_ROWS))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            vectors = _matrix(pa.chunked_array([batch.column(1)]), width)
            for query_id, vector, block in zip(batch.column(0).to_pylist(), vectors, batch.column(2).to_pylist()):
                cells = np.array(visit(vector, books, weights, enough), np.int32)
                for g in np.unique(group[cells]):
                    own = cells[group[cells] == g]
                    for part in range(int(parts[own].max())):
                        here = own[parts[own] > part]
                        out.append((query_id, vector, int(g), part, block, here.tobytes()))
            kinds = (pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)],
                                             ["query_id", "vector", "g", "part", "block", "cells"])

    def rerank(asked: pa.Table, held: pa.Table) -> pa.Table:
        cell = held["cell"].to_numpy()
        order = np.argsort(cell, kind="stable")
        ids, vectors, cell = held["id"].to_numpy()[order], _matrix(held["vector"], width)[order], cell[order]
        found: list[tuple] = []
        for query_id, vector, cells in zip(asked["query_id"].to_pylist(), _matrix(asked["vector"], width), asked["cells"].to_pylist()):
            cells = np.frombuffer(cells, np.int32)
            spans = zip(np.searchsorted(cell, cells), np.searchsorted(cell, cells, "right"))
            at = np.concatenate([np.arange(a, b) for a, b in spans] or [np.empty(0, np.int64)])
            found += [(query_id, i, s) for i, s in best_of(ids[at], vectors[at], vector, query_id, k)]
        return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()), "id": pa.array([f[1] for f in found], pa.int64()),
                         "score": pa.array([f[2] for f in found], pa.float64())})

    spots = spark.createDataFrame([(int(c), int(group[c]), int(parts[c])) for c in np.flatnonzero(sizes)],
                                  "cell int, g long, parts int")  # at most CENTROIDS squared rows
    held = (index.join(F.broadcast(spots), "cell").withColumn("part", F.pmod(F.xxhash64("id", "vector"), F.col("parts")).cast("int"))
            .select("g", "part", "cell", "id", "vector"))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("query_id", "vector", F.lit("block")), F.lit(blocks)).cast("int"))
    asked = dealt.mapInArrow(route, "query_id long, vector array<double>, g long, part int, block int, cells binary")
    met = held.select(F.col("g").alias("hg"), F.col("part").alias("hp"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("hb"),
                      "cell", "id", "vector")
    found = asked.groupBy("g", "part", "block").cogroup(met.groupBy("hg", "hp", "hb")).applyInArrow(
        rerank, "query_id long, id long, score double")
    return _first(found, k)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    once = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def _visit_length(index: DataFrame, queries: DataFrame, books, weights: np.ndarray, k: int, recall: float) -> float:
    """Different vectors a visit must hold so that the measured queries find `recall` of their true neighbours."""
    import pyarrow as pa

    measured = [(r["query_id"], np.array(r["vector"])) for r in
                queries.select(F.xxhash64("query_id").alias("h"), "*").orderBy("h", "query_id").limit(MEASURED).collect()]
    if not measured:
        return 0.0
    width = len(measured[0][1])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v, cell = batch.column(0).to_numpy(), _matrix(pa.chunked_array([batch.column(1)]), width), batch.column(2).to_numpy()
            where = dict(zip(ids.tolist(), cell.tolist()))
            rows = [(q, i, s, where[i]) for q, x in measured for i, s in best_of(ids, v, x, q, k)]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)],
                                             ["query_id", "id", "score", "cell"])

    near = index.mapInArrow(compare, "query_id long, id long, score double, cell int")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    true = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).collect()  # MEASURED times k rows
    needed, reach = [], {}
    for q, x in measured:
        cells = visit(x, books, weights, float("inf"))
        reach[q] = dict(zip(cells, np.cumsum(weights[cells]) - weights[cells] + 1))
    needed = sorted(reach[r["query_id"]][r["cell"]] for r in true)
    return float(needed[min(len(needed) - 1, int(len(needed) * recall))]) if needed else 0.0
