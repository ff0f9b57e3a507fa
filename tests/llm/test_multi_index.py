"""Approximate nearest neighbours: recall against brute force, visiting order, ties, odd vectors."""

import numpy as np
import pytest

from catalens.llm import multi_index as mi

QUERY = "id % 20 = 0"


def _brute(ids, x, q, k=20):
    s = (x * x[q]).sum(axis=1)
    s[ids == ids[q]] = -np.inf
    order = np.lexsort((ids, -s))[:k]
    return ids[order].tolist(), s[order]


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(12, 16))[rng.integers(0, 12, 1500)] + 0.4 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[900:1000] = x[900]  # equal vectors
    ids = rng.permutation(6000)[:1500]
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>").repartition(4)
    return ids, x.astype(np.float64), frame


def test_recall_order_and_exact_scores(clustered, monkeypatch):
    ids, x, frame = clustered
    monkeypatch.setattr(mi, "GROUP_ROWS", 90)
    rows = mi.nearest_neighbours(frame, QUERY).collect()
    found = {}
    for r in rows:
        found.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        got = sorted(found.pop(ids[q]))
        want, scores = _brute(ids, x, q)
        hits, total = hits + len(set(want) & {g[1] for g in got}), total + len(want)
        assert [g[0] for g in got] == list(range(1, 21)) and all(g[1] != ids[q] for g in got)
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(got, got[1:]))
        assert got[0][2] == pytest.approx((x[np.flatnonzero(ids == got[0][1])[0]] * x[q]).sum(), abs=1e-12)
    assert not found and hits / total >= 0.9


def test_visit_goes_by_summed_products():
    rng = np.random.default_rng(5)
    books, q, weights = (rng.normal(size=(7, 3)), rng.normal(size=(5, 3))), rng.normal(size=6), np.ones(35)
    weights[[3, 8]] = 0
    got = mi.visit(q, books, weights, float("inf"))
    value = ((books[0] @ q[:3])[:, None] + (books[1] @ q[3:])[None, :]).reshape(-1)
    assert got == [c for c in np.argsort(-value) if weights[c]] and mi.visit(q, books, weights, 4) == got[:4]


def test_best_of_breaks_ties_by_id_and_counts_an_id_once():
    ids, v = np.array([9, 4, 4, 7, 1, 2]), np.array([[1.0, 0], [1, 0], [2, 0], [1, 0], [5, 0], [0.5, 9]])
    assert mi.best_of(ids, v, np.array([1.0, 0.0]), 1, 3) == [(4, 2.0), (7, 1.0), (9, 1.0)]
    many = np.tile([[1.0, 0.0]], (50, 1))
    assert mi.best_of(np.repeat(5, 50), many, np.array([1.0, 0.0]), 1, 3) == [(5, 1.0)]


def test_odd_vectors_take_no_part(spark):
    good = [(i, [float(i), 1.0, -2.0, 0.5]) for i in range(0, 60, 4)]
    nan, inf = float("nan"), float("inf")
    odd = [(100, None), (120, []), (140, [0.0] * 4), (160, [1.0, None, 2.0, 3.0]), (180, [nan, 1.0, 1.0, 1.0]), (200, [inf, 1.0, 1.0, 1.0]),
           (220, [1.0, 2.0]), (None, [1.0, 2.0, 3.0, 4.0]), good[0], good[0]]
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(good + odd, "vec_id long, embedding array<float>").withColumns({"id": F.lit("clash"), "cell": F.lit(1)})
    rows = mi.nearest_neighbours(frame, QUERY).collect()
    ids, x = np.array([g[0] for g in good]), np.array([g[1] for g in good])
    for q in (0, 20, 40):
        want, _ = _brute(ids, x, int(np.flatnonzero(ids == q)[0]), 14)
        assert [r.id for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])] == want
    assert {r.query_id for r in rows} == {0, 20, 40}
    for empty in (frame.limit(0), frame.filter("vec_id is null"), frame.filter("vec_id = 140")):
        assert mi.nearest_neighbours(empty, QUERY).count() == 0
    assert mi.nearest_neighbours(frame.filter("vec_id = 0"), QUERY).count() == 0


def test_all_candidates_if_there_are_few(spark):
    rng = np.random.default_rng(8)
    frame = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(0, 380, 19)], "vec_id long, embedding array<float>")
    got = mi.nearest_neighbours(frame, QUERY).collect()
    assert {r.query_id for r in got} == {0} and sorted(r["rank"] for r in got) == list(range(1, 20))


def test_queries_meet_a_group_in_blocks(clustered, monkeypatch, tmp_path):
    ids, _, frame = clustered
    whole = {(r.query_id, r["rank"], r.id, r.score) for r in mi.nearest_neighbours(frame, QUERY).collect()}
    monkeypatch.setattr(mi, "QUERY_ROWS", 20, raising=False)
    n = int((ids % 20 == 0).sum())
    apply, sizes = mi.best_of, str(tmp_path)

    def noted(*args):
        import inspect
        import os
        import uuid

        asked = inspect.currentframe().f_back.f_locals.get("asked")
        if asked is not None:
            open(os.path.join(sizes, f"{asked.num_rows}-{uuid.uuid4().hex}"), "w").close()
        return apply(*args)

    monkeypatch.setattr(mi, "best_of", noted)
    assert {(r.query_id, r["rank"], r.id, r.score) for r in mi.nearest_neighbours(frame, QUERY).collect()} == whole
    import os

    most = max(int(f.split("-")[0]) for f in os.listdir(sizes))
    assert n > 60 and most <= 40
