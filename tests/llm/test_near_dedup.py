"""Near-duplicates: brute force over all pairs, a large group of near copies, components, odd rows."""

import random

import numpy as np
import pytest

from catalens.llm import graph, minhash
from catalens.llm.near_dedup import duplicate_groups, linked


def _shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def _brute(rows):
    sets, parent = [(i, _shingles(t)) for i, t in rows if i is not None], {}
    for i, _ in sets:
        graph.find_root(parent, i)
    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1:]:
            if i == j or (a and b and 100 * len(a & b) >= 75 * len(a | b)):
                graph.join_sets(parent, i, j)
    return {i: graph.find_root(parent, i) for i, _ in sets}


def _near_copies(n, seed, words=120):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10_000)}"
        out.append(" ".join(copy))
    return out


def _corpus():
    rng = random.Random(11)
    texts = _near_copies(80, 1) + _near_copies(12, 2) + _near_copies(5, 3, 12)
    texts += [" ".join(f"v{rng.randrange(500)}" for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += [texts[3], texts[3].upper(), texts[-2], "short one", "Short  ONE", "", None]
    ids = rng.sample(range(1000), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("block", [512, 16])
def test_equals_brute_force(documents, monkeypatch, block):
    monkeypatch.setattr("catalens.llm.near_dedup.BLOCK", block)
    rows = _corpus()
    want, got = _brute(rows), duplicate_groups(documents(rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(_shingles(t)) for i, t in rows}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_odd_rows(edge_documents):
    got = duplicate_groups(edge_documents).collect()
    assert len(got) == edge_documents.count()
    by_id = {r.doc_id: (r.component_id, r.kept) for r in got}
    assert by_id[8] == (7, False) and by_id[1] == (1, True) and by_id[3] == (3, True) and by_id[None] == (None, True)
    assert duplicate_groups(edge_documents.limit(0)).count() == 0


def test_one_id_with_two_texts_links_both(documents):
    a, b = "a b c d e f g h", "q r s t u v w x"
    got = duplicate_groups(documents([(5, a), (5, b), (9, a), (8, b), (3, "k l m n o p")])).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 5), (9, 5), (8, 5), (3, 3)}


def test_signature_estimates_similarity_with_less_variance_than_independent_places():
    rng, errors = np.random.default_rng(2), []
    for _ in range(150):
        x = rng.integers(0, 1 << 62, 120).astype(np.uint64)
        a, b = np.unique(x[:90]), np.unique(x[30:])
        sig = minhash.signatures([a, b])
        errors.append((sig[0] == sig[1]).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.01 and np.var(errors) < 0.9 * 0.25 / minhash.SLOTS


def test_signature_is_the_least_offer_of_all_permutations():
    element = np.arange(1, 9, dtype=np.uint64) * np.uint64(0x123456789ABCDEF)
    whole = minhash.signatures([element])[0]
    parts = np.min([minhash.signatures([element[i:i + 1]])[0] for i in range(len(element))], axis=0)
    assert (whole == parts).all()
    assert sorted(minhash.signatures([element[:1]])[0] >> 32) == list(range(minhash.SLOTS))


def test_linked_at_the_edge():
    a = np.arange(100, dtype=np.uint64)
    assert linked(a, a[:75]) and not linked(a, a[:74])
    assert linked(a[:80], a[10:90]) and not linked(a[:80], a[12:92]) and linked(a[12:92], a[10:90])


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(7, 7), (2001, 2000)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1200)} | {2000: 2000, 2001: 2000}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
