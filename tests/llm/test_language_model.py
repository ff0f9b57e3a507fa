"""Language model: counts and base score by brute force, gradients, a proper distribution, odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from catalens.llm import gru
from catalens.llm.labels import remainder
from catalens.llm.language_model import score_documents


def _tokens(text):
    return (text or "").encode().lower().split() + [None]


def _held(i):
    return zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1


def test_base_score_and_counts(documents, monkeypatch):
    monkeypatch.setattr("catalens.llm.language_model.BLOCK_TOKENS", 150)
    rows = [(i, " ".join(f"W{(i * k) % 37} is" for k in range(1, 20 + i % 5))) for i in range(60)] + [(61, None), (62, "")]
    c = Counter(t for i, text in rows if not _held(i) for t in _tokens(text))
    n, v = sum(c.values()), len(c)
    got = score_documents(documents(rows), remainder(5) == 1).collect()
    assert len(got) == len(rows)
    for r in got:
        tokens = _tokens(dict(rows)[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            _held(r.doc_id), len(tokens), sum(c[t] > 0 for t in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens))
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one_after_any_state():
    p = gru.initial(np.arange(1.0, 50.0), np.full(gru.TAILS, 3.0))
    rng = np.random.default_rng(1)
    p = {k: (w + rng.normal(0, 0.3, w.shape)).astype(np.float32) if k != "bw" else w for k, w in p.items()}
    states = rng.normal(size=(3, gru.HIDDEN)).astype(np.float32)
    every = np.arange(49 + gru.TAILS)
    for s in states:
        assert np.exp(gru._output(p, np.tile(s, (len(every), 1)), every)).sum() == pytest.approx(1.0, abs=1e-4)


def test_start_is_the_unigram_model():
    counts, mass = np.array([5.0, 9.0, 2.0]), np.full(gru.TAILS, 1.0)
    p = gru.initial(counts, mass)
    total = (counts + 0.5).sum() + mass.sum()
    got = gru.log_probabilities(p, [np.array([1, 2, 4, 0])])
    assert got[0] == pytest.approx(sum(math.log(x / total) for x in (9.5, 2.5, 1.0, 5.5)), abs=1e-4)


def test_windows_carry_the_state(monkeypatch):
    rng = np.random.default_rng(3)
    p = gru.initial(rng.integers(1, 90, 70).astype(float), np.full(gru.TAILS, 4.0))
    p["Wc"] += rng.normal(0, 0.5, p["Wc"].shape).astype(np.float32)
    texts = [np.append(rng.integers(1, 78, n), 0) for n in (3, 200, 0, 65, 64, 130)]
    whole = gru.log_probabilities(p, texts)
    monkeypatch.setattr(gru, "SCORE_STEPS", 7)
    monkeypatch.setattr(gru, "SCORE_LANES", 2)
    assert gru.log_probabilities(p, texts) == pytest.approx(whole, rel=1e-5)
    assert whole[1] == pytest.approx(gru.log_probabilities(p, [texts[1]])[0], rel=1e-5)


def test_training_lowers_the_loss_on_unseen_text():
    rng = np.random.default_rng(4)
    texts = [np.append(np.tile([1, 2, 3, 4] if i % 2 else [5, 6, 7], 12), 0) for i in range(80)]
    counts = np.bincount(np.concatenate(texts), minlength=8).astype(float)
    p = gru.initial(counts, np.full(gru.TAILS, 0.5))
    q = gru.train(p, [texts[i] for i in rng.permutation(60)], passes=40)
    assert gru.log_probabilities(q, texts[60:]).sum() > 0.3 * gru.log_probabilities(p, texts[60:]).sum()
    assert all((a == b).all() for a, b in zip(gru.unpacked(gru.packed(q), q).values(), (q[k] for k in sorted(q))))


def test_odd_rows(edge_documents):
    got = score_documents(edge_documents, remainder(5) == 1).collect()
    assert len(got) == edge_documents.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert score_documents(edge_documents.limit(0), remainder(5) == 1).count() == 0
    alone = score_documents(edge_documents.filter("doc_id = 4"), remainder(1) == 0).collect()[0]
    assert (alone.train_tokens, alone.n_known, alone.held_out) == (0, 0, True)


def test_all_training_documents_and_all_frequent_words_reach_the_network(documents, monkeypatch):
    from catalens.llm import language_model as lm

    rows = [(i, " ".join(f"v{k}" for k in range(40))) for i in range(120)] + [(200, None), (201, "once")]
    seen, trained = [], lm._trained
    monkeypatch.setattr(lm, "FREQUENT", 8)
    monkeypatch.setattr(lm, "_trained", lambda docs, p, words, *rest: seen.append((docs.count(), set(words))) or trained(docs, p, words, *rest))
    got = score_documents(documents(rows).repartition(3), remainder(5) == 1)
    assert got.count() == len(rows)
    assert seen == [(sum(not _held(i) and t is not None for i, t in rows), {f"v{k}".encode() for k in range(40)})]


def test_larger_groups_are_a_distribution_and_training_keeps_unread_rows():
    p = gru.initial(np.arange(5000.0, 0, -1), np.full(gru.TAILS, 3.0))
    assert p["Ww"].shape[2] == 71
    every = np.arange(5000 + gru.TAILS)
    assert np.exp(gru._output(p, np.ones((len(every), gru.HIDDEN), np.float32), every)).sum() == pytest.approx(1.0, abs=1e-3)
    q = gru.train(p, [np.append(np.tile([3, 4], 60), 0)], passes=2)
    moved = np.flatnonzero((q["E"] != p["E"]).any(axis=1))
    assert set(moved) == {3, 4, len(p["E"]) - 1}


def test_whole_batches_are_split_and_named_as_single_texts_are():
    import pyarrow as pa

    from catalens.llm import language_model as lm
    from catalens.llm.common import lower_words, split_words, word_bytes

    odd = ["", None, " a ", "A\tb\x0bC\x0c\x1c d", " x  y\u0085", "É Éa", "  ", "z", None, "q! 1. é? a, b\\ %5é", "ends ", "B"]
    whole = pa.array([t if t is None else t.encode() for t in odd], pa.binary())
    frequent = {b"a": 1, b"x": 2, "Éa".encode(): 3}
    for part in (whole, whole.slice(1), whole.slice(3, 4), whole.slice(5, 1), whole.slice(0, 2), whole.slice(0, 0)):
        words, sizes = split_words(part)
        texts = [lower_words(t) for t in part.to_pylist()]
        assert (words.to_pylist(), sizes.tolist()) == (sum(texts, []), [len(t) for t in texts])
        assert gru.tail_classes(*word_bytes(words)).tolist() == [gru.tail_class(w) for t in texts for w in t]
        got = lm._text_symbols(part, pa.array(sorted(frequent, key=frequent.get), pa.binary()), 4)
        assert [g.tolist() for g in got] == [lm._symbols(t, frequent, 4, {}).tolist() for t in texts]


def test_output_of_many_rows_and_its_gradient_do_not_follow_the_rows_taken_at_a_time(monkeypatch):
    rng = np.random.default_rng(5)
    p = gru.initial(np.arange(200.0, 0, -1), np.full(gru.TAILS, 3.0))
    p["Ww"] += rng.normal(0, 0.5, p["Ww"].shape).astype(np.float32)
    p["Wc"] += rng.normal(0, 0.5, p["Wc"].shape).astype(np.float32)
    states, target = rng.normal(size=(300, gru.HIDDEN)).astype(np.float32), rng.integers(0, 200 + gru.TAILS, 300)

    def done():
        grad = {k: np.zeros_like(w) for k, w in p.items()}
        out, ds = gru._output(p, states, target, grad)
        return [out, ds, *grad.values()]

    want = done()
    for rows in (1, 7, 100_000):
        monkeypatch.setattr(gru, "OUTPUT_ROWS", rows)
        assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(done(), want))
    # The gradient of the loss by one state, against differences.
    for at in (0, 17):
        moved = [states.copy(), states.copy()]
        moved[0][at, 3] += 0.01
        moved[1][at, 3] -= 0.01
        up, down = (gru._output(p, s, target)[at] for s in moved)
        assert want[1][at, 3] == pytest.approx((down - up) / 0.02, abs=5e-3)


def test_sums_of_rows_by_symbol_are_those_of_every_row_alone():
    rng = np.random.default_rng(6)
    for longest in (1, 2, 17, 300):
        sizes = rng.integers(1, longest + 1, 40)
        rows = rng.normal(size=(sizes.sum() + 1, 5)).astype(np.float32)
        rows[-1] = 0
        order, edges = rng.permutation(sizes.sum()), np.concatenate(([0], np.cumsum(sizes)[:-1]))
        want = [rows[order[e:e + n]].sum(axis=0) for e, n in zip(edges, sizes)]
        assert np.allclose(gru._sums(rows, order, edges), want, atol=1e-4)


def test_memory_kept_between_windows_does_not_change_training():
    """A window shorter than the ones before reads nothing that they left."""
    p = gru.initial(np.arange(60.0, 0, -1), np.full(gru.TAILS, 3.0))
    rng = np.random.default_rng(7)
    texts = [np.append(rng.integers(1, 68, n), 0) for n in (30, gru.TRAIN_STEPS * 4 + 5, 0, 9)]
    first = gru.train(p, texts, passes=3)
    assert all((a == b).all() for a, b in zip(first.values(), gru.train(p, texts, passes=3).values()))
    assert gru.log_probabilities(first, texts).sum() > gru.log_probabilities(p, texts).sum()
