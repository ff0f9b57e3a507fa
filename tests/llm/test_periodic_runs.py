"""Periodic runs against a search over all periods."""

import hashlib
import random
import zlib

import pytest

from catalens.llm.periodic_runs import collapse, periodic_runs, runs_of
from catalens.llm.queries import with_repeated_tails


def brute(words, least=12):
    """Stretches of equal words q apart, for every q; of one stretch the smallest period counts."""
    best, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > start and i - start + q >= max(least, 2 * q):
                best.setdefault((start, i - start + q), q)
            i = max(i, start + 1)
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_all_periods():
    random.seed(3)
    for _ in range(400):
        docs = []
        for _ in range(random.randint(1, 4)):
            n, k = random.choice([0, 1, 11, 12, 13, 40, 120]), random.choice([1, 2, 3, 30])
            words = [random.randrange(k) for _ in range(n)]
            if n > 4 and random.random() < 0.5:
                a = random.randrange(n)
                p = 1 + random.randrange((n - a) // 2 + 1)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            docs.append([b"%d" % w for w in words])
        for least in (12, 5, 4):
            assert runs_of(docs, least) == [brute(d, least) for d in docs]


def test_long_periodic_texts_stay_cheap():
    words = [b"a"] * 30_000
    assert runs_of([words]) == [[(0, 30_000, 1)]]
    assert collapse(words, [(0, 30_000, 1)]) == [b"a"]
    mixed = [w for i in range(3_000) for w in (b"x%d" % i, *(b"c%d" % j for j in range(7)), b"y%d" % i)]
    assert runs_of([mixed]) == [[]]


def test_collapse_keeps_what_a_first_period_shows_alone():
    words = [b"%d" % (i % 3) for i in range(14)] + [b"z"]
    assert collapse(words, runs_of([words])[0]) == [b"0", b"1", b"2", b"z"]


def test_edges_and_clashing_columns(spark, edge_documents):
    docs = edge_documents.withColumn("runs", edge_documents.text).withColumn("n_words", edge_documents.text)
    found = periodic_runs(docs, ["doc_id"]).collect()
    assert len(found) == docs.count()
    by_id = {r["doc_id"]: r for r in found}
    for i in (1, 2, 3):
        assert (by_id[i]["n_words"], by_id[i]["runs"], by_id[i]["collapsed"]) == (0, [], "")
    assert by_id[None]["n_words"] == 3 and len([r for r in found if r["doc_id"] == 5]) == 2
    assert periodic_runs(docs.limit(0), ["doc_id"]).collect() == []


def test_query_equals_brute_force(spark, documents, tmp_path):
    from catalens.llm.queries import op11_periodic_runs

    random.seed(5)
    rows = [(i, " ".join(random.choice("abcdefgh") for _ in range(random.choice([0, 3, 40, 90])))) for i in range(120)] + [(None, "a b " * 9), (500, None)]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, text in rows:
        words, h = (text or "").encode().split(), zlib.crc32(b"" if i is None else str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        gone = {j for s, length, q in runs for j in range(s + q, s + length)}
        want.append((i, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
                     hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
                     hashlib.sha256(b" ".join(w for j, w in enumerate(words) if j not in gone)).hexdigest()))
    got = [tuple(r) for r in op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(r[1] > 0 for r in want) > 5


def test_tails_repeat_only_where_drawn(spark, documents):
    texts = {r["doc_id"]: r["text"] for r in with_repeated_tails(documents([(i, "a b  c d e f g h") for i in range(60)])).collect()}
    changed = {i for i, t in texts.items() if t != "a b  c d e f g h"}
    assert changed and changed <= {i for i in range(60) if zlib.crc32(str(i).encode()) % 10 == 0}
    assert pytest.approx(8) == max(len(t.split()) for t in texts.values())
