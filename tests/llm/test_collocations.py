"""Quotient filters and collocations against plain counting."""

import random
from collections import Counter

import numpy as np
import pytest

from catalens.llm import collocations as co
from catalens.llm import quotient_filter as qf


@pytest.mark.parametrize("bits", [1, 2, 7, 31, 32, 33, 63, 64])
def test_filters_are_lossless_and_merge(bits):
    rng = np.random.default_rng(bits)
    numbers = np.unique(rng.integers(0, 1 << min(bits, 63), 3000, dtype=np.uint64) << np.uint64(bits == 64))
    permuted = qf.permute(numbers, bits)
    assert len(np.unique(permuted)) == len(numbers) and (qf.restore(permuted, bits) == numbers).all()
    permuted, counts = np.sort(permuted), rng.integers(1, 100_000, len(numbers))
    keys, read = qf.entries(qf.build(permuted, counts, bits))
    assert (keys == permuted).all() and (read == counts).all()
    keys, sums = qf.merge([qf.build(permuted, counts, bits), qf.build(permuted[::3], counts[::3], bits), qf.build(permuted[:0], counts[:0], bits)])
    counts[::3] *= 2
    assert (keys == permuted).all() and (sums == counts).all()


def test_a_filter_is_smaller_than_its_numbers():
    permuted = np.unique(qf.permute(np.arange(100_000), 32))
    assert len(qf.build(permuted, np.ones(100_000, np.int64), 32)) < 4 * 100_000


def test_squeezed_keeps_every_pair():
    rng = np.random.default_rng(1)
    for _ in range(300):
        ids = (rng.integers(0, 4, rng.integers(0, 30)) * rng.integers(0, 2)).astype(np.uint32)
        pairs = lambda x: [(a, b) for a, b in zip(x.tolist(), x.tolist()[1:]) if a and b]
        assert pairs(co._squeezed(ids)) == pairs(ids)


def brute(rows, least, top):
    grams, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in co.words_and_breaks((text or "").encode()) and b" ".join(co.words_and_breaks(text.encode())).split(b"\xff"):
            words = piece.decode().split()
            total[lang] += len(words)
            grams.update((lang, tuple(words[i:i + m])) for m in range(1, 6) for i in range(len(words) - m + 1))
    found = []
    often = {k: f for k, f in grams.items() if f >= least and len(k[1]) > 1}
    for (lang, p), a in often.items():
        if any(g == lang and len(q) > len(p) and f >= a and f" {' '.join(p)} " in f" {' '.join(q)} " for (g, q), f in often.items()):
            continue
        cuts = [(1000 * a * total[lang] // (grams[lang, p[:k]] * grams[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found.append((lang, " ".join(p), a, grams[lang, p[:k]], grams[lang, p[k:]], total[lang], score))
    out = []
    for lang in {r[0] for r in found}:
        mine = sorted((r for r in found if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        out += [(r[0], i + 1, *r[1:]) for i, r in enumerate(mine)]
    return sorted(out)


@pytest.mark.parametrize("sent", [1_000_000, 40, 0])
def test_equals_plain_counting_over_several_blocks(spark, monkeypatch, sent):
    monkeypatch.setattr(co, "SENT", sent)
    monkeypatch.setattr(co, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(co, "RANGE_ENTRIES", 200)
    monkeypatch.setattr(co, "NUMBERED_ROWS", 7)
    random.seed(2)
    vocabulary = ["De", "la", "un", "é", "x.y", "tail,", "A\tb", "a a a", "new york city hall steps"] + [f"w{i}" for i in range(20)]
    rows = [(random.choice(["en", "fr", None]), " ".join(random.choices(vocabulary, k=random.choice([0, 1, 5, 30])))) for _ in range(150)]
    rows += [("en", None), ("en", ""), ("en", "\n\n.,"), ("de", "new york city hall steps\nnew york city hall steps")] + [("en", "over and over")] * 12
    docs = spark.createDataFrame([(lang, text, "own", "own") for lang, text in rows], "lang string, text string, id string, words string").repartition(3)
    got = sorted(tuple(r) for r in co.collocations(docs, 8, 5, 40).collect())
    assert got == brute(rows, 8, 40) and any(len(r[2].split()) == 5 for r in got)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert co.collocations(docs).collect() == []
