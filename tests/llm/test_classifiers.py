"""Toxicity and quality: held-out accuracy, brute-force sums, defined results on odd rows."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalens.llm import quality, toxicity
from catalens.llm.labels import labelled, remainder


def _corpus(n, seed):
    rng = random.Random(seed)
    parts = ["an", "the", "ro", "li", "mer", "sto", "vin", "del", "qua", "res"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
    rows = []
    for i in range(n):
        words, toxic = [word() for _ in range(rng.randint(20, 60))], i % 4 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), "zorg" + rng.choice(parts))
        good = i % 3 != 0
        if not good:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), int(toxic), int(good)))
    return rows


@pytest.fixture(scope="module")
def corpus(spark, documents):
    rows = _corpus(600, 5)
    docs = documents([r[:2] for r in rows])
    labels = spark.createDataFrame([(r[0], r[3], r[2]) for r in rows], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_toxicity_finds_new_forms_and_leaves_clean_texts_alone(corpus):
    rows, docs, labels = corpus
    held = remainder(3) == 1
    model = toxicity.fit(labelled(docs, labels, "toxic", ~held, 1000))
    scored = toxicity.score_documents(docs.filter(held), model, ["doc_id"]).collect()
    truth = {r[0]: r[2] for r in rows}
    assert all((r.score >= 0.7) == bool(truth[r.doc_id]) for r in scored) and len(scored) > 100
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in scored)


def test_letters_after_a_context_sum_to_one_in_both_classes(spark):
    rng = random.Random(3)
    words = [("".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))), y, rng.randint(1, 3)) for y in (0, 1) for _ in range(150)]
    words += [("idiot", 1, 90), ("idiom", 0, 40), ("idea", 0, 300), ("idea", 1, 30), ("bad", 1, 60), ("bat", 0, 300), ("q", 0, 1)]
    frame = spark.createDataFrame(words, "w string, label int, n int").groupBy("label", "w").agg(F.sum("n").alias("n"))
    model = toxicity._smooth(*toxicity.gram_tables(frame))
    assert model.own and set(model.rest) == {g[:-1] for g in model.own}
    alphabet = sorted({g[-1] for g in model.grams})

    def both(gram):
        return model.grams.get(gram, model.back.get(gram[:-1], 0.0) + model.letter(gram[1:]))

    for ctx in sorted({g[:-1] for g in model.grams}):
        for c in (0, 1):
            rest = model.rest.get(ctx, (0.0, 0.0))[c]
            total = sum(math.exp(model.own[ctx + x][c] if ctx + x in model.own else both(ctx + x) + rest) for x in [*alphabet, "?"])
            assert abs(total - 1.0) < 1e-9, (ctx, c, total)
    assert "<q>" in model.grams  # a gram of a single document counts


def test_toxicity_sums_equal_a_plain_evaluation(corpus):
    _, docs, labels = corpus
    model = toxicity.fit(labelled(docs, labels, "toxic", F.lit(True), 1000))
    text = "Zorgan the rolimer, unseen XYZ ñandú"
    by_word = [(*model.word(w), len(w) + 1) for w in ("zorgan", "the", "rolimer", "unseen", "xyz", "ñandú")]
    assert model.document(text) == pytest.approx(tuple(map(sum, zip(*by_word))))
    assert model.word("zorgan")[0] > model.word("zorgan")[1] + 2
    # A word that tells nothing differs only by what telling letters leave to the others after the contexts it passes.
    contexts = ["<unseen>"[max(0, end + 1 - toxicity.ORDER):end] for end in range(1, 8)]
    left = sum(model.rest[c][0] - model.rest[c][1] for c in contexts if c in model.rest)
    assert model.word("unseen")[0] - model.word("unseen")[1] == pytest.approx(left) and abs(left) < 0.2
    assert model.document(None) == model.document("12 !!") == (0.0, 0.0, 0)
    # Both classes' probabilities of the letters after a seen context sum to at most one.
    context = "<th"
    total = sum(math.exp(p) for g, p in model.grams.items() if g[:-1] == context)
    assert 0.5 < total <= 1.0


def test_quality_on_held_out_rows(corpus):
    rows, docs, labels = corpus
    held = remainder(5) == 0
    weights = quality.fit(labelled(docs, labels, "quality", ~held, 1000))
    scored = quality.score_documents(docs.filter(held), weights, ["doc_id"]).collect()
    truth = {r[0]: r[3] for r in rows}
    assert all((r.score >= 0.3) == bool(truth[r.doc_id]) for r in scored) and len(scored) > 60


def test_quality_dot_products_equal_a_plain_sum():
    weights = np.random.default_rng(1).normal(size=quality.BUCKETS + 1)
    texts = ["a b a b!", None, "", "word word", "x " * 5000]
    got = quality.dot_products(texts, weights, {})
    for text, value in zip(texts, got):
        flat, sizes = quality.token_hashes([text], {})
        single, pair = quality.ngram_buckets(flat, sizes)
        plain = weights[-1] + quality.SCALE * sum(weights[i] for i in [*single, *pair]) / max(1, len(single))
        assert value == pytest.approx(plain)
    assert quality.dot_products([], weights, {}).shape == (0,)


def test_labelled_rows_are_bounded_and_unambiguous(spark, documents):
    docs = documents([(i, f"t{i}") for i in range(50)] + [(None, "x"), (60, None)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(3, 0), (4, 0), (4, 0), (None, 1), (60, 1), (7, None)],
                                   "doc_id long, toxic int")
    got = labelled(docs, labels, "toxic", F.col("doc_id") < 40, 10).collect()
    assert len(got) == 20 and {r.label for r in got} == {0, 1} and all(r.doc_id < 40 and r.doc_id != 3 for r in got)


@pytest.mark.parametrize("rows", [[], [(1, "only one class", 1)]])
def test_without_both_classes_scores_are_half(spark, documents, rows):
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int")
    docs = documents([(1, "anything"), (2, None)])
    for scored in (toxicity.score_documents(docs, toxicity.fit(sample), ["doc_id"]),
                   quality.score_documents(docs, quality.fit(sample), ["doc_id"])):
        assert [r.score for r in scored.collect()] == [0.5, 0.5]


def test_odd_rows(edge_documents, corpus):
    _, docs, labels = corpus
    model = toxicity.fit(labelled(docs, labels, "toxic", F.lit(True), 1000))
    weights = quality.fit(labelled(docs, labels, "quality", F.lit(True), 1000))
    for frame in (edge_documents, edge_documents.limit(0)):
        for scored in (toxicity.score_documents(frame, model, ["doc_id"]), quality.score_documents(frame, weights, ["doc_id"])):
            got = scored.collect()
            assert len(got) == frame.count() and all(0 <= r.score <= 1 for r in got)
