"""SentencePiece: equal to the library on a given model, exact round trips, unigram Viterbi against brute force."""

import itertools
import os
import random

import pytest

from catalens.llm import sentencepiece as sp
from catalens.llm.queries import TOKENIZER_MODEL

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER_MODEL), reason="no tokenizer files")


@pytest.fixture(scope="module")
def vocabulary():
    return sp.load_vocabulary(TOKENIZER_MODEL)


def test_equals_the_library(vocabulary):
    from sentencepiece import SentencePieceProcessor

    ref, encoder, rng = SentencePieceProcessor(model_file=TOKENIZER_MODEL), sp.Encoder(vocabulary), random.Random(3)
    alphabet = "  ▁abcdefghinorst.,\n\té日0123𝄞<>\x00_"
    texts = ["", " ", "  a\n b ", "▁x", "<s> </s>", "ab" * 300, " " * 40 + "the" + " " * 17]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    assert encoder.encode(texts) == ref.encode(texts)
    assert [sp.decode_ids(vocabulary, i) for i in encoder.encode(texts)] == [ref.decode(i) for i in ref.encode(texts)]


def test_shared_prefixes_change_nothing(vocabulary):
    words = ["▁inter", "▁international", "▁internationally", "▁in", "▁zebra"]
    together, alone = sp.Encoder(vocabulary), {}
    together.traverse(set(words))
    for w in words:
        one = sp.Encoder(vocabulary)
        one.traverse({w})
        alone[w] = one.words[w]
    assert together.words == alone


def test_unigram_viterbi_against_all_segmentations():
    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "c": -4.0, "ab": -3.1, "bc": -3.3, "abc": -6.0, "▁a": -2.2, "ca": -3.0}
    ids = {p: i + 3 for i, p in enumerate(scores)}
    vocab = sp.Vocabulary("unigram", ids, scores, (), 0, tuple([b""] * 3 + [p.encode() for p in scores]), 3)
    encoder = sp.Encoder(vocab)
    back = {i: p for p, i in ids.items()}
    for n in range(1, 6):
        for letters in itertools.product("abc", repeat=n):
            word = "▁" + "".join(letters)
            cuts = [[word[i:j] for i, j in zip((0, *c), (*c, len(word)))]
                    for k in range(len(word)) for c in itertools.combinations(range(1, len(word)), k)]
            best = max(sum(scores[p] for p in c) for c in cuts if all(p in scores for p in c))
            got = encoder.encode(["".join(letters)])[0]
            assert sum(scores[back[i]] for i in got) == pytest.approx(best)


def test_documents_round_trip_and_odd_rows(edge_documents, vocabulary):
    encoded = sp.encode_documents(edge_documents, vocabulary, ["doc_id"], check=True)
    rows = encoded.collect()
    assert len(rows) == edge_documents.count()
    assert all(r.round_trip is not False and r.n_tokens == len(r.ids or ()) for r in rows)
    assert [r for r in rows if r.doc_id == 1][0].ids is None and [r for r in rows if r.doc_id == 2][0].ids == []
    decoded = {r.doc_id: r.text for r in sp.decode_documents(encoded, vocabulary, ["doc_id"]).collect()}
    assert decoded == {r.doc_id: r.text for r in edge_documents.collect()}
    assert sp.encode_documents(edge_documents.limit(0), vocabulary, ["doc_id"]).count() == 0
