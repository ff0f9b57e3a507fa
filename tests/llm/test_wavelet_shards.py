"""Wavelet matrices against the plain sequence, shard files against the tokenizer."""

import zlib

import numpy as np
import pytest

from catalens.llm import wavelet_shards as ws

public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n, top", [(0, 5), (1, 1), (5, 1), (511, 3), (512, 9), (513, 900), (3000, 50_000), (2000, 100_000)])
def test_matrix_equals_plain_sequence(n, top):
    rng = np.random.default_rng(n + top)
    ids = (rng.random(n) ** 3 * top).astype(np.int64)
    matrix, docs, sizes = ws.from_bytes(ws.to_bytes(ws.WaveletMatrix.build(ids), [1, None], np.array([n, 0])))
    assert docs == [1, None] and sizes.tolist() == [n, 0]
    assert (matrix.ids() == ids).all() and (matrix.access(np.arange(n)) == ids).all()
    for id_ in {*ids[:20].tolist(), 0, top, 1 << 20}:
        at = np.flatnonzero(ids == id_)
        assert matrix.occurrences(id_).tolist() == at.tolist()
        ends = rng.integers(0, n + 1, 10)
        assert matrix.rank([id_] * 10, ends).tolist() == [(at < e).sum() for e in ends]
        assert matrix.select([id_], [len(at)]).tolist() == [-1]


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(FILE)
    texts = ["It's 3.5, isn't it?!", "", "Ünï ́x . İ. é, Å.b", "tab\tand\nline\x0b\x1cfs nbsp em", "<|endoftext|> a <|startoftext|>b",
             "x" * 5000, "no.space,after:marks;9!a?", "ДА.нет 日本語。 🙂.!", "it.'s 'S 'Ll."]
    encoder = ws.Encoder(FILE)
    for _ in range(2):
        assert [np.frombuffer(encoder.encode(t.encode()), "<u4").tolist() for t in texts] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.encode(None) == b""


@pytest.fixture
def manifest(spark, edge_documents, tmp_path, monkeypatch):
    monkeypatch.setattr(ws, "RANGE_DOCUMENTS", 3)
    return ws.write_shards(edge_documents, str(tmp_path / "shards"), FILE, 2, shard_tokens=20)


def expected(rows):
    encoder, start, out = ws.Encoder(FILE), 0, []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = np.frombuffer(encoder.encode((text or "").encode()), "<u4").tolist() + [2]
        out.append((doc_id, start, ids))
        start += len(ids)
    return out


def test_files_round_trip(spark, manifest, edge_documents):
    want = expected(edge_documents.collect())
    got = sorted((r["start"], r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in ws.read_documents(manifest).collect())
    assert got == sorted((s, i, t) for i, s, t in want) and manifest.count() > 2
    digests = {r["start"]: r["ids_crc32"] for r in ws.document_digests(manifest).collect()}
    assert digests == {s: zlib.crc32(np.array(t, "<u4").tobytes()) for _, s, t in want}


def test_counts_occurrences_and_access(spark, manifest, edge_documents):
    want = expected(edge_documents.collect())
    flat = [t for _, _, ids in want for t in ids]
    some = [2, flat[0], flat[-2], 40_000]
    assert {r["id"]: r["n"] for r in ws.count_ids(manifest, some).collect()} == {i: flat.count(i) for i in some}
    found = sorted((r["id"], r["start"] + r["offset"]) for r in ws.find_ids(manifest, some).collect())
    assert found == sorted((t, i) for i, t in enumerate(flat) if t in some)
    places = spark.range(-1, len(flat) + 1, 7).toDF("place")
    assert {r["place"]: r["id"] for r in ws.ids_at(manifest, places).collect()} == {i: flat[i] for i in range(-1, len(flat), 7) if i >= 0}


def test_empty_table_and_wrong_file(spark, documents, tmp_path):
    manifest = ws.write_shards(documents([(1, "a")]).limit(0), str(tmp_path / "none"), FILE, 2)
    assert manifest.count() == 0 and ws.read_documents(manifest).collect() == []
    with pytest.raises(ValueError):
        ws.from_bytes(b"something else entirely, long enough")
