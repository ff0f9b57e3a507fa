"""Token ids in wavelet-matrix files: one compressed file per shard, with token access, counting and occurrence lookup.

A shard's ids are split into bit planes, the highest bit first; after each plane the ids are dealt anew, those with a 0 before those
with a 1, each in their order. A plane is stored as its bits and the number of ones before every 512th bit. From the planes alone come
the id at a place (access), how often an id occurs before a place (rank), and the place of its k-th occurrence (select), each
in one step per plane; ids themselves are not stored.

File: magic; lengths of the sections; sections compressed on their own: document ids (64-bit), marks of null document ids,
tokens per document (32-bit), zeros of every plane (64-bit), then per plane its bits in 64-bit words and the counts before every
eighth word (32-bit). All numbers are little-endian.

Documents are dealt by ranges of (doc_id, hash of the text), so repeated and null ids split; a task sorts its range, encodes it
and writes a file whenever enough tokens have come together. A file is written under a name of its own and moved to its place when whole;
its content follows from the range, so a task that runs again puts the same file there.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalens.llm.common import batched, ship_with_tasks, stored

ship_with_tasks(__name__)

MAGIC = b"WVMX0001"
#: Tokens of a shard, about (a document is never split), and documents of a range, about.
SHARD_TOKENS, RANGE_DOCUMENTS = 2_000_000, 16_000
#: Pieces of text a task remembers the ids of; bounds memory, not results.
REMEMBERED = 600_000
_SAMPLE = 512
#: Where a word tokenizer of the given kind always cuts: between an ASCII letter or digit and one of these marks.
_SEAM = re.compile(rb"([a-z0-9])([.,;:!?])")
#: Words of the letters a to z and U+00DF to U+00FF, and the characters by which a byte-level model knows bytes: themselves where
#: visible, else the next ones from U+0100.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
_BYTES = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}


class WaveletMatrix:
    """A sequence of whole numbers below 2^width as bit planes with rank support."""

    def __init__(self, n: int, words: list[np.ndarray], zeros: np.ndarray, before: list[np.ndarray] | None = None):
        self.n, self.words, self.zeros = n, words, zeros
        self.before = before or [self._before(w) for w in words]

    @staticmethod
    def _before(words: np.ndarray) -> np.ndarray:
        ones = np.bitwise_count(words).astype(np.int64)
        total = np.concatenate(([0], np.cumsum(ones)))
        return total[:len(words) + 1:_SAMPLE // 64].astype("<u4")

    @classmethod
    def build(cls, ids: np.ndarray, width: int | None = None) -> WaveletMatrix:
        x = np.asarray(ids).astype(np.uint32)
        width = int(x.max(initial=0)).bit_length() if width is None else width
        planes, zeros = [], []
        if width <= 16:
            x = x.astype(np.uint16)
        for shift in range(width - 1, -1, -1):
            ones = (x & x.dtype.type(1 << shift)) != 0
            bits = np.packbits(ones, bitorder="little")
            planes.append(np.concatenate((bits, np.zeros(-len(bits) % 8, np.uint8))).view("<u8"))
            low = x[~ones]
            zeros.append(len(low))
            x = np.concatenate((low, x[ones]))
        return cls(len(x), planes, np.array(zeros, "<i8"))

    def _ones(self, plane: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each place."""
        words, word = self.words[plane], at >> 6
        first = (at // _SAMPLE) * (_SAMPLE // 64)
        out = self.before[plane][at // _SAMPLE].astype(np.int64)
        if len(words):
            for step in range(_SAMPLE // 64):
                here = np.minimum(first + step, len(words) - 1)
                mask = np.where(first + step < word, np.uint64(0xFFFFFFFFFFFFFFFF), np.where(
                    first + step == word, (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1), np.uint64(0)))
                out += np.bitwise_count(words[here] & mask)
        return out

    def _bit(self, plane: int, at: np.ndarray) -> np.ndarray:
        return (self.words[plane][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)

    def access(self, places) -> np.ndarray:
        """The ids at places below n."""
        at = np.asarray(places, np.int64)
        out = np.zeros(len(at), np.int64)
        for plane in range(len(self.words)):
            bit, ones = self._bit(plane, at), self._ones(plane, at)
            out = out << 1 | bit
            at = np.where(bit == 1, self.zeros[plane] + ones, at - ones)
        return out

    def rank(self, ids, places) -> np.ndarray:
        """How often each id occurs before each place (at most n)."""
        ids, high = np.broadcast_arrays(np.asarray(ids, np.int64), np.asarray(places, np.int64))
        low, width = np.zeros(len(high), np.int64), len(self.words)
        for plane in range(width):
            bit = ids >> (width - 1 - plane) & 1
            ones_low, ones_high = self._ones(plane, low), self._ones(plane, high)
            low = np.where(bit == 1, self.zeros[plane] + ones_low, low - ones_low)
            high = np.where(bit == 1, self.zeros[plane] + ones_high, high - ones_high)
        return np.where(ids >> width == 0, high - low, 0)

    def _select_bit(self, plane: int, bit: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The place of the k-th (from 0) bit of the given kind in a plane, by halving over ranks."""
        low, high = np.zeros(len(k), np.int64), np.full(len(k), self.n, np.int64)
        while (low < high).any():
            middle = (low + high) // 2
            ones = self._ones(plane, middle + 1)
            enough = np.where(bit == 1, ones, middle + 1 - ones) > k
            low, high = np.where((low < high) & ~enough, middle + 1, low), np.where((low < high) & enough, middle, high)
        return low

    def select(self, ids, ks) -> np.ndarray:
        """The place of the k-th occurrence (from 0) of each id; -1 where there are fewer."""
        ids, ks = np.broadcast_arrays(np.asarray(ids, np.int64), np.asarray(ks, np.int64))
        width, starts = len(self.words), []
        enough = (ks >= 0) & (self.rank(ids, np.full(len(ids), self.n)) > ks)
        ids, k = ids[enough], ks[enough]
        low = np.zeros(len(ids), np.int64)
        for plane in range(width):
            bit, ones = ids >> (width - 1 - plane) & 1, self._ones(plane, low)
            low = np.where(bit == 1, self.zeros[plane] + ones, low - ones)
            starts.append(low)
        at = (starts[-1] if starts else low) + k
        for plane in range(width - 1, -1, -1):
            bit = ids >> (width - 1 - plane) & 1
            at = self._select_bit(plane, bit, np.where(bit == 1, at - self.zeros[plane], at))
        out = np.full(len(enough), -1, np.int64)
        out[enough] = at
        return out

    def occurrences(self, id_: int) -> np.ndarray:
        """All places of an id, in order."""
        n = int(self.rank([id_], [self.n])[0])
        return self.select(np.full(n, id_), np.arange(n))

    def ids(self) -> np.ndarray:
        """The whole sequence: each plane's dealing undone, the lowest first."""
        width = len(self.words)
        out = np.zeros(self.n, np.uint16 if width <= 16 else np.uint32)
        for plane in range(width - 1, -1, -1):
            ones = np.unpackbits(self.words[plane].view(np.uint8), bitorder="little", count=self.n).view(bool)
            zeros, whole = int(self.zeros[plane]), np.empty_like(out)
            whole[~ones] = out[:zeros]
            whole[ones] = out[zeros:] | out.dtype.type(1 << (width - 1 - plane))
            out = whole
        return out


def to_bytes(matrix: WaveletMatrix, doc_ids: list[int | None], sizes: np.ndarray) -> bytes:
    """The content of a shard's file."""
    import pyarrow as pa

    raw = [np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], np.uint8),
           np.asarray(sizes).astype("<u4"), matrix.zeros.astype("<i8")]
    for words, before in zip(matrix.words, matrix.before):
        raw += [words.astype("<u8"), before.astype("<u4")]
    raw = [r.tobytes() for r in raw]
    codec = pa.Codec("zstd")
    packed = [codec.compress(r, asbytes=True) if r else b"" for r in raw]
    lengths = np.array([(len(r), len(p)) for r, p in zip(raw, packed)], "<u8").tobytes()
    return b"".join((MAGIC, struct.pack("<QI", matrix.n, len(raw)), lengths, *packed))


def from_bytes(data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """The matrix, document ids and tokens per document of a shard's file."""
    import pyarrow as pa

    if data[:8] != MAGIC:
        raise ValueError("not a token shard")
    n, sections = struct.unpack_from("<QI", data, 8)
    lengths = np.frombuffer(data, "<u8", 2 * sections, 20).reshape(-1, 2).tolist()
    codec, at, raw = pa.Codec("zstd"), 20 + 16 * sections, []
    for size, packed in lengths:
        raw.append(codec.decompress(data[at:at + packed], size, asbytes=True) if size else b"")
        at += packed
    ids, null = np.frombuffer(raw[0], "<i8").tolist(), np.frombuffer(raw[1], np.uint8).tolist()
    matrix = WaveletMatrix(n, [np.frombuffer(r, "<u8") for r in raw[4::2]], np.frombuffer(raw[3], "<i8"),
                           [np.frombuffer(r, "<u4") for r in raw[5::2]])
    return matrix, [None if z else i for i, z in zip(ids, null)], np.frombuffer(raw[2], "<u4").astype(np.int64)


class Pieces(dict):
    """Ids of pieces of text between blanks, as little-endian 32-bit bytes; what is missing is encoded when it is asked for."""

    def __init__(self, tokenizer):
        self.tokenizer, self.model = tokenizer, tokenizer.model

    def __missing__(self, piece: bytes) -> bytes:
        if _LETTERS(piece):
            # Normalising and cutting leave small Latin-1 letters as they are; the model takes every byte as one character.
            ids = array("I", [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(_BYTES))]).tobytes()
        elif len(cut := _SEAM.sub(rb"\1 \2", piece).split()) > 1:
            ids = b"".join(map(self.__getitem__, cut))
        else:
            ids = array("I", self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids).tobytes()
        self[piece] = ids
        return ids


class Encoder:
    """Ids of whole texts by a tokenizers file, as little-endian 32-bit bytes.

    The tokenizer lower-cases, drops white space and never joins across it, nor across a seam of an ASCII letter or digit and
    a punctuation mark; so a text's ids are those of its blank-separated, seam-cut pieces in order, and the library encodes each
    piece once as long as it is remembered. Texts that may hold the name of a special token go to the library whole.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.special = re.compile(b"|".join(re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()))
        self.pieces = Pieces(self.tokenizer)

    def encode(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        if self.special.search(text):
            return array("I", self.tokenizer.encode(text.decode(), add_special_tokens=False).ids).tobytes()
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        return b"".join(map(self.pieces.__getitem__, text.lower().split()))


def _put(folder: str, name: str, data: bytes) -> str:
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    own = f"{root}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(data)
    system.move(own, f"{root}/{name}")
    return f"{folder}/{name}"


def _get(file: str) -> bytes:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(file)
    with system.open_input_stream(path) as source:
        return source.read()


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode docs (doc_id, text), append end_id to each, and write shard files in ascending doc_id order below `folder`, an absolute
    path or address that driver and executors share. Returns the stored manifest: file, base (ids in all files before), tokens, documents.

    A null or empty text is the end id alone. Null doc_ids come last; rows of one doc_id follow by text, so repeated rows are all there.
    An empty table writes no file. Texts are encoded whole, a long one makes its file longer. Other columns of docs may have any name.
    """
    import pyarrow as pa

    schema = "part long, number long, file string, tokens long, documents long"
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, encoder = TaskContext.get().partitionId(), 0, Encoder(tokenizer)
        ids: list[int | None] = []
        codes: list[bytes] = []
        held = 0

        def flush():
            flat = np.frombuffer(b"".join(codes), "<u4")
            sizes = np.array([len(c) // 4 for c in codes])
            file = _put(folder, f"part-{part:06d}-{number:06d}.wvm", to_bytes(WaveletMatrix.build(flat), ids, sizes))
            values = [part, number, file, len(flat), len(ids)]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)],
                                              ["part", "number", "file", "tokens", "documents"])

        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids.append(doc_id)
                codes.append(encoder.encode(text) + end)
                held += len(codes[-1]) // 4
                if held >= shard_tokens:
                    yield flush()
                    ids, codes, held, number = [], [], 0, number + 1
        if ids:
            yield flush()

    batched(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    ranges = max(1, -(-docs.count() // RANGE_DOCUMENTS))
    order = F.col("doc_id").asc_nulls_last()
    dealt = docs.repartitionByRange(ranges, order, F.xxhash64("text")).sortWithinPartitions(order, F.xxhash64("text"), "text")
    made = stored(dealt.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, schema), "shards")
    # One row per range, then the few files of a range.
    parts = made.groupBy("part").agg(F.sum("tokens").alias("_all"))
    before = parts.select("part", (F.sum("_all").over(Window.orderBy("part")) - F.col("_all")).alias("_before"))
    inside = F.sum("tokens").over(Window.partitionBy("part").orderBy("number")) - F.col("tokens")
    return stored(made.withColumn("_inside", inside).join(before, "part").select(
        "file", (F.col("_before") + F.col("_inside")).alias("base"), "tokens", "documents"), "shard-manifest")


def _over_files(manifest: DataFrame, schema: str, read) -> DataFrame:
    """Rows that read(matrix, doc ids, starts within the file, base, file) yields, one file at a time."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                matrix, ids, sizes = from_bytes(_get(file))
                yield from read(matrix, ids, np.concatenate(([0], np.cumsum(sizes))), base)

    files = max(1, manifest.count())
    return manifest.select("file", "base").repartitionByRange(files, "base").mapInArrow(run, schema)


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (little-endian 32-bit) of every document, from the files."""
    import pyarrow as pa

    def read(matrix, ids, starts, base):
        flat = matrix.ids().astype("<u4")
        for at in range(0, len(ids), 500):
            rows = range(at, min(at + 500, len(ids)))
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[i] for i in rows], pa.int64()), pa.array([base + int(starts[i]) for i in rows], pa.int64()),
                pa.array([int(starts[i + 1] - starts[i]) for i in rows], pa.int64()),
                pa.array([flat[starts[i]:starts[i + 1]].tobytes() for i in rows], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return _over_files(manifest, "doc_id long, start long, n_tokens long, ids binary", read)


def document_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files; ids do not leave the task."""
    import pyarrow as pa

    def read(matrix, ids, starts, base):
        flat = matrix.ids().astype("<u4")
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
        yield pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array(base + starts[:-1], pa.int64()), pa.array(np.diff(starts), pa.int64()),
            pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _over_files(manifest, "doc_id long, start long, n_tokens long, ids_crc32 long", read)


def count_ids(manifest: DataFrame, ids: list[int]) -> DataFrame:
    """id, n: how often each of the given ids occurs in all files, by rank; repeated ids count once."""
    import pyarrow as pa

    wanted = sorted(set(ids))

    def read(matrix, _, __, ___):
        n = matrix.rank(np.array(wanted), np.full(len(wanted), matrix.n))
        yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array(n, pa.int64())], ["id", "n"])

    return _over_files(manifest, "id long, n long", read).groupBy("id").agg(F.sum("n").alias("n"))


def find_ids(manifest: DataFrame, ids: list[int]) -> DataFrame:
    """id, doc_id, start of the document, offset: every occurrence of the given ids, by select."""
    import pyarrow as pa

    wanted = sorted(set(ids))

    def read(matrix, docs, starts, base):
        for id_ in wanted:
            at = matrix.occurrences(id_)
            doc = np.searchsorted(starts, at, "right") - 1
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(at), id_), pa.int64()), pa.array([docs[i] for i in doc.tolist()], pa.int64()),
                pa.array(base + starts[doc], pa.int64()), pa.array(at - starts[doc], pa.int64())], ["id", "doc_id", "start", "offset"])

    return _over_files(manifest, "id long, doc_id long, start long, offset long", read)


def ids_at(manifest: DataFrame, places: DataFrame) -> DataFrame:
    """place, id: the ids at places (a column `place`) of the whole sequence, by access; places outside it are left out."""
    import pyarrow as pa

    def run(files: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        for file, base in zip(files["file"].to_pylist(), files["base"].to_pylist()):
            matrix, _, _ = from_bytes(_get(file))
            at = asked["place"].to_numpy()
            at = at[(at >= base) & (at < base + matrix.n)]
            out.append(pa.table({"place": pa.array(at, pa.int64()), "id": pa.array(matrix.access(at - base), pa.int64())}))
        return pa.concat_tables(out) if out else pa.table({"place": pa.array([], pa.int64()), "id": pa.array([], pa.int64())})

    # Slots of equal width bring places to the files that may hold them.
    slot = F.floor(F.col("place") / F.lit(SHARD_TOKENS))
    slots = F.sequence(F.floor(F.col("base") / F.lit(SHARD_TOKENS)), F.floor((F.col("base") + F.col("tokens") - 1) / F.lit(SHARD_TOKENS)))
    files = manifest.select("file", "base", F.explode(slots).alias("slot")).dropDuplicates(["file", "slot"])
    return files.groupBy("slot").cogroup(places.filter("place >= 0").select("place", slot.alias("slot")).groupBy("slot")).applyInArrow(
        run, "place long, id long")
