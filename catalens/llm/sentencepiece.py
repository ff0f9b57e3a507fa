"""SentencePiece encoding and decoding with a given model, by a forward pass that common prefixes share.

A normalised text is cut into marked words: a run of space marks with the text up to the next space. No piece of a
vocabulary reaches from text into a following mark, so words encode on their own. The distinct words of a block of
documents are sorted, which lists the leaves of their trie in depth-first order; each word takes over the forward states
of the prefix it shares with the word before it and only computes the rest.

A unigram model's state of a prefix is its best total score and last piece (Viterbi). A BPE model's encoding is not the
segmentation of greatest score: it is what merging in order of rank leaves. But the merge encoding of a text begins with
that of each prefix ending at one of its pieces, and two pieces may follow one another exactly if merging their
concatenation gives back these two. So the state of a prefix is the last piece of its merge encoding, found from the
states of shorter prefixes, and the same traversal serves.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens.llm.common import batched, ship_with_tasks

ship_with_tasks(__name__)

SPACE = "▁"
WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Words and pairs of pieces a task remembers before it starts afresh; bounds memory, not results.
REMEMBERED = 200_000
#: Characters of documents whose distinct words are sorted together.
BLOCK_CHARS = 2_000_000
#: Loss of score for a character no piece covers, below the least piece score, as unigram models count it.
UNKNOWN_LOSS = 10.0


@dataclass(frozen=True)
class Vocabulary:
    """What a model file says: ids and scores of ordinary pieces, ids of bytes, the unknown id, the text of every id."""

    kind: str
    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: tuple[int, ...]
    unknown: int
    surface: tuple[bytes, ...]
    longest: int
    dummy_prefix: bool = True


def load_vocabulary(path: str) -> Vocabulary:
    """Read a model file on the driver; its normaliser must leave text as it is, with spaces as marks."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    norm = proto.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only models with the identity normaliser are supported")
    kinds = {pb.TrainerSpec.UNIGRAM: "unigram", pb.TrainerSpec.BPE: "bpe"}
    sp = SentencePieceProcessor(model_proto=proto.SerializeToString())
    ids, scores, byte_ids, surface = {}, {}, [-1] * 256, []
    for i, piece in enumerate(proto.pieces):
        if piece.type == pb.ModelProto.SentencePiece.BYTE:
            byte_ids[int(piece.piece[3:5], 16)] = i
            surface.append(bytes([int(piece.piece[3:5], 16)]))
        elif sp.is_control(i):
            surface.append(b"")
        elif sp.is_unknown(i):
            surface.append(proto.trainer_spec.unk_surface.encode())
        else:
            ids[piece.piece], scores[piece.piece] = i, piece.score
            surface.append(piece.piece.replace(SPACE, " ").encode())
    if any(SPACE in p.lstrip(SPACE) for p in ids):
        raise ValueError("a piece reaches over a word's end")
    return Vocabulary(kinds[proto.trainer_spec.model_type], ids, scores, tuple(byte_ids) if min(byte_ids) >= 0 else (),
                      sp.unk_id(), tuple(surface), max(map(len, ids)), norm.add_dummy_prefix)


@dataclass
class Encoder:
    """Encodes blocks of texts; words, pairs and merges are remembered caches."""

    vocabulary: Vocabulary
    words: dict[str, tuple[int, ...]] = field(default_factory=dict)
    pairs: dict[tuple[str, str], bool] = field(default_factory=dict)
    #: Lengths of the pieces that end with two given characters.
    lengths: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        by_end: dict[str, set[int]] = {}
        for piece in self.vocabulary.ids:
            if len(piece) > 1:
                by_end.setdefault(piece[-2:], set()).add(len(piece))
        self.lengths = {k: tuple(sorted(x)) for k, x in by_end.items()}
        self.lowest = min(self.vocabulary.scores.values())

    def marked(self, text: str) -> list[str]:
        if not text:
            return []
        return WORDS.findall((SPACE if self.vocabulary.dummy_prefix else "") + text.replace(" ", SPACE))

    def merged(self, text: str) -> list[str]:
        """Merge encoding by its definition: join the best-scored neighbours, leftmost first, until none can be joined."""
        parts, scores = list(text), self.vocabulary.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follow(self, left: str, right: str) -> bool:
        """Whether merging the two pieces' text gives them back; with no left piece, whether the right one stays whole."""
        if len(self.pairs) > REMEMBERED:
            self.pairs.clear()
        known = self.pairs[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def bpe_step(self, word: str, end: int, states: list) -> str:
        """Last piece of the merge encoding of word[:end]; states hold those of the shorter prefixes."""
        ids, pairs = self.vocabulary.ids, self.pairs
        for length in self.lengths.get(word[end - 2:end], ()) if end > 1 else ():
            if length <= end:
                piece = word[end - length:end]
                if piece in ids:
                    known = pairs.get((states[end - length], piece))
                    if self.follow(states[end - length], piece) if known is None else known:
                        return piece
        return word[end - 1]

    def unigram_step(self, word: str, end: int, states: list) -> tuple[float, str]:
        """Best score of word[:end] and its last piece; of equal scores the longest last piece."""
        scores, best = self.vocabulary.scores, None
        for start in range(max(0, end - self.vocabulary.longest), end):
            piece = word[start:end]
            s = scores.get(piece)
            if s is None:
                if end - start > 1:
                    continue
                s = self.lowest - UNKNOWN_LOSS
            if best is None or states[start][0] + s > best[0]:
                best = (states[start][0] + s, piece)
        return best

    def ids_of(self, pieces: list[str]) -> tuple[int, ...]:
        v, out = self.vocabulary, []
        try:
            return tuple([v.ids[p] for p in pieces])
        except KeyError:
            pass
        for p in pieces:
            i = v.ids.get(p)
            if i is not None:
                out.append(i)
            elif v.byte_ids:
                out += [v.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != v.unknown:
                out.append(v.unknown)
        return tuple(out)

    def traverse(self, words: set[str]) -> None:
        """Encode words in sorted order, reusing the forward states of the prefix shared with the word before."""
        bpe = self.vocabulary.kind == "bpe"
        step: Callable = self.bpe_step if bpe else self.unigram_step
        states, before = ["" if bpe else (0.0, "")], ""
        for word in sorted(words):
            same, most = 0, min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            del states[same + 1:]
            for end in range(same + 1, len(word) + 1):
                states.append(step(word, end, states))
            pieces, end = [], len(word)
            while end:
                piece = states[end] if bpe else states[end][1]
                pieces.append(piece)
                end -= len(piece)
            self.words[word], before = self.ids_of(pieces[::-1]), word

    def encode(self, texts: list[str | None]) -> list[list[int] | None]:
        """Ids of every whole text; null stays null, an empty text has none."""
        out, block, chars = [], [], 0
        for text in texts:
            block.append(None if text is None else self.marked(text))
            chars += len(text or "")
            if chars > BLOCK_CHARS:
                out += self._block(block)
                block, chars = [], 0
        return out + self._block(block)

    def _block(self, block: list[list[str] | None]) -> list[list[int] | None]:
        if len(self.words) > REMEMBERED:
            self.words.clear()
        self.traverse(set().union(*filter(None, block)).difference(self.words))
        known = self.words
        return [None if words is None else [i for w in words for i in known[w]] for words in block]


def decode_ids(vocabulary: Vocabulary, ids: list[int] | None) -> str | None:
    """Text of a sequence of ids; broken byte sequences become replacement characters."""
    if ids is None:
        return None
    surface = vocabulary.surface
    text = b"".join([surface[i] for i in ids])
    if vocabulary.dummy_prefix and text[:1] == b" " and ids and surface[ids[0]][:1] == b" ":
        text = text[1:]
    return text.decode("utf-8", "replace")


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, keep: list[str], check: bool = False) -> DataFrame:
    """keep columns, ids (array of int, null for a null text) and n_tokens (0 for null); every whole text.

    check adds round_trip: whether decoding the ids gives the text back (its space marks as spaces), null for null.
    """
    import pyarrow as pa

    spark = batched(docs.sparkSession)
    shipped = spark.sparkContext.broadcast(vars(vocabulary))
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("round_trip", T.BooleanType())] * check
    schema = T.StructType([*docs.select(*keep).schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(**shipped.value))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            ids = encoder.encode(texts)
            made = [pa.array(ids, pa.list_(pa.int32())), pa.array([len(x or ()) for x in ids], pa.int64())]
            if check:
                made.append(pa.array([None if t is None else decode_ids(encoder.vocabulary, x) == t.replace(SPACE, " ")
                                      for t, x in zip(texts, ids)], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [f.name for f in schema.fields])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary, keep: list[str]) -> DataFrame:
    """keep columns and text decoded from the column ids."""
    import pyarrow as pa

    spark = batched(encoded.sparkSession)
    shipped = spark.sparkContext.broadcast(vars(vocabulary))
    schema = T.StructType([*encoded.select(*keep).schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(**shipped.value)
        for batch in batches:
            texts = pa.array([decode_ids(vocab, ids) for ids in batch.column(batch.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], [f.name for f in schema.fields])

    return encoded.select(*keep, F.col("ids").alias("_ids")).mapInArrow(run, schema)
