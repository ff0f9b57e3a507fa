"""Language-model scoring: word counts of the whole corpus and a gated recurrent network on top of them.

1. Documents are read once, in blocks: a block holds its distinct words with their training counts, and its documents as
   sequences of places in that list. A word crosses the network once per block, not once per occurrence.
2. Counts are summed over all blocks by word. The most frequent words and the mass of the tail classes set up the
   network as the unigram model of the counts; it is trained on a bounded sample first, then every partition of the corpus
   trains a copy on all of its training documents and the copies' weights are averaged.
3. Every block gets the counts of its words back and scores its documents whole, window by window with the state carried.

A tail word's probability is that of its class after the state, times its smoothed share of the class's training tokens;
words never seen share one such place in their class. Together with the frequent words that is a distribution over the
training words plus unknown ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from catalens.llm import gru
from catalens.llm.common import batched, lower_words, ship_with_tasks, split_words, stored, word_bytes

ship_with_tasks(__name__)

#: Least frequent words of the network, the end of a text included. All words counted sqrt(training tokens) / ROOT_SHARE
#: times take part besides, so the words grow with the input and the weights stay far smaller than the corpus.
FREQUENT, ROOT_SHARE = 1024, 10
#: Tokens of a block, about; a longer document is a block of its own.
BLOCK_TOKENS = 4_000_000
#: Documents of the bounded first training, the first in hash order.
WARM_DOCUMENTS = 400
#: Tokens a copy of the network is trained on at a time, and texts side by side.
TRAIN_TOKENS, TRAIN_LANES = 400_000, 256
#: Copies of the network, unless there are more cores; a copy goes through several partitions then.
COPIES = 64
#: Bytes of weights averaged by one task, and by the driver.
AVERAGED_BYTES = 64_000_000


def _blocks(docs: DataFrame) -> DataFrame:
    """Rows of documents (block, doc_id, held_out, codes) and of words (block, code, word, k, n) of every block."""
    import pyarrow as pa

    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()),
        T.StructField("codes", T.BinaryType()), T.StructField("code", T.IntegerType()), T.StructField("word", T.BinaryType()),
        T.StructField("k", T.IntegerType()), T.StructField("n", T.LongType())])
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.int64()]
    batched(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 24, 0
        parts: list[pa.Array] = []
        rows: list[tuple] = []
        tokens = 0

        def flush():
            coded = pa.chunked_array(parts, pa.binary()).dictionary_encode()
            words = coded.chunk(coded.num_chunks - 1).dictionary if coded.num_chunks else pa.array([], pa.binary())
            codes = np.concatenate([c.indices.to_numpy() for c in coded.chunks] or [np.empty(0, np.int32)])
            ends = np.cumsum([0, *(r[2] for r in rows)])
            learnt = np.repeat([not r[1] for r in rows], np.diff(ends))
            n = np.bincount(codes[learnt], minlength=len(words))
            places = [codes[lo:hi].tobytes() for lo, hi in zip(ends, ends[1:])]
            yield from batches_of([[base + made] * len(rows), [r[0] for r in rows], [r[1] for r in rows], places, *[[None] * len(rows)] * 4])
            none = [None] * len(words)
            yield from batches_of([np.full(len(words), base + made), none, none, none, np.arange(len(words), dtype=np.int32), words,
                                   gru.tail_classes(*word_bytes(words)).astype(np.int32), n])

        def batches_of(columns):
            whole = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds)], schema.names)
            for at in range(0, whole.num_rows, 20_000):
                yield whole.slice(at, 20_000)

        for batch in batches:
            # A block ends with the first row that fills it.
            words, sizes = split_words(batch.column(2))
            lo = start = 0
            for i, (doc_id, held) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                rows.append((doc_id, held, int(sizes[i])))
                tokens, lo = tokens + int(sizes[i]) + 1, lo + int(sizes[i])
                if tokens >= BLOCK_TOKENS:
                    parts.append(words.slice(start, lo - start))
                    yield from flush()
                    parts.clear()
                    rows.clear()
                    tokens, made, start = 0, made + 1, lo
            parts.append(words.slice(start))
        if rows:
            yield from flush()

    return docs.mapInArrow(run, schema)


def _symbols(words: list[bytes], frequent: dict[bytes, int], size: int, seen: dict[bytes, int]) -> np.ndarray:
    """Symbols of a text, the end symbol 0 last; size: number of frequent words."""
    for w in set(words).difference(seen):
        seen[w] = frequent[w] if w in frequent else size + gru.tail_class(w)
    return np.fromiter((*map(seen.__getitem__, words), 0), np.int64, len(words) + 1)


def _text_symbols(column, known, size: int) -> list[np.ndarray]:
    """_symbols of each text of an Arrow binary column; known: the frequent words in order, as an Arrow array."""
    import pyarrow.compute as pc

    words, sizes = split_words(column)
    found = pc.index_in(words, value_set=known)
    edges, letters = word_bytes(words)
    symbols = np.where(found.is_null().to_numpy(zero_copy_only=False), size + gru.tail_classes(edges, letters),
                       found.fill_null(-1).to_numpy().astype(np.int64) + 1)
    ends = np.cumsum(sizes + 1)
    out = np.zeros(len(symbols) + len(sizes), np.int64)
    out[np.arange(len(symbols)) + np.repeat(np.arange(len(sizes)), sizes)] = symbols
    return np.split(out, ends[:-1]) if len(ends) else []


def _trained(docs: DataFrame, weights: dict, frequent: dict[bytes, int], passes: int, rate: float) -> DataFrame:
    """A row (tokens, moved) per partition of docs (text): how far training on the partition's texts moved the weights."""
    import pyarrow as pa

    shipped = docs.sparkSession.sparkContext.broadcast((gru.packed(weights), {k: v.shape for k, v in weights.items()}, frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, shapes, frequent = shipped.value
        p = gru.unpacked(flat, {k: np.empty(s, np.float32) for k, s in shapes.items()})
        tokens, texts, pending, known = 0, [], 0, pa.array(sorted(frequent, key=frequent.get), pa.binary())
        for batch in batches:
            for text in _text_symbols(batch.column(0), known, len(known) + 1):
                texts.append(text)
                pending += len(text)
                if pending >= TRAIN_TOKENS:
                    p, tokens, texts, pending = gru.train(p, texts, passes, rate, TRAIN_LANES), tokens + pending, [], 0
        p, tokens = gru.train(p, texts, passes, rate, TRAIN_LANES), tokens + pending
        if tokens:
            moved = (gru.packed(p) - flat).astype(np.float16).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([moved], pa.binary())], ["tokens", "moved"])

    copies = docs.select(F.col("text").cast("binary")).coalesce(max(COPIES, docs.sparkSession.sparkContext.defaultParallelism))
    return copies.mapInArrow(run, "tokens long, moved binary")


def _averaged(copies: DataFrame, start: dict) -> dict:
    """The start moved by the mean of the copies by tokens; tasks average groups of AVERAGED_BYTES until one is left."""
    import pyarrow as pa

    def mean(rows) -> tuple[int, np.ndarray]:
        total, part = 0, 0.0
        for n, w in rows:
            total, part = total + n, part + n * np.frombuffer(w, np.float16).astype(np.float64)
        return total, part / total

    def merge(group: pa.Table) -> pa.Table:
        n, w = mean(zip(group["tokens"].to_pylist(), group["moved"].to_pylist()))
        return pa.table({"tokens": pa.array([n], pa.int64()), "moved": pa.array([w.astype(np.float16).tobytes()], pa.binary())})

    flat, copies = gru.packed(start), stored(copies, "trained")
    together = max(2, AVERAGED_BYTES // (2 * len(flat)))
    while (count := copies.count()) > together:
        dealt = copies.withColumn("g", F.pmod(F.xxhash64("moved"), F.lit(-(-count // together))))
        copies = stored(dealt.groupBy("g").applyInArrow(merge, "tokens long, moved binary"), "averaged")
    rows = sorted((r["tokens"], bytes(r["moved"])) for r in copies.collect())
    return gru.unpacked((flat + mean(rows)[1]).astype(np.float32), start) if rows else start


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of every row of docs.

    Learns from the rows that are not held out. Null and empty texts are the end token alone. Without any training row
    every token is unknown and the network is that of no counts. Rows that repeat are counted and scored each.
    """
    spark = batched(docs.sparkSession)
    source = docs.select("doc_id", held_out.alias("held_out"), F.col("text").cast("binary").alias("text"))
    blocks = stored(_blocks(source), "lm-blocks")
    words = blocks.filter("code is not null").select("block", "code", "word", "k", "n")
    counts = stored(words.groupBy("word").agg(F.sum("n").alias("c"), F.first("k").alias("k")).filter("c > 0"), "lm-counts")
    ends = blocks.filter("code is null and not held_out").count()
    totals = counts.groupBy("k").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    n_all = ends + sum(r["c"] for r in totals)
    often = counts.filter(F.col("c") >= n_all ** 0.5 / ROOT_SHARE).count()
    frequent = counts.orderBy(F.desc("c"), "word").limit(max(FREQUENT - 1, often)).collect()
    mass = np.full(gru.TAILS, 0.5)
    for r in totals:
        mass[r["k"]] += r["c"] + 0.5 * r["v"]
    for r in frequent:
        mass[r["k"]] -= r["c"] + 0.5
    v_all = sum(r["v"] for r in totals) + (ends > 0)
    known = {bytes(r["word"]): i + 1 for i, r in enumerate(frequent)}
    size = len(known) + 1

    weights = gru.initial(np.array([float(ends)] + [float(r["c"]) for r in frequent]), mass)
    train = docs.filter(~held_out).filter("text is not null")
    mark = F.xxhash64(F.lit("train"), F.col("doc_id"))
    first = train.select(mark.alias("h"), "text").orderBy("h", "text").limit(WARM_DOCUMENTS)
    seen: dict[bytes, int] = {}
    warm = [_symbols(lower_words(r["text"].encode()), known, size, seen) for r in first.collect()]
    weights = gru.train(weights, warm)
    weights = _averaged(_trained(train, weights, known, 1, gru.RATE / 4), weights)

    symbol_rows = [(bytearray(w), i) for w, i in known.items()]
    symbols = spark.createDataFrame(symbol_rows, "word binary, sym int")  # a row per frequent word
    sized = counts.join(F.broadcast(symbols), "word", "left").select("word", "c", "sym")
    back = words.join(sized, "word", "left").select(
        F.col("block").alias("home"), "code", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("sym", F.col("k") + size).alias("sym"))
    texts = blocks.filter("code is null").select("block", "doc_id", "held_out", "codes")
    return _scored(texts, back, weights, mass, size, ends, n_all, v_all)


def _scored(texts: DataFrame, back: DataFrame, weights: dict, mass: np.ndarray, size: int, ends: int, n_all: int,
            v_all: int) -> DataFrame:
    """Scores of the documents of each block from the counts and symbols of its words."""
    import pyarrow as pa

    shipped = texts.sparkSession.sparkContext.broadcast((weights, mass))
    schema = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

    def score(docs: pa.Table, words: pa.Table) -> pa.Table:
        p, tail_mass = shipped.value
        codes = words["code"].to_numpy()
        c, sym = np.zeros(len(codes)), np.zeros(len(codes), np.int64)
        c[codes], sym[codes] = words["c"].to_numpy(), words["sym"].to_numpy()
        log_count = np.log10(c + 0.5)
        log_share = np.where(sym >= size, log_count - np.log10(tail_mass)[np.maximum(sym - size, 0)], 0.0)
        places = [np.frombuffer(x, np.int32) for x in docs["codes"].to_pylist()]
        tokens = np.array([len(x) + 1 for x in places])
        model = gru.log_probabilities(p, [np.append(sym[x], 0) for x in places]) / np.log(10.0)
        base = np.array([log_count[x].sum() for x in places]) + np.log10(ends + 0.5) - tokens * np.log10(n_all + 0.5 * (v_all + 1))
        return pa.table({
            "doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": tokens,
            "n_known": np.array([int((c[x] > 0).sum()) for x in places]) + int(ends > 0),
            "train_tokens": np.full(len(tokens), n_all), "base_score": base,
            "score": model + np.array([log_share[x].sum() for x in places])})

    return texts.groupBy("block").cogroup(back.groupBy("home")).applyInArrow(score, schema)
