"""Phrase collocations: exact counts of frequent word n-grams in counting quotient filters, then scores in DataFrames.

1. Documents become blocks of word codes (one list of distinct words per block). Words are counted over all blocks; the
   frequent ones of each language get numbers. No phrase holds an infrequent word, as it occurs at most as often.
2. Level by level, n = 2 to 5: a frequent n-gram is two frequent (n-1)-grams that overlap in all but one word. The pair of their
   numbers is the packed n-gram; unfolding it level by level gives back its word numbers. A block counts its n-grams in a
   quotient filter, cut into ranges of the permuted numbers; the filters of a range are merged over all blocks, and what
   reaches the threshold is frequent. The numbers of the frequent n-grams go back to the blocks that hold them.
3. Levels are joined to phrases with the counts of all their beginnings and ends. Cuts, scores, the rule for phrases inside
   others and the first phrases of each language are DataFrame expressions.

A block sends each n-gram once however often it occurs, and ranges of permuted numbers are even, so a very frequent phrase
weighs no more than others. Blocks and ranges have a bounded size. Frequent words or n-grams are sent to the tasks while they
are at most SENT, as counted; beyond that they are joined to the blocks that hold them. Both ways give the same numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from catalens.llm import quotient_filter
from catalens.llm.common import batched, ship_with_tasks, stored

ship_with_tasks(__name__)

#: Tokens of a block, about (a longer document is a block of its own), and entries of a range, about.
BLOCK_TOKENS, RANGE_ENTRIES = 2_000_000, 2_000_000
#: Most frequent words or n-grams of one length that are sent to the tasks (some 20 bytes a word, 8 an n-gram).
SENT = 1_000_000
#: Rows whose dense numbers are given in one task, about.
NUMBERED_ROWS = 500_000
#: Pieces end at these; inside pieces words end at blanks and tabs. A byte no UTF-8 text holds marks the end of a piece.
_BREAKS, _BREAK = b".,;:!?\n\v\f\r", b"\xff"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _BREAKS, b"abcdefghijklmnopqrstuvwxyz" + _BREAK * len(_BREAKS))


def words_and_breaks(text: bytes | None) -> list[bytes]:
    """The lower-cased words of a text, with _BREAK between pieces."""
    return text.translate(_TABLE).replace(_BREAK, b" \xff ").split() if text else []


def _blocks(docs: DataFrame) -> DataFrame:
    """Rows of blocks (block, tokens, codes: words in order, -1 between pieces; langs and words: the words by code, as lists)
    and of their words (lang, word, n)."""
    import pyarrow as pa

    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("codes", T.BinaryType()),
        T.StructField("langs", T.ArrayType(T.StringType())), T.StructField("words", T.ArrayType(T.ArrayType(T.BinaryType()))),
        T.StructField("own", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("lang", T.StringType()), T.StructField("word", T.BinaryType()),
        T.StructField("n", T.LongType())])
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.list_(pa.binary())),
             pa.list_(pa.list_(pa.int32())), pa.string(), pa.binary(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made, tokens, size = TaskContext.get().partitionId() << 24, 0, 0, 0
        codes: dict[str, dict[bytes, int]] = {}
        texts: list[np.ndarray] = []

        def flush():
            block, flat = base + made, np.concatenate(texts)
            n = np.bincount(flat[flat >= 0], minlength=size).tolist()
            yield pa.RecordBatch.from_arrays([
                pa.array([block], pa.int64()), pa.array([sum(n)], pa.int64()), pa.array([flat.tobytes()], pa.binary()),
                pa.array([list(codes)], kinds[3]), pa.array([[list(known) for known in codes.values()]], kinds[4]),
                pa.array([[list(known.values()) for known in codes.values()]], kinds[5]), *(pa.nulls(1, k) for k in kinds[6:])], schema.names)
            for lang, known in codes.items():
                words, own = list(known), list(known.values())
                for at in range(0, len(words), 20_000):
                    part = slice(at, at + 20_000)
                    some = len(words[part])
                    yield pa.RecordBatch.from_arrays([
                        *(pa.nulls(some, k) for k in kinds[:6]), pa.array([lang] * some, pa.string()), pa.array(words[part], pa.binary()),
                        pa.array([n[c] for c in own[part]], pa.int64())], schema.names)

        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_and_breaks(text)
                known = codes.setdefault(lang, {})
                for w in set(words).difference(known):
                    if w != _BREAK:
                        known[w] = size
                        size += 1
                known[_BREAK] = -1
                texts.append(np.fromiter((*map(known.__getitem__, words), -1), np.int32, len(words) + 1))
                del known[_BREAK]
                tokens += len(words)
                if tokens >= BLOCK_TOKENS:
                    yield from flush()
                    codes, texts, tokens, size, made = {}, [], 0, 0, made + 1
        if tokens:
            yield from flush()

    batched(docs.sparkSession)
    return docs.select(F.coalesce("lang", F.lit("und")), F.col("text").cast("binary")).mapInArrow(run, schema)


def _numbered(df: DataFrame, key: list[str], number: str) -> DataFrame:
    """Numbers from 1 without gaps, in an order that only the rows decide."""
    shares = max(1, -(-df.count() // NUMBERED_ROWS))
    dealt = df.withColumn("_share", F.pmod(F.xxhash64(*key), F.lit(shares)))
    sizes = dealt.groupBy("_share").agg(F.count(F.lit(1)).alias("_size"))
    # One row per share of half a million rows.
    before = sizes.select("_share", (F.sum("_size").over(Window.orderBy("_share")) - F.col("_size")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_share").orderBy(*key))
    return dealt.withColumn("_n", inside).join(before, "_share").withColumn(number, F.col("_before") + F.col("_n")).drop(
        "_share", "_n", "_before")


def _squeezed(ids: np.ndarray) -> np.ndarray:
    """The numbers without what cannot take part in a pair: one 0 between stretches, none at the ends, no stretch of one."""
    held = ids > 0
    beside = np.zeros(len(ids), bool)
    beside[1:] |= held[:-1]
    beside[:-1] |= held[1:]
    held &= beside
    gap = ~held
    gap[1:] &= held[:-1]  # the first place after a stretch
    gap[:1] = False
    return np.where(held, ids, 0)[held | gap]


def _pairs(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of neighbours without a 0, and the pairs, packed and permuted."""
    at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    packed = (ids[at].astype(np.uint64) << np.uint64(bits)) | ids[at + 1].astype(np.uint64)
    return at, quotient_filter.permute(packed, 2 * bits)


def _word_sequences(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """(block, ids) from block codes and known (of_block, code, id)."""
    import pyarrow as pa

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for block, codes in zip(left["block"].to_pylist(), left["codes"].to_pylist()):
            codes = np.frombuffer(codes, np.int32)
            ids = np.zeros(int(codes.max(initial=0)) + 2, np.uint32)  # the last place serves code -1
            if right.num_rows:
                ids[right["code"].to_numpy()] = right["id"].to_numpy()
            rows.append((block, _squeezed(ids[codes]).tobytes()))
        rows = [r for r in rows if r[1]]
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "ids": pa.array([r[1] for r in rows], pa.binary())})

    return blocks.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(run, "block long, ids binary")


def _sent_words(blocks: DataFrame, frequent: DataFrame) -> DataFrame:
    """(block, ids) from block codes, with the numbers of the frequent words sent to the tasks."""
    import pyarrow as pa

    numbers: dict[str, dict[bytes, int]] = {}
    for lang, word, id_ in zip(*(c.to_pylist() for c in frequent.select("lang", "word", "id").toArrow().columns)):
        numbers.setdefault(lang, {})[word] = id_
    sent = blocks.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, codes, langs, words, own = (c[row] for c in batch.columns)
                codes, sizes = np.frombuffer(codes.as_buffer(), np.int32), [len(w) for w in words]
                ids = np.zeros(sum(sizes) + 1, np.uint32)  # the last place serves code -1
                for lang, known, places in zip(langs.as_py(), words, own):
                    frequent = sent.value.get(lang, {})
                    ids[places.values.to_numpy()] = [frequent.get(w, 0) for w in known.values.to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int64()), pa.array([_squeezed(ids[codes]).tobytes()], pa.binary())], ["block", "ids"])

    return blocks.select("block", "codes", "langs", "words", "own").mapInArrow(run, "block long, ids binary")


def _sent_pairs(blocks: DataFrame, frequent: DataFrame, bits: int) -> DataFrame:
    """(block, ids) of the next level, with the frequent pairs sent to the tasks in the order of their numbers."""
    import pyarrow as pa

    rows = sorted((r["range"], bytes(r["keys"])) for r in frequent.select("range", "keys").collect())
    sent = blocks.sparkSession.sparkContext.broadcast(np.frombuffer(b"".join(r[1] for r in rows), np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = sent.value
        numbers = np.arange(1, len(keys) + 1)
        for batch in batches:
            for block, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = _squeezed(_renumbered(np.frombuffer(ids, np.uint32), bits, keys, numbers))
                if len(out):
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([out.tobytes()], pa.binary())], ["block", "ids"])

    return blocks.select("block", "ids").mapInArrow(run, "block long, ids binary")


def _renumbered(ids: np.ndarray, bits: int, keys: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """At each place the number of the frequent pair that begins there, or 0; keys are sorted."""
    at, pairs = _pairs(ids, bits)
    out = np.zeros(len(ids), np.uint32)
    if len(keys):
        to = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
        out[at] = np.where(keys[to] == pairs, numbers[to], 0)
    return out


def _filters(blocks: DataFrame, bits: int, range_bits: int) -> DataFrame:
    """(range, block, filter): the pairs of each block, cut by the upper bits of the permuted numbers."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, counts = np.unique(_pairs(np.frombuffer(ids, np.uint32), bits)[1], return_counts=True)
                low = 2 * bits - range_bits
                upper = (keys >> np.uint64(low)).astype(np.int64)
                ranges, first = np.unique(upper, return_index=True)
                keys = keys & np.uint64((1 << low) - 1)
                edges = [*first.tolist(), len(keys)]
                made = [quotient_filter.build(keys[a:b], counts[a:b], low) for a, b in zip(edges, edges[1:])]
                for at in range(0, len(made), 256):
                    some = made[at:at + 256]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ranges[at:at + 256], pa.int64()), pa.array([block] * len(some), pa.int64()),
                        pa.array(some, pa.binary())], ["range", "block", "filter"])

    return blocks.select("block", "ids").mapInArrow(run, "range long, block long, filter binary")


def _merged(filters: DataFrame, least: int, low: int, back: bool) -> DataFrame:
    """Per range one row without block (keys, counts) of its frequent pairs, and, if `back`, one per block (keys, places)."""
    import pyarrow as pa

    def run(group: pa.Table) -> pa.Table:
        parts = group["filter"].to_pylist()
        keys, counts = quotient_filter.merge(parts)
        keys, counts = keys[counts >= least], counts[counts >= least]
        range_ = group["range"][0].as_py()
        top = np.uint64(range_ << low)
        rows = [(range_, None, len(keys), (keys | top).tobytes(), counts.astype(np.int64).tobytes())] if len(keys) else []
        for block, part in zip(group["block"].to_pylist(), parts) if back and len(keys) else ():
            own = quotient_filter.entries(part)[0]
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            held = keys[at] == own
            if held.any():
                rows.append((range_, block, int(held.sum()), (own[held] | top).tobytes(), at[held].astype(np.int64).tobytes()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        columns = [[r[i] for r in rows] for i in range(5)]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("range", "block", "size", "keys", "numbers"), columns, kinds)})

    return filters.groupBy("range").applyInArrow(run, "range long, block long, size long, keys binary, numbers binary")


def _unfolded(frequent: DataFrame, bits: int) -> DataFrame:
    """(id, left_id, right_id, f) of frequent pairs; frequent: before, keys, numbers."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                pairs = quotient_filter.restore(np.frombuffer(keys, np.uint64), 2 * bits)
                ids = before + 1 + np.arange(len(pairs))
                columns = [ids, pairs >> np.uint64(bits), pairs & np.uint64((1 << bits) - 1), np.frombuffer(counts, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["id", "left_id", "right_id", "f"])

    return frequent.select("before", "keys", "numbers").mapInArrow(run, "id long, left_id long, right_id long, f long")


def _next_sequences(blocks: DataFrame, held: DataFrame, bits: int) -> DataFrame:
    """(block, ids) of the next level; held: block, range, before, keys, numbers of the frequent pairs a block has."""
    import pyarrow as pa

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = sorted(zip(*(right[c].to_pylist() for c in ("range", "before", "keys", "numbers"))))
        keys = np.concatenate([np.frombuffer(p[2], np.uint64) for p in parts] or [np.empty(0, np.uint64)])
        numbers = np.concatenate([np.frombuffer(p[3], np.int64) + p[1] + 1 for p in parts] or [np.empty(0, np.int64)])
        rows = []
        for block, ids in zip(left["block"].to_pylist(), left["ids"].to_pylist()):
            out = _squeezed(_renumbered(np.frombuffer(ids, np.uint32), bits, keys, numbers))
            if len(out):
                rows.append((block, out.tobytes()))
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "ids": pa.array([r[1] for r in rows], pa.binary())})

    return blocks.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(run, "block long, ids binary")


def _phrases(level: DataFrame, shorter: DataFrame) -> DataFrame:
    """Phrases (id, lang, words, f, heads, tails, left_id, right_id, left_f, right_f) from those one word shorter.

    heads: counts of the phrase's beginnings by length from 1; tails: counts of its ends by length from the longest.
    """
    one = shorter.select(F.col("id").alias("left_id"), "lang", F.col("words").alias("_lw"), F.col("heads").alias("_heads"),
                         F.col("f").alias("left_f"))
    other = shorter.select(F.col("id").alias("right_id"), F.col("words").alias("_rw"), F.col("tails").alias("_tails"),
                           F.col("f").alias("right_f"))
    both = level.join(one, "left_id").join(other, "right_id")
    return both.select(
        "id", "lang", F.concat("_lw", F.slice("_rw", -1, 1)).alias("words"), "f",
        F.concat("_heads", F.array("left_f")).alias("heads"), F.concat(F.array("right_f"), "_tails").alias("tails"),
        "left_id", "right_id", "left_f", "right_f")


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """Words and phrases found at least `least` times in a language, and the number of words of each language.

    The first frame has level, id, lang, words, f, heads, tails, left_id, right_id, left_f, right_f (see `_phrases`); the
    second lang, n. A null lang counts as `und`, a null text as empty; repeated rows count as often as they are there; an
    empty table gives empty frames. Other columns of docs may have any name. Texts of any length are read whole.
    """
    blocks = stored(_blocks(docs), "phrase-blocks")
    words = blocks.filter("word is not null").select("lang", "word", "n")
    sums = stored(words.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-langs")
    frequent = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    frequent = stored(frequent, "phrase-counts")
    frequent = stored(_numbered(frequent, ["lang", "word"], "id"), "phrase-words")
    whole = blocks.filter("codes is not null")
    ids = frequent.count()
    if ids <= SENT:
        sequences = _sent_words(whole, frequent)
    else:
        known = whole.select("block", F.inline(F.arrays_zip("langs", "words", "own"))).select(
            "block", F.col("langs").alias("lang"), F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("own").alias("code")))).join(frequent.select("lang", "word", "id"), ["lang", "word"])
        sequences = _word_sequences(whole.select("block", "codes"), known.select(F.col("block").alias("of_block"), "code", "id"))
    size = whole.agg(F.sum("tokens")).head()[0] or 0
    range_bits = max(0, (size // RANGE_ENTRIES).bit_length())
    none = F.array().cast("array<bigint>")
    level = frequent.select(
        F.lit(1).alias("level"), "id", "lang", F.array(F.col("word").cast("string")).alias("words"), "f", none.alias("heads"),
        none.alias("tails"), *[F.lit(None).cast("long").alias(c) for c in ("left_id", "right_id", "left_f", "right_f")])
    levels = [level]
    for n in range(2, longest + 1):
        if not ids:
            break
        sequences = stored(sequences, f"phrase-ids-{n}")
        bits = ids.bit_length()
        if bits > 32:
            raise ValueError("more than 2^32 frequent phrases of one length; raise the threshold")
        cut = min(range_bits, 2 * bits)
        low = 2 * bits - cut
        filters = _filters(sequences, bits, cut)
        merged = stored(_merged(filters, least, low, False), f"phrase-merged-{n}")
        sizes = merged.select("range", "size")
        # One row per range of two million entries.
        before = sizes.select("range", (F.sum("size").over(Window.orderBy("range")) - F.col("size")).alias("before"))
        before = stored(before, f"phrase-before-{n}")
        pairs = stored(_unfolded(merged.join(before, "range"), bits), f"phrase-pairs-{n}")
        level = stored(_phrases(pairs, levels[-1]), f"phrases-{n}").withColumn("level", F.lit(n))
        levels.append(level)
        ids = merged.agg(F.sum("size")).head()[0] or 0
        if n < longest and ids <= SENT:
            sequences = _sent_pairs(sequences, merged, bits)
        elif n < longest:
            held = stored(_merged(filters, least, low, True).filter("block is not null"), f"phrase-held-{n}")
            sequences = _next_sequences(sequences, held.join(before, "range"), bits)
    phrases = levels[0]
    for level in levels[1:]:
        phrases = phrases.unionByName(level)
    return phrases, sums


def _cut(heads: Column, tails: Column, a: Column, n: Column) -> Column:
    """The lowest score over all cuts, the first of equal ones, as struct (score, k, l, r)."""
    exact = lambda c: c.cast("decimal(20,0)")
    return F.array_min(F.transform(F.arrays_zip(heads.alias("l"), tails.alias("r")), lambda z, k: F.struct(
        F.call_function("div", F.lit(1000).cast("decimal(4,0)") * exact(a) * exact(n), exact(z["l"]) * exact(z["r"])).alias("score"),
        k.alias("k"), z["l"].alias("l"), z["r"].alias("r"))))


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Phrases of 2 to `longest` words found a >= least times; the score floor(1000 a n / (l r)) is that of the lowest-scoring cut
    into two parts found l and r times (the first such cut). A phrase inside a longer one that is found as often is left out:
    counts only fall as phrases grow, so looking one word further is enough. Order: score and a downwards, phrase by bytes.
    Nulls, empty texts, repeated rows and empty tables as in `frequent_phrases`.
    """
    phrases, sums = frequent_phrases(docs, least, longest)
    found = phrases.filter("level > 1")
    inside = found.filter("level > 2").select(
        (F.col("level") - 1).alias("level"),
        F.explode(F.array(F.when(F.col("f") == F.col("left_f"), F.col("left_id")),
                          F.when(F.col("f") == F.col("right_f"), F.col("right_id")))).alias("id")).filter("id is not null")
    kept = found.join(inside, ["level", "id"], "left_anti").join(sums, "lang")
    scored = kept.withColumn("cut", _cut(F.col("heads"), F.col("tails"), F.col("f"), F.col("n"))).select(
        "lang", F.concat_ws(" ", "words").alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
