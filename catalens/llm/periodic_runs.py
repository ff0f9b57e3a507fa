"""Periodic runs of a text's words: maximal pairs of a bottom-up LCP-interval tree with left-word class lists.

A run with period q that covers words s to e-1 repeats itself q words further on: words s to e-q-1 equal words s+q to e-1,
the words before the two copies differ, and so do the words after them. So it is the maximal pair (s, s+q) of length e-s-q,
and as a run holds its period twice, the distance q of the pair is at most its length. The other way round, a maximal pair
whose distance is at most its length is a run already, no extension needed. A run with period q also shows up with
the multiples of q that fit twice; of all pairs over the same words the smallest distance is the period.

1. The suffixes of a block of texts are ranked by prefix doubling, on those only that are not unique yet; symbols carry their
   text's number, so no group reaches from one text into another.
2. A run of `least` words is a pair of at least least/2, so only suffixes with such a neighbour go on. Their LCPs come
   from the ranks of all doubling steps.
3. The interval tree is walked bottom-up. A node holds its positions, and class lists of them by the word to their left. When a
   child joins, each position of the smaller side looks for partners of other classes within its distance on the
   larger side, by class or by position, whichever list is shorter. Each pair met this way is reported once.

Work per text is near n log n; a text is handled whole in one task, and texts of one block share one sort.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens.llm.common import batched, ship_with_tasks

ship_with_tasks(__name__)

#: Words of texts whose suffixes are sorted together; a longer text is a block of its own.
BLOCK_WORDS = 400_000

RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False)


def _ranks(symbols: np.ndarray, least: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """Ranks by the first h symbols for h = 1, 2, 4, ... until all are told apart, and the positions that share the largest
    power of two of symbols up to `least` with another one, in suffix order."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    size = np.diff(np.append(first, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, size)
    open_ = order[np.repeat(size > 1, size)]
    levels, wanted, h = [(1, rank.astype(np.int32))], open_, 1
    while len(open_):
        key = rank[open_] * n + rank[open_ + h]
        by = np.argsort(key)
        open_, key = open_[by], key[by]
        old = rank[open_]
        at = np.arange(len(open_))
        new_old = np.concatenate(([True], old[1:] != old[:-1]))
        new = np.concatenate(([True], key[1:] != key[:-1]))
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(open_)))
        # A group keeps the rank of its first member: the old rank, and how far into the old group it begins.
        into = starts - np.maximum.accumulate(np.where(new_old, at, 0))[starts]
        rank[open_] = np.repeat(old[starts] + into, size)
        open_ = open_[np.repeat(size > 1, size)]
        h *= 2
        levels.append((h, rank.astype(np.int32)))
        if h <= least:
            wanted = open_
    return levels, wanted[np.argsort(rank[wanted])]


def _lcps(levels: list[tuple[int, np.ndarray]], suffixes: np.ndarray) -> np.ndarray:
    """Words that each suffix shares with the one before it; 0 for the first."""
    a, b, last = suffixes[:-1], suffixes[1:], len(levels[0][1]) - 1
    shared = np.zeros(len(a), np.int64)
    for h, rank in reversed(levels):
        shared += h * (rank[np.minimum(a + shared, last)] == rank[np.minimum(b + shared, last)])
    return np.concatenate(([0], shared))


def _join(a: tuple, b: tuple, depth: int, left: list[int], report) -> tuple:
    """The union of two children of a node; pairs of different left words at most `depth` apart are reported."""
    if len(a[0]) < len(b[0]):
        a, b = b, a
    places, classes = a
    for word, own in b[1].items():
        for p in own:
            low, high = bisect_left(places, p - depth), bisect_right(places, p + depth)
            if high - low <= len(classes):
                for q in places[low:high]:
                    if left[q] != word:
                        report(p, q, depth)
            else:
                for other, theirs in classes.items():
                    if other != word:
                        for q in theirs[bisect_left(theirs, p - depth):bisect_right(theirs, p + depth)]:
                            report(p, q, depth)
    _insert(places, b[0])
    for word, own in b[1].items():
        if word in classes:
            _insert(classes[word], own)
        else:
            classes[word] = own
    return a


def _insert(into: list[int], more: list[int]) -> None:
    if len(more) * 16 < len(into):
        for p in more:
            insort(into, p)
    else:
        into.extend(more)
        into.sort()


def _walk(suffixes: list[int], lcps: list[int], left: list[int], least_depth: int, report) -> None:
    """Bottom-up over the intervals of depth `least_depth` and more; a step below that depth ends a tree."""
    stack: list[tuple[int, tuple]] = []
    child = None
    for place, shared in zip([*suffixes, -1], [*lcps, 0]):
        while stack and stack[-1][0] > shared:
            depth, node = stack.pop()
            child = _join(node, child, depth, left, report)
        if shared >= least_depth:
            if stack and stack[-1][0] == shared:
                stack[-1] = (shared, _join(stack[-1][1], child, shared, left, report))
            else:
                stack.append((shared, child))
        child = ([place], {left[place]: [place]})


def runs_of(texts: list[list], least: int = 12) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of at least `least` words and two periods, by start, then period, of each
    list of words."""
    codes: dict = {}
    sizes = [len(t) for t in texts]
    for t in texts:
        for w in set(t).difference(codes):
            codes[w] = len(codes)
    out: list[dict] = [{} for _ in texts]
    if sum(sizes) < 2:
        return [[] for _ in texts]
    # One more symbol per text, found nowhere else, ends it.
    starts = np.concatenate(([0], np.cumsum(np.array(sizes) + 1)))
    symbols = np.empty(starts[-1], np.int64)
    for i, t in enumerate(texts):
        symbols[starts[i]:starts[i + 1] - 1] = np.fromiter(map(codes.__getitem__, t), np.int64, len(t))
        symbols[starts[i + 1] - 1] = len(codes)
        symbols[starts[i]:starts[i + 1]] += i * (len(codes) + 1)
    depth = (least + 1) // 2
    levels, suffixes = _ranks(symbols, depth)
    if len(suffixes) < 2:
        return [[] for _ in texts]
    lcps = _lcps(levels, suffixes)
    keep = (lcps >= depth) | np.append(lcps[1:] >= depth, False)
    suffixes, lcps = suffixes[keep], np.where(lcps[keep] >= depth, lcps[keep], 0)
    # The symbol left of a text's first word is the end of the text before it, which occurs once: its own class.
    before = np.concatenate(([-1], symbols[:-1]))
    text_of = np.searchsorted(starts, suffixes, "right") - 1
    found: dict[tuple[int, int], int] = {}

    def report(p: int, q: int, shared: int) -> None:
        at, apart = (p, q - p) if p < q else (q, p - q)
        if shared + apart >= least:
            key = (at, shared + apart)
            if apart < found.get(key, apart + 1):
                found[key] = apart

    # Left words by place, for the places at hand only.
    lefts = dict(zip(suffixes.tolist(), before[suffixes].tolist()))
    lefts[-1] = -2
    _walk(suffixes.tolist(), lcps.tolist(), lefts, depth, report)
    home = dict(zip(suffixes.tolist(), text_of.tolist()))
    for (at, length), period in found.items():
        i = home[at]
        out[i][(at - int(starts[i]), period, length)] = None
    return [[(s, n, q) for s, q, n in sorted(o)] for o in out]


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words outside runs, and the first period of each run that no other run covers."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, keep: list[str], text: str = "text", least: int = 12) -> DataFrame:
    """The columns `keep`, n_words, runs (start, length, period; by start, then period) and collapsed, the text's words but those
    that a run repeats, joined by one blank.

    Words are runs of characters other than the six ASCII blanks. A null or empty text has no words, no runs and an empty
    collapsed text. Rows stand for themselves: repeated rows give repeated results, an empty table none. A column of docs
    that is not kept may have any name. Texts of any length are handled whole.
    """
    import pyarrow as pa

    extra = [T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.BinaryType())]
    schema = T.StructType([*docs.select(*keep).schema.fields, *extra])
    run_type = pa.list_(pa.struct([pa.field(c, pa.int64(), False) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [t.split() if t else [] for t in batch.column(batch.num_columns - 1).to_pylist()]
            at = 0
            while at < len(words):
                end, total = at, 0
                while end < len(words) and (end == at or total + len(words[end]) <= BLOCK_WORDS):
                    total += len(words[end])
                    end += 1
                block = words[at:end]
                runs = runs_of(block, least)
                yield pa.RecordBatch.from_arrays([
                    *batch.slice(at, end - at).columns[:-1], pa.array([len(w) for w in block], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs], run_type),
                    pa.array([b" ".join(collapse(w, r)) for w, r in zip(block, runs)], pa.binary())], schema.names)
                at = end

    batched(docs.sparkSession)
    found = docs.select(*keep, F.col(text).cast("binary").alias("_text")).mapInArrow(run, schema)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))
