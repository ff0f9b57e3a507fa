"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Two models, one of toxic and one of ordinary text, give every letter of a word a probability after the letters before
it (up to ORDER - 1, from the word's start mark on). Where the counts of the longest context tell the classes apart, a class
has a discounted probability of its own; all other letters of that context share the rest of the class's probability as in the counts of
both classes together, which back off to one Kneser-Ney model of continuation counts, again of both. So after every context the
probabilities of a class add up to one, an expression too rare to tell the classes apart gets like probabilities from both, and the
many words that mean nothing for toxicity add no noise. Working on letters lets inflected and new forms of a toxic stem count
as much as the stem. A word counts once for each document that holds it; grams of a single document count as all others do.

A document's evidence is the toxic minus the ordinary log-likelihood over the number of predicted letters. A logistic
curve fitted on labelled rows held back from the counts turns it into a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens.llm.common import batched, ship_with_tasks, stored

ship_with_tasks(__name__)

#: Letters of a gram: up to five of context and the predicted one.
ORDER = 6
#: Most labelled rows of each class that a model is fitted on, the first in hash order.
CLASS_ROWS = 6000
#: One of FOLD labelled rows is kept from the counts and calibrates the score.
FOLD = 4
DISCOUNT = 0.75
#: Weight of the shared probability in a class's own besides what the discount frees, in counts.
STRENGTH = 1.0
#: A class has a probability of its own where its count is this many standard deviations off what is shared.
DEVIATIONS = 4.5
#: Pull of the calibration's slope towards zero; small, as classes that lie far apart need a steep curve.
RIDGE = 1e-7
#: Word scores a task remembers before it starts afresh; bounds memory, not results.
REMEMBERED = 150_000
#: Words are runs of letters, of which Python counts numeral letters and superscripts too; the same in Spark's terms.
LETTERS = re.compile(r"[^\W\d_]+")
EVEN = (0.0, 0.0)
SPARK_LETTERS = r"([\p{L}\p{Nl}\p{No}]+)"


@dataclass
class ToxicityModel:
    """grams: log-probability of seen grams in both classes; own: (toxic, ordinary) where they differ; rest: what the other
    letters after such a context are scaled by, (toxic, ordinary); back: of leaving a context for the shared model; shared: lower
    orders. All natural logarithms."""

    grams: dict[str, float]
    own: dict[str, tuple[float, float]]
    rest: dict[str, tuple[float, float]]
    back: dict[str, float]
    shared: dict[str, float]
    shared_back: dict[str, float]
    floor: float
    slope: float = 1.0
    offset: float = 0.0
    seen: dict[str, tuple[float, float]] = field(default_factory=dict, repr=False)

    def letter(self, gram: str) -> float:
        """Log-probability of the last letter of a gram after the others, in the shared model."""
        known = self.shared.get(gram)
        if known is not None:
            return known
        if len(gram) == 1:
            return self.floor
        return self.shared_back.get(gram[:-1], 0.0) + self.letter(gram[1:])

    def word(self, word: str) -> tuple[float, float]:
        """Toxic and ordinary log-likelihood of a word's letters and its end mark."""
        marked, toxic, ordinary = f"<{word}>", 0.0, 0.0
        for end in range(2, len(marked) + 1):
            gram = marked[max(0, end - ORDER):end]
            own = self.own.get(gram)
            if own is not None:
                toxic += own[0]
                ordinary += own[1]
                continue
            both = self.grams.get(gram)
            if both is None:
                both = self.back.get(gram[:-1], 0.0) + self.letter(gram[1:])
            rest = self.rest.get(gram[:-1], EVEN)
            toxic += both + rest[0]
            ordinary += both + rest[1]
        return (toxic, toxic) if toxic == ordinary else (toxic, ordinary)

    def document(self, text: str | None) -> tuple[float, float, int]:
        """Sums over all words of the whole text."""
        words = LETTERS.findall(text.lower()) if text else []
        seen = self.seen
        if len(seen) > REMEMBERED:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = self.word(w)
        toxic, ordinary, letters = 0.0, 0.0, 0
        for w in words:
            a, b = seen[w]
            toxic += a
            ordinary += b
            letters += len(w) + 1
        return toxic, ordinary, letters

    def score(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, self.slope * evidence + self.offset))))


def fit(rows: DataFrame) -> ToxicityModel:
    """Fit the model on rows (doc_id, text, label); label 1 is toxic. Without rows of both classes every score is 0.5.

    Counts, continuation counts and masses of contexts are made in Spark over all grams of the bounded sample; the driver
    sees one row per distinct gram of it.
    """
    held = F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id")), F.lit(FOLD)) == 0
    words = (rows.filter(~held).select("label", F.explode(
        F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(SPARK_LETTERS)))).alias("w"))
             .groupBy("label", "w").agg(F.count("*").alias("n")))
    model = _smooth(*gram_tables(words))
    points = sorted((r["x"], r["label"]) for r in evidence_of(rows.filter(held), model, ["label"]).select(
        (F.col("toxic_ll") - F.col("ordinary_ll")).alias("d"), "letters", "label")
        .withColumn("x", F.col("d") / F.greatest("letters", F.lit(1))).collect())
    model.slope, model.offset = _logistic(points)
    return model


def gram_tables(words: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Tables of words (label, w, n): grams (gram, n1, n0); their contexts (ctx, n1, n0, k, k1, k0: counts and distinct
    letters, of both and of each class); continuations (gram, n: distinct left neighbours of every shorter gram); and
    the contexts of these (ctx, n, k)."""
    marked = words.select("label", "n", F.concat(F.lit("<"), "w", F.lit(">")).alias("w"))
    gram = F.transform(F.sequence(F.lit(2), F.length("w")), lambda e: F.expr("w").substr(
        F.greatest(F.lit(1), e - (ORDER - 1)), F.least(F.lit(ORDER), e)))
    grams = stored(marked.select("n", "label", F.explode(gram).alias("gram")).groupBy("gram").agg(
        *[F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (1, 0)]), "toxic-grams")
    ctx = F.expr("substr(gram, 1, length(gram) - 1)").alias("ctx")
    contexts = grams.groupBy(ctx).agg(
        F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.count("*").alias("k"), F.count_if(F.col("n1") > 0).alias("k1"),
        F.count_if(F.col("n0") > 0).alias("k0"))
    ends = F.transform(F.sequence(F.lit(2), F.length("gram")), lambda size: F.expr("gram").substr(F.length("gram") - size + 1, size))
    continuations = stored(grams.select(F.explode(ends).alias("end")).distinct().groupBy(
        F.expr("substr(end, 2)").alias("gram")).agg(F.count("*").alias("n")), "toxic-continuations")
    lower = continuations.filter(F.length("gram") > 1).groupBy(ctx).agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    return grams, contexts, continuations, lower


def _rows(table: DataFrame) -> Iterator[tuple]:
    for batch in table.toArrow().to_batches(max_chunksize=50_000):
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _smooth(grams: DataFrame, contexts: DataFrame, continuations: DataFrame, lower: DataFrame) -> ToxicityModel:
    """Log-probabilities from the tables of gram_tables."""
    of_size: list[list[tuple[str, int]]] = [[] for _ in range(ORDER)]
    for gram, n in _rows(continuations):
        of_size[len(gram)].append((gram, n))
    letters, total = len(of_size[1]) + 1, sum(n for _, n in of_size[1])
    floor = 1.0 / (total + letters)
    probability = {g: (n + 1.0) / (total + letters) for g, n in of_size[1]}
    below = {ctx: (n, k) for ctx, n, k in _rows(lower)}
    for size in range(2, ORDER):
        for gram, n in of_size[size]:
            mass, kinds = below[gram[:-1]]
            probability[gram] = (n - DISCOUNT + DISCOUNT * kinds * probability[gram[1:]]) / mass
        of_size[size].clear()
    model = ToxicityModel({}, {}, {}, {}, {g: math.log(p) for g, p in probability.items()},
                          {ctx: math.log(DISCOUNT * k / n) for ctx, (n, k) in below.items()}, math.log(floor))
    del probability, below, of_size
    after = {ctx: counts for ctx, *counts in _rows(contexts)}
    model.back.update({ctx: math.log(DISCOUNT * k / (n1 + n0)) for ctx, (n1, n0, k, _, _) in after.items()})
    taken: dict[str, list[float]] = {}
    for gram, *pair in _rows(grams):
        n1, n0, k, *kinds = after[gram[:-1]]
        both = (sum(pair) - DISCOUNT + DISCOUNT * k * math.exp(model.letter(gram[1:]))) / (n1 + n0)
        own = [(max(seen - DISCOUNT, 0.0) + (STRENGTH + DISCOUNT * kind) * both) / (n + STRENGTH)
               for seen, kind, n in zip(pair, kinds, (n1, n0))]
        model.grams[gram] = math.log(both)
        if _departs(pair, (n1, n0), own):
            model.own[gram] = math.log(own[0]), math.log(own[1])
            sums = taken.setdefault(gram[:-1], [0.0, 0.0, 0.0])
            for i, p in enumerate((*own, both)):
                sums[i] += p
    # A class's probabilities after a context add up to one over all letters, so what is left is above zero.
    model.rest.update({ctx: tuple(math.log(max(1.0 - s, 1e-12) / max(1.0 - both, 1e-12)) for s in own)
                       for ctx, (*own, both) in taken.items()})
    return model


def _departs(pair: list[int], n: tuple[int, int], own: list[float]) -> bool:
    """Whether the classes differ in a letter after its context: by a factor of two, and not by chance."""
    share = sum(pair) / sum(n)
    spread = n[0] * share * (n[1] / sum(n)) * (1.0 - share)
    return (abs(math.log(own[0] / own[1])) >= math.log(2.0) and spread > 0
            and abs(pair[0] - n[0] * share) - 0.5 >= DEVIATIONS * math.sqrt(spread))


def _logistic(points: list[tuple[float, int]]) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (evidence, label): Newton's method, both classes of equal weight."""
    n = [sum(1 for _, y in points if y == c) for c in (0, 1)]
    if not all(n):
        return 0.0, 0.0
    scale = max(1e-9, max(abs(x) for x, _ in points))
    a, b = 0.0, 0.0
    for _ in range(50):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for x, y in points:
            z, w = x / scale, 0.5 / n[y]
            p = 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, a * z + b))))
            v = w * max(p * (1 - p), 1e-6)
            g0 += w * (p - y)
            g1 += w * (p - y) * z
            h00 += v
            h01 += v * z
            h11 += v * z * z
        g1, g0, h11, h00 = g1 + RIDGE * a, g0, h11 + RIDGE, h00 + 1e-9
        det = h00 * h11 - h01 * h01
        if det <= 0:
            break
        da, db = (h00 * g1 - h01 * g0) / det, (h11 * g0 - h01 * g1) / det
        step = min(1.0, 8.0 / max(abs(da), abs(db), 1e-12))
        a, b = a - step * da, b - step * db
        if max(abs(da), abs(db)) < 1e-9:
            break
    return a / scale, b


def evidence_of(docs: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """keep columns and toxic_ll, ordinary_ll (natural logarithms), letters of every whole text."""
    import pyarrow as pa

    spark = batched(docs.sparkSession)
    shipped = spark.sparkContext.broadcast(
        (model.grams, model.own, model.rest, model.back, model.shared, model.shared_back, model.floor))
    kept = docs.select(*keep).schema
    schema = T.StructType([*kept.fields, T.StructField("toxic_ll", T.DoubleType()), T.StructField("ordinary_ll", T.DoubleType()),
                           T.StructField("letters", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = ToxicityModel(*shipped.value)
        for batch in batches:
            sums = [m.document(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            columns = [pa.array([s[i] for s in sums], kind) for i, kind in enumerate((pa.float64(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [f.name for f in schema.fields])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def score_documents(docs: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """keep columns, toxic_ll, ordinary_ll, letters, evidence and score (0 to 1, higher: more likely toxic).

    Null texts and texts without letters have evidence 0 and the score of that. Rows that repeat are scored each, alike;
    texts are scored whole at any length; an empty table gives an empty one.
    """
    rated = evidence_of(docs, model, keep).withColumn(
        "evidence", (F.col("toxic_ll") - F.col("ordinary_ll")) / F.greatest("letters", F.lit(1)))
    return rated.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(model.slope) * F.col("evidence") + F.lit(model.offset)))))
