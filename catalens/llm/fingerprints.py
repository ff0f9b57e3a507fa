"""Document fingerprints as invertible Bloom lookup sketches of paragraphs (DataFrame functions only).

A text's paragraphs (pieces of lines of a few words, cut where the text itself says so: see paragraph_keys) are hashed to keys;
a repeated paragraph counts once. A sketch of m cells adds every key to one cell in each third of the table; a cell holds how many
keys it got, their exclusive or, and that of their check hashes. Sketches of two versions subtract cell by cell; what is
left holds the differing paragraphs only, and peeling recovers their keys: a cell with one key gives it away, and taking
it out of its other cells frees more. A text is sketched once, for its fingerprint and for every comparison. If peeling gets
stuck, both versions are sketched again at twice the size.

A sketch is kept as the array of its non-empty cells in order, so its size in memory follows the paragraphs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalens.llm.common import stored

#: Most characters of a paragraph piece, and least before a cut within a line.
PIECE, LEAST_PIECE = 300, 16
#: Where a line is cut: after punctuation, and after words of certain last letters, about one of five.
CUT = r"[.!?;:,…؟،।][\"')\]»”’]*[ \t]+|[。！？；，、]|[dtyDTYйяςν][ \t]+"
#: Least cells of a sketch, three times a power of two.
LEAST_CELLS = 12
#: Least cells of a third for each paragraph of a text. Two texts that share nothing then fill a sketch so far that peeling mostly ends.
SPARE = 2
#: Peeling rounds; each takes out all cells of one key, so few are ever needed.
ROUNDS = 24
#: Rows of one range of document ids, about, and most ranges cut by quantiles.
RANGE_ROWS, QUANTILES = 1500, 1000

_CELLS = "array<struct<cell:int,n:int,key:bigint,check:bigint>>"


def paragraph_keys(text: Column) -> Column:
    """Distinct 64-bit keys of the paragraphs of a text; none for null and empty texts.

    A piece ends at the first CUT after LEAST_PIECE characters, at the line's end, or after PIECE characters without a cut. Cuts
    follow the characters around them, so after an insertion pieces soon end at the same places again.
    """
    pieces = F.regexp_extract_all(text, F.lit(f"[^\n]{{{LEAST_PIECE},{PIECE - 1}}}?(?:{CUT})|[^\n]{{1,{PIECE}}}"), F.lit(0))
    return F.coalesce(F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p))), F.array().cast("array<bigint>"))


def _entries(keys: Column, sign: Column, third: Column) -> Column:
    """The cell entries of keys, three of each: the key, its check hash and one more hash tell the cells."""
    def of_key(key: Column) -> Column:
        return _with(F.xxhash64(key, F.lit(3)), lambda check: F.array(*[F.struct(
            (F.pmod(h, third) + F.lit(s) * third).cast("int").alias("cell"), sign.cast("int").alias("n"), key.alias("key"),
            check.alias("check")) for s, h in enumerate((key, check, F.xxhash64(key, F.lit(5))))]))

    return F.flatten(F.transform(keys, of_key))


def _with(value: Column, use) -> Column:
    """use(value), with the value computed once. The end of an aggregation over nothing: unlike transform it copies no result."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda same, _: same, use)


def _summed(entries: Column) -> Column:
    """Entries in order of cells, those of a cell added up, without cells that came to nothing.

    What is sorted are long numbers that hold cell and place of an entry. The entries of a cell then stand together and are
    added up, so the work follows the number of entries.
    """
    place_bits = 31
    mask = F.lit((1 << place_bits) - 1)

    def at(given: Column, mark: Column) -> Column:
        return F.get(given, mark.bitwiseAND(mask).cast("int"))

    def add(x: Column, y: Column) -> Column:
        return F.struct(x["cell"].alias("cell"), (x["n"] + y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"),
                        x["check"].bitwiseXOR(y["check"]).alias("check"))

    def run(given: Column, order: Column, ends: Column):
        def one(end: Column, i: Column) -> Column:
            before = F.coalesce(F.get(ends, i - 1), F.lit(-1))
            last = at(given, F.get(order, end))
            return F.when(end - before == 1, last).otherwise(F.aggregate(
                F.slice(order, before + 2, end - before - 1), last, lambda total, mark: _with(at(given, mark), lambda e: add(total, e))))
        return one

    def ends_of(order: Column) -> Column:
        def last_of_cell(i: Column) -> Column:
            return F.coalesce(F.shiftright(F.get(order, i), place_bits) != F.shiftright(F.get(order, i + 1), place_bits), F.lit(True))
        return F.filter(F.sequence(F.lit(0), F.size(order) - 1), last_of_cell)

    def totals(given: Column) -> Column:
        marks = F.transform(given, lambda e, i: F.shiftleft(e["cell"].cast("long"), place_bits).bitwiseOR(i.cast("long")))
        return F.when(F.size(given) == 0, given).otherwise(_with(F.sort_array(marks), lambda order: _with(
            ends_of(order), lambda ends: F.transform(ends, run(given, order, ends)))))

    return F.filter(_with(entries, totals), lambda c: (c["n"] != 0) | (c["key"] != 0) | (c["check"] != 0))


def _third(cells: Column) -> Column:
    return (cells / 3).cast("int")


def sketch(keys: Column, cells: Column) -> Column:
    """Sketch of a key set: its non-empty cells."""
    return _sketch(keys, _third(cells))


def _sketch(keys: Column, third: Column) -> Column:
    # The size is read for every entry: callers give a stored column or a variable, so it is computed once for each text.
    return _summed(_entries(keys, F.lit(1), third))


def subtract(left: Column, right: Column) -> Column:
    """Cell-wise difference of two sketches of one size."""
    taken = F.transform(right, lambda c: F.struct(c["cell"].alias("cell"), (-c["n"]).alias("n"), c["key"].alias("key"),
                                                  c["check"].alias("check")))
    return _summed(F.concat(left, taken))


def peel(difference: Column, cells: Column) -> Column:
    """struct(left: cells that stay stuck, found: array of struct(n, key)); n is 1 for keys of the left side, else -1."""
    return _peel(difference, _third(cells))


def _peel(difference: Column, third: Column, finish=None) -> Column:
    """peel of a sketch with so many cells in a third; finish is applied to the result."""

    def alone(left: Column, n: int) -> Column:
        """Keys of the cells that hold one key, of one side."""
        cells_of_one = F.filter(left, lambda c: (c["n"] == n) & (F.xxhash64(c["key"], F.lit(3)) == c["check"]))
        return F.array_distinct(F.transform(cells_of_one, lambda c: c["key"]))

    def signed_keys(keys: Column, n: int) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(n).alias("n"), k.alias("key")))

    def take_out(state: Column, keys: Column) -> Column:
        signed = [signed_keys(keys["ours"], 1), signed_keys(keys["theirs"], -1)]
        rest = F.concat(state["left"], _entries(keys["ours"], F.lit(-1), third), _entries(keys["theirs"], F.lit(1), third))
        return F.when(F.size(keys["ours"]) + F.size(keys["theirs"]) == 0, state).otherwise(
            F.struct(_summed(rest).alias("left"), F.concat(state["found"], *signed).alias("found")))

    def one_round(state: Column, _: Column) -> Column:
        keys = F.struct(alone(state["left"], 1).alias("ours"), alone(state["left"], -1).alias("theirs"))
        return F.when(F.size(state["left"]) == 0, state).otherwise(_with(keys, lambda ks: take_out(state, ks)))

    empty = F.array().cast("array<struct<n:int,key:bigint>>")
    start = F.struct(difference.alias("left"), empty.alias("found"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one_round, finish)


def own_third(keys: Column) -> Column:
    """Cells in a third of a text's own sketch: by its number of paragraphs alone, so equal texts have equal fingerprints.

    A power of two, so texts of like length mostly have sketches of one size.
    """
    bits = F.length(F.bin(F.greatest(F.lit(LEAST_CELLS // 3), F.size(keys) * SPARE) - 1))
    return F.pow(F.lit(2.0), bits).cast("int")


def fingerprint(own: Column, third: Column) -> Column:
    """Digest of a text's own sketch and of its size, in hexadecimal."""
    return F.sha2(F.concat_ws(":", third.cast("string"), own.cast("string")).cast("binary"), 256)


def differing_keys(left: Column, right: Column, left_sketch: Column | None = None, right_sketch: Column | None = None) -> Column:
    """Number of paragraphs in one text only, found by subtracting and peeling sketches, larger ones on failure; -1 if none do.

    Sketches of the texts' own sizes may be given; the smaller one is made again at the size of the larger one. A failure
    doubles the size, three times at most.
    """
    thirds = F.transform(F.array(*[F.lit(1 << i) for i in range(4)]), lambda f: f * F.greatest(own_third(left), own_third(right)))

    def made(keys: Column, given: Column | None, third: Column) -> Column:
        fresh = _sketch(keys, third)
        return fresh if given is None else F.when(third == own_third(keys), given).otherwise(fresh)

    def attempt(found: Column, third: Column) -> Column:
        difference = subtract(made(left, left_sketch, third), made(right, right_sketch, third))
        return F.when(found >= 0, found).otherwise(_peel(
            difference, third, lambda p: F.when(F.size(p["left"]) == 0, F.size(p["found"])).otherwise(F.lit(-1))))

    return F.when(left == right, F.lit(0)).otherwise(F.aggregate(thirds, F.lit(-1), attempt))


def likeness(left: Column, right: Column, differing: Column) -> Column:
    """1 - differing / (paragraphs of both); 1 for two texts without paragraphs. Sets differ by count if peeling failed."""
    together = F.size(left) + F.size(right)
    exact = F.size(F.array_except(left, right)) + F.size(F.array_except(right, left))
    d = F.when(differing >= 0, differing).otherwise(exact)
    return F.when(together == 0, F.lit(1.0)).otherwise(F.lit(1.0) - d / together)


def with_next(docs: DataFrame, columns: list[str], made: dict[str, Column] | None = None, arrived: list[dict[str, Column]] | None = None) -> DataFrame:
    """docs (doc_id, text and columns) with next_<column> of the document of next smaller doc_id; the last one's next is the first.

    made: further columns, computed once for every row of a range; columns may name them. arrived: the same, one dictionary after the
    other, but computed once the rows are in their ranges, so that they do not cross the network.

    Rows of one doc_id follow each other by text; rows without doc_id come last. Texts cross the network once: the ids
    are cut into ranges at quantiles, each range is ordered by itself, and the first row of a range is copied to the end of
    the range before.
    """
    stats = docs.agg(F.count("*").alias("n"), F.percentile_approx("doc_id", [i / QUANTILES for i in range(1, QUANTILES)], 20_000)
                     .alias("q"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    ranges = int(max(1, min(QUANTILES, -(-stats["n"] // RANGE_ROWS))))
    cuts = sorted(set((stats["q"] or [])[QUANTILES // ranges - 1::max(1, QUANTILES // ranges)])) if ranges > 1 else []
    # Each range is cut further into equal steps of ids where there are more rows than QUANTILES ranges can hold.
    steps = int(max(1, -(-stats["n"] // (RANGE_ROWS * QUANTILES))))
    edges = [stats["lo"] or 0, *cuts, (stats["hi"] or 0) + 1]
    bits = max(1, len(edges).bit_length())
    table = F.lit([int(x) for x in edges])

    def lower(at: Column, b: Column) -> Column:
        step = F.pow(F.lit(2.0), b).cast("int")
        return F.when((at + step < len(edges) - 1) & (F.get(table, at + step) <= F.col("doc_id")), at + step).otherwise(at)

    at = F.aggregate(F.sequence(F.lit(bits), F.lit(0), F.lit(-1)), F.lit(0), lower)
    low, high = F.get(table, F.col("_at")), F.get(table, F.col("_at") + 1)
    inside = F.floor((F.col("doc_id") - low) / F.greatest(high - low, F.lit(1)) * steps).cast("long")
    ranged = (docs.withColumn("_at", at).withColumn("_h", F.xxhash64("text"))
              .withColumn("_range", F.when(F.col("doc_id").isNull(), -1 - F.pmod("_h", F.lit(64)))
                          .otherwise(F.col("_at").cast("long") * steps + inside)).drop("_at"))
    order = [F.desc_nulls_last("doc_id"), F.desc("_h"), F.desc_nulls_last("text")]
    # First row of every range: by the greatest id, then among the rows of that id.
    tops = ranged.groupBy("_range").agg(F.max("doc_id").alias("_top"))
    before = (tops.withColumn("_to", F.lag("_range").over(Window.orderBy(F.desc("_range"))))
              .withColumn("_to", F.coalesce("_to", F.min("_range").over(Window.partitionBy()))))
    # A row per RANGE_ROWS documents: stored, so that the planner broadcasts it only while it is small.
    before = stored(before.withColumnRenamed("_range", "_r"), "range-tops")
    joined = ranged.join(before, (F.col("_range") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_top")))
    first = (joined.withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy(*order))).filter("_n = 1")
             .withColumn("_range", F.col("_to")).select(*ranged.columns).withColumn("_copy", F.lit(1)))
    rows = ranged.withColumn("_copy", F.lit(0)).union(first).withColumns(made or {})
    if arrived:
        rows = rows.repartition("_range")
        for more in arrived:
            rows = rows.withColumns(more)
    along = Window.partitionBy("_range").orderBy("_copy", *order)
    return (rows.select("*", *[F.lead(c).over(along).alias(f"next_{c}") for c in columns]).filter("_copy = 0")
            .drop("_copy", "_range", "_h"))


def fingerprint_versions(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness to each other and to the next document.

    The edited text replaces the last floor(n_chars / 2) code points by the first as many of the next document. Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_paragraphs, differing_edited
    and differing_next (paragraphs recovered). Null texts count as empty ones.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(texts, ["text", "keys", "keys_sketch"], {"keys": paragraph_keys(F.col("text"))}, [
        {"keys_third": own_third(F.col("keys"))}, {"keys_sketch": _sketch(F.col("keys"), F.col("keys_third"))}])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", 1, F.col("n_chars").cast("int") - half), F.substring("next_text", 1, half))
    staged = (pairs.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", edited)
              .withColumn("edited_keys", paragraph_keys(F.col("edited")))
              .withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
              .drop("text", "next_text", "edited"))
    sized = staged.withColumn("edited_keys_third", own_third(F.col("edited_keys")))
    sketched = sized.withColumn("edited_keys_sketch", _sketch(F.col("edited_keys"), F.col("edited_keys_third")))
    rated = sketched.withColumns({f"differing_{name}": differing_keys(*[F.col(c) for c in ("keys", k, "keys_sketch", own)])
                                  for name, k, own in (("edited", "edited_keys", "edited_keys_sketch"), ("next", "next_keys", "next_keys_sketch"))})
    return rated.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("keys_sketch"), F.col("keys_third")).alias("fingerprint"),
        fingerprint(F.col("edited_keys_sketch"), F.col("edited_keys_third")).alias("edited_fingerprint"),
        likeness(F.col("keys"), F.col("edited_keys"), F.col("differing_edited")).alias("near_edited"),
        likeness(F.col("keys"), F.col("next_keys"), F.col("differing_next")).alias("near_next"),
        F.size("keys").alias("n_paragraphs"), "differing_edited", "differing_next")
