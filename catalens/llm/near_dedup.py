"""Near-duplicate groups: SuperMinHash banding, verification on full shingle sets, union-find grouping.

1. Every document becomes its shingle set's digest and the keys of its signature's bands. Documents of equal sets are one
   class, named by the smallest doc_id, so copies never meet in pairs.
2. Classes sharing a band key are a bucket. Each member is compared on full sets with the bucket's smallest class only;
   links found so make first components, which swallow most of a large group of near copies.
3. Buckets that still hold several components are compared block by block inside tasks: signatures pick likely pairs of
   different components, full sets confirm them, and pairs that a link found meanwhile has joined are passed over. A
   bucket of any size is covered by pairs of blocks of bounded size; what leaves a task are links of a forest only.
4. All links give the final components.

A pair of similarity 0.75 shares no band with probability (1 - 0.75^6)^60, 7.8e-6; in step 3 fewer than LIKELY of its 360 places
would have to be equal for it to be passed over, with probability 3e-8 (both for independent places).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens.llm.common import batched, ship_with_tasks, stored
from catalens.llm.graph import components, find_root, join_sets
from catalens.llm.minhash import band_keys, shingle_sets, signatures

ship_with_tasks(__name__)

#: Link where 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Least share of equal signature places for a full comparison in step 3.
LIKELY = 0.62
#: Members of a block in step 3.
BLOCK = 512


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < PERCENT * large:
        return False
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _texts(docs: DataFrame, keep: list[str], run, fields: list[T.StructField]) -> DataFrame:
    schema = T.StructType([*docs.select(*keep).schema.fields, *fields])
    batched(docs.sparkSession)
    return docs.select(*keep, F.col("text").cast("binary").alias("_text")).mapInArrow(run(schema), schema)


def shingle_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digest of the set) and bands (null for an empty set) of every document."""
    import pyarrow as pa

    def runner(schema):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import xxhash

            seen: dict[bytes, int] = {}
            for batch in batches:
                sets = shingle_sets(batch.column(1).to_pylist(), seen)
                keys = band_keys(signatures(sets))
                digests = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets]).reshape(-1, 2)
                bands = pa.array([k if len(s) else None for s, k in zip(sets, keys)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]),
                    pa.array(digests[:, 1]), bands], schema.names)
        return run

    return _texts(docs, ["doc_id"], runner, [
        T.StructField("n_shingles", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType()))])


def shingle_set_table(docs: DataFrame) -> DataFrame:
    """cid (doc_id), set (sorted hashes as bytes) and sig (low byte of each signature place)."""
    import pyarrow as pa

    def runner(schema):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[bytes, int] = {}
            for batch in batches:
                sets = shingle_sets(batch.column(1).to_pylist(), seen)
                sig = (signatures(sets) & 0xFF).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary()),
                                                  pa.array([s.tobytes() for s in sig], pa.binary())], schema.names)
        return run

    return _texts(docs.withColumnRenamed("doc_id", "cid"), ["cid"], runner,
                  [T.StructField("set", T.BinaryType()), T.StructField("sig", T.BinaryType())])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ([np.frombuffer(x, np.uint64) for x in batch.column(i).to_pylist()] for i in (2, 3))
            keep = pa.array([linked(x, y) for x, y in zip(left, right)], pa.bool_())
            yield batch.select([0, 1]).filter(keep)

    one = sets.select(F.col("cid").alias("a"), F.col("set").alias("sa"))
    other = sets.select(F.col("cid").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(one, "a").join(other, "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(run, "a long, b long")


def links_in_blocks(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components inside buckets; members: key, cid, comp, c (members of the bucket)."""
    import pyarrow as pa

    dealt = (members.withColumn("nb", F.ceil(F.col("c") / BLOCK).cast("int"))
             .withColumn("i", F.pmod(F.xxhash64("cid", "key"), F.col("nb")).cast("int"))
             .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
             .select("key", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "i", "cid", "comp"))
    full = dealt.join(sets, "cid").select("key", "p", "q", "i", "cid", "comp", "set", "sig")
    gathered = full.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "cid")

    def compare(rows: list[tuple]) -> list[tuple[int, int]]:
        found, parent = [], {}
        sets_, sigs = [np.frombuffer(r[6], np.uint64) for r in rows], np.array([np.frombuffer(r[7], np.uint8) for r in rows])
        across = rows[0][1] != rows[0][2]
        sizes, blocks = np.array([len(s) for s in sets_]), np.array([r[3] for r in rows])
        comps = np.array([r[5] for r in rows])
        for x in range(len(rows)):
            other = np.arange(x + 1, len(rows))
            other = other[comps[other] != comps[x]]
            if across:
                other = other[blocks[other] != blocks[x]]
            other = other[(100 * np.minimum(sizes[other], sizes[x]) >= PERCENT * np.maximum(sizes[other], sizes[x]))]
            if not len(other):
                continue
            for y in other[(sigs[other] == sigs[x]).mean(axis=1) >= LIKELY]:
                a, b = int(comps[x]), int(comps[y])
                if find_root(parent, a) != find_root(parent, b) and linked(sets_[x], sets_[y]):
                    join_sets(parent, a, b)
                    found.append((rows[x][4], rows[y][4]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[0][:3] != row[:3]:
                    yield out(compare(group))
                    group = []
                group.append(row)
        if group:
            yield out(compare(group))

    return gathered.mapInArrow(run, "a long, b long")


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (doc_id = component_id) of every row.

    Null and empty texts and texts without words have empty sets and are linked with nothing. Rows that repeat a doc_id
    are one document: their sets are linked. Rows without doc_id take part in no link, have no component and are kept.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    source = docs.select("doc_id", "text")
    rows = stored(shingle_rows(source), "shingle-rows")
    named = rows.filter("doc_id is not null and n_shingles > 0")
    classes = named.groupBy("d1", "d2").agg(F.min("doc_id").alias("cid"))
    banded = named.join(classes, ["d1", "d2"]).filter("doc_id = cid").select("cid", F.explode("bands").alias("key")).repartition("key")
    shared = banded.groupBy("key").agg(F.min("cid").alias("center"), F.max("cid").alias("last")).filter("center < last")
    members = stored(banded.join(shared, "key").select("key", "cid", "center").distinct(), "bucket-members")
    wanted = stored(members.select("cid").distinct(), "candidates")
    # Whatever the size of the texts, the planner may prefilter them by a bounded Bloom filter of the wanted ids; the
    # comparison on the narrow side, true of every id, lets it do so. The table is written here, so the setting goes back.
    least = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(least)
    spark.conf.set(least, "0")
    texts = source.join(wanted.filter(F.col("cid") >= F.lit(-(1 << 63))).withColumnRenamed("cid", "doc_id"), "doc_id")
    try:
        sets = stored(shingle_set_table(texts).distinct(), "candidate-sets")
    finally:
        spark.conf.set(least, before)
    first = stored(confirmed(members.filter("cid <> center").select(F.col("center").alias("a"), F.col("cid").alias("b")).distinct(),
                             sets), "star-links")
    # The sets of a doc_id that several classes hold belong together.
    held = named.select("doc_id", "d1", "d2").join(classes, ["d1", "d2"]).select("doc_id", "cid")
    several = held.groupBy("doc_id").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).filter("lo < hi")
    first = first.union(held.join(several, "doc_id").select("lo", "cid").filter("lo <> cid"))
    placed = components(first, "star-components")
    located = (members.join(placed, members["cid"] == placed["node"], "left")
               .select("key", "cid", F.coalesce("component", "cid").alias("comp")))
    located = stored(located, "located")
    open_ = (located.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"),
                                        F.bit_xor(F.xxhash64("cid")).alias("x"), F.sum(F.col("cid").cast("decimal(38,0)")).alias("s"))
             .filter("lo < hi").groupBy("c", "x", "s").agg(F.min("key").alias("key")).select("key", "c"))
    second = links_in_blocks(located.join(open_, "key"), sets)
    final = components(first.union(second), "duplicate-components")
    linked_ids = stored(final, "document-components")
    by_class = classes.join(linked_ids, classes["cid"] == linked_ids["node"], "left").select(
        "d1", "d2", F.coalesce("component", "cid").alias("component_id"))
    per_doc = rows.filter("doc_id is not null").join(by_class, ["d1", "d2"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    rest = rows.filter("doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return per_doc.union(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
