"""Fingerprints, mixing, URL filters and sharding: brute force, contracts and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import date

import pytest
from pyspark.sql import functions as F

from catalens.llm import fingerprints as fp
from catalens.llm.mixing import mix, mixing_plan, source_targets
from catalens.llm.sharding import interleave, shard_documents
from catalens.llm.url_filters import filter_captures, host_of, path_of, rule_keys, validity_intervals


# fingerprints

def _keys(text):
    cut = f"[^\n]{{{fp.LEAST_PIECE},{fp.PIECE - 1}}}?(?:{fp.CUT})|[^\n]{{1,{fp.PIECE}}}"
    return {m.group(0) for m in re.finditer(cut, text)}


def test_short_and_shifted_lines_keep_their_pieces(spark, documents):
    words = "the cat went out and sat by the old road that day with a short red hat but not for long".split()
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(20)]
    got = fp.fingerprint_versions(documents(rows)).collect()
    assert all(len(t) < 300 for _, t in rows) and all(r.near_edited >= 0.2 and r.near_edited > r.near_next + 0.1 for r in got)
    line = " ".join(f"{rng.choice(words)}{k}, {rng.choice(words)}" for k in range(400))
    pair = spark.createDataFrame([(line, "inserted here " + line)], "a string, b string").select(
        fp.paragraph_keys(F.col("a")).alias("a"), fp.paragraph_keys(F.col("b")).alias("b")).first()
    assert len(set(pair.a) & set(pair.b)) > 0.9 * len(pair.a)


def test_fingerprints_against_brute_force(documents, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 7)
    rng = random.Random(1)
    lines = ["".join(rng.choice("abc é𝄞") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    lines += [" ".join(rng.choice(("red", "it", "was.", "today", "é𝄞,", "road!")) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    rows = [(i * 3, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 40)))) for i in range(40)] + [(500, None), (501, "x" * 5000)]
    text = {i: t or "" for i, t in rows}
    order = sorted(text, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    got = fp.fingerprint_versions(documents(rows).repartition(5)).collect()
    assert len(got) == len(rows)
    for r in got:
        own, nxt = text[r.doc_id], text[after[r.doc_id]]
        half = len(own) // 2
        edited = own[:len(own) - half] + nxt[:half]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for differing, near, other in ((r.differing_edited, r.near_edited, edited), (r.differing_next, r.near_next, nxt)):
            a, b = _keys(own), _keys(other)
            assert differing in (-1, len(a ^ b))
            assert near == pytest.approx(1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0)
    assert sum(r.differing_next < 0 for r in got) <= 1
    by_text = defaultdict(set)
    for r in got:
        by_text[text[r.doc_id]].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and len({min(v) for v in by_text.values()}) == len(by_text)


def test_subtracted_sketches_give_back_the_differing_keys(spark):
    a, b = list(range(1, 40)), list(range(20, 60))
    frame = spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>")
    cells = F.lit(120)
    peeled = frame.select(fp.peel(fp.subtract(fp.sketch(F.col("a"), cells), fp.sketch(F.col("b"), cells)), cells).alias("p")).first().p
    assert peeled.left == [] and {(x.n, x.key) for x in peeled.found} == {(1, k) for k in range(1, 20)} | {(-1, k) for k in range(40, 60)}
    stuck = frame.select(fp.peel(fp.subtract(fp.sketch(F.col("a"), F.lit(12)), fp.sketch(F.col("b"), F.lit(12))), F.lit(12)).alias("p")).first().p
    assert stuck.left and frame.select(fp.differing_keys(F.col("a"), F.col("b")).alias("d")).first().d == 39


def test_given_sketches_of_other_sizes_and_retries_count_alike(spark):
    rng = random.Random(3)
    pairs = [(rng.sample(range(1 << 40), a), rng.sample(range(1 << 40), b)) for a, b in ((0, 0), (0, 1), (1, 1), (3, 400), (90, 70), (2000, 5))]
    pairs = [(a, b + a[:len(a) // 2]) for a, b in pairs]
    frame = spark.createDataFrame(pairs, "a array<bigint>, b array<bigint>").withColumns(
        {f"{c}_third": fp.own_third(F.col(c)) for c in "ab"}).withColumns(
        {f"{c}_sketch": fp.sketch(F.col(c), F.col(f"{c}_third") * 3) for c in "ab"})
    got = frame.select("a", "b", fp.differing_keys(F.col("a"), F.col("b")).alias("fresh"), fp.differing_keys(
        F.col("a"), F.col("b"), F.col("a_sketch"), F.col("b_sketch")).alias("given")).collect()
    assert all(r.fresh == r.given == len(set(r.a) ^ set(r.b)) for r in got)
    assert all((r.third & (r.third - 1)) == 0 for r in frame.select(F.col("a_third").alias("third")).collect())


def test_fingerprints_odd_rows(edge_documents):
    got = fp.fingerprint_versions(edge_documents).collect()
    assert len(got) == edge_documents.count()
    same = {r.fingerprint for r in got if r.doc_id in (7, 8)}
    assert len(same) == 1 and {r.fingerprint for r in got if r.doc_id == 1} == {r.fingerprint for r in got if r.doc_id == 2}
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fp.fingerprint_versions(edge_documents.limit(0)).count() == 0
    one = fp.fingerprint_versions(edge_documents.filter("doc_id = 7")).collect()[0]
    assert one.near_next == 1.0


# mixing

def test_targets_share_the_excess_until_none_is_above(spark):
    sizes = {"a": 100, "b": 1, "c": 1000, "d": 50, None: 10, "zero": 0}
    frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in source_targets(frame).collect()}
    weight = dict(zip(["a", "b", "c", "d", "zero", None], [1, 2, 3, 1, 2, 3]))
    total, capped = sum(sizes.values()), {}
    while True:
        free = {s: weight[s] for s in sizes if s not in capped}
        rest = total - sum(capped.values())
        target = capped | {s: rest * w / sum(free.values()) for s, w in free.items()}
        above = {s: 3.0 * sizes[s] for s in free if target[s] > 3 * sizes[s]}
        if not above:
            break
        capped |= above
    assert got == pytest.approx(target) and sum(got.values()) == pytest.approx(total)


def test_mix_takes_floor_or_one_more(documents):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 4}") for i in range(2000)]
    plan = mixing_plan(documents(rows)).collect()
    taken = Counter()
    for r in plan:
        rate = r["_target"] / r["_source_size"]
        assert r["_copies"] in (int(rate), int(rate) + 1) and r["_copies"] <= 3
        taken[r["source"]] += r["_copies"] * r["_size"]
    for s in taken:
        target = next(r["_target"] for r in plan if r["source"] == s)
        assert abs(taken[s] / target - 1) < 0.1
    assert Counter(r.doc_id for r in mix(documents(rows)).collect()) == Counter({r.doc_id: r["_copies"] for r in plan if r["_copies"]})


def test_mixing_odd_rows(edge_documents):
    plan = mixing_plan(edge_documents).collect()
    assert len(plan) == edge_documents.count() and all(r["_size"] == 0 for r in plan if r.doc_id in (1, 2, 3))
    mixed = mix(edge_documents)
    assert mixed.columns == edge_documents.columns and {r["_size"] for r in mixed.collect()} == {"own _size"}
    assert mixing_plan(edge_documents.limit(0)).count() == mix(edge_documents.limit(0)).count() == 0


# sharding

def test_shards_are_even_gapless_and_mixed(spark, documents):
    rows = [(i, f"é{i}", "hot" if i % 3 else f"s{i % 5}") for i in range(3001)]
    got = shard_documents(documents(rows)).collect()
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r)
        assert r.size == len(f"é{r.doc_id}".encode()) + 1 and r.text_crc32 == zlib.crc32(f"é{r.doc_id}".encode())
    assert sorted(r.doc_id for r in got) == list(range(3001)) and set(by_shard) == set(range(8))
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    whole = Counter(r[2] for r in rows)
    for part in by_shard.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
        assert all(abs(n - whole[s] / 8) <= 2 for s, n in Counter(r.source for r in part).items())


def test_buckets_change_nothing_but_the_order_within(documents):
    rows = [(i, "t", "a" if i % 2 else None) for i in range(500)]
    slim = documents(rows).select("doc_id", "source")
    one, many = interleave(slim, 8, "doc_id", "source").collect(), interleave(slim, 8, "doc_id", "source", bucket_rows=20).collect()
    assert Counter((r.shard, r.source) for r in one) == Counter((r.shard, r.source) for r in many)
    assert interleave(slim.repartition(7), 8, "doc_id", "source").collect() == sorted(one, key=one.index) or set(one) == set(
        interleave(slim.repartition(7), 8, "doc_id", "source").collect())


def test_sharding_odd_rows(edge_documents):
    got = shard_documents(edge_documents).collect()
    assert len(got) == edge_documents.count() and {(r.size, r.text_crc32) for r in got if r.doc_id in (1, 2)} == {(1, None), (1, 0)}
    wide = interleave(edge_documents, 3, "doc_id", "source")
    assert wide.columns == [*edge_documents.columns, "shard", "slot"] and {r["_row"] for r in wide.collect()} == {"own _row"}
    assert shard_documents(edge_documents.limit(0)).count() == 0


# URL filters

ENTRIES = [("l", "d:example.org", "add", date(2024, 1, 10)), ("l", "d:example.org", "add", date(2024, 1, 12)),
           ("l", "d:example.org", "remove", date(2024, 2, 1)), ("l", "d:example.org", "add", date(2024, 3, 1)),
           ("m", "d:www.example.org", "add", date(2024, 1, 1)), ("m", "p:www.example.org/a/b", "add", date(2024, 1, 20)),
           ("m", "d:gone.net", "remove", date(2024, 1, 1)), ("m", "d:both.net", "add", date(2024, 1, 1)),
           ("m", "d:both.net", "remove", date(2024, 1, 1)), (None, "d:x.net", "add", date(2024, 1, 1)), ("m", None, "add", date(2024, 1, 1)),
           ("m", "d:x.net", None, date(2024, 1, 1)), ("m", "d:x.net", "add", None)]


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(ENTRIES, "list_name string, rule string, action string, listed_on date").withColumn("url", F.lit("clash"))


def test_intervals(entries):
    got = {(r.list_name, r.rule, r.valid_from, r.valid_to) for r in validity_intervals(entries).collect()}
    assert got == {("l", "d:example.org", date(2024, 1, 10), date(2024, 2, 1)), ("l", "d:example.org", date(2024, 3, 1), None),
                   ("m", "d:www.example.org", date(2024, 1, 1), None), ("m", "p:www.example.org/a/b", date(2024, 1, 20), None)}


def test_captures_meet_the_entries_of_their_day(spark, entries):
    captures = spark.createDataFrame([
        (1, "https://WWW.Example.org:8080/a/b/c?q#f", date(2024, 1, 15)), (2, "http://u@www.example.org./a", date(2024, 2, 1)),
        (3, "http://sub.example.org", date(2024, 1, 31)), (4, "http://notexample.org/", date(2024, 1, 15)), (5, None, date(2024, 1, 15)),
        (6, "no url", date(2024, 1, 15)), (7, "http://example.org/", None), (8, "http://gone.net/", date(2024, 6, 1)),
        (9, "http://www.example.org/a/b", date(2024, 3, 1)), (9, "http://www.example.org/a/b", date(2024, 3, 1)),
        (None, "http://both.net/", date(2024, 5, 1))], "page_id long, url string, fetched_on date").withColumn("rule", F.lit("clash"))
    got = {r.page_id: r for r in filter_captures(captures, entries).collect()}
    assert len(got) == 10
    assert {i: (r.n_active, r.rule) for i, r in got.items() if r.blocked} == {
        1: (2, "d:www.example.org"), 2: (1, "d:www.example.org"), 3: (1, "d:example.org"), 9: (3, "p:www.example.org/a/b")}
    assert got[9].captures == 2 and got[1].lists == "l,m" and got[3].valid_to == date(2024, 2, 1) and got[5].host is None
    assert filter_captures(captures.limit(0), entries).count() == 0
    assert not any(r.blocked for r in filter_captures(captures, entries.limit(0)).collect())


def test_rule_keys(spark):
    row = spark.range(1).select(rule_keys(F.lit("http://a.b.c/x//y?z")).alias("k"), host_of(F.lit("ftp://[::1]:2/")).alias("h"),
                                path_of(F.lit("http://a")).alias("p")).first()
    assert row.k == ["d:a.b.c", "d:b.c", "d:c", "p:a.b.c/x", "p:a.b.c/x/y"] and row.h == "[::1]" and row.p == "/"


@pytest.mark.parametrize("url, rules", [
    ("http://10.1.2.3/a", ["d:10.1.2.3", "p:10.1.2.3/a"]), ("http://[2001:db8::1.2.3.4]/", ["d:[2001:db8::1.2.3.4]"]),
    ("http://1.2.3/", ["d:1.2.3", "d:2.3", "d:3"])])
def test_addresses_are_looked_up_whole(spark, url, rules):
    assert spark.range(1).select(rule_keys(F.lit(url)).alias("k")).first().k == rules


def test_columns_made_on_arrival_are_those_of_the_next_row_and_are_not_shuffled(documents):
    docs = documents([(i, f"text {i % 5} and more") for i in range(40)] + [(None, "x"), (41, None)]).select("doc_id", "text")
    got = fp.with_next(docs, ["text", "twice"], None, [{"size": F.char_length("text")}, {"twice": F.col("size") * 2}])
    rows = got.collect()
    assert len(rows) == 42 and all(r.next_twice == (None if r.next_text is None else 2 * len(r.next_text)) for r in rows)
    assert {(r.doc_id, r.text, r.next_text) for r in rows} == {(r.doc_id, r.text, r.next_text) for r in fp.with_next(docs, ["text"]).collect()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("REPARTITION_BY_COL")]
    assert "Window" in above and above.count("Exchange") == 1  # the window adds no exchange above the one the rows arrive by


def test_a_value_used_many_times_is_computed_once_and_not_copied(spark):
    frame = spark.range(3).select(fp._with(F.array(F.col("id"), F.col("id") + 1), lambda a: F.concat(a, a)).alias("a"))
    assert [r.a for r in frame.collect()] == [[i, i + 1] * 2 for i in range(3)]
    assert "transform(" not in frame._jdf.queryExecution().optimizedPlan().toString()
