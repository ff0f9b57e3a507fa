"""Phrase counts and traced numbers against plain Python; first rows for claims."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from catalens import fixed_values as fx
from catalens.operators import evidence as ev
from catalens.operators import prose as pr


def test_pattern_counts_equal_single_scans(spark):
    random.seed(1)
    pieces = ["moreover", "this is a", "this is the", "the key point", "in summary", "plays a key role", "it is clear that", "Notably", "unnotably", "let us",
              "highlights the", "when it comes to", "word", "key", "this", "in today's", "explicitly", "."]
    docs = [(i, " ".join(random.choices(pieces, k=random.choice([0, 3, 40])))) for i in range(60)] + [(98, None), (99, "")]
    got = {(r.k, r.pattern): r.n for r in pr.pattern_counts(spark.createDataFrame(docs, "k long, t string"), "k", "t").collect()}
    want = {(k, pr.pattern_label(p)): n for k, t in docs for p in fx.CONNECTIVES if (n := len(re.findall(p, (t or "").lower())))}
    assert got == want and len(want) > 100
    assert sorted(p for g in fx.CONNECTIVE_GROUPS for p in g) == sorted(fx.CONNECTIVES)


def test_patterns_are_only_looked_for_where_a_match_can_begin(spark):
    starts = {r"\bplays? a (?:key|vital) role\b": "play", r"\bthis is (?:a|the) \w+": "this is ", r"\bin today's\b": "in today's", r"ab{2}": "a", "ab+": "ab",
              "a|b": "", "(?:a|b)c": "", r"\w+x": "", ".x": "", r"\bx*y": "", "[ab]": "", "a.c": "a", "it(?:s|z)": "it"}
    assert {p: pr._needed(p) for p in starts} == starts
    docs = [(1, "Bc ac abbb"), (2, "yy xxy PLAYS A KEY ROLE"), (3, "nothing"), (4, None), (5, "play a vital role, acc")]
    groups = (("ab{2}", "[ab]c"), (r"\bx*y", r"\bplays? a (?:key|vital) role\b"))
    frame = pr.pattern_counts(spark.createDataFrame(docs, "k long, t string"), "k", "t", groups)
    want = {(k, pr.pattern_label(p)): n for k, t in docs for g in groups for p in g if (n := len(re.findall(p, (t or "").lower())))}
    assert {(r.k, r.pattern): r.n for r in frame.collect()} == want and len(want) == 6
    plan = pr.pattern_counts(spark.createDataFrame(docs, "k long, t string"), "k", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" in plan and plan.count("lower(") == 1


def _profile(text):
    """The whole profile in plain Python: dashes set apart, words, sentences, openings, phrases, constructions."""
    body = re.sub("---?|—", " EMDASH ", text)
    words = re.findall(r"[A-Za-z][A-Za-z'\-]+", body)
    parts = [p for p in re.split(r"(?<=[.!?])\s+(?=[A-Z(])", re.sub(r"\s+", " ", body)) if len(p.split()) >= 4]
    openings = [m[1].lower() for p in parts if (m := re.match(r"([A-Za-z']+)", p.strip()))]
    found = [(pr.pattern_label(p), n) for p in fx.CONNECTIVES if (n := len(re.findall(p, text, re.I)))]
    counts = {
        "em_dashes": len(re.findall("---?|—", text)), "formulaic": sum(n for _, n in found), "triads": len(re.findall(fx.TRIAD, body)),
        "not_x_but_y": len(re.findall(fx.NOT_BUT, body, re.I)), "passive": len(re.findall(fx.PASSIVE, body, re.I)),
    }
    top = sorted({(o, openings.count(o)) for o in openings}, key=lambda e: (-e[1], e[0]))[:5]
    return len(words), [len(p.split()) for p in parts], counts, openings.count("the"), top, found


def test_whole_profile_in_plain_python(spark):
    random.seed(5)
    pieces = ["The cat", "It", "a dog", "ran--fast", "---", " -- ", "x—y", "stopped. The end", "of it all. An owl", "and sat. It is", "well? (No", "Notably", "this is a--b", "this is the key",
              "red, green, and blue", "one, two--three, and four", "is not big but", "are not -- so but", "was taken", "were--given", "is", "hidden", "plays a key role",
              "highlights the", "let us", "a-b", "été", "\n", "   ", ".", "----", "it's 'so'. 'Twas a fine day", "do so. We saw", "all day. Some are", "at last. Many"]
    docs = [(i, " ".join(random.choices(pieces, k=random.choice([0, 5, 60, 300])))) for i in range(120)] + [(900, None), (901, ""), (902, "--"), (903, "this is a--b or it")]
    asked = {i: _profile(t or "") for i, t in docs}
    for r in pr.prose_profile(spark.createDataFrame(docs, "k long, t string"), "k", "t").collect():
        w, lens, counts, the, top, found = asked[r.k]
        assert (r.words, r.sentences, r.the_initial_sentences) == (w, len(lens), the), r
        assert (r.min_sentence_words, r.max_sentence_words) == (min(lens, default=0), max(lens, default=0))
        assert abs(r.mean_sentence_words - (sum(lens) / len(lens) if lens else 0)) < 0.0501
        assert (r.em_dashes, r.formulaic_total, r.not_x_but_y) == (counts["em_dashes"], counts["formulaic"], counts["not_x_but_y"])
        for name, n in counts.items():
            assert abs(r[f"{name}_per_1000_words"] - (1000 * n / w if w else 0)) < 0.0501, (name, r)
        assert [tuple(e) for e in r.top_sentence_openings] == top and [tuple(e) for e in r.formulaic_detail] == found
    assert sum(len(a[4]) == 5 for a in asked.values()) > 40 and asked[903][5] == [] and asked[902][0] == 1


def test_most_frequent_openings_of_long_texts_and_ties(spark):
    one = lambda o, n: f"{o} b c d. " * n
    docs = [(1, one("Cow", 2) + one("Ant", 2) + one("The", 40_000) + one("Bee", 2) + one("Dog", 1) + one("Elk", 1) + one("(", 3)), (2, one("Ox", 1)), (3, "Too short.")]
    frame = spark.createDataFrame(docs, "k long, t string")
    got = {r.k: [tuple(e) for e in r.top_sentence_openings] for r in pr.prose_profile(frame, "k", "t").collect()}
    assert got == {1: [("the", 40_000), ("ant", 2), ("bee", 2), ("cow", 2), ("dog", 1)], 2: [("ox", 1)], 3: []}
    assert [len(r.top_sentence_openings) for r in pr.prose_profile(frame, "k", "t", n_openings=2).orderBy("k").collect()] == [2, 1, 0]


def test_profile_counts_phrases_without_a_literal_beginning(spark):
    frame = spark.createDataFrame([(1, "Bar foo abbb. Bar none."), (2, "nothing")], "k long, t string")
    got = {r.k: (r.formulaic_total, [tuple(e) for e in r.formulaic_detail]) for r in pr.prose_profile(frame, "k", "t", connectives=(r"\bfoo\b|\bbar\b", "ab{2}", "x+")).collect()}
    assert got == {1: (4, [(r"foo\b|\bbar", 3), ("ab{2}", 1)]), 2: (0, [])}
    assert pr.prose_profile(frame, "k", "t", connectives=()).where("formulaic_total = 0 and size(formulaic_detail) = 0").count() == 2


def test_deviation_of_sentence_lengths_rounds_as_in_sql(spark):
    random.seed(1)
    lengths = [[7, 5, 26, 23, 19, 27, 5, 4, 17, 12, 19, 14, 13, 18, 29, 14], [20, 25, 14, 14, 24, 12, 13, 26, 11, 17, 15, 18, 17, 24, 22, 20], [9], []]
    lengths += [random.choices(range(4, 30), k=random.choice([4, 8, 16])) for _ in range(500)]
    docs = [(i, " ".join(" ".join(["A"] + ["b"] * (n - 1)) + "." for n in ns)) for i, ns in enumerate(lengths)]
    got = {r.k: r.sd_sentence_words for r in pr.prose_profile(spark.createDataFrame(docs, "k long, t string"), "k", "t").collect()}
    con = duckdb.connect()
    want = {i: con.execute("SELECT coalesce(round_even(list_stddev_pop(?::BIGINT[]), 1), 0)", [ns]).fetchone()[0] for i, ns in enumerate(lengths)}
    assert got == want and (got[0], got[1], got[2], got[3]) == (7.7, 4.7, 0.0, 0.0)


def test_numbers_are_traced_by_text_rounding_and_scale(spark):
    body = spark.createDataFrame([("a", "99.4"), ("a", "12"), ("a", "0.305"), ("b", "7"), ("a", "x"), (None, "5"), ("a", None), ("a", "12")], "k string, number string")
    quoted = spark.createDataFrame([("a", "12.0"), ("a", "12.00"), ("a", "99.44"), ("a", "0.994"), ("a", "30.5"), ("a", "7"), ("b", "7.0"), ("c", "7"), ("a", "n/a"),
                                    ("a", "100"), ("a", "12.0"), (None, "12")], "k string, number string")
    got = {(r.k, r.number): r.status for r in pr.trace_numbers(quoted, body, "k").collect()}
    assert got == {("a", "12.0"): "same", ("a", "12.00"): "same", ("a", "99.44"): "rounded", ("a", "0.994"): "scaled", ("a", "30.5"): "scaled", ("a", "7"): "untraced",
                   ("b", "7.0"): "same", ("c", "7"): "untraced", ("a", "n/a"): "untraced", ("a", "100"): "untraced"}


def test_traced_numbers_equal_all_pairs(spark):
    random.seed(3)
    body = [(random.choice("ab"), f"{random.uniform(0, 5):.3f}") for _ in range(80)]
    quoted = [(random.choice("ab"), f"{random.uniform(0, 5):.{random.choice([1, 2, 4])}f}") for _ in range(200)]
    got = {(r.k, r.number): r.status for r in pr.trace_numbers(
        spark.createDataFrame(quoted, "k string, number string"), spark.createDataFrame(body, "k string, number string"), "k", tolerance=0.01).collect()}
    for k, q in set(quoted):
        near = lambda v: any(kb == k and abs(v - float(n)) <= 0.01 for kb, n in body)  # noqa: B023, E731
        if got[k, q] != "same":
            assert got[k, q] == ("rounded" if near(float(q)) else "scaled" if near(float(q) * 100.0) or near(float(q) * 0.01) else "untraced")


def test_claims_take_the_first_row(spark):
    table = spark.createDataFrame([("x", "b", 2.0), ("x", "a", 1.0), ("y", "a", 5.0)], "k string, sub string, v double")
    claims = spark.createDataFrame([("first", "x", 1.0), ("second", "x", 2.0), ("one", "y", 5.0), ("one", "y", 6.0)], "label string, key_value string, expected double").select(
        "label", F.lit("t").alias("source"), F.lit("k").alias("key_field"), "key_value", F.lit("v").alias("field"), "expected")
    got = sorted((r.label, r.expected, r.actual, r.rows_met, r.status) for r in ev.check_claims(claims, ev.claim_cells({"t": (table, ["k", "sub"])})).collect())
    assert got == [("first", 1.0, 1.0, 2, "ok"), ("one", 5.0, 5.0, 1, "ok"), ("one", 6.0, 5.0, 1, "mismatch"), ("second", 2.0, 1.0, 2, "mismatch")]
