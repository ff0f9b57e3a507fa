"""Text profiles per document and quoted numbers."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from catalens import fixed_values as fx
from catalens.functions.numeric import pct
from catalens.functions.text import squeeze, text_or_empty, word_count
from catalens.operators.keys import _first_per


def numbers_in(df: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct numbers quoted per document: separators removed, and '12.0' also listed as '12'."""
    raw = F.transform(F.regexp_extract_all(text_or_empty(text), F.lit(fx.NUMBER), F.lit(1)),
                      lambda x: F.replace(x, F.lit(","), F.lit("")))
    alias = F.transform(F.filter(raw, lambda x: x.endswith(".0")), lambda x: F.regexp_replace(x, r"\.0$", ""))
    return df.select(key, F.explode(F.array_distinct(F.concat(raw, alias))).alias("number"))


def sentences(text) -> Column:
    """Sentences of at least four words."""
    parts = F.split(squeeze(text), fx.SENTENCE_BREAK)
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.regexp_count(s, F.lit(r"(?U)\S+")) >= 4)


def _opening(s: Column) -> Column:
    return F.lower(F.regexp_extract(s, "^([A-Za-z']+)", 1))


def _deviation(values: str) -> Column:
    """Population standard deviation of an array; null for an empty one.

    Mean and squared differences are updated value by value in the array's order, as SQL engines do it: sums of squares can differ
    in the last bit, which decides how a value half-way between two results is rounded.
    """
    def add(acc: Column, x: Column) -> Column:
        n = acc["n"] + 1
        mean = acc["mean"] + (x - acc["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (acc["squares"] + (x - mean) * (x - acc["mean"])).alias("squares"))

    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))
    return F.aggregate(values, start, add, lambda acc: F.when(acc["n"] > 0, F.sqrt(acc["squares"] / acc["n"])))


def _group_starts(ordered: str) -> Column:
    """Where every group of equal values of a sorted array begins: its value and place."""
    numbered = F.transform(ordered, lambda x, i: F.struct(x.alias("value"), i.alias("at")))
    return F.filter(numbered, lambda e: (e["at"] == 0) | (F.get(ordered, e["at"] - 1) != e["value"]))


def _most_frequent(ordered: str, starts: str, n: int) -> Column:
    """The n most frequent values of a sorted array with their counts, ties in order of the values; `starts` as `_group_starts` gives them."""
    after = lambda i: F.coalesce(F.get(starts, i + 1)["at"], F.size(ordered))
    groups = F.transform(starts, lambda e, i: F.struct((e["at"] - after(i)).cast("bigint").alias("less"), e["value"].alias("opening")))
    return F.transform(F.slice(F.sort_array(groups), 1, n), lambda g: F.struct(g["opening"].alias("opening"), (-g["less"]).alias("sentences")))


def prose_profile(df: DataFrame, key: str, text: str, dash: str = fx.DASH, connectives=fx.CONNECTIVES, n_openings: int = 5) -> DataFrame:
    """Style profile per document. Everything is computed inside the row: no shuffle.

    Words, sentences and constructions are read from the text with a word in place of every dash (`DASH_WORD`), phrases from the text
    as it is. `top_sentence_openings` holds the most frequent first words of sentences, ties in text order; `formulaic_detail` the
    phrases found, in the order given. A null text is an empty one.
    """
    def hits(pattern: str, text: str, needs: tuple[str, ...] = ()) -> Column:
        """Number of matches; the expression is only run on text that holds the literals it needs."""
        found = F.regexp_count(F.col(text), F.lit(pattern))
        for literal in needs:
            found = F.when(F.contains(F.col(text), F.lit(literal)), found).otherwise(0)
        return found

    def phrase(p: str) -> Column:
        return F.struct(F.lit(pattern_label(p)).alias("pattern"), hits("(?U)" + p, "raw_low", (_needed(p),)).cast("bigint").alias("n"))

    phrases = F.array(*[phrase(p) for p in connectives]) if connectives else F.array().cast("array<struct<pattern:string,n:bigint>>")
    dashed = F.col("dashes") > 0
    raw = df.select(F.col(key), text_or_empty(text).alias("raw")).select(key, "raw", F.lower("raw").alias("raw_low"), hits(dash, "raw").alias("dashes"))
    parted = raw.withColumn("body", F.when(dashed, F.regexp_replace("raw", dash, f" {fx.DASH_WORD} ")).otherwise(F.col("raw")))
    base = parted.select(
        key, "raw_low", "dashes", "body", F.when(dashed, F.lower("body")).otherwise(F.col("raw_low")).alias("low"), sentences("body").alias("s")).select(
        key, "raw_low", "dashes", "body", "low",
        F.transform("s", lambda x: F.regexp_count(x, F.lit(r"(?U)\S+")).cast("double")).alias("lens"),
        F.sort_array(F.filter(F.transform("s", _opening), lambda o: o != "")).alias("openings"),
    )
    counted = base.select(
        key, "lens", "openings", _group_starts("openings").alias("starts"),
        hits(fx.WORD, "body").cast("double").alias("w"), "dashes",
        F.filter(phrases, lambda x: x["n"] > 0).alias("formulaic_detail"),
        hits("(?U)" + fx.TRIAD, "body", ("and", ",")).alias("triads"),
        hits("(?U)" + fx.NOT_BUT, "low", ("not", "but")).alias("not_but"),
        hits("(?U)" + fx.PASSIVE, "low").alias("passive"),
        F.size("lens").cast("double").alias("n"),
        F.aggregate("lens", F.lit(0.0), lambda acc, x: acc + x).alias("total"),
        _deviation("lens").alias("deviation"),
        F.size(F.filter("openings", lambda o: o == "the")).alias("the_initial"),
    ).withColumn("formulaic", F.aggregate("formulaic_detail", F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"]))

    def rate(c: str) -> Column:
        return F.when(F.col("w") > 0, F.bround(1000.0 * F.col(c) / F.col("w"), 1)).otherwise(0.0)

    some = F.col("n") > 0
    return counted.select(
        key, F.col("w").cast("bigint").alias("words"), F.col("n").cast("bigint").alias("sentences"),
        F.when(some, F.bround(F.col("total") / F.col("n"), 1)).otherwise(0.0).alias("mean_sentence_words"),
        F.when(some, F.bround("deviation", 1)).otherwise(0.0).alias("sd_sentence_words"),
        F.coalesce(F.array_min("lens"), F.lit(0.0)).cast("bigint").alias("min_sentence_words"),
        F.coalesce(F.array_max("lens"), F.lit(0.0)).cast("bigint").alias("max_sentence_words"),
        F.col("dashes").cast("bigint").alias("em_dashes"), rate("dashes").alias("em_dashes_per_1000_words"),
        F.col("formulaic").alias("formulaic_total"), rate("formulaic").alias("formulaic_per_1000_words"),
        rate("triads").alias("triads_per_1000_words"), F.col("not_but").cast("bigint").alias("not_x_but_y"),
        rate("not_but").alias("not_x_but_y_per_1000_words"), rate("passive").alias("passive_per_1000_words"),
        F.col("the_initial").cast("bigint").alias("the_initial_sentences"),
        pct("the_initial", "n").alias("the_initial_pct"),
        _most_frequent("openings", "starts", n_openings).alias("top_sentence_openings"), "formulaic_detail",
    )


def pattern_label(pattern: str) -> str:
    """A pattern as reports name it: without the word borders around it."""
    return pattern.removeprefix(r"\b").removesuffix(r"\b")


def _needed(pattern: str) -> str:
    """Literal text that every match of a pattern begins with; empty where none is certain."""
    plain = pattern.removeprefix(r"\b")
    if "|" in re.sub(r"\([^()]*\)", "", plain):
        return ""
    start = re.match(r"[\w ',-]*", plain)[0]
    return start[:-1] if plain[len(start):len(start) + 1] in tuple("?*{") else start


def pattern_counts(df: DataFrame, key: str, text: str, groups: tuple[tuple[str, ...], ...] = fx.CONNECTIVE_GROUPS) -> DataFrame:
    """Matches per document and pattern: key, pattern, n; patterns without a match and null or empty texts give no row.

    All patterns of a group are found in one pass over the lower-cased text, as alternatives; so patterns of one group must not be
    able to overlap. Which alternative a match belongs to is read from the match alone. A match of a pattern hides another of the
    same pattern that begins inside it, as counting the pattern by itself would. A group is only looked for in texts that hold the
    literal beginning of one of its patterns.
    """
    def found_in(group: tuple[str, ...]) -> Column:
        begun = reduce(or_, [F.contains("_low", F.lit(start)) for start in sorted({_needed(p) for p in group})])
        found = F.regexp_extract_all("_low", F.lit("(?U)(?:" + "|".join(group) + ")"), F.lit(0))
        return F.when(begun, found).otherwise(F.array().cast("array<string>"))

    low = df.select(F.col(key), F.lower(text_or_empty(text)).alias("_low"))
    hits = F.concat(*[found_in(group) for group in groups])
    named = F.coalesce(*[F.when(F.col("hit").rlike(f"(?U)^(?:{p})$"), F.lit(pattern_label(p))) for group in groups for p in group])
    found = low.select(F.col(key), F.explode(hits).alias("hit")).select(key, named.alias("pattern"))
    return found.groupBy(key, "pattern").agg(F.count(F.lit(1)).alias("n"))


def trace_numbers(
    quoted: DataFrame, body: DataFrame, key: str, number: str = "number", tolerance: float = 0.05, scales: tuple[float, ...] = (1.0, 100.0, 0.01)
) -> DataFrame:
    """How every quoted number of a key is found among the key's numbers in the body: key, number, status.

    Both frames have text columns `key` and `number`. `same`: the same text, or the same without trailing zeros; `rounded`: a value
    at most `tolerance` away; `scaled`: such a value after one of the other scales (0.994 and 99.4); else `untraced`, which
    includes text that is no number. Values meet through buckets of the tolerance's width: a quoted value looks into its own bucket
    and both neighbours, so nothing is compared beyond them. Repeated numbers count once; null keys and numbers are left out.
    """
    def plain(c: Column) -> Column:
        return F.when(F.contains(c, F.lit(".")), F.regexp_replace(c, r"\.?0*$", "")).otherwise(c)

    asked = quoted.select(key, F.col(number).alias("number")).where(F.col(key).isNotNull() & F.col("number").isNotNull()).distinct()
    there = body.select(key, F.col(number).alias("_found")).where(F.col(key).isNotNull() & F.col("_found").isNotNull()).distinct()
    bucket = lambda c: F.floor(c / F.lit(tolerance))
    listed = there.select(key, plain(F.col("_found")).alias("_plain")).distinct()
    exact = asked.withColumn("_plain", plain(F.col("number"))).join(listed, [key, "_plain"]).select(key, "number", F.lit(0).alias("_how"))
    values = there.select(key, F.col("_found").try_cast("double").alias("_b")).where("_b is not null").distinct().withColumn("_bucket", bucket(F.col("_b")))
    tries = asked.select(key, "number", F.col("number").try_cast("double").alias("_v")).where("_v is not null").select(
        key, "number", F.inline(F.array(*[F.struct((F.col("_v") * s).alias("_v"), F.lit(1 if s == 1.0 else 2).alias("_how")) for s in scales])))
    near = tries.withColumn("_bucket", F.explode(F.array(*[bucket(F.col("_v")) + i for i in (-1, 0, 1)]))).join(values, [key, "_bucket"])
    near = near.where(F.abs(F.col("_v") - F.col("_b")) <= F.lit(tolerance)).select(key, "number", "_how")
    best = exact.unionByName(near).groupBy(key, "number").agg(F.min("_how").alias("_how"))
    status = F.coalesce(F.get(F.array(*[F.lit(x) for x in ("same", "rounded", "scaled")]), F.col("_how")), F.lit("untraced"))
    return asked.join(best, [key, "number"], "left").select(key, "number", status.alias("status"))


def top_openings(df: DataFrame, key: str, text: str, n: int = 5) -> DataFrame:
    """Most frequent first words of sentences per document."""
    counts = (
        df.select(key, F.explode(F.transform(sentences(text), _opening)).alias("opening"))
        .where(F.col("opening") != "").groupBy(key, "opening").agg(F.count(F.lit(1)).alias("sentences"))
    )
    return _first_per(counts, [key], [F.desc("sentences"), F.col("opening").asc()], n).withColumnRenamed("_rank", "rank")


def section_profile(df: DataFrame, key: str, text: str, heading: str, reference: str) -> DataFrame:
    """Words, references and word share per section; `heading` has one group, the section title."""
    body = text_or_empty(text)
    titles = F.regexp_extract_all(body, F.lit(heading), F.lit(1))
    parts = F.split(body, heading)
    sections = df.select(key, word_count(text).alias("all_words"), titles.alias("t"), parts.alias("p")).select(
        key, "all_words", F.posexplode("t").alias("section", "title"), "p"
    )
    content = F.get("p", F.col("section") + 1)
    return sections.select(
        key, F.col("section").cast("bigint").alias("section"), "title",
        word_count(content).cast("bigint").alias("words"),
        F.regexp_count(content, F.lit(reference)).cast("bigint").alias("refs"),
        pct(word_count(content), "all_words").alias("share_pct"),
    )
