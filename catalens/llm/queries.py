"""Registered queries opN_<name>: each applies one operator to its whole table; SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.llm import language_model, quality, sentencepiece, sql, toxicity, wavelet_shards
from catalens.llm.collocations import collocations
from catalens.llm.common import WORD, table
from catalens.llm.fingerprints import fingerprint_versions
from catalens.llm.labels import labelled, remainder
from catalens.llm.mixing import mixing_plan
from catalens.llm.multi_index import nearest_neighbours
from catalens.llm.near_dedup import duplicate_groups
from catalens.llm.periodic_runs import periodic_runs
from catalens.llm.sharding import shard_documents
from catalens.llm.url_filters import filter_captures, host_of, path_of
from catalens.session import scratch_dir

TOKENIZER_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), remainder(3) == 1
    model = toxicity.fit(labelled(docs, table(spark, sf_dir, "labels"), "toxic", ~held, toxicity.CLASS_ROWS))
    scored = toxicity.score_documents(docs, model, ["doc_id"])
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
                         "evidence", "toxic_ll", "ordinary_ll", "letters")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), remainder(5) == 0
    weights = quality.fit(labelled(docs, table(spark, sf_dir, "labels"), "quality", ~held, quality.CLASS_ROWS))
    scored = quality.score_documents(docs, weights, ["doc_id"])
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_versions(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece.encode_documents(docs, sentencepiece.load_vocabulary(TOKENIZER_MODEL), ["doc_id"], check=True)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing_plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return plan.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                       F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest_neighbours(table(spark, sf_dir, "embeddings"), F.pmod("id", F.lit(20)) == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"), remainder(5) == 1)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shard_documents(table(spark, sf_dir, "documents"))
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                          F.lit(None).cast("int").alias("grown_shard"), "source")


def _digits(text, start: int = 1):
    return F.conv(F.substring(F.md5(text), start, 7), 16, 10).cast("long")


def captures(pages: DataFrame) -> DataFrame:
    """Pages as captures: the fetch date is drawn from the page id, one day of 2024."""
    return pages.select("page_id", "url", F.date_add(
        F.lit("2024-01-01").cast("date"), (_digits(F.concat(F.lit("fetch:"), F.col("page_id").cast("string"))) % 366)
        .cast("int")).alias("fetched_on"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries derived from the pages: a third of the hosts, and a fifth of the page paths, are listed.

    Every listed rule is added on a drawn day; two of three are removed later, and half of these added once more.
    """
    rules = pages.select(
        F.explode(F.array(
            F.struct(F.lit("hosts").alias("list_name"), F.concat(F.lit("d:"), host_of(F.col("url"))).alias("rule")),
            F.struct(F.lit("paths").alias("list_name"), F.concat(
                F.lit("p:"), host_of(F.col("url")), F.regexp_replace(path_of(F.col("url")), "/+$", "")).alias("rule")),
        )).alias("e")).select("e.*").filter("rule like '%/%' or list_name = 'hosts'").distinct()
    drawn = rules.withColumn("a", _digits("rule")).withColumn("b", _digits("rule", 8)).withColumn("c", _digits("rule", 15))
    listed = drawn.filter("a % (case when list_name = 'hosts' then 3 else 5 end) = 0")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    added = F.col("b") % 200
    removed = added + 20 + F.col("c") % 60
    return listed.withColumn("s", F.explode(F.array(
        F.struct(F.lit("add").alias("action"), day(added).alias("listed_on")),
        F.when(F.col("c") % 3 > 0, F.struct(F.lit("remove").alias("action"), day(removed).alias("listed_on"))),
        F.when((F.col("c") % 3 > 0) & (F.col("b") % 2 == 0),
               F.struct(F.lit("add").alias("action"), day(removed + 40).alias("listed_on"))),
    ))).filter("s is not null").select("list_name", "rule", "s.action", "s.listed_on")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    filtered = filter_captures(captures(pages), list_entries(pages))
    return filtered.withColumns({c: F.col(c).cast("string") for c in ("fetched_on", "valid_from", "valid_to")})


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; where crc32(doc_id) is a multiple of ten, the words from a drawn place on repeat a drawn number of words.

    A null doc_id counts as an empty text.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    n = F.size(words)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    edited = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return docs.select("doc_id", F.when((h % 10 == 0) & (n > 0), edited).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_repeated_tails(table(spark, sf_dir, "documents")), ["doc_id"])
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("at"), (-r["period"]).alias("q"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    return found.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.at")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.q")).alias("period"), F.floor(F.lit(1000) * F.col("best.length") / -F.col("best.q")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch_dir(spark, "llm-token-shards")
    docs = table(spark, sf_dir, "documents")
    return wavelet_shards.document_digests(wavelet_shards.write_shards(docs, folder, public_tokenizers.path("word_bpe_49k.json"), 2))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_fingerprints": op3_fingerprints,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_mixing": op5_mixing,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_language_model": op7_language_model,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_sharding": op9_sharding,
    "op10_url_filters": op10_url_filters,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_collocations": op12_collocations,
    "op13_token_shards": op13_token_shards,
}

ORACLE_SQL = {"op5_mixing": sql.MIXING, "op8_near_duplicates": sql.NEAR_DUPLICATES, "op10_url_filters": sql.URL_FILTERS,
              "op12_collocations": sql.COLLOCATIONS}
