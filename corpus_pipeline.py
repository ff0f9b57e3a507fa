"""Corpus pipeline: toxicity, quality, near-duplicates, mixing, tokens; each stage works on all its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents. Classifiers learn from the
labelled rows of sf_dir that their own input still holds and that are not held out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalens.llm import near_dedup, quality, sentencepiece, toxicity
from catalens.llm.common import stored, table
from catalens.llm.labels import labelled, remainder
from catalens.llm.mixing import mix
from catalens.llm.queries import TOKENIZER_MODEL

TOXIC_FROM, GOOD_FROM = 0.7, 0.3


def _packed(docs: DataFrame) -> DataFrame:
    """The rows as one column, beside their text, so that no column's name meets those of an operator."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.7."""
    rows = labelled(docs, table(spark, sf_dir, "labels"), "toxic", remainder(3) != 1, toxicity.CLASS_ROWS)
    scored = toxicity.score_documents(_packed(docs), toxicity.fit(rows), ["document"])
    return scored.filter(F.col("score") < TOXIC_FROM).select("document.*")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3."""
    rows = labelled(docs, table(spark, sf_dir, "labels"), "quality", remainder(5) != 0, quality.CLASS_ROWS)
    scored = quality.score_documents(_packed(docs), quality.fit(rows), ["document"])
    return scored.filter(F.col("score") >= GOOD_FROM).select("document.*")


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each near-duplicate group, once if its row is repeated.

    Only ids are joined and counted; rows without doc_id belong to no group and stay. Of several texts with one doc_id the
    first by hash and text stays.
    """
    groups = stored(near_dedup.duplicate_groups(docs).filter("doc_id is not null").select("doc_id", "kept"), "groups")
    repeated = groups.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("kept")).filter("n > 1")
    repeated = stored(repeated.select("doc_id", "kept"), "repeated")
    out = stored(groups.filter(~F.col("kept")).select("doc_id").union(repeated.select("doc_id")).distinct(), "dropped")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text", F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
    once = (docs.join(repeated.filter("kept").select("doc_id"), "doc_id", "left_semi")
            .select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), F.row_number().over(first).alias("n"))
            .filter("n = 1").select("document.*"))
    return docs.join(out, "doc_id", "left_anti").select(*docs.columns).union(once.select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and n_tokens of every copy in the mix."""
    vocabulary = sentencepiece.load_vocabulary(TOKENIZER_MODEL)
    return sentencepiece.encode_documents(docs, vocabulary, ["doc_id", "lang", "source"])


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_good),
    ("MinHash near-dedup", keep_one_of_group),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_tokens),
]

#: Trained classifiers are not expressible in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{i + 1}")
    return docs
