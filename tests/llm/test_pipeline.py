"""Registered queries, their SQL, and the pipeline's stages on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import check_oracle
import corpus_pipeline
from catalens.llm.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14)) and set(QUERIES) | {"pipeline"} <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in check_oracle.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert check_oracle.compare(contract.queries()[name](spark, SF), con, ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_covers_its_table(spark, name):
    got = QUERIES[name](spark, SF)
    if name == "op6_nearest_neighbours":
        asked = spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id % 20 = 0").count()
        assert got.groupBy("query_id").count().filter("count = 20").count() == asked
    else:
        ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
        assert ids(got) == ids(spark.read.parquet(f"{SF}/documents.parquet"))


def test_stages_keep_columns_and_only_their_own_rejects(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit(c) for c in ("score", "_size", "document", "kept")})
    extra = spark.createDataFrame([(None, None, None, None, None), (10_000, "", "en", None, 0)], docs.select(
        "doc_id", "text", "lang", "source", "n_chars").schema)
    docs = docs.unionByName(extra, allowMissingColumns=True)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        kept, had = Counter(r.doc_id for r in docs.collect()), Counter(r.doc_id for r in before.collect())
        if i < 4:
            assert docs.columns == before.columns
        if i < 3:
            assert kept <= had and sum(kept.values()) > 0.7 * sum(had.values()) and (i > 0 or kept[10_000] == 1)
        elif i == 3:
            assert set(kept) <= set(had) and max(kept.values()) <= 3
        else:
            assert kept == had


def test_near_duplicate_stage_keeps_one_of_each_group(spark, documents):
    text = "one two three four five six seven eight"
    docs = documents([(4, text), (2, text), (2, text), (9, text + " nine"), (3, "another text of five words"), (None, text), (5, None)])
    got = corpus_pipeline.keep_one_of_group(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 2, 3, 5]


def test_near_duplicate_stage_chooses_alike_among_texts_of_one_id(spark, documents):
    rows = [(2, f"text {i} " + " ".join(f"w{i}x{j}" for j in range(20))) for i in range(6)]
    got = [[r.text for r in corpus_pipeline.keep_one_of_group(spark, documents(order).repartition(n), SF).collect()]
           for order, n in ((rows, 1), (rows[::-1], 5))]
    assert len(got[0]) == 1 and got[0] == got[1]


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table(spark, documents, stage):
    assert stage(spark, documents([]), SF).count() == 0
