"""Every registered query against its SQL on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "tools"))
import check_oracle  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
from catalens.plans.catalogue import all_queries  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = {n: q.sql for n, q in all_queries().items()}


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("test tables are not available")
    connection = duckdb.connect()
    for t in check_oracle.TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert check_oracle.compare(contract.queries()[name](spark, SF), con, SQL[name]) == ""


def test_prose_profile_equals_sql_on_dashes_openings_and_phrases(spark, tmp_path):
    texts = ["The dog--it ran--was not big but fed. The end of it all. An owl is seen at dusk.", "This is a--b. Notably, red, green, and blue are given here. Notably so, it is so.",
             "Été—the hot one—was not bad, but dry. It is in today's news.\n\nA b c d! B c d e? B c d e. C d e f. D e f g. E f g h. F g h i.", "--- ----- —", "", "plays a key role"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = contract.queries()["prose_profile"](spark, str(tmp_path))
    assert check_oracle.compare(got, db, SQL["prose_profile"]) == ""
    rows = {r.doc_id: r for r in got.collect()}
    assert (rows[0].em_dashes, rows[0].words, rows[0].top_sentence_openings) == (2, 22, "the:2, an:1")
    assert (rows[1].formulaic_detail, rows[2].top_sentence_openings, rows[3].words) == ("notably:2", "b:2, a:1, c:1, d:1, e:1", 4)
    assert rows[2].formulaic_detail == "in today's:1" and rows[2].not_x_but_y_per_1000_words > 0


def test_every_query_of_the_library_has_sql():
    assert all(SQL.values())


def test_entry_runs(spark):
    assert contract.entry(spark).columns == ["top_k_namespaces", "versions", "share_of_versions_pct"]
