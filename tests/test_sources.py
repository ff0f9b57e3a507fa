import hashlib
import urllib.parse

import pytest
from pyspark.sql import functions as F

from catalens.operators import evidence as ev, prose as pr
from catalens.sources import integrity as ig, readers as rd, requests as rq, sinks as sk
from catalens.streaming.ingest import ingest_known_pages, ingest_pages


def test_malformed_lines_are_split_off(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": \n{"a": 2, "b": 3}\n')
    good, bad = rd.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a long")
    assert sorted(r.a for r in good.collect()) == [1, 2] and [r.line for r in bad.collect()] == ['{"a": ']


def test_coded_sheet_with_mark_fences_and_quotes(spark, tmp_path):
    (tmp_path / "s.csv").write_text('\ufeff```csv\n\nid,note\n1,"a, b"\r\n2,\n```\n', encoding="utf-8")
    (tmp_path / "t.csv").write_text('note,x, "id" \n"two\n\nlines, ""q""",9,3\n', encoding="utf-8")
    (tmp_path / "u.csv").write_text("", encoding="utf-8")
    assert sorted(map(tuple, rd.read_coded_csv(spark, str(tmp_path), ["id", "note", "none"]).collect())) == [
        ("1", "a, b", ""), ("2", "", ""), ("3", 'two\n\nlines, "q"', "")]


def test_arity_repair(spark):
    df = spark.createDataFrame([("1,C,x,y",), ("2,B,x,y",), ("3,C",), ("4,C,x,,y",), ("5,C,x,,y,z,w",)], "line string")
    out = rd.repair_arity(df, "line", ["i", "p", "a", "b", "c"], 2, F.get("cells", 1) == "C")
    assert [tuple(r) for r in out.orderBy("i").collect()] == [
        ("1", "C", "", "x", "y", True, []), ("2", "B", "x", "y", "", False, []), ("3", "C", "", "", "", False, []),
        ("4", "C", "x", "", "y", False, []), ("5", "C", "x", "", "y", False, ["z", "w"])]


def test_request_key_equals_form_encoding(spark):
    params = {"q": "a b*c~/é", "page": "1"}
    df = spark.createDataFrame([("https://x.example/y", params), ("https://x.example/y", None)], "u string, p map<string,string>")
    want = [hashlib.sha256(("https://x.example/y?" + urllib.parse.urlencode(sorted(p.items()))).encode()).hexdigest()[:32] for p in (params, {})]
    assert [r[0] for r in df.select(rq.request_key("u", "p")).collect()] == want


def test_file_digests_and_verification(spark, tmp_path):
    for name, body in (("a.txt", b"one"), ("b.tmp", b"x"), ("c.txt", b"two")):
        (tmp_path / name).write_bytes(body)
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache" / "d.txt").write_bytes(b"y")
    found = ig.digest_files(spark, str(tmp_path), root=f"{tmp_path.name}/", exclude_suffixes=(".tmp",))
    assert {r.path: r.sha256 for r in found.collect()} == {n: hashlib.sha256(b).hexdigest() for n, b in (("a.txt", b"one"), ("c.txt", b"two"))}
    assert tuple(ig.manifest_totals(found).first()) == (2, 6)
    manifest = spark.createDataFrame([("a.txt", hashlib.sha256(b"one").hexdigest()), ("c.txt", "0"), ("gone", "1"), ("null", None)], "path string, sha256 string")
    found = found.unionByName(spark.createDataFrame([("null", 3, None)], found.schema))
    checked = ig.verify_manifest(manifest, found)
    assert {r.path: r.status for r in checked.collect()} == {"a.txt": "ok", "c.txt": "MISMATCH", "gone": "MISSING", "null": "UNVERIFIED"}
    assert tuple(ig.verification_counts(checked).first()) == (1, 1, 1, 1)


def test_ingest_appends_only_new_pages(spark, tmp_path):
    pages = tmp_path / "in"
    pages.mkdir()
    (pages / "1.json").write_text('{"id": 1}\n{"id": 2}\n')
    args = (spark, str(pages), str(tmp_path / "out"), str(tmp_path / "cursor"), "id long")
    assert ingest_pages(*args).count() == 2
    assert ingest_pages(*args).count() == 2
    (pages / "2.json").write_text('{"id": 3}\n')
    assert sorted(r.id for r in ingest_pages(*args).collect()) == [1, 2, 3]


def test_a_page_is_known_by_its_content(spark, tmp_path):
    pages = tmp_path / "in"
    pages.mkdir()
    args = (spark, str(pages), str(tmp_path / "out"), str(tmp_path / "cursor"), "id long")
    (pages / "1.json").write_text('{"id": 1}\n\n{"id": 1}\n{"id": 2}\n')
    (pages / "2.json").write_text('{"id": 1}\n\n{"id": 1}\n{"id": 2}\n')
    (pages / "empty.json").write_text("")
    assert sorted(r.id for r in ingest_known_pages(*args).collect()) == [1, 1, 2]
    (pages / "3.json").write_text('{"id": 1}\n\n{"id": 1}\n{"id": 2}\n')
    (pages / "4.json").write_text('{"id": 2}\n')
    assert sorted(r.id for r in ingest_known_pages(*args).collect()) == [1, 1, 2, 2]


def test_files_beyond_a_cell_are_digested_in_chunks(spark, tmp_path):
    import hashlib

    (tmp_path / "small file.txt").write_bytes(b"small")
    with open(tmp_path / "large %41 file.bin", "wb") as f:
        f.truncate(2_000_000_001)  # sparse
    sha = hashlib.sha256()
    for _ in range(2000):
        sha.update(bytes(1_000_000))
    sha.update(b"\0")
    got = {r.path.rsplit("/", 1)[-1]: (r.bytes, r.sha256) for r in ig.digest_files(spark, str(tmp_path)).collect()}
    assert got == {"small file.txt": (5, hashlib.sha256(b"small").hexdigest()), "large %41 file.bin": (2_000_000_001, sha.hexdigest())}


def test_sinks_return_the_row_count(spark, tmp_path):
    assert sk.save_table(spark.range(7), str(tmp_path / "t")) == 7
    assert sk.save_table(spark.range(7), str(tmp_path / "p"), "parquet") == 7
    assert sk.save_jsonl(spark.range(3), str(tmp_path / "j")) == 3


def test_json_lines_are_compressed_and_keep_nulls(spark, tmp_path):
    rows = spark.range(5000).selectExpr("id as a_field_name", "cast(null as string) as another_field_name")
    assert sk.save_jsonl(rows, str(tmp_path / "z")) == 5000
    text = spark.read.text(str(tmp_path / "z"))
    assert text.where("value = '{\"a_field_name\":7,\"another_field_name\":null}'").count() == 1 and text.count() == 5000
    assert sum(f.stat().st_size for f in (tmp_path / "z").glob("part-*")) < 50_000 and sorted(rd.read_jsonl(
        spark, str(tmp_path / "z"), "a_field_name long, another_field_name string")[0].collect()) == sorted(rows.collect())


def test_claims(spark):
    table = spark.createDataFrame([("servers", 35.0), ("versions", 114.0)], "metric string, value double")
    table = table.unionByName(spark.createDataFrame([(f"m{i}", float(i)) for i in range(60)] + [("late", 114.0)], table.schema))
    claims = spark.createDataFrame(
        [("ok", "census", "metric", "servers", "value", 35.04), ("off", "census", "metric", "versions", "value", 115.0),
         ("late", "census", "metric", "m55", "value", 55.0), ("other column", "census", "metric", "114.0", "value", 7.0),
         ("row", "census", "metric", "x", "value", 1.0), ("table", "t", "metric", "x", "value", 1.0)],
        "label string, source string, key_field string, key_value string, field string, expected double")
    cells = ev.claim_cells({"census": (table, ["metric"])})
    assert {r.label: r.status for r in ev.check_claims(claims, cells).collect()} == {
        "ok": "ok", "off": "mismatch", "late": "ok", "other column": "row missing", "row": "row missing", "table": "table missing"}


def test_null_and_empty_cells_have_different_digests(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "")], "k int, t string")
    got = {r.k: r.sha256 for r in ig.digest_rows(df, "k", ["t"]).collect()}
    assert got[1] != got[2] == got[3]


def test_a_malformed_entry_fails_the_read(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"server": {"name": "a"}}\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        rd.read_entries(spark, str(tmp_path / "e.jsonl")).collect()


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from catalens import session

    class Unset:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        session.scratch_dir(Unset, "x")


def test_numbers_and_prose(spark):
    text = "The cat is not big but it was taken away. The dog sat, ran, and slept all day. Short one. Moreover it costs 1,200.0 or 7."
    df = spark.createDataFrame([(1, text), (2, None)], "i int, t string")
    assert {r.number for r in pr.numbers_in(df, "i", "t").collect()} == {"1200.0", "1200", "7."}
    p = {r.i: r for r in pr.prose_profile(df, "i", "t").collect()}
    assert (p[1].sentences, p[1].min_sentence_words, p[1].max_sentence_words, p[1].the_initial_sentences) == (3, 6, 10, 2)
    assert (p[1].formulaic_total, p[1].not_x_but_y, p[2].words, p[2].mean_sentence_words) == (1, 1, 0, 0.0)
    assert p[1].passive_per_1000_words > 0 and p[1].triads_per_1000_words > 0
