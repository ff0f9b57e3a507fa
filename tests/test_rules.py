import pytest
from pyspark.sql import functions as F

from catalens.functions import text as tx, vocab as vo
from catalens.functions.credentials import classify_credential, permissive_hint
from catalens.operators.security import adjudication_list, apply_adjudication, classify_declarations, secret_verdict

CASES = [
    ("ACME_API_KEY", None, "explicit", "credential"),
    ("ACME_TOKEN", None, "explicit", "credential"),
    ("ACME_TOKEN", "absolute path to the token", None, "declared-as-location"),
    ("SIGNING_KEY", None, "ambiguous", "credential"),
    ("FOREIGN_KEYS", None, None, "qualified"),
    ("CHARS_PER_TOKEN", None, None, "qualified"),
    ("PUBLIC_KEY", None, None, "public-by-name"),
    ("API_KEY_PATH", None, None, "no-credential-term"),
    ("TOKENIZER", None, None, "no-credential-term"),
    ("publicKey", None, None, "no-credential-term"),
    ("", None, None, "empty"),
    (None, None, None, "empty"),
    ("MAX_API_KEY", None, None, "qualified"),
    ("api-key", None, "explicit", "credential"),
    ("MY_PERSONAL_ACCESS_TOKEN", None, "explicit", "credential"),
    ("KEY", None, "ambiguous", "credential"),
]


def test_whole_word_rule_in_both_forms(spark):
    df = spark.createDataFrame([(i, n, d) for i, (n, d, _, _) in enumerate(CASES)], "i int, var_name string, var_description string")
    one = df.select("i", classify_credential("var_name", "var_description").alias("c")).select("i", "c.*")
    staged = classify_declarations(df).select("i", "credential_tier", "credential_reason")
    expected = [(i, t, r) for i, (_, _, t, r) in enumerate(CASES)]
    assert sorted(map(tuple, one.collect())) == expected
    assert sorted(map(tuple, staged.collect())) == expected


def test_loose_rule_reads_name_and_description(spark):
    df = spark.createDataFrame([("TOKENIZER", None), ("PORT", "token-bucket"), ("PORT", None), (None, None)], "n string, d string")
    assert [r[0] for r in df.select(permissive_hint("n", "d")).collect()] == [True, True, False, False]


def test_adjudication_only_demotes_names_the_rule_fires_on(spark):
    df = spark.createDataFrame(
        [("OURA_CREDENTIALS", False), ("ONE_CONNECTION_KEYS", True), ("DB_PASSWORD", False)], "var_name string, is_secret boolean"
    ).withColumn("var_description", F.lit(None).cast("string"))
    for audit in (None, adjudication_list(spark)):
        out = apply_adjudication(classify_declarations(df), audit)
        got = {r.var_name: (r.audit_demoted, r.credential_named, r.credential_named_unflagged) for r in out.collect()}
        assert got == {"OURA_CREDENTIALS": (True, False, False), "ONE_CONNECTION_KEYS": (True, False, False), "DB_PASSWORD": (False, True, True)}


def test_secret_verdict_per_server(spark):
    env = spark.createDataFrame(
        [("a", "API_KEY", True), ("a", "X_KEY", False), ("b", "API_KEY", False), ("c", "PORT", False)], "server string, var_name string, is_secret boolean")
    servers = spark.createDataFrame([(x,) for x in "abcd"], "name string")
    got = {r.name: r.verdict for r in secret_verdict(servers, env, "name", "server").collect()}
    assert got == {"a": "yes", "b": "no", "c": "n/a", "d": "n/a"}


@pytest.mark.parametrize("text, expected", [
    (r"a\nb   c\t\"q\" it\'s \\ end", 'a b c "q" it\'s \\ end'), (None, ""), ("x" * 950, "x" * 900), ("  a b ", "a b"),
])
def test_clean_description(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.clean_description("t", 900)).first()[0] == expected
    assert df.select(F.length(tx.clean_description("t")) >= len(expected)).first()[0]


@pytest.mark.parametrize("url, expected", [
    ("https://github.com/o/r.git", ("o", "r")), ("git@github.com:o/r", (None, None)), ("github.com/o/x.github.io", ("o", "x.github.io")),
    ("HTTP://WWW.GITHUB.COM/O/R#readme", ("O", "R")), ("https://example.org/o/r", (None, None)), (None, (None, None)),
])
def test_parse_repo_url(spark, url, expected):
    df = spark.createDataFrame([(url,)], "u string")
    assert tuple(df.select(tx.parse_repo_url("u").alias("r")).select("r.*").first()) == expected


def test_hosts(spark):
    df = spark.createDataFrame([("http://a.b?x=1",), ("https://1.2.3.4:80/x",), ("https://localhost/",), ("nothing",), (None,)], "u string")
    assert [r[0] for r in df.select(tx.url_host("u")).collect()] == ["a.b", "1.2.3.4", "localhost", None, None]
    assert df.select(tx.url_host("u", strict_compat=True)).first()[0] == "a.b?x=1"
    flags = [tuple(r[0]) for r in df.select(tx.url_flags("u")).collect()]
    assert flags == [(True, False, False), (False, True, False), (False, False, True), (False, False, False), (False, False, False)]


def test_vocabularies(spark):
    df = spark.createDataFrame([(" Yes ", "3.0", "N/A"), ("0", "junk", "Unclear"), ("maybe", "", "known"), (None, None, None)], "b string, n string, u string")
    got = df.select(vo.normalize_bool("b"), vo.to_int("n"), vo.collapse_undetermined("u"), vo.harmonise("u"), vo.presence("u")).collect()
    assert [tuple(r) for r in got] == [
        (True, 3, "undetermined", "N/A", "yes"), (False, None, "undetermined", "undetermined", "yes"),
        (None, None, "known", "known", "yes"), (None, None, "undetermined", "", "no")]


@pytest.mark.parametrize("raw, notes, server, expected", [
    ("anything", "", False, "not_a_server_or_no_tools"), ("regex 误报", "", True, "false_positive"), ("", "非工具", True, "false_positive"),
    ("漏 动态注册", "", True, "dynamic_registration"), ("AST-only", "", True, "extractor_miss"), ("", "", True, "none"),
    ("status_error", "", True, "other"), ("something else", "", True, "something else"), (None, None, True, "none"),
])
def test_classify_miss(spark, raw, notes, server, expected):
    df = spark.createDataFrame([(raw, notes, server)], "r string, n string, s boolean")
    assert df.select(vo.classify_miss("r", "n", "s")).first()[0] == expected


@pytest.mark.parametrize("kappa, band", [(None, "not estimable"), (-0.1, "poor"), (0.0, "slight"), (0.2, "fair"), (0.79, "substantial"), (0.8, "almost perfect")])
def test_kappa_band(spark, kappa, band):
    assert spark.createDataFrame([(kappa,)], "k double").select(vo.kappa_band("k")).first()[0] == band


def test_month_coercion(spark):
    df = spark.createDataFrame([("2024-03-05T10:00:00Z",), ("2024-03-05T10:00:00.123456Z",), ("soon",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.month_of("t")).collect()] == ["2024-03", "2024-03", None, None]
