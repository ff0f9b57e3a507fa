import random
import statistics

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from catalens import schemas
from catalens.functions.numeric import pct
from catalens.operators import agreement as ag, census as ce, coding as co, flatten as fl, keys as k, metric as me, sampling as sa, statistics as stt

CALM = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_latest_prefers_flag_then_time_then_first(spark):
    data = [("a", True, "2024-01-01", 1), ("a", False, "2025-01-01", 2), ("b", False, None, 3), ("b", False, "2024", 4), ("b", False, "2024", 5),
            ("", True, "x", 6), (None, True, "x", 7), ("c", None, None, 8)]
    df = spark.createDataFrame(data, "name string, is_latest boolean, published_at string, ordinal long")
    for _ in range(2):
        latest = k.latest_per_key(df, "name", "is_latest", "published_at", "ordinal")
        assert {r.name: r.ordinal for r in latest.collect()} == {"a": 1, "b": 4, "c": 8}
        fused = k.latest_with_counts(df, "name", "is_latest", "published_at", "ordinal")
        assert {r.name: (r.ordinal, r.version_count) for r in fused.collect()} == {"a": (1, 2), "b": (4, 3), "c": (8, 1)}
        random.Random(5).shuffle(data)
        df = spark.createDataFrame(data, df.schema)
    again = k.latest_per_key(latest, "name", "is_latest", "published_at", "ordinal")
    assert again.count() == latest.count()


def test_zero_fill_keeps_keys_without_events(spark):
    left = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    events = spark.createDataFrame([("a",), ("a",), ("z",)], "k string")
    resolved = spark.createDataFrame([("a",), ("b",)], "k string")
    assert sorted(map(tuple, k.zero_fill_counts(left, events, resolved, "k").collect())) == [("a", 2), ("b", 0)]


def test_pending_is_null_safe(spark):
    targets = spark.createDataFrame([("npm", None), ("npm", "a"), ("pypi", "b")], "t string, i string")
    done = spark.createDataFrame([("npm", None), ("pypi", "b"), ("pypi", "b"), ("oci", "q")], "t string, i string")
    assert [tuple(r) for r in k.pending(targets, done, ["t", "i"]).collect()] == [("npm", "a")]
    assert tuple(k.pending_counts(targets, done, ["t", "i"]).first()) == (3, 2, 1)


def test_extractor_agreement_sizes_add_up(spark):
    a = spark.createDataFrame([("p", "x"), ("p", "x"), ("p", "y"), ("q", "z")], "k string, i string")
    b = spark.createDataFrame([("p", "y"), ("p", "w"), ("r", None)], "k string, i string")
    got = {r.k: r for r in k.extractor_agreement(a, b, "k", "i").collect()}
    p = got["p"]
    assert (p.items_a, p.items_b, p.only_a, p.only_b, p.only_a_names, p.only_b_names) == (2, 2, 1, 1, "x", "w")
    assert p.items_a - p.only_a == p.items_b - p.only_b
    assert (got["q"].comparable, got["q"].items_b, got["q"].only_a) == (False, None, 0)
    assert (got["r"].comparable, got["r"].items_a, got["r"].items_b) == (True, 0, 0)
    scanned = spark.createDataFrame([("p", True), ("q", True), ("s", True), ("t", False)], "k string, parsed boolean")
    got = {r.k: r for r in k.extractor_agreement(a, b, "k", "i", scanned=scanned).collect()}
    assert (got["q"].items_a, got["q"].items_b, got["q"].only_a, got["q"].only_a_names) == (1, 0, 1, "z")  # a pure false positive
    assert (got["s"].items_a, got["s"].items_b) == (0, 0) and got["t"].items_b is None and set(got) == {"p", "q", "s", "t"}


def test_siblings_exclude_self(spark):
    df = spark.createDataFrame([("s", x) for x in "abcd"] + [("t", "a")], "p string, i string")
    got = {(r.p, r.i): (r.sibling_count, r.siblings) for r in k.siblings(df, "p", "i", 2).collect()}
    assert got[("s", "a")] == (3, ["b", "c"]) and got[("s", "d")] == (3, ["a", "b"]) and got[("t", "a")] == (0, [])


@CALM
@given(st.lists(st.one_of(st.integers(-50, 50), st.floats(-1e6, 1e6, allow_nan=False)), min_size=1, max_size=60))
def test_quantiles_equal_linear_interpolation(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = me.exact_quantiles(df, "v", {"p50": 0.5, "p90": 0.9}).first()
    ordered = sorted(float(v) for v in values)
    at = 0.9 * (len(ordered) - 1)
    low = int(at)
    high = min(low + 1, len(ordered) - 1)
    assert abs(got.p50 - statistics.median(ordered)) < 1e-6
    assert abs(got.p90 - (ordered[low] + (ordered[high] - ordered[low]) * (at - low))) < 1e-6


def test_quantiles_of_nothing_and_of_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", -5.0), ("b", None)], "g string, v double")
    assert {r.g: r.m for r in me.exact_quantiles(df, "v", {"m": 0.5}, ["g"]).collect()} == {"a": 1.5, "b": -5.0}
    assert me.exact_quantiles(df.where("false"), "v", {"m": 0.5}, ["g"]).count() == 0


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([(49, 400), (0, 0)], "p long, w long")
    assert [r[0] for r in df.select(pct("p", "w")).collect()] == [12.2, 0.0]


def test_release_gaps_cross_bucket_borders(spark):
    days = ["2024-01-30T00:00:00Z", "2024-01-31T00:00:00Z", "2024-03-01T00:00:00Z", "2024-03-01T12:00:00Z", "bad", None]
    df = spark.createDataFrame([("a", d) for d in days] + [("b", days[0]), (None, days[0])], "name string, t string")
    for bucket in ("yyyy", "yyyy-MM", "yyyy-MM-dd"):
        assert sorted(r.gap_days for r in ce.release_gaps(df, "name", "t", bucket).collect()) == [0.5, 1.0, 30.0]


def test_churn_matches_ranked_groups(spark):
    rng = random.Random(3)
    data = [(f"g{int(rng.paretovariate(0.8)) % 40}",) for _ in range(900)]
    got = {r[0]: r[1] for r in ce.churn_concentration(spark.createDataFrame(data, "g string"), "g").collect()}
    sizes = sorted((sum(1 for x in data if x == (g,)) for g in {x[0] for x in data}), reverse=True)
    assert [got[str(n)] for n in (1, 5, 10, 25, 50, 100)] == [sum(sizes[:n]) for n in (1, 5, 10, 25, 50, 100)]
    half = max(1, len(sizes) // 2)
    assert got[f"bottom 50% of namespaces ({half})"] == sum(sizes[-half:])


def test_reports_keep_their_rows_on_empty_input(spark):
    empty = spark.createDataFrame([], "name string, published_at string, version_count long, description string, title string")
    assert ce.staleness(empty, "2024-01-01").count() == 6
    assert [r.value for r in ce.release_cadence(empty, "name", "published_at").collect()][:1] == [0.0]
    assert [r.servers for r in ce.description_issues(empty, "description", "title").collect()] == [0.0, 0.0, 0.0]


def test_kappa_perfect_constant_and_known(spark):
    pairs = [("same", "x", "x"), ("same", "y", "y"), ("constant", "x", "x"), ("constant", "x", "x")]
    pairs += [("known", a, b) for a, b in [("y", "y")] * 20 + [("y", "n")] * 5 + [("n", "y")] * 10 + [("n", "n")] * 15]
    got = {r.field: r for r in ag.cohens_kappa(spark.createDataFrame(pairs, "field string, a string, b string")).collect()}
    assert got["same"].kappa == 1.0 and got["constant"].kappa is None and got["constant"].expected == 1.0
    assert abs(got["known"].kappa - 0.4) < 1e-12 and got["known"].items == 50


def test_pairs_stay_inside_their_part(spark):
    schema = "item_id string, part string, f string, g string"
    a = spark.createDataFrame([("1", "B", "yes", ""), ("2", "C", "", "no"), ("3", "B", "no", "")], schema)
    b = spark.createDataFrame([("1", "B", "no", ""), ("2", "C", "", "no")], schema)
    pairs = k.rater_pairs(a, b, "item_id", {"f": "B", "g": "C"}, "part")
    assert sorted((r.item_id, r.field, r.a, r.b) for r in pairs.collect()) == [("1", "f", "yes", "no"), ("2", "g", "no", "no")]
    assert k.rater_pairs(a, b, "item_id", {"f": "B", "g": "C"}, "part", include_blank=True).count() == 4
    assert k.disagreements(pairs).count() == 1


def test_excluded_items_form_their_own_variant(spark):
    pairs = spark.createDataFrame([("1", "f", "a", "a"), ("2", "f", "a", "b"), ("3", "f", "b", "b")], "item_id string, field string, a string, b string")
    out = ag.agreement_report(pairs, {"raw": (lambda c: c, lambda c: c)}, spark.createDataFrame([("2",)], "item_id string"))
    assert {r.variant: (r.items, r.observed_agreement) for r in out.collect()} == {"raw": (3, 0.667), "without excluded items": (2, 1.0)}


@CALM
@given(st.integers(1, 60), st.integers(0, 10_000))
def test_stratified_sample_has_the_asked_size(spark, n, seed):
    df = spark.range(80).select("id", F.when(F.col("id") < 50, "a").when(F.col("id") < 78, "b").when(F.col("id") < 79, "c").alias("s"))
    picked = [r.id for r in sa.stratified_sample(df, "s", "id", n, seed).collect()]
    assert len(picked) == n == len(set(picked))
    assert sorted(picked) == sorted(r.id for r in sa.stratified_sample(df.repartition(7), "s", "id", n, seed).collect())


def test_seeded_sample_reports_sizes(spark):
    out = sa.seeded_sample(spark.range(5), "id", 9, 1)
    assert out.count() == 5 and tuple(out.select("population_size", "sample_size").first()) == (5, 5)


def test_spearman_with_ties(spark):
    x, y = [1, 2, 2, 3, 5, 5, 5, 9], [2, 1, 4, 4, 4, 9, 7, 7]
    rank = lambda v: [sum(o < e for o in v) + (v.count(e) + 1) / 2 for e in v]
    df = spark.createDataFrame(list(zip(x, y)), "x long, y long")
    assert abs(stt.spearman(df, "x", "y").first().rho - statistics.correlation(rank(x), rank(y))) < 1e-12
    assert stt.spearman(df.withColumn("y", F.lit(1)), "x", "y").first().rho is None


def test_bootstrap_intervals_cover_the_share(spark):
    df = spark.range(300).select((F.col("id") < 90).alias("flag"), (F.col("id") % 30).alias("c"))
    plain = stt.bootstrap_proportion(df, {"q": F.col("flag")}, 400, 7).first()
    assert plain.value_pct == 30.0 and 23 < plain.ci95_low < 27 and 33 < plain.ci95_high < 37 and plain.n == 300
    clustered = stt.bootstrap_cluster(df, {"q": (F.col("flag"), F.lit(True))}, "c", 400, 7).first()
    assert clustered.value_pct == 30.0 and clustered.ci95_low <= 30.0 <= clustered.ci95_high
    many = stt.bootstrap_proportion(spark.range(40_000).select((F.col("id") < 12_000).alias("flag")), {"q": F.col("flag")}, 400, 7).first()
    assert abs(many.ci95_low - 29.55) < 0.15 and abs(many.ci95_high - 30.45) < 0.15


def test_cluster_weights_move_whole_clusters(spark):
    df = spark.range(1000).select((F.col("id") % 10 == 0).alias("flag"), (F.col("id") % 10).alias("c"))
    wide = stt.bootstrap_cluster(df, {"q": (F.col("flag"), F.lit(True))}, "c", 400, 1).first()
    narrow = stt.bootstrap_proportion(df, {"q": F.col("flag")}, 400, 1).first()
    assert wide.ci95_high - wide.ci95_low > 3 * (narrow.ci95_high - narrow.ci95_low)


def test_validate_enum_reports_blank_and_foreign_values(spark):
    df = spark.createDataFrame([("1", "B", "broad", "maybe"), ("2", "B", "", "yes"), ("3", "C", "", "")], "item string, part string, scope_breadth string, write_capability string")
    out = co.validate_enum(df, "item", {"scope_breadth": "B", "write_capability": "B"}, "part")
    assert sorted((r.item, r.field, r.problem) for r in out.collect()) == [("1", "write_capability", "not permitted"), ("2", "scope_breadth", "blank")]


def test_flatten_handles_missing_blocks(spark, tmp_path):
    path = tmp_path / "e.jsonl"
    path.write_text(
        '{"server": {"name": "n/a", "version": "1"}}\n\n'
        '{"server": {"name": "x/y", "$schema": "s", "repository": {"url": ""}, "packages": [{"registryType": "npm", "transport": {"type": "stdio"}, '
        '"environmentVariables": [{"name": "A", "isSecret": true}, {"name": "B"}]}, {"registryType": "npm"}], "remotes": [{"type": "stdio", "url": "u"}, {"type": "sse"}]}, '
        '"_meta": {"z.example/official": {"status": "active", "isLatest": true}, "z.example/other": {"status": "no"}}}\n')
    df = spark.read.schema(schemas.ENTRY).json(str(path))
    got = {r.name: r for r in fl.flatten_entries(df).collect()}
    assert len(fl.flatten_entries(df).columns) == 22
    full, bare = got["x/y"], got["n/a"]
    assert (full.registry_types, full.transports, full.env_var_count, full.package_count, full.remote_count) == (["npm"], ["sse", "stdio"], 2, 2, 2)
    assert (full.is_latest, full.status, full.has_repository, full.schema) == (True, "active", False, "s")
    assert (bare.registry_types, bare.env_var_count, bare.is_latest, bare.has_packages, bare.status) == ([], 0, False, False, None)
    assert [(r.var_name, r.is_secret, r.is_required) for r in fl.extract_env_vars(df).orderBy("var_name").collect()] == [("A", True, False), ("B", False, False)]
    assert fl.extract_packages(df).count() == 2 and fl.extract_remotes(df).count() == 2


def test_rater_subset_goes_by_number(spark):
    from catalens.operators import sampling

    items = lambda p: spark.createDataFrame([(f"{p}{i:03d}", f"t{i}") for i in range(1, 1201)], "item_id string, target string")
    got = {r.item_id for r in sampling.rater_subset(items("B"), items("C"), 2100, "target", "target").collect()}
    assert got == {f"B{i:03d}" for i in range(1, 1051)} | {f"C{i:03d}" for i in range(1, 1051)}
