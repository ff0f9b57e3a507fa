"""Key resolution, joins and set comparison over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalens.functions.vocab import presence
from catalens.operators import evidence as ev, extraction as ex, keys as k
from catalens.operators.coding import score_counts
from catalens.operators.sampling import with_item_ids
from catalens.plans import bindings as b
from catalens.plans.registry import Catalogue
from catalens.session import materialise

Q = Catalogue()

_LATEST = "name, title, description, version, repository_url, status, is_latest, published_at, has_packages, has_remotes, ordinal"


@Q.add("latest_per_key", "J1", f"SELECT {_LATEST} FROM latest")
def latest_per_key(s, d):
    return k.latest_per_key(b.versions(s, d), "name", "is_latest", "published_at", "ordinal").select(*_LATEST.split(", "))


@Q.add("collect_targets", "J2", """
SELECT registry_type, identifier, server_name, package_version, ordinal, line FROM packages WHERE is_latest AND registry_type IN ('npm', 'pypi')
QUALIFY row_number() OVER (PARTITION BY registry_type, identifier ORDER BY ordinal, line, server_name, package_version) = 1""")
def collect_targets(s, d):
    return k.collect_targets(
        b.packages(s, d), "registry_type", "identifier", ["ordinal", "line", "server_name", "package_version"], ("npm", "pypi"), "is_latest"
    ).select("registry_type", "identifier", "server_name", "package_version", "ordinal", "line")


_REPO_SQL = """
SELECT owner || '/' || repo AS repo_full_name, owner AS repo_owner, repo AS repo_name, name AS declared_by, repository_url AS declared_url
FROM (SELECT *, regexp_extract(repository_url, '^(?:https?://)?(?:www\\.)?github\\.com[/:]([^/]+)/([^/#?]+)', 1) AS owner,
  regexp_replace(regexp_extract(repository_url, '^(?:https?://)?(?:www\\.)?github\\.com[/:]([^/]+)/([^/#?]+)', 2), '\\.git$', '') AS repo FROM versions {where})
WHERE owner <> '' QUALIFY row_number() OVER (PARTITION BY owner, repo ORDER BY ordinal) = 1"""


@Q.add("collect_repos", "J3", _REPO_SQL.format(where=""))
def collect_repos(s, d):
    return k.collect_repos(b.versions(s, d), "repository_url", "name", "ordinal")


@Q.add("collect_repos_latest", "J3", _REPO_SQL.format(where="WHERE is_latest"))
def collect_repos_latest(s, d):
    return k.collect_repos(b.versions(s, d), "repository_url", "name", "ordinal", "is_latest")


@Q.add("dedupe_richest", "J4", """
SELECT package_key, tool_name, tool_description, has_schema, extraction_pattern, path FROM tools""")
def dedupe_richest(s, d):
    files = ex.select_source_files(b.source_files(s, d))
    return ex.extract_tools(files).select(
        "package_key", "tool_name", "tool_description", "has_schema", "extraction_pattern", "path"
    )


@Q.add("attach_counts", "J5", """
SELECT name, version, version_count, strftime(first_published_at, '%Y-%m-%d') AS first_published FROM latest_counts""")
def attach_counts(s, d):
    v = b.versions(s, d)
    latest = k.latest_per_key(v, "name", "is_latest", "published_at", "ordinal")
    return k.attach_counts(v, latest, "name", "published_at").select(
        "name", "version", "version_count", F.date_format("first_published_at", "yyyy-MM-dd").alias("first_published")
    )


@Q.add("latest_with_counts", "J1, J5", """
SELECT name, version, status, version_count, strftime(first_published_at, '%Y-%m-%d') AS first_published FROM latest_counts""")
def latest_with_counts(s, d):
    return k.latest_with_counts(b.versions(s, d), "name", "is_latest", "published_at", "ordinal").select(
        "name", "version", "status", "version_count", F.date_format("first_published_at", "yyyy-MM-dd").alias("first_published")
    )


@Q.add("attach_child_aggs", "J6", """
SELECT s_name AS server, n AS env_vars, sec AS secrets_declared, req AS required FROM supplier LEFT JOIN (
  SELECT server_name, count(var_name) AS n, count(*) FILTER (is_secret) AS sec, count(*) FILTER (is_required) AS req
  FROM declarations WHERE is_latest GROUP BY 1) ON server_name = 's' || s_suppkey""")
def attach_child_aggs(s, d):
    parent = b.table(s, d, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("key"), F.col("s_name").alias("server"))
    return k.attach_child_aggs(
        parent, b.declarations(s, d).where("is_latest"), "key", "server_name",
        {"env_vars": F.count("var_name"), "secrets_declared": F.count_if("is_secret"), "required": F.count_if("is_required")},
    ).drop("key")


def signals(s, d):
    """Version counts against zero-filled counts of expensive versions, for servers that declare a repository."""
    v = b.versions(s, d)
    latest = k.latest_with_counts(v, "name", "is_latest", "published_at", "ordinal").select("name", "version_count", "has_repository")
    resolved = latest.where("has_repository")
    counted = k.zero_fill_counts(latest, v.where(F.col("price") > 200000), resolved, "name", "b")
    return counted.select("name", F.col("version_count").alias("a"), "b")


def stored_signals(s, d):
    """The same as a written table of one narrow row per server, for reports that read it many times."""
    return materialise(signals(s, d), "signals")


@Q.add("zero_fill_counts", "J7", "SELECT name, a, b FROM signals")
def zero_fill_counts(s, d):
    return signals(s, d)


@Q.add("merge_codes", "J8, P15, P16, P17", """
SELECT doc_id, source AS registry_type, doc_id IN (SELECT doc_id FROM documents WHERE lang <> 'es') AS key_matched,
  quality = 1 AS is_server, CASE WHEN quality = 1 THEN n_actual ELSE 0 END AS n_actual, coalesce(n_extracted, 0) AS n_extracted,
  CASE WHEN quality = 1 THEN least(n_actual, coalesce(n_extracted, 0)) ELSE 0 END AS matched,
  greatest(0, CASE WHEN quality = 1 THEN n_actual ELSE 0 END - coalesce(n_extracted, 0)) AS under_extracted,
  greatest(0, coalesce(n_extracted, 0) - CASE WHEN quality = 1 THEN n_actual ELSE 0 END) AS over_extracted,
  CASE WHEN quality <> 1 THEN 'not_a_server_or_no_tools' WHEN toxic = 1 THEN 'dynamic_registration' WHEN lang = 'de' THEN 'extractor_miss'
    WHEN lang = 'fr' THEN 'false_positive' WHEN lang = 'es' THEN 'other' ELSE 'none' END AS miss_reason_taxonomy
FROM (SELECT l.doc_id, l.quality, l.toxic, o.lang, CASE WHEN o.lang <> 'es' THEN o.source END AS source, length(o.lang || o.source) AS n_actual,
  CASE WHEN o.lang <> 'es' THEN length(o.source) + l.toxic END AS n_extracted
  FROM labels l JOIN documents o USING (doc_id))""")
def merge_codes(s, d):
    docs, labels = b.table(s, d, "documents"), b.table(s, d, "labels")
    coded = labels.join(docs.select("doc_id", "lang", "source"), "doc_id").select(
        "doc_id",
        F.when(F.col("quality") == 1, " TRUE ").otherwise("no").alias("has_server_entrypoint"),
        F.concat(F.length(F.concat("lang", "source")).cast("string"), F.lit(".0")).alias("n_tools_actual"),
        F.when(F.col("toxic") == 1, "missed, dynamic names").when(F.col("lang") == "de", "AST-only tool")
        .when(F.col("lang") == "fr", "regex hit on a non-tool").when(F.col("lang") == "es", "metadata_error")
        .otherwise("").alias("miss_reason"),
        F.lit("").alias("notes"), "toxic", F.col("source").alias("_src"),
    )
    base = docs.where("lang <> 'es'").select("doc_id", F.col("source").alias("registry_type"), F.length("source").alias("n_source"))
    merged = k.merge_codes(base, coded, "doc_id", ["registry_type", "n_source"]).withColumn(
        "n_tools_extracted", (F.col("n_source") + F.col("toxic")).cast("string"))
    scored = score_counts(merged, "has_server_entrypoint", "n_tools_actual", "n_tools_extracted", "miss_reason", "notes")
    return scored.select("doc_id", "registry_type", "key_matched", "is_server", "n_actual", "n_extracted", "matched",
                         "under_extracted", "over_extracted", "miss_reason_taxonomy")


@Q.add("outer_merge_zero", "J9", """
SELECT coalesce(a.m, c.m) AS month, coalesce(a.n, 0) AS placed, coalesce(c.n, 0) AS shipped
FROM (SELECT strftime(o_orderdate, '%Y-%m') AS m, count(*) AS n FROM orders GROUP BY 1) a
FULL JOIN (SELECT strftime(l_shipdate, '%Y-%m') AS m, count(*) AS n FROM lineitem GROUP BY 1) c USING (m)""")
def outer_merge_zero(s, d):
    placed = b.table(s, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("placed"))
    shipped = b.table(s, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("shipped"))
    return k.outer_merge_zero(placed, shipped, "month")


def coder_sheets(s, d):
    """Two coders' sheets over the labelled documents; the part of an item follows from its language."""
    r = b.raters(s, d)
    part = F.when(F.col("lang") == "en", "B").otherwise("C")
    base = r.select(F.col("doc_id").alias("item_id"), part.alias("part"), "quality", "toxic", "n_chars", "lang")
    first = base.select(
        "item_id", "part",
        F.when(F.col("part") == "B", F.when(F.col("quality") == 1, "yes").otherwise("unclear")).alias("write_capability"),
        F.when(F.col("part") == "B", F.when(F.col("toxic") == 1, "yes").otherwise("no")).alias("destructive_capability"),
        F.when(F.col("part") == "C", F.when(F.col("quality") == 1, "yes").otherwise("")).alias("desc_states_purpose"),
    )
    second = base.select(
        "item_id",
        F.when(F.col("part") == "B", F.when(F.col("n_chars") >= 600, "yes").otherwise("undetermined")).alias("write_capability"),
        F.when(F.col("part") == "B", F.when(F.col("quality") == 0, "yes").otherwise("no")).alias("destructive_capability"),
        F.when(F.col("part") == "C", F.when(F.col("n_chars") >= 600, "yes").otherwise("n/a")).alias("desc_states_purpose"),
    )
    return first, second


FIELDS = {"write_capability": "B", "destructive_capability": "B", "desc_states_purpose": "C"}

PAIRS_SQL = """
sheet AS (SELECT doc_id AS item_id, CASE WHEN lang = 'en' THEN 'B' ELSE 'C' END AS part, quality, toxic, n_chars FROM raters),
pairs AS (SELECT item_id, part, 'write_capability' AS field, CASE WHEN quality = 1 THEN 'yes' ELSE 'unclear' END AS a,
    CASE WHEN n_chars >= 600 THEN 'yes' ELSE 'undetermined' END AS b FROM sheet WHERE part = 'B'
  UNION ALL SELECT item_id, part, 'destructive_capability', CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END, CASE WHEN quality = 0 THEN 'yes' ELSE 'no' END FROM sheet WHERE part = 'B'
  UNION ALL SELECT item_id, part, 'desc_states_purpose', CASE WHEN quality = 1 THEN 'yes' ELSE '' END, CASE WHEN n_chars >= 600 THEN 'yes' ELSE 'n/a' END FROM sheet WHERE part = 'C')"""


def coder_pairs(s, d):
    first, second = coder_sheets(s, d)
    return k.rater_pairs(first, second, "item_id", FIELDS, "part")


@Q.add("rater_pairs", "J10", f"WITH raters_ AS (SELECT 1 FROM raters), {PAIRS_SQL} SELECT item_id, part, field, a, b FROM pairs")
def rater_pairs(s, d):
    return coder_pairs(s, d)


@Q.add("rater_pairs_all_items", "J10", f"""WITH raters_ AS (SELECT 1 FROM raters), {PAIRS_SQL},
f AS (SELECT unnest(['write_capability', 'destructive_capability', 'desc_states_purpose']) AS field)
SELECT field, count(*) AS items, count(*) FILTER (coalesce(a, '') = coalesce(b, '')) AS same
FROM sheet JOIN f ON true LEFT JOIN pairs USING (item_id, field) GROUP BY 1""")
def rater_pairs_all_items(s, d):
    first, second = coder_sheets(s, d)
    pairs = k.rater_pairs(first, second, "item_id", FIELDS, "part", include_blank=True)
    return pairs.groupBy("field").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("a") == F.col("b")).alias("same"))


@Q.add("disagreements", "J11", f"WITH raters_ AS (SELECT 1 FROM raters), {PAIRS_SQL} SELECT item_id, part, field, a, b FROM pairs WHERE a <> b")
def disagreements(s, d):
    return k.disagreements(coder_pairs(s, d))


def tools_and_strict(s, d):
    files = ex.select_source_files(b.source_files(s, d))
    return files, ex.extract_tools(files), ex.extract_strict(files, ["package_key", "path"])


def stored_tools_and_strict(s, d):
    """Both extractors' results as written tables, for comparisons that read them several times, and the packages
    scanned with whether the second extractor, which reads Python only, could parse any of their files."""
    files, tools, strict = tools_and_strict(s, d)
    scanned = files.groupBy("package_key").agg(F.bool_or(F.col("language") == "python").alias("parsed"))
    return (materialise(tools.select("package_key", "tool_name"), "tools"),
            materialise(strict.select("package_key", "tool_name"), "strict"), scanned)


@Q.add("extractor_agreement", "J12", "SELECT * FROM agreed")
def extractor_agreement(s, d):
    tools, strict, scanned = stored_tools_and_strict(s, d)
    return k.extractor_agreement(tools, strict, "package_key", "tool_name", scanned=scanned)


@Q.add("extractor_agreement_links", "J12", """
SELECT page_id, bool_or(b) AS comparable, count(*) FILTER (a) AS items_a, CASE WHEN bool_or(b) THEN count(*) FILTER (b) END AS items_b,
  CASE WHEN bool_or(b) THEN count(*) FILTER (a AND NOT b) ELSE 0 END AS only_a, CASE WHEN bool_or(b) THEN count(*) FILTER (b AND NOT a) ELSE 0 END AS only_b,
  CASE WHEN bool_or(b) THEN coalesce(array_to_string(list_slice(list(href ORDER BY href) FILTER (a AND NOT b), 1, 12), '|'), '') ELSE '' END AS only_a_names,
  CASE WHEN bool_or(b) THEN coalesce(array_to_string(list_slice(list(href ORDER BY href) FILTER (b AND NOT a), 1, 12), '|'), '') ELSE '' END AS only_b_names
FROM (SELECT page_id, href, bool_or(side = 'a') AS a, bool_or(side = 'b') AS b FROM (SELECT page_id, href, 'a' AS side FROM links
  UNION ALL SELECT page_id, href, 'b' FROM strict_links) GROUP BY 1, 2) GROUP BY 1""")
def extractor_agreement_links(s, d):
    return k.extractor_agreement(b.links(s, d), b.links(s, d, b.STRICT_LINK), "page_id", "href")


@Q.add("siblings", "J13", """
SELECT a.page_id, a.href, len(l) - 1 AS sibling_count, array_to_string(list_slice(list_filter(l, lambda x: x <> a.href), 1, 3), ' ') AS siblings
FROM (SELECT DISTINCT page_id, href FROM links) a JOIN (SELECT page_id, list(DISTINCT href ORDER BY href) AS l FROM links GROUP BY 1) USING (page_id)""")
def siblings(s, d):
    return k.siblings(b.links(s, d), "page_id", "href", 3).withColumn("siblings", F.array_join("siblings", " "))


@Q.add("evidence_table", "J14, A19", """
WITH picked AS (SELECT server_name, 'B' || lpad(row_number() OVER (ORDER BY server_name)::VARCHAR, 3, '0') AS item_id FROM (
    SELECT DISTINCT server_name FROM declarations) WHERE true QUALIFY row_number() OVER (ORDER BY md5('7:' || server_name), server_name) <= 5),
 ptools AS (SELECT *, 'C' || lpad(row_number() OVER (ORDER BY server_name, tool_name)::VARCHAR, 3, '0') AS item_id FROM (
    SELECT server_name, tool_name FROM tools QUALIFY row_number() OVER (ORDER BY md5('7:' || tool_name), tool_name) <= 5)),
 picked2 AS (SELECT server_name, 'B' || lpad(row_number() OVER (ORDER BY server_name)::VARCHAR, 3, '0') AS item_id FROM picked)
SELECT item_id, 'manifest' AS section, 's_name' AS entry, s_name AS detail FROM picked2 JOIN supplier ON server_name = 's' || s_suppkey
UNION ALL SELECT item_id, 'manifest', 'nation', s_nationkey::VARCHAR FROM picked2 JOIN supplier ON server_name = 's' || s_suppkey
UNION ALL SELECT item_id, 'variable', var_name, CASE WHEN is_required THEN 'required' ELSE 'optional' END || ', ' || CASE WHEN is_secret THEN 'secret' ELSE 'not secret' END
  FROM picked2 JOIN declarations USING (server_name)
UNION ALL SELECT item_id, 'rule verdict', CASE WHEN count(*) FILTER (h) = 0 THEN 'n/a' WHEN count(*) FILTER (h AND is_secret) > 0 THEN 'yes' ELSE 'no' END,
  CASE WHEN count(*) FILTER (h) = 0 THEN 'declares variables, none credential-like' WHEN count(*) FILTER (h AND is_secret) > 0 THEN 'at least one credential-like variable flagged secret'
    ELSE 'credential-like variable declared but not flagged secret' END
  FROM picked2 JOIN (SELECT *, regexp_matches(lower(var_name), 'token|key|secret|password|passwd|credential|auth|pat|cookie|session|private|dsn') AS h FROM declarations) USING (server_name) GROUP BY item_id
UNION ALL SELECT item_id, 'description', 'complete', tool_description
  FROM ptools JOIN tools USING (server_name, tool_name)
UNION ALL SELECT item_id, 'siblings', (len(l) - 1)::VARCHAR, array_to_string(list_slice(list_filter(l, lambda x: x <> tool_name), 1, 25), ', ')
  FROM ptools JOIN (SELECT server_name, list(DISTINCT tool_name ORDER BY tool_name) AS l FROM tools GROUP BY 1) USING (server_name)""")
def evidence_table(s, d):
    from catalens.operators.sampling import seeded_sample

    env = b.declarations(s, d)
    tools = materialise(ex.extract_tools(ex.select_source_files(b.source_files(s, d))), "tools")
    servers = seeded_sample(env.select("server_name").distinct(), "server_name", 5, 7).select("server_name")
    items_b = with_item_ids(servers, "B", ["server_name"], 5).withColumn("tool_name", F.lit(None).cast("string"))
    some = seeded_sample(tools.select("server_name", "tool_name"), "tool_name", 5, 7).select("server_name", "tool_name")
    items_c = with_item_ids(some, "C", ["server_name", "tool_name"], 5)
    # The drawn sample is persisted, so every evidence section is read for the same items.
    items = materialise(items_b.unionByName(items_c), "items")
    latest = b.table(s, d, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("name"), "s_name", F.col("s_nationkey").alias("nation"))
    return ev.evidence_table(items, latest, env, tools, ["s_name", "nation"])


@Q.add("set_diff", "J15", """
SELECT key AS part_key, CASE WHEN max(l) = 1 AND max(r) = 1 THEN 'both' WHEN max(l) = 1 THEN 'left' ELSE 'right' END AS side
FROM (SELECT l_partkey AS key, 1 AS l, 0 AS r FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25
  UNION ALL SELECT p_partkey, 0, 1 FROM part) GROUP BY 1""")
def set_diff(s, d):
    used = b.table(s, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 25").select(F.col("l_partkey").alias("part_key"))
    return k.set_diff(used, b.table(s, d, "part").select(F.col("p_partkey").alias("part_key")), "part_key")


@Q.add("pending", "S8", """
SELECT DISTINCT c_custkey AS custkey, c_mktsegment AS segment FROM customer WHERE NOT EXISTS (
  SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)""")
def pending(s, d):
    targets = b.table(s, d, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("segment"))
    done = b.table(s, d, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("custkey"))
    return k.pending(targets, done, ["custkey"])


@Q.add("pending_counts", "S8", """
SELECT count(*) AS targets, count(*) FILTER (done) AS done, count(*) FILTER (NOT done) AS pending FROM (
  SELECT c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000) AS done FROM customer)""")
def pending_counts(s, d):
    targets = b.table(s, d, "customer").select(F.col("c_custkey").alias("custkey"))
    done = b.table(s, d, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("custkey"))
    return k.pending_counts(targets, done, ["custkey"])


@Q.add("list_presence", "P20, P23", """
SELECT page_id, len(list_filter(string_split(l, '|'), lambda x: trim(x) <> '')) AS items, CASE WHEN trim(l) <> '' THEN 'yes' ELSE 'no' END AS any_item
FROM (SELECT page_id, array_to_string(regexp_extract_all(html, '<a href="(/[A-Za-z]+)">', 1), '|') AS l FROM pages)""")
def list_presence(s, d):
    from catalens.functions.text import list_count

    cell = F.array_join(F.regexp_extract_all("html", F.lit(b.STRICT_LINK), F.lit(1)), "|")
    return b.table(s, d, "pages").select("page_id", cell.alias("l")).select(
        "page_id", list_count("l").cast("bigint").alias("items"), presence("l").alias("any_item"))
