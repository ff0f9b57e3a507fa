"""Census, endpoint, evolution, credential, interface and coding reports over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalens import fixed_values as fx
from catalens.functions import text as tx, vocab as vo
from catalens.operators import census as ce, coding as co, extraction as ex, interface as it, keys as k, security as se
from catalens.plans import bindings as b
from catalens.plans.oracle_views import any_of, pct, quoted, words
from catalens.plans.queries_keys import signals, stored_signals, stored_tools_and_strict, tools_and_strict
from catalens.plans.registry import Catalogue

Q = Catalogue()


def latest(s, d):
    return k.latest_with_counts(b.versions(s, d), "name", "is_latest", "published_at", "ordinal")


def rows(label: str, value: str, entries, extra: str = "") -> str:
    """UNION ALL of (label, value, ...) rows from one-row CTE expressions."""
    return " UNION ALL ".join(f"SELECT '{name.replace(chr(39), chr(39) * 2)}' AS {label}, {expr} {extra}" for name, expr in entries)


# --- census ---------------------------------------------------------------------------------------
@Q.add("census_overview", "A1, P11", """
WITH l AS (SELECT count(*) AS n, count(*) FILTER (has_packages) AS p, count(*) FILTER (has_remotes) AS r, count(*) FILTER (has_repository) AS g,
  count(*) FILTER (status = 'deprecated') AS x, count(DISTINCT split_part(name, '/', 1)) AS ns FROM latest), v AS (SELECT count(*) AS vn FROM versions)
SELECT u.metric, u.value::DOUBLE AS value, u.share::DOUBLE AS share_of_servers_pct FROM l, v, LATERAL (VALUES
 ('published_server_names', n, 100.0), ('published_versions', vn, NULL), ('versions_per_server_mean', round_even(vn::DOUBLE / n, 2), NULL),
 ('servers_with_packages', p, round_even(100.0::DOUBLE * p / n, 1)), ('servers_with_remote_endpoint', r, round_even(100.0::DOUBLE * r / n, 1)),
 ('servers_with_repository', g, round_even(100.0::DOUBLE * g / n, 1)), ('servers_deprecated', x, round_even(100.0::DOUBLE * x / n, 1)),
 ('distinct_namespaces', ns, NULL)) u(metric, value, share)""")
def census_overview(s, d):
    v = b.versions(s, d)
    return ce.census_overview(v, k.latest_per_key(v, "name", "is_latest", "published_at", "ordinal"))


@Q.add("field_completeness", "A2", """
WITH l AS (SELECT count(*) AS n, count(description) AS d, count(title) AS t, count(*) FILTER (has_repository) AS r, count(*) FILTER (has_website) AS w FROM latest)
SELECT u.field, u.p AS present, n - u.p AS missing, round_even(100.0::DOUBLE * u.p / n, 1) AS present_pct FROM l, LATERAL (VALUES
 ('description', d), ('title', t), ('repository', r), ('websiteUrl', w)) u(field, p)""")
def field_completeness(s, d):
    return ce.field_completeness(latest(s, d), {
        "description": F.col("description").isNotNull(), "title": F.col("title").isNotNull(),
        "repository": F.col("has_repository"), "websiteUrl": F.col("has_website"),
    })


_NS = """SELECT split_part(name, '/', 1) AS namespace, count(DISTINCT name) AS servers, count(*) AS versions, count(DISTINCT name) >= {m} AS recurring
FROM latest GROUP BY 1"""


@Q.add("namespace_concentration", "A3", _NS.format(m=3) + " ORDER BY servers DESC, namespace LIMIT 25")
def namespace_concentration(s, d):
    return ce.namespace_concentration(latest(s, d))


@Q.add("namespace_members", "A3", _NS.format(m=12))
def namespace_members(s, d):
    return ce.namespace_members(latest(s, d), min_servers=12)


@Q.add("recurring_share", "A3", f"""
SELECT count(*) FILTER (recurring) AS recurring_namespaces, coalesce(sum(servers) FILTER (recurring), 0)::BIGINT AS servers_held,
  {pct('coalesce(sum(servers) FILTER (recurring), 0)', 'sum(servers)')} AS share_pct FROM ({_NS.format(m=12)})""")
def recurring_share(s, d):
    return ce.recurring_share(latest(s, d), min_servers=12)


@Q.add("multivalue_distribution", "A4", f"""
SELECT word, count(*) AS parts, count(DISTINCT p_brand) AS brands, {pct('count(*)', '(SELECT count(*) FROM part)')} AS parts_pct
FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS word FROM part) WHERE word <> '' GROUP BY 1""")
def multivalue_distribution(s, d):
    return ce.multivalue_distribution(
        b.table(s, d, "part"), F.split("p_name", " "), "p_brand", ("word", "parts", "brands", "parts_pct"))


@Q.add("category_distribution", "A5", f"""
SELECT registry_type, count(*) AS packages, count(DISTINCT server_name) AS servers, {pct('count(*)', '(SELECT count(*) FROM packages)')} AS packages_pct
FROM packages GROUP BY 1""")
def category_distribution(s, d):
    return ce.category_distribution(
        b.packages(s, d), "registry_type", "server_name", ("registry_type", "packages", "servers", "packages_pct"))


@Q.add("schema_adoption", "A6", f"""
SELECT coalesce(nullif(regexp_extract(schema, '/schemas/([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})/', 1), ''), 'unknown') AS schema_version, count(*) AS versions,
  count(DISTINCT name) AS servers, {pct('count(*)', '(SELECT count(*) FROM versions)')} AS versions_pct FROM versions GROUP BY 1""")
def schema_adoption(s, d):
    return ce.schema_adoption(b.versions(s, d), "schema", "name")


@Q.add("publishing_timeline", "A7, P14, J9", """
WITH m AS (SELECT strftime(placed_at, '%Y-%m') AS month, count(*) AS nv FROM versions GROUP BY 1),
 f AS (SELECT month, count(*) AS ns FROM (SELECT name, min(strftime(placed_at, '%Y-%m')) AS month FROM versions GROUP BY 1) GROUP BY 1)
SELECT coalesce(m.month, f.month) AS month, coalesce(nv, 0)::BIGINT AS new_versions, coalesce(ns, 0)::BIGINT AS new_servers,
  sum(coalesce(ns, 0)) OVER (ORDER BY coalesce(m.month, f.month))::BIGINT AS cumulative_servers,
  sum(coalesce(nv, 0)) OVER (ORDER BY coalesce(m.month, f.month))::BIGINT AS cumulative_versions FROM m FULL JOIN f ON m.month = f.month""")
def publishing_timeline(s, d):
    return ce.publishing_timeline(b.versions(s, d), "name", "published_at")


@Q.add("count_distribution", "A8", f"""
SELECT version_count AS versions_published, count(*) AS servers, {pct('count(*)', '(SELECT count(*) FROM latest)')} AS servers_pct FROM latest_counts GROUP BY 1""")
def count_distribution(s, d):
    return ce.count_distribution(latest(s, d), "version_count")


@Q.add("capped_histogram", "A9", """
SELECT least(version_count, 16)::BIGINT AS versions, count(*) AS servers FROM latest_counts GROUP BY 1""")
def capped_histogram(s, d):
    return ce.capped_histogram(latest(s, d), "version_count", 15, ("versions", "servers"))


@Q.add("description_issues", "A10", f"""
WITH l AS (SELECT count(*) AS n, count(*) FILTER (coalesce(description, '') = '') AS a, count(*) FILTER ({words('description')} < 5) AS b,
  count(*) FILTER (lower(trim(coalesce(description, ''))) = lower(trim(coalesce(title, '')))) AS c FROM versions)
SELECT u.issue, u.v::DOUBLE AS servers, round_even(100.0::DOUBLE * u.v / n, 1) AS servers_pct FROM l, LATERAL (VALUES
 ('missing description', a), ('fewer than 5 words', b), ('identical to title', c)) u(issue, v)""")
def description_issues(s, d):
    return ce.description_issues(b.versions(s, d), "description", "title")


@Q.add("page_title_issues", "A10", f"""
WITH t AS (SELECT nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '') AS h, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS t FROM pages),
 l AS (SELECT count(*) AS n, count(*) FILTER (coalesce(h, '') = '') AS a, count(*) FILTER ({words('h')} < 5) AS b,
  count(*) FILTER (lower(trim(coalesce(h, ''))) = lower(trim(coalesce(t, '')))) AS c FROM t)
SELECT u.issue, u.v::DOUBLE AS servers, round_even(100.0::DOUBLE * u.v / n, 1) AS servers_pct FROM l, LATERAL (VALUES
 ('missing description', a), ('fewer than 5 words', b), ('identical to title', c)) u(issue, v)""")
def page_title_issues(s, d):
    p = b.table(s, d, "pages").select(
        F.nullif(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), F.lit("")).alias("h"),
        F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")).alias("t"))
    return ce.description_issues(p, "h", "t")


@Q.add("description_stats", "A11", f"""
WITH l AS (SELECT avg(length(text)) AS m, quantile_cont(length(text), 0.5) AS p50, quantile_cont(length(text), 0.9) AS p90, avg({words('text')}) AS w FROM documents)
SELECT u.statistic, round_even(u.v::DOUBLE, 1) AS value FROM l, LATERAL (VALUES ('description length (chars)', m), ('description length p50', p50),
 ('description length p90', p90), ('description words (mean)', w)) u(statistic, v)""")
def description_stats(s, d):
    return ce.description_stats(b.table(s, d, "documents"), "text")


def _page_names(s, d):
    """Link targets of every page as published names."""
    href = F.regexp_replace("href", "^/", "")
    return b.links(s, d).select(F.concat(F.lit("io.page"), F.when(F.length("href") > 6, "/").otherwise("_"), href).alias("name"))


@Q.add("naming_conventions", "A12, P24", """
WITH n AS (SELECT 'io.page' || CASE WHEN length(href) > 6 THEN '/' ELSE '_' END || regexp_replace(href, '^/', '') AS name FROM links),
 p AS (SELECT contains(name, '/') AS s, contains(name, '/') AND NOT contains(split_part(name, '/', 1), '.') AS nd, split_part(name, '/', -1) AS x FROM n),
 l AS (SELECT count(*) AS n, count(*) FILTER (NOT s) AS a, count(*) FILTER (nd) AS b, count(*) FILTER (regexp_matches(x, '[A-Z]')) AS c,
  count(*) FILTER (contains(x, ' ')) AS e, count(*) FILTER (contains(x, '_')) AS f FROM p)
SELECT u.pattern, u.v::DOUBLE AS servers, round_even(100.0::DOUBLE * u.v / n, 1) AS servers_pct FROM l, LATERAL (VALUES ('no slash separator', a),
 ('namespace without dot (not reverse-DNS)', b), ('uppercase in server segment', c), ('space in server segment', e), ('underscore in server segment', f)) u(pattern, v)""")
def naming_conventions(s, d):
    return ce.naming_conventions(_page_names(s, d), "name")


@Q.add("name_flags", "P24, P11", """
SELECT doc_id, name, split_part(name, '/', 1) AS namespace, split_part(name, '/', -1) AS local_part, contains(name, '_') AS underscore,
 regexp_matches(name, '[a-z][A-Z]') AS camel, contains(name, '-') AS dash, regexp_matches(name, '^[a-z]+[_-][a-z]') AS verb_noun
FROM (SELECT doc_id, replace(text, ' ', '_') AS name FROM documents)""")
def name_flags(s, d):
    named = b.table(s, d, "documents").select("doc_id", F.replace("text", F.lit(" "), F.lit("_")).alias("name"))
    return named.select("doc_id", "name", tx.name_parts("name").alias("p"), tx.identifier_flags("name").alias("f")).select(
        "doc_id", "name", "p.*", "f.*")


# --- endpoints ------------------------------------------------------------------------------------
@Q.add("url_flags", "P24", """
SELECT page_id, nullif(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1), '') AS scheme,
 CASE page_id % 7 WHEN 0 THEN '10.1.2.3' WHEN 1 THEN 'localhost' ELSE nullif(regexp_extract(url, '://([^/:?#]+)', 1), '') END AS host,
 starts_with(url, 'http:') AS plaintext, page_id % 7 = 0 AS bare_ip, page_id % 7 = 1 AS localhost FROM pages""")
def url_flags(s, d):
    """Pages, every seventh on a bare address and every seventh on the local host."""
    host = F.when(F.col("page_id") % 7 == 0, "://10.1.2.3").when(F.col("page_id") % 7 == 1, "://localhost")
    pages = b.table(s, d, "pages").withColumn(
        "url", F.when(F.col("page_id") % 7 < 2, F.regexp_replace("url", F.lit("://[^/:?#]+"), host)).otherwise(F.col("url")))
    return pages.select(
        "page_id", tx.url_scheme("url").alias("scheme"), tx.url_host("url").alias("host"), tx.url_flags("url").alias("f")
    ).select("page_id", "scheme", "host", "f.*")


@Q.add("parse_repo_url", "P12", """
SELECT ordinal, nullif(regexp_extract(repository_url, '(?i)^(?:https?://)?(?:www\\.)?github\\.com[/:]([^/]+)/([^/#?]+)', 1), '') AS owner,
 nullif(regexp_replace(regexp_extract(repository_url, '(?i)^(?:https?://)?(?:www\\.)?github\\.com[/:]([^/]+)/([^/#?]+)', 2), '\\.git$', ''), '') AS repo FROM versions""")
def parse_repo_url(s, d):
    return b.versions(s, d).select("ordinal", tx.parse_repo_url("repository_url").alias("r")).select("ordinal", "r.*")


@Q.add("endpoint_hygiene", "A20", """
WITH l AS (SELECT count(*) AS n, count(DISTINCT server_name) AS s, count(*) FILTER (lower(scheme) = 'http') AS p,
  count(*) FILTER (regexp_matches(coalesce(host, ''), '^\\d{1,3}(\\.\\d{1,3}){3}$')) AS i, count(*) FILTER (host IN ('localhost', '127.0.0.1', '0.0.0.0', '::1')) AS o,
  count(DISTINCT host) AS h FROM hosts)
SELECT u.metric, u.v::DOUBLE AS value, CASE WHEN u.f THEN round_even(100.0::DOUBLE * u.v / n, 1) END AS share_pct FROM l, LATERAL (VALUES
 ('remote endpoints', n, true), ('servers with a remote endpoint', s, false), ('plaintext http endpoints', p, true),
 ('endpoints on a bare IP address', i, true), ('endpoints pointing at localhost', o, true), ('distinct hosts', h, false)) u(metric, v, f)""")
def endpoint_hygiene(s, d):
    return ce.endpoint_hygiene(b.endpoints(s, d), "remote_url", "server_name")


@Q.add("top_hosts", "A21", """
SELECT host, count(*) AS endpoints, count(DISTINCT server_name) AS servers FROM hosts WHERE host IS NOT NULL GROUP BY 1 ORDER BY servers DESC, host LIMIT 30""")
def top_hosts(s, d):
    return ce.top_hosts(b.endpoints(s, d), "remote_url", "server_name")


# --- evolution ------------------------------------------------------------------------------------
@Q.add("release_cadence", "A23", """
WITH l AS (SELECT count(*) AS n, avg(g) AS m, quantile_cont(g, 0.5) AS p50, quantile_cont(g, 0.9) AS p90, count(*) FILTER (g < 1) AS a, count(*) FILTER (g > 180) AS z FROM gaps)
SELECT u.statistic, u.v::DOUBLE AS value FROM l, LATERAL (VALUES ('release-to-release gaps', n::DOUBLE), ('mean gap (days)', round_even(m, 1)),
 ('median gap (days)', round_even(p50, 1)), ('p90 gap (days)', round_even(p90, 1)), ('gaps under 1 day', a::DOUBLE), ('gaps over 180 days', z::DOUBLE)) u(statistic, v)""")
def release_cadence(s, d):
    return ce.release_cadence(b.versions(s, d), "name", "published_at")


@Q.add("event_cadence", "A23", """
WITH g AS (SELECT (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)))::DOUBLE / 86400000000.0::DOUBLE AS g FROM events),
 l AS (SELECT count(g) AS n, avg(g) AS m, quantile_cont(g, 0.5) AS p50, quantile_cont(g, 0.9) AS p90, count(*) FILTER (g < 1) AS a, count(*) FILTER (g > 180) AS z FROM g WHERE g IS NOT NULL)
SELECT u.statistic, u.v::DOUBLE AS value FROM l, LATERAL (VALUES ('release-to-release gaps', n::DOUBLE), ('mean gap (days)', round_even(m, 1)),
 ('median gap (days)', round_even(p50, 1)), ('p90 gap (days)', round_even(p90, 1)), ('gaps under 1 day', a::DOUBLE), ('gaps over 180 days', z::DOUBLE)) u(statistic, v)""")
def event_cadence(s, d):
    return ce.release_cadence(b.table(s, d, "events"), "user_id", "ts")


@Q.add("staleness", "A24", f"""
WITH l AS (SELECT version_count <= 1 AS s, (epoch_us(TIMESTAMP '{b.AS_OF}') - epoch_us(placed_at))::DOUBLE / 86400000000.0::DOUBLE AS x FROM latest_counts),
 c AS (SELECT count(*) AS n, count(*) FILTER (s) AS a, count(*) FILTER (NOT s AND x <= 30) AS b, count(*) FILTER (NOT s AND x > 30 AND x <= 90) AS c,
  count(*) FILTER (NOT s AND x > 90 AND x <= 180) AS e, count(*) FILTER (NOT s AND x > 180 AND x <= 365) AS f, count(*) FILTER (NOT s AND x > 365) AS g FROM l)
SELECT u.bucket, u.v::DOUBLE AS servers, round_even(100.0::DOUBLE * u.v / n, 1) AS servers_pct FROM c, LATERAL (VALUES ('single version, never updated again', a),
 ('multiple versions, last publish <= 30 days', b), ('multiple versions, 31-90 days', c), ('multiple versions, 91-180 days', e),
 ('multiple versions, 181-365 days', f), ('multiple versions, > 365 days', g)) u(bucket, v)""")
def staleness(s, d):
    return ce.staleness(latest(s, d), b.AS_OF)


@Q.add("deprecations", "A25", """
SELECT name AS server_name, version AS last_version, published_at, status_changed_at, version_count AS versions_published FROM latest_counts
WHERE is_latest AND status = 'deprecated'""")
def deprecations(s, d):
    return ce.deprecations(latest(s, d))


@Q.add("churn_concentration", "A26", """
WITH g AS (SELECT split_part(name, '/', 1) AS ns, count(*) AS c FROM versions GROUP BY 1),
 r AS (SELECT c, row_number() OVER (ORDER BY c DESC) AS dn, row_number() OVER (ORDER BY c) AS up, count(*) OVER () AS n, sum(c) OVER () AS t FROM g),
 k AS (SELECT unnest([1, 5, 10, 25, 50, 100]) AS k)
SELECT k::VARCHAR AS top_k_namespaces, sum(c)::BIGINT AS versions, round_even(100.0::DOUBLE * sum(c)::DOUBLE / max(t)::DOUBLE, 1) AS share_of_versions_pct FROM r JOIN k ON dn <= k GROUP BY k
UNION ALL SELECT 'bottom 50% of namespaces (' || greatest(1, max(n) // 2) || ')', sum(c)::BIGINT, round_even(100.0::DOUBLE * sum(c)::DOUBLE / max(t)::DOUBLE, 1) FROM r WHERE up <= greatest(1, n // 2)""")
def churn_concentration(s, d):
    return ce.churn_concentration(b.versions(s, d), tx.namespace("name"))


# --- credentials ----------------------------------------------------------------------------------
def classified(s, d):
    return se.classify_declarations(b.declarations(s, d))


def adjudicated(s, d):
    return se.apply_adjudication(classified(s, d))


@Q.add("permissive_hint", "X1", """
SELECT var_name, coalesce(var_description, '') AS description, looks_like_credential, name_hint, count(*) AS declarations FROM classified GROUP BY ALL""")
def permissive_hint(s, d):
    return classified(s, d).groupBy(
        "var_name", tx.text_or_empty("var_description").alias("description"), "looks_like_credential", "name_hint"
    ).agg(F.count(F.lit(1)).alias("declarations"))


@Q.add("classify_credential", "X2", """
SELECT ordinal, line, var_name, credential_tier, credential_reason FROM classified""")
def classify_credential(s, d):
    return classified(s, d).select("ordinal", "line", "var_name", "credential_tier", "credential_reason")


@Q.add("apply_adjudication", "X3", """
SELECT var_name, audit_reason, audit_demoted, credential_named, credential_named_unflagged, permissive_unflagged, count(*) AS declarations FROM adjudicated GROUP BY ALL""")
def apply_adjudication(s, d):
    cols = ["var_name", "audit_reason", "audit_demoted", "credential_named", "credential_named_unflagged", "permissive_unflagged"]
    return adjudicated(s, d).groupBy(*cols).agg(F.count(F.lit(1)).alias("declarations"))


_T = "coalesce(credential_tier = '{}', false)"
_SUMMARY = [
    ("declared environment variables", "true"), ("required variables", "is_required"), ("variables marked secret", "is_secret"),
    ("credential-named, explicit tier", _T.format("explicit") + " AND credential_named"),
    ("credential-named, ambiguous tier", _T.format("ambiguous") + " AND credential_named"),
    ("credential-named, both tiers", "credential_named"), ("credential-named and NOT marked secret", "credential_named_unflagged"),
    ("... of those, explicit tier", _T.format("explicit") + " AND credential_named_unflagged"),
    ("... of those, ambiguous tier", _T.format("ambiguous") + " AND credential_named_unflagged"),
    ("credential-named, NOT marked secret, and required", "credential_named_unflagged AND is_required"),
    ("permissive rule: variables that look like credentials", "looks_like_credential"),
    ("permissive rule: look like credentials, NOT marked secret", "permissive_unflagged"),
    ("declarations demoted by adjudication", "audit_demoted"), ("... of those, with no secret flag", "audit_demoted AND NOT is_secret"),
    ("variables with a default value", "default_value IS NOT NULL"),
]
_SERVERS = [
    ("servers declaring at least one env var", "true"),
    ("servers declaring at least one credential-named variable", "credential_named"),
    ("servers declaring a credential-named variable with no secret flag", "credential_named_unflagged"),
]
_SUMMARY_SQL = " UNION ALL ".join(
    [f"SELECT '{m}' AS metric, count(*) FILTER ({c}) AS value, {pct(f'count(*) FILTER ({c})', 'count(*)', 2)} AS share_pct, 'all published versions' AS basis FROM adjudicated"
     for m, c in _SUMMARY]
    + [f"SELECT '{m}', count(DISTINCT server_name) FILTER ({c}), NULL::DOUBLE, 'all published versions' FROM adjudicated" for m, c in _SERVERS])


@Q.add("credential_summary", "A13", _SUMMARY_SQL)
def credential_summary(s, d):
    return se.credential_summary(adjudicated(s, d))


@Q.add("top_vars", "A14", f"""
SELECT var_name, count(*) AS declarations, count(DISTINCT server_name) AS servers, count(*) FILTER (is_secret) AS secret_flagged,
 {pct('count(*) FILTER (is_secret)', 'count(*)')} AS secret_flagged_pct FROM declarations GROUP BY 1 ORDER BY servers DESC, var_name LIMIT 30""")
def top_vars(s, d):
    return se.top_vars(b.declarations(s, d))


def _audit(s, d):
    return se.rule_audit(adjudicated(s, d), ["ordinal", "line", "var_description"])


@Q.add("rule_audit", "A15", "SELECT * FROM audit")
def rule_audit(s, d):
    return _audit(s, d)


@Q.add("rule_precision", "A16", """
SELECT credential_tier AS tier, count(*) AS distinct_names_flagged, sum(unflagged)::BIGINT AS unflagged_before_audit,
 coalesce(sum(unflagged) FILTER (verdict <> 'credential'), 0)::BIGINT AS adjudicated_non_credential,
 (sum(unflagged) - coalesce(sum(unflagged) FILTER (verdict <> 'credential'), 0))::BIGINT AS unflagged_after_audit,
 round_even(100.0::DOUBLE * (sum(unflagged) - coalesce(sum(unflagged) FILTER (verdict <> 'credential'), 0))::DOUBLE / sum(unflagged)::DOUBLE, 1) AS precision_pct
FROM audit WHERE unflagged > 0 GROUP BY 1""")
def rule_precision(s, d):
    return se.rule_precision(_audit(s, d))


@Q.add("rule_decomposition", "A17", f"""
SELECT CASE WHEN credential_named THEN 'corroborated by the whole-word rule' WHEN name_hint THEN 'incidental name match' ELSE 'description only' END AS mechanism,
 count(*) AS declarations, count(DISTINCT server_name) AS servers, count(DISTINCT var_name) AS distinct_names,
 {pct('count(*)', '(SELECT count(*) FROM adjudicated WHERE permissive_unflagged)')} AS share_pct, 'all published versions, no secret flag' AS basis
FROM adjudicated WHERE permissive_unflagged GROUP BY 1""")
def rule_decomposition(s, d):
    return se.rule_decomposition(adjudicated(s, d))


@Q.add("tier_flag_counts", "A18", """
WITH l AS (SELECT count(*) FILTER (credential_tier = 'explicit' AND credential_named AND is_secret) AS a, count(*) FILTER (credential_tier = 'explicit' AND credential_named AND NOT is_secret) AS b,
 count(*) FILTER (credential_tier = 'ambiguous' AND credential_named AND NOT is_secret) AS c, count(*) FILTER (looks_like_credential AND NOT is_secret) AS e FROM adjudicated)
SELECT u.* FROM l, LATERAL (VALUES ('explicit tier, flagged secret', a), ('explicit tier, no flag', b), ('ambiguous tier, no flag', c), ('permissive rule, no flag', e)) u("group", variables)""")
def tier_flag_counts(s, d):
    return se.tier_flag_counts(adjudicated(s, d))


@Q.add("secret_verdict", "A19", f"""
WITH e AS (SELECT ordinal, count(*) AS n, count(*) FILTER ({any_of('var_name', fx.VERDICT_HINTS)}) AS c, count(*) FILTER ({any_of('var_name', fx.VERDICT_HINTS)} AND is_secret) AS f
 FROM declarations GROUP BY 1)
SELECT o_orderkey AS server, coalesce(n, 0) AS declared, coalesce(c, 0) AS credential_like,
 CASE WHEN coalesce(c, 0) = 0 THEN 'n/a' WHEN f > 0 THEN 'yes' ELSE 'no' END AS verdict,
 CASE WHEN coalesce(n, 0) = 0 THEN 'no environment variables declared' WHEN c = 0 THEN 'declares variables, none credential-like'
  WHEN f > 0 THEN 'at least one credential-like variable flagged secret' ELSE 'credential-like variable declared but not flagged secret' END AS reason
FROM orders LEFT JOIN e ON ordinal = o_orderkey""")
def secret_verdict(s, d):
    servers = b.table(s, d, "orders").select(F.col("o_orderkey").alias("server"))
    return se.secret_verdict(servers, b.declarations(s, d), "server", "ordinal")


# --- interface, packages, repositories ------------------------------------------------------------
_TOOL_FLAGS = [
    ("tools with a description", "tool_description <> ''"), ("descriptions under 5 words", f"{words('tool_description')} < 5"),
    ("descriptions that state when to use the tool", "regexp_matches(lower(tool_description), 'use (?:this|when)|when to use|use it when')"),
    ("tools declaring an input schema", "has_schema"), ("snake_case names", "contains(tool_name, '_')"),
    ("camelCase names", "regexp_matches(tool_name, '[a-z][A-Z]')"), ("kebab-case names", "contains(tool_name, '-')"),
]


@Q.add("tool_interface_profile", "A27", " UNION ALL ".join(
    ["SELECT 'extracted tool definitions' AS metric, count(*)::DOUBLE AS value, NULL::DOUBLE AS share_pct FROM tools",
     "SELECT 'servers represented', count(DISTINCT server_name)::DOUBLE, NULL FROM tools",
     "SELECT 'tools per server (mean)', round_even(count(*)::DOUBLE / greatest(1, count(DISTINCT server_name)), 1), NULL FROM tools"]
    + [f"SELECT '{m}', (count(*) FILTER ({c}))::DOUBLE, {pct(f'count(*) FILTER ({c})', 'count(*)')} FROM tools" for m, c in _TOOL_FLAGS]))
def tool_interface_profile(s, d):
    return it.tool_interface_profile(tools_and_strict(s, d)[1])


@Q.add("tools_per_server", "A28", f"""
SELECT server_name, count(*) AS tools, count(*) FILTER (tool_description <> '') AS with_description, count(*) FILTER (has_schema) AS with_schema,
 round_even(avg({words('tool_description')}), 1) AS mean_desc_words FROM tools GROUP BY 1""")
def tools_per_server(s, d):
    return it.tools_per_server(tools_and_strict(s, d)[1])


@Q.add("tool_outcome", "A29", """
SELECT server_name, count(*) AS tools, count(*) FILTER (tool_description <> '') AS with_description, count(*) FILTER (has_schema) AS with_schema,
 array_to_string(list(DISTINCT language ORDER BY language), '|') AS languages FROM tools GROUP BY 1""")
def tool_outcome(s, d):
    return it.tool_outcome(tools_and_strict(s, d)[1])


@Q.add("extraction_coverage", "A30", """
WITH l AS (SELECT count(*) AS n, count(*) FILTER (lang <> 'es') AS p, count(*) FILTER (lang <> 'es' AND f > 0) AS y FROM (
 SELECT lang, len(regexp_extract_all(text, '[A-Za-z]+ = "')) AS f FROM documents))
SELECT u.metric, u.v::DOUBLE AS value, round_even(100.0::DOUBLE * u.v / n, 1) AS share_of_attempted_pct FROM l, LATERAL (VALUES ('packages attempted', n),
 ('packages parsed successfully', p), ('packages yielding >= 1 tool', y)) u(metric, v)""")
def extraction_coverage(s, d):
    cov = b.table(s, d, "documents").select(
        F.when(F.col("lang") == "es", "no_sdist").otherwise("ok").alias("status"),
        F.regexp_count("text", F.lit('[A-Za-z]+ = "')).alias("tools_found"))
    return it.extraction_coverage(cov)


def enriched(s, d):
    """Parts as enriched packages."""
    npm = F.col("p_size") <= 30
    licence = F.when(F.col("p_type") != "SMALL", F.col("p_type"))
    return b.table(s, d, "part").select(
        F.when(npm, "npm").otherwise("pypi").alias("registry_type"),
        F.when(npm, licence).alias("npm_license"), F.when(~npm, licence).alias("pypi_license"),
        F.when(npm, F.contains("p_name", F.lit("red"))).alias("npm_deprecated"),
        F.when(npm & (F.col("p_size") > 2), F.col("p_size") % 4).alias("npm_maintainer_count"),
        F.when(npm, F.length("p_name")).alias("npm_version_count"),
        F.when(npm & (F.col("p_size") != 7), F.floor(F.col("p_retailprice")) - 901).alias("npm_monthly_downloads"),
        F.when(~npm, F.contains("p_name", F.lit("gear"))).alias("pypi_yanked"),
    )


_ENRICHED = """
WITH e AS (SELECT p_size <= 30 AS npm, CASE WHEN p_type <> 'SMALL' THEN p_type END AS lic, contains(p_name, 'red') AS dep, CASE WHEN p_size > 2 THEN p_size % 4 END AS m,
 length(p_name) AS v, CASE WHEN p_size <> 7 THEN floor(p_retailprice) - 901 END AS dl, contains(p_name, 'gear') AS y FROM part)"""


@Q.add("package_profile", "A31", _ENRICHED + """,
 l AS (SELECT count(*) AS n, count(*) FILTER (npm) AS a, count(*) FILTER (NOT npm) AS b, count(lic) FILTER (npm) AS c, count(*) FILTER (npm AND dep) AS e, count(*) FILTER (npm AND m = 1) AS f,
  count(*) FILTER (npm AND coalesce(m, 0) = 0) AS g, median(v) FILTER (npm) AS h, median(dl) FILTER (npm) AS i, count(*) FILTER (npm AND coalesce(dl, 0) = 0) AS j,
  count(lic) FILTER (NOT npm) AS k, count(*) FILTER (NOT npm AND y) AS o FROM e)
SELECT u.metric, u.x::DOUBLE AS value, CASE WHEN NOT contains(u.metric, 'median') THEN round_even(100.0::DOUBLE * u.x::DOUBLE / n, 1) END AS share_pct FROM l, LATERAL (VALUES
 ('packages enriched', n), ('npm packages', a), ('PyPI packages', b), ('npm: with a licence declared', c), ('npm: deprecated', e), ('npm: single maintainer', f),
 ('npm: no maintainer recorded', g), ('npm: median versions published', h), ('npm: median monthly downloads', i), ('npm: zero downloads in last month', j),
 ('PyPI: with a licence declared', k), ('PyPI: yanked releases', o)) u(metric, x)""")
def package_profile(s, d):
    return it.package_profile(enriched(s, d))


_LIC = _ENRICHED + " SELECT CASE WHEN npm THEN 'npm' ELSE 'pypi' END AS registry, lic AS licence, count(*) AS count FROM e WHERE lic IS NOT NULL GROUP BY 1, 2 "


@Q.add("licence_distribution", "A32", _LIC + "QUALIFY row_number() OVER (PARTITION BY registry ORDER BY count DESC, licence) <= 3")
def licence_distribution(s, d):
    df = enriched(s, d).withColumn("licence", F.coalesce("npm_license", "pypi_license"))
    return it.licence_distribution(df, "registry_type", "licence", 3)


@Q.add("licence_distribution_global", "A32", _LIC + "ORDER BY count DESC, licence, registry LIMIT 5")
def licence_distribution_global(s, d):
    df = enriched(s, d).withColumn("licence", F.coalesce("npm_license", "pypi_license"))
    return it.licence_distribution(df, "registry_type", "licence", 5, per_registry=False)


def repositories(s, d):
    """Orders as repositories."""
    p, total = F.col("o_orderpriority"), F.col("o_totalprice")
    return b.table(s, d, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "not_found").otherwise("ok").alias("status"),
        F.when(p == "5-LOW", F.lit(None)).when(p == "2-HIGH", "NOASSERTION").otherwise("MIT").alias("repo_license"),
        (p == "1-URGENT").alias("repo_archived"), F.when(p != "3-MEDIUM", p == "2-HIGH").alias("repo_is_fork"),
        F.when(total > 20000, F.floor((total - 20000) / 700)).alias("repo_stars"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("repo_created_at"),
        F.date_format(F.date_add("o_orderdate", 400), "yyyy-MM-dd'T'00:00:00'Z'").alias("repo_pushed_at"),
        F.substring(p, 3, 20).alias("repo_language"),
    )


_REPOS = f"""
WITH r AS (SELECT *, CASE o_orderpriority WHEN '5-LOW' THEN NULL WHEN '2-HIGH' THEN 'NOASSERTION' ELSE 'MIT' END AS lic,
 CASE WHEN o_totalprice > 20000 THEN floor((o_totalprice - 20000) / 700)::BIGINT END AS stars, substr(o_orderpriority, 3) AS repo_language,
 (epoch_us(TIMESTAMP '{b.AS_OF}') - epoch_us(o_orderdate))::DOUBLE / 86400000000.0::DOUBLE AS age,
 (epoch_us(TIMESTAMP '{b.AS_OF}') - epoch_us((o_orderdate::DATE + 400)::TIMESTAMP))::DOUBLE / 86400000000.0::DOUBLE AS idle FROM orders WHERE o_orderstatus <> 'F')"""


@Q.add("repository_profile", "A33", _REPOS + """,
 l AS (SELECT count(*) AS n, count(*) FILTER (coalesce(lic, 'NOASSERTION') IN ('NOASSERTION', 'NONE', '')) AS a, count(*) FILTER (o_orderpriority = '1-URGENT') AS b,
  count(*) FILTER (o_orderpriority = '2-HIGH') AS c, count(*) FILTER (coalesce(stars, 0) = 0) AS e, count(*) FILTER (coalesce(stars, 0) >= 100) AS f,
  count(*) FILTER (idle > 180) AS g, median(stars) AS h, round_even(median(age), 0) AS i FROM r)
SELECT u.metric, u.x::DOUBLE AS value, CASE WHEN NOT contains(u.metric, 'median') THEN round_even(100.0::DOUBLE * u.x::DOUBLE / n, 1) END AS share_pct FROM l, LATERAL (VALUES
 ('repositories resolved', n), ('no licence declared', a), ('archived', b), ('forks', c), ('with no stars', e), ('with >= 100 stars', f), ('no push in 180 days', g),
 ('median stars', h), ('median age (days)', i)) u(metric, x)""")
def repository_profile(s, d):
    return it.repository_profile(repositories(s, d), b.AS_OF)


@Q.add("by_language", "A34", _REPOS + """
SELECT repo_language, count(*) AS repos, median(stars)::DOUBLE AS median_stars FROM r GROUP BY 1 ORDER BY repos DESC, repo_language LIMIT 4""")
def by_language(s, d):
    return it.by_language(repositories(s, d).where("status = 'ok'"), "repo_language", "repo_stars", 4)


@Q.add("group_compare", "A35", """
WITH g AS (SELECT "group", count(*) AS servers, median(version_count)::DOUBLE AS median_versions, round_even(avg(version_count), 2) AS mean_versions,
 round_even(100.0::DOUBLE * count(*) FILTER (status = 'deprecated') / count(*), 1) AS share_deprecated_pct FROM (SELECT l.*, unnest(list_filter([
 CASE WHEN has_repository THEN 'declares a repository' END, CASE WHEN NOT has_repository THEN 'does not declare a repository' END, CASE WHEN has_packages THEN 'ships a package' END,
 CASE WHEN NOT has_packages THEN 'hosted only (no package)' END, CASE WHEN title IS NOT NULL THEN 'has a title' END, CASE WHEN title IS NULL THEN 'has no title' END],
 lambda x: x IS NOT NULL)) AS "group" FROM latest_counts l) GROUP BY 1)
SELECT "group", coalesce(servers, 0) AS servers, coalesce(median_versions, 0) AS median_versions, coalesce(mean_versions, 0) AS mean_versions, coalesce(share_deprecated_pct, 0) AS share_deprecated_pct
FROM (VALUES ('declares a repository'), ('does not declare a repository'), ('ships a package'), ('hosted only (no package)'), ('has a title'), ('has no title')) v("group") LEFT JOIN g USING ("group")""")
def group_compare(s, d):
    return ce.group_compare(latest(s, d), {
        "declares a repository": F.col("has_repository"), "does not declare a repository": ~F.col("has_repository"),
        "ships a package": F.col("has_packages"), "hosted only (no package)": ~F.col("has_packages"),
        "has a title": F.col("title").isNotNull(), "has no title": F.col("title").isNull(),
    }, "version_count", F.col("status") == "deprecated")


@Q.add("signal_comparison", "A43, T6", """
WITH ra AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS x, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS y FROM signals),
 l AS (SELECT count(*) AS n, count(*) FILTER (a > 0) AS wa, count(*) FILTER (b = 0) AS zb, median(a) AS ma, median(b) AS mb, avg(a) AS aa, avg(b) AS ab,
 count(*) FILTER (b > a) AS bm, count(*) FILTER (a = b) AS eq, count(*) FILTER (a > b) AS am, corr(x, y) AS rho FROM ra)
SELECT u.metric, u.v::DOUBLE AS value FROM l, LATERAL (VALUES ('items compared', n::DOUBLE), ('... with at least one versions', wa), ('... with zero releases', zb),
 ('share with zero releases (%)', round_even(100.0::DOUBLE * zb / n, 1)), ('median versions', ma), ('median releases', mb), ('mean versions', round_even(aa, 2)),
 ('mean releases', round_even(ab, 2)), ('items where releases > versions', bm), ('items where the counts are equal', eq), ('items where versions > releases', am),
 ('Spearman correlation between the counts', round_even(rho, 3))) u(metric, v)""")
def signal_comparison(s, d):
    return it.signal_comparison(stored_signals(s, d), "a", "b", ("versions", "releases"))


@Q.add("agreement_bands", "A44", """
WITH l AS (SELECT count(*) AS n, count(*) FILTER (b > a) AS p, count(*) FILTER (a = b) AS q, count(*) FILTER (a > b) AS r, count(*) FILTER (b >= 2 * CASE WHEN a = 0 THEN 1 ELSE a END) AS t FROM signals)
SELECT u.pattern, u.v::DOUBLE AS servers, round_even(100.0::DOUBLE * u.v / n, 1) AS share_pct FROM l, LATERAL (VALUES ('releases exceed versions', p),
 ('counts agree exactly', q), ('versions exceed releases', r), ('versions understate by 2x or more', t)) u(pattern, v)""")
def agreement_bands(s, d):
    return it.agreement_bands(signals(s, d), "a", "b", ("versions", "releases"))


@Q.add("extraction_quality", "A45", """
WITH l AS (SELECT count(*) AS n, count(*) FILTER (comparable) AS c, coalesce(sum(items_a) FILTER (comparable), 0) AS a, coalesce(sum(items_b), 0) AS b,
 coalesce(sum(only_a), 0) AS oa, coalesce(sum(only_b), 0) AS ob FROM agreed)
SELECT u.metric, u.v::DOUBLE AS value FROM l, LATERAL (VALUES ('validation sample size', n::DOUBLE), ('packages comparable', c), ('items found by the first extractor', a),
 ('items found by the second extractor', b), ('items agreed by both', b - ob), ('first only (candidate false positives)', oa), ('second only (extractor misses)', ob),
 ('estimated recall on comparable packages (%)', round_even(100.0::DOUBLE * (b - ob)::DOUBLE / greatest(1, b)::DOUBLE, 1)),
 ('candidate false positive rate (%)', round_even(100.0::DOUBLE * oa::DOUBLE / greatest(1, a)::DOUBLE, 1))) u(metric, v)""")
def extraction_quality(s, d):
    tools, strict, scanned = stored_tools_and_strict(s, d)
    return it.extraction_quality(k.extractor_agreement(tools, strict, "package_key", "tool_name", scanned=scanned))


# --- hand-coded sheets ----------------------------------------------------------------------------
def counted(s, d):
    """Labelled documents as part-A rows: a coder's count against an extractor's count."""
    return b.raters(s, d).select(
        F.when(F.col("quality") == 1, "yes").otherwise("0").alias("has_server_entrypoint"),
        F.length(F.concat("lang", "source")).cast("string").alias("n_tools_actual"),
        F.when(F.col("lang") != "es", (F.length("source") + 2 * F.col("toxic")).cast("string")).alias("n_tools_extracted"),
        F.lit("").alias("miss_reason"), F.lit("").alias("notes"))


@Q.add("count_recall_precision", "A36", """
WITH r AS (SELECT quality = 1 AS s, CASE WHEN quality = 1 THEN length(lang || source) ELSE 0 END AS x, CASE WHEN lang <> 'es' THEN length(source) + 2 * toxic ELSE 0 END AS e FROM raters),
 l AS (SELECT count(*) AS n, count(*) FILTER (s) AS sv, count(*) FILTER (NOT s) AS o, count(*) FILTER (s AND e > 0) AS det, sum(x) FILTER (s) AS a, sum(e) FILTER (s) AS ex,
  sum(least(x, e)) FILTER (s) AS m, sum(greatest(0, x - e)) FILTER (s) AS u, sum(greatest(0, e - x)) FILTER (s) AS ov, count(*) FILTER (s AND x > e) AS wm FROM r)
SELECT t.metric, t.v::DOUBLE AS value FROM l, LATERAL (VALUES ('coded packages', n::DOUBLE), ('classified as a server', sv), ('classified as not a server', o),
 ('servers where the extractor found >= 1 tool', det), ('package-level detection rate (%)', round_even(100.0::DOUBLE * det / sv, 1)), ('tools actually exposed (coder count)', a),
 ('tools extracted by the pipeline', ex), ('tools matched (estimated)', m), ('tools missed by the extractor', u), ('tools extracted that are not real tools', ov),
 ('estimated tool-level recall (%)', round_even(100.0::DOUBLE * m::DOUBLE / a::DOUBLE, 1)), ('estimated tool-level precision (%)', round_even(100.0::DOUBLE * m::DOUBLE / ex::DOUBLE, 1)),
 ('servers with at least one miss', wm)) t(metric, v)""")
def count_recall_precision(s, d):
    return co.count_recall_precision(co.score_counts(
        counted(s, d), "has_server_entrypoint", "n_tools_actual", "n_tools_extracted", "miss_reason", "notes"))


def security_codes(s, d):
    """Labelled documents as coded security rows."""
    r, lang = b.raters(s, d), F.col("lang")
    return r.select(
        F.col("doc_id").cast("string").alias("item_id"),
        F.when(lang == "en", vo.transport_class(F.col("quality") == 1, F.col("toxic") == 1)).otherwise("remote-only").alias("transport_class"),
        F.when(lang == "de", "oauth").when(lang == "fr", "x402").when(lang == "es", "").when(F.col("quality") == 1, " none ").otherwise("unclear").alias("auth_mechanism"),
        F.when(lang == "de", "env vars: TOKEN").when(lang == "fr", "描述: text").when(lang == "es", "本地 config").when(F.col("quality") == 1, "无 auth 声明").alias("auth_evidence"),
        F.when(F.col("toxic") == 1, "yes").otherwise("no").alias("requires_user_secret"),
        F.when(F.col("quality") == 1, "no").otherwise("unclear").alias("secret_documented_as_secret"),
        F.when(F.col("n_chars") > 500, "broad").otherwise("narrow").alias("scope_breadth"),
        F.when(F.col("quality") == 0, "yes").otherwise("no").alias("destructive_capability"),
        F.when(F.col("quality") == 1, "yes").otherwise("no").alias("write_capability"),
    )


_SEC = """
WITH c AS (SELECT *, CASE WHEN lang = 'en' THEN CASE WHEN quality = 1 AND toxic = 1 THEN 'package+remote' WHEN quality = 1 THEN 'package-only' WHEN toxic = 1 THEN 'remote-only' ELSE 'neither' END ELSE 'remote-only' END AS transport_class,
 CASE lang WHEN 'de' THEN 'oauth' WHEN 'fr' THEN 'x402' WHEN 'es' THEN '' ELSE CASE WHEN quality = 1 THEN 'none' ELSE 'unclear' END END AS mech,
 CASE lang WHEN 'de' THEN 'manifest_env_vars' WHEN 'fr' THEN 'manifest_description' WHEN 'es' THEN 'local_configuration' ELSE CASE WHEN quality = 1 THEN 'no_statement' ELSE 'none' END END AS ev,
 CASE lang WHEN 'de' THEN 'credential' WHEN 'fr' THEN 'payment' WHEN 'es' THEN 'unknown' ELSE CASE WHEN quality = 1 THEN 'none' ELSE 'unclear' END END AS fam,
 toxic = 1 AS sec, CASE WHEN quality = 1 THEN 'no' ELSE 'unclear' END AS flag, n_chars > 500 AS broad, quality = 0 AS destr, quality = 1 AS wr FROM raters)"""


@Q.add("coded_security", "P13, P18, P19", _SEC + "SELECT doc_id::VARCHAR AS item_id, transport_class, fam AS auth_family, ev AS auth_evidence_source FROM c")
def coded_security(s, d):
    return co.coded_security(security_codes(s, d)).select("item_id", "transport_class", "auth_family", "auth_evidence_source")


@Q.add("coded_security_summary", "A38", _SEC + """,
 l AS (SELECT count(*) AS n, count(*) FILTER (mech NOT IN ('', 'unclear')) AS a, count(*) FILTER (mech = 'unclear') AS b, count(*) FILTER (mech = 'none') AS e, count(*) FILTER (fam = 'credential') AS f,
  count(*) FILTER (fam = 'payment') AS g, count(*) FILTER (sec) AS h, count(*) FILTER (sec AND flag = 'no') AS i, count(*) FILTER (sec AND flag = 'unclear') AS j, count(*) FILTER (wr) AS k,
  count(*) FILTER (destr) AS m, count(*) FILTER (broad) AS o, count(*) FILTER (broad AND wr) AS p FROM c)
SELECT t.metric, t.v::DOUBLE AS value FROM l, LATERAL (VALUES ('servers coded', n::DOUBLE), ('authentication mechanism identified', a), ('authentication mechanism identified (%)', round_even(100.0::DOUBLE * a / n, 1)),
 ('authentication mechanism unclear (%)', round_even(100.0::DOUBLE * b / n, 1)), ('no authentication required', e), ('credential-based authentication', f), ('payment-based gate', g),
 ('requires the user to supply a secret', h), ('... of those: secret NOT flagged as secret', i), ('... of those: secret flag left unclear', j), ('servers with write capability', k),
 ('servers with destructive capability', m), ('servers with broad scope', o), ('broad scope AND write capability', p)) t(metric, v)""")
def coded_security_summary(s, d):
    return co.coded_security_summary(security_codes(s, d))


@Q.add("crosstabs", "A39", _SEC + f""",
 f AS (SELECT unnest([struct_pack(field := 'auth_mechanism', value := mech), struct_pack(field := 'scope_breadth', value := CASE WHEN broad THEN 'broad' ELSE 'narrow' END),
  struct_pack(field := 'write_capability', value := CASE WHEN wr THEN 'yes' ELSE 'no' END)], recursive := true) FROM c)
SELECT field, value, count(*) AS servers, {pct('count(*)', '(SELECT count(*) FROM c)')} AS share_pct FROM f GROUP BY 1, 2""")
def crosstabs(s, d):
    return co.crosstabs(security_codes(s, d), ["auth_mechanism", "scope_breadth", "write_capability"], ("field", "value", "servers", "share_pct"))


@Q.add("rates_by", "A40", _SEC + f"""
SELECT transport_class, count(*) AS servers, {pct('count(*)', '(SELECT count(*) FROM c)')} AS share_pct, {pct("count(*) FILTER (mech NOT IN ('', 'unclear'))", 'count(*)')} AS auth_identified_pct,
 {pct("count(*) FILTER (mech = 'none')", 'count(*)')} AS no_auth_pct, {pct('count(*) FILTER (sec)', 'count(*)')} AS needs_secret_pct, {pct('count(*) FILTER (wr)', 'count(*)')} AS write_capability_pct,
 {pct('count(*) FILTER (broad)', 'count(*)')} AS broad_scope_pct FROM c GROUP BY 1""")
def rates_by(s, d):
    mechanism = F.trim("auth_mechanism")
    return co.rates_by(security_codes(s, d), "transport_class", {
        "auth_identified_pct": ~mechanism.isin("", "unclear"), "no_auth_pct": mechanism == "none",
        "needs_secret_pct": F.col("requires_user_secret") == "yes", "write_capability_pct": F.col("write_capability") == "yes",
        "broad_scope_pct": F.col("scope_breadth") == "broad",
    }, "servers")


def description_codes(s, d):
    """Labelled documents as coded description rows."""
    lang = F.col("lang")
    return b.raters(s, d).select(
        F.col("doc_id").cast("string").alias("item_id"), "source",
        F.when(F.col("quality") == 1, "yes").when(F.col("toxic") == 1, "no").otherwise("partial").alias("desc_states_purpose"),
        F.when(F.col("n_chars") > 900, "yes").otherwise("no").alias("desc_states_when_to_use"),
        F.when(F.col("n_chars") > 500, "yes").otherwise("n/a").alias("desc_states_inputs"),
        F.when(F.col("toxic") == 1, "yes").otherwise("no").alias("desc_names_side_effects"),
        F.when(lang == "de", "alpha| beta||").when(lang == "fr", " | ").when(lang == "es", "gamma").alias("ambiguous_with"),
    )


_DESC = """
WITH c AS (SELECT *, CASE WHEN quality = 1 THEN 'yes' WHEN toxic = 1 THEN 'no' ELSE 'partial' END AS pu, n_chars > 900 AS w, n_chars > 500 AS i, toxic = 1 AS e,
 CASE lang WHEN 'de' THEN 2 WHEN 'es' THEN 1 ELSE 0 END AS k FROM raters)"""


@Q.add("coded_description_summary", "A41", _DESC + """,
 l AS (SELECT count(*) AS n, count(*) FILTER (pu = 'yes') AS a, count(*) FILTER (pu = 'partial') AS b, count(*) FILTER (pu = 'no') AS f, count(*) FILTER (w) AS g, count(*) FILTER (i) AS h,
  count(*) FILTER (e) AS j, count(*) FILTER (k > 0) AS m, sum(k) AS o, count(*) FILTER (pu = 'yes' AND w) AS p FROM c)
SELECT t.metric, t.v::DOUBLE AS value FROM l, LATERAL (VALUES ('tools coded', n::DOUBLE), ('description states the purpose (yes)', a), ('description states the purpose (partial)', b),
 ('description does NOT state the purpose', f), ('description states WHEN to use the tool', g), ('... as a share of coded tools (%)', round_even(100.0::DOUBLE * g / n, 1)),
 ('description explains the inputs', h), ('... as a share (inputs, %)', round_even(100.0::DOUBLE * h / n, 1)), ('description names side effects', j),
 ('tools the coder found ambiguous with a sibling', m), ('... as a share (ambiguous, %)', round_even(100.0::DOUBLE * m / n, 1)), ('mean ambiguous siblings per tool', round_even(o::DOUBLE / n, 2)),
 ('tools that state purpose AND when to use', p)) t(metric, v)""")
def coded_description_summary(s, d):
    return co.coded_description_summary(description_codes(s, d))


@Q.add("ambiguous_items", "A42", _DESC + """
SELECT doc_id::VARCHAR AS item_id, source, k::BIGINT AS ambiguous_count, CASE lang WHEN 'de' THEN 'alpha| beta||' ELSE 'gamma' END AS ambiguous_with FROM c WHERE k > 0""")
def ambiguous_items(s, d):
    return co.ambiguous_items(description_codes(s, d), ["item_id", "source"])


@Q.add("validate_enum", "P22", """
WITH v AS (SELECT doc_id::VARCHAR AS item_id, unnest([struct_pack(field := 'auth_mechanism', value := CASE lang WHEN 'de' THEN 'oauth' WHEN 'fr' THEN 'x402' WHEN 'es' THEN '' ELSE CASE WHEN quality = 1 THEN 'none' ELSE 'unclear' END END),
 struct_pack(field := 'secret_documented_as_secret', value := CASE WHEN quality = 1 THEN 'no' ELSE 'unclear' END)], recursive := true) FROM raters)
SELECT item_id, field, value, CASE WHEN value = '' THEN 'blank' ELSE 'not permitted' END AS problem FROM v WHERE value IN ('', 'unclear')""")
def validate_enum(s, d):
    return co.validate_enum(security_codes(s, d), "item_id", {"auth_mechanism": None, "secret_documented_as_secret": None, "scope_breadth": None})


@Q.add("coded_vocabulary", "P15, P16, P20, P23", """
SELECT role, count(*) AS turns, count(*) FILTER (role = 'user') AS truthy, count(*) FILTER (role = 'system') AS falsy, sum(turn)::BIGINT AS numbers,
 count(*) FILTER (role <> 'user') AS undetermined, count(*) FILTER (role = 'assistant') AS harmonised, sum(len(list_filter(string_split(replace(text, ',', '|'), '|'), lambda x: trim(x) <> '')))::BIGINT AS items
FROM conversations GROUP BY 1""")
def coded_vocabulary(s, d):
    role = F.col("role")
    word = F.when(role == "user", " Yes").when(role == "system", "n").otherwise("Unclear ")
    blank = F.when(role == "user", "known").when(role == "system", "N/A").otherwise(" UNCLEAR")
    return b.table(s, d, "conversations").groupBy("role").agg(
        F.count(F.lit(1)).alias("turns"), F.count_if(vo.normalize_bool(word)).alias("truthy"), F.count_if(~vo.normalize_bool(word)).alias("falsy"),
        F.sum(vo.to_int(F.concat(F.col("turn").cast("string"), F.lit(".0 ")))).alias("numbers"),
        F.count_if(vo.collapse_undetermined(blank) == "undetermined").alias("undetermined"),
        F.count_if(vo.harmonise(blank) == "undetermined").alias("harmonised"),
        F.sum(tx.list_count(F.replace("text", F.lit(","), F.lit("|")))).alias("items"),
    )
