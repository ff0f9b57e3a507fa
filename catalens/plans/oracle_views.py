"""The same views as `bindings`, as common table expressions for the SQL oracle."""

from __future__ import annotations

import re

from catalens import fixed_values as fx
from catalens.plans.bindings import DECLARED_NAMES

WS = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NWS = r"[^\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def words(x: str) -> str:
    return f"len(regexp_extract_all(coalesce({x},''), '{NWS}'))"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x},''), '{WS}+', ' ', 'g'))"


def pct(part: str, whole: str, digits: int = 1) -> str:
    return (f"CASE WHEN ({whole}) > 0 THEN round_even(100.0::DOUBLE * ({part})::DOUBLE / ({whole})::DOUBLE, {digits}) "
            f"ELSE 0.0::DOUBLE END")


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def any_of(x: str, hints) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce({x},'')), '{h}')" for h in hints) + ")"


def digest_int(digest: str, start: int = 1) -> str:
    return f"('0x' || substr({digest}, {start}, 8))::BIGINT"


def uniform(digest: str, start: int = 1) -> str:
    return f"({digest_int(digest, start)}::DOUBLE / 4294967296.0::DOUBLE)"


def poisson1(u: str) -> str:
    from catalens.functions.numeric import POISSON1_CDF

    return "(" + " + ".join(f"CASE WHEN {u} >= {p!r}::DOUBLE THEN 1 ELSE 0 END" for p in POISSON1_CDF) + ")"


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, sql: str, *needs: str) -> None:
    VIEWS[name] = (needs, sql)


view("versions", """
SELECT 'io.' || lower(c_mktsegment) || '.n' || c_nationkey || '/c' || o_custkey AS name,
  CASE WHEN o_orderpriority <> '5-LOW' THEN substr(o_orderpriority, 3) END AS title,
  CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN '' WHEN '5-LOW' THEN NULL WHEN '3-MEDIUM' THEN ' medium '
    ELSE c_name || ' places an order of status ' || o_orderstatus END AS description,
  o_orderkey::VARCHAR AS version,
  CASE WHEN o_orderstatus <> 'F' THEN 'https://static.example.org/schemas/' || strftime(o_orderdate, '%Y-%m') || '-01/server.json' END AS schema,
  CASE WHEN c_acctbal > 3000 THEN 'https://github.com/n' || c_nationkey || '/' || lower(c_mktsegment) || '.git'
    WHEN c_acctbal > 0 THEN 'https://example.org/c' || o_custkey END AS repository_url,
  CASE WHEN o_orderstatus = 'P' THEN 'deprecated' ELSE 'active' END AS status,
  o_orderpriority = '1-URGENT' AS is_latest,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS published_at, NULL::VARCHAR AS status_changed_at,
  o_orderdate AS placed_at,
  o_orderstatus <> 'F' AS has_packages, o_orderpriority IN ('1-URGENT', '2-HIGH') AS has_remotes,
  c_acctbal > 0 AS has_repository, c_acctbal > 8000 AS has_website, o_totalprice AS price, o_orderkey AS ordinal
FROM orders JOIN customer ON o_custkey = c_custkey""")
view("latest", """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY is_latest DESC, published_at DESC, ordinal) AS rn
  FROM versions) WHERE rn = 1""", "versions")
view("latest_counts", """
SELECT l.*, v.version_count, v.first_published_at FROM latest l
JOIN (SELECT name, count(*) AS version_count, min(placed_at) AS first_published_at FROM versions GROUP BY name) v USING (name)""", "latest")
view("packages", """
SELECT 's' || l_suppkey AS server_name, CASE l_returnflag WHEN 'R' THEN 'npm' WHEN 'A' THEN 'pypi' ELSE 'oci' END AS registry_type,
  'p' || l_partkey AS identifier, strftime(l_shipdate, '%Y.%m') AS package_version, l_linestatus = 'O' AS is_latest,
  l_orderkey AS ordinal, l_linenumber::BIGINT AS line FROM lineitem""")
view("declarations", f"""
SELECT 's' || l_suppkey AS server_name, ([{quoted(DECLARED_NAMES)}])[(l_partkey % {len(DECLARED_NAMES)})::INT + 1] AS var_name,
  CASE WHEN l_linenumber = 1 THEN 'Absolute path to the value' WHEN l_linenumber = 2 THEN 'Refill rate of the token bucket'
    WHEN l_linenumber > 3 THEN 'value for ' || l_returnflag END AS var_description,
  l_linestatus = 'F' AS is_required, l_returnflag = 'R' AS is_secret,
  CASE WHEN l_discount > 0.05 THEN l_returnflag END AS default_value, l_linestatus = 'O' AS is_latest,
  l_orderkey AS ordinal, l_linenumber::BIGINT AS line FROM lineitem""")
view("classified0", f"""
SELECT *, list_filter(string_split_regex(lower(coalesce(var_name,'')), '[^a-z0-9]+'), lambda x: x <> '') AS seg FROM declarations""",
     "declarations")
view("classified1", f"""
SELECT *, len(seg) AS n, CASE WHEN len(seg) >= 2 THEN seg[len(seg) - 1] || ' ' || seg[len(seg)] END AS tail2,
  CASE WHEN len(seg) >= 1 THEN seg[len(seg)] END AS head FROM classified0""", "classified0")
view("classified2", f"""
SELECT *, CASE WHEN coalesce(tail2 IN ({quoted(fx.COMPOUNDS)}), false) THEN n - 1 WHEN head IN ({quoted(fx.EXPLICIT_HEADS + fx.AMBIGUOUS_HEADS)}) THEN n END AS pos,
  CASE WHEN coalesce(tail2 IN ({quoted(fx.COMPOUNDS)}), false) OR head IN ({quoted(fx.EXPLICIT_HEADS)}) THEN 'explicit'
    WHEN head IN ({quoted(fx.AMBIGUOUS_HEADS)}) THEN 'ambiguous' END AS tier0 FROM classified1""", "classified1")
view("classified3", f"""
SELECT *, CASE WHEN n = 0 THEN 'empty' WHEN pos IS NULL THEN 'no-credential-term'
  WHEN pos > 1 AND seg[pos - 1] IN ({quoted(fx.NON_SECRET_QUALIFIERS)}) THEN 'qualified'
  WHEN pos > 1 AND seg[pos - 1] IN ({quoted(fx.PUBLIC_QUALIFIERS)}) THEN 'public-by-name'
  WHEN {any_of('var_description', fx.LOCATION_PHRASES)} THEN 'declared-as-location' ELSE 'credential' END AS credential_reason
FROM classified2""", "classified2")
view("classified", f"""
SELECT *, CASE WHEN credential_reason = 'credential' THEN tier0 END AS credential_tier,
  {any_of('var_name', fx.LOOSE_HINTS)} OR {any_of('var_description', fx.LOOSE_HINTS)} AS looks_like_credential,
  {any_of('var_name', fx.LOOSE_HINTS)} AS name_hint FROM classified3""", "classified3")
_ADJ = ", ".join(f"('{n}', '{r}')" for n, r in fx.ADJUDICATED)
view("adjudicated", f"""
SELECT c.*, coalesce(a.r, '') AS audit_reason, credential_tier IS NOT NULL AND a.r IS NOT NULL AS audit_demoted,
  credential_tier IS NOT NULL AND a.r IS NULL AS credential_named,
  credential_tier IS NOT NULL AND a.r IS NULL AND NOT is_secret AS credential_named_unflagged,
  looks_like_credential AND NOT is_secret AS permissive_unflagged
FROM classified c LEFT JOIN (VALUES {_ADJ}) a(v, r) ON c.var_name = a.v""", "classified")
view("audit", """
SELECT f.var_name, f.credential_tier, count(*) AS declarations, count(DISTINCT server_name) AS servers,
  count(*) FILTER (is_secret) AS secret_flagged, count(*) FILTER (NOT is_secret) AS unflagged, max(audit_reason) AS audit_reason,
  (list(var_description ORDER BY ordinal, line, var_description) FILTER (var_description IS NOT NULL))[1] AS example_description,
  CASE WHEN max(audit_reason) = '' THEN 'credential' ELSE max(audit_reason) END AS verdict
FROM adjudicated f WHERE credential_tier IS NOT NULL AND var_name IS NOT NULL GROUP BY 1, 2""", "adjudicated")
view("endpoints", "SELECT url AS remote_url, split_part(url, '/', 4) AS server_name FROM pages")
view("hosts", """
SELECT *, nullif(regexp_extract(remote_url, '://([^/:?#]+)', 1), '') AS host,
  nullif(regexp_extract(remote_url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1), '') AS scheme FROM endpoints""", "endpoints")
view("links", """SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href FROM pages""")
view("strict_links", """SELECT page_id, unnest(regexp_extract_all(html, '<a href="(/[A-Za-z]+)">', 1)) AS href FROM pages""")
view("raters", "SELECT l.*, d.lang, d.source, d.n_chars FROM labels l JOIN documents d USING (doc_id)")
view("docs", """
SELECT *, doc_id::VARCHAR AS i, trim(regexp_replace(regexp_replace(left(text, 60), '[^A-Za-z ]', ' ', 'g'), ' +', ' ', 'g')) AS d
FROM documents""")
view("gaps", """
SELECT * FROM (SELECT (epoch_us(placed_at) - epoch_us(lag(placed_at) OVER (PARTITION BY name ORDER BY placed_at)))::DOUBLE / 86400000000.0::DOUBLE AS g FROM versions)
WHERE g IS NOT NULL""", "versions")
view("files", """
SELECT *, CASE WHEN lang IN ('en', 'fr') THEN 'npm:' ELSE 'pypi:' END || source AS package_key, source AS server_name,
  CASE lang WHEN 'en' THEN 'typescript' WHEN 'fr' THEN 'javascript' ELSE 'python' END AS language,
  CASE lang WHEN 'en' THEN 'src/d' || i || '.ts' WHEN 'fr' THEN 'lib/d' || i || '.js' ELSE 'pkg/d' || i || '.py' END AS path
FROM docs WHERE lang <> 'es'""", "docs")
# Expected extraction results follow from how the files were generated, not from the patterns.
view("found_js", """
SELECT package_key, server_name, language, path, u.* FROM files, LATERAL (VALUES
  ('alpha_' || i, d, false, 'ts_server_tool', 1), ('beta_' || i, 'Does "beta"', true, 'ts_server_tool_object', 2),
  ('gamma_' || source, d, false, 'ts_tool_literal', 3), ('nest_' || i, 'Nested (body', true, 'ts_server_tool_object', 2),
  ('lit_' || i, 'Literal', false, 'ts_tool_literal', 3)) u(tool_name, tool_description, has_schema, extraction_pattern, rank)
WHERE lang IN ('en', 'fr')""", "files")
view("found_decorators", """
SELECT package_key, server_name, language, path, u.* FROM files, LATERAL (VALUES
  ('delta_' || i, d, false, 'py_decorator', 4), ('eps_' || source, CASE WHEN d = '' THEN '' ELSE d END, false, 'py_decorator', 4),
  ('multi_' || i, 'Reads (all) files', false, 'py_decorator', 4))
  u(tool_name, tool_description, has_schema, extraction_pattern, rank) WHERE lang = 'de' AND source <> 'src3'""", "files")
view("found_ctors", """
SELECT package_key, server_name, language, path, u.* FROM files, LATERAL (VALUES
  ('zeta_' || i, 'Does zeta', true, 'py_tool_ctor', 5), ('old_' || i, 'gone', false, 'py_tool_ctor', 5),
  ('one_' || i, 'First :)', false, 'py_tool_ctor', 5), ('two_' || i, '', false, 'py_tool_ctor', 5))
  u(tool_name, tool_description, has_schema, extraction_pattern, rank) WHERE lang = 'de' AND (source <> 'src3' OR tool_name LIKE 'old%')""", "files")
view("found", """
SELECT * FROM found_js UNION ALL SELECT * FROM found_decorators UNION ALL SELECT * FROM found_ctors""",
     "found_js", "found_decorators", "found_ctors")
view("tools", """
SELECT package_key, server_name, language, path, tool_name, tool_description, has_schema, extraction_pattern FROM (
  SELECT *, row_number() OVER (PARTITION BY package_key, tool_name ORDER BY length(tool_description) + CASE WHEN has_schema THEN 50 ELSE 0 END DESC, path, rank) AS rn
  FROM found) WHERE rn = 1""", "found")
view("strict", """
SELECT package_key, path, u.* FROM files, LATERAL (VALUES ('delta_' || i, 'strict_decorator'),
  ('eps_' || source, 'strict_decorator'), ('multi_' || i, 'strict_decorator'), ('zeta_' || i, 'strict_ctor'), ('one_' || i, 'strict_ctor'), ('two_' || i, 'strict_ctor'))
  u(tool_name, extraction_pattern) WHERE lang = 'de' AND source <> 'src3'""", "files")
view("agreed", """
SELECT package_key, parsed AS comparable, count(tool_name) FILTER (a) AS items_a,
  CASE WHEN parsed THEN count(tool_name) FILTER (b) END AS items_b,
  CASE WHEN parsed THEN count(tool_name) FILTER (a AND NOT b) ELSE 0 END AS only_a,
  CASE WHEN parsed THEN count(tool_name) FILTER (b AND NOT a) ELSE 0 END AS only_b,
  CASE WHEN parsed THEN coalesce(array_to_string(list_slice(list(tool_name ORDER BY tool_name) FILTER (a AND NOT b), 1, 12), '|'), '') ELSE '' END AS only_a_names,
  CASE WHEN parsed THEN coalesce(array_to_string(list_slice(list(tool_name ORDER BY tool_name) FILTER (b AND NOT a), 1, 12), '|'), '') ELSE '' END AS only_b_names
FROM (SELECT package_key, bool_or(language = 'python') AS parsed FROM files GROUP BY 1) LEFT JOIN (
  SELECT package_key, tool_name, bool_or(side = 'a') AS a, bool_or(side = 'b') AS b FROM (
  SELECT package_key, tool_name, 'a' AS side FROM tools UNION ALL SELECT package_key, tool_name, 'b' FROM strict) GROUP BY 1, 2) USING (package_key) GROUP BY 1, 2""",
     "tools", "strict", "files")
view("signals", """
SELECT l.name, l.version_count AS a, coalesce(e.n, 0) AS b FROM latest_counts l
LEFT JOIN (SELECT name, count(*) AS n FROM versions WHERE price > 200000 GROUP BY name) e USING (name) WHERE l.has_repository""",
     "latest_counts", "versions")


def with_views(sql: str, *names: str) -> str:
    """Prefix a query with the views it needs, in dependency order."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in VIEWS[n][0]:
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    for n in list(VIEWS):
        if n not in order and re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql):
            add(n)
    body = sql.strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in order)
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}" if ctes else body
    return f"WITH {ctes}\n{body}" if ctes else body
