"""Sources, sinks, payload projections, resume and integrity over data derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalens import schemas
from catalens.operators import flatten as fl, payloads as pa
from catalens.plans import bindings as b
from catalens.plans.registry import Catalogue
from catalens.session import scratch_dir
from catalens.sources import integrity as ig, readers as rd, requests as rq, sinks as sk
from catalens.streaming.ingest import ingest_known_pages, ingest_pages

Q = Catalogue()

_STATUS = "CASE WHEN o_orderstatus = 'P' THEN 'deprecated' ELSE 'active' END"
_LINES = "list_sort(list_filter([{}], lambda x: x IS NOT NULL))"
_FLAT = f"""
WITH l AS (SELECT l_orderkey, count(*) AS n, bool_or(l_returnflag = 'R') AS npm, bool_or(l_returnflag = 'A') AS pypi, bool_or(l_linestatus = 'O') AS stdio, bool_or(l_linestatus <> 'O') AS sse FROM lineitem GROUP BY 1)
SELECT 'c' || o_custkey AS name, NULL::VARCHAR AS title, o_orderpriority AS description, o_orderkey::VARCHAR AS version, NULL::VARCHAR AS schema,
 CASE WHEN o_orderstatus = 'O' THEN 'https://github.com/o/r' || o_custkey END AS repository_url, 'github' AS repository_source,
 CASE o_orderstatus WHEN 'P' THEN '' WHEN 'F' THEN 'https://example.org' END AS website_url, {_STATUS} AS status, o_orderpriority = '1-URGENT' AS is_latest,
 strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS published_at, NULL::VARCHAR AS updated_at, NULL::VARCHAR AS status_changed_at, coalesce(n, 0) AS package_count,
 CASE WHEN o_orderstatus <> 'O' THEN 1 ELSE 0 END::BIGINT AS remote_count,
 array_to_string({_LINES.format("CASE WHEN npm THEN 'npm' END, CASE WHEN pypi THEN 'pypi' END")}, '|') AS registry_types,
 array_to_string({_LINES.format("CASE WHEN stdio THEN 'stdio' END, CASE WHEN sse THEN 'sse' END, CASE WHEN o_orderstatus <> 'O' THEN 'streamable-http' END")}, '|') AS transports,
 coalesce(n, 0) AS env_var_count, coalesce(n, 0) > 0 AS has_packages, o_orderstatus <> 'O' AS has_remotes, o_orderstatus = 'O' AS has_repository, o_orderstatus = 'F' AS has_website
FROM orders LEFT JOIN l ON l_orderkey = o_orderkey"""


def _flat(df):
    flat = fl.flatten_entries(df)
    return flat.withColumn("registry_types", F.array_join("registry_types", "|")).withColumn("transports", F.array_join("transports", "|"))


@Q.add("flatten_entries", "P1", _FLAT)
def flatten_entries(s, d):
    return _flat(b.entries(s, d))


@Q.add("read_entries", "S1, S7, P1", _FLAT)
def read_entries(s, d):
    """Entries written as JSON lines and read back with the declared schema."""
    path = scratch_dir(s, "entries")
    sk.save_jsonl(b.entries(s, d), path)
    return _flat(rd.read_entries(s, path))


@Q.add("extract_packages", "P2", f"""
SELECT 'c' || o_custkey AS server_name, o_orderkey::VARCHAR AS server_version, o_orderpriority = '1-URGENT' AS is_latest, {_STATUS} AS status, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS published_at,
 CASE l_returnflag WHEN 'R' THEN 'npm' WHEN 'A' THEN 'pypi' END AS registry_type, NULL::VARCHAR AS registry_base_url, 'p' || l_partkey AS identifier, NULL::VARCHAR AS package_version,
 CASE WHEN l_linestatus = 'O' THEN 'stdio' ELSE 'sse' END AS transport_type, NULL::VARCHAR AS transport_url, NULL::VARCHAR AS runtime_hint, l_linestatus = 'F' AS has_runtime_args, false AS has_package_args
FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def extract_packages(s, d):
    return fl.extract_packages(b.entries(s, d))


@Q.add("extract_env_vars", "P3", """
SELECT 'c' || o_custkey AS server_name, o_orderkey::VARCHAR AS server_version, o_orderpriority = '1-URGENT' AS is_latest, CASE l_returnflag WHEN 'R' THEN 'npm' WHEN 'A' THEN 'pypi' END AS registry_type,
 'p' || l_partkey AS identifier, 'VAR_' || l_linenumber AS var_name, NULL::VARCHAR AS var_description, l_linestatus = 'F' AS is_required, l_returnflag = 'R' AS is_secret,
 NULL::VARCHAR AS default_value, NULL::VARCHAR AS format, NULL::VARCHAR AS choices FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def extract_env_vars(s, d):
    return fl.extract_env_vars(b.entries(s, d)).withColumn("choices", F.array_join("choices", "|"))


@Q.add("extract_remotes", "P4", """
SELECT 'c' || o_custkey AS server_name, o_orderkey::VARCHAR AS server_version, o_orderpriority = '1-URGENT' AS is_latest, 'streamable-http' AS remote_type,
 'http://10.0.0.1:80/' || o_custkey AS remote_url FROM orders WHERE o_orderstatus <> 'O'""")
def extract_remotes(s, d):
    return fl.extract_remotes(b.entries(s, d))


@Q.add("read_jsonl", "S2", """
SELECT 'good' AS kind, event_type, count(*) AS lines, sum((props->>'$.k')::BIGINT)::BIGINT AS total FROM events WHERE event_type <> 'error' GROUP BY 2
UNION ALL SELECT 'malformed', NULL, count(*), NULL FROM events WHERE event_type = 'error'""")
def read_jsonl(s, d):
    path = scratch_dir(s, "lines")
    whole = F.concat(F.lit('{"kind": "'), F.col("event_type"), F.lit('", "props": '), F.col("props"), F.lit("}"))
    line = F.when(F.col("event_type") == "error", F.left(whole, F.length(whole) - 3)).otherwise(F.concat(F.lit("\n"), whole))
    b.table(s, d, "events").select(line.alias("value")).write.text(path)
    good, bad = rd.read_jsonl(s, path, "kind string, props struct<k: bigint>")
    counted = good.groupBy(F.col("kind").alias("event_type")).agg(F.count(F.lit(1)).alias("lines"), F.sum("props.k").alias("total"))
    broken = bad.agg(F.count(F.lit(1)).alias("lines")).select(
        F.lit("malformed").alias("kind"), F.lit(None).cast("string").alias("event_type"), "lines", F.lit(None).cast("bigint").alias("total"))
    return counted.select(F.lit("good").alias("kind"), "event_type", "lines", "total").unionByName(broken)


@Q.add("ingest_pages", "S3", "SELECT page_id, url, length(html) AS chars FROM pages")
def ingest_pages_query(s, d):
    """Two landings of page files and three runs: each run appends only what is new, the third nothing."""
    base = scratch_dir(s, "pages")
    pages = b.table(s, d, "pages")
    secure = F.col("url").startswith("https:")
    args = (f"{base}/in", f"{base}/table", f"{base}/cursor", pages.schema)
    pages.where(secure).write.json(f"{base}/in")
    ingest_pages(s, *args, pages_per_batch=2)
    pages.where(~secure).write.mode("append").json(f"{base}/in")
    ingest_pages(s, *args)
    return ingest_pages(s, *args).select("page_id", "url", F.length("html").cast("bigint").alias("chars"))


@Q.add("ingest_known_pages", "S3", "SELECT page_id, url, length(html) AS chars FROM pages")
def ingest_known_pages_query(s, d):
    """Page files landed twice under different names, in one run and over two: every page's rows arrive once."""
    base = scratch_dir(s, "known-pages")
    pages = b.table(s, d, "pages")
    secure = F.col("url").startswith("https:")
    args = (f"{base}/in/*", f"{base}/table", f"{base}/cursor", pages.schema)
    for name, some in (("a", secure), ("b", secure)):
        pages.where(some).write.json(f"{base}/in/{name}")
    ingest_known_pages(s, *args)
    for name, some in (("c", ~secure), ("d", secure)):
        pages.where(some).write.json(f"{base}/in/{name}")
    return ingest_known_pages(s, *args).select("page_id", "url", F.length("html").cast("bigint").alias("chars"))


_SHEET = ["item_id", "part", "quality", "toxic", "notes"]


@Q.add("read_coded_csv", "S4", """
SELECT doc_id::VARCHAR AS item_id, lang AS part, quality::VARCHAR AS quality, toxic::VARCHAR AS toxic, 'seen,' || chr(10) || '"twice"' AS notes FROM raters""")
def read_coded_csv(s, d):
    """Sheets of a thousand ids, every other one with its columns in reverse, fenced, marked and with line breaks in cells."""
    path = scratch_dir(s, "sheets")
    cells = F.array(F.col("doc_id").cast("string"), "lang", F.concat(F.lit(" "), F.col("quality").cast("string")),
                    F.col("toxic").cast("string"), F.lit('"seen,\n""twice"""'))
    header, sheet = F.array(*[F.lit(c) for c in _SHEET]), F.floor(F.col("doc_id") / 1000)
    ordered = lambda c: F.array_join(F.when(F.col("sheet") % 2 == 0, c).otherwise(F.reverse(c)), ",")
    lines = b.raters(s, d).select(sheet.alias("sheet"), cells.alias("cells")).withColumn("line", ordered(F.col("cells")))
    texts = lines.groupBy("sheet").agg(F.concat(
        F.lit("\ufeff```csv\n\n"), ordered(header), F.lit("\r\n"), F.array_join(F.collect_list("line"), "\r\n"), F.lit("\n```")).alias("value"))
    texts.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return rd.read_coded_csv(s, path, _SHEET)


@Q.add("repair_arity", "S5", """
SELECT doc_id::VARCHAR AS a, CASE WHEN lang = 'en' THEN 'B' ELSE 'C' END AS b, quality::VARCHAR AS c, CASE WHEN lang = 'en' THEN toxic::VARCHAR ELSE '' END AS d,
 CASE WHEN lang = 'en' THEN '' ELSE toxic::VARCHAR END AS e, lang NOT IN ('en', 'fr') AS repaired, CASE WHEN lang = 'fr' THEN 'more|cells' ELSE '' END AS surplus FROM raters""")
def repair_arity(s, d):
    part = F.when(F.col("lang") == "en", "B").otherwise("C")
    line = F.concat_ws(",", F.col("doc_id").cast("string"), part, F.col("quality").cast("string"), F.when(F.col("lang") == "fr", F.lit("")),
                       F.col("toxic").cast("string"))
    lines = b.raters(s, d).select(F.concat(line, F.when(F.col("lang") == "fr", F.lit(",more,cells")).otherwise(F.lit(""))).alias("line"))
    repaired = rd.repair_arity(lines, "line", ["a", "b", "c", "d", "e"], 3, F.get("cells", 1) == "C")
    return repaired.withColumn("surplus", F.array_join("surplus", "|"))


_TABLE = "SELECT l_returnflag, l_linestatus, count(*) AS lines, round_even(avg(l_quantity), 1) AS mean_quantity FROM lineitem GROUP BY 1, 2"


def _result_table(s, d):
    return b.table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("lines"), F.bround(F.avg("l_quantity"), 1).alias("mean_quantity"))


@Q.add("save_table", "S6", _TABLE.replace("mean_quantity", "mean_quantity, (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)) AS written", 1))
def save_table(s, d):
    path = scratch_dir(s, "table")
    written = sk.save_table(_result_table(s, d), path)
    schema = "l_returnflag string, l_linestatus string, lines bigint, mean_quantity double"
    return s.read.schema(schema).option("header", True).csv(path).withColumn("written", F.lit(written).cast("bigint"))


@Q.add("save_jsonl", "S7", _TABLE)
def save_jsonl(s, d):
    path = scratch_dir(s, "jsonl")
    sk.save_jsonl(_result_table(s, d), path)
    return rd.read_jsonl(s, path, "l_returnflag string, l_linestatus string, lines bigint, mean_quantity double")[0]


_KEY = """left(sha256(split_part(split_part(url, '?', 1), '#', 1) || '?' || 'host=' || split_part(url, '/', 3) || '&page=a+' || page_id || '%2Ax~'), 32)"""


def _requests(s, d):
    params = F.create_map(
        F.lit("page"), F.concat(F.lit("a "), F.col("page_id").cast("string"), F.lit("*x~")), F.lit("host"), F.split_part("url", F.lit("/"), F.lit(3)))
    address = F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    return b.table(s, d, "pages").select("page_id", "html", rq.request_key(address, params).alias("request_key"))


@Q.add("request_key", "S9", f"SELECT page_id, {_KEY} AS request_key FROM pages")
def request_key(s, d):
    return _requests(s, d).select("page_id", "request_key")


@Q.add("cache_split", "S10", """
SELECT page_id, CASE WHEN contains(html, 'lang="en"') THEN 'fresh' WHEN contains(html, 'lang="fr"') THEN 'error' ELSE 'cached' END AS outcome FROM pages""")
def cache_split(s, d):
    return _cache(s, d).select("page_id", "outcome")


def _cache(s, d):
    r = _requests(s, d)
    landed = r.where(~F.contains("html", F.lit('lang="en"'))).select(
        "request_key", F.when(F.contains("html", F.lit('lang="fr"')), '{"__http_error__": 404}').otherwise('{"ok": true}').alias("payload"))
    return rq.cache_split(r.select("page_id", "request_key"), landed)


@Q.add("cache_stats", "S10", """
SELECT count(*) FILTER (contains(html, 'lang="en"')) AS fresh, count(*) FILTER (NOT contains(html, 'lang="en"') AND NOT contains(html, 'lang="fr"')) AS cached,
 count(*) FILTER (contains(html, 'lang="fr"') AND NOT contains(html, 'lang="en"')) AS error FROM pages""")
def cache_stats(s, d):
    return rq.cache_stats(_cache(s, d))


@Q.add("digest_files", "S11", """
SELECT 'month=' || month AS folder, sum(octet_length(encode(line)))::BIGINT AS bytes, sha256(string_agg(line, '' ORDER BY o_orderkey)) AS sha256
FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey, o_orderkey || chr(10) AS line FROM orders) GROUP BY month""")
def digest_files(s, d):
    """Digests of a landed tree: the order keys of every month, in order, as one file in the month's folder."""
    path = scratch_dir(s, "tree")
    keys = b.table(s, d, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderkey", F.col("o_orderkey").cast("string").alias("value"))
    landed = keys.repartition("month").sortWithinPartitions("month", "o_orderkey").select("month", "value")
    landed.write.partitionBy("month").text(path)
    found = ig.digest_files(s, path, root=f"{path.rsplit('/', 1)[-1]}/", glob="*.txt")
    return found.select(F.substring_index("path", "/", 1).alias("folder"), "bytes", "sha256")


@Q.add("digest_files_chunked", "S11", """
SELECT 'month=' || month AS folder, sum(octet_length(encode(line)))::BIGINT AS bytes, sha256(string_agg(line, '' ORDER BY o_orderkey)) AS sha256
FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey, o_orderkey || chr(10) AS line FROM orders) GROUP BY month""")
def digest_files_chunked(s, d):
    """The same tree with every file above 100 bytes read in chunks, as files beyond a cell's size are."""
    path = scratch_dir(s, "tree")
    keys = b.table(s, d, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderkey", F.col("o_orderkey").cast("string").alias("value"))
    landed = keys.repartition("month").sortWithinPartitions("month", "o_orderkey").select("month", "value")
    landed.write.partitionBy("month").text(path)
    found = ig.digest_files(s, path, root=f"{path.rsplit('/', 1)[-1]}/", glob="*.txt", largest_cell=100)
    return found.select(F.substring_index("path", "/", 1).alias("folder"), "bytes", "sha256")


_DIGEST = "sha256(doc_id || chr(1) || text || chr(1) || lang)"


@Q.add("digest_rows", "S12", f"SELECT doc_id, {_DIGEST} AS sha256 FROM documents")
def digest_rows(s, d):
    return ig.digest_rows(b.table(s, d, "documents"), "doc_id", ["doc_id", "text", "lang"])


_VERIFY = """SELECT doc_id, CASE WHEN lang = 'es' THEN 'MISSING' WHEN lang = 'de' AND text <> lower(text) THEN 'MISMATCH' ELSE 'ok' END AS status FROM documents"""


def _verified(s, d):
    docs = b.table(s, d, "documents")
    manifest = ig.digest_rows(docs, "doc_id", ["text"])
    changed = docs.where("lang <> 'es'").withColumn("text", F.when(F.col("lang") == "de", F.lower("text")).otherwise(F.col("text")))
    return ig.verify_manifest(manifest, ig.digest_rows(changed, "doc_id", ["text"]), "doc_id")


@Q.add("verify_manifest", "S13", _VERIFY)
def verify_manifest(s, d):
    return _verified(s, d)


@Q.add("verification_counts", "S13", f"""
SELECT count(*) FILTER (status = 'ok') AS verified, count(*) FILTER (status = 'MISSING') AS missing, count(*) FILTER (status = 'MISMATCH') AS mismatched,
 count(*) FILTER (status = 'UNVERIFIED') AS unverified FROM ({_VERIFY})""")
def verification_counts(s, d):
    return ig.verification_counts(_verified(s, d))


@Q.add("manifest_totals", "S11, S12", "SELECT count(*) AS file_count, sum(octet_length(encode(text)))::BIGINT AS total_bytes FROM documents")
def manifest_totals(s, d):
    return ig.manifest_totals(b.table(s, d, "documents").select(F.octet_length("text").cast("bigint").alias("bytes")))


# --- payloads -------------------------------------------------------------------------------------
def _payload(s, d, *parts):
    """Events with a JSON text column built from their own columns."""
    return b.heavy(s, d, "events").select("event_id", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("payload"))




def _cols():
    i = F.col("event_id").cast("string")
    kind = F.col("event_type")
    n = F.get_json_object("props", "$.k").cast("int")
    return i, kind, n


_EV = "WITH e AS (SELECT event_id, event_type AS t, (props->>'$.k')::INT AS n FROM events) "


@Q.add("project_npm", "P5", _EV + """
SELECT event_id, CASE WHEN ok THEN 'pkg-' || event_id END AS npm_name, CASE WHEN ok AND t <> 'view' THEN '1.' || n END AS npm_latest_version, CASE WHEN ok THEN '2024-01-01' END AS npm_created, NULL::VARCHAR AS npm_modified,
 CASE WHEN ok THEN 2 END::BIGINT AS npm_version_count, CASE WHEN ok THEN CASE WHEN t = 'click' THEN 'MIT' ELSE 'ISC' END END AS npm_license, CASE WHEN ok THEN t = 'click' END AS npm_deprecated,
 CASE WHEN ok THEN CASE t WHEN 'click' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END END::BIGINT AS npm_maintainer_count, CASE WHEN ok THEN t IN ('click', 'purchase') END AS npm_has_repository,
 CASE WHEN ok THEN CASE WHEN t = 'view' THEN 0 ELSE 2 END END::BIGINT AS npm_dependencies, CASE WHEN ok THEN CASE WHEN t = 'view' THEN 0 ELSE 1 END END::BIGINT AS npm_dev_dependencies,
 CASE WHEN ok THEN CASE WHEN t = 'view' THEN '' ELSE 'build|test' END END AS npm_scripts, CASE WHEN ok AND t <> 'view' THEN 'https://files.example.org/' || event_id || '.tgz' END AS npm_tarball,
 CASE WHEN NOT ok THEN 404 END::BIGINT AS error FROM (SELECT *, t <> 'error' AS ok FROM e)""")
def project_npm(s, d):
    i, kind, n = _cols()
    version = F.concat(F.lit("1."), n.cast("string"))
    latest = F.when(kind == "view", "{}").otherwise(F.concat(F.lit('{"latest": "'), version, F.lit('"}')))
    people = F.when(kind == "click", '[{"name": "a"}, {"name": "b"}]').when(kind == "purchase", '{"name": "a"}').otherwise("null")
    own = F.when(kind == "click", '"license": "MIT", "deprecated": "use other", "repository": {"url": "git+x"}, ').when(
        kind == "purchase", '"deprecated": false, "repository": "x/y", ').otherwise('"repository": {"type": "git"}, ')
    ok = F.concat(
        F.lit('{"name": "pkg-'), i, F.lit('", "dist-tags": '), latest, F.lit(', "license": "ISC", "time": {"created": "2024-01-01"}, "maintainers": '), people,
        F.lit(', "versions": {"0.0.1": {}, "'), version, F.lit('": {'), own,
        F.lit('"dependencies": {"a": "1", "b": "2"}, "devDependencies": {"c": "3"}, "scripts": {"test": "t", "build": "b"}, "dist": {"tarball": "https://files.example.org/'), i, F.lit('.tgz"}}}}'))
    return pa.project_npm(_payload(s, d, F.when(kind == "error", '{"__http_error__": 404, "detail": "gone"}').otherwise(ok)), keep=("event_id",))


@Q.add("project_downloads", "P6", _EV + "SELECT event_id, CASE WHEN t <> 'error' AND t <> 'view' THEN n::BIGINT END AS npm_monthly_downloads FROM e")
def project_downloads(s, d):
    i, kind, n = _cols()
    ok = F.concat(F.lit('{"downloads": '), F.when(kind == "view", '"n.a."').otherwise(n.cast("string")), F.lit(', "package": "x"}'))
    return pa.project_downloads(_payload(s, d, F.when(kind == "error", '{"__http_error__": 500}').otherwise(ok)), keep=("event_id",))


@Q.add("project_pypi", "P7", _EV + """
SELECT event_id, CASE WHEN ok THEN 'pkg-' || event_id END AS pypi_name, CASE WHEN ok THEN '2.' || n END AS pypi_latest_version, CASE WHEN ok THEN 'About ' || t END AS pypi_summary,
 CASE WHEN ok AND t = 'click' THEN 'MIT' END AS pypi_license, CASE WHEN ok THEN '>=3.9' END AS pypi_requires_python, CASE WHEN ok THEN 3 END::BIGINT AS pypi_release_count, NULL::VARCHAR AS pypi_author,
 CASE WHEN ok THEN CASE WHEN t = 'click' THEN 'Docs|Source' ELSE '' END END AS pypi_project_urls, CASE WHEN ok THEN CASE WHEN t = 'view' THEN 2 ELSE 0 END END::BIGINT AS pypi_requires_dist,
 CASE WHEN ok THEN t = 'purchase' END AS pypi_yanked, CASE WHEN NOT ok THEN 404 END::BIGINT AS error FROM (SELECT *, t <> 'error' AS ok FROM e)""")
def project_pypi(s, d):
    i, kind, n = _cols()
    ok = F.concat(
        F.lit('{"info": {"name": "pkg-'), i, F.lit('", "version": "2.'), n.cast("string"), F.lit('", "summary": "About '), kind, F.lit('", "requires_python": ">=3.9", "license": '),
        F.when(kind == "click", '"MIT"').otherwise("null"), F.lit(', "project_urls": '), F.when(kind == "click", '{"Source": "s", "Docs": "d"}').otherwise("null"),
        F.lit(', "requires_dist": '), F.when(kind == "view", '["a", "b>1"]').otherwise("null"),
        F.lit('}, "releases": {"1.0": [{"yanked": false}], "1.1": null, "1.2": [{"yanked": false}, {"yanked": '), F.when(kind == "purchase", "true").otherwise("false"), F.lit("}]}}"))
    return pa.project_pypi(_payload(s, d, F.when(kind == "error", '{"__http_error__": 404}').otherwise(ok)), keep=("event_id",))


@Q.add("project_repo", "P8", _EV + """
SELECT event_id, 'o/r' || event_id AS repo_full_name, 'o' AS repo_owner, 'r' || event_id AS repo_name, 'https://github.com/o/r' || event_id AS repo_url, t AS repo_description, n::BIGINT AS repo_stars,
 NULL::BIGINT AS repo_forks, 3::BIGINT AS repo_watchers, 4::BIGINT AS repo_open_issues, CASE WHEN t = 'click' THEN 'Go' END AS repo_language, CASE WHEN t = 'view' THEN 'MIT' END AS repo_license,
 '2024-01-01T00:00:00Z' AS repo_created_at, NULL::VARCHAR AS repo_pushed_at, NULL::VARCHAR AS repo_updated_at, 9::BIGINT AS repo_size_kb, 'main' AS repo_default_branch,
 CASE WHEN t = 'purchase' THEN 'x|y' ELSE '' END AS repo_topics, t = 'signup' AS repo_is_fork, false AS repo_archived, true AS repo_has_issues FROM e WHERE t <> 'error'""")
def project_repo(s, d):
    i, kind, n = _cols()
    ok = F.concat(
        F.lit('{"full_name": "o/r'), i, F.lit('", "owner": {"login": "o"}, "name": "r'), i, F.lit('", "html_url": "https://github.com/o/r'), i, F.lit('", "description": "'), kind,
        F.lit('", "stargazers_count": '), n.cast("string"), F.lit(', "subscribers_count": 3, "open_issues_count": 4, "language": '), F.when(kind == "click", '"Go"').otherwise("null"),
        F.lit(', "license": '), F.when(kind == "view", '{"spdx_id": "MIT"}').otherwise("null"), F.lit(', "created_at": "2024-01-01T00:00:00Z", "size": 9, "default_branch": "main", "topics": '),
        F.when(kind == "purchase", '["x", "y"]').otherwise("[]"), F.lit(', "has_issues": true, "fork": '), F.when(kind == "signup", "true").otherwise("null"), F.lit("}"))
    return pa.project_repo(_payload(s, d, F.when(kind == "error", '{"__http_error__": 404}').otherwise(ok)), keep=("event_id",))


@Q.add("project_releases", "P9", _EV + """
SELECT 'o/r' || event_id AS repo_full_name, u.* FROM e, LATERAL (VALUES ('v' || n, t, '2024-02-01T00:00:00Z', true, false, 2::BIGINT), ('v0', NULL, NULL, false, false, 0::BIGINT))
 u(release_tag, release_name, release_published_at, release_prerelease, release_draft, release_assets) WHERE t NOT IN ('error', 'view')""")
def project_releases(s, d):
    i, kind, n = _cols()
    ok = F.concat(
        F.lit('[{"tag_name": "v'), n.cast("string"), F.lit('", "name": "'), kind, F.lit('", "published_at": "2024-02-01T00:00:00Z", "prerelease": true, "draft": false, "assets": [{"id": 1}, {"id": 2}]}, {"tag_name": "v0"}]'))
    payload = F.when(kind == "error", '{"__http_error__": 404}').when(kind == "view", "[]").otherwise(ok)
    df = b.heavy(s, d, "events").select(F.concat(F.lit("o/r"), i).alias("repo"), payload.alias("payload"))
    return pa.project_releases(df, "repo")


@Q.add("pick_sdist", "P10", _EV + """
SELECT event_id, CASE t WHEN 'click' THEN 'sdist' WHEN 'purchase' THEN 'bdist_wheel' END AS packagetype,
 CASE t WHEN 'click' THEN 's' || event_id WHEN 'purchase' THEN 'w' || event_id END AS url FROM e""")
def pick_sdist(s, d):
    i, kind, n = _cols()
    wheel, sdist = F.concat(F.lit('{"packagetype": "bdist_wheel", "url": "w'), i, F.lit('"}')), F.concat(F.lit('{"packagetype": "sdist", "url": "s'), i, F.lit('"}'))
    files = F.when(kind == "click", F.concat(wheel, F.lit(", "), sdist)).when(kind == "purchase", wheel).otherwise("")
    payload = F.when(kind == "error", '{"__http_error__": 404}').otherwise(F.concat(F.lit('{"urls": ['), files, F.lit("]}")))
    return pa.pick_sdist(b.table(s, d, "events").select("event_id", payload.alias("payload")), keep=("event_id",))


@Q.add("month_buckets", "P14", """
SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS events FROM events WHERE event_type <> 'error' GROUP BY 1, 2
UNION ALL SELECT NULL, 'error', count(*) FROM events WHERE event_type = 'error'""")
def month_buckets(s, d):
    from catalens.functions.text import month_of

    stamp = F.when(F.col("event_type") == "error", "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return b.table(s, d, "events").groupBy(month_of(stamp).alias("month"), "event_type").agg(F.count(F.lit(1)).alias("events"))
