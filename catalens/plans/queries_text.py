"""Extraction from text, prose profiles, sampling, agreement and intervals over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalens import fixed_values as fx
from catalens.functions import text as tx, vocab as vo
from catalens.operators import agreement as ag, evidence as ev, extraction as ex, prose as pr, sampling as sa, statistics as st
from catalens.plans import bindings as b
from catalens.plans.oracle_views import NWS, WS, digest_int, pct, poisson1, squeeze, uniform, words
from catalens.plans.queries_keys import PAIRS_SQL, coder_pairs, stored_signals
from catalens.plans.registry import Catalogue

Q = Catalogue()
HIT = "package_key, server_name, language, path, tool_name, tool_description, has_schema, extraction_pattern"
KEEP = ["package_key", "server_name", "language", "path"]


def scanned(s, d):
    return ex.select_source_files(b.source_files(s, d))


# --- extraction -----------------------------------------------------------------------------------
@Q.add("select_source_files", "X4", "SELECT package_key, server_name, language, path FROM files")
def select_source_files(s, d):
    return scanned(s, d).select("package_key", "server_name", "language", "path")


@Q.add("extract_calls_js", "X5", f"SELECT {HIT} FROM found_js")
def extract_calls_js(s, d):
    return ex.extract_calls_js(scanned(s, d), KEEP).drop("position")


@Q.add("extract_decorators", "X6", f"SELECT {HIT} FROM found_decorators")
def extract_decorators(s, d):
    return ex.extract_decorators(scanned(s, d), KEEP).drop("position")


@Q.add("extract_ctors", "X7", f"SELECT {HIT} FROM found_ctors")
def extract_ctors(s, d):
    return ex.extract_ctors(scanned(s, d), KEEP).drop("position")


@Q.add("scan_coverage", "X8", """
SELECT package_key, n AS files_scanned, coalesce(t, 0) AS tools_found FROM (SELECT package_key, count(*) AS n FROM files GROUP BY 1)
LEFT JOIN (SELECT package_key, count(*) AS t FROM tools GROUP BY 1) USING (package_key)""")
def scan_coverage(s, d):
    files = scanned(s, d)
    return ex.scan_coverage(files, ex.extract_tools(files))


@Q.add("extract_strict", "X9", "SELECT package_key, path, tool_name, extraction_pattern FROM strict")
def extract_strict(s, d):
    return ex.extract_strict(scanned(s, d), ["package_key", "path"]).drop("position")


@Q.add("document_assignments", "X5, X10", """
SELECT doc_id, lower(trim(name)) AS name, value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Za-z_]+) = "([^"]+)"', 1)) AS name,
 unnest(regexp_extract_all(text, '([A-Za-z_]+) = "([^"]+)"', 2)) AS value FROM documents)""")
def document_assignments(s, d):
    pattern = '([A-Za-z_]+) = "([^"]+)"'
    hits = b.table(s, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("h"))
    return hits.select("doc_id", F.lower(F.trim(F.regexp_extract("h", pattern, 1))).alias("name"), F.regexp_extract("h", pattern, 2).alias("value"))


@Q.add("snippets", "X10", """
WITH t AS (SELECT package_key, list_slice(list(DISTINCT tool_name ORDER BY tool_name), 1, 8) AS terms FROM tools GROUP BY 1),
 js AS (SELECT package_key, path, 'server.tool("alpha_' || i || '", "' || d || '", shape);' || chr(10) || 'server.registerTool("beta_' || i || '", { description: "Does \\"beta\\"", inputSchema: shape });' || chr(10)
  || 'tools = [{ name: "gamma_' || source || '", title: "G", description: "' || d || '" }];' || chr(10)
  || 'server.registerTool("nest_' || i || '", {' || chr(10) || '  inputSchema: { type: "object", properties: { a: { description: "an } argument" } } },' || chr(10)
  || '  description: "Nested (body" }, handler);' || chr(10) || 'list.push({ name: "lit_' || i || '", annotations: { readOnly: true, hint: { schema: 1 } }, description: "Literal" });' || chr(10)
  || text AS body FROM files WHERE lang IN ('en', 'fr')),
 py AS (SELECT package_key, path, CASE WHEN source = 'src3' THEN '# Tool(name="old_' || i || '", description="gone")' || chr(10) ELSE '@app.tool()' || chr(10) || 'async def delta_' || i || '(a,' || chr(10) || '    b):' || chr(10) || '    \"\"\"' || d || chr(10) || '    \"\"\"' || chr(10) || '    return a' || chr(10)
  || '@app.tool(name="eps_' || source || '", description="' || d || '")' || chr(10) || 'def inner():' || chr(10) || '    pass' || chr(10)
  || '@app.tool()' || chr(10) || 'def _hidden_' || i || '():' || chr(10) || '    pass' || chr(10)
  || 't = types.Tool(name="zeta_' || i || '", description="Does zeta", input_schema={})' || chr(10) || '# Tool(name="old_' || i || '", description="gone")' || chr(10)
  || '@app.tool(' || chr(10) || '    name="multi_' || i || '",' || chr(10) || '    description="Reads (all) files",  # a :) note' || chr(10) || '    tags={"a": (1, 2)},' || chr(10) || ')' || chr(10) || '@other(' || chr(10) || '    1)' || chr(10)
  || 'def multi():' || chr(10) || '    pass' || chr(10) || 'x, y = Tool(name="one_' || i || '", description="First :)"), Tool(name="two_' || i || '")' || chr(10) END || text AS body FROM files WHERE lang = 'de'),
 l AS (SELECT f.package_key, path, string_split(body, chr(10)) AS lines, terms FROM (SELECT * FROM js UNION ALL SELECT * FROM py) f JOIN t USING (package_key)),
 h AS (SELECT package_key, path, lines, terms, unnest(range(1, len(lines) + 1)) AS n FROM l)
SELECT package_key, path, n AS line_no, left(regexp_replace(array_to_string(list_slice(lines, greatest(1, n - 1), n + 3), chr(10)), '^\\s+|\\s+$', '', 'g'), 300) AS snippet,
 row_number() OVER (PARTITION BY package_key ORDER BY path, n) AS rank
FROM h WHERE len(list_filter(terms, lambda x: contains(lines[n], x))) > 0 QUALIFY row_number() OVER (PARTITION BY package_key ORDER BY path, n) <= 6""")
def snippets(s, d):
    files = scanned(s, d)
    terms = ex.first_terms(ex.extract_tools(files), "package_key", "tool_name")
    return ex.snippets(files, terms).withColumn("rank", F.col("rank").cast("bigint"))


@Q.add("clean_description", "P21", f"""
SELECT turn, conv_id, {squeeze("replace(replace(text, '.', ' '), 'a', '\"')")} AS cleaned FROM conversations""")
def clean_description(s, d):
    escaped = F.replace(F.replace("text", F.lit("."), F.lit("\\n")), F.lit("a"), F.lit('\\"'))
    return b.table(s, d, "conversations").select("turn", "conv_id", tx.clean_description(escaped).alias("cleaned"))


_NUM = "regexp_extract_all(text, '(\\d[\\d,]*\\.?\\d*)', 1)"


@Q.add("numbers_in", "X11", f"""
WITH n AS (SELECT doc_id, unnest(list_transform({_NUM}, lambda x: replace(x, ',', ''))) AS number FROM documents)
SELECT DISTINCT doc_id, number FROM (SELECT * FROM n UNION ALL SELECT doc_id, regexp_replace(number, '\\.0$', '') FROM n WHERE ends_with(number, '.0'))""")
def numbers_in(s, d):
    return pr.numbers_in(b.heavy(s, d, "documents"), "doc_id", "text")


def _hits(p: str, text: str = "plain") -> str:
    """Matches of a pattern; `plain` has accented letters replaced, so ASCII word borders act like Unicode ones."""
    flags = ", 0, 'i'" if p.startswith("(?i)") else ""
    return f"len(regexp_extract_all({text}, '{p.removeprefix('(?i)').replace(chr(39), chr(39) * 2)}'{flags}))"


_PLAIN = r"regexp_replace(text, '[\x{c0}-\x{24f}]', 'z', 'g')"


def _sentences(table: str = "documents", columns: str = "doc_id, text") -> str:
    return f"""
s0 AS (SELECT {columns}, string_split(regexp_replace({squeeze('text')}, '([.!?]) ([A-Z(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS parts FROM {table}),
s1 AS (SELECT {columns}, list_filter(parts, lambda x: len(regexp_extract_all(x, '{NWS}')) >= 4) AS sents FROM s0),
s2 AS (SELECT *, {_PLAIN} AS plain, list_transform(sents, lambda x: len(regexp_extract_all(x, '{NWS}'))) AS lens,
 list_filter(list_transform(sents, lambda x: lower(regexp_extract(x, '^([A-Za-z'']+)', 1))), lambda x: x <> '') AS openings FROM s1)"""


_SENT = _sentences()
_FORM = " + ".join(_hits("(?i)" + p, "raw") for p in fx.CONNECTIVES)


def _rate(c: str) -> str:
    return f"CASE WHEN w > 0 THEN round_even(1000.0::DOUBLE * {c} / w, 1) ELSE 0.0::DOUBLE END"


_FOUND = ", ".join(f"{{'p': '{pr.pattern_label(p).replace(chr(39), chr(39) * 2)}', 'n': {_hits('(?i)' + p, 'raw')}}}" for p in fx.CONNECTIVES)


@Q.add("prose_profile", "X12", f"""
WITH parted AS (SELECT doc_id, {_PLAIN} AS raw, regexp_replace(text, '{fx.DASH}', ' {fx.DASH_WORD} ', 'g') AS text FROM documents), {_sentences('parted', 'doc_id, raw, text')},
 c AS (SELECT doc_id, lens, openings, {_hits(fx.WORD, 'text')} AS w, {_hits(fx.DASH, 'raw')} AS dashes, {_FORM} AS formulaic, {_hits(fx.TRIAD)} AS triads, {_hits('(?i)' + fx.NOT_BUT)} AS nb,
 {_hits('(?i)' + fx.PASSIVE)} AS pas, len(lens) AS n, len(list_filter(openings, lambda x: x = 'the')) AS ti, list_filter([{_FOUND}], lambda x: x.n > 0) AS found,
 list_sort(list_transform(map_entries(list_aggregate(openings, 'histogram')), lambda e: {{'less': -e.value::BIGINT, 'opening': e.key}})) AS tops FROM s2)
SELECT doc_id, w::BIGINT AS words, n::BIGINT AS sentences, CASE WHEN n > 0 THEN round_even(list_avg(lens), 1) ELSE 0.0::DOUBLE END AS mean_sentence_words,
 CASE WHEN n > 0 THEN round_even(list_stddev_pop(lens), 1) ELSE 0.0::DOUBLE END AS sd_sentence_words, coalesce(list_min(lens), 0)::BIGINT AS min_sentence_words,
 coalesce(list_max(lens), 0)::BIGINT AS max_sentence_words, dashes::BIGINT AS em_dashes, {_rate('dashes')} AS em_dashes_per_1000_words, formulaic::BIGINT AS formulaic_total,
 {_rate('formulaic')} AS formulaic_per_1000_words, {_rate('triads')} AS triads_per_1000_words, nb::BIGINT AS not_x_but_y, {_rate('nb')} AS not_x_but_y_per_1000_words,
 {_rate('pas')} AS passive_per_1000_words, ti::BIGINT AS the_initial_sentences, {pct('ti', 'n')} AS the_initial_pct,
 coalesce(array_to_string(list_transform(list_slice(tops, 1, 5), lambda x: x.opening || ':' || -x.less), ', '), '') AS top_sentence_openings,
 coalesce(array_to_string(list_transform(found, lambda x: x.p || ':' || x.n), ', '), '') AS formulaic_detail FROM c""")
def prose_profile(s, d):
    def listed(name: str, of: str, n: str):
        return F.array_join(F.transform(name, lambda e: F.concat(e[of], F.lit(":"), e[n].cast("string"))), ", ").alias(name)

    profile = pr.prose_profile(b.heavy(s, d, "documents"), "doc_id", "text")
    return profile.withColumns({"top_sentence_openings": listed("top_sentence_openings", "opening", "sentences"), "formulaic_detail": listed("formulaic_detail", "pattern", "n")})


_CONNECTIVES = ", ".join(f"('{pr.pattern_label(p).replace(chr(39), chr(39) * 2)}', {_hits('(?i)' + p, 'plain')})" for p in fx.CONNECTIVES)


@Q.add("pattern_counts", "X12", f"""
WITH {_SENT} SELECT doc_id, u.pattern, u.n::BIGINT AS n FROM s2, LATERAL (VALUES {_CONNECTIVES}) u(pattern, n) WHERE u.n > 0""")
def pattern_counts(s, d):
    return pr.pattern_counts(b.heavy(s, d, "documents"), "doc_id", "text")


_QUOTED = """
b AS (SELECT DISTINCT c_nationkey::VARCHAR AS nation, c_acctbal::VARCHAR AS number FROM customer),
q AS (SELECT DISTINCT c_nationkey::VARCHAR AS nation, CASE c_custkey % 4 WHEN 0 THEN c_acctbal::VARCHAR WHEN 1 THEN floor(c_acctbal * 100)::BIGINT::VARCHAR || '.0' WHEN 2 THEN (floor(c_acctbal * 10) / 10)::VARCHAR
  ELSE floor(c_acctbal)::BIGINT::VARCHAR || '7' END AS number FROM customer)"""


@Q.add("trace_numbers", "X11, J15", f"""
WITH {_QUOTED}, p AS (SELECT *, CASE WHEN contains(number, '.') THEN regexp_replace(number, '\\.?0*$', '') ELSE number END AS plain FROM q),
 bp AS (SELECT nation, CASE WHEN contains(number, '.') THEN regexp_replace(number, '\\.?0*$', '') ELSE number END AS plain, number::DOUBLE AS v FROM b)
SELECT nation, number, CASE WHEN EXISTS (SELECT 1 FROM bp WHERE bp.nation = p.nation AND bp.plain = p.plain) THEN 'same'
 WHEN EXISTS (SELECT 1 FROM bp WHERE bp.nation = p.nation AND abs(p.number::DOUBLE - v) <= 0.05::DOUBLE) THEN 'rounded'
 WHEN EXISTS (SELECT 1 FROM bp WHERE bp.nation = p.nation AND (abs(p.number::DOUBLE * 100.0::DOUBLE - v) <= 0.05::DOUBLE OR abs(p.number::DOUBLE * 0.01::DOUBLE - v) <= 0.05::DOUBLE)) THEN 'scaled' ELSE 'untraced' END AS status FROM p""")
def trace_numbers(s, d):
    nation, balance = F.col("c_nationkey").cast("string").alias("nation"), F.col("c_acctbal")
    way = F.col("c_custkey") % 4
    number = (F.when(way == 0, balance.cast("string")).when(way == 1, F.concat(F.floor(balance * 100).cast("long").cast("string"), F.lit(".0")))
              .when(way == 2, (F.floor(balance * 10) / 10).cast("string")).otherwise(F.concat(F.floor(balance).cast("long").cast("string"), F.lit("7"))))
    customers = b.table(s, d, "customer")
    return pr.trace_numbers(customers.select(nation, number.alias("number")), customers.select(nation, balance.cast("string").alias("number")), "nation")


@Q.add("top_openings", "X12", f"""
WITH {_SENT}, o AS (SELECT doc_id, unnest(openings) AS opening FROM s2), c AS (SELECT doc_id, opening, count(*) AS sentences FROM o GROUP BY 1, 2)
SELECT doc_id, opening, sentences, row_number() OVER (PARTITION BY doc_id ORDER BY sentences DESC, opening) AS rank FROM c
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sentences DESC, opening) <= 5""")
def top_openings(s, d):
    return pr.top_openings(b.heavy(s, d, "documents"), "doc_id", "text").withColumn("rank", F.col("rank").cast("bigint"))


@Q.add("section_profile", "X13", f"""
WITH p AS (SELECT page_id, html, regexp_extract_all(html, '<(?:h[1-6]|b|title)>([^<]*)<', 1) AS t, string_split_regex(html, '<(?:h[1-6]|b|title)>([^<]*)<') AS c FROM pages),
 u AS (SELECT page_id, html, t, c, unnest(range(1, len(t) + 1)) AS i FROM p)
SELECT page_id, i - 1 AS section, t[i] AS title, {words('c[i + 1]')} AS words, len(regexp_extract_all(c[i + 1], '<a href=')) AS refs,
 {pct(words('c[i + 1]'), words('html'))} AS share_pct FROM u""")
def section_profile(s, d):
    return pr.section_profile(b.heavy(s, d, "pages"), "page_id", "html", "<(?:h[1-6]|b|title)>([^<]*)<", "<a href=")


# --- sampling -------------------------------------------------------------------------------------
@Q.add("seeded_sample", "T1", """
SELECT doc_id, lang, (SELECT count(*) FROM documents) AS population_size, least(100, (SELECT count(*) FROM documents)) AS sample_size
FROM documents ORDER BY md5('20260924:' || doc_id), doc_id LIMIT 100""")
def seeded_sample(s, d):
    return sa.seeded_sample(b.table(s, d, "documents").select("doc_id", "lang"), "doc_id", 100, 20260924)


def _strata(n: int, seed: int) -> str:
    return f"""
WITH d AS (SELECT doc_id, lang, md5('{seed}:' || doc_id) AS h FROM documents),
 q AS (SELECT lang, least(greatest(1, round_even(count(*)::DOUBLE / (SELECT count(*) FROM d) * {n}, 0)::BIGINT), count(*)) AS quota FROM d GROUP BY 1),
 r AS (SELECT doc_id, lang, h, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS rn FROM d)
SELECT doc_id, lang FROM r JOIN q USING (lang) ORDER BY (rn <= quota) DESC, h, doc_id LIMIT {n}"""


for _n in (7, 150, 151):
    def _sample(s, d, n=_n):
        return sa.stratified_sample(b.table(s, d, "documents").select("doc_id", "lang"), "lang", "doc_id", n, 20260926)

    Q.add("stratified_sample" if _n == 150 else f"stratified_sample_{_n}", "T2", _strata(_n, 20260926))(_sample)


@Q.add("rater_subset", "T3", """
WITH b AS (SELECT c_name AS target FROM customer ORDER BY md5('1:' || c_custkey), c_custkey LIMIT 30),
 c AS (SELECT source || ' :: ' || doc_id AS target FROM documents ORDER BY md5('1:' || doc_id), doc_id LIMIT 40)
SELECT * FROM (SELECT 'B' || lpad(row_number() OVER (ORDER BY target)::VARCHAR, 3, '0') AS item_id, 'B' AS part, target FROM b) WHERE item_id <= 'B025'
UNION ALL SELECT * FROM (SELECT 'C' || lpad(row_number() OVER (ORDER BY target)::VARCHAR, 3, '0') AS item_id, 'C' AS part, target FROM c) WHERE item_id <= 'C026'""")
def rater_subset(s, d):
    customers = sa.seeded_sample(b.table(s, d, "customer").select("c_custkey", "c_name"), "c_custkey", 30, 1).select(F.col("c_name").alias("target"))
    docs = sa.seeded_sample(b.table(s, d, "documents").select("doc_id", "source"), "doc_id", 40, 1).select(
        F.concat("source", F.lit(" :: "), F.col("doc_id").cast("string")).alias("target"))
    return sa.rater_subset(sa.with_item_ids(customers, "B", ["target"], 30), sa.with_item_ids(docs, "C", ["target"], 40), 51, "target", "target")


# --- agreement ------------------------------------------------------------------------------------
def _kappa(source: str, by: str, digits: int = 3) -> str:
    cols = ", ".join(f"p.{c}" for c in by.split(", "))
    on = " AND ".join(f"p.{c} = e.{c}" for c in by.split(", "))
    return f"""
ma AS (SELECT {by}, a AS label, count(*)::DOUBLE AS ca FROM {source} GROUP BY ALL), mb AS (SELECT {by}, b AS label, count(*)::DOUBLE AS cb FROM {source} GROUP BY ALL),
e AS (SELECT {by}, sum(ca * cb) AS ab FROM ma JOIN mb USING ({by}, label) GROUP BY ALL),
o AS (SELECT {cols}, count(*) AS items, (count(*) FILTER (p.a = p.b))::DOUBLE / count(*) AS obs, coalesce(max(e.ab), 0) / (count(*)::DOUBLE * count(*)) AS exp
 FROM {source} p LEFT JOIN e ON {on} GROUP BY ALL),
kk AS (SELECT *, CASE WHEN exp < 1.0 THEN (obs - exp) / (1.0::DOUBLE - exp) END AS k FROM o)
SELECT {by}, items, round_even(obs, {digits}) AS observed_agreement, round_even(exp, {digits}) AS expected_agreement, round_even(k, {digits}) AS cohens_kappa,
 CASE WHEN k IS NULL THEN 'not estimable' WHEN k < 0 THEN 'poor' WHEN k < 0.2 THEN 'slight' WHEN k < 0.4 THEN 'fair' WHEN k < 0.6 THEN 'moderate' WHEN k < 0.8 THEN 'substantial' ELSE 'almost perfect' END AS band FROM kk"""


@Q.add("cohens_kappa", "T4", "WITH p0 AS (SELECT lang AS field, quality::VARCHAR AS a, toxic::VARCHAR AS b FROM raters)," + _kappa("p0", "field"))
def cohens_kappa(s, d):
    pairs = b.raters(s, d).select(F.col("lang").alias("field"), F.col("quality").cast("string").alias("a"), F.col("toxic").cast("string").alias("b"))
    return ag.agreement_table(pairs)


_COL = "CASE WHEN lower(trim({0})) IN ('', 'unclear', 'n/a', 'na', 'unknown') THEN 'undetermined' ELSE lower(trim({0})) END"
_HAR = "CASE WHEN lower(trim({0})) = 'unclear' THEN 'undetermined' ELSE trim({0}) END"


@Q.add("agreement_report", "T5, P20", f"""WITH raters_ AS (SELECT 1 FROM raters), {PAIRS_SQL},
vv AS (SELECT 'raw' AS variant, field, a, b FROM pairs UNION ALL SELECT 'collapsed', field, {_COL.format('a')}, {_COL.format('b')} FROM pairs
 UNION ALL SELECT 'harmonised', field, {_HAR.format('a')}, b FROM pairs
 UNION ALL SELECT 'without excluded items', field, a, b FROM pairs WHERE item_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src7')),""" + _kappa("vv", "variant, field"))
def agreement_report(s, d):
    pairs = coder_pairs(s, d)
    seen = b.table(s, d, "documents").where("source = 'src7'").select(F.col("doc_id").alias("item_id"))
    same = lambda c: c
    return ag.agreement_report(pairs, {
        "raw": (same, same), "collapsed": (vo.collapse_undetermined, vo.collapse_undetermined), "harmonised": (vo.harmonise, same),
    }, exclude=seen)


# --- intervals ------------------------------------------------------------------------------------
N_BOOT, SEED = 10_000, 20260928
_AT = f"max(draw) FILTER (pos = floor(0.025::DOUBLE * n)) AS low, max(draw) FILTER (pos = floor(0.975::DOUBLE * n) - 1) AS high"


def _u52(*parts: str) -> str:
    return f"(('0x' || substr(md5('{SEED}:' || {" || ':' || ".join(parts)}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE)"


def _law(name: str, laws: str, key: str, low: str, high: str, log_pmf: str) -> str:
    """A table of cumulative probabilities: the law's key, x, lo, hi."""
    return f"""{name}_p AS (SELECT *, exp({log_pmf}) AS p FROM (SELECT *, unnest(range({low}, {high} + 1)) AS x FROM (SELECT DISTINCT {key} FROM {laws}))),
 {name}_c AS (SELECT {key}, x, sum(p) OVER (PARTITION BY {key} ORDER BY x) / sum(p) OVER (PARTITION BY {key}) AS hi FROM {name}_p),
 {name} AS (SELECT {key}, x, coalesce(lag(hi) OVER o, 0.0::DOUBLE) AS lo, CASE WHEN lead(x) OVER o IS NULL THEN 2.0::DOUBLE ELSE hi END AS hi FROM {name}_c WINDOW o AS (PARTITION BY {key} ORDER BY x))"""


def _poisson(name: str, laws: str) -> str:
    side = "(ceil(12 * sqrt(m)) + 40)::BIGINT"
    return _law(name, laws, "m", f"greatest(0, m - {side})", f"m + {side}", "x * ln(m::DOUBLE) - m - lgamma(x + 1)")


def _proportion(parts: str) -> str:
    side = "(ceil(12 * sqrt(s * (1 - s::DOUBLE / k))) + CASE WHEN s > 0 AND s < k THEN 40 ELSE 0 END)::BIGINT"
    pmf = ("CASE WHEN s = 0 OR s = k THEN 0.0 ELSE lgamma(k + 1) - lgamma(x + 1) - lgamma(k - x + 1) + x * ln(s::DOUBLE / k) + (k - x) * ln(1 - s::DOUBLE / k) END")
    return f"""
WITH t AS ({parts}), r AS (SELECT *, {_u52('quantity', 'r')} AS u FROM (SELECT quantity, k, s, unnest(range({N_BOOT})) AS r FROM t WHERE k > 0)),
 {_law('pl', '(SELECT * FROM t WHERE k > 0)', 'k, s', f'greatest(0, s - {side})', f'least(k, s + {side})', pmf)},
 pd AS (SELECT quantity, draw, row_number() OVER (PARTITION BY quantity ORDER BY draw) - 1 AS pos, count(*) OVER (PARTITION BY quantity) AS n
   FROM (SELECT quantity, 100.0::DOUBLE * x / r.k AS draw FROM r JOIN pl ON r.k = pl.k AND r.s = pl.s AND u >= lo AND u < hi)),
 pc AS (SELECT quantity, {_AT} FROM pd GROUP BY 1)
SELECT quantity, round_even(100.0::DOUBLE * s / k, 1) AS value_pct, round_even(low, 1) AS ci95_low, round_even(high, 1) AS ci95_high, k AS n FROM t JOIN pc USING (quantity)"""


@Q.add("bootstrap_proportion", "T7", _proportion("""
SELECT 'quality' AS quantity, count(*) AS k, count(*) FILTER (quality = 1) AS s FROM labels UNION ALL SELECT 'toxic', count(*), count(*) FILTER (toxic = 1) FROM labels"""))
def bootstrap_proportion(s, d):
    return st.bootstrap_proportion(b.table(s, d, "labels"), {"quality": F.col("quality") == 1, "toxic": F.col("toxic") == 1}, N_BOOT, SEED)


@Q.add("bootstrap_proportion_many_rows", "T7", _proportion("""
SELECT 'returned' AS quantity, count(*) AS k, count(*) FILTER (l_returnflag = 'R') AS s FROM lineitem UNION ALL SELECT 'large', count(*), count(*) FILTER (l_quantity > 45) FROM lineitem"""))
def bootstrap_proportion_many_rows(s, d):
    return st.bootstrap_proportion(
        b.table(s, d, "lineitem"), {"returned": F.col("l_returnflag") == "R", "large": F.col("l_quantity") > 45}, N_BOOT, SEED)


def _clusters(clusters: str) -> str:
    """`clusters`: quantity, cluster, num, den."""
    return f"""
WITH cc AS (SELECT quantity, num::BIGINT AS num, den::BIGINT AS den, count(*) AS m FROM ({clusters}) GROUP BY 1, 2, 3), {_poisson('cl', 'cc')},
 cx AS (SELECT *, {_u52('quantity', 'num', 'den', 'r')} AS u FROM (SELECT *, unnest(range({N_BOOT})) AS r FROM cc WHERE den > 0)),
 cz AS (SELECT quantity, r, 100.0::DOUBLE * sum(num * x)::DOUBLE / sum(den * x)::DOUBLE AS draw FROM cx JOIN cl ON cx.m = cl.m AND u >= lo AND u < hi WHERE x > 0 GROUP BY 1, 2),
 cd AS (SELECT quantity, draw, row_number() OVER (PARTITION BY quantity ORDER BY draw) - 1 AS pos, count(*) OVER (PARTITION BY quantity) AS n FROM cz), ci AS (SELECT quantity, {_AT} FROM cd GROUP BY 1),
 ct AS (SELECT quantity, sum(num * m)::DOUBLE AS num, sum(den * m)::BIGINT AS n FROM cc GROUP BY 1)
SELECT quantity, round_even(100.0::DOUBLE * num / n, 1) AS value_pct, round_even(low, 1) AS ci95_low, round_even(high, 1) AS ci95_high, n FROM ct JOIN ci USING (quantity)"""


def _cluster(cells: str, label: str) -> str:
    return _clusters(f"SELECT '{label}' AS quantity, * FROM ({cells})")


@Q.add("bootstrap_cluster", "T8", _cluster("""
SELECT server_name AS cluster, count(*) FILTER (credential_named AND NOT is_secret) AS num, count(*) FILTER (credential_named) AS den FROM adjudicated GROUP BY 1""",
       "unflagged credential names, of credential-named"))
def bootstrap_cluster(s, d):
    from catalens.plans.queries_reports import adjudicated

    named = F.col("credential_named")
    return st.bootstrap_cluster(adjudicated(s, d), {"unflagged credential names, of credential-named": (~F.col("is_secret"), named)}, "server_name", N_BOOT, SEED)


@Q.add("bootstrap_cluster_labels", "T8", _cluster(
    "SELECT source AS cluster, count(*) FILTER (quality = 1) AS num, count(*) AS den FROM raters GROUP BY 1", "quality"))
def bootstrap_cluster_labels(s, d):
    return st.bootstrap_cluster(b.raters(s, d), {"quality": (F.col("quality") == 1, F.lit(True))}, "source", N_BOOT, SEED)


@Q.add("spearman", "T6", """
WITH r AS (SELECT rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE AS x,
 rank() OVER (ORDER BY w) + (count(*) OVER (PARTITION BY w) - 1) / 2.0::DOUBLE AS y FROM (SELECT n_chars, len(string_split(text, 'a')) AS w FROM documents))
SELECT round_even(corr(x, y), 6) AS rho FROM r""")
def spearman(s, d):
    df = b.table(s, d, "documents").select("n_chars", (F.regexp_count("text", F.lit("a")) + 1).alias("w"))
    return st.spearman(df, "n_chars", "w").select(F.bround("rho", 6).alias("rho"))


@Q.add("spearman_prices", "T6", """
WITH r AS (SELECT rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS x,
 rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS y FROM lineitem)
SELECT round_even(corr(x, y), 6) AS rho FROM r""")
def spearman_prices(s, d):
    return st.spearman(b.table(s, d, "lineitem"), "l_extendedprice", "l_quantity").select(F.bround("rho", 6).alias("rho"))


_RANKS = f"""
WITH sp AS (SELECT a, b, count(*) AS m FROM signals GROUP BY 1, 2), {_poisson('sl', 'sp')},
 sx AS (SELECT *, {_u52('a::DOUBLE', 'b::DOUBLE', 'r')} AS u FROM (SELECT *, unnest(range({N_BOOT})) AS r FROM sp)),
 sc AS (SELECT r, a, b, x::DOUBLE AS w FROM sx JOIN sl ON sx.m = sl.m AND u >= lo AND u < hi WHERE x > 0),
 ra AS (SELECT r, a, coalesce(sum(w) OVER (PARTITION BY r ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (w + 1) / 2 AS x FROM (SELECT r, a, sum(w) AS w FROM sc GROUP BY 1, 2)),
 rb AS (SELECT r, b, coalesce(sum(w) OVER (PARTITION BY r ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (w + 1) / 2 AS y FROM (SELECT r, b, sum(w) AS w FROM sc GROUP BY 1, 2)),
 sv AS (SELECT r, sum(w) * sum(w * x * x) - sum(w * x) ** 2 AS vx, sum(w) * sum(w * y * y) - sum(w * y) ** 2 AS vy, sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y) AS vxy FROM sc JOIN ra USING (r, a) JOIN rb USING (r, b) GROUP BY 1),
 sd AS (SELECT draw, row_number() OVER (ORDER BY draw) - 1 AS pos, count(*) OVER () AS n FROM (SELECT vxy / sqrt(vx) / sqrt(vy) AS draw FROM sv WHERE vx > 0 AND vy > 0)), si AS (SELECT {_AT} FROM sd),
 sk AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS x, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS y FROM signals)
SELECT (SELECT round_even(corr(x, y), 3) FROM sk) AS value, round_even(low, 3) AS ci95_low, round_even(high, 3) AS ci95_high, (SELECT count(*) FROM signals) AS n FROM si"""


@Q.add("bootstrap_spearman", "T9", _RANKS)
def bootstrap_spearman(s, d):
    return st.bootstrap_spearman(stored_signals(s, d), "a", "b", N_BOOT, SEED)


#: Shares of the interval table by basis: label, condition in SQL over the coded items (part C: not English; part B: English).
_CODED = {
    "coded tool definitions": ("lang <> 'en'", {
        "description states the purpose": "quality = 1", "description explains the inputs": "n_chars >= 600",
        "description names side effects": "toxic = 1", "description states when to use": "n_chars % 3 = 0",
        "confusable with a sibling tool": "n_chars % 5 > 0"}),
    "coded servers": ("lang = 'en'", {
        "authentication mechanism identified": "n_chars >= 400", "no authentication required": "n_chars % 4 = 0",
        "write capability": "quality = 1", "broad scope": "toxic = 1", "broad scope and write capability": "toxic = 1 and quality = 1"}),
}
_RULES = {"whole-word rule": "credential_named", "permissive substring rule": "looks_like_credential"}
_BASES = {"all published versions": [], "latest version only": ["is_latest"]}


def _credential_quantities() -> dict[str, tuple[list[str], list[str], str]]:
    """The eight shares over two bases, two rules and two denominators: conditions of numerator and denominator, basis."""
    out = {}
    for basis, within in _BASES.items():
        for rule, hit in _RULES.items():
            out[f"unflagged credential names, of credential-named ({rule}, {basis})"] = (["unflagged"], [hit, *within], basis)
            out[f"unflagged credential names, of all declared ({rule}, {basis})"] = ([hit, "unflagged"], ["declared", *within], basis)
    return out


def _interval_sql() -> str:
    width = "round_even(100.0::DOUBLE * 1.96::DOUBLE * sqrt(0.25::DOUBLE / n), 1) AS worst_half_width_pct"
    shares = [f"SELECT '{label}' AS quantity, count(*) FILTER ({part}) AS k, count(*) FILTER (({part}) AND ({cond})) AS s FROM raters"
              for part, conds in _CODED.values() for label, cond in conds.items()]
    shares.append("SELECT 'packages yielding at least one tool', count(*), count(*) FILTER (package_key IN (SELECT package_key FROM tools)) FROM (SELECT DISTINCT package_key FROM files)")
    shares.append("SELECT 'servers with no tagged release', count(*), count(*) FILTER (b = 0) FROM signals")
    basis_of = {label: basis for basis, (_, conds) in _CODED.items() for label in conds} | {
        "packages yielding at least one tool": "sampled packages", "servers with no tagged release": "sampled repositories"}
    basis = "CASE quantity " + " ".join(f"WHEN '{q}' THEN '{v}'" for q, v in basis_of.items()) + " END"
    names = {"unflagged": "NOT is_secret", "declared": "true"}
    both = lambda conds: " AND ".join(names.get(c, c) for c in conds)
    clusters = " UNION ALL ".join(
        f"SELECT '{label}' AS quantity, server_name AS cluster, count(*) FILTER ({both(num + den)}) AS num, count(*) FILTER ({both(den)}) AS den FROM adjudicated GROUP BY server_name"
        for label, (num, den, _) in _credential_quantities().items())
    return f"""
WITH ia AS ({_proportion(" UNION ALL ".join(shares))}), ib AS ({_clusters(clusters)}), ic AS ({_RANKS})
SELECT *, {basis} AS basis, {width} FROM ia
UNION ALL SELECT *, CASE WHEN ends_with(quantity, 'latest version only)') THEN 'latest version only' ELSE 'all published versions' END, {width} FROM ib
UNION ALL SELECT 'Spearman correlation, registry versions vs releases', value, ci95_low, ci95_high, n, 'sampled repositories', NULL FROM ic"""


@Q.add("interval_table", "T10", _interval_sql())
def interval_table(s, d):
    from catalens.plans.queries_reports import adjudicated

    coded = {label: (F.expr(cond), F.expr(part)) for part, conds in _CODED.values() for label, cond in conds.items()}
    parts = st.bootstrap_proportion(b.raters(s, d), coded, N_BOOT, SEED)
    basis = F.create_map(*[F.lit(x) for name, (_, conds) in _CODED.items() for label in conds for x in (label, name)])
    files = scanned(s, d)
    coverage = st.bootstrap_proportion(ex.scan_coverage(files, ex.extract_tools(files)),
                                       {"packages yielding at least one tool": F.col("tools_found") > 0}, N_BOOT, SEED)
    signals = stored_signals(s, d)
    silent = st.bootstrap_proportion(signals, {"servers with no tagged release": F.col("b") == 0}, N_BOOT, SEED)
    grid = _credential_quantities()
    conditions = {"declared": F.lit(True), "unflagged": ~F.col("is_secret"), "is_latest": F.col("is_latest"),
                  "credential_named": F.col("credential_named"), "looks_like_credential": F.col("looks_like_credential")}
    cube = st.mask_cube(adjudicated(s, d), conditions, "server_name")
    shares = st.cluster_intervals(cube, list(conditions), {q: (num, den) for q, (num, den, _) in grid.items()}, N_BOOT, SEED)
    of = F.create_map(*[F.lit(x) for q, (_, _, name) in grid.items() for x in (q, name)])
    ranks = st.bootstrap_spearman(signals, "a", "b", N_BOOT, SEED).select(
        F.lit("Spearman correlation, registry versions vs releases").alias("quantity"), F.col("value").alias("value_pct"), "ci95_low", "ci95_high", "n")
    return st.interval_table([
        (parts, basis[F.col("quantity")]), (coverage, "sampled packages"), (silent, "sampled repositories"), (shares, of[F.col("quantity")]),
    ], [(ranks, "sampled repositories")])


# --- fact sheets and claims -----------------------------------------------------------------------
_FACTS = """
WITH p AS (SELECT o_orderpriority, count(*) AS orders FROM orders GROUP BY 1), g AS (SELECT l_returnflag, l_linestatus, count(*) AS lines FROM lineitem GROUP BY 1, 2),
 pr AS (SELECT *, row_number() OVER (ORDER BY o_orderpriority) AS row_no FROM p ORDER BY o_orderpriority LIMIT 40), gr AS (SELECT *, row_number() OVER (ORDER BY l_returnflag, l_linestatus) AS row_no FROM g ORDER BY l_returnflag, l_linestatus LIMIT 40),
 facts AS (SELECT 'priorities' AS source, row_no, 'o_orderpriority' AS field, o_orderpriority AS value FROM pr UNION ALL SELECT 'priorities', row_no, 'orders', orders::VARCHAR FROM pr
 UNION ALL SELECT 'flags', row_no, 'l_returnflag', l_returnflag FROM gr UNION ALL SELECT 'flags', row_no, 'l_linestatus', l_linestatus FROM gr UNION ALL SELECT 'flags', row_no, 'lines', lines::VARCHAR FROM gr)"""


def _fact_tables(s, d):
    priorities = b.table(s, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"))
    flags = b.table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("lines"))
    return {"priorities": (priorities, ["o_orderpriority"]), "flags": (flags, ["l_returnflag", "l_linestatus"])}


@Q.add("fact_sheet", "S14", _FACTS + " SELECT * FROM facts")
def fact_sheet(s, d):
    return ev.fact_sheet(_fact_tables(s, d))


@Q.add("check_claims", "J16", """
WITH o AS (SELECT o_orderpriority, count(*)::DOUBLE AS n FROM orders GROUP BY 1)
SELECT 'orders ' || o_orderpriority AS label, 'priorities' AS source, n AS expected, n AS actual, 1::BIGINT AS rows_met, 'ok' AS status FROM o
UNION ALL SELECT 'wrong ' || o_orderpriority, 'priorities', n + 1, n, 1, 'mismatch' FROM o
UNION ALL SELECT 'row ' || o_orderpriority, 'flags', n, NULL, 0, 'row missing' FROM o
UNION ALL SELECT 'absent ' || o_orderpriority, 'nowhere', n, NULL, 0, 'table missing' FROM o
UNION ALL SELECT 'lines', 'flags', n, first, met, CASE WHEN n = first THEN 'ok' ELSE 'mismatch' END FROM (
  SELECT count(*)::DOUBLE AS n, min(count(*)) FILTER (l_linestatus = s) OVER (PARTITION BY l_returnflag)::DOUBLE AS first, count(*) OVER (PARTITION BY l_returnflag) AS met
  FROM lineitem JOIN (SELECT l_returnflag, min(l_linestatus) AS s FROM lineitem GROUP BY 1) USING (l_returnflag) GROUP BY l_returnflag, l_linestatus, s)""")
def check_claims(s, d):
    counts = b.table(s, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).cast("double").alias("n"))
    claims = counts.select(F.inline(F.array(*[
        F.struct(
            F.concat(F.lit(word), F.lit(" "), F.col("o_orderpriority")).alias("label"), F.lit(source).alias("source"),
            F.lit("o_orderpriority").alias("key_field"),
            F.col("o_orderpriority").alias("key_value"), F.lit("orders").alias("field"), (F.col("n") + shift).alias("expected"))
        for word, source, shift in (("orders", "priorities", 0.0), ("wrong", "priorities", 1.0), ("row", "flags", 0.0), ("absent", "nowhere", 0.0))
    ])))
    # One claim per line status: where a return flag has several, only the first row's number holds.
    lines = b.table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).cast("double").alias("expected")).select(
        F.lit("lines").alias("label"), F.lit("flags").alias("source"), F.lit("l_returnflag").alias("key_field"),
        F.col("l_returnflag").alias("key_value"), F.lit("lines").alias("field"), "expected")
    return ev.check_claims(claims.unionByName(lines), ev.claim_cells(_fact_tables(s, d)))
