"""Views that give the star-schema and text tables the shape of catalogue tables.

Each view is a plain projection (plus a key join where two tables meet), so filters and column pruning
reach the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalens.session import spread

AS_OF = "2002-01-01"

DECLARED_NAMES = (
    "ACME_API_KEY", "ACME_TOKEN", "SIGNING_KEY", "FOREIGN_KEYS", "CHARS_PER_TOKEN", "PUBLIC_KEY", "API_KEY_PATH",
    "TOKENIZER", "publicKey", "DB_PASSWORD", "SSH_KEY", "LOG_LEVEL", "PORT", "CLIENT_SECRET", "CLIENT_ID",
    "REDACT_SECRETS", "ALLOW_TOKEN", "GITHUB_PERSONAL_ACCESS_TOKEN", "REFRESH_TOKEN", "ID_TOKEN", "DB_PATH",
    "COMPAT_MODE", "SESSION_DIR", "WEBHOOK_URL", "SENTRY_DSN", "OURA_CREDENTIALS", "DATAIKU_PROJECT_KEY",
    "ONE_CONNECTION_KEYS", "MAX_TOKENS", "BEARER_TOKEN", "ANON_KEY", "ENCRYPTION_KEYS", "USER_NAME", "TIMEOUT",
    "APIKEY", "SERVICE_ACCOUNT_CREDENTIALS", "X__Y", "", "REGION", "AUTH_MODE",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def heavy(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table that expensive per-row expressions run over."""
    return spread(table(spark, sf_dir, name))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as published versions of their customer's component."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    priority, status, balance = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("c_acctbal")
    segment = F.lower("c_mktsegment")
    c = lambda x: F.col(x).cast("string")
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(
        F.concat(F.lit("io."), segment, F.lit(".n"), c("c_nationkey"), F.lit("/c"), c("o_custkey")).alias("name"),
        F.when(priority != "5-LOW", F.substring(priority, 3, 20)).alias("title"),
        F.when(priority == "4-NOT SPECIFIED", "").when(priority == "5-LOW", F.lit(None)).when(
            priority == "3-MEDIUM", " medium "
        ).otherwise(F.concat("c_name", F.lit(" places an order of status "), status)).alias("description"),
        c("o_orderkey").alias("version"),
        F.when(status != "F", F.concat(
            F.lit("https://static.example.org/schemas/"), F.date_format("o_orderdate", "yyyy-MM"), F.lit("-01/server.json")
        )).alias("schema"),
        F.when(balance > 3000, F.concat(
            F.lit("https://github.com/n"), c("c_nationkey"), F.lit("/"), segment, F.lit(".git")
        )).when(balance > 0, F.concat(F.lit("https://example.org/c"), c("o_custkey"))).alias("repository_url"),
        F.when(status == "P", "deprecated").otherwise("active").alias("status"),
        (priority == "1-URGENT").alias("is_latest"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"),
        F.lit(None).cast("string").alias("status_changed_at"),
        (status != "F").alias("has_packages"),
        priority.isin("1-URGENT", "2-HIGH").alias("has_remotes"),
        (balance > 0).alias("has_repository"),
        (balance > 8000).alias("has_website"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderkey").alias("ordinal"),
    )


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as packages of their supplier's component."""
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("server_name"),
        F.when(flag == "R", "npm").when(flag == "A", "pypi").otherwise("oci").alias("registry_type"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("identifier"),
        F.date_format("l_shipdate", "yyyy.MM").alias("package_version"),
        (F.col("l_linestatus") == "O").alias("is_latest"),
        F.col("l_orderkey").alias("ordinal"), F.col("l_linenumber").cast("bigint").alias("line"),
    )


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as declared environment variables."""
    names = F.array(*[F.lit(n) for n in DECLARED_NAMES])
    line = F.col("l_linenumber")
    return heavy(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("server_name"),
        F.get(names, F.pmod("l_partkey", F.lit(len(DECLARED_NAMES))).cast("int")).alias("var_name"),
        F.when(line == 1, "Absolute path to the value").when(line == 2, "Refill rate of the token bucket").when(
            line > 3, F.concat(F.lit("value for "), F.col("l_returnflag"))
        ).alias("var_description"),
        (F.col("l_linestatus") == "F").alias("is_required"),
        (F.col("l_returnflag") == "R").alias("is_secret"),
        F.when(F.col("l_discount") > 0.05, F.col("l_returnflag")).alias("default_value"),
        (F.col("l_linestatus") == "O").alias("is_latest"),
        F.col("l_orderkey").alias("ordinal"), F.col("l_linenumber").cast("bigint").alias("line"),
    )


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.col("url").alias("remote_url"), F.split_part("url", F.lit("/"), F.lit(4)).alias("server_name")
    )


LINK = '<a href="([^"]*)">([^<]*)</a>'
#: Source whose Python files hold a commented-out registration only.
UNREGISTERED = "src3"
STRICT_LINK = '<a href="(/[A-Za-z]+)">'


def links(spark: SparkSession, sf_dir: str, pattern: str = LINK) -> DataFrame:
    """Anchors of every page."""
    return table(spark, sf_dir, "pages").select(
        F.col("page_id"), F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("href")
    )


def raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as the codes of one rater, a length rule as the codes of another."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    return labels.join(docs.select("doc_id", "lang", "source", "n_chars"), "doc_id")


def description_of(text) -> Column:
    """Latin letters of a document's first sixty characters."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.left(text, F.lit(60)), "[^A-Za-z ]", " "), " +", " "))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files: registration code in the file's language, followed by the whole document."""
    docs = heavy(spark, sf_dir, "documents").select(
        "lang", "source", "text", F.col("doc_id").cast("string").alias("i"), description_of(F.col("text")).alias("d")
    )
    lang, source, i, d = (F.col(c) for c in ("lang", "source", "i", "d"))
    js = F.concat(
        F.lit('server.tool("alpha_'), i, F.lit('", "'), d, F.lit('", shape);\n'),
        F.lit('server.registerTool("beta_'), i, F.lit('", { description: "Does \\"beta\\"", inputSchema: shape });\n'),
        F.lit('tools = [{ name: "gamma_'), source, F.lit('", title: "G", description: "'), d, F.lit('" }];\n'),
        F.lit('server.registerTool("nest_'), i, F.lit('", {\n  inputSchema: { type: "object", properties: { a: { description: "an } argument" } } },\n'),
        F.lit('  description: "Nested (body" }, handler);\nlist.push({ name: "lit_'), i,
        F.lit('", annotations: { readOnly: true, hint: { schema: 1 } }, description: "Literal" });\n'),
    )
    old = F.concat(F.lit('# Tool(name="old_'), i, F.lit('", description="gone")\n'))
    py = F.when(source == UNREGISTERED, old).otherwise(F.concat(
        F.lit("@app.tool()\nasync def delta_"), i, F.lit('(a,\n    b):\n    """'), d, F.lit('\n    """\n    return a\n'),
        F.lit('@app.tool(name="eps_'), source, F.lit('", description="'), d, F.lit('")\ndef inner():\n    pass\n'),
        F.lit("@app.tool()\ndef _hidden_"), i, F.lit("():\n    pass\n"),
        F.lit('t = types.Tool(name="zeta_'), i, F.lit('", description="Does zeta", input_schema={})\n'),
        old,
        F.lit('@app.tool(\n    name="multi_'), i, F.lit('",\n    description="Reads (all) files",  # a :) note\n    tags={"a": (1, 2)},\n)\n@other(\n    1)\n'),
        F.lit('def multi():\n    pass\nx, y = Tool(name="one_'), i, F.lit('", description="First :)"), Tool(name="two_'), i, F.lit('")\n'),
    ))
    code = F.when(lang.isin("en", "fr"), js).otherwise(py)
    path = (
        F.when(lang == "en", F.concat(F.lit("src/d"), i, F.lit(".ts")))
        .when(lang == "fr", F.concat(F.lit("lib/d"), i, F.lit(".js")))
        .when(lang == "de", F.concat(F.lit("pkg/d"), i, F.lit(".py")))
        .otherwise(F.concat(F.lit("tests/d"), i, F.lit(".py")))
    )
    kind = F.when(lang.isin("en", "fr"), "npm").otherwise("pypi")
    return docs.select(
        F.concat(kind, F.lit(":"), source).alias("package_key"), source.alias("server_name"),
        kind.alias("registry_type"), path.alias("path"),
        F.octet_length("text").cast("bigint").alias("bytes"), F.concat(code, F.col("text")).alias("text"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their line items nested back into catalogue entries."""
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(
        F.col("l_linenumber").alias("n"),
        F.when(F.col("l_returnflag") == "R", "npm").when(F.col("l_returnflag") == "A", "pypi").alias("registryType"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("identifier"),
        F.when(F.col("l_linestatus") == "O", "stdio").otherwise("sse").alias("transport"),
        (F.col("l_linestatus") == "F").alias("required"), (F.col("l_returnflag") == "R").alias("secret"),
    ).alias("line"))
    # An order has at most seven lines, so the nested list is bounded.
    nested = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    none = F.lit(None).cast("string")
    variables = lambda x: F.array(F.struct(
        F.concat(F.lit("VAR_"), x["n"].cast("string")).alias("name"), none.alias("description"),
        x["required"].alias("isRequired"), x["secret"].alias("isSecret"), none.alias("default"), none.alias("format"),
        F.lit(None).cast("array<string>").alias("choices"),
    ))
    package = lambda x: F.struct(
        x["registryType"].alias("registryType"), none.alias("registryBaseUrl"), x["identifier"].alias("identifier"),
        none.alias("version"), F.struct(x["transport"].alias("type"), none.alias("url")).alias("transport"),
        none.alias("runtimeHint"), F.when(x["required"], F.array(F.lit("-y"))).alias("runtimeArguments"),
        F.lit(None).cast("array<string>").alias("packageArguments"), variables(x).alias("environmentVariables"),
    )
    status = F.col("o_orderstatus")
    remote = F.struct(F.lit("streamable-http").alias("type"), F.concat(
        F.lit("http://10.0.0.1:80/"), F.col("o_custkey").cast("string")).alias("url"))
    server = F.struct(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("name"), none.alias("title"),
        F.col("o_orderpriority").alias("description"), F.col("o_orderkey").cast("string").alias("version"),
        none.alias("$schema"),
        F.struct(F.when(status == "O", F.concat(F.lit("https://github.com/o/r"), F.col("o_custkey").cast("string"))).alias("url"),
                 F.lit("github").alias("source")).alias("repository"),
        F.when(status == "P", "").when(status == "F", "https://example.org").alias("websiteUrl"),
        F.transform("lines", package).alias("packages"),
        F.when(status != "O", F.array(remote)).alias("remotes"),
    )
    meta = F.create_map(F.lit("registry.example/official"), F.struct(
        F.when(status == "P", "deprecated").otherwise("active").alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"), none.alias("updatedAt"),
        none.alias("statusChangedAt"), F.when(F.col("o_orderpriority") == "1-URGENT", True).alias("isLatest"),
    ))
    return orders.join(nested, orders["o_orderkey"] == nested["l_orderkey"], "left").select(
        server.alias("server"), meta.alias("_meta")
    )
