"""Evidence for coders, fact sheets and claim checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from catalens.functions.text import text_or_empty
from catalens.operators.keys import siblings
from catalens.operators.security import secret_verdict


def evidence_table(
    items: DataFrame, latest: DataFrame, env: DataFrame, tools: DataFrame, fields: list[str], shown_siblings: int = 25,
    description_cap: int | None = None,
) -> DataFrame:
    """Everything a coder needs per sampled item in long form: (item_id, section, entry, detail).

    Sections: manifest fields, declared variables, the rule verdict, the item's own description (with a
    mark when it reached the cap that its extraction had, if any) and its siblings. Long form keeps any number of declared
    variables without building one large cell. `items` has item_id, server_name and tool_name (null for
    server items) and drives every join, so the big tables are reduced to the sampled keys first.
    """
    asked = items.select("item_id", F.col("server_name").alias("_server"), F.col("tool_name").alias("_tool"))
    server_items = asked.where(F.col("_tool").isNull())
    tool_items = asked.where(F.col("_tool").isNotNull())

    sampled = server_items.select("_server").distinct()
    known = latest.join(sampled, latest["name"] == sampled["_server"], "left_semi")
    manifest = known.select(
        F.col("name").alias("_server"),
        F.inline(F.array(*[
            F.struct(F.lit(f).alias("entry"), text_or_empty(F.col(f).cast("string")).alias("detail")) for f in fields
        ])),
    ).withColumn("section", F.lit("manifest"))
    declared = env.join(sampled, env["server_name"] == sampled["_server"], "left_semi")
    variables = declared.select(
        F.col("server_name").alias("_server"), F.lit("variable").alias("section"), F.col("var_name").alias("entry"),
        F.concat(
            F.when(F.col("is_required"), "required").otherwise("optional"), F.lit(", "),
            F.when(F.col("is_secret"), "secret").otherwise("not secret"),
        ).alias("detail"),
    )
    verdicts = secret_verdict(sampled, declared, "_server", "server_name").select(
        "_server", F.lit("rule verdict").alias("section"), F.col("verdict").alias("entry"), F.col("reason").alias("detail")
    )
    about_servers = manifest.unionByName(variables).unionByName(verdicts)
    wanted = tool_items.select("_server").distinct()
    own_tools = tools.join(wanted, tools["server_name"] == wanted["_server"], "left_semi")
    described = own_tools.select(
        F.col("server_name").alias("_server"), F.col("tool_name").alias("_tool"), F.lit("description").alias("section"),
        (F.lit("complete") if description_cap is None else F.when(
            F.length(text_or_empty("tool_description")) >= description_cap, "reached the cap").otherwise("complete")).alias("entry"),
        text_or_empty("tool_description").alias("detail"),
    )
    near = siblings(own_tools, "server_name", "tool_name", shown_siblings).select(
        F.col("server_name").alias("_server"), F.col("tool_name").alias("_tool"), F.lit("siblings").alias("section"),
        F.col("sibling_count").cast("string").alias("entry"), F.array_join("siblings", ", ").alias("detail"),
    )
    out = ["item_id", "section", "entry", "detail"]
    return (
        server_items.drop("_tool").join(about_servers, "_server").select(*out)
        .unionByName(tool_items.join(described.unionByName(near), ["_server", "_tool"]).select(*out))
    )


def fact_sheet(tables: dict[str, tuple[DataFrame, list]], n: int = 40) -> DataFrame:
    """The first n rows of every result table in long form: (source, row_no, field, value).

    `tables` maps a name to (frame, sort columns); each is a top-n, so ranking touches at most n rows.
    """
    parts = []
    for source, (df, order) in tables.items():
        head = df.orderBy(*order).limit(n).withColumn("row_no", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
        parts.append(head.select(
            F.lit(source).alias("source"), "row_no",
            F.inline(F.array(*[
                F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in df.columns
            ])),
        ))
    return reduce(DataFrame.unionByName, parts)


def claim_cells(tables: dict[str, tuple[DataFrame, list]]) -> DataFrame:
    """Every cell of whole result tables under each of its row's keys: (source, key_field, key_value, field, value, place).

    `tables` maps a name to (frame, key columns); a cell is found by the value of a named key column only. Rows are ordered
    by their key columns as text, which is the place of a cell.
    """
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(source).alias("source"), F.inline(F.array(*[
            F.struct(
                F.lit(k).alias("key_field"), F.col(k).cast("string").alias("key_value"),
                F.lit(c).alias("field"), F.col(c).cast("string").alias("value"),
                F.array(*[F.col(x).cast("string") for x in keys]).alias("place"))
            for k in keys for c in df.columns
        ])))
        for source, (df, keys) in tables.items()
    ])


def check_claims(claims: DataFrame, cells: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Status of each claim (label, source, key_field, key_value, field, expected) against the cells of whole tables.

    Where several rows hold the key, the first one counts, and rows_met says how many there are. Claims are told apart by all
    they say, so two of one label stay two; repeated claims stay repeated. Claims are the small side and only matched by equality.
    """
    sources = cells.select("source").distinct().withColumn("_table", F.lit(True))
    values = cells.select("source", "key_field", "key_value", "field", F.col("value").try_cast("double").alias("actual"), "place")
    about = ["source", "key_field", "key_value", "field"]
    hits = claims.select(*about).distinct().join(values, about).groupBy(*about).agg(
        F.min_by("actual", "place").alias("actual"), F.count(F.lit(1)).alias("rows_met"))
    status = (
        F.when(F.col("_table").isNull(), "table missing")
        .when(F.col("actual").isNull(), "row missing")
        .when(F.abs(F.col("actual") - F.col("expected")) > tolerance, "mismatch")
        .otherwise("ok")
    )
    return claims.join(sources, "source", "left").join(hits, about, "left").select(
        "label", "source", "expected", "actual", F.coalesce("rows_met", F.lit(0)).cast("long").alias("rows_met"), status.alias("status")
    )
