"""Credential reports: rule results, adjudication, hygiene summary, audit and precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from catalens import fixed_values as fx
from catalens.functions.credentials import (
    credential_words, loose_name_hint, reason_of, tails, tier_of, verdict_hint, word_before,
)
from catalens.functions.numeric import pct
from catalens.functions.text import any_of
from catalens.operators.metric import keyed_counts, long_form, rows_of
from catalens.session import materialise


def adjudication_list(spark, entries=fx.ADJUDICATED) -> DataFrame:
    """The adjudication list as a table (name, verdict)."""
    return spark.createDataFrame([tuple(e) for e in entries], "var_name string, audit_reason string")


def classify_declarations(env: DataFrame, name: str = "var_name", description: str = "var_description") -> DataFrame:
    """Add both rules' results to declared variables.

    The steps are separate projections: each intermediate value is used several times and is not inlined
    into its uses, which keeps it computed once and the generated code short.
    """
    last, two, three = tails("_words")
    staged = (
        env.withColumn("_words", credential_words(name))
        .select("*", last.alias("_last"), two.alias("_two"), three.alias("_three"))
        .select(
            "*", tier_of(F.col("_last"), F.col("_two")).alias("_tier"),
            word_before(F.col("_last"), F.col("_two"), F.col("_three")).alias("_before"),
        )
        .withColumn("credential_reason", reason_of(F.col("_words"), F.col("_tier"), F.col("_before"), description))
        .withColumn("name_hint", loose_name_hint(name))
    )
    return staged.select(
        *env.columns,
        F.when(F.col("credential_reason") == "credential", F.col("_tier")).alias("credential_tier"),
        "credential_reason",
        (F.col("name_hint") | any_of(description, fx.LOOSE_HINTS)).alias("looks_like_credential"),
        "name_hint",
    )


def apply_adjudication(classified: DataFrame, audit: DataFrame | None = None, name: str = "var_name") -> DataFrame:
    """Correct the whole-word rule by an adjudication list and derive the flags the reports use.

    The fixed list is a map literal, so declarations are neither joined nor shuffled by their few hot names. A caller's
    table is stored first: the planner then broadcasts it by its true size, or joins by a shuffle that it may split.
    """
    if audit is None:
        reasons = F.create_map(*[F.lit(x) for entry in fx.ADJUDICATED for x in entry])
        joined = classified.withColumn("audit_reason", F.try_element_at(reasons, F.col(name)))
    else:
        verdicts = audit.select(F.col("var_name").alias("_name"), "audit_reason").dropDuplicates(["_name"])
        verdicts = materialise(verdicts, "adjudication")
        joined = classified.join(verdicts, classified[name] == verdicts["_name"], "left").drop("_name")
    fires = F.col("credential_tier").isNotNull()
    listed = F.col("audit_reason").isNotNull()
    return joined.select(
        *classified.columns,
        F.coalesce("audit_reason", F.lit("")).alias("audit_reason"),
        (fires & listed).alias("audit_demoted"),
        (fires & ~listed).alias("credential_named"),
        (fires & ~listed & ~F.col("is_secret")).alias("credential_named_unflagged"),
        (F.col("looks_like_credential") & ~F.col("is_secret")).alias("permissive_unflagged"),
    )


def _tier(name: str) -> Column:
    return F.coalesce(F.col("credential_tier") == name, F.lit(False))


def credential_summary(classified: DataFrame, server: str = "server_name", basis: str = "all published versions"):
    """Eighteen hygiene metrics. One row per server is built first, so the server counts need no
    count-distinct; shares are of all declarations and empty for server counts."""
    named, unflagged = F.col("credential_named"), F.col("credential_named_unflagged")
    flags = {
        "required": F.col("is_required"), "secret": F.col("is_secret"),
        "explicit": _tier("explicit") & named, "ambiguous": _tier("ambiguous") & named, "named": named,
        "unflagged": unflagged, "u_explicit": _tier("explicit") & unflagged,
        "u_ambiguous": _tier("ambiguous") & unflagged, "u_required": unflagged & F.col("is_required"),
        "loose": F.col("looks_like_credential"), "loose_unflagged": F.col("permissive_unflagged"),
        "demoted": F.col("audit_demoted"), "demoted_unflagged": F.col("audit_demoted") & ~F.col("is_secret"),
        "defaulted": F.col("default_value").isNotNull(),
    }
    per_server = keyed_counts(classified, server, flags)
    known = F.col(server).isNotNull()
    wide = per_server.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in ("rows", *flags)],
        F.count_if(known).alias("servers"),
        F.count_if(known & (F.col("named") > 0)).alias("servers_named"),
        F.count_if(known & (F.col("unflagged") > 0)).alias("servers_unflagged"),
    )
    rows = [
        ("declared environment variables", "rows"),
        ("required variables", "required"),
        ("variables marked secret", "secret"),
        ("credential-named, explicit tier", "explicit"),
        ("credential-named, ambiguous tier", "ambiguous"),
        ("credential-named, both tiers", "named"),
        ("credential-named and NOT marked secret", "unflagged"),
        ("... of those, explicit tier", "u_explicit"),
        ("... of those, ambiguous tier", "u_ambiguous"),
        ("credential-named, NOT marked secret, and required", "u_required"),
        ("permissive rule: variables that look like credentials", "loose"),
        ("permissive rule: look like credentials, NOT marked secret", "loose_unflagged"),
        ("declarations demoted by adjudication", "demoted"),
        ("... of those, with no secret flag", "demoted_unflagged"),
        ("variables with a default value", "defaulted"),
        ("servers declaring at least one env var", "servers"),
        ("servers declaring at least one credential-named variable", "servers_named"),
        ("servers declaring a credential-named variable with no secret flag", "servers_unflagged"),
    ]
    nothing = F.lit(None).cast("double")
    cells = [
        (label, (F.col(c), nothing if label.startswith("servers") else pct(c, "rows", 2), F.lit(basis)))
        for label, c in rows
    ]
    return long_form(wide, cells, "metric", ("value", "share_pct", "basis"))


def top_vars(env: DataFrame, n: int = 30, name: str = "var_name", server: str = "server_name") -> DataFrame:
    """Most common variables by number of servers."""
    return (
        env.where(F.col(name).isNotNull())
        .groupBy(name)
        .agg(
            F.count(F.lit(1)).alias("declarations"), F.count_distinct(server).alias("servers"),
            F.count_if("is_secret").alias("secret_flagged"),
        )
        .orderBy(F.desc("servers"), name).limit(n)
        .withColumn("secret_flagged_pct", pct("secret_flagged", "declarations"))
    )


def rule_audit(
    classified: DataFrame, ordinal: list[str], name: str = "var_name", server: str = "server_name",
    description: str = "var_description",
) -> DataFrame:
    """Every distinct flagged name and tier with its counts, first description and verdict."""
    # Cells per (name, tier, server) first. Rows the rule does not flag are dropped after that: a filter in
    # front would be pushed below the rule and make it run twice.
    known = F.col(description).isNotNull()
    at = F.struct(*ordinal)
    keys = [name, "credential_tier"]
    cells = classified.groupBy(*keys, server).agg(
        F.count(F.lit(1)).alias("c"), F.count_if("is_secret").alias("secret"),
        F.count_if(F.col("credential_tier").isNotNull() & F.col(name).isNotNull()).alias("fires"),
        F.max("audit_reason").alias("audit_reason"),
        F.min_by(F.when(known, F.col(description)), F.when(known, at)).alias("text"), F.min(F.when(known, at)).alias("at"),
    ).where(F.col("fires") > 0)
    return cells.groupBy(*keys).agg(
        F.sum("c").alias("declarations"), F.count(server).alias("servers"), F.sum("secret").alias("secret_flagged"),
        (F.sum("c") - F.sum("secret")).alias("unflagged"), F.max("audit_reason").alias("audit_reason"),
        F.min_by("text", "at").alias("example_description"),
    ).withColumn(
        "verdict", F.when(F.col("audit_reason") == "", "credential").otherwise(F.col("audit_reason"))
    ).orderBy("credential_tier", F.desc("unflagged"), F.desc("declarations"), name)


def rule_precision(audit: DataFrame) -> DataFrame:
    """Precision of the whole-word rule per tier, before and after adjudication."""
    block = audit.where(F.col("unflagged") > 0)
    demoted = F.sum(F.when(F.col("verdict") != "credential", F.col("unflagged")).otherwise(0))
    return block.groupBy(F.col("credential_tier").alias("tier")).agg(
        F.count(F.lit(1)).alias("distinct_names_flagged"),
        F.sum("unflagged").alias("unflagged_before_audit"),
        demoted.alias("adjudicated_non_credential"),
        (F.sum("unflagged") - demoted).alias("unflagged_after_audit"),
        pct(F.sum("unflagged") - demoted, F.sum("unflagged")).alias("precision_pct"),
    )


def rule_decomposition(classified: DataFrame, server: str = "server_name", name: str = "var_name") -> DataFrame:
    """Why the loose rule flags more: three exclusive mechanisms over its unflagged declarations."""
    flagged = classified.where("permissive_unflagged")
    mechanism = (
        F.when(F.col("credential_named"), "corroborated by the whole-word rule")
        .when(F.col("name_hint"), "incidental name match")
        .otherwise("description only")
    )
    # One cell per (mechanism, server, name) first: both distinct counts work on the reduced table.
    cells = flagged.groupBy(mechanism.alias("mechanism"), server, name).agg(F.count(F.lit(1)).alias("c"))
    return (
        cells.groupBy("mechanism")
        .agg(
            F.sum("c").alias("declarations"), F.count_distinct(server).alias("servers"),
            F.count_distinct(name).alias("distinct_names"),
        )
        .withColumn("share_pct", pct("declarations", F.sum("declarations").over(Window.partitionBy())))
        .withColumn("basis", F.lit("all published versions, no secret flag"))
    )


def tier_flag_counts(classified: DataFrame) -> DataFrame:
    """Tier by secret flag: the four groups of the credential chart."""
    secret, named = F.col("is_secret"), F.col("credential_named")
    wide = classified.agg(
        F.count_if(_tier("explicit") & named & secret).alias("a"),
        F.count_if(_tier("explicit") & named & ~secret).alias("b"),
        F.count_if(_tier("ambiguous") & named & ~secret).alias("c"),
        F.count_if(F.col("looks_like_credential") & ~secret).alias("d"),
    )
    labels = ("explicit tier, flagged secret", "explicit tier, no flag", "ambiguous tier, no flag",
              "permissive rule, no flag")
    return long_form(wide, [(label, (F.col(c),)) for label, c in zip(labels, "abcd")], "group", ("variables",))


VERDICT_REASONS = {
    "none": "no environment variables declared",
    "unlike": "declares variables, none credential-like",
    "yes": "at least one credential-like variable flagged secret",
    "no": "credential-like variable declared but not flagged secret",
}


def secret_verdict(
    servers: DataFrame, env: DataFrame, server_key: str, env_key: str, name: str = "var_name"
) -> DataFrame:
    """Per server: n/a, yes or no, whether its credential-like variables are flagged secret."""
    hint = verdict_hint(name)
    grouped = env.groupBy(F.col(env_key).alias("_k")).agg(
        F.count(F.lit(1)).alias("declared"), F.count_if(hint).alias("credential_like"),
        F.count_if(hint & F.col("is_secret")).alias("flagged"),
    )
    zero = F.lit(0)
    declared, like, flagged = (F.coalesce(c, zero) for c in ("declared", "credential_like", "flagged"))
    return servers.join(grouped, servers[server_key] == grouped["_k"], "left").select(
        servers[server_key],
        declared.cast("bigint").alias("declared"), like.cast("bigint").alias("credential_like"),
        F.when(like == 0, "n/a").when(flagged > 0, "yes").otherwise("no").alias("verdict"),
        F.when(declared == 0, VERDICT_REASONS["none"]).when(like == 0, VERDICT_REASONS["unlike"])
        .when(flagged > 0, VERDICT_REASONS["yes"]).otherwise(VERDICT_REASONS["no"]).alias("reason"),
    )
