"""Reports over hand-coded sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from catalens import fixed_values as fx
from catalens.functions.numeric import pct
from catalens.functions.text import list_count, text_or_empty
from catalens.functions.vocab import auth_family, classify_evidence, classify_miss, normalize_bool, to_int
from catalens.operators.metric import long_form


def _trimmed(c: str) -> Column:
    return F.trim(text_or_empty(c))


def validate_enum(
    df: DataFrame, item: str, fields: dict[str, str | None], part: str | None = None,
    allowed: dict[str, tuple[str, ...]] = fx.ALLOWED_CODES,
) -> DataFrame:
    """One row per coded value that is blank or not permitted. Fields without a value set are free text.

    The value sets are constants, so the check is an expression per field and the sheet is read once.
    """
    entries = []
    for name, own in fields.items():
        if name not in allowed:
            continue
        value = _trimmed(name)
        problem = F.when(value == "", "blank").when(~value.isin(*allowed[name]), "not permitted")
        if own is not None and part is not None:
            problem = F.when(F.col(part) == own, problem)
        entries.append(F.struct(F.lit(name).alias("field"), value.alias("value"), problem.alias("problem")))
    return df.select(item, F.inline(F.array(*entries))).where(F.col("problem").isNotNull())


def score_counts(merged: DataFrame, is_server: str, actual: str, extracted: str, reason: str, notes: str) -> DataFrame:
    """Typed part-A row: counts, matched, under- and over-extracted items, reason taxonomy."""
    server = normalize_bool(F.col(is_server).cast("string"))
    yes = F.coalesce(server, F.lit(False))
    zero = F.lit(0).cast("bigint")
    found = F.coalesce(to_int(F.col(extracted).cast("string")), zero)
    real = F.when(yes, F.coalesce(to_int(F.col(actual).cast("string")), zero)).otherwise(zero)
    own = {"is_server", "n_actual", "n_extracted", "matched", "under_extracted", "over_extracted", "miss_reason_taxonomy"}
    return merged.select(
        *[c for c in merged.columns if c not in own],
        server.alias("is_server"), real.alias("n_actual"), found.alias("n_extracted"),
        F.when(yes, F.least(real, found)).otherwise(zero).alias("matched"),
        F.greatest(zero, real - found).alias("under_extracted"),
        F.greatest(zero, found - real).alias("over_extracted"),
        classify_miss(reason, notes, yes).alias("miss_reason_taxonomy"),
    )


def count_recall_precision(scored: DataFrame) -> DataFrame:
    """Extraction scores from counts: detection rate, recall and precision over the servers."""
    yes = F.coalesce(F.col("is_server"), F.lit(False))

    def total(c: str) -> Column:
        return F.coalesce(F.sum(F.when(yes, F.col(c))), F.lit(0)).cast("double")

    wide = scored.agg(
        F.count(F.lit(1)).cast("double").alias("coded"), F.count_if(yes).cast("double").alias("servers"),
        F.count_if(~yes).cast("double").alias("others"),
        F.count_if(yes & (F.col("n_extracted") > 0)).cast("double").alias("detected"),
        total("n_actual").alias("actual"), total("n_extracted").alias("extracted"), total("matched").alias("matched"),
        total("under_extracted").alias("missed"), total("over_extracted").alias("extra"),
        F.count_if(yes & (F.col("under_extracted") > 0)).cast("double").alias("with_miss"),
    )
    rows = [
        ("coded packages", F.col("coded")), ("classified as a server", F.col("servers")),
        ("classified as not a server", F.col("others")),
        ("servers where the extractor found >= 1 tool", F.col("detected")),
        ("package-level detection rate (%)", pct("detected", "servers")),
        ("tools actually exposed (coder count)", F.col("actual")),
        ("tools extracted by the pipeline", F.col("extracted")), ("tools matched (estimated)", F.col("matched")),
        ("tools missed by the extractor", F.col("missed")),
        ("tools extracted that are not real tools", F.col("extra")),
        ("estimated tool-level recall (%)", pct("matched", "actual")),
        ("estimated tool-level precision (%)", pct("matched", "extracted")),
        ("servers with at least one miss", F.col("with_miss")),
    ]
    return long_form(wide, [(label, (v,)) for label, v in rows], "metric", ("value",))


def coded_security(codes: DataFrame) -> DataFrame:
    """Add the auth family and the evidence source to coded security rows."""
    return codes.withColumn("auth_family", auth_family("auth_mechanism")).withColumn(
        "auth_evidence_source", classify_evidence("auth_evidence")
    )


def coded_security_summary(codes: DataFrame) -> DataFrame:
    """Fourteen metrics of the coded security sheet."""
    mechanism = _trimmed("auth_mechanism")
    secret, flag = _trimmed("requires_user_secret") == "yes", _trimmed("secret_documented_as_secret")
    write, broad = _trimmed("write_capability") == "yes", _trimmed("scope_breadth") == "broad"
    conditions = {
        "known": ~mechanism.isin("", "unclear"), "unclear": mechanism == "unclear", "open": mechanism == "none",
        "credential": auth_family("auth_mechanism") == "credential",
        "payment": auth_family("auth_mechanism") == "payment",
        "secret": secret, "secret_no": secret & (flag == "no"), "secret_unclear": secret & (flag == "unclear"),
        "write": write, "destructive": _trimmed("destructive_capability") == "yes", "broad": broad,
        "broad_write": broad & write,
    }
    wide = codes.agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.count_if(c).cast("double").alias(k) for k, c in conditions.items()],
    )
    rows = [
        ("servers coded", F.col("n")), ("authentication mechanism identified", F.col("known")),
        ("authentication mechanism identified (%)", pct("known", "n")),
        ("authentication mechanism unclear (%)", pct("unclear", "n")),
        ("no authentication required", F.col("open")), ("credential-based authentication", F.col("credential")),
        ("payment-based gate", F.col("payment")), ("requires the user to supply a secret", F.col("secret")),
        ("... of those: secret NOT flagged as secret", F.col("secret_no")),
        ("... of those: secret flag left unclear", F.col("secret_unclear")),
        ("servers with write capability", F.col("write")),
        ("servers with destructive capability", F.col("destructive")),
        ("servers with broad scope", F.col("broad")), ("broad scope AND write capability", F.col("broad_write")),
    ]
    return long_form(wide, [(label, (v,)) for label, v in rows], "metric", ("value",))


def crosstabs(df: DataFrame, fields: list[str], names=("field", "value", "rows", "share_pct")) -> DataFrame:
    """Counts and shares of several categorical fields in one long table, one pass over the data."""
    field, value, rows, share = names
    entries = [F.struct(F.lit(f).alias(field), F.trim(text_or_empty(F.col(f).cast("string"))).alias(value)) for f in fields]
    return (
        df.select(F.inline(F.array(*entries))).groupBy(field, value).agg(F.count(F.lit(1)).alias(rows))
        .withColumn(share, pct(rows, F.sum(rows).over(Window.partitionBy(field))))  # every row has each field once
    )


def rates_by(df: DataFrame, stratum: str, rates: dict[str, Column], count: str = "rows") -> DataFrame:
    """Size, share of all rows and several rates per stratum."""
    return (
        df.groupBy(stratum)
        .agg(
            F.count(F.lit(1)).alias(count),
            *[pct(F.count_if(c), F.count(F.lit(1))).alias(name) for name, c in rates.items()],
        )
        .withColumn("share_pct", pct(count, F.sum(count).over(Window.partitionBy())))
    )


def coded_description_summary(codes: DataFrame, ambiguous_with: str = "ambiguous_with") -> DataFrame:
    """Thirteen metrics of the coded description sheet."""
    purpose, when = _trimmed("desc_states_purpose"), _trimmed("desc_states_when_to_use") == "yes"
    confusable = list_count(ambiguous_with)
    conditions = {
        "yes": purpose == "yes", "partial": purpose == "partial", "no": purpose == "no", "when": when,
        "inputs": _trimmed("desc_states_inputs") == "yes", "effects": _trimmed("desc_names_side_effects") == "yes",
        "ambiguous": confusable > 0, "both": (purpose == "yes") & when,
    }
    wide = codes.agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.coalesce(F.sum(confusable), F.lit(0)).cast("double").alias("confusable"),
        *[F.count_if(c).cast("double").alias(k) for k, c in conditions.items()],
    )
    mean = F.bround(F.col("confusable") / F.greatest(F.lit(1.0), F.col("n")), 2)
    rows = [
        ("tools coded", F.col("n")), ("description states the purpose (yes)", F.col("yes")),
        ("description states the purpose (partial)", F.col("partial")),
        ("description does NOT state the purpose", F.col("no")),
        ("description states WHEN to use the tool", F.col("when")),
        ("... as a share of coded tools (%)", pct("when", "n")),
        ("description explains the inputs", F.col("inputs")), ("... as a share (inputs, %)", pct("inputs", "n")),
        ("description names side effects", F.col("effects")),
        ("tools the coder found ambiguous with a sibling", F.col("ambiguous")),
        ("... as a share (ambiguous, %)", pct("ambiguous", "n")),
        ("mean ambiguous siblings per tool", mean), ("tools that state purpose AND when to use", F.col("both")),
    ]
    return long_form(wide, [(label, (v,)) for label, v in rows], "metric", ("value",))


def ambiguous_items(codes: DataFrame, keep: list[str], ambiguous_with: str = "ambiguous_with") -> DataFrame:
    """Items a coder could confuse with a sibling."""
    return codes.withColumn("ambiguous_count", list_count(ambiguous_with).cast("bigint")).where(
        F.col("ambiguous_count") > 0
    ).select(*keep, "ambiguous_count", ambiguous_with)
