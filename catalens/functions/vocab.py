"""Normalisers for hand-coded values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from catalens import fixed_values as fx
from catalens.functions.numeric import col
from catalens.functions.text import text_or_empty


def _tidy(c) -> Column:
    return F.trim(text_or_empty(c))


def normalize_bool(c) -> Column:
    word = F.lower(_tidy(c))
    return F.when(word.isin(*fx.TRUE_WORDS), True).when(word.isin(*fx.FALSE_WORDS), False)


def to_int(c) -> Column:
    """Whole number from dirty text: '3.0' gives 3, anything unreadable gives null."""
    return _tidy(c).try_cast("double").try_cast("bigint")


def classify_miss(raw, notes, is_server) -> Column:
    """Reason why an extractor missed or over-reported, from the coder's free text."""
    raw, notes = _tidy(raw), text_or_empty(notes)
    out = (
        F.when(~F.coalesce(col(is_server), F.lit(False)), "not_a_server_or_no_tools")
        .when(raw.rlike(fx.MISS_ARTEFACT_PATTERN) | F.contains(notes, F.lit(fx.MISS_NOTE_MARK)), "false_positive")
        .when(raw.rlike(fx.MISS_PATTERN) & raw.rlike(fx.MISS_DYNAMIC_PATTERN), "dynamic_registration")
        .when(raw.rlike(fx.MISS_PATTERN), "extractor_miss")
    )
    for word, reason in fx.MISS_REASONS.items():
        out = out.when(raw == word, reason)
    return out.otherwise(raw)


def classify_evidence(c) -> Column:
    text = _tidy(c)
    return (
        F.when(text == "", "none")
        .when(text.startswith(fx.EVIDENCE_ENV_PREFIX), "manifest_env_vars")
        .when(text.startswith(fx.EVIDENCE_DESCRIPTION_PREFIX), "manifest_description")
        .when(F.contains(text, F.lit(fx.EVIDENCE_NONE_MARK)), "no_statement")
        .when(text.startswith(fx.EVIDENCE_LOCAL_PREFIX), "local_configuration")
        .otherwise("other")
    )


def auth_family(c) -> Column:
    word = _tidy(c)
    return (
        F.when(word.isin(*fx.CREDENTIAL_AUTH), "credential")
        .when(word.isin(*fx.PAYMENT_AUTH), "payment")
        .when(word == "", "unknown")
        .otherwise(word)
    )


def collapse_undetermined(c) -> Column:
    """All wordings of 'the evidence does not settle this' become one label."""
    word = F.lower(_tidy(c))
    return F.when(word.isin(*fx.UNDETERMINED_WORDS), "undetermined").otherwise(word)


def harmonise(c) -> Column:
    """Only the purely lexical difference between two code books is removed."""
    word = _tidy(c)
    return F.when(F.lower(word) == "unclear", "undetermined").otherwise(word)


def presence(c) -> Column:
    return F.when(_tidy(c) != "", "yes").otherwise("no")


def transport_class(has_package, has_remote) -> Column:
    package, remote = F.coalesce(col(has_package), F.lit(False)), F.coalesce(col(has_remote), F.lit(False))
    return (
        F.when(package & remote, "package+remote")
        .when(package, "package-only")
        .when(remote, "remote-only")
        .otherwise("neither")
    )


def kappa_band(c) -> Column:
    """Landis-Koch band of a kappa value."""
    kappa = col(c)
    out = F.when(kappa.isNull(), fx.BAND_NONE)
    for limit, label in fx.BAND_LIMITS:
        out = out.when(kappa < F.lit(limit), label)
    return out.otherwise(fx.BAND_TOP)
