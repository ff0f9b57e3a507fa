"""Rules that decide whether a declared variable names a credential.

A declaration table is large and these rules touch every row, so the expressions are kept short: long
generated methods would not be compiled by the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from catalens import fixed_values as fx
from catalens.functions.text import any_of, text_or_empty


def loose_name_hint(name) -> Column:
    return any_of(name, fx.LOOSE_HINTS)


def permissive_hint(name, description) -> Column:
    """Loose substring rule over name and description."""
    return loose_name_hint(name) | any_of(description, fx.LOOSE_HINTS)


def verdict_hint(name) -> Column:
    return any_of(name, fx.VERDICT_HINTS)


def credential_words(name) -> Column:
    """The name as blank-separated lower-case words."""
    return F.trim(F.regexp_replace(F.lower(text_or_empty(name)), "[^a-z0-9]+", " "))


def tails(words) -> list[Column]:
    """The last word, the last two and the last three words."""
    return [F.substring_index(words, " ", -n) for n in (1, 2, 3)]


def tier_of(last: Column, two: Column) -> Column:
    """Tier by the last two words (a compound) or the last word (a head noun); null when neither names a secret."""
    return (
        F.when(two.isin(*fx.COMPOUNDS) | last.isin(*fx.EXPLICIT_HEADS), "explicit")
        .when(last.isin(*fx.AMBIGUOUS_HEADS), "ambiguous")
    )


def word_before(last: Column, two: Column, three: Column) -> Column:
    """The word in front of the compound or head noun, empty when the name starts with it."""
    before = (
        F.when(two.isin(*fx.COMPOUNDS), F.when(three != two, F.substring_index(three, " ", 1)))
        .when(two != last, F.substring_index(two, " ", 1))
    )
    return F.coalesce(before, F.lit(""))


def reason_of(words: Column, tier: Column, before: Column, description) -> Column:
    """Why the whole-word rule fires ('credential') or does not."""
    return (
        F.when(words == "", "empty")
        .when(tier.isNull(), "no-credential-term")
        .when(before.isin(*fx.NON_SECRET_QUALIFIERS), "qualified")
        .when(before.isin(*fx.PUBLIC_QUALIFIERS), "public-by-name")
        .when(any_of(description, fx.LOCATION_PHRASES), "declared-as-location")
        .otherwise("credential")
    )


def classify_credential(name, description) -> Column:
    """Whole-word rule as one expression: struct(tier, reason); tier is null when the rule does not fire.

    For whole tables `operators.security.classify_declarations` computes the same step by step, each
    intermediate value once per row.
    """
    words = credential_words(name)
    last, two, three = tails(words)
    tier = tier_of(last, two)
    reason = reason_of(words, tier, word_before(last, two, three), description)
    return F.struct(F.when(reason == "credential", tier).alias("tier"), reason.alias("reason"))
