"""Request keys and landed payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from catalens.functions.numeric import col


def _form_encode(c: Column) -> Column:
    """Form encoding of one key or value (`url_encode` writes '*' plainly and '~' as an escape)."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def request_key(url, params) -> Column:
    """First 32 hex digits of the SHA-256 over the address and its parameters in name order."""
    pairs = F.transform(
        F.array_sort(F.map_entries(col(params))),
        lambda e: F.concat(_form_encode(e["key"]), F.lit("="), _form_encode(e["value"])),
    )
    query = F.coalesce(F.array_join(pairs, "&"), F.lit(""))
    return F.left(F.sha2(F.concat(col(url), F.lit("?"), query), 256), F.lit(32))


def cache_split(requests: DataFrame, payloads: DataFrame, key: str = "request_key", payload: str = "payload") -> DataFrame:
    """Requests with their landed payload and outcome: cached, error (an error marker landed) or fresh (to fetch)."""
    landed = payloads.select(key, payload, F.lit(True).alias("_landed")).dropDuplicates([key])
    failed = F.get_json_object(payload, "$.__http_error__").isNotNull()
    return requests.join(landed, key, "left").withColumn(
        "outcome", F.when(F.col("_landed").isNull(), "fresh").when(failed, "error").otherwise("cached")
    ).drop("_landed")


def cache_stats(split: DataFrame) -> DataFrame:
    return split.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("fresh", "cached", "error")])
