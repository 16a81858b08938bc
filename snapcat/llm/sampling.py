"""Bounded, repeatable samples of rows for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, key: list[str], columns: list[str | Column], limit: int, seed: int = 42) -> list:
    """At most `limit` rows, those whose key columns have the smallest hashes; the same rows on every run.

    The key should hold all that tells rows apart (id and text): rows that tie in it count as alike, and any of them are
    taken. The hash threshold is found first, so that no task ever holds more than the texts it returns.
    """
    h = F.xxhash64(F.lit(seed), *key)
    top = df.select(h.alias("_sample_hash")).orderBy("_sample_hash").limit(limit).agg(F.max("_sample_hash")).first()[0]
    if top is None:
        return []
    return df.filter(h <= F.lit(top)).select(*columns).limit(limit).collect()
