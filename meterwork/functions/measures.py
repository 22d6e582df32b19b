"""The measure bundle every usage row carries (A1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENS = ["input_tokens", "cache_read_tokens", "cache_write_tokens", "output_tokens"]
MEASURES = [
    "input_tokens",
    "cache_read_tokens",
    "cache_write_tokens",
    "cache_write_1h_tokens",
    "output_tokens",
    "long_input_tokens",
    "long_cache_read_tokens",
    "long_output_tokens",
    "turns",
]


def sums(prefix: str = "") -> list[Column]:
    """A1: add up every measure."""
    return [F.sum(prefix + m).alias(m) for m in MEASURES]


def total_tokens() -> Column:
    """Tokens of all four kinds; the 1-hour and long-context columns are subsets."""
    return F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens") + F.col("output_tokens")


def zero(name: str) -> Column:
    return F.lit(0).cast("bigint").alias(name)
