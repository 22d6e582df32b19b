"""Token estimates from text volume."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimated_tokens
from ..functions.times import round_half_up

INPUT_SHARE = 0.85


def absorb_unnamed(turns: DataFrame, keys: list[str], unknown: str) -> DataFrame:
    """(keys, model, turns, pos) with unnamed turns (model '') given to the model with most turns, earliest on a tie."""
    named = F.when(F.col("model") != "", F.col("model"))
    rank = F.when(F.col("model") != "", F.struct(F.col("turns"), -F.col("pos")))
    leader = F.max_by(named, rank).over(Window.partitionBy(*keys))
    settled = turns.withColumn("model", F.coalesce(named, leader, F.lit(unknown)))
    return settled.groupBy(*keys, "model").agg(F.sum("turns").alias("turns"))


def split_estimate(turns: DataFrame, volumes: DataFrame, keys: list[str]) -> DataFrame:
    """Spread a group's estimated tokens over its models by turns, input and output at a fixed ratio.

    turns(keys, model, turns), volumes(keys, text_chars).
    """
    share = F.col("turns") / F.sum("turns").over(Window.partitionBy(*keys))
    tokens = estimated_tokens(F.col("text_chars"))
    return turns.join(volumes, keys).select(
        *keys,
        "model",
        F.col("turns").cast("bigint").alias("turns"),
        round_half_up(tokens * share * INPUT_SHARE).alias("input_tokens"),
        round_half_up(tokens * share * (1 - INPUT_SHARE)).alias("output_tokens"),
    )
