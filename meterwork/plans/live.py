"""The live view as batch expressions (W11, A24, C4, P36); the streaming jobs reuse them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import round_half_up
from ..operators.blocks import burn_level, burn_rate, context_level
from ..operators.prices import with_cost
from .reports import usage_by

CONTEXT_WINDOW = 200_000


def cost_of_day(usage: DataFrame, day: str, scope: list[str], live: DataFrame | None = None) -> DataFrame:
    """Cost of one day, priced per session and model like the day's bundles."""
    today = usage.filter(F.col("day") == day)
    priced = with_cost(usage_by(today, [*scope, "session_id", "model"]), live)
    return priced.groupBy(*scope).agg(F.sum("cost_usd").alias("today_usd"))


def cost_of_sessions(usage: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Cost of each session from its tokens."""
    priced = with_cost(usage_by(usage, ["session_id", "model"]), live)
    return priced.groupBy("session_id").agg(F.sum("cost_usd").alias("cost_usd"))


def context_use(recorded: DataFrame, scanned: DataFrame) -> DataFrame:
    """Context tokens and percent of the window; a recorded figure wins over the log's newest line.

    recorded(session_id, total_input_tokens, window_size), scanned(session_id, context_tokens).
    """
    tokens = F.coalesce("total_input_tokens", "context_tokens")
    percent = round_half_up(tokens / F.coalesce("window_size", F.lit(CONTEXT_WINDOW)) * 100)
    both = recorded.join(scanned, "session_id", "left")
    return both.select("session_id", tokens.alias("context_tokens"), percent.alias("percent"), context_level(percent).alias("level"))


def active_pace(blocks: DataFrame, now_ms: int) -> DataFrame:
    """Pace and level of active blocks."""
    return burn_rate(blocks, now_ms).withColumn("level", burn_level(F.col("tokens_per_minute")))
