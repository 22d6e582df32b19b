"""Shared ending of the record-style sources: zero filter, duplicate removal, session times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import zero
from ..operators.dedup import first_records
from ..operators.usage import SESSION, TOOL_COLUMNS, USAGE_COLUMNS, Facts
from ..session import stage

PLACE = ["file", "block_start", "line_no", "pos"]


def record(agent: str, session: Column, model: Column, ts: Column, event_id: Column | None, input_tokens: Column,
           output_tokens: Column, cache_read: Column | None = None, cache_write: Column | None = None) -> list[Column]:
    """Projection of one parsed row to a usage record."""
    none = F.lit(None).cast("string")
    nothing = F.lit(0).cast("bigint")
    return [
        F.lit(agent).alias("agent_id"),
        session.alias("session_id"),
        *[F.col(p) for p in PLACE],
        (none if event_id is None else event_id).alias("event_id"),
        ts.alias("ts_raw"),
        model.alias("model"),
        input_tokens.alias("input_tokens"),
        (nothing if cache_read is None else cache_read).alias("cache_read_tokens"),
        (nothing if cache_write is None else cache_write).alias("cache_write_tokens"),
        output_tokens.alias("output_tokens"),
    ]


def complete(usage: DataFrame) -> DataFrame:
    """Add day, turn and the measures a source does not have."""
    have = set(usage.columns)
    usage = usage.withColumn("day", F.substring("ts_raw", 1, 10))
    extra = [zero(c) for c in USAGE_COLUMNS if c not in have and c not in ("day", "turns")]
    turns = F.lit(1).cast("bigint").alias("turns")
    return usage.select("*", *extra, turns).select(*USAGE_COLUMNS)


def no_tools(usage: DataFrame) -> DataFrame:
    """An empty tool table; the source records none."""
    types = {"tool_name": "string", "call_id": "string", "calls": "bigint", "split": "bigint"}
    cols = [(F.lit(None).cast(types[c]).alias(c) if c in types else F.col(c)) for c in TOOL_COLUMNS]
    return usage.filter(F.lit(False)).select(*cols)


def sessions_of(usage: DataFrame, cwd: DataFrame | None = None) -> DataFrame:
    """Earliest and latest timestamp text of each session's kept rows; ``cwd`` is (session_id, cwd)."""
    base = usage.groupBy(*SESSION).agg(
        F.min("file").alias("file"), F.min("ts_raw").alias("first_ts"), F.max("ts_raw").alias("last_ts")
    )
    if cwd is None:
        return base.select(*SESSION, "file", F.lit(None).cast("string").alias("cwd"), "first_ts", "last_ts")
    return base.join(cwd, "session_id", "left").select(*SESSION, "file", "cwd", "first_ts", "last_ts")


def records_to_facts(records: DataFrame, dedup: bool, cwd: DataFrame | None = None) -> Facts:
    """P14 then D1 then the canonical tables. The typed rows are staged: sessions, cubes and marts never parse the log again."""
    used = records.filter(
        F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens") != 0
    )
    usage = stage(complete(first_records(used) if dedup else used), "records")
    return Facts(usage, no_tools(usage), sessions_of(usage, cwd))
