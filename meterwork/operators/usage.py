"""From event-level facts to the session cubes all reports read."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import MEASURES, sums
from ..functions.times import in_range
from ..session import stage
from .prices import with_cost

SESSION = ["agent_id", "session_id"]
# Columns of the tables every source adapter returns.
USAGE_COLUMNS = [*SESSION, "file", "block_start", "line_no", "pos", "event_id", "ts_raw", "day", "model", *MEASURES]
TOOL_COLUMNS = [*SESSION, "tool_name", "call_id", "model", "calls", "split", *MEASURES]
SESSION_COLUMNS = [*SESSION, "file", "cwd", "first_ts", "last_ts"]


class Facts(NamedTuple):
    """What an adapter returns: usage events, tool calls and sessions (or their cubes)."""

    usage: DataFrame
    tools: DataFrame
    sessions: DataFrame


def usage_cube(usage: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """A3 and A4: usage per session, day and model; every report is a regrouping of it."""
    return usage.groupBy(*SESSION, *(extra or []), "day", "model").agg(*sums())


def tool_cube(tools: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Calls and cost share per session and tool.

    A row stands for ``calls`` of the ``split`` calls that share a turn's cost.
    Costs are linear once the 1-hour part is clipped per line, so tokens are
    summed per (session, tool, model, calls, split) and priced afterwards.
    """
    kinds = [*SESSION, "tool_name", "model", "calls", "split"]
    summed = tools.groupBy(*kinds).agg(F.count("*").alias("rows"), *sums())
    priced = with_cost(summed, live)
    share = F.col("cost_usd") * F.col("calls") / F.col("split")
    return priced.groupBy(*SESSION, "tool_name").agg(
        F.sum(F.col("rows") * F.col("calls")).alias("calls"), F.sum(share).alias("cost_usd")
    )


def cubes(facts: Facts, live: DataFrame | None = None, kept: bool = True) -> Facts:
    """The tables every mart regroups, each built once and staged; ``session.clear_staged`` removes them.

    A single mart reads each of them once: give ``kept=False`` and nothing is written for it.
    """
    built = usage_cube(facts.usage), tool_cube(facts.tools, live), facts.sessions
    return Facts(*[stage(df, label) for df, label in zip(built, ("usage-cube", "tool-cube", "sessions"))]) if kept else Facts(*built)


def clamp(facts: Facts, bounds: tuple[str, str] | None) -> Facts:
    """A12 and J9 on cubes: usage of the days in range, sessions with such a day, their times cut to the range.

    Tool counts of a kept session stay whole.
    """
    if bounds is None:
        return facts
    usage = facts.usage.filter(F.col("day").isNotNull() & in_range(F.col("day"), bounds))
    alive = usage.select(*SESSION).distinct()
    lo, hi = F.lit(f"{bounds[0]}T00:00:00Z"), F.lit(f"{bounds[1]}T23:59:59.999Z")
    sessions = facts.sessions.join(alive, SESSION, "left_semi").withColumns(
        {
            "first_ts": F.when(F.col("first_ts") > lo, F.col("first_ts")).otherwise(lo),
            "last_ts": F.when(F.col("last_ts") < hi, F.col("last_ts")).otherwise(hi),
        }
    )
    return Facts(usage, facts.tools.join(alive, SESSION, "left_semi"), sessions)
