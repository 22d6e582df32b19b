"""Report marts over session cubes.

Every function takes cubes (``operators.usage.cubes``) and a ``scope``: the
columns that separate reports, e.g. [] for everything, ["agent_id"] or
["agent_id", "project_id"]. A cube is small next to the log it came from and is
meant to be kept, so marts only regroup it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import MEASURES, sums
from ..functions.text import is_mcp_tool, short_model
from ..functions.times import DAY_MS, age_label, bucket_key, duration_minutes, epoch_ms, round_half_up
from ..operators.prices import with_cost
from ..operators.ranking import with_rank
from ..operators.servers import server_audit
from ..operators.usage import SESSION, Facts, clamp

COSTS = ["input_usd", "cache_read_usd", "cache_write_usd", "output_usd", "cost_usd"]
DAILY = ["cost_usd", "input_tokens", "cache_read_tokens", "cache_write_tokens", "output_tokens", "turns"]


def usage_by(usage: DataFrame, keys: list[str]) -> DataFrame:
    """A1: sum of all measures per key."""
    return usage.groupBy(*keys).agg(*sums())


def cost_by_model(usage: DataFrame, scope: list[str], live: DataFrame | None = None) -> DataFrame:
    """Usage and cost by kind per model."""
    return with_cost(usage_by(usage, [*scope, "model"]), live)


def daily(usage: DataFrame, scope: list[str], live: DataFrame | None = None) -> DataFrame:
    """A4: dated usage, priced per day and model and then summed per day."""
    priced = with_cost(usage_by(usage.filter("day IS NOT NULL"), [*scope, "day", "model"]), live)
    return priced.groupBy(*scope, "day").agg(*[F.sum(c).alias(c) for c in DAILY])


def roll_up(days: DataFrame, scope: list[str], unit: str) -> DataFrame:
    """A5: daily rows summed into weeks (by their Monday) or months."""
    return days.groupBy(*scope, bucket_key(F.col("day"), unit).alias("day")).agg(*[F.sum(c).alias(c) for c in DAILY])


def span(sessions: DataFrame, scope: list[str]) -> DataFrame:
    """Earliest first and latest last timestamp; text that is no timestamp is ignored."""
    return _with_days(sessions.groupBy(*scope).agg(*_ends()), scope)


def _ends() -> list[Column]:
    return [
        F.count("*").alias("session_count"),
        F.min(epoch_ms(F.col("first_ts"))).alias("start_ms"),
        F.max(epoch_ms(F.col("last_ts"))).alias("end_ms"),
    ]


def _with_days(ms: DataFrame, scope: list[str]) -> DataFrame:
    day = lambda x: F.date_format(F.timestamp_millis(x), "yyyy-MM-dd")
    days = F.greatest(F.lit(1), round_half_up((F.col("end_ms") - F.col("start_ms")) / DAY_MS))
    return ms.select(
        *scope,
        "session_count",
        "start_ms",
        "end_ms",
        day(F.col("start_ms")).alias("span_start"),
        day(F.col("end_ms")).alias("span_end"),
        F.coalesce(days, F.lit(1)).cast("bigint").alias("span_days"),
    )


def hit_rate(read: Column, fresh: Column) -> Column:
    """A10: cached share of all input, 0 if there is none."""
    return F.coalesce(read / F.nullif(read + fresh, F.lit(0)), F.lit(0.0))


def totals(usage: DataFrame, sessions: DataFrame, scope: list[str], live: DataFrame | None = None) -> DataFrame:
    """One row per scope."""
    return _totals(span(sessions, scope), cost_by_model(usage, scope, live), scope)


def totals_and_total(usage: DataFrame, sessions: DataFrame, key: str, label: str, live: DataFrame | None = None) -> DataFrame:
    """``totals`` per ``key`` and, under ``label``, over all of them when there are several.

    Grouping sets count every row for its key and for the whole in one pass over either table.
    """
    named = lambda df: df.withColumn(key, F.when(F.col("_whole") == 1, F.lit(label)).otherwise(F.col(key))).drop("_whole")
    whole = F.grouping(key).alias("_whole")
    models = usage.groupingSets([[key, "model"], ["model"]], F.col(key), F.col("model")).agg(*sums(), whole)
    copied = sessions.withColumn("_key", F.col(key))  # the grouping set of the whole empties the key itself
    several = (F.min("_key") < F.max("_key")).alias("_several")
    ends = copied.groupingSets([[key], []], F.col(key)).agg(*_ends(), several, whole)
    kept = ends.filter("_whole = 0 OR _several").drop("_several")
    return _totals(_with_days(named(kept), [key]), with_cost(named(models), live), [key])


def _totals(covered: DataFrame, models: DataFrame, scope: list[str]) -> DataFrame:
    money = models.groupBy(*scope).agg(
        F.sum("cost_usd").alias("total_cost_usd"),
        F.sum("turns").alias("total_turns"),
        F.sum("cache_savings_usd").alias("cache_savings_usd"),
        hit_rate(F.sum("cache_read_tokens"), F.sum("input_tokens")).alias("cache_hit_rate"),
    )
    both = covered.join(money, scope, "left") if scope else _side_by_side(covered, money)
    cost = F.coalesce("total_cost_usd", F.lit(0.0))
    return both.select(
        *covered.columns,
        cost.alias("total_cost_usd"),
        F.coalesce("total_turns", F.lit(0)).alias("total_turns"),
        F.coalesce("cache_savings_usd", F.lit(0.0)).alias("cache_savings_usd"),
        F.coalesce("cache_hit_rate", F.lit(0.0)).alias("cache_hit_rate"),
        (cost / F.col("span_days") * 30).alias("monthly_projection_usd"),
    )


def _side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join two one-row totals."""
    return left.withColumn("_one", F.lit(1)).join(right.withColumn("_one", F.lit(1)), "_one").drop("_one")


def tool_totals(tools: DataFrame, scope: list[str]) -> DataFrame:
    """Calls and estimated cost per tool."""
    return tools.groupBy(*scope, "tool_name").agg(F.sum("calls").alias("calls"), F.sum("cost_usd").alias("cost_usd"))


def session_summary(facts: Facts, live: DataFrame | None = None, extra: list[str] | None = None) -> DataFrame:
    """Cost, turns, tool calls and models by falling cost per session."""
    models = with_cost(usage_by(facts.usage, [*SESSION, "model"]), live)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("cost_usd")).alias("c"), F.col("model").alias("m"))))
    money = models.groupBy(*SESSION).agg(
        F.sum("cost_usd").alias("cost_usd"), F.sum("turns").alias("turns"), ranked["m"].alias("models")
    )
    calls = facts.tools.groupBy(*SESSION).agg(F.sum("calls").alias("tool_calls"))
    return (
        facts.sessions.join(money, SESSION, "left")
        .join(calls, SESSION, "left")
        .select(
            *SESSION,
            *(extra or []),
            "file",
            F.col("first_ts").alias("start"),
            F.col("last_ts").alias("end"),
            F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
            F.coalesce("turns", F.lit(0)).alias("turns"),
            F.coalesce("tool_calls", F.lit(0)).alias("tool_calls"),
            F.coalesce("models", F.lit([]).cast("array<string>")).alias("models"),
        )
    )


def build_report(facts: Facts, scope: list[str] | None = None, servers: DataFrame | None = None,
                 bounds: tuple[str, str] | None = None, live: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every mart of one report, optionally restricted to a date range."""
    scope = scope or []
    cut = clamp(facts, bounds)
    tools = tool_totals(cut.tools, scope)
    marts = {
        "totals": totals(cut.usage, cut.sessions, scope, live),
        "models": cost_by_model(cut.usage, scope, live),
        "daily": daily(cut.usage, scope, live),
        "tools": tools,
        "sessions": session_summary(cut, live, [s for s in scope if s not in SESSION]),
    }
    if servers is not None:
        marts["servers"] = server_audit(tools, servers, scope)
    return marts


def report_document(marts: dict[str, DataFrame], scope: list[str]) -> DataFrame:
    """The marts of a scope as one row with nested arrays, ready for a JSON sink. The marts are report-sized."""
    doc = marts["totals"]
    for name, order in (("models", "model"), ("daily", "day"), ("tools", "tool_name"), ("servers", "name")):
        if name not in marts:
            continue
        fields = [order, *[x for x in marts[name].columns if x not in (order, *scope)]]
        nested = marts[name].groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        doc = doc.join(nested, scope, "left") if scope else _side_by_side(doc, nested)
    return doc


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON sink; tasks write their own files."""
    df.write.mode(mode).json(path)


def with_total_row(mart: DataFrame, key: str, measures: list[str], scope: list[str] | None = None) -> DataFrame:
    """The mart, one row per key, plus a TOTAL row when it has more than one; grouping sets read it once."""
    scope = scope or []
    whole, n = F.grouping(key).alias("_whole"), F.count("*").alias("_n")
    rows = mart.groupingSets([[*scope, key], scope], *[F.col(c) for c in (*scope, key)]).agg(*[F.sum(m).alias(m) for m in measures], whole, n)
    named = F.when(F.col("_whole") == 1, F.lit("TOTAL")).otherwise(F.col(key)).alias(key)
    return rows.filter("_whole = 0 OR _n > 1").select(*scope, named, *measures)


def server_total(servers: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Server count, unused count and calls."""
    return servers.groupBy(*(scope or [])).agg(
        F.count("*").alias("servers"),
        F.count(F.when(F.col("unused"), 1)).alias("unused"),
        F.sum("calls").alias("calls"),
    )


def top(mart: DataFrame, by: str, key: str, n: int, scope: list[str] | None = None) -> DataFrame:
    """The n rows with the highest ``by``; ties by name. Per scope when one is given."""
    if not scope:
        return mart.orderBy(F.desc(by), F.asc(key)).limit(n)
    rank = F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc(by), F.asc(key)))
    return mart.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def by_cost(mart: DataFrame, by: str, key: str) -> DataFrame:
    """T5: the whole mart by falling ``by``, ties by name; ``rank`` holds the place."""
    return with_rank(mart, [F.desc(by), F.asc(key)])


def top_tools(tools: DataFrame, n: int = 15) -> DataFrame:
    """By cost if any tool cost anything, else by calls; both orders agree with the one below.

    If no tool cost anything, all costs are 0 and the second key decides.
    """
    by_cost = F.greatest("cost_usd", F.lit(0.0))
    any_cost = tools.agg((F.max("cost_usd") > 0).alias("x")).scalar()
    return tools.orderBy(F.desc(F.when(any_cost, by_cost).otherwise(F.col("calls").cast("double"))), "tool_name").limit(n)


def rest_after(mart: DataFrame, n: int) -> DataFrame:
    """T4: how many rows a top-n list leaves out."""
    return mart.agg(F.greatest(F.lit(0), F.count("*") - n).alias("left_out"))


def model_shares(models: DataFrame, scope: list[str]) -> DataFrame:
    """Share of each model in the scope's cost, 0 when nothing cost anything."""
    whole = F.sum("cost_usd").over(Window.partitionBy(*scope) if scope else Window.partitionBy(F.lit(0)))
    return models.select(*scope, "model", "cost_usd", F.when(whole > 0, F.col("cost_usd") / whole).otherwise(0.0).alias("share"))


def cost_split(models: DataFrame, scope: list[str]) -> DataFrame:
    """Cost by kind of token."""
    return models.groupBy(*scope).agg(*[F.sum(c).alias(c) for c in COSTS])


def average_per_active_day(days: DataFrame, total: DataFrame, scope: list[str]) -> DataFrame:
    """Cost per day with activity."""
    active = days.groupBy(*scope).agg(F.count("*").alias("active_days"))
    both = total.join(active, scope, "left") if scope else _side_by_side(total, active)
    n = F.coalesce("active_days", F.lit(0))
    return both.select(*scope, n.alias("active_days"), (F.col("total_cost_usd") / F.greatest(n, F.lit(1))).alias("usd_per_active_day"))


def mcp_share(tools: DataFrame, scope: list[str]) -> DataFrame:
    """Calls, MCP calls and distinct tools."""
    mcp = F.sum(F.when(is_mcp_tool(F.col("tool_name")), F.col("calls")).otherwise(0))
    return tools.groupBy(*scope).agg(
        F.sum("calls").alias("calls"),
        mcp.alias("mcp_calls"),
        (mcp / F.sum("calls")).alias("mcp_share"),
        F.countDistinct("tool_name").alias("tools"),
    )


def last_days(days: DataFrame, ends: DataFrame, scope: list[str], n: int) -> DataFrame:
    """The n calendar days up to the span end, quiet ones as zero. ``ends`` is (scope, span_end)."""
    end = F.to_date("span_end")
    calendar = ends.filter("span_end IS NOT NULL").select(
        *scope, F.explode(F.sequence(F.date_sub(end, n - 1), end)).alias("d")
    ).select(*scope, F.date_format("d", "yyyy-MM-dd").alias("day"))
    return calendar.join(days, [*scope, "day"], "left").select(
        *scope, "day", F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"), F.coalesce("turns", F.lit(0)).alias("turns")
    )


def peak_day(calendar: DataFrame, scope: list[str]) -> DataFrame:
    """The day with the highest cost, the earliest on a tie."""
    at = F.struct(F.col("cost_usd"), -F.unix_date(F.to_date("day")))
    return calendar.groupBy(*scope).agg(F.max_by("day", at).alias("day"), F.max("cost_usd").alias("cost_usd"))


def last_active(mart: DataFrame, scope: list[str], n: int, key: str = "day") -> DataFrame:
    """The newest n days, weeks or months with activity."""
    rank = F.row_number().over(Window.partitionBy(*scope, F.lit(0)).orderBy(F.desc(key)))
    return mart.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def trailing_activity(calendar21: DataFrame, scope: list[str]) -> DataFrame:
    """Of the last 21 days keep active ones and the newest 14, then the newest 16 of those."""
    rank = F.row_number().over(Window.partitionBy(*scope, F.lit(0)).orderBy(F.desc("day")))
    kept = calendar21.withColumn("_rank", rank).filter((F.col("cost_usd") > 0) | (F.col("_rank") <= 14)).drop("_rank")
    return last_active(kept, scope, 16)


def session_list(summary: DataFrame, now_ms: int, n: int = 12) -> DataFrame:
    """The costliest sessions with age, length and leading model."""
    return top(summary, "cost_usd", "session_id", n).select(
        *SESSION,
        age_label(F.col("start"), now_ms).alias("age"),
        duration_minutes(F.col("start"), F.col("end")).alias("minutes"),
        "turns",
        "tool_calls",
        "cost_usd",
        short_model(F.try_element_at("models", F.lit(1))).alias("model"),
    )


def reconcile(recorded: DataFrame, computed: DataFrame) -> DataFrame:
    """C4: a session's recorded cost against the cost computed from tokens.

    recorded(session_id, recorded_usd), computed(session_id, cost_usd). ``auto`` prefers the recorded figure.
    """
    r, k = F.col("recorded_usd"), F.col("cost_usd")
    return recorded.join(computed.select("session_id", "cost_usd"), "session_id", "left").select(
        "session_id",
        F.coalesce(r, F.lit(0.0)).alias("cc"),
        F.coalesce(k, F.lit(0.0)).alias("calc"),
        F.coalesce(r, k, F.lit(0.0)).alias("auto"),
        (F.coalesce(r, F.lit(0.0)) - F.coalesce(k, F.lit(0.0))).alias("difference"),
    )
