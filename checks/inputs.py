"""Usage facts derived from the given tables, once as DataFrames and once as SQL text.

``events`` rows become usage of small agents' sessions; ``lineitem`` joined to
``orders`` becomes usage at benchmark size (order = session, customer = project).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterwork.functions.measures import MEASURES, zero
from meterwork.functions.pricing import FALLBACK_KEY, FALLBACK_PREFIX, STATIC_PRICES
from meterwork.operators.usage import SESSION_COLUMNS, TOOL_COLUMNS, USAGE_COLUMNS, Facts, cubes

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
NOW_MS = 1706659200000  # 2024-01-31T00:00:00Z, just after the last event
NOW_DAY = "2024-01-30"
RANGE = ("2024-01-08", "2024-01-21")
MODEL_OF_EVENT = {
    "click": "claude-opus-4-8",
    "view": "claude-haiku-4-5-20251001",
    "purchase": "gpt-5.5",
    "signup": "gemini-2.5-pro",
    "error": "mystery-model",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def usd(x: Column) -> Column:
    """Six decimals; the nudge keeps exact halves on one side in every engine."""
    return F.round(x + 1e-9, 6)


def usd_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: usd(F.col(n)) for n in names})


def _choose(column: Column, cases: dict[str, str]) -> Column:
    chain = None
    for key, value in cases.items():
        chain = F.when(column == key, value) if chain is None else chain.when(column == key, value)
    return chain


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with the usage columns all derivations share. A small table is one split: it is dealt to all cores."""
    raw, cores = table(spark, sf, "events"), spark.sparkContext.defaultParallelism
    return events_from(raw.repartition(cores) if len(raw.inputFiles()) < cores else raw)


def events_from(raw: DataFrame) -> DataFrame:
    k = F.regexp_extract("props", r"(\d+)", 1).cast("bigint")
    day = F.date_format("ts", "yyyy-MM-dd")
    base = raw.select(
        "event_id",
        "user_id",
        k.alias("k"),
        F.date_format("ts", ISO).alias("ts_raw"),
        day.alias("day"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        _choose(F.col("event_type"), MODEL_OF_EVENT).alias("model"),
        F.floor(F.col("value") * 100).cast("bigint").alias("input_tokens"),
        F.floor(F.col("value") * 10).cast("bigint").alias("output_tokens"),
    )
    return base.select(
        "*",
        (F.col("k") * 1000).alias("cache_read_tokens"),
        (F.col("k") * 10).alias("cache_write_tokens"),
        F.when(F.col("k") % 2 == 0, F.col("k") * 10).otherwise(0).cast("bigint").alias("cache_write_1h_tokens"),
        zero("long_input_tokens"),
        zero("long_cache_read_tokens"),
        zero("long_output_tokens"),
        F.lit(1).cast("bigint").alias("turns"),
        F.concat(F.lit("a"), (F.col("user_id") % 3).cast("string")).alias("agent_id"),
        F.concat(F.lit("s"), "user_id", F.lit("-"), "day").alias("session_id"),
        F.when(F.col("user_id") % 10 != 9, F.concat(F.lit("/home/team"), (F.col("user_id") % 4).cast("string"), F.lit("/p"), (F.col("user_id") % 10).cast("string"))).alias("cwd"),
        F.element_at(F.array(F.lit("mcp__ctx__query"), F.lit("Read"), F.lit("mcp__plugin_pages_pages__search"), F.lit("Bash")), (F.col("k") % 4 + 1).cast("int")).alias("tool_name"),
        (F.col("k") % 3 + 1).alias("split"),
    )


EVENTS_SQL = """
e AS (
  SELECT event_id, user_id, k, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS ts_raw, strftime(ts, '%Y-%m-%d') AS day,
    epoch_us(ts) // 1000 AS ts_ms,
    CASE event_type WHEN 'click' THEN 'claude-opus-4-8' WHEN 'view' THEN 'claude-haiku-4-5-20251001'
      WHEN 'purchase' THEN 'gpt-5.5' WHEN 'signup' THEN 'gemini-2.5-pro' WHEN 'error' THEN 'mystery-model' END AS model,
    CAST(floor(value * 100) AS BIGINT) AS input_tokens, CAST(floor(value * 10) AS BIGINT) AS output_tokens,
    k * 1000 AS cache_read_tokens, k * 10 AS cache_write_tokens,
    CASE WHEN k % 2 = 0 THEN k * 10 ELSE 0 END AS cache_write_1h_tokens,
    0 AS long_input_tokens, 0 AS long_cache_read_tokens, 0 AS long_output_tokens, 1 AS turns,
    'a' || (user_id % 3) AS agent_id, 's' || user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id,
    CASE WHEN user_id % 10 <> 9 THEN '/home/team' || (user_id % 4) || '/p' || (user_id % 10) END AS cwd,
    CASE k % 4 WHEN 0 THEN 'mcp__ctx__query' WHEN 1 THEN 'Read' WHEN 2 THEN 'mcp__plugin_pages_pages__search' ELSE 'Bash' END AS tool_name,
    k % 3 + 1 AS split
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)
)"""


def event_facts(spark: SparkSession, sf: str) -> Facts:
    """Event rows as an adapter's tables."""
    e = events(spark, sf)
    place = {"file": F.col("session_id"), "block_start": F.lit(0).cast("bigint"), "line_no": F.col("event_id"), "pos": F.lit(0).cast("bigint")}
    usage = e.withColumn("event_id", F.col("event_id").cast("string")).withColumns(place).select(*USAGE_COLUMNS)
    tools = e.withColumns({"call_id": F.col("event_id").cast("string"), "calls": F.lit(1).cast("bigint"),
                           "cache_write_1h_tokens": F.least("cache_write_1h_tokens", "cache_write_tokens")}).select(*TOOL_COLUMNS)
    sessions = e.groupBy("agent_id", "session_id").agg(
        F.concat(F.lit("/logs/dir"), (F.min("user_id") % 7).cast("string"), F.lit("/"), F.min("session_id"), F.lit(".jsonl")).alias("file"),
        F.min("cwd").alias("cwd"), F.min("ts_raw").alias("first_ts"), F.max("ts_raw").alias("last_ts"))
    return Facts(usage, tools, sessions.select(*SESSION_COLUMNS))


def event_cubes(spark: SparkSession, sf: str, kept: bool = False) -> Facts:
    """Most checks read one mart; ``kept`` stages the cubes for those that read several."""
    return cubes(event_facts(spark, sf), kept=kept)


SESSIONS_SQL = """
ses AS (
  SELECT agent_id, session_id, '/logs/dir' || (min(user_id) % 7) || '/' || session_id || '.jsonl' AS file,
    min(cwd) AS cwd, min(ts_raw) AS first_ts, max(ts_raw) AS last_ts
  FROM e GROUP BY agent_id, session_id
)"""

MODEL_OF_FLAGS = {"AF": "claude-opus-4-8", "AO": "claude-sonnet-4-6", "NF": "gpt-5.5", "NO": "gpt-5-mini",
                  "RF": "gemini-2.5-flash", "RO": "claude-haiku-4-5-20251001"}


def order_usage(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as usage events of the order's session; the order names customer and agent.

    Lines carry their session key already, so usage needs no join; see ``order_sessions``.
    """
    li = table(spark, sf, "lineitem")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    qty = F.col("l_quantity").cast("bigint")
    cols = {
        "agent_id": F.lit("orders"),
        "session_id": F.col("l_orderkey").cast("string"),
        "file": F.col("l_orderkey").cast("string"),
        "block_start": F.lit(0).cast("bigint"),
        "line_no": F.col("l_linenumber").cast("bigint"),
        "pos": F.lit(0).cast("bigint"),
        "event_id": F.lit(None).cast("string"),
        "ts_raw": F.concat(day, F.lit("T00:00:00.000Z")),
        "day": day,
        "model": _choose(F.concat("l_returnflag", "l_linestatus"), MODEL_OF_FLAGS),
        "input_tokens": qty * 100,
        "cache_read_tokens": F.floor("l_extendedprice").cast("bigint"),
        "cache_write_tokens": qty * 10,
        "cache_write_1h_tokens": F.when(F.col("l_linenumber") % 2 == 0, qty * 10).otherwise(0).cast("bigint"),
        "output_tokens": qty * 7,
        "long_input_tokens": F.lit(0).cast("bigint"),
        "long_cache_read_tokens": F.lit(0).cast("bigint"),
        "long_output_tokens": F.lit(0).cast("bigint"),
        "turns": F.lit(1).cast("bigint"),
    }
    return li.select(*[c.alias(n) for n, c in cols.items()]).select(*USAGE_COLUMNS)


LINES_SQL = """
l AS (
  SELECT 'orders' AS agent_id, CAST(l_orderkey AS VARCHAR) AS session_id, strftime(l_shipdate, '%Y-%m-%d') AS day,
    CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'claude-opus-4-8' WHEN 'AO' THEN 'claude-sonnet-4-6' WHEN 'NF' THEN 'gpt-5.5'
      WHEN 'NO' THEN 'gpt-5-mini' WHEN 'RF' THEN 'gemini-2.5-flash' WHEN 'RO' THEN 'claude-haiku-4-5-20251001' END AS model,
    q * 100 AS input_tokens, CAST(floor(l_extendedprice) AS BIGINT) AS cache_read_tokens, q * 10 AS cache_write_tokens,
    CASE WHEN l_linenumber % 2 = 0 THEN q * 10 ELSE 0 END AS cache_write_1h_tokens, q * 7 AS output_tokens,
    0 AS long_input_tokens, 0 AS long_cache_read_tokens, 0 AS long_output_tokens, 1 AS turns
  FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
)"""


def order_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """orders as sessions; the customer is the working directory."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return table(spark, sf, "orders").select(
        F.lit("orders").alias("agent_id"),
        F.col("o_orderkey").cast("string").alias("session_id"),
        F.col("o_orderkey").cast("string").alias("file"),
        F.concat(F.lit("/cust/"), F.col("o_custkey").cast("string")).alias("cwd"),
        day.alias("first_ts"),
        day.alias("last_ts"),
    )


# --- SQL pieces -------------------------------------------------------------

SUMS_SQL = ", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}" for m in MEASURES)


def _sql(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)"


PRICES_SQL = (
    "prices(key, pin, pout, rm, wm) AS (VALUES "
    + ", ".join("(" + ", ".join(_sql(v) for v in row) + ")" for row in STATIC_PRICES)
    + ")"
)


def priced_sql(source: str, name: str = "priced") -> str:
    """CTEs ``<name>_key`` and ``<name>``: rows of ``source`` with cost columns."""
    hour = "least(s.cache_write_1h_tokens, s.cache_write_tokens)"
    read = "coalesce(p.rm, 0.1)"
    hour_mult = "CASE WHEN p.wm = 0 THEN 0 ELSE 2 END"
    return f"""
{name}_key AS (
  SELECT m.model, arg_max(p.key, length(p.key)) AS key FROM (SELECT DISTINCT model FROM {source}) m
  JOIN prices p ON starts_with(m.model, p.key) GROUP BY m.model
),
{name}_cost AS (
  SELECT s.*,
    (s.input_tokens + s.long_input_tokens) * (coalesce(p.pin, 0) / 1e6) AS input_usd,
    (s.cache_read_tokens + s.long_cache_read_tokens) * (coalesce(p.pin, 0) / 1e6) * {read} AS cache_read_usd,
    (s.cache_write_tokens - {hour}) * (coalesce(p.pin, 0) / 1e6) * coalesce(p.wm, 1.25)
      + {hour} * (coalesce(p.pin, 0) / 1e6) * {hour_mult} AS cache_write_usd,
    (s.output_tokens + 0.5 * s.long_output_tokens) * (coalesce(p.pout, 0) / 1e6) AS output_usd,
    s.cache_read_tokens * (coalesce(p.pin, 0) / 1e6) * (1 - {read}) AS cache_savings_usd
  FROM {source} s LEFT JOIN {name}_key b ON b.model = s.model
  LEFT JOIN prices p ON p.key = coalesce(b.key, CASE WHEN starts_with(s.model, '{FALLBACK_PREFIX}') THEN '{FALLBACK_KEY}' END)
),
{name} AS (SELECT *, input_usd + cache_read_usd + cache_write_usd + output_usd AS cost_usd FROM {name}_cost)"""


def usd_sql(x: str, name: str | None = None) -> str:
    return f"round({x} + 1e-9, 6) AS {name or x}"


def with_sql(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes) + " " + select


def grouped_sql(source: str, keys: list[str], name: str = "g", where: str = "") -> str:
    cols = "".join(f"{k}, " for k in keys)
    group = f" GROUP BY {', '.join(keys)}" if keys else ""
    return f"\n{name} AS (SELECT {cols}{SUMS_SQL} FROM {source} {where}{group})"
