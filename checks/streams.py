"""Checks of the streaming jobs: the events table is read as a stream and drained."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from meterwork.functions.measures import MEASURES
from meterwork.operators.usage import Facts
from meterwork.session import stage, staging_root
from meterwork.streaming import jobs

from .files import write_logs
from .inputs import EVENTS_SQL, PRICES_SQL, SUMS_SQL, events_from, grouped_sql, priced_sql, table, usd_columns, usd_sql, with_sql
from .reports import blocks_sql
from .sources import CLAUDE_SQL, CODEX_SQL, claude_lines, codex_lines, facts_table

QUERIES, SQL = {}, {}


def check(name, sql=None):
    def add(f):
        def run(spark, sf):
            jobs.use_state_store(spark)
            return f(spark, sf, f"{staging_root(spark)}/stream-{uuid.uuid4().hex}")

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return events_from(raw).withColumn("ts", F.timestamp_millis("ts_ms"))


def drain(writer):
    writer.start().awaitTermination()


BATCHES = 3
DELTA_SQL = """
m AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'hot' ELSE 'm' || (event_id % 4000) END AS message_id, session_id AS file FROM e),
w AS (SELECT *, max(input_tokens) OVER p AS hi_in, max(cache_read_tokens) OVER p AS hi_read, max(cache_write_tokens) OVER p AS hi_write,
    max(cache_write_1h_tokens) OVER p AS hi_1h, max(output_tokens) OVER p AS hi_out, count(*) OVER p AS before
  FROM m WINDOW p AS (PARTITION BY message_id ORDER BY event_id % 3, file, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@check("r01_r02_stream_deltas", with_sql(EVENTS_SQL, DELTA_SQL, select="""SELECT * FROM (SELECT message_id, file, day, model,
  CAST(sum(greatest(0, input_tokens - coalesce(hi_in, 0))) AS BIGINT) AS input_tokens, CAST(sum(greatest(0, cache_read_tokens - coalesce(hi_read, 0))) AS BIGINT) AS cache_read_tokens,
  CAST(sum(greatest(0, cache_write_tokens - coalesce(hi_write, 0))) AS BIGINT) AS cache_write_tokens, CAST(sum(greatest(0, cache_write_1h_tokens - coalesce(hi_1h, 0))) AS BIGINT) AS cache_write_1h_tokens,
  CAST(sum(greatest(0, output_tokens - coalesce(hi_out, 0))) AS BIGINT) AS output_tokens, count(*) FILTER (WHERE before = 0) AS turns FROM w GROUP BY ALL)
  WHERE input_tokens + cache_read_tokens + cache_write_tokens + cache_write_1h_tokens + output_tokens + turns > 0"""))
def _(spark, sf, work):
    """Three batches arrive one after the other; ids and models interleave in and across them."""
    mid = F.when(F.col("k") % 3 == 0, "hot").otherwise(F.concat(F.lit("m"), (F.col("event_id") % 4000).cast("string")))
    lines = events_from(table(spark, sf, "events")).select(
        mid.alias("message_id"), F.col("session_id").alias("file"), "day", "model", F.col("event_id").alias("line_no"), F.lit(True).alias("counted"),
        "input_tokens", "cache_read_tokens", "cache_write_tokens", "cache_write_1h_tokens", "output_tokens")
    for k in range(BATCHES):
        lines.filter(F.col("line_no") % BATCHES == k).write.parquet(f"{work}/in/part={k}")
        arrived = spark.readStream.schema(lines.schema).parquet(f"{work}/in").drop("part")
        drain(jobs.message_deltas_job(arrived, work))
    deltas = spark.read.parquet(f"{work}/deltas")
    counters = ["input_tokens", "cache_read_tokens", "cache_write_tokens", "cache_write_1h_tokens", "output_tokens", "turns"]
    return deltas.groupBy("message_id", "file", "day", "model").agg(*[F.sum(c).alias(c) for c in counters])


@check("r03_stream_dedup", with_sql(EVENTS_SQL, select="SELECT event_id % 4000 AS call_id, count(*) AS kept FROM (SELECT DISTINCT event_id % 4000 AS event_id FROM e) GROUP BY 1"))
def _(spark, sf, work):
    keyed = event_stream(spark, sf).select("ts", (F.col("event_id") % 4000).alias("call_id"))
    kept = jobs.run_to_table(jobs.first_of(keyed, ["call_id"], delay="40 days"), f"{work}/out", f"{work}/ck")
    return kept.groupBy("call_id").agg(F.count("*").alias("kept"))


@check("r04_stream_daily_usage", with_sql(EVENTS_SQL, select=f"""SELECT day, model, {SUMS_SQL} FROM e
  WHERE CAST(day AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT make_timestamp(max(ts_ms) * 1000) FROM e) - INTERVAL 1 DAY GROUP BY ALL"""))
def _(spark, sf, work):
    return jobs.run_to_table(jobs.daily_usage_stream(event_stream(spark, sf)), f"{work}/out", f"{work}/ck").select("day", "model", *MEASURES)


@check("r04_stream_seven_days", with_sql(EVENTS_SQL, f"""
w AS (SELECT e.*, CAST(day AS DATE) - CAST(n AS INTEGER) AS first_day FROM e, generate_series(0, 6) AS s(n))""", select=f"""
SELECT strftime(first_day, '%Y-%m-%d') AS day, model, {SUMS_SQL} FROM w
WHERE CAST(first_day AS TIMESTAMP) + INTERVAL 7 DAY <= (SELECT make_timestamp(max(ts_ms) * 1000) FROM e) - INTERVAL 1 DAY GROUP BY ALL"""))
def _(spark, sf, work):
    week = jobs.daily_usage_stream(event_stream(spark, sf), length="7 days", slide="1 day")
    return jobs.run_to_table(week, f"{work}/out", f"{work}/ck").select("day", "model", *MEASURES)


@check("r05_stream_blocks", with_sql(EVENTS_SQL, PRICES_SQL, blocks_sql(["user_id"], 5), select=f"""
SELECT CAST(user_id AS VARCHAR) AS key, block_start, block_end, first_ts, last_ts, total_tokens, {usd_sql('cost_usd')}, 0 AS late_events, TRUE AS closed
FROM (SELECT *, max(block_start) OVER (PARTITION BY user_id) AS newest FROM blocks)
WHERE block_start < newest OR block_end <= (SELECT max(ts_ms) FROM e) - 3600000"""))
def _(spark, sf, work):
    usage = event_stream(spark, sf)
    drain(jobs.block_hours_job(usage, F.col("user_id").cast("string"), work))
    hours = spark.readStream.schema(jobs.PACK_DDL).parquet(f"{work}/hours")
    return usd_columns(jobs.run_to_table(jobs.block_stream(hours), f"{work}/out", f"{work}/ck2"), "cost_usd")


def r6_sql(now):
    """The batch answer at one moment: spend of the day and the pace of the newest block if it is still open."""
    ms = int(now.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    return with_sql(EVENTS_SQL, PRICES_SQL, blocks_sql(["agent_id"], 5), f"""
day_used AS (SELECT * FROM e WHERE day = '{now:%Y-%m-%d}'),
spent AS (SELECT agent_id, sum(cost_usd) AS usd FROM ({priced_now()}) GROUP BY 1),
open AS (SELECT *, {ms} - first_ts AS gone FROM (SELECT *, max(block_start) OVER (PARTITION BY agent_id) AS newest FROM blocks) WHERE block_start = newest AND {ms} < block_end)""",
        select=f"""SELECT coalesce(spent.agent_id, open.agent_id) AS key, {usd_sql('coalesce(usd, 0)', 'today_usd')}, {usd_sql('cost_usd', 'block_usd')},
  greatest(0, block_end - {ms}) AS remaining_ms, {usd_sql('total_tokens / (greatest(60000, gone) / 60000.0)', 'tokens_per_minute')},
  {usd_sql('cost_usd / (greatest(60000, gone) / 3600000.0)', 'cost_per_hour')},
  CASE WHEN total_tokens / (greatest(60000, gone) / 60000.0) > 5000 THEN 'high' WHEN total_tokens / (greatest(60000, gone) / 60000.0) > 2000 THEN 'moderate'
    WHEN total_tokens IS NOT NULL THEN 'normal' END AS level FROM spent FULL JOIN open ON spent.agent_id = open.agent_id""")


def priced_now():
    """Usage of the chosen day per agent and model, priced."""
    return f"WITH {grouped_sql('day_used', ['agent_id', 'model'], 'dg').strip()}, {priced_sql('dg', 'dp').strip()} SELECT agent_id, cost_usd FROM dp"


R6_NOWS = {"evening": dt.datetime(2024, 1, 30, 20), "early": dt.datetime(2024, 1, 30, 3, 30), "after_midnight": dt.datetime(2024, 1, 31, 0, 20)}


def _live(now):
    def run(spark, sf, work):
        """Events arrive in two interleaved batches, so blocks grow in the second."""
        usage = events_from(table(spark, sf, "events")).withColumn("key", F.col("agent_id"))
        for k, part in enumerate((F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1)):
            usage.filter(part).write.parquet(f"{work}/in/part={k}")
            arrived = spark.readStream.schema(usage.schema).parquet(f"{work}/in").drop("part")
            drain(jobs.live_job(arrived, f"{work}/state", f"{work}/view", f"{work}/ck", lambda: now))
        return usd_columns(spark.read.parquet(f"{work}/view"), "today_usd", "block_usd", "tokens_per_minute", "cost_per_hour")

    return run


for _name, _now in R6_NOWS.items():
    check("r06_stream_live_view" if _name == "evening" else f"r06_stream_live_view_{_name}", r6_sql(_now))(_live(_now))


# ---- text files as a stream (R1) ---------------------------------------------------


def arriving(lines, root, job):
    """Files of three thirds of the names, in their order, land one third after the other; ``job`` runs after each."""
    third = F.ntile(BATCHES).over(Window.orderBy("file"))
    files = lines.select("file").distinct().withColumn("third", third)
    placed = stage(lines.join(files, "file"), "arriving")
    for k in range(1, BATCHES + 1):
        write_logs(placed.filter(F.col("third") == k), f"{root}/in")
        drain(job())


TWENTY = [x.replace("'/logs/dir' || (user_id % 7) || '/' || session_id || '.jsonl' AS file", "'/logs/u' || (user_id % 20 + 10) || '.jsonl' AS file") for x in CLAUDE_SQL]


@check("r01_r02_claude_text_stream", with_sql(*TWENTY, select=f"SELECT file AS session_id, day, model, {SUMS_SQL} FROM u GROUP BY ALL"))
def _(spark, sf, work):
    """Transcripts, twenty files of many sessions, arrive in three batches; the usage is that of the batch job over all of them."""
    user = F.regexp_extract("file", r"/s(\d+)-", 1).cast("int")
    lines = claude_lines(spark, sf).withColumn("file", F.concat(F.lit("/logs/u"), (user % 20 + 10).cast("string"), F.lit(".jsonl")))
    arriving(lines, work, lambda: jobs.claude_text_job(jobs.stream_lines(spark, f"{work}/in"), work))
    return facts_table(Facts(jobs.claude_usage(spark, work), None, None)).withColumn("session_id", F.regexp_extract("session_id", "/in(/.*)$", 1))


@check("r01_r03_codex_text_stream", with_sql(*CODEX_SQL, select=f"SELECT '/a/u' || user_id || '.jsonl' AS session_id, day, model, {SUMS_SQL} FROM cf GROUP BY ALL"))
def _(spark, sf, work):
    """Rollouts and, in later batches, copies of them: counters, models and turns are settled per file, copies dropped across batches."""
    arriving(codex_lines(spark, sf), work, lambda: jobs.codex_text_job(jobs.stream_lines(spark, f"{work}/in", listed=f"{work}/listed"), work))
    return facts_table(jobs.codex_facts(spark, work)).withColumn("session_id", F.regexp_extract("session_id", "/in(/.*)$", 1))


# ---- daily cost with late rows (R4) -----------------------------------------------------

# Three batches: the first fourteen days; the days after them; the newest two days with a fifth of the rows of long ago.
# A batch ends the days that lie more than ten days behind the newest time of the batches before it; what comes later for
# an ended day is late.
R4_SQL = f"""
p AS (SELECT *, CASE WHEN ts_ms >= (SELECT max(ts_ms) FROM e) - 86400000 * 2 THEN 2 WHEN event_id % 5 = 0 AND ts_ms < (SELECT max(ts_ms) FROM e) - 86400000 * 20 THEN 2
  WHEN ts_ms < (SELECT min(ts_ms) FROM e) + 86400000 * 14 THEN 0 ELSE 1 END AS part FROM e),
mk AS (SELECT part, max(max(ts_ms)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - 86400000 * 10 AS mark FROM p GROUP BY part),
dy AS (SELECT p.*, CAST(epoch(CAST(day AS TIMESTAMP)) * 1000 AS BIGINT) + 86400000 <= coalesce(mark, -1) AS late FROM p JOIN mk USING (part))"""


def r4_batches(spark, sf, work, job):
    e = events_from(table(spark, sf, "events")).withColumn("ts", F.timestamp_millis("ts_ms"))
    lo, hi = e.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    part = (
        F.when(F.col("ts_ms") >= hi - 86_400_000 * 2, 2).when((F.col("event_id") % 5 == 0) & (F.col("ts_ms") < hi - 86_400_000 * 20), 2)
        .when(F.col("ts_ms") < lo + 86_400_000 * 14, 0).otherwise(1)
    )
    e = e.withColumn("part", part)
    for k in range(BATCHES):
        e.filter(F.col("part") == k).drop("part").write.parquet(f"{work}/in/part={k}")
        drain(job(spark.readStream.schema(e.drop("part").schema).parquet(f"{work}/in")))


@check("r04_stream_daily_cost", with_sql(EVENTS_SQL, PRICES_SQL, R4_SQL, "\nok AS (SELECT * FROM dy WHERE NOT late)", grouped_sql("ok", ["day", "model"]), priced_sql("g"), select=f"""
SELECT day, model, input_tokens, output_tokens, turns, {usd_sql('cost_usd')} FROM priced
WHERE CAST(epoch(CAST(day AS TIMESTAMP)) * 1000 AS BIGINT) + 86400000 <= (SELECT max(ts_ms) FROM p WHERE part < 2) - 86400000 * 10"""))
def _(spark, sf, work):
    """Finished days, priced as they leave; days of late rows keep what was counted in time."""
    r4_batches(spark, sf, work, lambda s: jobs.daily_cost_job(s, work, delay="10 days"))
    cost = spark.read.parquet(f"{work}/cost").select("day", "model", "input_tokens", "output_tokens", "turns", "cost_usd")
    return usd_columns(cost, "cost_usd")


@check("r04_stream_late_sums", with_sql(EVENTS_SQL, R4_SQL, select="SELECT CAST(count(*) AS BIGINT) AS late_sums FROM (SELECT DISTINCT part, day, model FROM dy WHERE late)"))
def _(spark, sf, work):
    """How many (batch, day, model) sums came after their day had ended for good."""
    r4_batches(spark, sf, work, lambda s: jobs.daily_cost_job(s, work, delay="10 days"))
    return spark.read.parquet(f"{work}/late").agg(F.sum("late_sums").alias("late_sums"))


# ---- live view with bounded state (R6) -----------------------------------------------------


def _bounded(now):
    def run(spark, sf, work):
        """Events arrive in order in three batches, each read when its last day is over; the last one at ``now``."""
        usage = events_from(table(spark, sf, "events")).withColumn("key", F.col("agent_id")).filter(F.col("ts_ms") <= int(now.replace(tzinfo=dt.timezone.utc).timestamp() * 1000))
        cuts = [dt.datetime(2024, 1, 14), dt.datetime(2024, 1, 27), now]
        low = 0
        for k, cut in enumerate(cuts):
            high = int(cut.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
            usage.filter((F.col("ts_ms") >= low) & (F.col("ts_ms") < high + (cut == now))).write.parquet(f"{work}/in/part={k}")
            arrived = spark.readStream.schema(usage.schema).parquet(f"{work}/in").drop("part")
            drain(jobs.live_job(arrived, f"{work}/state", f"{work}/view", f"{work}/ck", lambda: cut, keep=dt.timedelta(hours=30)))
            low = high
        return usd_columns(spark.read.parquet(f"{work}/view"), "today_usd", "block_usd", "tokens_per_minute", "cost_per_hour")

    return run


def bounded_sql(now):
    """The batch answer from what has happened by then; a key without an open block has no time left of one."""
    ms = int(now.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    seen = EVENTS_SQL.replace("e AS (", "e0 AS (", 1) + f",\ne AS (SELECT * FROM e0 WHERE ts_ms <= {ms})"
    return r6_sql(now).replace(EVENTS_SQL, seen, 1).replace(f"greatest(0, block_end - {ms})", f"CASE WHEN block_end IS NOT NULL THEN greatest(0, block_end - {ms}) END")


for _name, _now in R6_NOWS.items():
    check(f"r06_stream_bounded_view_{_name}", bounded_sql(_now))(_bounded(_now))
