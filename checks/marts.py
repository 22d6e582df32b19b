"""Checks of whole reports, live prices in marts, ranges from arguments, and blocks straight from a log."""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwork.functions import times
from meterwork.functions.pricing import PRICE_FIELDS
from meterwork.operators import blocks as bl
from meterwork.operators import prices, servers
from meterwork.operators.usage import cubes
from meterwork.plans import agents, live, projects, reports
from meterwork.sources import antigravity, claude, json_lines
from meterwork.sources.lines import table_lines

from .inputs import EVENTS_SQL, PRICES_SQL, RANGE, SESSIONS_SQL, SUMS_SQL, event_cubes, event_facts, events, grouped_sql, priced_sql, table, usd_columns, usd_sql, with_sql
from .reports import BURN_SQL, CLAMP_SQL, LIVE_MS, PROJECT_SERVERS_SQL, PROJECT_SQL, REGISTRY_SQL, TOOLS_SQL, blocks_sql, event_projects, totals_sql
from .sources import CLAUDE_SQL, ESTIMATE_SQL, claude_lines, conversation_files, history_lines

QUERIES, SQL = {}, {}


def check(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---- blocks from transcripts -------------------------------------------------------

# The walk of ``blocks_sql`` over the usage that transcripts add, for the whole account.
LOG_BLOCKS_SQL = (*CLAUDE_SQL, "\nlu AS (SELECT *, 'all' AS account FROM u)", blocks_sql(["account"], 5).replace("AS bucket FROM e)", "AS bucket FROM lu)"))


def log_blocks(spark, sf) -> DataFrame:
    return bl.usage_blocks(claude.load(claude_lines(spark, sf)).usage, [], LIVE_MS)


@check("w09_a21_a27_blocks_from_log", with_sql(*LOG_BLOCKS_SQL, select=f"SELECT block_start, block_end, first_ts, last_ts, total_tokens, {usd_sql('cost_usd')}, models, active FROM blocks"))
def _(spark, sf):
    """From transcript lines to the account's billing blocks."""
    return usd_columns(log_blocks(spark, sf).withColumn("models", F.concat_ws(",", "models")), "cost_usd")


@check("a22_t07_p36_active_block_of_log", with_sql(*LOG_BLOCKS_SQL, BURN_SQL.replace("SELECT user_id, ", "SELECT "), "\nlim AS (SELECT max(total_tokens) FILTER (NOT active) AS token_limit FROM blocks)", select="""
SELECT block_start, total_tokens, token_limit, CAST(floor(total_tokens + tpm * (remaining_ms / 60000.0) + 0.5) AS BIGINT) AS projected_tokens,
  CASE WHEN floor(total_tokens + tpm * (remaining_ms / 60000.0) + 0.5) > token_limit THEN 'over' WHEN total_tokens > token_limit * 0.8 THEN 'near' ELSE 'ok' END AS level FROM burn, lim"""))
def _(spark, sf):
    """The active block alone, its projection against the biggest finished block."""
    blocks = log_blocks(spark, sf)
    pace = bl.burn_rate(bl.recent_blocks(blocks, LIVE_MS, active_only=True), LIVE_MS)
    both = pace.withColumn("_one", F.lit(1)).join(bl.biggest_done_block(blocks, []).withColumn("_one", F.lit(1)), "_one")
    level = bl.limit_level(F.col("total_tokens"), F.col("token_limit"), F.col("projected_tokens"))
    return both.select("block_start", "total_tokens", "token_limit", "projected_tokens", level.alias("level"))


# ---- whole reports --------------------------------------------------------------------


@check("a13_marts_in_range", with_sql(*CLAMP_SQL, *totals_sql(["agent_id"], "er", "sr"), grouped_sql("er", ["agent_id", "model"], "mg"), priced_sql("mg", "mp"),
    grouped_sql("er", ["agent_id", "day", "model"], "dg"), priced_sql("dg", "dp"), grouped_sql("er", ["agent_id", "session_id", "model"], "sg"), priced_sql("sg", "sp"), *TOOLS_SQL[2:],
    "\nkt AS (SELECT * FROM tools WHERE session_id IN (SELECT session_id FROM sr))", select=f"""
SELECT 'totals' AS part, agent_id, '' AS item, total_cost_usd AS cost_usd, total_turns AS n FROM tot
UNION ALL SELECT 'models', agent_id, model, {usd_sql('cost_usd')}, CAST(turns AS BIGINT) FROM mp
UNION ALL SELECT 'daily', agent_id, day, {usd_sql('sum(cost_usd)', 'cost_usd')}, CAST(sum(turns) AS BIGINT) FROM dp GROUP BY agent_id, day
UNION ALL SELECT 'tools', agent_id, tool_name, {usd_sql('sum(cost_usd)', 'cost_usd')}, CAST(sum(calls) AS BIGINT) FROM kt GROUP BY agent_id, tool_name
UNION ALL SELECT 'sessions', agent_id, session_id, {usd_sql('sum(cost_usd)', 'cost_usd')}, CAST(sum(turns) AS BIGINT) FROM sp GROUP BY agent_id, session_id
UNION ALL SELECT 'calls', agent_id, session_id, 0, CAST(sum(calls) AS BIGINT) FROM kt GROUP BY agent_id, session_id"""))
def _(spark, sf):
    """All five marts of a report over a range of days; tools of a session in range stay whole."""
    marts = reports.build_report(event_cubes(spark, sf, kept=True), ["agent_id"], bounds=RANGE)
    pick = lambda part, mart, item, cost, n: marts[mart].select(F.lit(part).alias("part"), "agent_id", item.alias("item"), cost.alias("cost_usd"), n.cast("bigint").alias("n"))
    rows = [
        pick("totals", "totals", F.lit(""), F.col("total_cost_usd"), F.col("total_turns")), pick("models", "models", F.col("model"), F.col("cost_usd"), F.col("turns")),
        pick("daily", "daily", F.col("day"), F.col("cost_usd"), F.col("turns")), pick("tools", "tools", F.col("tool_name"), F.col("cost_usd"), F.col("calls")),
        pick("sessions", "sessions", F.col("session_id"), F.col("cost_usd"), F.col("turns")), pick("calls", "sessions", F.col("session_id"), F.lit(0.0), F.col("tool_calls"))]
    return usd_columns(functools.reduce(DataFrame.union, rows), "cost_usd")


@check("a17_j10_server_costs", with_sql(*PROJECT_SQL, *totals_sql(["agent_id", "project_id"], "pe", "ps"), PROJECT_SERVERS_SQL,
    "\npw AS (SELECT * REPLACE (least(cache_write_1h_tokens, cache_write_tokens) AS cache_write_1h_tokens) FROM pe)", priced_sql("pw", "px"),
    "\npc AS (SELECT agent_id, project_id, tool_name, sum(cost_usd / split) AS cost_usd FROM px GROUP BY ALL)", select=f"""
SELECT n.name, {usd_sql('sum(coalesce(c.cost_usd, 0))', 'cost_usd')} FROM pnames n
LEFT JOIN pc c ON c.agent_id = n.agent_id AND c.project_id = n.project_id AND starts_with(c.tool_name, 'mcp__' || n.name || '__') GROUP BY n.name"""))
def _(spark, sf):
    """What the tools of every server cost, over all projects."""
    facts, dim = event_projects(spark, sf)
    scope = ["agent_id", "project_id"]
    srv = dim.filter("real_path IS NOT NULL").select(*scope, F.when(F.col("agent_id") == "a0", "ctx").otherwise("idle").alias("name"), F.col("real_path").alias("source"))
    audit = servers.server_audit(reports.tool_totals(facts.tools, scope), srv, scope)
    cost = usd_columns(reports.totals(facts.usage, facts.sessions, scope), "total_cost_usd")
    return usd_columns(projects.merged_servers(audit, [], cost).select("name", "cost_usd"), "cost_usd")


@check("a19_reasons", with_sql(EVENTS_SQL, REGISTRY_SQL, select=f"""SELECT agent_id, name_seen, CASE WHEN agent_id = 'cursor' AND seen THEN '{agents.find("cursor").unsupported_reason.replace("'", "''")}' END AS reason
  FROM (SELECT reg.agent_id, count(e.event_id) > 0 AS seen, count(e.event_id) AS name_seen FROM reg LEFT JOIN e ON reg.pos = e.user_id % 17 GROUP BY reg.agent_id)"""))
def _(spark, sf):
    """Why an agent that was found has no figures; agents without a reason have none."""
    dim = agents.agent_dim(spark)
    seen = events(spark, sf).drop("agent_id").withColumn("position", (F.col("user_id") % 17).cast("int")).groupBy("position").agg(F.count("*").alias("name_seen"))
    found = dim.join(seen, "position")
    none = found.select("agent_id", F.lit("-").alias("project_id"), F.lit(0).alias("session_count"), F.lit(0.0).alias("total_cost_usd")).filter(F.lit(False))
    status = agents.agent_status(dim, none, found.select("agent_id")).select("agent_id", "reason")
    return status.join(found.select("agent_id", "name_seen"), "agent_id", "left").select("agent_id", F.coalesce("name_seen", F.lit(0)).alias("name_seen"), "reason")


# ---- ranges from arguments ------------------------------------------------------------------

RANGES = {"since": {"since": "20240108"}, "until": {"until": " 2024-01-21"}, "both": {"since": "2024-01-08", "until": "20240121", "days": 3}, "days": {"days": 5}, "none": {"since": "8 January"}}


@check("p28_range_arguments", with_sql(EVENTS_SQL, "\nr(name, lo, hi) AS (VALUES ('since', '2024-01-08', '9999-12-31'), ('until', '0000-01-01', '2024-01-21'), ('both', '2024-01-08', '2024-01-21'), ('days', '2024-01-26', '2024-01-30'), ('none', '0000-01-01', '9999-12-31'))",
    select=f"SELECT name, model, {SUMS_SQL} FROM e JOIN r ON day BETWEEN lo AND hi GROUP BY ALL"))
def _(spark, sf):
    """Usage in ranges as a user types them: open ends, both spellings of a date, last days, and text that is no date."""
    now = dt.datetime(2024, 1, 30, 12)
    usage = event_cubes(spark, sf).usage
    rows = [reports.usage_by(usage.filter(times.in_range(F.col("day"), times.resolve_range(now, **x))), ["model"]).withColumn("name", F.lit(name)) for name, x in RANGES.items()]
    return functools.reduce(DataFrame.union, rows)


# ---- marts with live prices ---------------------------------------------------------------------

# A live table derived from part: one model by its own name, three by a prefix (of which two have a seed price too).
LIVE_KEYS = ["claude-opus-4-8", "claude-haiku", "mystery", "gpt-5.5"]
LIVE_SQL = f"""
lv AS (SELECT {LIVE_KEYS!r}[p_partkey % 4 + 1] AS key, round(avg(p_retailprice) / 100, 2) AS i, round(max(p_retailprice) / 50, 2) AS o, CASE WHEN p_partkey % 4 < 2 THEN 0.25 END AS r,
  CASE WHEN p_partkey % 4 = 0 THEN 1.5 END AS w, CASE WHEN p_partkey % 4 = 2 THEN 3.0 END AS h FROM part GROUP BY p_partkey % 4),
um AS (SELECT DISTINCT model FROM e)"""


def live_prices(spark, sf) -> DataFrame:
    k = F.col("p_partkey") % 4
    key = F.element_at(F.array(*[F.lit(x) for x in LIVE_KEYS]), (F.col("k") + 1).cast("int"))
    sums = table(spark, sf, "part").groupBy(k.alias("k")).agg(F.round(F.avg("p_retailprice") / 100, 2).alias("i"), F.round(F.max("p_retailprice") / 50, 2).alias("o"))
    none = F.lit(None).cast("double")
    values = [F.col("i"), F.col("o"), F.when(F.col("k") < 2, F.lit(0.25)), F.when(F.col("k") == 0, F.lit(1.5)), F.when(F.col("k") == 2, F.lit(3.0)).otherwise(none)]
    return sums.select(key.alias("key"), *[v.cast("double").alias(n) for v, n in zip(values, PRICE_FIELDS)])


PICK_SQL = """
seedp AS (SELECT m.model, arg_max(key, length(key)) AS key FROM um m JOIN prices ON starts_with(m.model, prices.key) GROUP BY 1),
livep AS (SELECT m.model, arg_max(lv.key, length(lv.key)) AS key FROM um m JOIN lv ON starts_with(m.model, lv.key) GROUP BY 1),
pick AS (SELECT um.model, CASE WHEN x.key IS NOT NULL THEN x.i WHEN s.key IS NOT NULL THEN s.pin WHEN l.key IS NOT NULL THEN l.i WHEN starts_with(um.model, 'claude') THEN 5.0 ELSE 0 END AS i,
  CASE WHEN x.key IS NOT NULL THEN x.o WHEN s.key IS NOT NULL THEN s.pout WHEN l.key IS NOT NULL THEN l.o WHEN starts_with(um.model, 'claude') THEN 25.0 ELSE 0 END AS o,
  coalesce(CASE WHEN x.key IS NOT NULL THEN x.r WHEN s.key IS NOT NULL THEN s.rm WHEN l.key IS NOT NULL THEN l.r END, 0.1) AS r,
  CASE WHEN x.key IS NOT NULL THEN x.w WHEN s.key IS NOT NULL THEN s.wm WHEN l.key IS NOT NULL THEN l.w END AS w,
  CASE WHEN x.key IS NOT NULL THEN x.h WHEN s.key IS NOT NULL THEN NULL WHEN l.key IS NOT NULL THEN l.h END AS h
  FROM um LEFT JOIN lv x ON x.key = um.model LEFT JOIN seedp sp ON sp.model = um.model LEFT JOIN prices s ON s.key = sp.key LEFT JOIN livep lp ON lp.model = um.model LEFT JOIN lv l ON l.key = lp.key)"""


def cost_sql(source: str, name: str) -> str:
    return f"""
{name} AS (SELECT g.*, input_tokens * (i / 1e6) AS input_usd, cache_read_tokens * (i / 1e6) * r AS cache_read_usd,
  (cache_write_tokens - least(cache_write_1h_tokens, cache_write_tokens)) * (i / 1e6) * coalesce(w, 1.25)
    + least(cache_write_1h_tokens, cache_write_tokens) * (i / 1e6) * coalesce(h, CASE WHEN w = 0 THEN 0 ELSE 2 END) AS cache_write_usd, output_tokens * (o / 1e6) AS output_usd
  FROM {source} g JOIN pick ON pick.model = g.model)"""


PARTS = ["input_usd", "cache_read_usd", "cache_write_usd", "output_usd", "cost_usd"]


@check("j01_x03_models_at_live_prices", with_sql(EVENTS_SQL, PRICES_SQL, LIVE_SQL, grouped_sql("e", ["agent_id", "model"]), PICK_SQL, cost_sql("g", "cost"), select=f"""SELECT agent_id, model,
  {', '.join(usd_sql(c) for c in PARTS[:4])}, {usd_sql('input_usd + cache_read_usd + cache_write_usd + output_usd', 'cost_usd')} FROM cost"""))
def _(spark, sf):
    """Every kind of cost at live prices: own name before the seed, the seed before a live prefix, all five price fields."""
    mart = reports.cost_by_model(event_cubes(spark, sf).usage, ["agent_id"], live_prices(spark, sf))
    return usd_columns(mart.select("agent_id", "model", *PARTS), *PARTS)


@check("j01_x03_report_at_live_prices", with_sql(EVENTS_SQL, PRICES_SQL, LIVE_SQL, grouped_sql("e", ["agent_id", "day", "model"]), PICK_SQL, cost_sql("g", "cost"), """
tw AS (SELECT * REPLACE (least(cache_write_1h_tokens, cache_write_tokens) AS cache_write_1h_tokens) FROM e)""", cost_sql("tw", "tcost"), select=f"""
SELECT 'daily' AS part, agent_id, day AS item, {usd_sql('sum(input_usd + cache_read_usd + cache_write_usd + output_usd)', 'cost_usd')} FROM cost GROUP BY agent_id, day
UNION ALL SELECT 'tools', agent_id, tool_name, {usd_sql('sum((input_usd + cache_read_usd + cache_write_usd + output_usd) / split)', 'cost_usd')} FROM tcost GROUP BY agent_id, tool_name"""))
def _(spark, sf):
    """Days and tools of a report whose cubes and marts are all priced with the live table."""
    table_ = live_prices(spark, sf)
    marts = reports.build_report(cubes(event_facts(spark, sf), table_), ["agent_id"], live=table_)
    days = marts["daily"].select(F.lit("daily").alias("part"), "agent_id", F.col("day").alias("item"), "cost_usd")
    return usd_columns(days.union(marts["tools"].select(F.lit("tools"), "agent_id", "tool_name", "cost_usd")), "cost_usd")



# ---- branches that other checks do not take ------------------------------------------------------


@check("s23_catalog_document", with_sql("""
cd AS (SELECT CAST(floor(p_retailprice) AS BIGINT) AS cost, p_partkey, p_size, CASE WHEN p_partkey % 2 = 0 THEN 'prov/' ELSE '' END || 'm-' || (p_partkey // 2) AS key FROM part),
cn AS (SELECT *, split_part(key, '/', -1) AS name, contains(key, '/') AS prefixed FROM cd WHERE p_size % 5 <> 0)""",
    select="""SELECT name AS key, arg_min(cost * 1e6, (prefixed, p_partkey)) AS input_per_mtok, arg_min(cost * 2 * 1e6, (prefixed, p_partkey)) AS output_per_mtok FROM cn GROUP BY name"""))
def _(spark, sf):
    """A catalog as it is published, one JSON object of all entries: bare names beat prefixed ones, free entries do not count."""
    p = table(spark, sf, "part")
    cost = F.floor("p_retailprice").cast("bigint")
    key = F.concat(F.when(F.col("p_partkey") % 2 == 0, "prov/").otherwise(""), F.lit("m-"), F.floor(F.col("p_partkey") / 2).cast("string"))
    entry = F.concat(F.lit('"'), key, F.lit('":{"input_cost_per_token":'), F.when(F.col("p_size") % 5 == 0, F.lit(0)).otherwise(cost).cast("string"),
                     F.lit(',"output_cost_per_token":'), (cost * 2).cast("string"), F.lit("}"))
    listed = p.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("k"), entry.alias("e")))).alias("x"))
    document = listed.select(F.concat(F.lit("{"), F.concat_ws(",", F.col("x.e")), F.lit("}")).alias("value"))
    return prices.catalog_prices(prices.catalog_entries(document)).select("key", "input_per_mtok", "output_per_mtok")


@check("d03_spans_without_response", with_sql(EVENTS_SQL, """
sp AS (SELECT *, event_id % 500 AS span, 's' || (user_id % 4) AS ses FROM e WHERE input_tokens + output_tokens + cache_read_tokens > 0),
sf AS (SELECT * FROM sp QUALIFY row_number() OVER (PARTITION BY span, ses, input_tokens, output_tokens ORDER BY event_id) = 1)""",
    select="SELECT ses AS session_id, model, count(*) AS turns, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens FROM sf GROUP BY ALL"))
def _(spark, sf):
    """Telemetry without response ids: copies are told by span, session and both counts."""
    e = events(spark, sf)
    attributes = F.struct(
        F.col("model").alias("gen_ai.request.model"), F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("session.id"), F.col("input_tokens").alias("gen_ai.usage.input_tokens"),
        F.col("output_tokens").alias("gen_ai.usage.output_tokens"), F.col("cache_read_tokens").alias("gen_ai.usage.cache_read.input_tokens"))
    line = F.struct((F.col("event_id") % 500).cast("string").alias("spanId"), F.col("ts_raw").alias("timestamp"), attributes.alias("attributes"))
    usage = json_lines.copilot(table_lines(e, F.lit("otel.jsonl"), F.col("event_id"), F.to_json(line))).usage
    return usage.groupBy("session_id", "model").agg(*[F.sum(c).alias(c) for c in ("turns", "input_tokens", "cache_read_tokens")])


@check("j04_dated_estimates", with_sql(*ESTIMATE_SQL, """
hs AS (SELECT conv_id, strftime(make_timestamp((1704067200000 + conv_id * 3600000 + max(turn) * 60000) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS ts_raw FROM conversations GROUP BY conv_id)""",
    select="SELECT 'c' || conv_id AS session_id, model, ts_raw, substr(ts_raw, 1, 10) AS day, turns FROM est JOIN hs USING (conv_id)"))
def _(spark, sf):
    """Estimated usage with the dates that the history gives its conversation."""
    usage = antigravity.load(conversation_files(spark, sf), history_lines(spark, sf)).usage
    return usage.select("session_id", "model", "ts_raw", "day", "turns")


@check("w11_recorded_context", with_sql(*CLAUDE_SQL, """
lc AS (SELECT file AS session_id, arg_max(input_tokens + cache_read_tokens + cache_write_tokens, event_id) AS t, min(user_id) AS u FROM c GROUP BY 1),
rc AS (SELECT session_id, CASE WHEN u % 2 = 0 THEN t + 1000 ELSE t END AS tokens, CASE WHEN u % 3 = 0 THEN 1000000 ELSE 200000 END AS size FROM lc)""",
    select="SELECT session_id, tokens AS context_tokens, CAST(floor(tokens / size::DOUBLE * 100 + 0.5) AS BIGINT) AS percent FROM rc"))
def _(spark, sf):
    """A recorded figure wins over the log's; a recorded window size over the default one."""
    lines = claude_lines(spark, sf)
    scanned = claude.last_context(lines)
    user = lines.groupBy(F.col("file").alias("session_id")).agg(F.min(F.regexp_extract("file", r"/s(\d+)-", 1).cast("int")).alias("u"))
    recorded = scanned.join(user, "session_id").select(
        "session_id", F.when(F.col("u") % 2 == 0, F.col("context_tokens") + 1000).alias("total_input_tokens"), F.when(F.col("u") % 3 == 0, F.lit(1_000_000)).alias("window_size"))
    return live.context_use(recorded, scanned).select("session_id", "context_tokens", "percent")


@check("j07_real_paths_from_config", with_sql(EVENTS_SQL, SESSIONS_SQL, """
fs AS (SELECT agent_id, string_split(file, '/')[3] AS project_id, file, cwd FROM ses),
fd AS (SELECT agent_id, project_id, arg_min(cwd, file) FILTER (cwd IS NOT NULL) AS first_cwd FROM fs GROUP BY 1, 2),
fp AS (SELECT *, CASE WHEN project_id IN ('dir1', 'dir3', 'dir5') THEN '/real/' || project_id || '/app' ELSE first_cwd END AS real_path FROM fd)""",
    select="SELECT agent_id, project_id, coalesce(real_path, project_id) AS name, coalesce(list_extract(string_split(real_path, '/'), -1), project_id) AS label, real_path FROM fp"))
def _(spark, sf):
    """Folders that the configuration knows get its path, others the first working directory seen."""
    facts = projects.folder_sessions(event_cubes(spark, sf), "/logs")
    known = facts.sessions.select(F.col("project_id").alias("sanitized")).distinct().filter(F.col("sanitized").isin("dir1", "dir3", "dir5"))
    return projects.folder_project_dim(facts.sessions, known.select("sanitized", F.concat(F.lit("/real/"), "sanitized", F.lit("/app")).alias("real_path")))


@check("t02_top_five_tools", with_sql(*TOOLS_SQL, "\ntt AS (SELECT agent_id, tool_name, CAST(sum(calls) AS BIGINT) AS calls FROM tools GROUP BY ALL)",
                                      select="SELECT agent_id, tool_name, calls FROM tt QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY calls DESC, tool_name) <= 5"))
def _(spark, sf):
    return reports.top(reports.tool_totals(event_cubes(spark, sf).tools, ["agent_id"]), "calls", "tool_name", 5, ["agent_id"]).select("agent_id", "tool_name", "calls")


@check("a10_p36_cache_levels", with_sql(EVENTS_SQL, select="""SELECT session_id, CASE WHEN sum(cache_read_tokens) / nullif(sum(cache_read_tokens) + sum(input_tokens), 0) > 0.8 THEN 'good' ELSE 'low' END AS level
  FROM e GROUP BY agent_id, session_id"""))
def _(spark, sf):
    """The level of every session's cache hit rate."""
    sums = reports.usage_by(event_cubes(spark, sf).usage, ["agent_id", "session_id"])
    return sums.select("session_id", bl.cache_level(reports.hit_rate(F.col("cache_read_tokens"), F.col("input_tokens"))).alias("level"))
