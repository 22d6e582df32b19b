"""Checks of prices, cubes, reports, projects, servers, blocks and the live view."""

from __future__ import annotations

import datetime as dt
import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwork.functions import text, times
from meterwork.functions.measures import MEASURES
from meterwork.operators import blocks as bl
from meterwork.operators import prices, servers
from meterwork.operators.dedup import keep_first
from meterwork.operators.usage import Facts, clamp, tool_cube, usage_cube
from meterwork.plans import agents, live, projects, reports
from meterwork.session import staging_root

from .inputs import (
    EVENTS_SQL,
    LINES_SQL,
    NOW_DAY,
    NOW_MS,
    PRICES_SQL,
    RANGE,
    SESSIONS_SQL,
    SUMS_SQL,
    event_cubes,
    event_facts,
    events,
    grouped_sql,
    order_sessions,
    order_usage,
    priced_sql,
    table,
    usd,
    usd_columns,
    usd_sql,
    with_sql,
)

QUERIES, SQL = {}, {}
MS = ", ".join(MEASURES)
DAY_COLS = "input_tokens, cache_read_tokens, cache_write_tokens, output_tokens, turns"
DAY_SUMS = ", ".join(f"CAST(sum({c.strip()}) AS BIGINT) AS {c.strip()}" for c in DAY_COLS.split(","))
NOW = dt.datetime(2024, 1, 30, 12)


def check(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def costs(df):
    return usd_columns(df, *reports.COSTS, "cache_savings_usd")


COST_SELECT = ", ".join(usd_sql(c) for c in [*reports.COSTS, "cache_savings_usd"])

# ---- usage and cost ----------------------------------------------------------


@check("a01_usage_total", with_sql(EVENTS_SQL, select=f"SELECT {SUMS_SQL} FROM e"))
def _(spark, sf):
    return reports.usage_by(events(spark, sf), [])


@check("a02_a06_c02_cost_by_model", with_sql(EVENTS_SQL, PRICES_SQL, grouped_sql("e", ["model"]), priced_sql("g"),
                                          select=f"SELECT model, {MS}, {COST_SELECT} FROM priced"))
def _(spark, sf):
    return costs(reports.cost_by_model(events(spark, sf), []))


@check("a02_cost_by_model_orders", with_sql(LINES_SQL, PRICES_SQL, grouped_sql("l", ["model"]), priced_sql("g"),
                                         select=f"SELECT model, {MS}, {COST_SELECT} FROM priced"))
def _(spark, sf):
    return costs(reports.cost_by_model(order_usage(spark, sf), []))


@check("a03_usage_by_session_and_model", with_sql(EVENTS_SQL, grouped_sql("e", ["agent_id", "session_id", "model"]), select="SELECT * FROM g"))
def _(spark, sf):
    return reports.usage_by(event_cubes(spark, sf).usage, ["agent_id", "session_id", "model"])


@check("a03_session_cube_orders", with_sql(LINES_SQL, grouped_sql("l", ["agent_id", "session_id", "day", "model"]), select="SELECT * FROM g"))
def _(spark, sf):
    return usage_cube(order_usage(spark, sf))


DAILY_SQL = (EVENTS_SQL, PRICES_SQL, grouped_sql("e", ["day", "model"]), priced_sql("g"))


@check("a04_daily", with_sql(*DAILY_SQL, select=f"SELECT day, {usd_sql('sum(cost_usd)', 'cost_usd')}, {DAY_SUMS} FROM priced GROUP BY day"))
def _(spark, sf):
    return usd_columns(reports.daily(event_cubes(spark, sf).usage, []), "cost_usd")


@check("a04_daily_orders", with_sql(LINES_SQL, PRICES_SQL, grouped_sql("l", ["day", "model"]), priced_sql("g"),
                                    select=f"SELECT day, {usd_sql('sum(cost_usd)', 'cost_usd')}, {DAY_SUMS} FROM priced GROUP BY day"))
def _(spark, sf):
    return usd_columns(reports.daily(order_usage(spark, sf), []), "cost_usd")


@check("a05_p19_weekly", with_sql(*DAILY_SQL, select=f"""SELECT strftime(date_trunc('week', CAST(day AS DATE)), '%Y-%m-%d') AS day,
  {usd_sql('sum(cost_usd)', 'cost_usd')}, {DAY_SUMS} FROM priced GROUP BY 1"""))
def _(spark, sf):
    return usd_columns(reports.roll_up(reports.daily(event_cubes(spark, sf).usage, []), [], "week"), "cost_usd")


@check("a05_p20_monthly", with_sql(*DAILY_SQL, select=f"SELECT substr(day, 1, 7) AS day, {usd_sql('sum(cost_usd)', 'cost_usd')}, {DAY_SUMS} FROM priced GROUP BY 1"))
def _(spark, sf):
    return usd_columns(reports.roll_up(reports.daily(event_cubes(spark, sf).usage, []), [], "month"), "cost_usd")


TOOLS_SQL = (
    EVENTS_SQL,
    PRICES_SQL,
    "\ntl AS (SELECT * REPLACE (least(cache_write_1h_tokens, cache_write_tokens) AS cache_write_1h_tokens) FROM e)",
    priced_sql("tl", "tp"),
    "\ntools AS (SELECT agent_id, session_id, tool_name, count(*) AS calls, sum(cost_usd / split) AS cost_usd FROM tp GROUP BY ALL)",
)


@check("a07_tools", with_sql(*TOOLS_SQL, select=f"SELECT tool_name, CAST(sum(calls) AS BIGINT) AS calls, {usd_sql('sum(cost_usd)', 'cost_usd')} FROM tools GROUP BY 1"))
def _(spark, sf):
    return usd_columns(reports.tool_totals(event_cubes(spark, sf).tools, []), "cost_usd")


SESSION_SQL = (
    *TOOLS_SQL,
    SESSIONS_SQL,
    grouped_sql("e", ["agent_id", "session_id", "model"]),
    priced_sql("g"),
    """
sm AS (SELECT agent_id, session_id, sum(cost_usd) AS cost_usd, CAST(sum(turns) AS BIGINT) AS turns,
  string_agg(model, ',' ORDER BY cost_usd DESC, model) AS models FROM priced GROUP BY 1, 2),
tc AS (SELECT agent_id, session_id, CAST(sum(calls) AS BIGINT) AS tool_calls FROM tools GROUP BY 1, 2),
summary AS (SELECT s.agent_id, s.session_id, s.file, s.first_ts AS start, s.last_ts AS "end", sm.cost_usd, turns, tool_calls, models
  FROM ses s JOIN sm USING (agent_id, session_id) JOIN tc USING (agent_id, session_id))""",
)


@check("a08_session_summary", with_sql(*SESSION_SQL, select=f"SELECT * REPLACE (round(cost_usd + 1e-9, 6) AS cost_usd) FROM summary"))
def _(spark, sf):
    s = reports.session_summary(event_cubes(spark, sf))
    return usd_columns(s.withColumn("models", F.concat_ws(",", "models")), "cost_usd")


def totals_sql(scope, source="e", ses="ses", name="tot"):
    cols = "".join(f"{k}, " for k in scope)
    group = f" GROUP BY {', '.join(scope)}" if scope else ""
    using = f"JOIN {name}_m USING ({', '.join(scope)})" if scope else f", {name}_m"
    return (
        grouped_sql(source, [*scope, "model"], f"{name}_g"),
        priced_sql(f"{name}_g", f"{name}_p"),
        f"""
{name}_m AS (SELECT {cols}sum(cost_usd) AS total_cost_usd, CAST(sum(turns) AS BIGINT) AS total_turns, sum(cache_savings_usd) AS cache_savings_usd,
  sum(cache_read_tokens) / (sum(cache_read_tokens) + sum(input_tokens)) AS cache_hit_rate FROM {name}_p{group}),
{name}_s AS (SELECT {cols}count(*) AS session_count, min(epoch_ms(CAST(replace(first_ts, 'Z', '') AS TIMESTAMP))) AS start_ms,
  max(epoch_ms(CAST(replace(last_ts, 'Z', '') AS TIMESTAMP))) AS end_ms FROM {ses}{group}),
{name}_d AS (SELECT *, strftime(make_timestamp(start_ms * 1000), '%Y-%m-%d') AS span_start, strftime(make_timestamp(end_ms * 1000), '%Y-%m-%d') AS span_end,
  CAST(greatest(1, floor((end_ms - start_ms) / 86400000.0 + 0.5)) AS BIGINT) AS span_days FROM {name}_s),
{name} AS (SELECT {cols}session_count, start_ms, end_ms, span_start, span_end, span_days, round(total_cost_usd + 1e-9, 6) AS total_cost_usd,
  total_turns, round(cache_savings_usd + 1e-9, 6) AS cache_savings_usd, round(cache_hit_rate + 1e-9, 6) AS cache_hit_rate,
  round(total_cost_usd / span_days * 30 + 1e-9, 6) AS monthly_projection_usd FROM {name}_d {using})""",
    )


def tidy_totals(df):
    return usd_columns(df, "total_cost_usd", "cache_savings_usd", "cache_hit_rate", "monthly_projection_usd")


@check("a09_a10_c03_totals", with_sql(EVENTS_SQL, PRICES_SQL, SESSIONS_SQL, *totals_sql([]), select="SELECT * FROM tot"))
def _(spark, sf):
    c = event_cubes(spark, sf)
    return tidy_totals(reports.totals(c.usage, c.sessions, []))


@check("a09_totals_by_agent", with_sql(EVENTS_SQL, PRICES_SQL, SESSIONS_SQL, *totals_sql(["agent_id"]), select="SELECT * FROM tot"))
def _(spark, sf):
    c = event_cubes(spark, sf)
    return tidy_totals(reports.totals(c.usage, c.sessions, ["agent_id"]))


# ---- ranges ----------------------------------------------------------------

R0, R1 = RANGE
CLAMP_SQL = (
    EVENTS_SQL,
    PRICES_SQL,
    SESSIONS_SQL,
    f"""
er AS (SELECT * FROM e WHERE day BETWEEN '{R0}' AND '{R1}'),
sr AS (SELECT * REPLACE (greatest(first_ts, '{R0}T00:00:00Z') AS first_ts, least(last_ts, '{R1}T23:59:59.999Z') AS last_ts)
  FROM ses WHERE session_id IN (SELECT session_id FROM er))""",
)


@check("a12_p27_models_in_range", with_sql(*CLAMP_SQL, grouped_sql("er", ["model"]), priced_sql("g"), select=f"SELECT model, {MS}, {COST_SELECT} FROM priced"))
def _(spark, sf):
    return costs(reports.cost_by_model(clamp(event_cubes(spark, sf), RANGE).usage, []))


@check("a12_j09_sessions_in_range", with_sql(*CLAMP_SQL, select="SELECT agent_id, session_id, cwd, first_ts, last_ts FROM sr"))
def _(spark, sf):
    return clamp(event_cubes(spark, sf), RANGE).sessions.drop("file")


@check("a13_report_in_range", with_sql(*CLAMP_SQL, *totals_sql(["agent_id"], "er", "sr"), select="SELECT * FROM tot"))
def _(spark, sf):
    return tidy_totals(reports.build_report(event_cubes(spark, sf), ["agent_id"], bounds=RANGE)["totals"])


@check("p27_p28_last_week_usage", with_sql(EVENTS_SQL, select=f"SELECT day, {SUMS_SQL} FROM e WHERE day BETWEEN '2024-01-24' AND '2024-01-30' GROUP BY day"))
def _(spark, sf):
    bounds = times.timeframe_range("7d", NOW)
    return reports.usage_by(event_cubes(spark, sf).usage.filter(times.in_range(F.col("day"), bounds)), ["day"])


@check("s26_report_document", with_sql(EVENTS_SQL, PRICES_SQL, SESSIONS_SQL, *totals_sql(["agent_id"]),
    grouped_sql("e", ["agent_id", "model"], "mg"), priced_sql("mg", "mp"), grouped_sql("e", ["agent_id", "day", "model"], "dg"), priced_sql("dg", "dp"), *TOOLS_SQL[2:], select=f"""
SELECT agent_id, 'totals' AS part, '' AS item, total_cost_usd AS cost_usd, total_turns AS n FROM tot
UNION ALL SELECT agent_id, 'models', model, {usd_sql('cost_usd')}, CAST(turns AS BIGINT) FROM mp
UNION ALL SELECT agent_id, 'daily', day, {usd_sql('sum(cost_usd)', 'cost_usd')}, CAST(sum(turns) AS BIGINT) FROM dp GROUP BY agent_id, day
UNION ALL SELECT agent_id, 'tools', tool_name, {usd_sql('sum(cost_usd)', 'cost_usd')}, CAST(sum(calls) AS BIGINT) FROM tools GROUP BY agent_id, tool_name"""))
def _(spark, sf):
    """The document is written by the JSON sink, read back and unnested."""
    marts = reports.build_report(event_cubes(spark, sf), ["agent_id"])
    path = f"{staging_root(spark)}/report-{uuid.uuid4().hex}"
    reports.write_json(reports.report_document(marts, ["agent_id"]), path)
    doc = spark.read.json(path)
    parts = [doc.select("agent_id", F.lit("totals").alias("part"), F.lit("").alias("item"), F.col("total_cost_usd").alias("cost_usd"), F.col("total_turns").alias("n"))]
    for part, item, n in (("models", "model", "turns"), ("daily", "day", "turns"), ("tools", "tool_name", "calls")):
        rows = doc.select("agent_id", F.explode(part).alias("r"))
        parts.append(rows.select("agent_id", F.lit(part).alias("part"), F.col(f"r.{item}").alias("item"), F.col("r.cost_usd").alias("cost_usd"), F.col(f"r.{n}").alias("n")))
    return usd_columns(functools.reduce(DataFrame.union, parts), "cost_usd")


# ---- servers ----------------------------------------------------------------

TOOL_LINES_SQL = """
st AS (SELECT 'mcp__grp' || (l_suppkey % 10) || '__sup' || l_suppkey || '__op' || l_linenumber AS tool_name, count(*) AS calls,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS cost_usd FROM lineitem GROUP BY 1),
conf AS (SELECT DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN 'grp' || (s_suppkey % 10) WHEN s_suppkey % 4 = 3 THEN 'lone' || s_suppkey ELSE 'grp' || (s_suppkey % 10) || '__sup' || s_suppkey END AS name,
  'nation ' || (s_suppkey % 2) AS source FROM supplier),
obs AS (SELECT DISTINCT regexp_extract(tool_name, '^mcp__(.+)__[^_]', 1) AS name FROM st),
extra AS (SELECT o.name FROM obs o WHERE NOT EXISTS (SELECT 1 FROM conf c WHERE o.name = c.name OR starts_with(o.name, c.name || '__'))),
names AS (SELECT name, source, TRUE AS configured FROM conf UNION ALL
  SELECT name, 'observed in transcripts (plugin or external config)', FALSE FROM extra),
audit AS (SELECT n.name, n.source, CAST(coalesce(sum(t.calls), 0) AS BIGINT) AS calls, coalesce(sum(t.calls), 0) = 0 AND n.configured AS unused,
  coalesce(sum(t.cost_usd), 0) AS cost_usd, n.configured FROM names n LEFT JOIN st t ON starts_with(t.tool_name, 'mcp__' || n.name || '__')
  GROUP BY n.name, n.source, n.configured)"""


def supplier_tools(spark, sf):
    s = F.col("l_suppkey")
    name = F.concat(F.lit("mcp__grp"), (s % 10).cast("string"), F.lit("__sup"), s.cast("string"), F.lit("__op"), F.col("l_linenumber").cast("string"))
    return table(spark, sf, "lineitem").groupBy(name.alias("tool_name")).agg(
        F.count("*").alias("calls"), F.sum(F.col("l_quantity").cast("bigint")).cast("double").alias("cost_usd"))


def supplier_servers(spark, sf):
    s = F.col("s_suppkey")
    group = F.concat(F.lit("grp"), (s % 10).cast("string"))
    name = (
        F.when(s % 2 == 0, group)
        .when(s % 4 == 3, F.concat(F.lit("lone"), s.cast("string")))
        .otherwise(F.concat(group, F.lit("__sup"), s.cast("string")))
    )
    return table(spark, sf, "supplier").select(name.alias("name"), F.concat(F.lit("nation "), (s % 2).cast("string")).alias("source")).distinct()


@check("j05_tool_to_server", with_sql(TOOL_LINES_SQL, select="SELECT name, calls, cost_usd FROM audit WHERE calls > 0"))
def _(spark, sf):
    audit = servers.server_audit(supplier_tools(spark, sf), supplier_servers(spark, sf), [])
    return audit.filter("calls > 0").select("name", "calls", "cost_usd")


@check("j06_p25_observed_only_servers", with_sql(TOOL_LINES_SQL, select="SELECT name FROM extra"))
def _(spark, sf):
    return servers.observed_only(supplier_tools(spark, sf), supplier_servers(spark, sf), [])


@check("a11_u02_server_audit", with_sql(TOOL_LINES_SQL, select="SELECT * FROM audit"))
def _(spark, sf):
    return servers.server_audit(supplier_tools(spark, sf), supplier_servers(spark, sf), [])


@check("a20_server_total", with_sql(TOOL_LINES_SQL, select="SELECT count(*) AS servers, count(*) FILTER (unused) AS unused, CAST(sum(calls) AS BIGINT) AS calls FROM audit"))
def _(spark, sf):
    return reports.server_total(servers.server_audit(supplier_tools(spark, sf), supplier_servers(spark, sf), []))


@check("t05_p26_servers_by_cost", with_sql(TOOL_LINES_SQL, select="SELECT name, calls, cost_usd, row_number() OVER (ORDER BY cost_usd DESC, name) AS rank FROM audit"))
def _(spark, sf):
    audit = servers.server_audit(supplier_tools(spark, sf), supplier_servers(spark, sf), [])
    shown = audit.withColumn("name", text.display_server(F.col("name"), F.col("configured")))
    return reports.by_cost(shown.select("name", "calls", "cost_usd"), "cost_usd", "name")


# Server configuration files rendered from suppliers: three homes, one project per nation, the supplier names its servers.
# Each home lists every project a second time under a path that reads alike once sanitized; the last one listed counts.
def server_configs(spark, sf):
    s = table(spark, sf, "supplier").select(
        F.concat(F.lit("/h"), (F.col("s_nationkey") % 3).cast("string")).alias("home"),
        F.concat(F.lit("/work/n"), F.col("s_nationkey").cast("string")).alias("project_path"), "s_suppkey")
    def names(key, only):
        return F.map_from_entries(F.array_sort(F.collect_list(F.when(only, F.struct(key, F.struct(F.lit("run").alias("command")))))))
    key = F.concat(F.lit("srv"), (F.col("s_suppkey") % 12).cast("string"))
    ranked = s.select("home", "project_path", key.alias("name"), (F.col("s_suppkey") % 3).alias("kind")).distinct()
    body = lambda kind: F.to_json(F.struct(names(F.col("name"), F.col("kind") == kind).alias("mcpServers")))
    files = ranked.groupBy("home", "project_path").agg(body(0).alias("value"), body(1).alias("entry"))
    own = files.select("home", "project_path", F.concat("project_path", F.lit("/.mcp.json")).alias("file"), "value")
    shared = ranked.filter("kind = 2").select("home", "name").distinct().groupBy("home").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), "name", F.lit('":{}')))), ",").alias("shared"))
    twin = files.select("home", F.replace("project_path", F.lit("/work/"), F.lit("/work-")).alias("project_path"), F.lit("{}").alias("entry"))
    listed = F.concat(F.lit('"'), "project_path", F.lit('":'), "entry")
    entries = files.select("home", "project_path", "entry").union(twin).groupBy("home").agg(
        F.array_join(F.sort_array(F.collect_list(listed), asc=False), ",").alias("projects"))
    top = entries.join(shared, "home", "left").select(
        "home", F.concat("home", F.lit("/.claude.json")).alias("file"),
        F.concat(F.lit('{"mcpServers":{'), F.coalesce("shared", F.lit("")), F.lit('},"projects":{'), "projects", F.lit("}}")).alias("value"))
    return own, top, files.select("home", "project_path")


CONFIG_SQL = """
r AS (SELECT DISTINCT '/h' || (s_nationkey % 3) AS home, '/work/n' || s_nationkey AS project_path, 'srv' || (s_suppkey % 12) AS name, s_suppkey % 3 AS kind FROM supplier),
pr AS (SELECT DISTINCT home, project_path FROM r),
al AS (
  SELECT home, project_path, name, project_path || '/.mcp.json' AS source, 0 AS rank FROM r WHERE kind = 0
  UNION ALL SELECT home, project_path, name, home || '/.claude.json', 1 FROM pr JOIN (SELECT DISTINCT home, name FROM r WHERE kind = 2) USING (home)
  UNION ALL SELECT home, project_path, name, home || '/.claude.json (project entry)', 2 FROM r WHERE kind = 1),
cfg AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY home, project_path, name ORDER BY rank) = 1)"""


@check("s20_d07_configured_servers", with_sql(CONFIG_SQL, select="SELECT home, project_path, name, source FROM cfg"))
def _(spark, sf):
    own, top, paths = server_configs(spark, sf)
    return servers.configured_servers(own, top, paths).select("home", "project_path", "name", "source")


@check("s21_p21_project_path_map", with_sql(CONFIG_SQL, select="SELECT home, regexp_replace(project_path, '[^a-zA-Z0-9]', '-', 'g') AS sanitized, replace(project_path, '/work/', '/work-') AS real_path FROM pr"))
def _(spark, sf):
    _own, top, _paths = server_configs(spark, sf)
    return servers.config_project_paths(top)


# ---- projects ----------------------------------------------------------------

PROJECT_SQL = (
    EVENTS_SQL,
    PRICES_SQL,
    SESSIONS_SQL,
    """
pe AS (SELECT *, agent_id || ':' || coalesce(cwd, '(unknown project)') AS project_id FROM e),
ps AS (SELECT *, agent_id || ':' || coalesce(cwd, '(unknown project)') AS project_id FROM ses),
dim AS (SELECT DISTINCT agent_id, project_id, coalesce(cwd, '(unknown project)') AS name,
  CASE WHEN cwd IS NULL THEN '(unknown project)' ELSE list_extract(string_split(cwd, '/'), -1) END AS label, cwd AS real_path FROM ps)""",
)


def event_projects(spark, sf):
    facts = projects.cwd_sessions(event_cubes(spark, sf))
    return facts, projects.cwd_project_dim(facts.sessions)


@check("a14_p22_p37_projects_by_directory", with_sql(*PROJECT_SQL, *totals_sql(["agent_id", "project_id"], "pe", "ps"),
                                             select="SELECT * FROM dim JOIN tot USING (agent_id, project_id)"))
def _(spark, sf):
    facts, dim = event_projects(spark, sf)
    return tidy_totals(projects.project_list(facts, dim))


@check("a14_projects_orders", with_sql(LINES_SQL, PRICES_SQL, """
os AS (SELECT 'orders' AS agent_id, CAST(o_orderkey AS VARCHAR) AS session_id, '/cust/' || o_custkey AS cwd FROM orders),
lp AS (SELECT l.*, 'orders:' || cwd AS project_id FROM l JOIN os USING (agent_id, session_id))""",
    grouped_sql("lp", ["project_id", "model"]), priced_sql("g"),
    select=f"SELECT project_id, {usd_sql('sum(cost_usd)', 'cost_usd')}, CAST(sum(turns) AS BIGINT) AS turns FROM priced GROUP BY project_id"))
def _(spark, sf):
    usage = usage_cube(order_usage(spark, sf))
    none = usage.filter(F.lit(False)).select("agent_id", "session_id", F.lit("").alias("tool_name"), F.lit(0).alias("calls"), F.lit(0.0).alias("cost_usd"))
    facts = projects.cwd_sessions(Facts(usage, none, order_sessions(spark, sf)))
    by_model = reports.cost_by_model(facts.usage, ["project_id"])
    return usd_columns(by_model.groupBy("project_id").agg(F.sum("cost_usd").alias("cost_usd"), F.sum("turns").alias("turns")), "cost_usd")


@check("a15_j07_projects_by_folder", with_sql(EVENTS_SQL, PRICES_SQL, SESSIONS_SQL, """
fs AS (SELECT *, string_split(file, '/')[3] AS project_id FROM ses),
fd AS (SELECT agent_id, project_id, arg_min(cwd, file) FILTER (cwd IS NOT NULL) AS real_path FROM fs GROUP BY 1, 2),
fe AS (SELECT e.*, fs.project_id FROM e JOIN fs USING (agent_id, session_id))""",
    *totals_sql(["agent_id", "project_id"], "fe", "fs"),
    select="""SELECT tot.*, coalesce(real_path, project_id) AS name, coalesce(list_extract(string_split(real_path, '/'), -1), project_id) AS label, real_path
  FROM fd JOIN tot USING (agent_id, project_id)"""))
def _(spark, sf):
    facts = projects.folder_sessions(event_cubes(spark, sf), "/logs")
    nobody = facts.sessions.filter(F.lit(False)).select(F.col("project_id").alias("sanitized"), F.col("cwd").alias("real_path"))
    dim = projects.folder_project_dim(facts.sessions, nobody)
    return tidy_totals(projects.project_list(facts, dim))


@check("a16_projects_in_range", with_sql(*PROJECT_SQL, f"""
per AS (SELECT * FROM pe WHERE day BETWEEN '{R0}' AND '{R1}'),
psr AS (SELECT * REPLACE (greatest(first_ts, '{R0}T00:00:00Z') AS first_ts, least(last_ts, '{R1}T23:59:59.999Z') AS last_ts)
  FROM ps WHERE session_id IN (SELECT session_id FROM per))""", *totals_sql(["agent_id", "project_id"], "per", "psr"),
    select="SELECT * FROM dim JOIN tot USING (agent_id, project_id)"))
def _(spark, sf):
    facts, dim = event_projects(spark, sf)
    return tidy_totals(projects.project_list(facts, dim, RANGE))


@check("a17_merged_daily", with_sql(*PROJECT_SQL, grouped_sql("pe", ["project_id", "day", "model"]), priced_sql("g"),
                                    select=f"SELECT day, {usd_sql('sum(cost_usd)', 'cost_usd')}, {DAY_SUMS} FROM priced GROUP BY day"))
def _(spark, sf):
    facts, _dim = event_projects(spark, sf)
    scope = ["agent_id", "project_id"]
    return usd_columns(projects.merged_daily(reports.daily(facts.usage, scope), []), "cost_usd")


PROJECT_SERVERS_SQL = """
psv AS (SELECT DISTINCT agent_id, project_id, CASE WHEN agent_id = 'a0' THEN 'ctx' ELSE 'idle' END AS name, real_path AS source FROM dim WHERE real_path IS NOT NULL),
pt AS (SELECT agent_id, project_id, tool_name, count(*) AS calls FROM pe GROUP BY ALL),
pobs AS (SELECT DISTINCT agent_id, project_id, regexp_extract(tool_name, '^mcp__(.+)__[^_]', 1) AS name FROM pt WHERE starts_with(tool_name, 'mcp__')),
pnames AS (SELECT agent_id, project_id, name, source, TRUE AS configured FROM psv UNION ALL
  SELECT agent_id, project_id, name, 'observed in transcripts (plugin or external config)', FALSE FROM pobs o
  WHERE NOT EXISTS (SELECT 1 FROM psv c WHERE c.agent_id = o.agent_id AND c.project_id = o.project_id AND (o.name = c.name OR starts_with(o.name, c.name || '__')))),
paud AS (SELECT n.agent_id, n.project_id, n.name, n.source, n.configured, CAST(coalesce(sum(t.calls), 0) AS BIGINT) AS calls
  FROM pnames n LEFT JOIN pt t ON t.agent_id = n.agent_id AND t.project_id = n.project_id AND starts_with(t.tool_name, 'mcp__' || n.name || '__') GROUP BY ALL)"""


@check("a17_j10_merged_servers", with_sql(*PROJECT_SQL, *totals_sql(["agent_id", "project_id"], "pe", "ps"), PROJECT_SERVERS_SQL, select="""
SELECT name, arg_min(source, (-total_cost_usd, project_id)) AS source, CAST(sum(calls) AS BIGINT) AS calls, sum(calls) = 0 AS unused, bool_or(configured) AS configured
FROM paud JOIN tot USING (agent_id, project_id) GROUP BY name"""))
def _(spark, sf):
    facts, dim = event_projects(spark, sf)
    configured = dim.filter("real_path IS NOT NULL").select(
        F.col("real_path").alias("project_path"), "agent_id", F.when(F.col("agent_id") == "a0", "ctx").otherwise("idle").alias("name"))
    lists = dim.join(configured.select(F.col("project_path").alias("real_path"), "agent_id", F.col("name").alias("server")), ["agent_id", "real_path"])
    srv = lists.select("agent_id", "project_id", F.col("server").alias("name"), F.col("real_path").alias("source"))
    scope = ["agent_id", "project_id"]
    audit = servers.server_audit(reports.tool_totals(facts.tools, scope), srv, scope)
    cost = usd_columns(reports.totals(facts.usage, facts.sessions, scope), "total_cost_usd")
    return projects.merged_servers(audit, [], cost).drop("cost_usd")


@check("j10_servers_of_projects", with_sql(CONFIG_SQL, select="SELECT 'a' AS agent_id, 'a:' || project_path AS project_id, name, source FROM cfg"))
def _(spark, sf):
    own, top, paths = server_configs(spark, sf)
    dim = paths.select(F.lit("a").alias("agent_id"), F.concat(F.lit("a:"), "project_path").alias("project_id"), F.col("project_path").alias("real_path"))
    return projects.project_servers(dim, servers.configured_servers(own, top, paths))


@check("p31_display_labels", with_sql(*PROJECT_SQL, select="""
SELECT project_id, CASE WHEN count(*) OVER (PARTITION BY label) > 1 AND len(list_filter(string_split(name, '/'), lambda x: x <> '')) > 1
  THEN label || ' (' || list_extract(list_filter(string_split(name, '/'), lambda x: x <> ''), -2) || ')' ELSE label END AS display_label FROM dim"""))
def _(spark, sf):
    _facts, dim = event_projects(spark, sf)
    return projects.display_labels(dim).select("project_id", "display_label")


@check("p32_project_filter", with_sql(*PROJECT_SQL, select="SELECT project_id FROM dim WHERE contains(lower(label), 'team3') OR contains(lower(name), 'team3')"))
def _(spark, sf):
    _facts, dim = event_projects(spark, sf)
    return projects.matching(dim, "TEAM3").select("project_id")


@check("t06_projects_by_cost", with_sql(*PROJECT_SQL, *totals_sql(["agent_id", "project_id"], "pe", "ps"),
                                        select="SELECT project_id, total_cost_usd, row_number() OVER (ORDER BY total_cost_usd DESC, project_id) AS rank FROM tot"))
def _(spark, sf):
    facts, dim = event_projects(spark, sf)
    return projects.ordered(tidy_totals(projects.project_list(facts, dim)), "cost").select("project_id", "total_cost_usd", "rank")


@check("t06_projects_by_recency", with_sql(*PROJECT_SQL, *totals_sql(["agent_id", "project_id"], "pe", "ps"),
                                           select="SELECT project_id, span_end, row_number() OVER (ORDER BY span_end DESC, project_id) AS rank FROM tot"))
def _(spark, sf):
    facts, dim = event_projects(spark, sf)
    return projects.ordered(projects.project_list(facts, dim), "recent").select("project_id", "span_end", "rank")


@check("t06_projects_by_name", with_sql(*PROJECT_SQL, select="SELECT project_id, label, row_number() OVER (ORDER BY label, project_id) AS rank FROM dim"))
def _(spark, sf):
    facts, dim = event_projects(spark, sf)
    return projects.ordered(projects.project_list(facts, dim), "name").select("project_id", "label", "rank")


# ---- agents ----------------------------------------------------------------


@check("a18_u01_all_agents", with_sql(EVENTS_SQL, PRICES_SQL, SESSIONS_SQL, *totals_sql(["agent_id"]), *totals_sql([], name="al"),
                                  select="SELECT * FROM tot UNION ALL SELECT '__all_agents__', * FROM al"))
def _(spark, sf):
    c = event_cubes(spark, sf)
    return tidy_totals(agents.agent_totals(c.usage, c.sessions))


REGISTRY_IDS = ["claude", "codex", "opencode", "gemini", "qwen", "droid", "codebuff", "openclaw", "kimi", "kilo", "goose", "hermes", "copilot", "amp", "pi", "antigravity", "cursor"]
REGISTRY_SQL = "reg(pos, agent_id) AS (VALUES " + ", ".join(f"({i}, '{a}')" for i, a in enumerate(REGISTRY_IDS)) + ")"
STATUS_SQL = f"""
ag AS (SELECT reg.agent_id, e.* EXCLUDE (agent_id) FROM e JOIN reg ON reg.pos = e.user_id % 17 WHERE event_id % 5 <> 0 AND reg.agent_id <> 'cursor'),
seen AS (SELECT DISTINCT reg.agent_id FROM e JOIN reg ON reg.pos = e.user_id % 17)"""


@check("a19_s19_x02_agent_status", with_sql(EVENTS_SQL, PRICES_SQL, REGISTRY_SQL, STATUS_SQL, grouped_sql("ag", ["agent_id", "cwd", "model"]), priced_sql("g"), f"""
pc AS (SELECT agent_id, count(DISTINCT coalesce(cwd, '-')) AS projects, sum(cost_usd) AS cost_usd FROM priced GROUP BY 1),
sc AS (SELECT agent_id, count(DISTINCT session_id) AS sessions FROM ag GROUP BY 1)""", select="""
SELECT r.agent_id, coalesce(projects, 0) AS projects, coalesce(sessions, 0) AS sessions, round(coalesce(cost_usd, 0) + 1e-9, 6) AS cost_usd,
  CASE WHEN projects > 0 AND r.agent_id = 'antigravity' THEN 'estimated' WHEN projects > 0 THEN 'data'
       WHEN s.agent_id IS NOT NULL AND r.agent_id = 'cursor' THEN 'unsupported' WHEN s.agent_id IS NOT NULL THEN 'no usage data' ELSE 'not detected' END AS status
FROM reg r LEFT JOIN pc USING (agent_id) LEFT JOIN sc USING (agent_id) LEFT JOIN seen s USING (agent_id)"""))
def _(spark, sf):
    dim = agents.agent_dim(spark)
    place = F.col("user_id") % 17
    e = events(spark, sf).drop("agent_id").withColumn("position", place.cast("int")).join(F.broadcast(dim.select("position", "agent_id", "supported")), "position")
    usage = e.filter((F.col("event_id") % 5 != 0) & F.col("supported")).withColumn("project_id", F.coalesce("cwd", F.lit("-")))
    money = reports.cost_by_model(usage, ["agent_id", "project_id"]).groupBy("agent_id", "project_id").agg(F.sum("cost_usd").alias("total_cost_usd"))
    count = usage.groupBy("agent_id", "project_id").agg(F.countDistinct("session_id").alias("session_count"))
    status = agents.agent_status(dim, money.join(count, ["agent_id", "project_id"]), e.select("agent_id"))
    return usd_columns(status, "cost_usd").drop("name", "reason")


# ---- totals rows, top lists, shares -------------------------------------------

MODEL_SQL = (EVENTS_SQL, PRICES_SQL, grouped_sql("e", ["model"]), priced_sql("g"))


@check("a20_models_with_total", with_sql(*MODEL_SQL, select=f"""SELECT model, input_tokens, output_tokens, {usd_sql('cost_usd')} FROM priced
UNION ALL SELECT 'TOTAL', CAST(sum(input_tokens) AS BIGINT), CAST(sum(output_tokens) AS BIGINT), round(sum(cost_usd) + 1e-9, 6) FROM priced HAVING count(*) > 1"""))
def _(spark, sf):
    m = reports.cost_by_model(event_cubes(spark, sf).usage, [])
    return usd_columns(reports.with_total_row(m, "model", ["input_tokens", "output_tokens", "cost_usd"]), "cost_usd")


@check("t01_top_tools_by_calls", with_sql(TOOL_LINES_SQL, select="SELECT tool_name, calls FROM st ORDER BY calls DESC, tool_name LIMIT 10"))
def _(spark, sf):
    return reports.top(supplier_tools(spark, sf), "calls", "tool_name", 10).select("tool_name", "calls")


@check("t02_top_models", with_sql(*MODEL_SQL, select=f"SELECT model, {usd_sql('cost_usd')} FROM priced ORDER BY priced.cost_usd DESC, model LIMIT 4"))
def _(spark, sf):
    return usd_columns(reports.top(reports.cost_by_model(event_cubes(spark, sf).usage, []), "cost_usd", "model", 4).select("model", "cost_usd"), "cost_usd")


@check("t03_top_tools_by_cost", with_sql(TOOL_LINES_SQL, select="SELECT tool_name, calls, cost_usd FROM st ORDER BY cost_usd DESC, tool_name LIMIT 15"))
def _(spark, sf):
    return reports.top_tools(supplier_tools(spark, sf))


@check("t04_p29_p30_top_sessions", with_sql(*SESSION_SQL, select=f"""
SELECT agent_id, session_id, turns, tool_calls, {usd_sql('cost_usd')},
  CAST(floor((epoch_ms(CAST(replace("end", 'Z', '') AS TIMESTAMP)) - epoch_ms(CAST(replace(start, 'Z', '') AS TIMESTAMP))) / 60000.0 + 0.5) AS BIGINT) AS minutes,
  CASE WHEN d <= 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d < 30 THEN d || 'd ago' ELSE substr(start, 1, 10) END AS age,
  regexp_replace(regexp_replace(string_split(models, ',')[1], '^claude-', ''), '-[0-9]{{8}}$', '') AS model
FROM (SELECT *, CAST(floor(({NOW_MS} - epoch_ms(CAST(substr(start, 1, 10) AS TIMESTAMP))) / 86400000.0) AS BIGINT) AS d FROM summary)
ORDER BY summary_cost DESC, session_id LIMIT 12""".replace("SELECT *, CAST(floor((", "SELECT *, cost_usd AS summary_cost, CAST(floor((")))
def _(spark, sf):
    return usd_columns(reports.session_list(reports.session_summary(event_cubes(spark, sf)), NOW_MS), "cost_usd")


@check("t04_sessions_left_out", with_sql(EVENTS_SQL, select="SELECT greatest(0, count(DISTINCT (agent_id, session_id)) - 12) AS left_out FROM e"))
def _(spark, sf):
    return reports.rest_after(event_cubes(spark, sf).sessions, 12)


@check("a25_model_shares", with_sql(*MODEL_SQL, select=f"SELECT model, {usd_sql('cost_usd')}, round(cost_usd / sum(cost_usd) OVER () + 1e-9, 6) AS share FROM priced"))
def _(spark, sf):
    return usd_columns(reports.model_shares(reports.cost_by_model(event_cubes(spark, sf).usage, []), []), "cost_usd", "share")


@check("a25_cost_split", with_sql(*MODEL_SQL, select="SELECT " + ", ".join(usd_sql(f"sum({c})", c) for c in reports.COSTS) + " FROM priced"))
def _(spark, sf):
    return usd_columns(reports.cost_split(reports.cost_by_model(event_cubes(spark, sf).usage, []), []), *reports.COSTS)


@check("a25_a26_cost_per_active_day", with_sql(*MODEL_SQL, select="SELECT (SELECT count(DISTINCT day) FROM e) AS active_days, round(sum(cost_usd) / (SELECT count(DISTINCT day) FROM e) + 1e-9, 6) AS usd_per_active_day FROM priced"))
def _(spark, sf):
    c = event_cubes(spark, sf)
    avg = reports.average_per_active_day(reports.daily(c.usage, []), reports.totals(c.usage, c.sessions, []), [])
    return usd_columns(avg, "usd_per_active_day")


@check("a26_p33_tool_shares", with_sql(EVENTS_SQL, select="""SELECT agent_id, count(*) AS calls, count(*) FILTER (starts_with(tool_name, 'mcp__')) AS mcp_calls,
  round(count(*) FILTER (starts_with(tool_name, 'mcp__')) / count(*) + 1e-9, 6) AS mcp_share, count(DISTINCT tool_name) AS tools FROM e GROUP BY agent_id"""))
def _(spark, sf):
    return usd_columns(reports.mcp_share(event_cubes(spark, sf).tools, ["agent_id"]), "mcp_share")


CAL_SQL = (*DAILY_SQL, """
dd AS (SELECT day, sum(cost_usd) AS cost_usd, CAST(sum(turns) AS BIGINT) AS turns FROM priced GROUP BY day),
cal AS (SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(cost_usd, 0) AS cost_usd, coalesce(turns, 0) AS turns
  FROM (SELECT unnest(generate_series((SELECT max(CAST(day AS DATE)) FROM e) - INTERVAL 40 DAY, (SELECT max(CAST(day AS DATE)) FROM e), INTERVAL 1 DAY)) AS d)
  LEFT JOIN dd ON dd.day = strftime(d, '%Y-%m-%d'))""")


def calendar(spark, sf, n):
    c = event_cubes(spark, sf)
    return reports.last_days(reports.daily(c.usage, []), reports.span(c.sessions, []), [], n)


@check("w12_last_days", with_sql(*CAL_SQL, select=f"SELECT day, {usd_sql('cost_usd')}, turns FROM cal"))
def _(spark, sf):
    return usd_columns(calendar(spark, sf, 41), "cost_usd")


@check("w13_peak_day", with_sql(*CAL_SQL, select=f"SELECT day, {usd_sql('cost_usd')} FROM cal ORDER BY cal.cost_usd DESC, day LIMIT 1"))
def _(spark, sf):
    return usd_columns(reports.peak_day(calendar(spark, sf, 41), []), "cost_usd")


@check("w13_trailing_activity", with_sql(*CAL_SQL, """
t21 AS (SELECT *, row_number() OVER (ORDER BY day DESC) AS n FROM cal),
kept AS (SELECT *, row_number() OVER (ORDER BY day DESC) AS m FROM t21 WHERE n <= 21 AND (cost_usd > 0 OR n <= 14))""", select=f"SELECT day, {usd_sql('cost_usd')}, turns FROM kept WHERE m <= 16"))
def _(spark, sf):
    return usd_columns(reports.trailing_activity(calendar(spark, sf, 21), []), "cost_usd")


@check("w13_last_active_days", with_sql(*CAL_SQL, select=f"SELECT day, {usd_sql('cost_usd')} FROM dd ORDER BY day DESC LIMIT 10"))
def _(spark, sf):
    days = reports.daily(event_cubes(spark, sf).usage, [])
    return usd_columns(reports.last_active(days, [], 10).select("day", "cost_usd"), "cost_usd")


# ---- prices ------------------------------------------------------------------

CATALOG_SQL = """
cat AS (SELECT p_partkey AS pos, CASE WHEN p_partkey % 3 = 0 THEN 'prov' || (p_partkey % 7) || '/' ELSE '' END
    || CASE WHEN p_size % 2 = 0 THEN 'claude-' ELSE 'm-' END || replace(p_name, ' ', '-') || '-' || (p_size % 20) AS key,
    CAST(floor(p_retailprice) AS BIGINT) AS c, p_size FROM part),
ent AS (SELECT pos, regexp_replace(key, '^.*/', '') AS name, contains(key, '/') AS prefixed, CASE WHEN p_size % 5 <> 0 THEN c ELSE 0 END AS i,
  c * 4 AS o, CASE WHEN p_size % 3 = 0 THEN c END AS r, CASE WHEN p_size % 4 = 0 THEN c * 2 END AS w FROM cat),
live AS (SELECT * FROM ent WHERE i > 0 QUALIFY row_number() OVER (PARTITION BY name ORDER BY prefixed, pos) = 1),
lp AS (SELECT name AS key, i * 1e6 AS input_per_mtok, o * 1e6 AS output_per_mtok, r / i AS cache_read_mult,
  CASE WHEN w IS NOT NULL THEN w / i WHEN NOT starts_with(name, 'claude') THEN 0 END AS cache_write_mult FROM live)"""


def part_catalog(spark, sf):
    """A price catalog with one entry per part; keys repeat, with and without a provider prefix."""
    p = table(spark, sf, "part")
    size = F.col("p_size")
    cost = F.col("p_retailprice").cast("bigint")
    prov = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("prov"), (F.col("p_partkey") % 7).cast("string"), F.lit("/"))).otherwise("")
    family = F.when(size % 2 == 0, "claude-").otherwise("m-")
    key = F.concat(prov, family, F.translate("p_name", " ", "-"), F.lit("-"), (size % 20).cast("string"))
    entry = F.struct(
        F.when(size % 5 != 0, cost).otherwise(0).alias("input_cost_per_token"),
        (cost * 4).alias("output_cost_per_token"),
        F.when(size % 3 == 0, cost).alias("cache_read_input_token_cost"),
        F.when(size % 4 == 0, cost * 2).alias("cache_creation_input_token_cost"),
    )
    return p.select(F.col("p_partkey").alias("pos"), key.alias("key"), F.to_json(entry).alias("json")).select(
        "pos", "key", F.try_parse_json("json").alias("entry"))


@check("s23_price_catalog", with_sql(CATALOG_SQL, select="""SELECT key, input_per_mtok, output_per_mtok, round(cache_read_mult + 1e-9, 6) AS cache_read_mult,
  round(cache_write_mult + 1e-9, 6) AS cache_write_mult FROM lp"""))
def _(spark, sf):
    return usd_columns(prices.catalog_prices(part_catalog(spark, sf)).drop("cache_write_1h_mult"), "cache_read_mult", "cache_write_mult")


@check("c01_j01_x03_live_and_seed_prices", with_sql(EVENTS_SQL, PRICES_SQL, CATALOG_SQL, """
mm AS (SELECT DISTINCT key || CASE WHEN pos % 2 = 0 THEN '-20250101' ELSE '' END AS model FROM cat UNION SELECT DISTINCT model FROM e),
hit AS (SELECT model, key, input_per_mtok, length(key) AS n FROM mm JOIN lp ON starts_with(model, key)),
best AS (SELECT model, max(CASE WHEN key = model THEN input_per_mtok END) AS exact, arg_max(input_per_mtok, n) AS pre FROM hit GROUP BY model),
seed AS (SELECT model, arg_max(pin, length(key)) AS pin FROM mm JOIN prices ON starts_with(model, key) GROUP BY model)""", select="""
SELECT model, coalesce(exact, pin, pre, CASE WHEN starts_with(model, 'claude') THEN 5.0 ELSE 0 END) AS input_per_mtok
FROM mm LEFT JOIN best USING (model) LEFT JOIN seed USING (model)"""))
def _(spark, sf):
    cat = part_catalog(spark, sf)
    dated = F.concat("key", F.when(F.col("pos") % 2 == 0, "-20250101").otherwise(""))
    models = cat.select(dated.alias("model")).union(events(spark, sf).select("model")).distinct()
    return prices.with_price(models, prices.catalog_prices(cat)).select("model", F.col("price.input_per_mtok").alias("input_per_mtok"))


@check("s22_seed_price_of_models", with_sql(LINES_SQL, PRICES_SQL, grouped_sql("l", ["model"]), priced_sql("g"), select="SELECT model, key FROM priced_key"))
def _(spark, sf):
    from meterwork.functions.pricing import static_prices

    models = order_usage(spark, sf).select("model").distinct()
    hit = prices.resolve_live(models, static_prices(spark))
    seeds = static_prices(spark).select("key", F.struct("input_per_mtok", "output_per_mtok", "cache_read_mult", "cache_write_mult", "cache_write_1h_mult").alias("prefix"))
    return hit.select("model", F.to_json("prefix").alias("p")).join(seeds.select("key", F.to_json("prefix").alias("p")), "p").filter(
        F.col("model").startswith(F.col("key"))).groupBy("model").agg(F.max_by("key", F.length("key")).alias("key"))


@check("s24_price_snapshot", with_sql(EVENTS_SQL, f"""
sn AS (SELECT user_id, ts_ms - ts_ms % 86400000 AS fetched_at, 'm' || user_id AS key, max(input_tokens) AS v FROM e GROUP BY ALL),
ok AS (SELECT * FROM sn WHERE fetched_at <= 1706443200000 AND fetched_at > 1706443200000 - 2 * 86400000)""",
    select="SELECT key, v AS input_per_mtok FROM ok WHERE fetched_at = (SELECT max(fetched_at) FROM ok)"))
def _(spark, sf):
    e = events(spark, sf).select(F.concat(F.lit("m"), "user_id").alias("key"), (F.col("ts_ms") - F.col("ts_ms") % 86_400_000).alias("fetched_at"), "input_tokens")
    snapshots = e.groupBy("key", "fetched_at").agg(F.max("input_tokens").alias("input_per_mtok"))
    return prices.choose_snapshot(snapshots, 1706443200000, 2 * 86_400_000)


# ---- blocks and live view ------------------------------------------------------


def blocks_sql(keys, length_h):
    """Blocks by walking each key's distinct half-hour-like buckets with a recursive query."""
    k = ", ".join(keys)
    same = " AND ".join(f"b.{x} = c.{x}" for x in keys)
    edge = int(length_h * 3_600_000) % 3_600_000
    bucket = f"CASE WHEN {edge} > 0 AND ts_ms % 3600000 >= {edge} THEN ts_ms - ts_ms % 3600000 + {edge} ELSE ts_ms - ts_ms % 3600000 END"
    return f"""
be AS (SELECT *, ts_ms - ts_ms % 3600000 AS hour, {bucket} AS bucket FROM e),
bk AS (SELECT DISTINCT {k}, hour, bucket FROM be),
chain AS (
  SELECT {k}, arg_min(hour, bucket) AS start, min(bucket) AS opened FROM bk GROUP BY {k}
  UNION ALL
  SELECT {', '.join('b.' + x for x in keys)}, b.hour, b.bucket FROM chain c JOIN bk b ON {same} AND b.bucket >= c.start + {int(length_h * 3_600_000)}
  WHERE b.bucket = (SELECT min(b2.bucket) FROM bk b2 WHERE {' AND '.join(f'b2.{x} = c.{x}' for x in keys)} AND b2.bucket >= c.start + {int(length_h * 3_600_000)})
),
placed AS (SELECT be.*, ch.start AS block_start FROM be ASOF JOIN chain ch ON {' AND '.join(f'be.{x} = ch.{x}' for x in keys)} AND be.bucket >= ch.opened),
{grouped_sql('placed', [*keys, 'block_start', 'model'], 'g').strip()},
{priced_sql('g').strip()},
times AS (SELECT {k}, block_start, min(ts_ms) AS first_ts, max(ts_ms) AS last_ts FROM placed GROUP BY {k}, block_start),
bt AS (SELECT {k}, block_start, CAST(sum(input_tokens + cache_read_tokens + cache_write_tokens + output_tokens) AS BIGINT) AS total_tokens,
  sum(cost_usd) AS cost_usd, string_agg(DISTINCT regexp_replace(regexp_replace(model, '^claude-', ''), '-[0-9]{{8}}$', ''), ',' ORDER BY regexp_replace(regexp_replace(model, '^claude-', ''), '-[0-9]{{8}}$', '')) AS models
  FROM priced GROUP BY {k}, block_start),
blocks AS (SELECT bt.*, first_ts, last_ts, block_start + {int(length_h * 3_600_000)} AS block_end,
  block_start = max(block_start) OVER (PARTITION BY {k}) AND {NOW_MS - 14_400_000} < block_start + {int(length_h * 3_600_000)} AS active FROM bt JOIN times USING ({k}, block_start))"""


LIVE_MS = NOW_MS - 14_400_000


def event_blocks(spark, sf, keys=("user_id",), length_h=5.0):
    return bl.build_blocks(events(spark, sf), list(keys), LIVE_MS, int(length_h * 3_600_000))


def tidy_blocks(b):
    return usd_columns(b.withColumn("models", F.concat_ws(",", "models")), "cost_usd")


BLOCK_SELECT = "* REPLACE (round(cost_usd + 1e-9, 6) AS cost_usd)"


@check("w09_a21_a27_blocks_by_user", with_sql(EVENTS_SQL, PRICES_SQL, blocks_sql(["user_id"], 5), select=f"SELECT {BLOCK_SELECT} FROM blocks"))
def _(spark, sf):
    return tidy_blocks(event_blocks(spark, sf))


@check("w09_blocks_by_agent", with_sql(EVENTS_SQL, PRICES_SQL, blocks_sql(["agent_id"], 5), select=f"SELECT {BLOCK_SELECT} FROM blocks"))
def _(spark, sf):
    return tidy_blocks(event_blocks(spark, sf, ("agent_id",)))


@check("w09_blocks_of_two_and_a_half_hours", with_sql(EVENTS_SQL, PRICES_SQL, blocks_sql(["user_id"], 2.5), select=f"SELECT {BLOCK_SELECT} FROM blocks"))
def _(spark, sf):
    return tidy_blocks(event_blocks(spark, sf, length_h=2.5))


BURN_SQL = f"""
burn AS (SELECT user_id, block_start, total_tokens, cost_usd, total_tokens / (greatest(60000, {LIVE_MS} - first_ts) / 60000.0) AS tpm,
  cost_usd / (greatest(60000, {LIVE_MS} - first_ts) / 3600000.0) AS cph, greatest(0, block_end - {LIVE_MS}) AS remaining_ms FROM blocks WHERE active)"""


@check("a22_p36_burn_rate", with_sql(EVENTS_SQL, PRICES_SQL, blocks_sql(["user_id"], 5), BURN_SQL, select="""
SELECT user_id, block_start, total_tokens, round(tpm + 1e-9, 6) AS tokens_per_minute, round(cph + 1e-9, 6) AS cost_per_hour, remaining_ms,
  CAST(floor(total_tokens + tpm * (remaining_ms / 60000.0) + 0.5) AS BIGINT) AS projected_tokens, round(cost_usd + cph * (remaining_ms / 3600000.0) + 1e-9, 6) AS projected_cost_usd,
  CASE WHEN tpm > 5000 THEN 'high' WHEN tpm > 2000 THEN 'moderate' ELSE 'normal' END AS level FROM burn"""))
def _(spark, sf):
    pace = live.active_pace(event_blocks(spark, sf), LIVE_MS)
    cols = ["user_id", "block_start", "total_tokens", "tokens_per_minute", "cost_per_hour", "remaining_ms", "projected_tokens", "projected_cost_usd", "level"]
    return usd_columns(pace.select(*cols), "tokens_per_minute", "cost_per_hour", "projected_cost_usd")


@check("a22_biggest_done_block", with_sql(EVENTS_SQL, PRICES_SQL, blocks_sql(["user_id"], 5), select="SELECT user_id, coalesce(max(total_tokens) FILTER (NOT active), 0) AS token_limit FROM blocks GROUP BY 1"))
def _(spark, sf):
    return bl.biggest_done_block(event_blocks(spark, sf), ["user_id"])


@check("t07_p36_recent_blocks", with_sql(EVENTS_SQL, PRICES_SQL, blocks_sql(["user_id"], 5), select=f"""SELECT user_id, block_start,
  CASE WHEN total_tokens > 150000 THEN 'over' WHEN total_tokens > 150000 * 0.8 THEN 'near' ELSE 'ok' END AS level
  FROM blocks WHERE last_ts >= {LIVE_MS} - 3 * 86400000"""))
def _(spark, sf):
    recent = bl.recent_blocks(event_blocks(spark, sf), LIVE_MS, recent_only=True)
    return recent.select("user_id", "block_start", bl.limit_level(F.col("total_tokens"), F.lit(150_000)).alias("level"))


@check("a24_cost_today", with_sql(EVENTS_SQL, PRICES_SQL, f"\ntd AS (SELECT * FROM e WHERE day = '{NOW_DAY}')", grouped_sql("td", ["agent_id", "session_id", "model"]), priced_sql("g"),
                                  select=f"SELECT agent_id, {usd_sql('sum(cost_usd)', 'today_usd')} FROM priced GROUP BY 1"))
def _(spark, sf):
    return usd_columns(live.cost_of_day(event_cubes(spark, sf).usage, NOW_DAY, ["agent_id"]), "today_usd")


@check("c04_a24_reconciled_costs", with_sql(EVENTS_SQL, PRICES_SQL, grouped_sql("e", ["session_id", "model"]), priced_sql("g"), """
rec AS (SELECT session_id, CASE WHEN min(user_id) % 3 <> 0 THEN CAST(sum(input_tokens) AS DOUBLE) / 1e4 END AS recorded_usd FROM e GROUP BY 1),
cc AS (SELECT session_id, sum(cost_usd) AS cost_usd FROM priced GROUP BY 1)""", select="""
SELECT session_id, round(coalesce(recorded_usd, 0) + 1e-9, 6) AS cc, round(cost_usd + 1e-9, 6) AS calc, round(coalesce(recorded_usd, cost_usd) + 1e-9, 6) AS auto,
  round(coalesce(recorded_usd, 0) - cost_usd + 1e-9, 6) AS difference FROM rec JOIN cc USING (session_id)"""))
def _(spark, sf):
    recorded = events(spark, sf).groupBy("session_id").agg(
        F.when(F.min("user_id") % 3 != 0, F.sum("input_tokens").cast("double") / 1e4).alias("recorded_usd"))
    both = reports.reconcile(recorded, live.cost_of_sessions(event_cubes(spark, sf).usage))
    return usd_columns(both, "cc", "calc", "auto", "difference")
