"""Checks on real files: event rows are rendered as text below homes, found by the agents' own patterns and read back."""

from __future__ import annotations

import itertools
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterwork.plans import agents, reports
from meterwork.session import staging_root
from meterwork.sources import codex, json_lines
from meterwork.sources.files import LogFiles, home_files
from meterwork.sources.lines import fault_places, line_report, read_lines
from meterwork.sources.records import PLACE, record, records_to_facts

from .inputs import EVENTS_SQL, PRICES_SQL, SUMS_SQL, events, with_sql
from .reports import tidy_totals, totals_sql
from .sources import CODEX_SQL, codex_lines, col, facts_table, msg_id, obj

QUERIES, SQL = {}, {}
OLD_MS = 1_600_000_000_000  # the file time of logs that a bound on times leaves out
BOUND = "2021-01-01T00:00:00"


def check(name, sql=None):
    def add(f):
        QUERIES[name] = lambda spark, sf: f(spark, sf, f"{staging_root(spark)}/logs-{uuid.uuid4().hex}")
        if sql:
            SQL[name] = sql
        return f

    return add


def write_logs(lines: DataFrame, root: str, old: str | None = None) -> None:
    """Write rows (file, line_no, value) as text files of those names below ``root``; files that match ``old`` get an old time.

    Where ``root`` is a folder that every task mounts, a task opens the files of its rows by their own names, one at a
    time, and the driver touches none; other file systems take them from Spark and only get them renamed.
    """
    spark = lines.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getUri().getScheme() != "file":
        return _write_and_rename(lines, root, system, old)
    folder = system.makeQualified(place).toUri().getPath()
    placed = lines.select("file", "line_no", "value").repartition("file").sortWithinPartitions("file", "line_no").select("file", "value")
    placed.mapInArrow(lambda batches: _write_files(batches, folder, old), "files bigint").agg(F.sum("files")).collect()


def _write_files(batches: Iterator[pa.RecordBatch], folder: str, old: str | None) -> Iterator[pa.RecordBatch]:
    """Write the files of one task, whose rows come sorted; a file shows under its name when it is whole, so a repeated task replaces it."""
    name, out, files = None, None, 0
    for batch in batches:
        rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        for file, group in itertools.groupby(rows, key=lambda r: r[0]):
            if not file:
                raise ValueError("a line without a file")
            if file != name:
                if out:
                    _close_file(out, f"{folder}/{name.lstrip('/')}", old is not None and old in name)
                name, files = file, files + 1
                parent, leaf = os.path.split(f"{folder}/{file.lstrip('/')}")
                os.makedirs(parent, exist_ok=True)
                out = open(f"{parent}/.{leaf}-{uuid.uuid4().hex}", "wb", buffering=1 << 16)
            out.write("".join([f"{value or ''}\n" for _, value in group]).encode())
    if out:
        _close_file(out, f"{folder}/{name.lstrip('/')}", old is not None and old in name)
    yield pa.RecordBatch.from_pydict({"files": [files]})


def _close_file(out, target: str, old: bool) -> None:
    out.close()
    if old:
        os.utime(out.name, (OLD_MS / 1000, OLD_MS / 1000))
    os.replace(out.name, target)


def _write_and_rename(lines: DataFrame, root: str, system, old: str | None) -> None:
    """``write_logs`` through Spark's text writer: a task writes whole files; the driver only gives them their names."""
    spark = lines.sparkSession
    work = f"{root}-parts-{uuid.uuid4().hex}"
    placed = lines.select(F.hex("file").alias("f"), "line_no", "value").repartition("f").sortWithinPartitions("f", "line_no")
    placed.select("f", "value").write.partitionBy("f").text(work)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for folder in system.listStatus(hadoop.Path(work)):
        name = folder.getPath().getName()
        if not name.startswith("f="):
            continue
        file = bytes.fromhex(name[2:]).decode()
        target = hadoop.Path(f"{root}/{file.lstrip('/')}")
        system.mkdirs(target.getParent())
        [part] = [x.getPath() for x in system.listStatus(folder.getPath()) if x.getPath().getName().startswith("part-")]
        system.rename(part, target)
        if old and old in file:
            system.setTimes(target, OLD_MS, -1)


def below(root: str, column: str = "file"):
    """A path without what stands before the homes."""
    return F.regexp_replace(column, f"^.*{uuid_of(root)}", "")


def uuid_of(root: str) -> str:
    return root.rsplit("/", 1)[1]


# ---- Codex homes -----------------------------------------------------------------


@check("s03_s25_s28_d06_codex_homes", with_sql(*CODEX_SQL, select=f"""SELECT CASE user_id % 3 WHEN 0 THEN '/h1/sessions/u' WHEN 1 THEN '/h1/archived_sessions/a b/u' ELSE '/h2/deep/u' END || user_id || '.jsonl' AS session_id,
  day, model, {SUMS_SQL} FROM cf WHERE user_id % 10 <> 5 GROUP BY ALL"""))
def _(spark, sf, root):
    """Two homes: one with active logs and archived twins (shorter ones), one without either folder. Old files are not opened."""
    user = F.regexp_extract("file", r"u(\d+)\.jsonl$", 1).cast("int")
    base = codex_lines(spark, sf).filter(F.col("file").startswith("/a/")).withColumn("user", user)
    name = F.concat(F.lit("u"), F.col("user").cast("string"), F.when(F.col("user") % 10 == 5, F.lit("-old")).otherwise(F.lit("")), F.lit(".jsonl"))
    home = F.when(F.col("user") % 3 == 0, "/h1/sessions/").when(F.col("user") % 3 == 1, "/h1/archived_sessions/a b/").otherwise("/h2/deep/")
    logs = base.select(F.concat(home, name).alias("file"), "line_no", "value")
    twins = base.filter((F.col("user") % 3 == 0) & (F.col("line_no") % 2 == 0)).select(F.concat(F.lit("/h1/archived_sessions/"), name).alias("file"), "line_no", "value")
    write_logs(logs.unionByName(twins), root, old="-old")
    lines = codex.read_home(spark, [f"{root}/h1", f"{root}/h2", f"{root}/none"], modified_after=BOUND)
    return facts_table(codex.load(lines)).withColumn("session_id", below(root, "session_id"))


@check("s03_s28_files_listed", with_sql(EVENTS_SQL, select="""SELECT 'h' || (user_id % 2) AS home, user_id % 4 // 2 AS rank, 'u' || user_id || '.jsonl' AS rel,
  CAST(sum(length('{"id":' || event_id || '}') + 1) AS BIGINT) AS size FROM e GROUP BY user_id"""))
def _(spark, sf, root):
    """Paths and sizes of every home's logs, chosen among other files, without a look inside."""
    e = events(spark, sf)
    user = F.col("user_id").cast("string")
    folder = F.concat(F.lit("/h"), (F.col("user_id") % 2).cast("string"), F.when(F.col("user_id") % 4 < 2, "/sessions/u").otherwise("/archived_sessions/u"))
    line = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit("}"))
    logs = e.select(F.concat(folder, user, F.lit(".jsonl")).alias("file"), F.col("event_id").alias("line_no"), line.alias("value"))
    other = e.filter("event_id % 50 = 0").select(F.concat(folder, user, F.lit(".txt")).alias("file"), F.col("event_id").alias("line_no"), line.alias("value"))
    write_logs(logs.unionByName(other), root)
    files = home_files(spark, [f"{root}/h0", f"{root}/h1"], codex.LOGS)
    return files.select(F.regexp_extract("home", "/(h[01])$", 1).alias("home"), "rank", "rel", "size")


# ---- tolerant reading --------------------------------------------------------------

BROKEN_SQL = """
b AS (SELECT user_id, event_id, CASE WHEN k % 11 = 0 THEN 'malformed' WHEN k % 13 = 1 THEN 'blank' WHEN k % 17 = 2 THEN 'null' END AS fault,
  CASE WHEN k % 11 = 0 THEN '{"id":' || event_id || ',"t":"é' WHEN k % 13 = 1 THEN ' ' WHEN k % 17 = 2 THEN 'null' ELSE '{"id":' || event_id || ',"t":"é"}' END AS value FROM e)"""


def broken_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One line per event; some are cut short, empty or null."""
    k, eid = F.col("k"), F.col("event_id").cast("string")
    head = F.concat(F.lit('{"id":'), eid, F.lit(',"t":"é'))
    value = F.when(k % 11 == 0, head).when(k % 13 == 1, " ").when(k % 17 == 2, "null").otherwise(F.concat(head, F.lit('"}')))
    return events(spark, sf).select(F.concat(F.lit("/l/u"), F.col("user_id").cast("string"), F.lit(".jsonl")).alias("file"), F.col("event_id").alias("line_no"), value.alias("value"))


@check("s27_line_report", with_sql(EVENTS_SQL, BROKEN_SQL, select="""SELECT '/l/u' || user_id || '.jsonl' AS file, count(*) AS lines, count(*) FILTER (fault IS NULL) AS read,
  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'malformed') AS malformed, count(*) FILTER (fault = 'null') AS "null" FROM b GROUP BY user_id"""))
def _(spark, sf, root):
    write_logs(broken_lines(spark, sf), root)
    return line_report(read_lines(spark, root)).withColumn("file", below(root))


@check("s27_r01_fault_places", with_sql(EVENTS_SQL, BROKEN_SQL, """
p AS (SELECT *, row_number() OVER w - 1 AS line, coalesce(sum(octet_length(encode(value)) + 1) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS byte_at
  FROM b WINDOW w AS (PARTITION BY user_id ORDER BY event_id))""",
    select="SELECT '/l/u' || user_id || '.jsonl' AS file, line, CAST(byte_at AS BIGINT) AS byte_at, fault FROM p WHERE fault IS NOT NULL"))
def _(spark, sf, root):
    """The line number and the first byte of every line that cannot be read."""
    write_logs(broken_lines(spark, sf), root)
    return fault_places(read_lines(spark, root)).withColumn("file", below(root))


# ---- agents found by their patterns ---------------------------------------------------


def agent_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Logs of five agents in two homes; every agent also has a file that its pattern leaves out."""
    e = events(spark, sf).withColumn("who", F.col("user_id") % 5)
    user, who = F.col("user_id").cast("string"), F.col("who")
    counts = {"input": col("input_tokens"), "output": col("output_tokens"), "cacheRead": col("cache_read_tokens"), "cacheWrite": col("cache_write_tokens")}
    kimi = obj(model=col("model"), timestamp=col("ts_raw"), message=obj(id=msg_id(), payload=obj(
        usage=obj(inputOther=col("input_tokens"), output=col("output_tokens"), inputCacheRead=col("cache_read_tokens"), inputCacheCreation=col("cache_write_tokens")))))
    claw = obj(type=F.lit("message"), id=msg_id(), timestamp=col("ts_raw"), message=obj(model=col("model"), usage=obj(**counts)))
    pi = obj(timestamp=col("ts_raw"), message=obj(id=msg_id(), role=F.lit("assistant"), model=col("model"), usage=obj(**counts)))
    qwen = obj(model=col("model"), timestamp=col("ts_raw"), id=msg_id(), usageMetadata=obj(
        promptTokenCount=col("input_tokens") + col("cache_read_tokens"), candidatesTokenCount=col("output_tokens"), cachedContentTokenCount=col("cache_read_tokens")))
    own = obj(t=col("ts_raw"), m=col("model"), tokens_in=col("input_tokens"), tokens_out=col("output_tokens"))
    value = F.when(who == 0, F.to_json(kimi)).when(who == 1, F.to_json(claw)).when(who == 2, F.to_json(pi)).when(who == 3, F.to_json(qwen)).otherwise(F.to_json(own))
    home = F.concat(F.lit("/h"), (F.col("user_id") % 2).cast("string"))
    second = F.col("user_id") % 4 < 2
    good = (
        F.when(who == 0, F.concat(home, F.when(second, "/.kimi/sessions/s").otherwise("/.kimi-code/sessions/x/s"), user, F.lit("/wire.jsonl")))
        .when(who == 1, F.concat(home, F.when(second, "/.openclaw/a/").otherwise("/.clawdbot/"), user, F.when(F.col("user_id") % 3 == 0, ".jsonl.1").otherwise(".jsonl")))
        .when(who == 2, F.concat(home, F.lit("/.pi/agent/sessions/"), user, F.lit(".jsonl")))
        .when(who == 3, F.concat(home, F.lit("/.qwen/projects/p/"), user, F.lit(".jsonl")))
        .otherwise(F.concat(home, F.lit("/.own/"), user, F.lit(".log")))
    )
    bad = (
        F.when(who == 0, F.concat(home, F.lit("/.kimi/wire.jsonl")))
        .when(who == 1, F.concat(home, F.lit("/.openclaw/jsonl.txt")))
        .when(who == 2, F.concat(home, F.lit("/.pi/agent/settings.jsonl")))
        .when(who == 3, F.concat(home, F.lit("/.qwen/history.jsonl")))
        .otherwise(F.concat(home, F.lit("/.own/log.old")))
    )
    changed = F.regexp_replace("value", "2024-", "2023-")  # read by mistake, it would count as further usage
    rows = e.select(good.alias("good"), bad.alias("bad"), F.col("event_id").alias("line_no"), value.alias("value"))
    return rows.select(F.col("good").alias("file"), "line_no", "value").unionByName(
        rows.filter("line_no % 40 = 0").select(F.col("bad").alias("file"), "line_no", changed.alias("value")))


def own_facts(lines: DataFrame):
    """A loader as a user would add it."""
    opened = json_lines.parsed(lines).select(*PLACE, F.expr("try_variant_get(v, '$', 'struct<t:string,m:string,tokens_in:bigint,tokens_out:bigint>')").alias("s"))
    rows = opened.select(*record("own", F.col("file"), F.col("s.m"), F.col("s.t"), None, F.col("s.tokens_in"), F.col("s.tokens_out")))
    return records_to_facts(rows, dedup=False)


AGENT_NAMES = ["kimi", "openclaw", "pi", "qwen", "own"]
HOMES_SQL = f"""
w AS (SELECT * REPLACE ({AGENT_NAMES!r}[user_id % 5 + 1] AS agent_id, CAST(user_id AS VARCHAR) AS session_id, 0 AS cache_write_1h_tokens,
    CASE WHEN user_id % 5 = 4 THEN 0 ELSE cache_read_tokens END AS cache_read_tokens, CASE WHEN user_id % 5 >= 3 THEN 0 ELSE cache_write_tokens END AS cache_write_tokens) FROM e)"""


def home_facts(spark, sf, root):
    """The facts of all five agents, one of them registered on the spot."""
    write_logs(agent_logs(spark, sf), root)
    agents.adapter("own", "Own log")(own_facts)
    agents.LOGS["own"] = (LogFiles((".own",), r"\.log$"),)
    try:
        homes = [f"{root}/h0", f"{root}/h1"]
        return agents.all_agents([agents.read_agent(spark, a, homes, BOUND) for a in AGENT_NAMES])
    finally:
        agents.unregister("own")


@check("s28_x01_u01_agent_homes", with_sql(EVENTS_SQL, HOMES_SQL, select=f"SELECT agent_id, session_id, day, model, {SUMS_SQL} FROM w GROUP BY ALL"))
def _(spark, sf, root):
    facts = home_facts(spark, sf, root)
    user = F.regexp_extract("session_id", r"(\d+)(/wire)?\.(jsonl|log)(\.1)?$", 1)
    return reports.usage_by(facts.usage.withColumn("session_id", user), ["agent_id", "session_id", "day", "model"])


@check("a18_u01_totals_of_homes", with_sql(EVENTS_SQL, PRICES_SQL, HOMES_SQL, "\nws AS (SELECT agent_id, session_id, min(ts_raw) AS first_ts, max(ts_raw) AS last_ts FROM w GROUP BY 1, 2)",
    *totals_sql(["agent_id"], "w", "ws"), *totals_sql([], "w", "ws", name="al"), select="SELECT * FROM tot UNION ALL SELECT '__all_agents__', * FROM al"))
def _(spark, sf, root):
    facts = home_facts(spark, sf, root)
    return tidy_totals(agents.agent_totals(facts.usage, facts.sessions))


