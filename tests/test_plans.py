"""Shapes of plans: how often tables are read and dealt, and what never goes through one task or a Python worker."""

import random

from pyspark.sql import functions as F

from meterwork.functions import coerce as c
from meterwork.functions.measures import MEASURES
from meterwork.operators.blocks import bucket_blocks, build_blocks, limit_level, recent_blocks, usage_blocks
from meterwork.operators.ranking import with_rank
from meterwork.operators.usage import SESSION_COLUMNS
from meterwork.plans import agents, reports
from meterwork.sources import documents, json_lines

from .conftest import records

HOUR = 3_600_000


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def written(spark, df, path):
    df.write.parquet(str(path))
    return spark.read.parquet(str(path))


def usage(spark, n=200):
    rng = random.Random(4)
    rows = [(f"a{rng.randrange(3)}", f"s{rng.randrange(9)}", "2026-07-10", rng.choice(["gpt-5", "claude-opus-4-8", "x"]), *[rng.randrange(1000) for _ in MEASURES]) for _ in range(n)]
    return spark.createDataFrame(rows, "agent_id string, session_id string, day string, model string, " + ", ".join(f"{m} bigint" for m in MEASURES))


def test_rows_and_total_in_one_scan(spark, tmp_path):
    u = written(spark, usage(spark), tmp_path / "u")
    s = written(spark, u.select("agent_id", "session_id").distinct().select("agent_id", "session_id", *[F.lit("2026-07-10T00:00:00Z").alias(x) for x in SESSION_COLUMNS[2:]]), tmp_path / "s")
    both = agents.agent_totals(u, s)
    assert plan_of(both).count("FileScan") == 2 and plan_of(both).count("Exchange hashpartitioning") <= 4
    got = {r["agent_id"]: r for r in records(both)}
    for r in records(reports.totals(u, s, ["agent_id"])) + [{**x, "agent_id": "__all_agents__"} for x in records(reports.totals(u, s, []))]:
        assert {k: round(v, 6) if isinstance(v, float) else v for k, v in r.items()} == {k: round(v, 6) if isinstance(v, float) else v for k, v in got.pop(r["agent_id"]).items()}
    assert not got
    one = agents.agent_totals(u.filter("agent_id = 'a1'"), s.filter("agent_id = 'a1'"))
    assert [r["agent_id"] for r in records(one)] == ["a1"]
    mart = written(spark, reports.usage_by(u, ["model"]), tmp_path / "m")
    with_total = reports.with_total_row(mart, "model", ["input_tokens"])
    assert plan_of(with_total).count("FileScan") == 1
    rows = {r["model"]: r["input_tokens"] for r in records(with_total)}
    assert rows["TOTAL"] == sum(v for k, v in rows.items() if k != "TOTAL") and len(rows) == 4
    assert [r["model"] for r in records(reports.with_total_row(mart.filter("model = 'x'"), "model", ["input_tokens"]))] == ["x"]


def test_ranks_need_no_single_task(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, v int").repartition(5)
    ranked = with_rank(df, [F.desc("v"), F.asc("id")])
    assert "Window" not in plan_of(ranked)
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [(r["id"], r["v"], r["rank"]) for r in ranked.collect()] == [(a, b, k + 1) for k, (a, b) in enumerate(want)]
    assert with_rank(df.limit(0), [F.asc("id")]).count() == 0 and with_rank(df.limit(0), [F.asc("id")]).columns == ["id", "v", "rank"]


def test_one_scan_of_threads_and_no_python_for_deep_usage(spark, tmp_path):
    lines = lambda value: spark.createDataFrame([("f", 0, 0, 0, value, "t")], "file string, block_start bigint, line_no bigint, pos bigint, value string, mtime string")
    doc = '{"id":"T","messages":[{"messageId":1,"role":"assistant","usage":{"inputTokens":1}}],"usageLedger":{"events":[{"toMessageId":1,"tokens":{"input":2}}]}}'
    raw = written(spark, lines(doc), tmp_path / "t")
    (tmp_path / "t").rename(tmp_path / "moved")
    moved = spark.read.parquet(str(tmp_path / "moved"))
    nodes = documents.amp_nodes(moved)  # staged: what comes after reads its rows, not the documents
    assert str(tmp_path) not in "".join(documents.amp(moved).usage.inputFiles()) and {r["part"] for r in records(nodes)} == {"event", "cached"}
    assert raw.schema == moved.schema
    owner = c.parse_once(lines('{"a":{"inputOther":1}}'), F.try_parse_json("value"), ["value"], "v").select(c.owner_of_keys(F.col("value"), F.col("v"), json_lines.KIMI_USAGE))
    assert "Python" not in plan_of(owner) and "Arrow" not in plan_of(owner)


def test_counters_are_typed(spark):
    values = ["9007199254740993", "9223372036854775807", "99999999999999999999", "1e3", "5.0", "5.5", "-7", "true", "null", '"12"', '" 12 "', '"1e2"', '""', '"x"', "[1]", '{"a":1}', "0.1"]
    df = c.parse_once(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string"), F.try_parse_json("t"), ["i", "t"], "v")
    read = df.select("t", c.number(F.col("v")).alias("number"), c.count(F.col("v")).alias("count"), c.natural(F.col("v")).alias("natural"))
    assert "to_json" not in plan_of(read).lower()
    got = {r["t"]: (r["number"], r["count"], r["natural"]) for r in records(read)}
    assert got["9007199254740993"] == (9007199254740992.0, 9007199254740992, 9007199254740993)
    assert got["9223372036854775807"][1:] == (2**63 - 1, 2**63 - 1) and got["99999999999999999999"] == (1e20, 2**63 - 1, None)
    assert got["1e3"] == (1000.0, 1000, 1000) and got["5.0"] == (5.0, 5, 5) and got["5.5"] == (5.5, 5, None) and got["-7"] == (-7.0, 0, None)
    assert got['"12"'] == (None, 12, 12) and got['" 12 "'] == (None, 12, 12) and got['"1e2"'] == (None, 100, None)
    assert all(got[t] == (None, 0, None) for t in ("true", "null", '""', '"x"', "[1]", '{"a":1}')) and got["0.1"] == (0.1, 0, None)


def walked(hours, length):
    end, out = None, {}
    for bucket, hour in sorted(hours):
        if end is None or bucket >= end:
            start, end = hour, hour + length
        out[bucket] = start
    return out


def test_blocks_of_a_long_history(spark):
    rng = random.Random(7)
    for length in (5 * HOUR, int(2.5 * HOUR), 40 * 24 * HOUR):
        rows, want = [], {}
        for key in ("steady", "gaps", "one"):
            hours, at = set(), rng.randrange(10**6) * HOUR
            for _ in range(1 if key == "one" else 3000):
                at += HOUR * (1 if key == "steady" else rng.choice([1, 1, 2, 4, 7, 900]))
                half = HOUR // 2 if length % HOUR and rng.random() < 0.5 else 0
                hours.add((at + half, at))
            rows += [(key, b, h) for b, h in hours]
            want |= {(key, b): s for b, s in walked(hours, length).items()}
        df = spark.createDataFrame(rows, "key string, bucket bigint, hour bigint")
        assert {(r["key"], r["bucket"]): r["block_start"] for r in records(bucket_blocks(df, ["key"], length))} == want
        # A walk that goes on from a known end gives the rest of the same blocks.
        # The cut lies inside a block, so the first hours of the rest belong to it, and stretches follow.
        cut = sorted(b for k, b, _ in rows if k == "gaps")[1501]
        before = max(s for (k, b), s in want.items() if k == "gaps" and b < cut)
        rest = df.filter((F.col("key") == "gaps") & (F.col("bucket") >= cut))
        entered = spark.createDataFrame([("gaps", before + length)], "key string, end bigint")
        assert {r["bucket"]: r["block_start"] for r in records(bucket_blocks(rest, ["key"], length, entered))} == {b: s for (k, b), s in want.items() if k == "gaps" and b >= cut}


def test_blocks_from_usage(spark):
    none = [0] * (len(MEASURES) - 1)
    rows = [("2026-07-10T09:20:00Z", "gpt-5", 100, *none), ("2026-07-10T10:20:00.000Z", "gpt-5", 300, *none), ("2026-07-10T14:10:00+00:00", "x", 50, *none), ("soon", "x", 7, *none), (None, "x", 9, *none)]
    df = spark.createDataFrame(rows, "ts_raw string, model string, " + ", ".join(f"{m} bigint" for m in MEASURES))
    now = 1_783_695_600_000  # 15:00 of the day
    whole = usage_blocks(df, [], now)
    got = [(r["block_start"] % (24 * HOUR) // HOUR, r["total_tokens"], r["active"]) for r in records(whole.orderBy("block_start"))]
    assert got == [(9, 400, False), (14, 50, True)]
    assert recent_blocks(whole, now, active_only=True).count() == 1
    level = whole.select(limit_level(F.col("total_tokens"), F.lit(60), F.when(F.col("active"), F.lit(90))).alias("x"))
    assert {r["x"] for r in records(level)} == {"over"}
    assert build_blocks(df.withColumn("ts_ms", F.lit(None).cast("bigint")), [], now).count() == 0
