"""Streaming jobs against their batch twins on hand-made batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterwork.operators.blocks import build_blocks
from meterwork.operators.deltas import COUNTERS, message_deltas
from meterwork.operators.usage import USAGE_COLUMNS
from meterwork.plans.live import cost_of_day
from meterwork.session import clear_staged, stage, staged_mark
from meterwork.streaming import jobs

LINE = "message_id string, file string, day string, model string, line_no bigint, counted boolean, " + ", ".join(f"{c} bigint" for c in COUNTERS)


@pytest.fixture
def streaming(spark):
    jobs.use_state_store(spark)
    return spark


def drain(writer):
    writer.start().awaitTermination()


def line(mid, file, n, model, value):
    return (mid, file, "2026-07-20", model, n, True, value, 0, 0, 0, value // 2)


def test_stream_deltas_equal_the_batch(streaming, tmp_path):
    spark = streaming
    batches = [
        [line("x", "f1", 1, "A", 100), line("x", "f1", 2, "B", 200), line("x", "f1", 3, "A", 300), line("y", "f1", 4, "A", 5)],
        [line("x", "f2", 1, "B", 250), line("x", "f2", 2, "B", 350), line("y", "f2", 3, "B", 5), line("z", "f2", 4, "A", 0)],
        [line("hot", f"g{k % 3}", k, "AB"[k % 2], k) for k in range(12_000)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, LINE).repartition(3).write.parquet(f"{tmp_path}/in/part={k}")
        drain(jobs.message_deltas_job(spark.readStream.schema(LINE).parquet(f"{tmp_path}/in"), f"{tmp_path}/work", keep=dt.timedelta(days=30)))
    key = ["message_id", "file", "line_no"]
    got = {tuple(r[c] for c in key): (r["model"], r["input_tokens"], r["output_tokens"], r["turns"]) for r in spark.read.parquet(f"{tmp_path}/work/deltas").collect()}
    everything = spark.createDataFrame([(*r, k) for k, rows in enumerate(batches) for r in rows], LINE + ", block_start bigint").withColumn("pos", F.lit(0).cast("bigint"))
    order = ["block_start", "file", "line_no", "pos"]
    batch = message_deltas(everything, [F.col("block_start").alias("b"), F.col("file").alias("f")], order)
    want = {tuple(r[c] for c in key): (r["model"], r["input_tokens"], r["output_tokens"], r["turns"]) for r in batch.collect()
            if r["input_tokens"] or r["output_tokens"] or r["turns"]}
    assert got == want and got["x", "f1", 3][:2] == ("A", 100) and got["x", "f2", 2][:2] == ("B", 50)


def events(spark, rows):
    made = [(k, 1_784_505_600_000 + int(minute * 60_000), "claude-opus-4-8", 1000) for k, minute in rows]
    df = spark.createDataFrame(made, "key string, ts_ms bigint, model string, input_tokens bigint")
    for c in USAGE_COLUMNS:
        if c not in df.columns and c not in ("day", "model", "input_tokens"):
            df = df.withColumn(c, F.lit(1 if c == "turns" else 0).cast("bigint")) if c.endswith(("tokens", "turns")) else df.withColumn(c, F.lit(None).cast("string"))
    return df.withColumn("day", F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd"))


def test_live_view_keeps_the_anchor_of_the_open_block(streaming, tmp_path, monkeypatch):
    """Events 21:05, 21:35, 01:30, 02:30 and now 03:30: the block opened at 21:00 has ended, the open one began at 02:00."""
    spark = streaming
    monkeypatch.setattr(jobs, "COMPACT_EVERY", 2)
    day = 24 * 60
    times = [("u", 21 * 60 + 5), ("u", 21 * 60 + 35), ("u", day + 90), ("u", day + 150), ("v", day + 10)]
    now = dt.datetime(2026, 7, 21, 3, 30)
    now_ms = int(now.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    whole = events(spark, times)
    for k, row in enumerate(times):
        events(spark, [row]).write.parquet(f"{tmp_path}/in/part={k}")
        drain(jobs.live_job(spark.readStream.schema(whole.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/state", f"{tmp_path}/view", f"{tmp_path}/ck", lambda: now))
    got = {r["key"]: r for r in spark.read.parquet(f"{tmp_path}/view").collect()}
    blocks = {r["key"]: r for r in build_blocks(whole, ["key"], now_ms).filter("active").collect()}
    assert (blocks["u"]["block_start"], blocks["u"]["total_tokens"]) == (1_784_505_600_000 + (day + 120) * 60_000, 1000)
    for key in ("u", "v"):
        assert got[key]["remaining_ms"] == blocks[key]["block_end"] - now_ms
        assert got[key]["block_usd"] == pytest.approx(blocks[key]["cost_usd"])
    today = {r["key"]: r["today_usd"] for r in cost_of_day(whole.withColumn("agent_id", F.col("key")), "2026-07-21", ["key"]).collect()}
    assert {k: r["today_usd"] for k, r in got.items()} == pytest.approx(today)


def test_files_before_the_cutoff_are_left_out(streaming, tmp_path):
    spark = streaming
    old, new = events(spark, [("u", 5)]).withColumn("mtime", F.lit("2026-07-18T00:00:00")), events(spark, [("u", 5)]).withColumn("mtime", F.lit("2026-07-21T03:00:00"))
    old.union(new).write.parquet(f"{tmp_path}/in")
    drain(jobs.live_job(spark.readStream.schema(old.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/state", f"{tmp_path}/view", f"{tmp_path}/ck", lambda: dt.datetime(2026, 7, 21, 3, 30)))
    assert spark.read.parquet(f"{tmp_path}/state/batch=0").agg(F.sum("turns")).first()[0] == 1


def test_first_of_drops_copies(streaming, tmp_path):
    spark = streaming
    rows = spark.createDataFrame([("a", 1_000_000), ("a", 1_000_060), ("b", 1_000_000)], "id string, s bigint").select("id", F.timestamp_seconds("s").alias("ts"))
    rows.write.parquet(f"{tmp_path}/in")
    kept = jobs.run_to_table(jobs.first_of(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), ["id"]), f"{tmp_path}/out", f"{tmp_path}/ck")
    assert sorted(r["id"] for r in kept.collect()) == ["a", "b"]


def test_staged_tables_can_be_cleared(spark):
    mark = staged_mark()
    df = stage(spark.range(3), "clear-me")
    path = df.inputFiles()[0]
    assert df.count() == 3 and clear_staged(spark, mark) == 1
    import os

    assert not os.path.exists(path.removeprefix("file://").removeprefix("file:"))


def test_bounded_state_stays_the_same_size(streaming, tmp_path):
    """1,000 hours of steady usage in 25 batches: the state never holds more than the kept hours, and the view is the batch answer."""
    spark = streaming
    start = dt.datetime(2026, 7, 20)
    sizes = []
    for k in range(25):
        now = start + dt.timedelta(hours=40 * (k + 1))
        events(spark, [(u, 60 * h + 7) for h in range(40 * k, 40 * (k + 1)) for u in ("u", "v") if u == "u" or h % 9]).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
        arrived = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in/part={k}").schema).parquet(f"{tmp_path}/in")
        if k < 3 or k == 24:  # the batches between are taken together with the last
            drain(jobs.live_job(arrived, f"{tmp_path}/state", f"{tmp_path}/view", f"{tmp_path}/ck", lambda: now, keep=dt.timedelta(hours=30)))
            last = max((p.name for p in (tmp_path / "state" / "hours").iterdir()), key=lambda n: int(n.split("=")[1]))
            sizes.append(spark.read.parquet(f"{tmp_path}/state/hours/{last}").count())
    assert max(sizes) <= 2 * 40 and sizes[-1] <= sizes[0] + 8, sizes
    assert len(list((tmp_path / "state" / "hours").iterdir())) <= 2
    now_ms = int(now.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    whole = spark.read.parquet(f"{tmp_path}/in").drop("part")
    blocks = {r["key"]: r for r in build_blocks(whole, ["key"], now_ms).filter("active").collect()}
    got = {r["key"]: r for r in spark.read.parquet(f"{tmp_path}/view").collect()}
    for key, block in blocks.items():
        assert got[key]["remaining_ms"] == block["block_end"] - now_ms and got[key]["block_usd"] == pytest.approx(block["cost_usd"])


def test_windows_are_priced_and_late_sums_counted(streaming, tmp_path):
    spark = streaming
    day = 24 * 60
    batches = [[("u", 10), ("u", 20)], [("u", 5 * day)], [("u", 30), ("u", 9 * day)], [("u", 12 * day)]]
    for k, rows in enumerate(batches):
        events(spark, rows).withColumn("ts", F.timestamp_millis("ts_ms")).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
        arrived = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in/part={k}").schema).parquet(f"{tmp_path}/in")
        drain(jobs.daily_cost_job(arrived, f"{tmp_path}/work"))
    cost = {r["day"]: (r["turns"], round(r["cost_usd"], 6)) for r in spark.read.parquet(f"{tmp_path}/work/cost").collect()}
    assert cost == {"2026-07-20": (3, 0.015), "2026-07-25": (1, 0.005)} or cost == {"2026-07-20": (2, 0.01), "2026-07-25": (1, 0.005)}
    assert spark.read.parquet(f"{tmp_path}/work/late").agg(F.sum("late_sums")).first()[0] in (0, 1)


def test_a_batch_of_text_is_bounded_by_bytes(spark, tmp_path):
    """Many small files are one batch, not one per thousand files; a smaller bound cuts them, and every line is read."""
    (tmp_path / "in").mkdir()
    for k in range(1200):
        (tmp_path / "in" / f"{k}.jsonl").write_bytes(b"0123456789\n")
    for name, options, batches in (("all", {}, 1), ("cut", {"bytes_per_batch": 1100 * 11}, 2), ("counted", {"files_per_batch": 600}, 2)):
        seen = []
        lines = jobs.stream_lines(spark, f"{tmp_path}/in", **options)
        lines.writeStream.foreachBatch(lambda b, _: seen.append(b.count())).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
        assert len(seen) == batches and sum(seen) == 1200


def test_block_state_takes_a_row_per_key_and_month(streaming, tmp_path):
    """Hours reach the state packed; of a pack's hours only those that came in time count, and a closed block stays closed."""
    spark = streaming
    batches = [
        [("u", 5), ("u", 70), ("u", 90), ("u", 30 * 60), ("v", 30), ("v", 100), ("v", 160)],
        [("u", 29.5 * 60), ("u", 130), ("u", 31 * 60), ("v", 61), ("v", 31 * 60), ("v", 32 * 60)],  # the watermark is at 29:00
        [("u", 60 * 60), ("v", 60 * 60)],
    ]
    for k, rows in enumerate(batches):
        made = events(spark, rows)
        made.coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
        arrived = spark.readStream.schema(made.schema).parquet(f"{tmp_path}/in").drop("part")
        drain(jobs.block_hours_job(arrived, F.col("key"), f"{tmp_path}/work"))
        packs = spark.readStream.schema(jobs.PACK_DDL).parquet(f"{tmp_path}/work/hours")
        blocks = jobs.run_to_table(jobs.block_stream(packs), f"{tmp_path}/blocks", f"{tmp_path}/checkpoint")
    landed = {r["batch"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/work/hours").groupBy("batch").count().collect()}
    assert landed == {0: 2, 1: 4, 2: 2}
    hour = lambda ms: (ms - 1_784_505_600_000) / 3_600_000
    got = {(r["key"], hour(r["block_start"])): (hour(r["block_end"]), hour(r["last_ts"]), r["total_tokens"], round(r["cost_usd"], 6), r["late_events"]) for r in blocks.collect()}
    assert got == {
        ("u", 0): (5, 1.5, 3000, 0.015, 0), ("u", 30): (35, 31, 2000, 0.01, 1),
        ("v", 0): (5, 160 / 60, 3000, 0.015, 0), ("v", 31): (36, 32, 2000, 0.01, 0),
    } and blocks.count() == 4


def arrived(spark, lines, checkpoint):
    """What a stream of lines brings, batch by batch: (file, split, rank in the split, bytes of the text, time)."""
    batches = []

    def take(batch, _):
        rows = jobs.placed(batch).select("file", "block_start", "line_no", F.hex(F.col("value").cast("binary")).alias("hex"), "mtime").collect()
        batches.append([(r["file"], r["block_start"], r["hex"], r["mtime"]) for r in sorted(rows, key=lambda r: (r["file"], r["block_start"], r["line_no"]))])

    drain(lines.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True))
    return batches


def test_listed_files_give_the_lines_of_the_text_source(spark, tmp_path, monkeypatch):
    """Odd names, bytes that are no UTF-8, marks, long lines and cut splits; a later call brings only what is new."""
    from meterwork.sources import lines as source

    root = tmp_path / "my logs+%41 é"
    texts = {"a.jsonl": b"\xef\xbb\xbf1\r\n\n \xef\xbb\xbf2\n", "deep/b [1]{x}.jsonl": b"\xff\xfe\n" + b"x" * 300 + b"\nlast", "empty.jsonl": b"", "_c=1/c+%20.jsonl": b"3\n",
             "deep/_hidden/d.jsonl": b"4\n", ".e.jsonl": b"5\n", "f.jsonl.txt": b"6\n", "g.jsonl": b"\n".join(b"%d" % k for k in range(300)) + b"\n"}
    for name, text in texts.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text)
    (root / "gone.jsonl").symlink_to(root / "was here")
    [text] = arrived(spark, jobs.stream_lines(spark, str(root)), f"{tmp_path}/text")
    [listed] = arrived(spark, jobs.stream_lines(spark, str(root), listed=f"{tmp_path}/lists"), f"{tmp_path}/checkpoint")
    assert listed == text and {f.removeprefix(f"file://{root}/") for f, *_ in text} == {"a.jsonl", "deep/b [1]{x}.jsonl", "_c=1/c+%20.jsonl", "g.jsonl"}
    with monkeypatch.context() as other:  # as on a file system that tasks do not mount
        other.setattr(jobs, "mounted", lambda *_: None)
        assert arrived(spark, jobs.stream_lines(spark, str(root), listed=f"{tmp_path}/unused"), f"{tmp_path}/other") == [text] and not (tmp_path / "unused").exists()
    monkeypatch.setattr(source, "SPLIT_BYTES", 16)
    [cut] = arrived(spark, jobs.stream_lines(spark, str(root), listed=f"{tmp_path}/cut"), f"{tmp_path}/cut-checkpoint")
    assert [(f, x, t) for f, _, x, t in cut] == [(f, x, t) for f, _, x, t in text] and len({(f, s) for f, s, *_ in cut}) > 60
    assert arrived(spark, jobs.stream_lines(spark, str(root), listed=f"{tmp_path}/lists"), f"{tmp_path}/checkpoint") == []
    (root / "deep" / "new.jsonl").write_bytes(b"7\n")
    [new] = arrived(spark, jobs.stream_lines(spark, str(root), listed=f"{tmp_path}/lists"), f"{tmp_path}/checkpoint")
    assert [(f, x) for f, _, x, _ in new] == [(f"file://{root}/deep/new.jsonl", "37")]


def test_lists_are_bounded_and_in_the_order_of_time(spark, tmp_path):
    import os

    (tmp_path / "in").mkdir()
    for k in range(60):
        (tmp_path / "in" / f"{k:02d}.jsonl").write_bytes(b"0123456789\n")
        os.utime(tmp_path / "in" / f"{k:02d}.jsonl", (1_700_000_000 - k, 1_700_000_000 - k))
    for name, options in (("bytes", {"bytes_per_batch": 20 * (11 + 4096)}), ("count", {"files_per_batch": 20})):
        batches = arrived(spark, jobs.stream_lines(spark, f"{tmp_path}/in", listed=f"{tmp_path}/{name}", **options), f"{tmp_path}/{name}-checkpoint")
        assert [sorted({f[-8:-6] for f, *_ in b}) for b in batches] == [[f"{k:02d}" for k in range(n, n + 20)] for n in (40, 20, 0)]
    (tmp_path / "none").mkdir()
    assert arrived(spark, jobs.stream_lines(spark, f"{tmp_path}/none", listed=f"{tmp_path}/nothing"), f"{tmp_path}/nothing-checkpoint") == []
    with pytest.raises(FileNotFoundError):
        jobs.stream_lines(spark, f"{tmp_path}/not there", listed=f"{tmp_path}/nothing")


def test_the_driver_holds_no_file_of_a_listed_stream(streaming, tmp_path):
    """Rollouts in many files: the offsets of the stream, the plan of a batch and its tasks do not grow with the files."""
    spark = streaming
    (tmp_path / "in").mkdir()
    row = '{"timestamp":"2026-07-10T09:00:%02dZ","type":"event_msg","payload":{"type":"token_count","info":{"last_token_usage":{"input_tokens":%d}}}}\n'
    for k in range(600):
        (tmp_path / "in" / f"u{k}.jsonl").write_text(row % (k % 60, k % 300 + 1))
    lines = jobs.stream_lines(spark, f"{tmp_path}/in", listed=f"{tmp_path}/listed")
    drain(jobs.codex_text_job(lines, f"{tmp_path}/work"))
    usage = jobs.codex_facts(spark, f"{tmp_path}/work").usage
    assert usage.agg(F.sum("input_tokens"), F.count("*")).first()[:] == (300 * 301 // 2, 300)
    seen = [p.read_text() for p in (tmp_path / "work" / "rollouts-checkpoint" / "sources").rglob("*") if p.is_file() and not p.name.startswith(".")]
    assert sum(x.count('"path"') for x in seen) == 1 and not any("/in/u" in x for x in seen)
