"""Files listed, chosen and read."""

import json
import os
import random

import pytest

from meterwork.plans import agents
from meterwork.sources import codex
from meterwork.sources.files import LogFiles, home_files, list_files, read_listed
from meterwork.sources.lines import fault_places, judged, line_report, read_lines, with_places

from .conftest import by_session, records


def put(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(root)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_listing_opens_nothing_and_spells_paths_plainly(spark, tmp_path):
    root = put(tmp_path / "my logs+%41 é", {"a b/x[1].jsonl": "1\n", "a b/deep/y.jsonl": "22\n", "z.txt": "z", "empty.jsonl": ""})
    files = list_files(spark, [root, str(tmp_path / "none")])
    got = {r["rel"]: r for r in records(files)}
    assert {k: r["size"] for k, r in got.items()} == {"a b/x[1].jsonl": 2, "a b/deep/y.jsonl": 3, "z.txt": 1}
    assert got["z.txt"]["path"] == f"file://{root}/z.txt" and got["z.txt"]["root"] == f"file://{root}"
    read = records(read_listed(files.filter("rel <> 'z.txt'")))
    assert {(r["file"], r["value"]) for r in read} == {(f"file://{root}/a b/x[1].jsonl", "1"), (f"file://{root}/a b/deep/y.jsonl", "22")}
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root.replace("[", "\\[")).select("path", "length")
    assert "content" not in plan_of(listing).split("ReadSchema")[1]
    assert list_files(spark, str(tmp_path / "none")).count() == 0 and read_listed(list_files(spark, str(tmp_path / "none"))).count() == 0


def test_twins_times_and_one_scan(spark, tmp_path):
    row = lambda n: json.dumps({"timestamp": "2026-07-10T09:00:00Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": n}}}}) + "\n"
    one = put(tmp_path / "one", {"sessions/a.jsonl": row(1), "archived_sessions/a.jsonl": row(2), "archived_sessions/b.jsonl": row(4), "loose.jsonl": row(8), "sessions/c.txt": row(16)})
    two = put(tmp_path / "two", {"x/y.jsonl": row(32), "old.jsonl": row(64)})
    os.utime(f"{two}/old.jsonl", (1_500_000_000, 1_500_000_000))
    lines = codex.read_home(spark, [one, two], modified_after="2018-01-01T00:00:00")
    assert plan_of(lines).count("FileScan") == 1
    assert sorted(r["input_tokens"] for r in records(codex.load(lines).usage)) == [1, 4, 32]
    ranks = {r["rel"]: r["rank"] for r in records(home_files(spark, one, codex.LOGS))}
    assert ranks == {"a.jsonl": 0, "b.jsonl": 1}


def test_agents_find_their_own_files(spark, tmp_path):
    usage = {"inputOther": 7, "output": 1}
    kimi = json.dumps({"model": "k", "id": "1", "timestamp": "2026-07-10T09:00:00Z", "usage": usage}) + "\n"
    doc = json.dumps({"model": "g", "tokens": {"input": 5}})
    home = put(tmp_path / "h", {
        ".kimi/sessions/a/wire.jsonl": kimi, ".kimi-code/sessions/wire.jsonl": kimi.replace('"1"', '"2"'), ".kimi/wire.jsonl": kimi.replace('"1"', '"3"'),
        ".kimi/sessions/a/other.jsonl": kimi.replace('"1"', '"4"'), ".gemini/tmp/s/chat.json": doc, ".gemini/tmp/s/log.jsonl": doc.replace("5", "6") + "\n" + "null\n",
        ".openclaw/x.jsonl.2": json.dumps({"type": "message", "id": "1", "message": {"model": "m", "usage": {"input": 3}}}) + "\n"})
    total = lambda facts: sum(sum(v[0] for v in m.values()) for m in by_session(facts.usage).values())
    assert [total(agents.read_agent(spark, a, home)) for a in ("kimi", "gemini", "openclaw", "claude")] == [14, 11, 3, 0]
    with pytest.raises(ValueError):
        agents.read_agent(spark, "kilo", home)
    assert LogFiles((".x",), "y").kind == "lines"


def test_faults_are_counted_and_placed(spark, tmp_path):
    root = put(tmp_path / "l", {"a.jsonl": b'{"a":1}\r\n\n {"b"\nnull\n{"t":"\xff\xfe"}\n  \n{"cut":', "b.jsonl": b"", "c.jsonl": '{"é":1}\nbad'})
    lines = read_lines(spark, root)
    report = {r["file"].rsplit("/", 1)[1]: [r[c] for c in ("lines", "read", "blank", "malformed", "null")] for r in records(line_report(lines))}
    assert report == {"a.jsonl": [7, 2, 2, 2, 1], "c.jsonl": [2, 1, 0, 1, 0]}
    places = {(r["file"].rsplit("/", 1)[1], r["line"]): r["byte_at"] for r in records(with_places(lines))}
    assert [places["a.jsonl", k] for k in range(5)] == [0, 9, 10, 16, 21] and places["c.jsonl", 1] == 9
    assert judged(lines).filter("fault IS NULL").count() == 3


def test_places_do_not_depend_on_splits(spark, tmp_path):
    rng = random.Random(1)
    text = [json.dumps({"n": i, "x": "é" * rng.randrange(60)}, ensure_ascii=False) for i in range(3000)]
    root = put(tmp_path / "big", {"one.jsonl": "\n".join(text) + "\n"})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        lines = read_lines(spark, root)
        assert lines.rdd.getNumPartitions() > 5
        got = {r["line"]: (r["byte_at"], r["value"]) for r in records(with_places(lines))}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    at = 0
    for i, value in enumerate(text):
        assert got[i] == (at, value)
        at += len(value.encode()) + 1


def test_checked_logs_are_written_by_tasks(spark, tmp_path):
    """Files stand under their own names, in line order, in a folder that may hold others; nothing else is left there."""
    from checks.files import OLD_MS, write_logs

    for k in (1, 2):
        rows = [(f"/h {k}/u{u}%.jsonl", n, f"é{u}-{n}" if n else None) for n in (2, 0, 1) for u in range(30)]
        write_logs(spark.createDataFrame(rows, "file string, line_no bigint, value string"), f"{tmp_path}/in", old="u7%")
    found = {str(p.relative_to(tmp_path)): p for p in tmp_path.rglob("*") if p.is_file()}
    assert set(found) == {f"in/h {k}/u{u}%.jsonl" for k in (1, 2) for u in range(30)}
    assert all(p.read_text() == f"\né{n[8:].split('%')[0]}-1\né{n[8:].split('%')[0]}-2\n" for n, p in found.items())
    assert {n for n, p in found.items() if p.stat().st_mtime * 1000 == OLD_MS} == {"in/h 1/u7%.jsonl", "in/h 2/u7%.jsonl"}


def test_faults_are_placed_in_one_scan(spark, tmp_path):
    root = put(tmp_path, {"a.jsonl": '{"é":1}\n \nnull\n{"b":\n{}\n', "b.jsonl": "x\n"})
    placed = fault_places(read_lines(spark, root))
    got = {(r["file"].rsplit("/", 1)[1], r["line"], r["byte_at"], r["fault"]) for r in records(placed)}
    assert got == {("a.jsonl", 1, 9, "blank"), ("a.jsonl", 2, 11, "null"), ("a.jsonl", 3, 16, "malformed"), ("b.jsonl", 0, 0, "malformed")}
    assert "jsonl" not in plan_of(placed) and "value" not in plan_of(placed)


def test_many_paths_are_looked_up_in_few_tasks(spark):
    from meterwork.session import use_settings

    assert int(use_settings(spark).conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) <= 100
