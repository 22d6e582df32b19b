"""Rollouts: snapshots, forks, headless lines."""

import pytest
from pyspark.sql import functions as F

from meterwork.operators.ordered import line_chunk
from meterwork.operators.usage import tool_cube
from meterwork.sources import codex

from .conftest import by_session, records


def token(ts, total=None, last=None, **extra):
    name = lambda v: dict(zip(("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens"), v))
    info = {k: name(v) for k, v in {"total_token_usage": total, "last_token_usage": last}.items() if v}
    return {"timestamp": ts, "type": "event_msg", "payload": {"type": "token_count", "info": info, **extra}}


def context(model):
    return {"timestamp": "2026-07-10T09:00:00Z", "type": "turn_context", "payload": {"model": model, "cwd": "/home/me/api"}}


def call(name, kind="function_call"):
    return {"timestamp": "2026-07-10T09:00:30Z", "type": "response_item", "payload": {"type": kind, "name": name}}


def tools_of(facts):
    return {(r["session_id"], r["tool_name"]): (r["calls"], round(r["cost_usd"], 9)) for r in records(tool_cube(facts.tools))}


def test_cumulative_difference(lines):
    facts = codex.load(lines({"a.jsonl": [
        context("gpt-5-codex"),
        call("", "local_shell_call"),
        token("2026-07-10T09:01:00Z", (1_000_000, 400_000, 50_000)),
        token("2026-07-10T09:01:01Z", (1_000_000, 400_000, 50_000)),
        token("2026-07-10T09:02:00Z", (1_500_000, 800_000, 80_000)),
    ]}))
    assert by_session(facts.usage) == {"a.jsonl": {"gpt-5-codex": (700_000, 800_000, 0, 80_000, 2)}}
    got = tools_of(facts)[("a.jsonl", "shell")]
    assert got[0] == 1 and got[1] > 0
    [s] = records(facts.sessions)
    assert s["cwd"] == "/home/me/api" and s["last_ts"] == "2026-07-10T09:02:00Z"
    long = records(facts.usage.groupBy().sum("long_input_tokens", "long_cache_read_tokens", "long_output_tokens"))[0]
    assert list(long.values()) == [700_000, 800_000, 80_000]


def test_fork_copy_is_dropped(lines):
    event = token("2026-07-10T09:01:00.123Z", None, (13501, 11648, 433, 104))
    facts = codex.load(lines({"parent": [context("gpt-5"), event], "z-fork": [context("gpt-5"), call("x"), event, call("x")]}))
    assert by_session(facts.usage) == {"parent": {"gpt-5": (1853, 11648, 0, 433, 1)}}
    assert tools_of(facts) == {("z-fork", "x"): (2, 0.0)}


def test_replayed_burst_is_skipped(lines):
    first, second = (50_000, 10_000, 1_000), (90_000, 40_000, 5_000)
    parent = [context("gpt-5"), token("2026-07-10T09:01:00Z", first), token("2026-07-10T09:02:00Z", second)]
    fork = [
        {"timestamp": "2026-07-10T10:00:00Z", "type": "session_meta", "payload": {"source": "thread_spawn"}},
        context("gpt-5"),
        token("2026-07-10T10:00:01.100Z", first),
        token("2026-07-10T10:00:01.200Z", second),
        token("2026-07-10T10:05:00Z", (190_000, 100_000, 13_000)),
    ]
    want = {"parent": {"gpt-5": (50_000, 40_000, 0, 5_000, 2)}, "z": {"gpt-5": (40_000, 60_000, 0, 8_000, 1)}}
    log = lines({"parent": parent, "z": fork})
    assert by_session(codex.load(log).usage) == want
    assert by_session(codex.load(log, chunk=line_chunk(2)).usage) == want


def test_marker_behind_the_probe_is_ignored(lines):
    filler = ["x" * 9000, "y" * 9000]
    marker = {"type": "session_meta", "payload": {"forked_from_id": "p"}}
    burst = [token("2026-07-10T10:00:01.100Z", None, (10, 0, 1)), token("2026-07-10T10:00:01.200Z", None, (20, 0, 2))]
    assert codex.load(lines({"a": [*filler, marker, *burst]})).usage.count() == 2
    assert codex.load(lines({"a": [filler[0], marker, *burst]})).usage.count() == 0


def test_headless_lines(lines):
    facts = codex.load(lines({"h": [
        {"type": "done", "created_at": 1_752_138_000, "model": "gpt-5-mini", "usage": {"prompt_tokens": "40", "completion_tokens": 7, "cached_tokens": 50}},
        {"type": "done", "data": {"usage": {"input": 3, "output": 2}, "createdAt": "2026-07-11T01:00:00Z"}},
        {"type": "done", "usage": {}, "result": {"usage": {"input": 9}}},
        {"type": "done", "response": {"usage": {"input": 1}}},
    ]}))
    assert by_session(facts.usage) == {"h": {"gpt-5-mini": (4, 40, 0, 9, 3)}}
    assert sorted(r["ts_raw"] for r in records(facts.usage)) == [
        "2025-07-10T09:00:00.000Z", "2026-07-11T01:00:00.000Z", "2026-07-20T00:00:00.000Z"]


def test_tools_share_the_next_event(lines):
    facts = codex.load(lines({"a": [
        context("gpt-5"), call("p"), call("p"), call("q"), token("2026-07-10T09:01:00Z", None, (1_000_000, 0, 0)),
        token("2026-07-10T09:01:30Z", None, (0, 0, 0)), call("q"), token("2026-07-10T09:02:00Z", None, (200_000, 0, 0)), call("q"),
    ]}), chunk=line_chunk(3))
    got = tools_of(facts)
    assert got[("a", "p")] == (2, pytest.approx(2.5 * 2 / 3, abs=1e-6))
    assert got[("a", "q")] == (3, pytest.approx(2.5 / 3 + 0.25, abs=1e-6))


def test_sticky_and_auto_review_models(lines):
    facts = codex.load(lines({"a": [
        token("2026-07-10T09:00:00Z", None, (1, 0, 0)),
        token("2026-07-10T09:00:01Z", None, (0, 0, 0), model="ignored"),
        token("2026-07-10T09:00:02Z", None, (2, 0, 0)),
        context("codex-auto-review"),
        token("2025-10-01T09:00:00Z", None, (4, 0, 0)),
        token("2026-03-05T09:00:00Z", None, (8, 0, 0)),
        token("2026-02-30T09:00:00Z", None, (16, 0, 0)),
        token("2024-01-01T09:00:00Z", None, (32, 0, 0)),
        token("2024-01-01T09:00:00Z", None, (64, 0, 0), model="gpt-5.5"),
        token("2024-01-02T09:00:00Z", None, (128, 0, 0)),
    ]}))
    got = {m: v[0] for m, v in by_session(facts.usage)["a"].items()}
    assert got == {"gpt-5": 1 + 2 + 16 + 32, "gpt-5-codex": 4, "gpt-5.4": 8, "gpt-5.5": 64 + 128}


def test_home_prefers_active_files(spark, tmp_path):
    import json

    home = tmp_path / "home"
    for folder, amount in (("sessions", 5), ("archived_sessions", 9)):
        for rel in ("2026/a.jsonl",) if folder == "sessions" else ("2026/a.jsonl", "2026/b.jsonl"):
            f = home / folder / rel
            f.parent.mkdir(parents=True, exist_ok=True)
            f.write_text(json.dumps(token("2026-07-10T09:00:00Z", None, (amount, 0, 0))) + "\r\n\n")
    (home / "loose.jsonl").write_text(json.dumps(token("2026-07-10T09:00:00Z", None, (77, 0, 0))))
    facts = codex.load(codex.read_home(spark, str(home)))
    assert sorted(r["input_tokens"] for r in records(facts.usage)) == [5, 9]
    plain = tmp_path / "plain"
    plain.mkdir()
    (plain / "x.jsonl").write_text(json.dumps(token("2026-07-10T09:00:00Z", None, (3, 0, 0))))
    assert records(codex.load(codex.read_home(spark, str(plain))).usage)[0]["input_tokens"] == 3
