"""Transcripts: growing messages, copies, tool calls."""

import pytest
from pyspark.sql import functions as F

from meterwork.operators.ordered import line_chunk
from meterwork.operators.usage import tool_cube
from meterwork.sources import claude

from .conftest import by_session, records

OPUS = "claude-opus-4-8"


def line(ts=None, mid=None, usage=None, content=None, cwd=None, model=OPUS):
    msg = {k: v for k, v in {"id": mid, "model": model, "usage": usage, "content": content}.items() if v is not None}
    out = {"type": "assistant", "message": msg}
    if ts:
        out["timestamp"] = ts
    if cwd:
        out["cwd"] = cwd
    return out


def use(i=0, o=0, cr=0, cw=0, hour=0):
    u = {"input_tokens": i, "output_tokens": o, "cache_read_input_tokens": cr, "cache_creation_input_tokens": cw}
    if hour:
        u["cache_creation"] = {"ephemeral_5m_input_tokens": 0, "ephemeral_1h_input_tokens": hour}
    return u


def tool(name, call=None):
    return {"type": "tool_use", "name": name, **({"id": call} if call else {}), "input": {"x": 1}}


def tools_of(facts):
    return {r["tool_name"]: (r["calls"], r["cost_usd"]) for r in records(
        tool_cube(facts.tools).groupBy("tool_name").agg(F.sum("calls").alias("calls"), F.sum("cost_usd").alias("cost_usd")))}


def test_accumulates_and_skips_junk(lines):
    facts = claude.load(lines({"a.jsonl": [
        line("2026-07-01T10:00:00Z", usage=use(100, 200, 30000, 50), content=[{"type": "text"}, tool("mcp__ctx__query-docs"), tool("Read")]),
        {"type": "user", "message": {"content": "assistant"}},
        "not json assistant",
        "null assistant",
        line("2026-07-01T11:00:00Z", usage=use(10, 20), content=[tool("Read")]),
    ]}))
    assert by_session(facts.usage) == {"a.jsonl": {OPUS: (110, 30000, 50, 220, 2)}}
    got = tools_of(facts)
    assert got["Read"][0] == 2 and got["mcp__ctx__query-docs"][0] == 1
    assert got["mcp__ctx__query-docs"][1] == pytest.approx(0.01040625, abs=1e-9)
    assert got["Read"][1] == pytest.approx(0.01040625 + 0.00055, abs=1e-9)
    [s] = records(facts.sessions)
    assert (s["first_ts"], s["last_ts"]) == ("2026-07-01T10:00:00Z", "2026-07-01T11:00:00Z")


def test_growing_stream_counts_the_maximum(lines):
    rows = [line("2026-07-01T10:00:00Z", "msg_grow", use(10, o, 0, 100, 100)) for o in (1, 1, 638)]
    facts = claude.load(lines({"a": rows}))
    [r] = records(facts.usage.groupBy().sum("output_tokens", "input_tokens", "cache_write_tokens", "cache_write_1h_tokens", "turns"))
    assert list(r.values()) == [638, 10, 100, 100, 1]


def test_split_message_counts_once_but_keeps_its_tools(lines):
    blocks = [[{"type": "thinking"}], [tool("Read", "t1")], [tool("Bash", "t2")]]
    facts = claude.load(lines({"a": [line("2026-07-01T10:00:00Z", "msg_1", use(100, 50), b) for b in blocks]}))
    assert by_session(facts.usage) == {"a": {OPUS: (100, 0, 0, 50, 1)}}
    got = tools_of(facts)
    assert got["Read"] == (1, 0.0) and got["Bash"] == (1, 0.0)


def test_copies_in_a_resumed_session(lines):
    copy = line("2026-07-01T10:00:00Z", "m1", use(100, 50), [tool("Bash", "toolu_same")])
    other = line("2026-07-01T10:05:00Z", "m2", use(7, 5), [tool("Bash", "toolu_same")])
    facts = claude.load(lines({"a": [copy], "b": [copy, other]}))
    assert by_session(facts.usage) == {"a": {OPUS: (100, 0, 0, 50, 1)}, "b": {OPUS: (7, 0, 0, 5, 1)}}
    assert tools_of(facts)["Bash"][0] == 1


def test_wrong_numbers_are_zero_and_wrong_shapes_drop_the_line(lines):
    good = {"type": "assistant", "message": {"model": OPUS, "usage": {"input_tokens": "100", "output_tokens": 5, "cache_creation": None}}}
    bad = [
        {"type": "assistant", "cwd": None, "message": {"usage": {"input_tokens": 1}}},
        {"type": "assistant", "message": {"usage": [1]}},
        {"type": "assistant", "message": {"content": "text"}},
        {"type": "assistant", "message": {"content": [{"type": "tool_use", "id": 5}]}},
        {"type": "assistant"},
    ]
    facts = claude.load(lines({"a": [good, *bad]}))
    assert by_session(facts.usage) == {"a": {OPUS: (0, 0, 0, 5, 1)}}


def test_synthetic_lines_keep_tools_and_times(lines):
    facts = claude.load(lines({"a": [line("2026-07-01T10:00:00Z", "m", use(9, 9), [tool("Read")], "/w", "<synthetic>")]}))
    assert facts.usage.count() == 0
    assert tools_of(facts) == {"Read": (1, 0.0)}
    assert records(facts.sessions)[0]["cwd"] == "/w"


def test_chunked_state_equals_one_pass(lines):
    """A hot message id split over many chunks gives what a sequential pass gives."""
    import random

    rng = random.Random(4)
    rows, seen, want = [], {}, {}
    for i in range(400):
        mid = "hot" if rng.random() < 0.5 else f"m{rng.randrange(40)}"
        vals = [rng.randrange(100) for _ in range(4)]
        rows.append(line(f"2026-07-{1 + i // 100:02d}T10:00:00Z", mid, use(*vals)))
        high = seen.setdefault(mid, [0] * 4)
        day = want.setdefault(f"2026-07-{1 + i // 100:02d}", [0] * 4)
        for j, x in enumerate(vals):
            day[j] += max(0, x - high[j])
            high[j] = max(high[j], x)
    facts = claude.load(lines({"a": rows}), chunk=line_chunk(7))
    got = {r["day"]: [r["i"], r["o"], r["r"], r["w"]] for r in records(facts.usage.groupBy("day").agg(
        F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"), F.sum("cache_read_tokens").alias("r"), F.sum("cache_write_tokens").alias("w")))}
    assert got == want


def test_zone_moves_the_day(lines):
    log = lines({"a": [line("2026-07-17T23:30:00Z", usage=use(1, 1))]})
    assert records(claude.load(log).usage)[0]["day"] == "2026-07-17"
    assert records(claude.load(log, zone="Asia/Amman").usage)[0]["day"] == "2026-07-18"


def test_last_context(lines):
    log = lines({"a": [line(usage=use(5, 1, 10, 20)), line(usage=use(7, 1, 1, 2)), {"message": {"usage": {"input_tokens": "x"}}}]})
    assert records(claude.last_context(log)) == [{"session_id": "a", "context_tokens": 10}]
