"""One small log per agent with hand-computed counts."""

import json

import pytest

from meterwork.operators.usage import SESSION_COLUMNS, TOOL_COLUMNS, USAGE_COLUMNS, Facts
from meterwork.plans import agents
from meterwork.sources import antigravity, documents, json_lines, tables
from meterwork.sources.lines import read_documents, read_lines

from .conftest import by_session, records

TS = "2026-07-10T10:00:00.000Z"


def counts(facts: Facts):
    """(input, cache read, cache write, output, turns) summed over everything."""
    total = [0] * 5
    for models in by_session(facts.usage).values():
        for row in models.values():
            total = [a + b for a, b in zip(total, row)]
    return tuple(total)


def test_pi_and_canonical_columns(lines):
    row = {"timestamp": TS, "message": {"role": "assistant", "model": "gpt-5", "usage": {"input": 100, "output": 20, "cacheRead": 50, "cacheWrite": 5}}}
    facts = json_lines.pi(lines({"p": [row, "null", "[]", "", "junk"]}))
    assert by_session(facts.usage) == {"p": {"gpt-5": (100, 50, 5, 20, 1)}}
    assert [d.columns for d in facts] == [USAGE_COLUMNS, TOOL_COLUMNS, SESSION_COLUMNS]


def test_openclaw_model_line(lines):
    log = [{"type": "model_change", "data": {"modelId": "glm-4.6"}},
           {"type": "message", "timestamp": TS, "message": {"role": "assistant", "usage": {"input": 200, "output": 40, "cacheRead": 10, "cacheWrite": 2}}}]
    assert by_session(json_lines.openclaw(lines({"o": log})).usage) == {"o": {"glm-4.6": (200, 10, 2, 40, 1)}}


def test_qwen_and_gemini(lines):
    q = {"model": "q", "timestamp": TS, "usageMetadata": {"promptTokenCount": 1000, "candidatesTokenCount": 200, "thoughtsTokenCount": 50, "cachedContentTokenCount": 400}}
    assert counts(json_lines.qwen(lines({"q": [q, q]}))) == (600, 400, 0, 250, 1)
    g = lambda p, o, **x: {"model": "g", "timestamp": TS, "tokens": {"prompt": p, "candidates": o, **x}}
    assert counts(json_lines.gemini(lines({"g": [g(800, 100, cached=200, thoughts=30)]}))) == (800, 200, 0, 130, 1)
    assert counts(json_lines.gemini(lines({"g": [g(800, 100), g(500, 60)]}))) == (1300, 0, 0, 160, 2)
    doc = {"model": "doc-model", "messages": [{"tokens": {"input": 1}}, {"model": "own", "tokens": {"input": "2"}}], "tokens": {"input": 4}}
    both = json_lines.gemini(lines({}), lines({"d": [doc]}))
    assert {m: v[0] for m, v in by_session(both.usage)["d"].items()} == {"doc-model": 5, "own": 2}


def test_kimi_depth_order_and_roots(lines):
    usage = {"inputOther": 400, "output": 70, "inputCacheRead": 25, "inputCacheCreation": 5}
    row = {"model": "k", "timestamp": TS, "message": {"id": "msg-1", "payload": {"usage": usage}}}
    assert counts(json_lines.kimi(lines({"r1/wire": [row], "r2/wire": [row]}))) == (400, 25, 5, 70, 1)
    text = json.dumps(usage)
    tricky = {"z": {"text": text, "deep": {"inputOther": 1, "output": 0}}, "a": usage}
    assert counts(json_lines.kimi(lines({"w": [tricky]}))) == (1, 0, 0, 0, 1)
    seven = {"a": {"a": {"a": {"a": {"a": {"a": {"a": usage}}}}}}}
    assert counts(json_lines.kimi(lines({"w": [seven]}))) == (0, 0, 0, 0, 0)


def test_copilot(lines):
    def span(rid, i, **x):
        return {"spanId": "s", "timestamp": TS, "attributes": {"gen_ai.response.id": rid, "gen_ai.response.model": "gpt-5", "gen_ai.conversation.id": "conv-1",
                "gen_ai.usage.input_tokens": i, "gen_ai.usage.output_tokens": 20, **x}}
    extra = {"gen_ai.usage.reasoning.output_tokens": 5, "gen_ai.usage.cache_read.input_tokens": 300}
    facts = json_lines.copilot(lines({"o": [span("r1", 100, **extra), span("r1", 100, **extra), span("r2", 50)]}))
    assert by_session(facts.usage) == {"conv-1": {"gpt-5": (150, 300, 0, 45, 2)}}
    wrapped = {"attributes": {"gen_ai.request.model": {"stringValue": "gpt-5-mini"}, "session.id": {"stringValue": "w"},
               "gen_ai.usage.input_tokens": {"intValue": "400"}, "gen_ai.usage.output_tokens": {"intValue": 60}}}
    assert by_session(json_lines.copilot(lines({"o": [wrapped]})).usage) == {"w": {"gpt-5-mini": (400, 0, 0, 60, 1)}}


def test_droid_codebuff(lines):
    d = {"model": "m", "tokenUsage": {"inputTokens": 300, "outputTokens": 60, "cacheReadTokens": 20, "cacheCreationTokens": 4, "thinkingTokens": 10}}
    facts = documents.droid(lines({"x.settings.json": [d]}))
    assert counts(facts) == (300, 20, 4, 70, 1)
    assert records(facts.usage)[0]["ts_raw"] == "2026-07-20T00:00:00.000Z"
    said = {"role": "assistant", "id": "1", "metadata": {"model": "gpt-5", "usage": {"inputTokens": 500, "outputTokens": 80, "cacheReadInputTokens": 30}}}
    chat = [{"role": "user"}, said, said, {**said, "variant": "user"}]
    assert counts(documents.codebuff(lines({"c": [chat]}))) == (1000, 60, 0, 160, 2)
    assert counts(documents.codebuff(lines({"c": [chat]}), dedup=True)) == (500, 30, 0, 80, 1)


def test_amp(lines):
    msg = lambda i, cr, cw: {"messageId": i, "role": "assistant", "model": "gpt-5", "timestamp": TS, "usage": {"inputTokens": 200, "outputTokens": 30, "cacheReadInputTokens": cr, "cacheCreationInputTokens": cw}}
    ledger = {"id": "T1", "messages": [msg(5, 1, 1), msg(5, 900, 40)], "usageLedger": {"events": [
        {"model": "m", "timestamp": TS, "toMessageId": 5, "tokens": {"input": 100, "output": 50}}, {"tokens": {"input": 1}, "toMessageId": "5"}]}}
    facts = documents.amp(lines({"a": [ledger], "b": [{"messages": [msg(1, 10, 0)]}]}))
    assert by_session(facts.usage) == {"T1": {"m": (100, 900, 40, 50, 1), "amp-unknown": (1, 0, 0, 0, 1)}, "b": {"gpt-5": (200, 10, 0, 30, 1)}}


def test_opencode(lines):
    tokens = {"input": 1_000_000, "output": 100_000, "reasoning": 0, "cache": {"read": 500_000, "write": 20_000}}
    good = {"sessionID": "s1", "role": "assistant", "modelID": "claude-sonnet-4-6", "time": {"created": 1783677600000}, "tokens": tokens}
    messages = {"m1": [good], "m2": [{**good, "role": "user"}], "m3": [{**good, "modelID": None}], "m4": [{**good, "tokens": {}, "sessionID": "s2"}]}
    sessions = {"a": [{"id": "s1", "directory": "/home/me/web"}], "b": [{"id": "s2", "projectID": "p"}], "c": [{"id": "s1", "directory": ""}]}
    facts = documents.opencode(lines(messages), lines(sessions), lines({"p": [{"id": "p", "worktree": "/tree"}]}))
    assert by_session(facts.usage) == {"s1": {"claude-sonnet-4-6": (1_000_000, 500_000, 20_000, 100_000, 1)}, "s2": {"claude-sonnet-4-6": (0, 0, 0, 0, 1)}}
    assert {r["session_id"]: r["cwd"] for r in records(facts.sessions)} == {"s1": "/home/me/web", "s2": "/tree"}


def test_tables(spark):
    data = lambda o, r: json.dumps({"role": "assistant", "modelID": "m", "tokens": {"input": 100, "output": o, "reasoning": r, "cache": {"read": 50, "write": 10}}})
    rows = [("1", data(20, 5), "s"), ("2", data(30, 5), "s"), ("3", json.dumps({"role": "user"}), "s"), ("4", None, "s")]
    facts = tables.kilo(spark.createDataFrame(rows, "id string, data string, session_id string"))
    assert by_session(facts.usage) == {"s": {"m": (200, 100, 20, 60, 2)}}
    goose = spark.createDataFrame(
        [(1000, 180, 1200, 1, 1, 1, '{"model_name":"gpt-5"}', TS), (0, None, 0, 400, 90, 500, "{bad", TS)],
        "accumulated_input_tokens long, accumulated_output_tokens long, accumulated_total_tokens long, input_tokens long, output_tokens long, total_tokens long, model_config_json string, created_at string")
    assert by_session(tables.goose(goose).usage) == {"goose": {"gpt-5": (1000, 0, 0, 200, 1), "goose-unknown": (400, 0, 0, 100, 1)}}
    hermes = spark.createDataFrame([("h", 1783677600.5, 1000, 200, 30, 500, 50)],
        "model string, started_at double, input_tokens long, output_tokens long, reasoning_tokens long, cache_read_tokens long, cache_write_tokens long")
    facts = tables.hermes(hermes)
    assert counts(facts) == (1000, 500, 50, 230, 1)
    assert records(facts.usage)[0]["ts_raw"].startswith("2026-07-10T10:00:00.5")


def test_antigravity(spark, lines):
    mark = antigravity.MARKER.encode()
    named = mark + b"\x01Gemini 3.1 Pro (High)" + b"\x00" * 250
    content = named + named + mark + b"\x00" * 250 + b"z" * 8000
    conversations = spark.createDataFrame([("c1", bytearray(content)), ("none", bytearray(b"no marker"))], "conversation_id string, content binary")
    history = lines({"h": [{"timestamp": 1783677600000, "workspace": "/home/me/rocket", "conversationId": "c1"}, {"timestamp": 0, "conversationId": "c1"}]})
    facts = antigravity.load(conversations, history)
    [(model, row)] = by_session(facts.usage)["c1"].items()
    assert model == "gemini-3.1-pro" and row[4] == 3 and row[0] > 1000 and row[3] > 100
    [s] = records(facts.sessions)
    assert s["cwd"] == "/home/me/rocket" and s["first_ts"] == TS


def test_registry_and_extension(spark):
    assert agents.find(" claude CODE ").id == "claude" and agents.find("nope") is None
    dim = {r["agent_id"]: r for r in records(agents.agent_dim(spark))}
    assert len(dim) == 17 and not dim["cursor"]["supported"] and "server-side" in dim["cursor"]["unsupported_reason"]
    assert dim["antigravity"]["estimated"]
    wrong = agents.adapter("claude", "Claude Code")(lambda: Facts(*[spark.range(1)] * 3))
    with pytest.raises(ValueError):
        wrong()
    from meterwork.sources import claude

    agents.adapter("claude", "Claude Code")(claude.load)


def test_readers(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "a.jsonl").write_text('{"a":1}\r\nbad\n\n{"a":2}')
    (tmp_path / "deep" / "b.json").write_text('{\n "a": 3\n}')
    got = records(read_lines(spark, str(tmp_path)).orderBy("line_no"))
    assert [r["value"].strip() for r in got] == ['{"a":1}', "bad", "", '{"a":2}']
    assert got[0]["file"].endswith("/deep/er/a.jsonl")
    assert len(records(read_documents(spark, [str(tmp_path)]))) == 1
    assert read_lines(spark, str(tmp_path), modified_after="2100-01-01T00:00:00").count() == 0
