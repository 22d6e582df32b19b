"""Sources that log one usage object per JSON line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import coerce as c
from ..functions.times import iso
from ..operators.dedup import keep_first
from ..operators.ordered import ORDER, Running, running
from ..operators.usage import Facts
from ..session import stage
from .lines import explode_nodes, parsed
from .records import PLACE, record, records_to_facts

V = "v"

# Field names each log format uses, first match wins.
GEMINI_INPUT = ["input", "prompt", "input_tokens", "prompt_tokens"]
GEMINI_OUTPUT = ["output", "candidates", "output_tokens", "candidates_tokens"]
GEMINI_THOUGHTS = ["thoughts", "reasoning", "thoughts_tokens", "reasoning_tokens"]
GEMINI_CACHED = ["cached", "cached_tokens"]
KIMI_USAGE = ["inputOther", "input_other", "inputCacheRead", "input_cache_read"]
KIMI_IDS = ["messageId", "message_id", "id"]
COPILOT_COUNTS = [
    "input_tokens",
    "output_tokens",
    "cache_read.input_tokens",
    "cache_write.input_tokens",
    "cache_creation.input_tokens",
    "reasoning.output_tokens",
    "reasoning_tokens",
]
COPILOT_MODELS = ["gen_ai.response.model", "gen_ai.request.model"]
COPILOT_SESSIONS = [
    "gen_ai.conversation.id",
    "copilot_chat.session_id",
    "copilot_chat.chat_session_id",
    "session.id",
    "github.copilot.interaction_id",
    "gen_ai.response.id",
]


def _first_text(*columns: str):
    return F.coalesce(*[c.text(F.col(x)) for x in columns])


def _count(owner: str, keys: list[str]):
    return c.count(*[F.col(f"{owner}.{k}") for k in keys])


def _open(df: DataFrame, keep: list[str], **objects) -> DataFrame:
    """Add struct columns of the named fields, one level per call, and keep rows where the last one is an object.

    The last one comes out of a generator: a filter would be pushed down and open the object a second time.
    """
    opened = {n: c.fields(node, names) for n, (node, names) in objects.items()}
    name, last = opened.popitem()
    return df.select(*keep, *[x.alias(n) for n, x in opened.items()], F.explode(F.array_compact(F.array(last))).alias(name))


def gemini(lines: DataFrame, documents: DataFrame | None = None) -> Facts:
    """`tokens` objects from lines, from a document's `messages` and from the document itself."""
    nodes = parsed(lines.filter(F.col("value").contains("tokens"))).select(*PLACE, F.lit(None).cast("string").alias("doc_model"), "v")
    if documents is not None:
        docs = parsed(documents.filter(F.col("value").contains("tokens"))).select(*PLACE, c.text(c.get(V, "$.model")).alias("doc_model"), "v")
        keep = ["file", "block_start", "line_no", "doc_model"]
        messages = explode_nodes(docs, c.elements(c.get(V, "$.messages")), keep)
        last = docs.withColumn("pos", F.lit((1 << 62)))
        nodes = nodes.unionByName(messages.select(*nodes.columns)).unionByName(last.select(*nodes.columns))
    top = ["model", "timestamp", "id", "messageId", "message_id", "responseId", "tokens"]
    level1 = _open(nodes, [*PLACE, "doc_model"], s=(V, top))
    counters = [*GEMINI_INPUT, *GEMINI_OUTPUT, *GEMINI_THOUGHTS, *GEMINI_CACHED]
    used = _open(level1, [*PLACE, "doc_model", "s"], t=("s.tokens", counters))
    rows = used.select(
        *record(
            "gemini",
            F.col("file"),
            F.coalesce(c.text(F.col("s.model")), F.col("doc_model"), F.lit("gemini-unknown")),
            c.text(F.col("s.timestamp")),
            _first_text("s.id", "s.messageId", "s.message_id", "s.responseId"),
            _count("t", GEMINI_INPUT),
            _count("t", GEMINI_OUTPUT) + _count("t", GEMINI_THOUGHTS),
            _count("t", GEMINI_CACHED),
        )
    )
    return records_to_facts(rows, dedup=True)


def qwen(lines: DataFrame) -> Facts:
    """The prompt count includes the cached part."""
    lines = parsed(lines.filter(F.col("value").contains("usageMetadata")))
    level1 = _open(lines, PLACE, s=(V, ["model", "timestamp", "id", "messageId", "message_id", "usageMetadata"]))
    counters = ["promptTokenCount", "candidatesTokenCount", "thoughtsTokenCount", "cachedContentTokenCount"]
    used = _open(level1, [*PLACE, "s"], t=("s.usageMetadata", counters))
    cached = _count("t", ["cachedContentTokenCount"])
    rows = used.select(
        *record(
            "qwen",
            F.col("file"),
            F.coalesce(c.text(F.col("s.model")), F.lit("qwen-unknown")),
            c.text(F.col("s.timestamp")),
            _first_text("s.id", "s.messageId", "s.message_id"),
            F.greatest(F.lit(0), _count("t", ["promptTokenCount"]) - cached),
            _count("t", ["candidatesTokenCount"]) + _count("t", ["thoughtsTokenCount"]),
            cached,
        )
    )
    return records_to_facts(rows, dedup=True)


def pi(lines: DataFrame) -> Facts:
    """S11."""
    level1 = _open(parsed(lines.filter(F.col("value").contains("usage"))), PLACE, s=(V, ["timestamp", "id", "message"]))
    level2 = _open(level1, [*PLACE, "s"], m=("s.message", ["model", "id", "messageId", "usage"]))
    used = _open(level2, [*PLACE, "s", "m"], t=("m.usage", ["input", "output", "cacheRead", "cacheWrite"]))
    rows = used.select(
        *record(
            "pi",
            F.col("file"),
            F.coalesce(c.text(F.col("m.model")), F.lit("pi-unknown")),
            c.text(F.col("s.timestamp")),
            _first_text("m.id", "s.id", "m.messageId"),
            *[_count("t", [k]) for k in ("input", "output", "cacheRead", "cacheWrite")],
        )
    )
    return records_to_facts(rows, dedup=True)


def openclaw(lines: DataFrame, chunk=None) -> Facts:
    """A model line names the model of the lines after it; a message's own model wins."""
    names_model = F.col("value").contains("odel")  # modelId, model, model_change, model-snapshot
    likely = lines.filter(F.col("value").contains("usage") | names_model)
    level1 = _open(parsed(likely), ORDER, s=(V, ["type", "timestamp", "id", "modelId", "model", "data", "message"]))
    opened = level1.select(
        *ORDER,
        "s",
        c.fields("s.data", ["modelId", "model"]).alias("d"),
        c.fields("s.message", ["modelId", "model", "timestamp", "id", "messageId", "usage"]).alias("m"),
    ).select("*", c.fields("m.usage", ["input", "output", "cacheRead", "cacheWrite"]).alias("t"))
    sets_model = F.coalesce(c.string(F.col("s.type")).isin("model_change", "model-snapshot"), F.lit(False))
    rows = stage(
        opened.select(
            *ORDER,
            F.when(sets_model, _first_text("d.modelId", "d.model", "s.modelId", "s.model")).alias("set_model"),
            (~sets_model & F.col("t").isNotNull()).alias("used"),
            _first_text("m.modelId", "m.model").alias("own_model"),
            _first_text("m.timestamp", "s.timestamp").alias("ts_raw"),
            _first_text("m.id", "s.id", "m.messageId").alias("event_id"),
            *[_count("t", [k]).alias(n) for k, n in (("input", "i"), ("output", "o"), ("cacheRead", "r"), ("cacheWrite", "w"))],
        ).filter("set_model IS NOT NULL OR used"),
        "openclaw-lines",
    )
    sticky = running(rows, ["file"], [Running("current", "last", F.col("set_model"))], chunk)
    records = sticky.filter("used").select(
        *record(
            "openclaw",
            F.col("file"),
            F.coalesce("own_model", "current", F.lit("openclaw-unknown")),
            F.col("ts_raw"),
            F.col("event_id"),
            F.col("i"),
            F.col("o"),
            F.col("r"),
            F.col("w"),
        )
    )
    return records_to_facts(records, dedup=True)


def kimi(lines: DataFrame) -> Facts:
    """The usage object and the id sit at unknown depth."""
    value = F.col("value")
    likely = value.contains(KIMI_USAGE[0])
    for key in KIMI_USAGE[1:]:
        likely = likely | value.contains(key)
    nodes = c.parse_once(lines.filter(likely), F.try_parse_json("value"), [*PLACE, "value"], "line")
    owners = c.owners_of_keys(value, F.col("line"), [KIMI_USAGE, KIMI_IDS])
    found = c.parse_once(nodes, owners, [*PLACE, "line"], "n").select(*PLACE, "line", F.col("n")[0].alias("v"), F.col("n")[1].alias("host"))
    counters = ["inputOther", "input_other", "output", "inputCacheRead", "input_cache_read", "inputCacheCreation", "input_cache_creation"]
    opened = _open(found, PLACE, s=("line", ["model", "timestamp"]), h=("host", KIMI_IDS), t=("v", counters))
    rows = opened.select(
        *record(
            "kimi",
            F.col("file"),
            F.coalesce(c.text(F.col("s.model")), F.lit("kimi-unknown")),
            c.text(F.col("s.timestamp")),
            _first_text(*[f"h.{k}" for k in KIMI_IDS]),
            _count("t", ["inputOther", "input_other"]),
            _count("t", ["output"]),
            _count("t", ["inputCacheRead", "input_cache_read"]),
            _count("t", ["inputCacheCreation", "input_cache_creation"]),
        )
    )
    return records_to_facts(rows, dedup=True)


def copilot(lines: DataFrame) -> Facts:
    """Telemetry records; one inference may appear in several spans and files."""
    usage = {n: f"gen_ai.usage.{n}" for n in COPILOT_COUNTS}
    keys = {**usage, **{k: k for k in [*COPILOT_MODELS, *COPILOT_SESSIONS]}}
    level1 = _open(parsed(lines.filter(F.col("value").contains("attributes"))), PLACE, s=(V, ["attributes", "spanId", "timestamp", "startTime"]))
    opened = _open(level1, [*PLACE, "s"], a=("s.attributes", list(dict.fromkeys(keys.values()))))
    # Every attribute is unwrapped and read once; the filter below then sees plain columns.
    names = [*keys, "span_node"]
    nodes = F.array(*[F.col(f"a.`{k}`") for k in keys.values()], F.col("s.spanId"))
    stamp = F.coalesce(iso(F.col("s.timestamp")), iso(F.col("s.startTime")))
    plain = c.parse_once(opened.select(*PLACE, stamp.alias("ts_raw"), "a", "s"), F.transform(nodes, c.otel_value), [*PLACE, "ts_raw"], "x")
    value = {n: F.col("x")[i] for i, n in enumerate(names)}
    either = lambda a, b: F.when(F.col(a) != 0, F.col(a)).otherwise(F.col(b))
    read = F.struct(
        *[c.count(value[n]).alias(n.replace(".", "_")) for n in usage],
        F.coalesce(c.otel_text([value[k] for k in COPILOT_SESSIONS]), F.lit("copilot")).alias("session"),
        c.otel_text([value["gen_ai.response.id"]]).alias("response"),
        F.coalesce(c.otel_text([value["span_node"]]), F.lit("")).alias("span"),
        F.coalesce(c.otel_text([value[k] for k in COPILOT_MODELS]), F.lit("copilot-unknown")).alias("model"),
    )
    rows = c.parse_once(plain, read, [*PLACE, "ts_raw"], "r").select(*PLACE, "ts_raw", "r.*").select(
        "*",
        F.col("input_tokens").alias("i"),
        F.col("output_tokens").alias("o"),
        F.col("cache_read_input_tokens").alias("r"),
        either("cache_write_input_tokens", "cache_creation_input_tokens").alias("w"),
        either("reasoning_output_tokens", "reasoning_tokens").alias("think"),
    )
    # The zero test comes before reasoning tokens are added.
    used = rows.filter(F.col("i") + F.col("o") + F.col("r") + F.col("w") != 0)
    spanned = F.when(F.col("response").isNull(), F.struct("span", "session", "i", "o"))
    first = keep_first(used, ["response", spanned], ORDER)
    records = first.select(
        *record(
            "copilot",
            F.col("session"),
            F.col("model"),
            F.col("ts_raw"),
            F.col("response"),
            F.col("i"),
            F.col("o") + F.col("think"),
            F.col("r"),
            F.col("w"),
        )
    )
    return records_to_facts(records, dedup=False)
