"""Claude transcripts (S1): JSON lines whose assistant messages grow over several lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import coerce as c
from ..functions.measures import TOKENS, zero
from ..functions.times import day_key
from ..operators.dedup import keep_first, row_identity
from ..operators.deltas import message_deltas
from ..operators.ordered import ORDER, order_struct
from ..operators.usage import SESSION, TOOL_COLUMNS, USAGE_COLUMNS, Facts
from ..session import stage

AGENT = "claude"
SYNTHETIC = "<synthetic>"
USAGE_FIELDS = ["input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens"]


def _optional_string(node: str) -> Column:
    return c.absent(F.col(node)) | c.is_string(F.col(node))


def _opened(lines: DataFrame) -> DataFrame:
    """Lines as structs of nodes: ``s`` the line, ``m`` its message, ``u`` the usage, ``h`` the cache split, ``blocks`` the content."""
    rows = c.parse_once(lines, F.try_parse_json("value"), ORDER)
    line = rows.select(*ORDER, c.fields("v", ["type", "cwd", "timestamp", "message"]).alias("s"))
    message = line.select("*", c.fields("s.message", ["id", "model", "usage", "content"]).alias("m"))
    usage = message.select(
        "*",
        c.fields("m.usage", [*USAGE_FIELDS, "cache_creation"]).alias("u"),
        F.transform(c.elements(F.col("m.content")), lambda b: c.fields(b, ["type", "id", "name"])).alias("blocks"),
    )
    return usage.select("*", c.fields("u.cache_creation", ["ephemeral_1h_input_tokens"]).alias("h"))


def _valid() -> Column:
    """The structure an assistant line must have; wrong numbers are forgiven, wrong shapes are not."""
    def block_ok(b: Column) -> Column:
        id_ok = b["id"].isNull() | c.is_string(b["id"])
        return b.isNotNull() & c.is_string(b["type"]) & id_ok & (b["name"].isNull() | c.is_string(b["name"]))

    has = lambda x: F.col(x).isNotNull()
    return (
        has("m")
        & F.coalesce(c.string(F.col("s.type")) == "assistant", F.lit(False))
        & _optional_string("s.cwd")
        & _optional_string("s.timestamp")
        & _optional_string("m.id")
        & _optional_string("m.model")
        & (~has("m.usage") | has("u"))
        & (~has("u.cache_creation") | has("h") | c.missing_or_null(F.col("u.cache_creation")))
        & (~has("m.content") | F.coalesce(F.forall("blocks", block_ok), F.lit(False)))
    )


def _counter(node: str) -> Column:
    return c.whole(c.number(F.col(node)))


def assistant_lines(lines: DataFrame, zone: str | None = None) -> DataFrame:
    """Assistant lines as narrow typed rows; ``tools`` holds their tool calls.

    The substring test runs before the JSON parser sees the line, and the
    validity test is the last step, on columns that are already there.
    """
    candidates = lines.filter((F.length("value") >= 2) & F.col("value").contains("assistant"))
    calls = F.transform("blocks", lambda b: F.struct(
        c.text(b["id"]).alias("call_id"),
        F.when(c.string(b["type"]) == "tool_use", c.text(b["name"])).alias("tool_name"),
    ))
    model = F.coalesce(c.string(F.col("m.model")), F.lit("unknown"))
    typed = _opened(candidates).select(
        *ORDER,
        _valid().alias("valid"),
        c.text(F.col("s.cwd")).alias("cwd"),
        c.text(F.col("s.timestamp")).alias("ts_raw"),
        c.text(F.col("m.id")).alias("message_id"),
        model.alias("model"),
        F.col("u").isNotNull().alias("has_usage"),
        _counter("u.input_tokens").alias("input_tokens"),
        _counter("u.cache_read_input_tokens").alias("cache_read_tokens"),
        _counter("u.cache_creation_input_tokens").alias("cache_write_tokens"),
        _counter("h.ephemeral_1h_input_tokens").alias("cache_write_1h_tokens"),
        _counter("u.output_tokens").alias("output_tokens"),
        calls.alias("calls"),
    )
    names = [x for x in typed.columns if x not in ("valid", "has_usage", "calls")]
    # Generators keep the columns computed once; the filter then reads one boolean.
    kept = typed.select(F.explode(F.array(F.struct(*typed.columns))).alias("r")).filter("r.valid").select("r.*")
    return kept.select(
        *names,
        day_key(F.col("ts_raw"), zone).alias("day"),
        (F.col("has_usage") & (F.col("model") != SYNTHETIC)).alias("counted"),
        F.filter("calls", lambda t: t["tool_name"].isNotNull()).alias("tools"),
    )


def usage_events(deltas: DataFrame) -> DataFrame:
    """Lines that add tokens or open a turn."""
    added = sum((F.col(t) for t in TOKENS), F.lit(0))
    kept = deltas.filter(F.col("counted") & ((added > 0) | (F.col("turns") > 0)))
    return kept.select(
        F.lit(AGENT).alias("agent_id"),
        F.col("file").alias("session_id"),
        "*",
        F.col("message_id").alias("event_id"),
        zero("long_input_tokens"),
        zero("long_cache_read_tokens"),
        zero("long_output_tokens"),
    ).select(*USAGE_COLUMNS)


def tool_calls(deltas: DataFrame) -> DataFrame:
    """Tool calls counted once per call id; ``split`` is how many newly counted tools share the line's cost."""
    calls = deltas.select(*[x for x in deltas.columns if x != "tools"], F.posexplode("tools").alias("slot", "t")).select(
        "*", "t.call_id", "t.tool_name"
    )
    own = F.when(F.col("call_id").isNull(), F.concat_ws("\x00", row_identity(), F.col("slot").cast("string")))
    counted = keep_first(calls, ["call_id", own], [*ORDER, "slot"])
    split = F.count("*").over(Window.partitionBy(*ORDER))
    return counted.select(
        F.lit(AGENT).alias("agent_id"),
        F.col("file").alias("session_id"),
        "*",
        F.lit(1).cast("bigint").alias("calls"),
        split.alias("split"),
        zero("long_input_tokens"),
        zero("long_cache_read_tokens"),
        zero("long_output_tokens"),
    ).withColumn("cache_write_1h_tokens", F.least("cache_write_1h_tokens", "cache_write_tokens")).select(*TOOL_COLUMNS)


def sessions(rows: DataFrame) -> DataFrame:
    """First working directory, first and last timestamp in line order."""
    at = order_struct()
    dated = F.when(F.col("ts_raw").isNotNull(), at)
    return rows.groupBy(F.lit(AGENT).alias("agent_id"), F.col("file").alias("session_id"), "file").agg(
        F.min_by("cwd", F.when(F.col("cwd").isNotNull(), at)).alias("cwd"),
        F.min_by("ts_raw", dated).alias("first_ts"),
        F.max_by("ts_raw", dated).alias("last_ts"),
    )


def load(lines: DataFrame, zone: str | None = None, chunk: list[Column] | None = None) -> Facts:
    """Parse once, stage the narrow rows, then derive usage, tools and sessions from them."""
    rows = stage(assistant_lines(lines, zone), "claude-lines")
    deltas = stage(message_deltas(rows, chunk), "claude-deltas")
    return Facts(usage_events(deltas), tool_calls(deltas), sessions(rows))


def last_context(lines: DataFrame) -> DataFrame:
    """Per file, input plus cache tokens of the newest line that has a numeric input count."""
    rows = c.parse_once(lines.filter(F.col("value").contains('"usage"')), F.try_parse_json("value"), ORDER)
    usage = c.get("v", "$.message.usage")
    part = lambda name: F.coalesce(c.number(c.get(usage, f"$.{name}")), F.lit(0.0))
    has_input = c.number(c.get(usage, "$.input_tokens")).isNotNull()
    total = part("input_tokens") + part("cache_read_input_tokens") + part("cache_creation_input_tokens")
    return rows.filter(has_input).groupBy(F.col("file").alias("session_id")).agg(
        F.max_by(total.cast("bigint"), order_struct()).alias("context_tokens")
    )
