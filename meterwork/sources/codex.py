"""Codex rollouts (S2, S3): cumulative counters, sticky models, replayed forks and headless log lines.

All ordered state is built with ``running`` per file, so a rollout of any
length is spread over many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import coerce as c
from ..functions.measures import MEASURES, zero
from ..functions.times import kept_or_normalized, normalized, real_date
from ..operators.dedup import keep_first
from ..operators.ordered import ORDER, Running, order_struct, running
from ..operators.usage import TOOL_COLUMNS, USAGE_COLUMNS, Facts
from ..session import stage
from .files import LogFiles, home_files, read_listed

AGENT = "codex"
DEFAULT_MODEL = "gpt-5"
AUTO_REVIEW = "codex-auto-review"
# The model behind the auto-review pseudo-model from each date on.
AUTO_REVIEW_MODELS = [
    ("2026-04-23", "gpt-5.5"),
    ("2026-03-05", "gpt-5.4"),
    ("2026-02-05", "gpt-5.3-codex"),
    ("2025-12-11", "gpt-5.2-codex"),
    ("2025-11-13", "gpt-5.1-codex"),
    ("2025-09-15", "gpt-5-codex"),
    ("2025-08-07", "gpt-5"),
]
LONG_CONTEXT = 272_000
PROBE_BYTES = 16_384
FORK_MARKERS = ("thread_spawn", "forked_from_id")
# Spellings of each counter, first match wins.
COUNTER_NAMES = {
    "input": ("input_tokens", "prompt_tokens", "input"),
    "cached": ("cached_input_tokens", "cache_read_input_tokens", "cached_tokens"),
    "output": ("output_tokens", "completion_tokens", "output"),
    "reasoning": ("reasoning_output_tokens", "reasoning_tokens"),
}
COUNTERS = ["input", "cached", "output", "reasoning", "total"]
# Where a model name may stand (P16), first match wins.
MODEL_NAMES = ("model", "model_name", "metadata.model")


def usage_fields(node: Column, path: str = "$") -> Column:
    """All spellings of the counters of a usage object, opened in one pass; NULL if the node is no object."""
    return c.fields(node, [*(n for names in COUNTER_NAMES.values() for n in names), "total_tokens"], path)


def counters(usage: str) -> Column:
    """A column of ``usage_fields`` as a struct of counters."""
    zero_ = F.lit(0).cast("bigint")
    part = {k: F.coalesce(*[c.natural(F.col(f"{usage}.{n}")) for n in names], zero_) for k, names in COUNTER_NAMES.items()}
    fields = [x.alias(k) for k, x in part.items()] + [c.natural(F.col(f"{usage}.total_tokens")).alias("total")]
    return F.when(F.col(usage).isNotNull(), F.struct(*fields))


def trusted_total(usage: Column) -> Column:
    """The stated total counts if positive or if nothing else was used, else the sum of the parts."""
    added = usage["input"] + usage["output"] + usage["reasoning"]
    return F.coalesce(F.when((usage["total"] > 0) | (added == 0), usage["total"]), added)


def auto_review_model(model: Column, ts: Column) -> Column:
    """The pseudo-model stands for the model in force on the event's date."""
    date = real_date(ts)
    dated = F.coalesce(*[F.when(date >= since, F.lit(real)) for since, real in AUTO_REVIEW_MODELS], F.lit(DEFAULT_MODEL))
    return F.when(model == AUTO_REVIEW, dated).otherwise(model)


def rollout_lines(lines: DataFrame) -> DataFrame:
    """Narrow typed rows of every raw line; ``kind`` is NULL for blank and malformed ones, which still have a length."""
    v, value = F.col("v"), F.col("value")
    text = F.regexp_replace(value, "\r$", "")
    sized = lines.select(
        *ORDER,
        "mtime",
        "value",
        (F.octet_length(text) + 1).cast("bigint").alias("bytes"),
        reduce(lambda a, b: a | b, [value.contains(m) for m in FORK_MARKERS]).alias("marked"),
    )
    placed = [*ORDER, "mtime", "bytes", "marked"]
    rows = c.parse_once(sized, F.try_parse_json(value), placed)
    nodes = rows.select(
        *placed,
        "v",
        c.is_object(v).alias("is_line"),
        c.string(c.get(v, "$.type")).alias("line_type"),
        c.string(c.get(v, "$.payload.type")).alias("payload_type"),
    )
    is_token = F.col("is_line") & F.coalesce((F.col("line_type") == "event_msg") & (F.col("payload_type") == "token_count"), F.lit(False))
    is_context = F.col("is_line") & F.coalesce(F.col("line_type") == "turn_context", F.lit(False))
    silent = is_context | F.col("line_type").eqNullSafe("event_msg") | F.col("payload_type").eqNullSafe("turn_context")
    hosts = ["$", "$.data", "$.result", "$.response"]
    tool = (
        F.when(F.col("payload_type").isin("function_call", "custom_tool_call"), c.trimmed(c.get(v, "$.payload.name")))
        .when(F.col("payload_type") == "local_shell_call", F.lit("shell"))
        .when(F.col("line_type") == "function_call", c.trimmed(c.get(v, "$.name")))
    )
    kinds = nodes.select(
        *placed,
        "v",
        F.when(is_token, "token").when(is_context, "context").when(F.col("is_line"), "other").alias("kind"),
        (F.col("is_line") & ~silent).alias("may_be_headless"),
        tool.alias("tool_name"),
    )
    objects = F.filter(F.array(*[c.get(v, f"{h}.usage") for h in hosts]), c.is_object)
    used = kinds.select(
        *[x for x in kinds.columns if x != "may_be_headless"],
        F.when(F.col("may_be_headless"), F.try_element_at(objects, F.lit(1))).alias("usage_node"),
    )
    token, headless = F.col("kind") == "token", F.col("usage_node").isNotNull()
    # Counters look at every field several times: a column of its own keeps each usage object opened once.
    used = used.select(
        "*",
        F.when(token, usage_fields(v, "$.payload.info.last_token_usage")).alias("last_node"),
        F.when(token, usage_fields(v, "$.payload.info.total_token_usage")).alias("totals_node"),
        F.when(headless, usage_fields(F.col("usage_node"))).alias("headless_node"),
    )
    stamps = [c.get(v, f"{h}.{k}") for h in hosts for k in ("timestamp", "created_at", "createdAt")]
    names = lambda paths: c.first([c.get(v, f"{p}.{k}") for p in paths for k in MODEL_NAMES], c.trimmed)
    typed = used.select(
        *placed,
        "kind",
        "tool_name",
        c.string(c.get(v, "$.timestamp")).alias("ts_raw"),
        F.nullif(F.coalesce(c.string(c.get(v, "$.payload.cwd")), c.string(c.get(v, "$.cwd"))), F.lit("")).alias("cwd"),
        F.when(token, c.is_object(c.get(v, "$.payload.info"))).alias("has_info"),
        counters("last_node").alias("last"),
        counters("totals_node").alias("totals"),
        counters("headless_node").alias("headless"),
        F.when(token, names(["$.payload", "$.payload.info"]))
        .when(F.col("kind") == "context", names(["$.payload"]))
        .when(headless, names(hosts))
        .alias("named_model"),
        F.when(headless, F.coalesce(c.first(stamps, normalized), "mtime")).alias("headless_ts"),
        F.when(headless, F.coalesce(c.first(stamps, kept_or_normalized), "mtime")).alias("headless_model_ts"),
    )
    return typed.withColumns({u: F.col(u).withField("total", trusted_total(F.col(u))) for u in ("last", "totals", "headless")})


def replay_seconds(rows: DataFrame) -> DataFrame:
    """(file, replay_second) of forked files whose first two token counts share one second.

    A file is forked when a marker occurs in a line that starts within its first bytes.
    """
    first_mark = rows.filter("marked").groupBy("file").agg(F.min(order_struct()).alias("mark"))
    up_to_mark = rows.select(*ORDER, "bytes").join(first_mark, "file").filter(order_struct() <= F.col("mark"))
    # Bytes ahead of the first marked line; sums per file need no ordered scan.
    ahead = F.sum(F.when(order_struct() < F.col("mark"), F.col("bytes")).otherwise(0))
    forked = up_to_mark.groupBy("file").agg(ahead.alias("before")).filter(F.col("before") <= PROBE_BYTES).select("file")
    counted = rows.filter(
        (F.col("kind") == "token") & (F.col("last").isNotNull() | F.col("totals").isNotNull()) & (F.length("ts_raw") >= 19)
    ).select(*ORDER, F.substring("ts_raw", 1, 19).alias("second"))
    nth = F.row_number().over(Window.partitionBy("file").orderBy(*ORDER))
    first_two = counted.withColumn("nth", nth).filter("nth <= 2")
    bursts = first_two.groupBy("file").agg(F.count("*").alias("n"), F.min("second").alias("lo"), F.max("second").alias("hi"))
    return (
        bursts.filter("n = 2 AND lo = hi")
        .join(forked, "file", "left_semi")
        .select("file", F.col("lo").alias("replay_second"))
    )


def turn_usage(rows: DataFrame, replays: DataFrame, chunk: list[Column] | None = None) -> DataFrame:
    """Add ``used``, the counters a line adds, NULL where it adds none.

    A token count adds its last usage, else the growth of the running totals;
    the leading run of token counts inside the replay second adds nothing but
    still moves the totals.
    """
    is_token = F.col("kind") == "token"
    same = F.coalesce(F.substring("ts_raw", 1, 19) == F.col("replay_second"), F.lit(False))
    marked = rows.join(replays, "file", "left")
    state = running(
        marked,
        ["file"],
        [
            Running("previous", "last", F.col("totals")),
            Running("left_replay", "max", F.when(is_token & ~same, F.lit(1)), inclusive=True),
        ],
        chunk,
    )
    replayed = is_token & F.col("replay_second").isNotNull() & F.col("left_replay").isNull()
    grown = F.struct(
        *[
            F.greatest(F.lit(0), F.col(f"totals.{k}") - F.coalesce(F.col(f"previous.{k}"), F.lit(0))).cast("bigint").alias(k)
            for k in COUNTERS
        ]
    )
    counted = F.coalesce("last", F.when(F.col("totals").isNotNull(), grown))
    anything = lambda keys: F.greatest(*[F.col(f"raw_used.{k}") for k in keys]) > 0
    raw = F.when(is_token, F.when(~replayed & F.col("has_info"), counted)).otherwise(F.col("headless"))
    keep = F.when(is_token, anything(COUNTERS[:4])).otherwise(anything(COUNTERS))
    return state.withColumn("raw_used", raw).select(
        *ORDER,
        "kind",
        "tool_name",
        "named_model",
        F.when(is_token, F.col("ts_raw")).otherwise(F.col("headless_ts")).alias("event_ts"),
        F.when(is_token, F.coalesce("ts_raw", F.lit(""))).otherwise(F.col("headless_model_ts")).alias("model_ts"),
        F.when(keep, F.col("raw_used")).alias("used"),
    )


def model_and_turn(usage: DataFrame, chunk: list[Column] | None = None) -> DataFrame:
    """Add ``model``, in force at the line, and ``turn``, the number of counted lines before it."""
    counts = F.col("used").isNotNull()
    state = running(
        usage,
        ["file"],
        [
            Running("sticky", "last", F.when(counts | (F.col("kind") == "context"), F.col("named_model")), inclusive=True),
            Running("turn", "sum", F.when(counts, F.lit(1)).otherwise(F.lit(0)).cast("bigint")),
        ],
        chunk,
    )
    model = auto_review_model(F.coalesce("sticky", F.lit(DEFAULT_MODEL)), F.col("model_ts"))
    return state.withColumn("model", model).drop("sticky")


def first_events(lines: DataFrame) -> DataFrame:
    """Usage of counted lines, one per identity across all files; ``identity`` tells copies of an event."""
    u = lambda k: F.col(f"used.{k}")
    cached = F.least(u("cached"), u("input"))
    identity = [F.coalesce("event_ts", F.lit("")), "model", u("input"), cached, u("output"), u("reasoning"), u("total")]
    named = F.concat_ws("\x1f", *[F.coalesce(F.col(x) if isinstance(x, str) else x.cast("string"), F.lit("")) for x in identity])
    first = keep_first(lines.filter("used IS NOT NULL").withColumn("identity", named), ["identity"], ORDER)
    long = u("input") > LONG_CONTEXT
    none = F.lit(0).cast("bigint")
    fresh = F.greatest(F.lit(0), u("input") - cached)
    return first.select(
        F.lit(AGENT).alias("agent_id"),
        F.col("file").alias("session_id"),
        *ORDER,
        F.lit(None).cast("string").alias("event_id"),
        F.nullif(F.col("event_ts"), F.lit("")).alias("ts_raw"),
        F.substring(F.nullif(F.col("event_ts"), F.lit("")), 1, 10).alias("day"),
        "model",
        "turn",
        "identity",
        fresh.cast("bigint").alias("input_tokens"),
        cached.alias("cache_read_tokens"),
        zero("cache_write_tokens"),
        zero("cache_write_1h_tokens"),
        u("output").alias("output_tokens"),
        F.when(long, fresh).otherwise(none).cast("bigint").alias("long_input_tokens"),
        F.when(long, cached).otherwise(none).alias("long_cache_read_tokens"),
        F.when(long, u("output")).otherwise(none).alias("long_output_tokens"),
        F.lit(1).cast("bigint").alias("turns"),
    )


def tool_calls(lines: DataFrame, events: DataFrame) -> DataFrame:
    """Calls since the last counted line share the next one's cost.

    Calls after the last counted line, or before a dropped copy, cost nothing.
    Calls are counted per (file, turn, tool) before anything is joined.
    """
    return priced_calls(calls_by_turn(lines), events)


def calls_by_turn(lines: DataFrame) -> DataFrame:
    """(file, turn, tool_name, calls, split) of every turn that called tools."""
    calls = lines.filter("tool_name IS NOT NULL").groupBy("file", "turn", "tool_name").agg(F.count("*").alias("calls"))
    return calls.withColumn("split", F.sum("calls").over(Window.partitionBy("file", "turn")))


def priced_calls(shared: DataFrame, events: DataFrame) -> DataFrame:
    """Calls with the usage of the turn that they share."""
    priced = events.select("file", "turn", "model", *MEASURES)
    return shared.join(priced, ["file", "turn"], "left").select(
        F.lit(AGENT).alias("agent_id"),
        F.col("file").alias("session_id"),
        "*",
        F.lit(None).cast("string").alias("call_id"),
    ).select(*TOOL_COLUMNS)


def sessions(rows: DataFrame) -> DataFrame:
    """First working directory, first and last timestamp in line order."""
    at = order_struct()
    dated = F.nullif(F.col("ts_raw"), F.lit(""))
    seen = F.when(dated.isNotNull(), at)
    return rows.groupBy(F.lit(AGENT).alias("agent_id"), F.col("file").alias("session_id"), "file").agg(
        F.min_by("cwd", F.when(F.col("cwd").isNotNull(), at)).alias("cwd"),
        F.min_by(dated, seen).alias("first_ts"),
        F.max_by(dated, seen).alias("last_ts"),
    )


def load(lines: DataFrame, chunk: list[Column] | None = None) -> Facts:
    """Raw rollout lines to facts."""
    events, calls, seen = parts(lines, chunk)
    return Facts(events.select(*USAGE_COLUMNS), priced_calls(calls, events), seen)


def parts(lines: DataFrame, chunk: list[Column] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events with turn and identity, tool calls by turn, sessions.

    Most lines of a rollout are messages that touch no state: they end with the parse, and only lines that carry
    usage, a context or a tool call go through the ordered passes.
    """
    rows = stage(rollout_lines(lines), "codex-lines")
    relevant = rows.filter("kind IN ('token', 'context') OR tool_name IS NOT NULL OR headless IS NOT NULL")
    used = stage(turn_usage(relevant, replay_seconds(rows), chunk), "codex-used")
    placed = stage(model_and_turn(used, chunk), "codex-turns")
    return first_events(placed), calls_by_turn(placed), sessions(rows)


def active_over_archived(lines: DataFrame) -> DataFrame:
    """S3 and D6 on a table of lines that names each line's (home, rel_path, source_rank): the files of lowest rank stay."""
    files = lines.select("home", "rel_path", "source_rank", "file").distinct()
    kept = keep_first(files, ["home", "rel_path"], ["source_rank"]).select("file")
    return lines.join(kept, "file", "left_semi")


# The folders of a home, in order of preference; a home with neither is read whole.
LOGS = LogFiles(("sessions", "archived_sessions"), r"\.jsonl$", twins=True, otherwise="")


def read_home(spark: SparkSession, home: str | list[str], modified_after: str | None = None) -> DataFrame:
    """S3: lines of one or several homes; twins and times are settled on the list of files, before any is opened."""
    return read_listed(home_files(spark, home, LOGS, modified_after))
