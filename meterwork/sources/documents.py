"""Sources that keep one JSON document per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce as c
from ..functions.measures import zero
from ..functions.times import iso, iso_from_ms
from ..operators.usage import Facts
from ..session import stage
from .lines import explode_nodes, parsed
from .records import PLACE, complete, no_tools, record, records_to_facts, sessions_of

V = "v"


def droid(documents: DataFrame) -> Facts:
    """One cumulative usage object per settings file; the file time stands in for a missing date."""
    used = parsed(documents).filter(c.is_object(c.get(V, "$.tokenUsage")))
    amount = lambda k: c.count(c.get(V, f"$.tokenUsage.{k}"))
    rows = used.select(
        *record(
            "droid",
            F.col("file"),
            F.coalesce(c.text(c.get(V, "$.model")), F.lit("droid-unknown")),
            F.coalesce(c.text(c.get(V, "$.updatedAt")), c.text(c.get(V, "$.createdAt")), F.col("mtime")),
            None,
            amount("inputTokens"),
            amount("outputTokens") + amount("thinkingTokens"),
            amount("cacheReadTokens"),
            amount("cacheCreationTokens"),
        )
    )
    return records_to_facts(rows, dedup=False)


def codebuff(documents: DataFrame, dedup: bool = False) -> Facts:
    """Assistant messages of a chat array; duplicates stay unless asked otherwise."""
    docs = parsed(documents)
    messages = explode_nodes(docs, c.elements(V), ["file", "block_start", "line_no", "mtime"])
    role = F.coalesce(c.text(c.get(V, "$.variant")), c.text(c.get(V, "$.role")))
    used = messages.filter(role.isin("ai", "agent", "assistant") & c.is_object(c.get(V, "$.metadata.usage")))
    amount = lambda *keys: c.count(*[c.get(V, f"$.metadata.usage.{k}") for k in keys])
    rows = used.select(
        *record(
            "codebuff",
            F.col("file"),
            F.coalesce(c.text(c.get(V, "$.metadata.model")), F.lit("codebuff-unknown")),
            F.coalesce(c.text(c.get(V, "$.timestamp")), F.col("mtime")),
            F.coalesce(*[c.text(c.get(V, f"$.{k}")) for k in ("id", "messageId", "message_id")]),
            amount("inputTokens", "input_tokens"),
            amount("outputTokens", "output_tokens"),
            amount("cacheReadInputTokens", "cache_read_input_tokens", "cachedTokens"),
            amount("cacheCreationInputTokens", "cache_creation_input_tokens"),
        )
    )
    return records_to_facts(rows, dedup=dedup)


def amp_nodes(documents: DataFrame) -> DataFrame:
    """Typed rows of all ledger events and messages of a thread, out of one array that is opened once.

    ``part`` is "event", "cached" (a message of a thread with a ledger) or "plain" (a message of one without).
    """
    docs = parsed(documents).select(
        *PLACE,
        F.coalesce(c.text(c.get(V, "$.id")), F.col("file")).alias("session"),
        c.elements(c.get(V, "$.messages")).alias("messages"),
        c.elements(c.get(V, "$.usageLedger.events")).alias("events"),
    )
    tagged = lambda nodes, part: F.transform(
        F.coalesce(nodes, F.array().cast("array<variant>")), lambda n, i: F.struct(part.alias("part"), i.cast("bigint").alias("pos"), n.alias("v")))
    messages = F.when(F.col("events").isNull(), F.lit("plain")).otherwise(F.lit("cached"))
    every = F.concat(tagged(F.col("events"), F.lit("event")), tagged(F.col("messages"), messages))
    nodes = docs.select("file", "block_start", "line_no", "session", F.explode(every).alias("n")).select("file", "block_start", "line_no", "session", "n.*")
    is_event, has_usage = F.col("part") == "event", c.is_object(c.get(V, "$.usage"))
    amount = lambda path: c.whole(c.number(c.get(V, f"$.usage.{path}")))
    typed = nodes.select(
        *PLACE,
        "session",
        "part",
        F.when(is_event, c.text(c.get(V, "$.model"))).otherwise(c.string(c.get(V, "$.model"))).alias("model"),
        iso(F.when(~is_event | c.text(c.get(V, "$.timestamp")).isNotNull(), c.get(V, "$.timestamp"))).alias("ts"),
        c.number(F.when(is_event, c.get(V, "$.toMessageId")).otherwise(c.get(V, "$.messageId"))).alias("message"),
        (is_event | has_usage & ((F.col("part") == "cached") | F.coalesce(c.string(c.get(V, "$.role")) == "assistant", F.lit(False)))).alias("used"),
        F.when(is_event, c.count(c.get(V, "$.tokens.input"))).otherwise(amount("inputTokens")).alias("input"),
        F.when(is_event, c.count(c.get(V, "$.tokens.output"))).otherwise(amount("outputTokens")).alias("output"),
        amount("cacheReadInputTokens").alias("r"),
        amount("cacheCreationInputTokens").alias("w"),
    )
    return stage(typed.filter("used"), "amp-nodes")


def amp(documents: DataFrame) -> Facts:
    """Ledger events with cache tokens of the message they point at, else assistant messages."""
    nodes = amp_nodes(documents)
    cached = nodes.filter("part = 'cached' AND message IS NOT NULL").groupBy("file", "message").agg(F.max_by(F.struct("r", "w"), "pos").alias("cache"))
    events = nodes.filter("part = 'event'").drop("r", "w").join(cached, ["file", "message"], "left").select(
        *nodes.drop("r", "w").columns, F.coalesce("cache.r", F.lit(0)).alias("r"), F.coalesce("cache.w", F.lit(0)).alias("w"))
    rows = events.unionByName(nodes.filter("part = 'plain'"))
    model = F.coalesce("model", F.lit("amp-unknown"))
    return records_to_facts(
        rows.select(*record("amp", F.col("session"), model, F.col("ts"), None, F.col("input"), F.col("output"), F.col("r"), F.col("w"))), dedup=False)


def _optional(node: Column, ok: Column) -> Column:
    return c.absent(node) | F.coalesce(ok, F.lit(False))


def _optional_text(path: str) -> Column:
    return _optional(c.get(V, path), c.is_string(c.get(V, path)))


def _optional_number(path: str) -> Column:
    return _optional(c.get(V, path), c.number(c.get(V, path)).isNotNull())


def _optional_object(path: str) -> Column:
    return _optional(c.get(V, path), c.is_object(c.get(V, path)))


def opencode_directories(sessions: DataFrame, projects: DataFrame) -> DataFrame:
    """(session_id, cwd); a session's directory, else its project's worktree; the last file per id wins."""
    trees = (
        parsed(projects)
        .filter(c.is_string(c.get(V, "$.id")) & _optional_text("$.worktree"))
        .select(c.string(c.get(V, "$.id")).alias("project"), c.text(c.get(V, "$.worktree")).alias("worktree"), "file")
        .filter("worktree IS NOT NULL")
        .groupBy("project")
        .agg(F.max_by("worktree", "file").alias("worktree"))
    )
    valid = (
        c.is_string(c.get(V, "$.id"))
        & _optional_text("$.directory")
        & _optional_text("$.projectID")
        & _optional_object("$.time")
        & _optional_number("$.time.created")
    )
    listed = parsed(sessions).filter(valid).select(
        c.string(c.get(V, "$.id")).alias("session_id"),
        c.string(c.get(V, "$.directory")).alias("directory"),
        c.text(c.get(V, "$.projectID")).alias("project"),
        "file",
    )
    cwd = F.nullif(F.coalesce("directory", "worktree"), F.lit(""))
    placed = listed.join(trees, "project", "left").withColumn("cwd", cwd).filter("cwd IS NOT NULL")
    return placed.groupBy("session_id").agg(F.max_by("cwd", "file").alias("cwd"))


def opencode(messages: DataFrame, sessions: DataFrame, projects: DataFrame) -> Facts:
    """Assistant messages with a token object; one without tokens spent still counts a turn."""
    valid = (
        c.is_string(c.get(V, "$.sessionID"))
        & c.is_string(c.get(V, "$.role"))
        & _optional_text("$.modelID")
        & _optional_text("$.providerID")
        & _optional_object("$.time")
        & _optional_number("$.time.created")
        & _optional_number("$.time.completed")
        & c.is_object(c.get(V, "$.tokens"))
        & _optional_object("$.tokens.cache")
    )
    amount = lambda path: c.whole(c.number(c.get(V, path)))
    created = F.nullif(c.number(c.get(V, "$.time.created")), F.lit(0.0))
    used = parsed(messages).filter(valid & (c.string(c.get(V, "$.role")) == "assistant"))
    rows = used.select(
        *record(
            "opencode",
            c.string(c.get(V, "$.sessionID")),
            F.coalesce(c.string(c.get(V, "$.modelID")), F.lit("unknown")),
            iso_from_ms(created),
            None,
            amount("$.tokens.input"),
            amount("$.tokens.output") + amount("$.tokens.reasoning"),
            amount("$.tokens.cache.read"),
            amount("$.tokens.cache.write"),
        )
    )
    usage = complete(rows)
    return Facts(usage, no_tools(usage), sessions_of(usage, opencode_directories(sessions, projects)))
