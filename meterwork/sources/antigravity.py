"""Antigravity conversations (S17, S18): no token counts on disk, so they are estimated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce as c
from ..functions.measures import MEASURES
from ..functions.text import model_slug, printable_chars
from ..functions.times import iso_from_ms
from ..operators.estimate import absorb_unnamed, split_estimate
from ..operators.ordered import order_struct
from ..operators.usage import SESSION_COLUMNS, USAGE_COLUMNS, Facts
from .lines import parsed
from .records import no_tools

# The per-turn marker, how many bytes behind it may hold a display name, and the name's shape.
MARKER = "used_claude_conservative"
NAME_BYTES = 226
NAME_PATTERN = r"(Gemini|Claude|GPT)[- ][0-9][0-9A-Za-z. ]{0,25}(\((Low|Medium|High|Max|Thinking)\))?"


def read_conversations(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(conversation_id, content) of every database file; the scan is binary, one file per row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.db").option("recursiveFileLookup", "true").load(paths)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.regexp_replace(name, r"\.db$", "").alias("conversation_id"), "content")


def scan_text(conversations: DataFrame) -> DataFrame:
    """(conversation_id, model, turns, pos, text_chars) from ``content``; model '' marks turns without a readable name."""
    latin = conversations.select("conversation_id", F.decode("content", "ISO-8859-1").alias("t"))
    # The look-ahead captures what follows each marker without consuming it, so windows may overlap.
    windows = F.regexp_extract_all("t", F.lit(MARKER + r"(?=([\s\S]{0,%d}))" % NAME_BYTES), F.lit(1))
    turns = latin.select("conversation_id", printable_chars(F.col("t")).alias("text_chars"), F.posexplode(windows).alias("pos", "w"))
    name = F.regexp_extract("w", NAME_PATTERN, 0)
    return (
        turns.select("conversation_id", "text_chars", "pos", F.when(name == "", "").otherwise(model_slug(name)).alias("model"))
        .groupBy("conversation_id", "model")
        .agg(F.count("*").alias("turns"), F.min("pos").alias("pos"), F.max("text_chars").alias("text_chars"))
    )


def history_times(history: DataFrame) -> DataFrame:
    """Per conversation the first workspace named and the earliest and latest time."""
    v = F.col("v")
    ms = F.nullif(c.number(c.get(v, "$.timestamp")), F.lit(0.0))
    rows = parsed(history).select(
        c.text(c.get(v, "$.conversationId")).alias("conversation_id"),
        c.string(c.get(v, "$.workspace")).alias("workspace"),
        ms.alias("ms"),
        order_struct().alias("at"),
    ).filter("conversation_id IS NOT NULL AND ms IS NOT NULL")
    return rows.groupBy("conversation_id").agg(
        F.min_by("workspace", F.when(F.col("workspace").isNotNull(), F.col("at"))).alias("cwd"),
        iso_from_ms(F.min("ms")).alias("first_ts"),
        iso_from_ms(F.max("ms")).alias("last_ts"),
    )


def load(conversations: DataFrame, history: DataFrame) -> Facts:
    """Estimated usage per conversation and model, dated by the conversation's last activity."""
    scanned = scan_text(conversations)
    key = ["conversation_id"]
    volumes = scanned.groupBy(*key).agg(F.max("text_chars").alias("text_chars"))
    turns = absorb_unnamed(scanned.select(*key, "model", "turns", "pos"), key, "antigravity-unknown")
    estimated = split_estimate(turns, volumes, key).join(history_times(history), key, "left")
    known = {
        "agent_id": F.lit("antigravity"),
        "session_id": F.col("conversation_id"),
        "file": F.col("conversation_id"),
        "ts_raw": F.col("last_ts"),
        "day": F.substring(F.coalesce("last_ts", "first_ts"), 1, 10),
        "event_id": F.lit(None).cast("string"),
    }
    rows = estimated.withColumns(known)
    missing = [x for x in USAGE_COLUMNS if x not in rows.columns]
    rows = rows.select("*", *[F.lit(0).cast("bigint").alias(x) for x in missing])
    usage = rows.select(*[F.col(x).cast("bigint") if x in MEASURES else F.col(x) for x in USAGE_COLUMNS])
    sessions = rows.select(*SESSION_COLUMNS).distinct()
    return Facts(usage, no_tools(usage), sessions)
