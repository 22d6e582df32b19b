"""Sources that keep their log in database tables, read as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce as c
from ..functions.times import iso, iso_from_ms
from ..operators.usage import Facts
from .records import record, records_to_facts

V = "v"


def _rows(table: DataFrame) -> DataFrame:
    """Give table rows a place: there is one copy of each row, so any distinct numbering does."""
    return table.select(
        "*",
        F.lit("table").alias("file"),
        F.lit(0).cast("bigint").alias("block_start"),
        F.monotonically_increasing_id().alias("line_no"),
        F.lit(0).cast("bigint").alias("pos"),
    )


def _cell(table: DataFrame, name: str) -> Column:
    """Column as a node, NULL when the table lacks it."""
    if name not in table.columns:
        return F.try_parse_json(F.lit(None).cast("string"))
    return c.get(F.try_parse_json(F.to_json(F.struct(F.col(name).alias("x")))), "$.x")


def kilo(messages: DataFrame) -> Facts:
    """A JSON message in the text column ``data``; the session id may also be a column."""
    row_session = F.col("session_id").cast("string") if "session_id" in messages.columns else F.lit(None).cast("string")
    rows = _rows(messages)
    rows = c.parse_once(rows, F.try_parse_json("data"), rows.columns)
    used = rows.filter((c.string(c.get(V, "$.role")) == "assistant") & c.is_object(c.get(V, "$.tokens")))
    amount = lambda path: c.whole(c.number(c.get(V, path)))
    created = F.nullif(c.number(c.get(V, "$.time.created")), F.lit(0.0))
    records = used.select(
        *record(
            "kilo",
            F.coalesce(c.string(c.get(V, "$.sessionID")), row_session, F.lit("kilo")),
            F.coalesce(c.string(c.get(V, "$.modelID")), F.lit("kilo-unknown")),
            iso_from_ms(created),
            None,
            amount("$.tokens.input"),
            amount("$.tokens.output") + amount("$.tokens.reasoning"),
            amount("$.tokens.cache.read"),
            amount("$.tokens.cache.write"),
        )
    )
    return records_to_facts(records, dedup=False)


def goose(table: DataFrame) -> Facts:
    """Lifetime counts, falling back to plain ones when zero; all rows form one session."""
    def either(name: str) -> Column:
        lifetime, plain = c.count(_cell(table, f"accumulated_{name}")), c.count(_cell(table, name))
        return F.when(lifetime != 0, lifetime).otherwise(plain)

    rows = _rows(table).select(
        "file",
        "block_start",
        "line_no",
        "pos",
        either("input_tokens").alias("i"),
        either("output_tokens").alias("o"),
        either("total_tokens").alias("total"),
        F.coalesce(
            c.text(c.get(F.try_parse_json(F.col("model_config_json").cast("string")), "$.model_name")), F.lit("goose-unknown")
        ).alias("model"),
        iso(_cell(table, "created_at")).alias("ts_raw"),
    )
    remainder = F.greatest(F.lit(0), F.col("total") - F.col("i") - F.col("o"))
    records = rows.select(
        *record("goose", F.lit("goose"), F.col("model"), F.col("ts_raw"), None, F.col("i"), F.col("o") + remainder)
    )
    return records_to_facts(records, dedup=False)


def hermes(table: DataFrame) -> Facts:
    """One row per run; all rows form one session."""
    amount = lambda name: c.count(_cell(table, name))
    records = _rows(table).select(
        *record(
            "hermes",
            F.lit("hermes"),
            F.coalesce(c.text(_cell(table, "model")), F.lit("hermes-unknown")),
            iso(_cell(table, "started_at")),
            None,
            amount("input_tokens"),
            amount("output_tokens") + amount("reasoning_tokens"),
            amount("cache_read_tokens"),
            amount("cache_write_tokens"),
        )
    )
    return records_to_facts(records, dedup=False)
