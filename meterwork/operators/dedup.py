"""Keep the first row of each identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ORDER


def row_identity() -> Column:
    """An identity no other line shares, for rows that must not be merged."""
    return F.concat_ws("\x00", *[F.col(c).cast("string") for c in ORDER])


def keep_first(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """First row per key in ``order``.

    Filtering ``row_number() = 1`` lets Spark limit every key to one row per
    map task before the shuffle, so a key repeated in a third of all rows
    costs one row per task.
    """
    columns = df.columns
    key_names = [f"_key{i}" for i in range(len(keys))]
    keyed = df.select("*", *[(F.col(k) if isinstance(k, str) else k).alias(n) for k, n in zip(keys, key_names)])
    rank = F.row_number().over(Window.partitionBy(*key_names).orderBy(*order))
    return keyed.withColumn("_rank", rank).filter("_rank = 1").select(*columns)


def first_records(records: DataFrame) -> DataFrame:
    """One copy of records equal in id (else timestamp), model and all four counts; rows without both always stay."""
    scope = F.coalesce(F.nullif(F.col("event_id"), F.lit("")), F.nullif(F.col("ts_raw"), F.lit("")))
    anchored = F.when(scope.isNull(), row_identity())
    counts = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"]
    return keep_first(records, ["agent_id", scope, anchored, "model", *counts], ORDER)
