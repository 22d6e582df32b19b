"""Usage that grows over several lines of one message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import row_identity
from .ordered import Running, running

COUNTERS = ["input_tokens", "cache_read_tokens", "cache_write_tokens", "cache_write_1h_tokens", "output_tokens"]


def message_deltas(lines: DataFrame, chunk: list[Column] | None = None, order: list[str] | None = None,
                   identity: Column | None = None) -> DataFrame:
    """Replace each counter by what the line adds to the highest value seen for its message id.

    Needs ``message_id``, ``counted`` (the line carries usage) and the counters.
    ``turns`` is 1 on the first counted line of an id; lines without an id stand
    alone. The state spans all files (D5): the first file in order owns the usage.
    """
    own = row_identity() if identity is None else identity
    keyed = lines.withColumn(
        "_message",
        F.when(F.col("counted") & (F.col("message_id") != ""), F.concat(F.lit("m"), "message_id")).otherwise(F.concat(F.lit("r"), own)),
    )
    specs = [Running(f"_hi_{c}", "max", F.when(F.col("counted"), F.col(c))) for c in COUNTERS]
    specs.append(Running("_seen", "max", F.when(F.col("counted"), F.lit(1))))
    out = running(keyed, ["_message"], specs, chunk, order)
    kept = [c for c in lines.columns if c not in COUNTERS]
    zero = F.lit(0).cast("bigint")
    grown = [
        F.when(F.col("counted"), F.greatest(zero, F.col(c) - F.greatest(zero, F.coalesce(F.col(f"_hi_{c}"), zero))))
        .otherwise(zero)
        .alias(c)
        for c in COUNTERS
    ]
    first = F.when(F.col("counted") & F.col("_seen").isNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("turns")
    return out.select(*kept, *grown, first)
