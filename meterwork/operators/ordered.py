"""Running values over ordered rows that survive a key holding a large share of all rows.

A plain window sorts one key's rows in one task. Here the ordered rows of a key
are cut into chunks that follow the order; values run inside (key, chunk), one
small row per (key, chunk) carries the state over, and both are combined. Sums,
maxima and "last non-null" are associative, so the result is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Line order of a source: file, then split, then line, then position inside the line.
ORDER = ["file", "block_start", "line_no", "pos"]
CHUNK_ROWS = 1 << 16


@dataclass(frozen=True)
class Running:
    name: str
    kind: str  # last | sum | max
    value: Column
    inclusive: bool = False


def line_chunk(rows: int = CHUNK_ROWS) -> list[Column]:
    """Chunk of a log line; it never crosses a file split and follows ``ORDER``."""
    return [F.col("file").alias("_f"), F.col("block_start").alias("_b"), F.floor(F.col("line_no") / rows).alias("_c")]


def order_struct() -> Column:
    return F.struct(*ORDER)


def running(df: DataFrame, keys: list[str], specs: list[Running], chunk: list[Column] | None = None,
            order: list[str] | None = None) -> DataFrame:
    """Add one column per spec: the value over earlier rows of the same key (and the row itself if inclusive).

    ``keys`` must not be NULL. Reads ``df`` twice, so give it a staged or cheap input.
    """
    order = order or ORDER
    columns = df.columns
    inputs = {s.name: f"_in_{s.name}" for s in specs}
    chunk = line_chunk() if chunk is None else chunk
    parts = [f"_p{i}" for i in range(len(chunk))]
    rows = df.select("*", *[c.alias(n) for c, n in zip(chunk, parts)], *[s.value.alias(inputs[s.name]) for s in specs])
    place = F.struct(*order)

    def total(s: Running) -> Column:
        col = F.col(inputs[s.name])
        if s.kind == "last":
            return F.max_by(col, F.when(col.isNotNull(), place))
        return {"sum": F.sum, "max": F.max}[s.kind](col)

    def over(s: Running, col: Column, window) -> Column:
        if s.kind == "last":
            return F.last(col, ignorenulls=True).over(window)
        return {"sum": F.sum, "max": F.max}[s.kind](col).over(window)

    totals = rows.groupBy(*keys, *parts).agg(*[total(s).alias(f"_t_{s.name}") for s in specs])
    before = Window.partitionBy(*keys).orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, *parts, *[over(s, F.col(f"_t_{s.name}"), before).alias(f"_k_{s.name}") for s in specs])

    inside = Window.partitionBy(*keys, *parts).orderBy(*order)
    local = rows.select(
        "*",
        *[
            over(s, F.col(inputs[s.name]), inside.rowsBetween(Window.unboundedPreceding, 0 if s.inclusive else -1)).alias(f"_l_{s.name}")
            for s in specs
        ],
    )

    def combined(s: Running) -> Column:
        near, far = F.col(f"_l_{s.name}"), F.col(f"_k_{s.name}")
        if s.kind == "last":
            return F.coalesce(near, far)
        if s.kind == "sum":
            return F.coalesce(near, F.lit(0)) + F.coalesce(far, F.lit(0))
        return F.greatest(near, far)

    return local.join(carried, keys + parts).select(*columns, *[combined(s).alias(s.name) for s in specs])
