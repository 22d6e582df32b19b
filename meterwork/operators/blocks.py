"""Anchored fixed-length billing blocks.

The first event of a key opens a block at its hour; the block lasts a fixed
length; the first event at or after its end opens the next one. Every block
edge falls on an hour plus the fractional hour of the length, so events are
first summed into (key, half-hour-like bucket, model) with map-side partial
sums. A key's buckets are walked in stretches of about a month: each stretch
tells, for every end an earlier block may have, where its own last block ends;
these few rows per stretch are followed in order, and then every stretch knows
its open block and is walked by a task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import MEASURES, sums, total_tokens
from ..functions.text import short_model
from ..functions.times import DAY_MS, HOUR_MS, epoch_ms, round_half_up
from ..session import stage
from .prices import with_cost

BLOCK_MS = 5 * HOUR_MS
STRETCH_MS = 32 * DAY_MS


def hourly_buckets(events: DataFrame, keys: list[str], length_ms: int = BLOCK_MS) -> DataFrame:
    """Usage per key, bucket and model; ``bucket`` is the bucket's lower edge, ``hour`` the hour it lies in."""
    if length_ms < HOUR_MS:
        raise ValueError("a block lasts at least one hour")
    edge = length_ms % HOUR_MS
    ts = F.col("ts_ms")
    hour = F.floor(ts / HOUR_MS) * HOUR_MS
    bucket = hour if edge == 0 else F.when(ts - hour >= edge, hour + edge).otherwise(hour)
    return (
        events.filter(ts.isNotNull())
        .select(*keys, "model", "ts_ms", hour.alias("hour"), bucket.alias("bucket"), *MEASURES)
        .groupBy(*keys, "hour", "bucket", "model")
        .agg(*sums(), F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"))
    )


def bucket_blocks(buckets: DataFrame, keys: list[str], length_ms: int = BLOCK_MS, entered: DataFrame | None = None) -> DataFrame:
    """(keys, bucket, block_start) for every bucket; no task holds more of a key than one stretch of its history.

    ``entered`` is (keys, end): the end of a key's last block before its first bucket here, if that is known.
    """
    stretch_ms = max(STRETCH_MS, 4 * length_ms)
    stretch = F.floor(F.col("bucket") / stretch_ms).alias("stretch")
    seen = F.array_sort(F.collect_set(F.struct("bucket", "hour")))
    listed = buckets.select(*keys, "bucket", "hour", stretch).groupBy(*keys, "stretch").agg(seen.alias("seen"))
    none = F.lit(None).cast("bigint")
    if entered is not None:
        listed = listed.join(entered.withColumnRenamed("end", "_end"), keys, "left")
    known_end = none if entered is None else F.col("_end")

    def last_end(opened_by: Column) -> Column:
        """Where the last block of the stretch ends if ``opened_by`` opens its first one."""
        later = F.filter("seen", lambda b: b["bucket"] >= opened_by["bucket"])
        return F.aggregate(later, none, lambda end, b: F.when(end.isNull() | (b["bucket"] >= end), b["hour"] + length_ms).otherwise(end))

    # A block of an earlier stretch ends less than a length into this one, the one known before at its end: few buckets
    # can open the first block here.
    latest = F.greatest(F.col("stretch") * stretch_ms + length_ms, known_end)
    early = F.size(F.filter("seen", lambda b: b["bucket"] < latest))
    openers = F.slice("seen", 1, early + 1)
    exits = listed.select(*keys, "stretch", known_end.alias("_known"), F.transform(openers, lambda o: F.struct(o["bucket"].alias("bucket"), last_end(o).alias("end"))).alias("exits"))
    followed = exits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("stretch", "exits"))).alias("stretches"), F.max("_known").alias("_known"))
    state = F.struct(F.col("_known").alias("end"), F.lit([]).cast("array<struct<stretch:bigint,end:bigint>>").alias("entered"))

    def enter(acc: Column, s: Column) -> Column:
        opens = F.filter(s["exits"], lambda x: acc["end"].isNull() | (x["bucket"] >= acc["end"]))
        return F.struct(
            F.coalesce(F.try_element_at(opens, F.lit(1))["end"], acc["end"]).alias("end"),
            F.array_append(acc["entered"], F.struct(s["stretch"].alias("stretch"), acc["end"].alias("end"))).alias("entered"))

    known = followed.select(*keys, F.explode(F.aggregate("stretches", state, enter, lambda acc: acc["entered"])).alias("e"))
    known = known.select(*keys, "e.stretch", F.col("e.end").alias("entry_end"))
    walk = F.struct(F.col("entry_end").alias("end"), F.lit([]).cast("array<struct<bucket:bigint,start:bigint>>").alias("opened"))

    def step(acc: Column, b: Column) -> Column:
        opens = acc["end"].isNull() | (b["bucket"] >= acc["end"])
        opened = F.struct(b["bucket"].alias("bucket"), b["hour"].alias("start"))
        return F.when(opens, F.struct((b["hour"] + length_ms).alias("end"), F.array_append(acc["opened"], opened).alias("opened"))).otherwise(acc)

    met = listed.join(known, [*keys, "stretch"])
    walked = met.select(*keys, "stretch", "seen", "entry_end", F.aggregate("seen", walk, step, lambda acc: acc["opened"]).alias("opened"))
    every = walked.select(*keys, "stretch", "entry_end", F.explode("seen.bucket").alias("bucket"), none.alias("start"))
    openers = walked.select(*keys, "stretch", "entry_end", F.explode("opened").alias("o")).select(*keys, "stretch", "entry_end", "o.bucket", "o.start")
    marked = every.unionByName(openers).groupBy(*keys, "stretch", "bucket").agg(F.max("start").alias("start"), F.max("entry_end").alias("entry_end"))
    along = Window.partitionBy(*keys, "stretch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    start = F.coalesce(F.last("start", ignorenulls=True).over(along), F.col("entry_end") - length_ms)
    return marked.select(*keys, "bucket", start.alias("block_start"))


def block_models(events: DataFrame, keys: list[str], length_ms: int = BLOCK_MS, entered: DataFrame | None = None) -> DataFrame:
    """Usage per key, block and model."""
    buckets = stage(hourly_buckets(events, keys, length_ms), "block-buckets")
    placed = buckets.join(bucket_blocks(buckets, keys, length_ms, entered), [*keys, "bucket"])
    return placed.groupBy(*keys, "block_start", "model").agg(
        *sums(), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
    )


def build_blocks(events: DataFrame, keys: list[str], now_ms: int, length_ms: int = BLOCK_MS,
                 live: DataFrame | None = None, entered: DataFrame | None = None) -> DataFrame:
    """One row per block. Only a key's newest block can be active. ``entered``: see ``bucket_blocks``."""
    costed = with_cost(block_models(events, keys, length_ms, entered), live)
    blocks = costed.groupBy(*keys, "block_start").agg(
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.sum(total_tokens()).alias("total_tokens"),
        F.sum("cost_usd").alias("cost_usd"),
        F.array_sort(F.collect_set(short_model(F.col("model")))).alias("models"),
    )
    newest = F.max("block_start").over(Window.partitionBy(*keys))
    end = F.col("block_start") + length_ms
    return blocks.select(
        *keys,
        "block_start",
        end.alias("block_end"),
        "first_ts",
        "last_ts",
        "total_tokens",
        "cost_usd",
        "models",
        ((F.col("block_start") == newest) & (F.lit(now_ms) < end)).alias("active"),
    )


def usage_blocks(usage: DataFrame, keys: list[str], now_ms: int, length_ms: int = BLOCK_MS, live: DataFrame | None = None) -> DataFrame:
    """W9 from a log: blocks of a loader's usage events. Events without a readable timestamp belong to none."""
    # A generator keeps the parsed time as one column however often it is read.
    timed = usage.select(*dict.fromkeys([*keys, "model"]), *MEASURES, F.explode(F.array(epoch_ms(F.col("ts_raw")))).alias("ts_ms"))
    return build_blocks(timed, keys, now_ms, length_ms, live)


def burn_rate(blocks: DataFrame, now_ms: int) -> DataFrame:
    """Pace of active blocks and where it leads by the end of the block."""
    now = F.lit(now_ms)
    elapsed = F.greatest(F.lit(60_000), now - F.col("first_ts"))
    left = F.greatest(F.lit(0), F.col("block_end") - now)
    per_minute = F.col("total_tokens") / (elapsed / 60_000)
    per_hour = F.col("cost_usd") / (elapsed / HOUR_MS)
    return blocks.filter("active").select(
        "*",
        per_minute.alias("tokens_per_minute"),
        per_hour.alias("cost_per_hour"),
        round_half_up(F.col("total_tokens") + per_minute * (left / 60_000)).alias("projected_tokens"),
        (F.col("cost_usd") + per_hour * (left / HOUR_MS)).alias("projected_cost_usd"),
        left.alias("remaining_ms"),
    )


def biggest_done_block(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Highest token count of a finished block, 0 if none."""
    done = F.max(F.when(~F.col("active"), F.col("total_tokens")))
    return blocks.groupBy(*keys).agg(F.coalesce(done, F.lit(0)).alias("token_limit"))


def recent_blocks(blocks: DataFrame, now_ms: int, active_only: bool = False, recent_only: bool = False) -> DataFrame:
    """Only active blocks, or blocks with activity in the last three days."""
    if recent_only:
        blocks = blocks.filter(F.col("last_ts") >= now_ms - 3 * 24 * HOUR_MS)
    return blocks.filter("active") if active_only else blocks


def limit_level(tokens: Column, limit: Column, projected: Column | None = None) -> Column:
    """Against a token limit; an active block is over when its projection is, others have none."""
    reached = tokens if projected is None else F.coalesce(projected, tokens)
    return F.when(reached > limit, "over").when(tokens > limit * 0.8, "near").otherwise("ok")


def burn_level(per_minute: Column) -> Column:
    """Pace in tokens per minute."""
    return F.when(per_minute > 5000, "high").when(per_minute > 2000, "moderate").otherwise("normal")


def context_level(percent: Column) -> Column:
    """Share of the context window in percent."""
    return F.when(percent >= 80, "high").when(percent >= 50, "moderate").otherwise("normal")


def cache_level(rate: Column) -> Column:
    """Cache hit rate."""
    return F.when(rate > 0.8, "good").otherwise("low")
