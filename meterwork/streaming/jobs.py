"""Structured Streaming jobs (R1-R6). Each has a batch operator as its twin.

Logs must land as new files; the file source does not see appends. A stateful
step writes a table and the next step reads it, so no query stacks two.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.measures import MEASURES, TOKENS, sums, total_tokens, zero
from ..functions.times import DAY_MS, HOUR_MS, instant
from ..operators.blocks import BLOCK_MS, STRETCH_MS, build_blocks, burn_level, burn_rate
from ..operators.deltas import COUNTERS
from ..operators.ordered import Running, line_chunk, running
from ..operators.prices import with_cost
from ..operators.usage import USAGE_COLUMNS, Facts
from ..session import remove, stage
from ..sources import claude, codex
from ..sources.files import LISTED, land_lists, mounted
from ..sources.lines import ISO_MS, listed_lines, plain_path

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}


def use_state_store(spark: SparkSession) -> None:
    """Arbitrary stateful steps need the RocksDB state store."""
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)


def stream_lines(spark: SparkSession, paths: str, glob: str = "*.jsonl", files_per_batch: int | None = None, bytes_per_batch: int = 1 << 30,
                 listed: str | None = None) -> DataFrame:
    """The text of new log files as a stream. Its lines get their places inside a batch, see ``placed``.

    A batch ends with the file that reaches ``bytes_per_batch``: logs are many small files, and a batch costs the same
    jobs however little it holds. ``files_per_batch`` counts files instead.

    Spark's file source keeps every file it has seen on the driver, some kilobytes each. With ``listed``, a folder that
    belongs to this stream as its checkpoint does, tasks list the files below ``paths``, a folder, and land the new ones
    there; the stream reads these lists, one a batch, and tasks open the files that they name. It holds the files that
    were there when this was called. That needs a folder that tasks mount; on other file systems ``listed`` is not used.
    """
    folder = None if listed is None else mounted(spark, paths)
    if folder is not None:
        land_lists(spark, folder, glob, listed, bytes_per_batch, files_per_batch)
        lists = spark.readStream.schema(LISTED).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(listed)
        return listed_lines(lists, 2 * spark.sparkContext.defaultParallelism)
    limit = ("maxBytesPerTrigger", bytes_per_batch) if files_per_batch is None else ("maxFilesPerTrigger", files_per_batch)
    text = (
        spark.readStream.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .option(*limit)
        .option("lineSep", "\n")
        .text(paths)
    )
    return text.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        "value",
        F.date_format("_metadata.file_modification_time", ISO_MS).alias("mtime"),
    )


def placed(batch: DataFrame) -> DataFrame:
    """A batch of ``stream_lines`` as the placed lines every adapter takes.

    A split's lines stand together and in order, so numbers given here grow with the line inside a split.
    """
    return batch.select(
        plain_path(F.col("path")).alias("file"),
        "block_start",
        F.monotonically_increasing_id().alias("line_no"),
        F.lit(0).cast("bigint").alias("pos"),
        "value",
        "mtime",
    )


def ingest(lines: DataFrame, parse: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, then: Callable[[], None] | None = None):
    """Run an adapter's parser on each batch of whole files and append the rows to ``table``.

    A file arrives whole in one batch, so file-local state (sticky models,
    snapshots) is complete inside the batch. The batch id names the folder:
    a repeated batch replaces its own output. ``then`` runs after each batch
    has landed, e.g. a stateful step that must see one batch at a time.
    """
    def land(batch: DataFrame, batch_id: int) -> None:
        parse(batch).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
        if then:
            then()

    return lines.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True)


GROWTH = ["message_id", "file", "day", "model"]
BEFORE = [f"before_{c}" for c in COUNTERS]


def growth_lines(lines: DataFrame) -> DataFrame:
    """R2 input: of the counted lines with a message id those that raise a counter above all earlier lines of the batch.

    Meant for ``ingest``: the highest value before each line comes from the
    chunked running maximum of W1, so an id that fills a third of a batch is
    spread over tasks, and lines that add nothing never reach the stateful step.
    ``opens`` marks the id's first line in the batch.
    """
    place = [F.col(x) if x in lines.columns else F.lit(0).cast("bigint").alias(x) for x in ("block_start", "pos")]
    counted = lines.filter(F.col("counted") & F.col("message_id").isNotNull()).select(*GROWTH, *place, "line_no", *COUNTERS)
    specs = [Running(b, "max", F.col(c)) for b, c in zip(BEFORE, COUNTERS)] + [Running("_seen", "max", F.lit(1))]
    placed = running(counted, ["message_id"], specs, line_chunk())
    opens = F.col("_seen").isNull()
    raises = F.array_max(F.array(*[F.col(c) > F.greatest(F.coalesce(b, F.lit(0)), F.lit(0)) for b, c in zip(BEFORE, COUNTERS)]))
    return placed.filter(opens | raises).select(*GROWTH, "line_no", *COUNTERS, *[F.coalesce(b, F.lit(0)).alias(b) for b in BEFORE], opens.alias("opens"))


def lone_lines(lines: DataFrame) -> DataFrame:
    """R2: counted lines without a message id need no state; each is a turn of its own."""
    lone = lines.filter(F.col("counted") & F.col("message_id").isNull())
    return lone.select(*GROWTH, "line_no", *COUNTERS, F.lit(1).cast("bigint").alias("turns"))


class _Deltas(StatefulProcessor):
    """Highest counters seen per message id in earlier batches; rows of a batch may come in any order."""

    def __init__(self, keep_ms: int | None) -> None:
        self._keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField(c, T.LongType()) for c in COUNTERS])
        self._high = handle.getValueState("high", schema, self._keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stored = self._high.get()
        first, base = stored is None, [0] * len(COUNTERS) if stored is None else list(stored)
        high = list(base)
        for row in rows:
            added = {c: max(0, row[c] - max(h, row[b])) for c, b, h in zip(COUNTERS, BEFORE, base)}
            high = [max(h, row[c]) for h, c in zip(high, COUNTERS)]
            turn = int(first and row["opens"])
            if turn or any(added.values()):
                yield Row(**{c: row[c] for c in [*GROWTH, "line_no"]}, **added, turns=turn)
        self._high.update(tuple(high))

    def close(self) -> None:
        pass


def message_deltas_stream(growth: DataFrame, keep: dt.timedelta | None = None) -> DataFrame:
    """R2: running-max deltas per message id from the landed ``growth_lines``, equal to W1 line by line.

    A micro-batch must hold one landed batch: run it as the ``then`` of ``ingest``. State of ids that did not grow
    for ``keep`` is dropped; without it every id is kept.
    """
    out = T.StructType(
        [T.StructField(c, T.StringType()) for c in GROWTH]
        + [T.StructField("line_no", T.LongType())]
        + [T.StructField(c, T.LongType()) for c in [*COUNTERS, "turns"]]
    )
    keep_ms = None if keep is None else int(keep.total_seconds() * 1000)
    return (
        growth.select(*GROWTH, "line_no", *COUNTERS, *BEFORE, "opens")
        .groupBy("message_id")
        .transformWithState(_Deltas(keep_ms), outputStructType=out, outputMode="Append", timeMode="None" if keep is None else "ProcessingTime")
    )


def message_deltas_job(lines: DataFrame, work: str, keep: dt.timedelta | None = None):
    """R2: land growth batch by batch under ``work`` and turn each into deltas at ``work``/deltas before the next one lands."""
    spark = lines.sparkSession

    def follow() -> None:
        growth = spark.readStream.schema(_growth_schema()).parquet(f"{work}/growth")
        # One batch; state with an age would otherwise ask for further batches without end.
        run_to_table(message_deltas_stream(growth, keep), f"{work}/deltas", f"{work}/deltas-checkpoint", one_batch=True)

    return ingest(lines, growth_lines, f"{work}/growth", f"{work}/growth-checkpoint", follow)


def _growth_schema() -> str:
    types = {**dict.fromkeys(GROWTH, "string"), "opens": "boolean"}
    return ", ".join(f"{c} {types.get(c, 'bigint')}" for c in [*GROWTH, "line_no", *COUNTERS, *BEFORE, "opens"])


def claude_text_job(lines: DataFrame, work: str, keep: dt.timedelta | None = None, zone: str | None = None):
    """Transcripts as text, from ``stream_lines``, to usage under ``work``; read it with ``claude_usage``.

    Every batch lands its parsed lines, then the lines whose counters grow; these go through the state of their
    message ids before the next batch is taken. All three folders are named by batch, so a repeated batch replaces
    what it wrote.
    """
    spark = lines.sparkSession

    def land(batch: DataFrame, batch_id: int) -> None:
        claude.assistant_lines(placed(batch), zone).write.mode("overwrite").parquet(f"{work}/lines/batch={batch_id}")
        rows = spark.read.parquet(f"{work}/lines/batch={batch_id}")
        growth_lines(rows).write.mode("overwrite").parquet(f"{work}/growth/batch={batch_id}")
        lone_lines(rows).write.mode("overwrite").parquet(f"{work}/lone/batch={batch_id}")
        growth = spark.readStream.schema(_growth_schema()).parquet(f"{work}/growth")
        run_to_table(message_deltas_stream(growth, keep), f"{work}/deltas", f"{work}/deltas-checkpoint", one_batch=True)

    return lines.writeStream.foreachBatch(land).option("checkpointLocation", f"{work}/lines-checkpoint").trigger(availableNow=True)


def claude_usage(spark: SparkSession, work: str) -> DataFrame:
    """Usage that ``claude_text_job`` has counted so far: (agent_id, session_id, file, day, model, measures)."""
    counted = [*GROWTH, "line_no", *COUNTERS, "turns"]
    both = spark.read.parquet(f"{work}/deltas").select(*counted).unionByName(spark.read.parquet(f"{work}/lone").select(*counted))
    used = both.filter(sum((F.col(c) for c in TOKENS), F.col("turns")) > 0)
    none = [zero(m) for m in MEASURES if m not in (*COUNTERS, "turns")]
    return used.select(F.lit(claude.AGENT).alias("agent_id"), F.col("file").alias("session_id"), "file", "day", "model", *COUNTERS, "turns", *none).select(
        "agent_id", "session_id", "file", "day", "model", *MEASURES)


def codex_text_job(lines: DataFrame, work: str, keep: str | None = None):
    """Rollouts as text, from ``stream_lines``, to events, calls and sessions under ``work``; read them with ``codex_facts``.

    A file arrives whole, so its counters, models and replays are settled inside its batch by the batch operators.
    Copies of an event in files of other batches are dropped by a stream over the landed events; with ``keep`` its
    state forgets identities that long after their time, without it none.
    """
    spark = lines.sparkSession

    def land(batch: DataFrame, batch_id: int) -> None:
        events, calls, seen = codex.parts(stage(placed(batch), "rollouts"))
        for name, df in (("events", events.withColumn("ts", instant(F.col("ts_raw")))), ("calls", calls), ("sessions", seen)):
            df.write.mode("overwrite").parquet(f"{work}/{name}/batch={batch_id}")
        landed = spark.readStream.schema(spark.read.parquet(f"{work}/events/batch={batch_id}").schema).parquet(f"{work}/events")
        kept = landed.dropDuplicates(["identity"]) if keep is None else first_of(landed, ["identity"], "ts", keep)
        run_to_table(kept, f"{work}/kept", f"{work}/kept-checkpoint", one_batch=True)

    return lines.writeStream.foreachBatch(land).option("checkpointLocation", f"{work}/rollouts-checkpoint").trigger(availableNow=True)


def codex_facts(spark: SparkSession, work: str) -> Facts:
    """Facts of all rollouts that ``codex_text_job`` has read so far."""
    events = spark.read.parquet(f"{work}/kept")
    return Facts(events.select(*USAGE_COLUMNS), codex.priced_calls(spark.read.parquet(f"{work}/calls"), events), spark.read.parquet(f"{work}/sessions").drop("batch"))


def first_of(stream: DataFrame, keys: list[str], event_time: str = "ts", delay: str = "1 day") -> DataFrame:
    """Drop copies of a record, tool call or span that come within the watermark delay."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def daily_usage_stream(usage: DataFrame, keys: list[str] | None = None, delay: str = "1 day", length: str = "1 day",
                       slide: str | None = None) -> DataFrame:
    """Usage per day and model; late rows within ``delay`` still count. A longer ``length`` with a
    one-day ``slide`` gives the 7-day and 30-day views."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (
        usage.withWatermark("ts", delay)
        .groupBy(window.alias("w"), *(keys or []), "model")
        .agg(*sums())
        .select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), *(keys or []), "model", *MEASURES)
    )


def daily_cost_job(usage: DataFrame, work: str, live: DataFrame | None = None, delay: str = "1 day", length: str = "1 day", slide: str | None = None):
    """Priced usage by day and model; finished windows under ``work``/cost, what came too late under ``work``/late.

    A batch is first summed by day and model, so the windows see a few rows of it, and each sum carries the batch's
    latest time of its day. The windows run over the landed sums one batch at a time; those that the watermark ends
    are priced as they leave, with ``live`` as it is then, and a window that has left takes nothing more. ``late``
    counts, per batch, the sums that came for such windows, as the query's progress tells.
    """
    spark = usage.sparkSession

    def by_day(batch: DataFrame) -> DataFrame:
        return batch.groupBy(F.date_trunc("day", "ts").alias("_day"), "model").agg(*sums(), F.max("ts").alias("ts")).drop("_day")

    def price(done: DataFrame, batch_id: int) -> None:
        with_cost(done, live).drop("price").write.mode("overwrite").parquet(f"{work}/cost/batch={batch_id}")

    def follow() -> None:
        days = spark.readStream.schema(spark.read.parquet(f"{work}/days").drop("batch").schema).parquet(f"{work}/days")
        windows = daily_usage_stream(days, delay=delay, length=length, slide=slide)
        query = windows.writeStream.outputMode("append").foreachBatch(price).option("checkpointLocation", f"{work}/cost-checkpoint").trigger(once=True).start()
        query.awaitTermination()
        rows = [(int(p["batchId"]), sum(int(o["numRowsDroppedByWatermark"]) for o in p["stateOperators"])) for p in map(_as_dict, query.recentProgress)]
        for batch_id in {b for b, _ in rows}:  # one batch, and perhaps one more that only moves the watermark
            kept = spark.createDataFrame([(b, n) for b, n in rows if b == batch_id], "batch_id bigint, late_sums bigint")
            kept.write.mode("overwrite").parquet(f"{work}/late/batch={batch_id}")

    return ingest(usage, by_day, f"{work}/days", f"{work}/days-checkpoint", follow)


def _as_dict(progress) -> dict:
    return progress if isinstance(progress, dict) else json.loads(progress.json)


class _Blocks(StatefulProcessor):
    """The open block of a key; a closed one is emitted when a later bucket or the timer ends it."""

    FIELDS = ["start", "end", "first_ts", "last_ts", "total_tokens", "late"]

    def __init__(self, length_ms: int) -> None:
        self._length = length_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        schema = T.StructType([T.StructField(f, T.LongType()) for f in self.FIELDS] + [T.StructField("cost_usd", T.DoubleType())])
        self._open = handle.getValueState("open", schema)

    def _load(self):
        block = self._open.get()
        return None if block is None else list(block)

    @staticmethod
    def _closed(key, block: list) -> Row:
        start, end, first, last, tokens, late, cost = block
        return _BLOCK(key[0], start, end, first, last, tokens, cost, late, True)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        block, done = self._load(), []
        seen: dict[int, list] = {}  # one entry per hour, however many rows a batch holds of it
        for row in rows:
            for bucket, first, last, events, tokens, cost in zip(*(row[c] for c in BUCKET)):
                kept = seen.setdefault(bucket, [0, first, last, 0, 0.0])
                kept[:] = kept[0] + events, min(kept[1], first), max(kept[2], last), kept[3] + tokens, kept[4] + cost
        for bucket in sorted(seen):
            events, first, last, tokens, cost = seen[bucket]
            if block is not None and bucket < block[0]:
                # A boundary that was emitted cannot move; the batch job is the correction path.
                block[5] += events
                continue
            if block is None or bucket >= block[1]:
                if block is not None:
                    done.append(self._closed(key, block))
                start = bucket // HOUR_MS * HOUR_MS
                block = [start, start + self._length, first, last, 0, 0, 0.0]
            block[2], block[3] = min(block[2], first), max(block[3], last)
            block[4] += tokens
            block[6] += cost
        if block is not None:
            self._open.update(tuple(block))
            if timerValues.getCurrentWatermarkInMs() >= 0:
                self._handle.registerTimer(block[1])
        yield from done

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        block = self._load()
        # A timer of a block that later input already closed finds another block open.
        if block is not None and block[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self._open.clear()
            yield self._closed(key, block)

    def close(self) -> None:
        pass


BLOCK_DDL = (
    "key string, block_start bigint, block_end bigint, first_ts bigint, last_ts bigint, "
    "total_tokens bigint, cost_usd double, late_events bigint, closed boolean"
)
_BLOCK = Row(*(field.split()[0] for field in BLOCK_DDL.split(", ")))


BUCKET = ["bucket", "first_ts", "last_ts", "events", "total_tokens", "cost_usd"]
PACK_DDL = "key string, ts timestamp, " + ", ".join(f"{c} array<{'double' if c == 'cost_usd' else 'bigint'}>" for c in BUCKET)
DELAY_MS = HOUR_MS


def block_stream(packs: DataFrame, length_ms: int = BLOCK_MS) -> DataFrame:
    """Anchored blocks from the landed packs of ``block_hours_job``.

    A row that reaches a Python state step costs as much as a thousand numbers in an array, so a key sends one row per
    month and batch, however many events, models and hours it has.
    """
    return (
        packs.select("key", "ts", *BUCKET)
        .withWatermark("ts", f"{DELAY_MS} milliseconds")
        .groupBy("key")
        .transformWithState(_Blocks(length_ms), outputStructType=BLOCK_DDL, outputMode="Append", timeMode="EventTime")
    )


def packed_hours(rows: DataFrame, landed_ms: int | None = None) -> DataFrame:
    """Rows of ``hourly_rows``, a key's hours of a month side by side in arrays; ``ts`` is the latest of them.

    ``landed_ms`` is the latest time in earlier batches. Hours that a watermark of those may have passed are packed with
    hours of the very same time only, so what is late is still left out hour by hour.
    """
    passed = F.lit(None).cast("bigint") if landed_ms is None else F.when(F.col("last_ts") <= landed_ms - DELAY_MS, F.col("last_ts"))
    month = F.floor(F.col("bucket") / STRETCH_MS)
    packs = rows.groupBy("key", month.alias("_month"), passed.alias("_passed")).agg(F.max("ts").alias("ts"), F.collect_list(F.struct(*BUCKET)).alias("_hours"))
    return packs.select("key", "ts", *[F.col("_hours")[c].alias(c) for c in BUCKET])


def block_hours_job(usage: DataFrame, key: Column, work: str, length_ms: int = BLOCK_MS, live: DataFrame | None = None):
    """Land the packed hours of each batch of usage at ``work``/hours, for ``block_stream``.

    Beside them the latest time landed so far is kept, a row per batch. A micro-batch of ``block_stream`` must hold whole
    landed batches, as it does unless its files are counted.
    """
    def land(batch: DataFrame, batch_id: int) -> None:
        spark, landed_ms = batch.sparkSession, None
        if batch_id:
            landed_ms = spark.read.schema("landed_ms bigint").parquet(f"{work}/landed/batch={batch_id - 1}").first()[0]
        path = f"{work}/hours/batch={batch_id}"
        packed_hours(hourly_rows(batch, key, length_ms, live), landed_ms).write.mode("overwrite").parquet(path)
        latest = spark.read.schema(PACK_DDL).parquet(path).agg(F.max(F.unix_millis("ts")).alias("ms"))
        latest.select(F.greatest("ms", F.lit(landed_ms).cast("bigint")).alias("landed_ms")).write.mode("overwrite").parquet(f"{work}/landed/batch={batch_id}")

    return usage.writeStream.foreachBatch(land).option("checkpointLocation", f"{work}/hours-checkpoint").trigger(availableNow=True)


def hourly_rows(usage: DataFrame, key: Column, length_ms: int = BLOCK_MS, live: DataFrame | None = None) -> DataFrame:
    """R5 input for one batch of usage (a static DataFrame): priced hourly buckets."""
    from ..operators.blocks import hourly_buckets

    summed = hourly_buckets(usage.withColumn("key", key), ["key"], length_ms)
    events = F.col("turns").alias("events")
    return with_cost(summed, live).select(
        "key",
        F.timestamp_millis("last_ts").alias("ts"),
        "bucket",
        "first_ts",
        "last_ts",
        events,
        total_tokens().alias("total_tokens"),
        "cost_usd",
    )


def live_view(daily: DataFrame, blocks: DataFrame, today: str, now_ms: int, live: DataFrame | None = None) -> DataFrame:
    """Spend today, tokens of the active block and its pace, per key.

    daily(key, day, model, measures) and blocks as the batch operators give them.
    """
    priced = with_cost(daily.filter(F.col("day") == today), live)
    spent = priced.groupBy("key").agg(F.sum("cost_usd").alias("today_usd"))
    pace = burn_rate(blocks, now_ms).select(
        "key",
        F.col("cost_usd").alias("block_usd"),
        "remaining_ms",
        "tokens_per_minute",
        "cost_per_hour",
        burn_level(F.col("tokens_per_minute")).alias("level"),
    )
    return spent.join(pace, "key", "full_outer").withColumn("today_usd", F.coalesce("today_usd", F.lit(0.0)))


COMPACT_EVERY = 50


def live_job(usage_stream: DataFrame, state_table: str, view_table: str, checkpoint: str, now: Callable[[], dt.datetime],
             keep: dt.timedelta | None = None):
    """Keep hourly usage per key as a partial table and rewrite the view after every batch.

    With ``keep`` the state forgets what is older, see ``forgetful_live_job``; without it every hour is kept, and usage
    of any age may still move the blocks after it.

    Whole files are pruned, never hours of a file: with an ``mtime`` column, rows of files last touched before the
    live cutoff (S25) are left out as they arrive. Each batch writes its own hourly sums (replacing them if it is
    repeated); every ``COMPACT_EVERY`` batches the sums so far become one folder, so the table holds one row per
    (key, hour, model) plus the batches since. ``now`` is asked once per batch.
    """
    from ..sources.lines import live_cutoff

    def update(batch: DataFrame, batch_id: int) -> None:
        at = now()
        now_ms = int(at.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
        kept = batch.filter(F.col("mtime") >= live_cutoff(at)) if "mtime" in batch.columns else batch
        hour = F.floor(F.col("ts_ms") / HOUR_MS) * HOUR_MS
        # The first and the last event of an hour are kept apart: blocks show both times.
        first, last = F.min("ts_ms").alias("ts_ms"), F.max("ts_ms").alias("until_ms")
        partial = kept.groupBy("key", "day", "model", hour.alias("hour_ms")).agg(*sums(), first, last)
        partial.write.mode("overwrite").parquet(f"{state_table}/batch={batch_id}")
        spark = batch.sparkSession
        base = batch_id // COMPACT_EVERY * COMPACT_EVERY
        if batch_id and base == batch_id:
            before = read(spark, partial.schema, max(0, base - COMPACT_EVERY), base - 1)
            merged = before.groupBy("key", "day", "model", "hour_ms").agg(*sums(), F.min("ts_ms").alias("ts_ms"), F.max("until_ms").alias("until_ms"))
            merged.write.mode("overwrite").parquet(f"{state_table}/upto={base - 1}")
        known = read(spark, partial.schema, base, batch_id)
        daily = known.groupBy("key", "day", "model").agg(*sums())
        none = [F.lit(0).cast("bigint").alias(m) for m in MEASURES]
        ends = known.select("key", "day", "model", F.col("until_ms").alias("ts_ms"), *none)
        blocks = build_blocks(known.select("key", "day", "model", "ts_ms", *MEASURES).unionByName(ends), ["key"], now_ms)
        live_view(daily, blocks, at.strftime("%Y-%m-%d"), now_ms).write.mode("overwrite").parquet(view_table)

    if keep is not None:
        return forgetful_live_job(usage_stream, state_table, view_table, checkpoint, now, keep)

    def read(spark: SparkSession, schema: T.StructType, base: int, last: int) -> DataFrame:
        """The compacted sums before ``base`` and the batches from there on."""
        paths = ([f"{state_table}/upto={base - 1}"] if base else []) + [f"{state_table}/batch={k}" for k in range(base, last + 1)]
        return spark.read.schema(schema).parquet(*paths)

    return usage_stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True)


HOURS = ["key", "day", "model", "hour_ms"]


def forgetful_live_job(usage_stream: DataFrame, state_table: str, view_table: str, checkpoint: str, now: Callable[[], dt.datetime], keep: dt.timedelta):
    """R6 with state that does not grow with the stream's age.

    After each batch the state is written anew: the hours since ``now`` - ``keep`` (and since midnight), and per key
    the end of the last block that opened before them, from which the walk goes on. Closed blocks and past days are
    gone. Usage older than the kept hours is left out; keep at least a day and a block's length. The folder of a batch
    is made from the one before it, so a repeated batch gives the same state; older folders are removed.
    """
    if keep < dt.timedelta(milliseconds=BLOCK_MS + HOUR_MS):
        raise ValueError("keep more than a block and an hour")

    def update(batch: DataFrame, batch_id: int) -> None:
        spark, at = batch.sparkSession, now()
        now_ms = int(at.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
        midnight = now_ms // DAY_MS * DAY_MS
        oldest = min(now_ms - int(keep.total_seconds() * 1000), midnight) // HOUR_MS * HOUR_MS
        hour = F.floor(F.col("ts_ms") / HOUR_MS) * HOUR_MS
        arrived = batch.groupBy("key", "day", "model", hour.alias("hour_ms")).agg(*sums(), F.min("ts_ms").alias("ts_ms"), F.max("ts_ms").alias("until_ms"))
        before = f"{state_table}/hours/batch={batch_id - 1}"
        known, floor_ms = arrived, oldest
        anchors = spark.createDataFrame([], "key string, end bigint")
        if batch_id:
            old_hours, old_anchors = spark.read.schema(arrived.schema).parquet(before), spark.read.schema("key string, end bigint, floor_ms bigint").parquet(f"{state_table}/anchors/batch={batch_id - 1}")
            row = old_anchors.agg(F.max("floor_ms")).first()
            floor_ms, anchors = row[0] or 0, old_anchors.filter("key IS NOT NULL").drop("floor_ms")
            # Hours that were forgotten take no more usage: the walk has passed them.
            known = old_hours.unionByName(arrived.filter(F.col("hour_ms") >= floor_ms))
        merged = known.groupBy(*HOURS).agg(*sums(), F.min("ts_ms").alias("ts_ms"), F.max("until_ms").alias("until_ms"))
        hours = stage(merged, "live-hours")
        none = [F.lit(0).cast("bigint").alias(m) for m in MEASURES]
        ends = hours.select("key", "day", "model", F.col("until_ms").alias("ts_ms"), *none)
        blocks = stage(build_blocks(hours.select("key", "day", "model", "ts_ms", *MEASURES).unionByName(ends), ["key"], now_ms, entered=anchors), "live-blocks")
        live_view(hours.groupBy("key", "day", "model").agg(*sums()), blocks, at.strftime("%Y-%m-%d"), now_ms).write.mode("overwrite").parquet(view_table)
        oldest = max(oldest, floor_ms) if batch_id else oldest
        passed = blocks.filter(F.col("block_start") < oldest).groupBy("key").agg(F.max("block_end").alias("end"))
        alive = passed.unionByName(anchors).groupBy("key").agg(F.max("end").alias("end")).filter(F.col("end") > oldest)  # an older end opens nothing
        mark = spark.createDataFrame([(None, None, oldest)], "key string, end bigint, floor_ms bigint")
        alive.withColumn("floor_ms", F.lit(oldest)).unionByName(mark).write.mode("overwrite").parquet(f"{state_table}/anchors/batch={batch_id}")
        hours.filter(F.col("hour_ms") >= oldest).write.mode("overwrite").parquet(f"{state_table}/hours/batch={batch_id}")
        for name in ("hours", "anchors"):
            remove(spark, f"{state_table}/{name}/batch={batch_id - 2}")

    return usage_stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", one_batch: bool = False) -> DataFrame:
    """Process everything available, in one batch if asked, append it to a Parquet table and read the table back."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**({"once": True} if one_batch else {"availableNow": True}))
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
