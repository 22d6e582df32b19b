"""Raw log readers (S25, S27, S28): one row per line or per document, with its place in the source."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import parse_once
from ..functions.times import DAY_MS, HOUR_MS
from ..operators.ordered import ORDER, Running, running
from ..session import stage

LINE_COLUMNS = ["file", "block_start", "line_no", "pos", "value", "mtime"]
LINE_SCHEMA = "file string, block_start bigint, line_no bigint, pos bigint, value string, mtime string"
ISO_MS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def plain_path(path: Column) -> Column:
    """A path as its folder names spell it; file sources give it with blanks and other signs percent-encoded."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:///")


def _reader(spark: SparkSession, glob: str | None, modified_after: str | None):
    reader = spark.read.option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").option(
        "ignoreCorruptFiles", "true"
    )
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    return reader


def _placed(df: DataFrame) -> DataFrame:
    # The id is taken directly above the scan, so it grows with the line inside a file split.
    return df.select(
        plain_path(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_no"),
        F.lit(0).cast("bigint").alias("pos"),
        "value",
        F.date_format("_metadata.file_modification_time", ISO_MS).alias("mtime"),
    )


def read_lines(spark: SparkSession, paths: str | list[str], glob: str | None = "*.jsonl",
               modified_after: str | None = None) -> DataFrame:
    """Lines of every matching file below the roots; unreadable files give nothing."""
    return _placed(_reader(spark, glob, modified_after).option("lineSep", "\n").text(paths))


def read_documents(spark: SparkSession, paths: str | list[str], glob: str | None = "*.json",
                   modified_after: str | None = None) -> DataFrame:
    """Whole files, one row each."""
    return _placed(_reader(spark, glob, modified_after).text(paths, wholetext=True))


SPLIT_BYTES = 1 << 25


def listed_lines(files: DataFrame, tasks: int) -> DataFrame:
    """(path, block_start, value, mtime) of the lines of (path, size, mtime_ms), files that tasks mount, as a text scan gives them.

    Tasks open the files by their names, long ones in splits, so the driver holds none of them. A split's lines stand
    together and in order. Also on streams.
    """
    splits = files.select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(SPLIT_BYTES).cast("bigint"))).alias("start"), "size", "mtime_ms")
    ends = splits.select("path", "start", F.least("size", F.col("start") + SPLIT_BYTES).alias("end"), "mtime_ms")
    lines = ends.repartition(tasks).mapInArrow(_read_splits, "path string, block_start bigint, value binary, mtime_ms bigint")
    return lines.select("path", "block_start", F.col("value").cast("string").alias("value"), F.date_format(F.timestamp_millis("mtime_ms"), ISO_MS).alias("mtime"))


def _read_splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for batch in batches:
        for path, start, end, mtime_ms in zip(*(c.to_pylist() for c in batch.columns)):
            name = "file://" + quote(path)
            for line in _split_lines(path, start, end):
                rows.append((name, start, line, mtime_ms))
                held += len(line) + len(name)
                if held >= 1 << 22 or len(rows) >= 1 << 14:
                    yield _line_batch(rows)
                    rows, held = [], 0
    if rows:
        yield _line_batch(rows)


def _line_batch(rows: list[tuple[str, int, bytes, int]]) -> pa.RecordBatch:
    names, types = ("path", "block_start", "value", "mtime_ms"), (pa.string(), pa.int64(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], list(names))


def _split_lines(path: str, start: int, end: int) -> Iterator[bytes]:
    """Lines that begin at ``start`` or later and before ``end``; a byte order mark is no part of the first."""
    with open(path, "rb", buffering=1 << 16) as f:
        if start:
            f.seek(start - 1)
            f.readline()
        elif f.read(3) != b"\xef\xbb\xbf":
            f.seek(0)
        at = f.tell()
        while at < end and (line := f.readline()):
            at += len(line)
            yield line.removesuffix(b"\n")


def live_cutoff(now: dt.datetime) -> str:
    """Lower bound of file times for the live view, the earlier of six hours ago and just before midnight."""
    since_midnight = (now - now.replace(hour=0, minute=0, second=0, microsecond=0)).total_seconds() * 1000
    back = max(6 * HOUR_MS, min(max(since_midnight, 0), 1.5 * DAY_MS) + 60_000)
    return (now - dt.timedelta(milliseconds=back)).strftime("%Y-%m-%dT%H:%M:%S")


def recent_files(lines: DataFrame, now: dt.datetime) -> DataFrame:
    """S25 on a table of lines that already carries ``mtime``."""
    return lines.filter(F.col("mtime") >= live_cutoff(now))


def table_lines(df: DataFrame, file: Column, line_no: Column, value: Column, mtime: Column | None = None) -> DataFrame:
    """Lines held in any table instead of files."""
    return df.select(
        file.alias("file"),
        F.lit(0).cast("bigint").alias("block_start"),
        line_no.cast("bigint").alias("line_no"),
        F.lit(0).cast("bigint").alias("pos"),
        value.alias("value"),
        (F.lit(None).cast("string") if mtime is None else mtime).alias("mtime"),
    )


def parsed(lines: DataFrame) -> DataFrame:
    """Lines that are JSON, as ``v``; blank, malformed and null lines are gone."""
    return judged(lines).filter("fault IS NULL").drop("fault")


def judged(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every line with its JSON as ``v`` and what is wrong with it as ``fault``: blank, malformed (truncated lines too) or null.

    Columns named by ``keep`` stay beside the line's place.
    """
    place = ["file", "block_start", "line_no", "pos", "mtime", *keep]
    blank = F.length(F.btrim("value", F.lit(" \t\r\n"))) == 0
    node = F.try_parse_json(F.make_valid_utf8("value"))
    rows = parse_once(lines, F.struct(node.alias("v"), blank.alias("blank")), place, "p")
    v = F.col("p.v")
    fault = F.when(F.col("p.blank"), "blank").when(v.isNull(), "malformed").when(F.is_variant_null(v), "null")
    return rows.select(*place, v.alias("v"), fault.alias("fault"))


def with_places(lines: DataFrame) -> DataFrame:
    """Add a line's number in its file and the byte at which it starts, from 0; a file of any length is counted in chunks.

    Sizes are taken from ``bytes`` where lines carry that column, else from their text.
    """
    size = F.col("bytes") if "bytes" in lines.columns else _bytes()
    return running(lines, ["file"], [Running("line", "sum", F.lit(1).cast("bigint")), Running("byte_at", "sum", size)])


def _bytes() -> Column:
    return (F.octet_length("value") + 1).cast("bigint")


def fault_places(lines: DataFrame) -> DataFrame:
    """(file, line, byte_at, fault) of every line that cannot be read.

    The log is read once: its lines are staged with their size and fault, without their text, and counted there.
    """
    sized = judged(lines.withColumn("bytes", _bytes()), ("bytes",)).select(*ORDER, "bytes", "fault")
    return with_places(stage(sized, "line-faults")).filter("fault IS NOT NULL").select("file", "line", "byte_at", "fault")


def line_report(lines: DataFrame) -> DataFrame:
    """Per file, its lines, those that are read, and what the others suffer from."""
    n = lambda fault: F.count(F.when(F.col("fault") == fault, 1))
    return judged(lines).groupBy("file").agg(
        F.count("*").alias("lines"), F.count(F.when(F.col("fault").isNull(), 1)).alias("read"), *[n(x).alias(x) for x in ("blank", "malformed", "null")])


def explode_nodes(df: DataFrame, nodes: Column, keep: list[str]) -> DataFrame:
    """One row per array element, ``pos`` being its place in the array."""
    return df.select(*keep, F.posexplode(nodes).alias("pos", "v")).withColumn("pos", F.col("pos").cast("bigint"))
