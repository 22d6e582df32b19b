"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwork.session import stage

#: Rows up to which a table of a few narrow columns may be broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 200_000

#: A word: a run of anything but ASCII white space. ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def text_bytes(column: str = "text") -> Column:
    """A text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def is_held_out(id_column: str, folds: int, fold: int) -> Column:
    """True for rows whose crc32(id as text) mod ``folds`` is ``fold``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % folds == fold, F.lit(False))


def staged_small(df: DataFrame, label: str, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Write a table to the shared folder; say whether its counted rows may be broadcast."""
    out = stage(df, label)
    return out, out.count() <= rows


def join_side(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cut a batch of rows into runs of about ``most`` units; one row may exceed it."""
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def texts_of(batch: pa.RecordBatch, name: str = "_text") -> list[bytes]:
    return [t or b"" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def replaced(batch: pa.RecordBatch, schema: pa.Schema, **columns) -> pa.RecordBatch:
    """The batch's columns, or new ones of the given names, in the order of ``schema``."""
    names = batch.schema.names
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns else batch.column(names.index(f.name)) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def content_mark(text_column: str = "text") -> Column:
    """md5 of a text: tells rows that share an id apart."""
    return F.md5(text_bytes(text_column))


def unused(columns: list[str], name: str) -> str:
    """A name that none of ``columns`` has, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """All columns of ``docs`` as one struct ``_row``, which no internal name can clash with, and some more columns.

    ``unpacked`` gives the columns back, unchanged and in their order.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return docs.select(row, *[c.alias(n) for n, c in columns.items()])


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("_row.*")


def numbered(df: DataFrame, key: str, label: str, name: str = "_nth") -> DataFrame:
    """``df``, staged, with each row's number among the rows of its ``key`` (not null), from 1.

    Rows are numbered in stretches that follow the staged files; the rows of a key in earlier stretches, one count per
    stretch, are added. So a key that holds a third of all rows is numbered by many tasks.
    """
    rows = stage(df.withColumn("_at", F.monotonically_increasing_id()), label)
    rows = rows.withColumn("_stretch", F.shiftright("_at", 16))
    counts = rows.groupBy(F.col(key).alias("_k"), F.col("_stretch").alias("_s")).agg(F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_k", "_s", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    local = rows.withColumn("_local", F.row_number().over(Window.partitionBy(key, "_stretch").orderBy("_at")))
    met = local.join(before, (F.col(key) == F.col("_k")) & (F.col("_stretch") == F.col("_s")))
    return met.select(*df.columns, (F.col("_local") + F.col("_before")).alias(name))


def kept_rows(docs: DataFrame, decisions: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows of ``docs`` that ``decisions(id, mark, kept)``, a staged table with one row per document row, keeps.

    Rows are told by id. Ids that occur more than once (null among them) are told by id and ``content_mark``; of rows
    that agree in both as many stay as were kept.
    """
    ids = decisions.select(F.col(id_column).alias("_id"), F.col("mark").alias("_mark"), "kept")
    repeated, few = staged_small(ids.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1 OR _id IS NULL").select("_id"), "repeated")
    gone = ids.filter("NOT kept").select("_id")
    gone_few = gone.count() <= BROADCAST_ROWS
    ours = packed(docs, _doc=F.col(id_column))
    is_gone = F.col("_doc").eqNullSafe(F.col("_id"))
    if repeated.isEmpty():
        return unpacked(ours.join(join_side(gone, gone_few), is_gone, "left_anti"))
    again = join_side(repeated.withColumnRenamed("_id", "_again"), few)
    is_again = F.col("_doc").eqNullSafe(F.col("_again"))
    lone = ours.join(again, is_again, "left_anti").join(join_side(gone, gone_few), is_gone, "left_anti")
    told = lambda i, mark: F.md5(F.concat_ws("\x1f", F.coalesce(F.col(i).cast("string"), F.lit("\x1e")), F.col(mark)))
    shared = packed(docs, _doc=F.col(id_column), _m=content_mark(text_column)).join(again, is_again, "left_semi")
    nth = numbered(shared.withColumn("_told", told("_doc", "_m")), "_told", "repeated-rows")
    stay = ids.filter("kept").groupBy(told("_id", "_mark").alias("_t")).agg(F.count(F.lit(1)).alias("_stay"))
    chosen = nth.join(stay, (F.col("_told") == F.col("_t")) & (F.col("_nth") <= F.col("_stay")), "left_semi")
    return unpacked(lone.select("_row").unionByName(chosen.select("_row")))
