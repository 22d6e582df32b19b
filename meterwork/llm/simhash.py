"""SimHash near-duplicates: tiles of fingerprints compared exactly with numpy exclusive-or and bit counts.

A text is lower-cased (A-Z), cut into words and shingles of ``words`` words; bit k of its fingerprint is 1 if set in
over half of the shingles' XXH64 values. Distinct fingerprints are dealt into tiles of one bit count each, tiles
whose bit counts differ by more than the radius are skipped (so many bits differ at least), and all others are
compared pair by pair inside numpy. A tile pair hands on a spanning forest of its links, not the links, so thousands
of near copies stay a few thousand rows. Components are found on the distinct fingerprints with distributed stars.

Cost: exact comparison grows with the square of the number of distinct fingerprints; the skip saves about half.

Defined results: null and empty texts have fingerprint zero and are linked like any other; fewer words than a
shingle make one shingle; null ids join components but never name one, unless a component has no other; repeated
rows share fingerprint and component; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwork.llm.common import content_mark, join_side, kept_rows, staged_small, text_bytes, texts_of
from meterwork.llm.components import components
from meterwork.session import stage

#: Fingerprints of a tile: 64 KB, compared with another tile in about a tenth of a second.
TILE = 8192
_SHINGLES_AT_ONCE = 1 << 15
_ROWS_AT_ONCE = 32


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a text in UTF-8."""
    found = text.lower().split()
    if not found:
        return 0
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(0, len(found) - words)
    starts, ends = starts[: last + 1], ends[min(words, len(found)) - 1 :]
    totals = np.zeros(64, np.int64)
    for at in range(0, last + 1, _SHINGLES_AT_ONCE):
        some = slice(at, at + _SHINGLES_AT_ONCE)
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[some].tolist(), ends[some].tolist())], ">u8")
        totals += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * totals > last + 1).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 4) -> DataFrame:
    """(id, mark, fp): the fingerprint as a signed long; ``mark`` tells rows of one id apart."""
    columns = docs.select(F.col(id_column), content_mark(text_column).alias("mark"), text_bytes(text_column).alias("_text"))
    id_type = columns.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_signed(fingerprint(t, words)) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=[id_column, "mark", "fp"])

    return columns.mapInArrow(run, f"`{id_column}` {id_type}, mark string, fp bigint")


def tile_links(left: np.ndarray, right: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) of a spanning forest over all pairs of two tiles that differ in ``radius`` bits at most."""
    nodes = left if same else np.concatenate((left, right))
    shift = 0 if same else len(left)
    label = np.arange(len(nodes))
    for at in range(0, len(left), _ROWS_AT_ONCE):
        near = np.bitwise_count(left[at : at + _ROWS_AT_ONCE, None] ^ right[None, :]) <= radius
        if same:
            near &= np.arange(len(right))[None, :] > np.arange(at, at + len(near))[:, None]
        for row in np.flatnonzero(near.any(1)).tolist():
            met = np.concatenate(([at + row], np.flatnonzero(near[row]) + shift))
            roots = np.unique(label[met])
            if len(roots) > 1:
                label[np.isin(label, roots)] = roots[0]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _compared(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for left, right, same in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
            a, b = (np.asarray(x.values).astype(np.int64).view(np.uint64) for x in (left, right))
            nodes, roots = tile_links(a, b, same, radius)
            if len(nodes):
                yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(roots.view(np.int64))], names=["a", "b"])


def linked(prints: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """(a, b): links that span the near groups of the distinct fingerprints ``prints(fp, ...)``; give it a staged table."""
    counted = prints.groupBy(F.bit_count("fp").alias("bits")).count().collect()  # 65 rows at most
    parts = {int(r["bits"]): -(-int(r["count"]) // tile) for r in counted}
    if not parts:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    held = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv])
    bits = F.bit_count("fp")
    tiles = (
        prints.select("fp", bits.alias("bits"), F.pmod(F.xxhash64("fp"), F.element_at(held, bits)).cast("int").alias("part"))
        .groupBy("bits", "part").agg(F.collect_list("fp").alias("fps"))
    )
    tiles = stage(tiles, "tiles")

    def parts_at(away: int) -> Column:
        """All parts of the tiles whose bit count is ``away`` more."""
        bits = (F.col("bits") + away).cast("int")
        n = F.coalesce(F.try_element_at(held, bits), F.lit(0))
        numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda p: F.struct(bits.alias("bits"), p.cast("int").alias("part")))

    partners = F.flatten(F.array(*[parts_at(k) for k in range(-radius, radius + 1)]))
    own = F.struct(F.col("bits").cast("int").alias("bits"), F.col("part").alias("part"))
    left = tiles.select(F.col("fps").alias("left"), own.alias("own"), F.explode(F.filter(partners, lambda p: p >= own)).alias("to"))
    right = tiles.select(F.col("fps").alias("right"), own.alias("at"))
    pairs = left.join(right, F.col("to") == F.col("at")).select("left", "right", (F.col("own") == F.col("at")).alias("same"))
    return pairs.mapInArrow(lambda batches: _compared(batches, radius), "a bigint, b bigint")


def near_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 4, radius: int = 4,
                tile: int = TILE) -> DataFrame:
    """One row per document: id, mark, fp, component_id (smallest id reachable over links of ``radius`` bits at most), kept.

    The row of the smallest id is kept; of repeated rows with that id, one.
    """
    raw = fingerprints(docs, id_column, text_column, words).withColumn("_row", F.monotonically_increasing_id())
    found = stage(raw, "simhash")  # the row numbers are fixed once written
    first = F.struct(F.col(id_column).isNull(), F.col(id_column), F.col("_row"))
    distinct = stage(found.groupBy("fp").agg(F.min(first).alias("least"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    roots = stage(components(linked(distinct, radius, tile)), "simhash-roots")
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "n", "root")
    lowest = named.filter("root IS NOT NULL").groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("lowest"))
    # A fingerprint of one document without links names itself; only the others are joined to the documents.
    grouped, small = staged_small(
        named.filter("root IS NOT NULL OR n > 1").join(lowest, F.col("root") == F.col("_root"), "left")
        .select(F.col("fp").alias("_fp"), F.coalesce("lowest", "least").alias("_least")), "simhash-groups")
    joined = found.join(join_side(grouped, small), F.col("fp") == F.col("_fp"), "left")
    alone = F.col("_least").isNull()
    return joined.select(
        id_column, "mark", "fp", F.when(alone, F.col(id_column)).otherwise(F.col(f"_least.{id_column}")).alias("component_id"),
        (alone | (F.col("_least._row") == F.col("_row"))).alias("kept"),
    )


def one_of_each_group(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The documents with one row of each near group, columns unchanged."""
    return kept_rows(docs, stage(near_groups(docs, id_column, text_column, **options), "simhash-kept"), id_column, text_column)
