"""Exact duplicates by composable polynomial fingerprints and chunkwise comparison.

Texts are equal when identical after lower-casing A-Z. A text's bytes are hashed in chunks of 4096: all chunks of a
batch of documents are one matrix, multiplied by the powers of two bases (exact in doubles), and the hashes of the
chunks combine as H(ab) = H(a) * base^|b| + H(b). ``fingerprint_parts`` does the same across rows for documents
that are stored in parts, hashed in parallel by any number of tasks.

Rows of equal fingerprint and length are then compared with the group's row of the largest id, 64 KB at a time. A
group of any size is salted into runs of about ``RUN_ROWS`` rows that each get a copy of that one row, so no task
holds a group. Rows that turn out different form new groups and are compared anew, until none is left.

Defined results: null and empty texts are equal; of equal texts the row with the largest id stays, a null id being
the smallest; of repeated rows with that id one stays; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterwork.llm.common import content_mark, join_side, kept_rows, slices, staged_small, text_bytes, texts_of
from meterwork.session import stage

CHUNK = 4096
COMPARED_AT_ONCE = 1 << 16
RUN_ROWS = 64
_BLOCK_BYTES = 1 << 20


@dataclass(frozen=True)
class Polynomial:
    """Two polynomials modulo primes below 2^31, packed into one long."""

    primes: tuple[int, int] = ((1 << 31) - 1, (1 << 31) - 19)
    bases: tuple[int, int] = (1_103_515_245, 69_069_421)

    def powers(self) -> np.ndarray:
        """base^(CHUNK - 1 - i) in doubles: 255 * 2^31 * CHUNK stays below 2^53."""
        out = np.empty((CHUNK, 2))
        for k, (base, prime) in enumerate(zip(self.bases, self.primes)):
            value = 1
            for i in range(CHUNK - 1, -1, -1):
                out[i, k] = value
                value = value * base % prime
        return out

    def pack(self, hashes) -> int:
        return int(hashes[0]) << 31 | int(hashes[1])

    def shifted(self, packed: int, length: int) -> tuple[int, int]:
        """The two hashes of the same bytes followed by ``length`` zero bytes."""
        parts = packed >> 31, packed & ((1 << 31) - 1)
        return tuple(h * pow(b, length, p) % p for h, b, p in zip(parts, self.bases, self.primes))

    def combined(self, left: int, right: int, right_length: int) -> int:
        """Fingerprint of a concatenation from those of its halves."""
        there = right >> 31, right & ((1 << 31) - 1)
        return self.pack([(a + b) % p for a, b, p in zip(self.shifted(left, right_length), there, self.primes)])


def chunked_hashes(texts: list[bytes], poly: Polynomial, powers: np.ndarray) -> list[int]:
    """Fingerprints of normalised texts; the first chunk of each is padded in front, which adds nothing to its sum."""
    steps = [pow(b, CHUNK, p) for b, p in zip(poly.bases, poly.primes)]
    counts = np.array([-(-len(t) // CHUNK) for t in texts], np.int64)
    out: list[int] = []
    for lo, hi in slices(counts * CHUNK, _BLOCK_BYTES):
        rows = np.concatenate(([0], np.cumsum(counts[lo:hi])))
        hashes = np.empty((int(rows[-1]), 2), np.int64)
        flat = np.zeros(len(hashes) * CHUNK, np.uint8)
        for text, end in zip(texts[lo:hi], rows[1:].tolist()):
            if text:
                flat[end * CHUNK - len(text) : end * CHUNK] = np.frombuffer(text, np.uint8)
        matrix = flat.reshape(-1, CHUNK)
        for at in range(0, len(matrix), 256):
            hashes[at : at + 256] = (matrix[at : at + 256].astype(np.float64) @ powers).astype(np.int64) % poly.primes
        listed = hashes.tolist()
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
            first = second = 0
            for x, y in listed[a:b]:
                first, second = (first * steps[0] + x) % poly.primes[0], (second * steps[1] + y) % poly.primes[1]
            out.append(poly.pack((first, second)))
    return out


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", poly: Polynomial = Polynomial(),
                 keep_text: bool = False) -> DataFrame:
    """(id, mark, fp, n_bytes, text_sha256[, text]): the normalised text's fingerprint, length and SHA-256."""
    columns = docs.select(F.col(id_column), content_mark(text_column).alias("mark"), text_bytes(text_column).alias("_text"))
    id_type = columns.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = poly.powers()
        for batch in batches:
            texts = [t.lower() for t in texts_of(batch)]
            arrays = [batch.column(0), batch.column(1), pa.array(chunked_hashes(texts, poly, powers), pa.int64()), pa.array(map(len, texts), pa.int64()),
                      pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
            names = [id_column, "mark", "fp", "n_bytes", "text_sha256"]
            if keep_text:
                arrays, names = [*arrays, pa.array(texts, pa.binary())], [*names, "text"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"`{id_column}` {id_type}, mark string, fp bigint, n_bytes bigint, text_sha256 string"
    return columns.mapInArrow(run, schema + (", text binary" if keep_text else ""))


def fingerprint_parts(parts: DataFrame, key: str, order: str, text_column: str = "text", poly: Polynomial = Polynomial()) -> DataFrame:
    """(key, fp, n_bytes) of documents stored as several rows: parts are hashed apart and combined by shifted sums."""
    hashed = fingerprints(parts.select(F.struct(key, order).alias("_at"), F.col(text_column).alias("text")), "_at", "text", poly)
    after = Window.partitionBy(f"_at.{key}").orderBy(F.col(f"_at.{order}").desc()).rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.select(F.col("_at")[key].alias(key), "fp", "n_bytes", F.coalesce(F.sum("n_bytes").over(after), F.lit(0)).alias("_after"))
    key_type = placed.schema[key].dataType.simpleString()

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved = [poly.shifted(h, n) for h, n in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *[pa.array([m[k] for m in moved], pa.int64()) for k in (0, 1)]], names=[key, "n_bytes", "a", "b"])

    sums = placed.mapInArrow(shift, f"`{key}` {key_type}, n_bytes bigint, a bigint, b bigint").groupBy(key).agg(
        F.sum("n_bytes").alias("n_bytes"), *[(F.sum(c) % p).alias(c) for c, p in zip("ab", poly.primes)])
    return sums.select(key, F.shiftleft("a", 31).bitwiseOR(F.col("b")).alias("fp"), "n_bytes")


def same_text(left: bytes, right: bytes) -> bool:
    if len(left) != len(right):
        return False
    a, b = memoryview(left), memoryview(right)
    return all(a[i : i + COMPARED_AT_ONCE] == b[i : i + COMPARED_AT_ONCE] for i in range(0, len(left), COMPARED_AT_ONCE))


def _different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that differ from the row that leads their run. A run may go on over many batches."""
    leader = None
    for batch in batches:
        wrong = []
        for i, (leads, text) in enumerate(zip(batch.column(0), batch.column(1))):
            if leads.as_py():
                leader = text.as_py()
            elif not same_text(leader, text.as_py()):
                wrong.append(i)
        if wrong:
            yield batch.select(batch.schema.names[2:]).take(pa.array(wrong))


def _leaders(ids: DataFrame, groups: DataFrame, small: bool) -> DataFrame:
    """(fp, n_bytes, n, text): the normalised text that leads each group, once, however many rows repeat it."""
    ours = join_side(groups.select("fp", "n_bytes", "n", F.col("lead.id").alias("_id"), F.col("lead.mark").alias("_mark")), small)
    marked = ids.select("id", content_mark("text").alias("mark"), text_bytes("text").alias("_text"))
    met = marked.join(ours, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))
    lower = F.translate(F.col("_text").cast("string"), string.ascii_uppercase, string.ascii_lowercase).cast("binary").alias("text")
    return met.dropDuplicates(["fp", "n_bytes"]).select("fp", "n_bytes", "n", lower)


def _mismatches(rows: DataFrame, leaders: DataFrame, groups: DataFrame, small: bool) -> DataFrame:
    """Of ``rows`` (with text), those that differ from the leader of their group (fp, n_bytes, lead, n)."""
    ours = join_side(groups.select(F.col("fp").alias("_fp"), F.col("n_bytes").alias("_nb"), F.col("lead").alias("_lead"), F.col("n").alias("_n")), small)
    met = rows.join(ours, (F.col("fp") == F.col("_fp")) & (F.col("n_bytes") == F.col("_nb")))
    runs = lambda n: F.ceil(F.col(n) / F.lit(RUN_ROWS)).cast("int")
    names = ["leads", "text", "id", "mark", "fp", "n_bytes", "salt"]
    # Rows of the leader's id and text are equal to it and need no comparison; of them one goes to every run.
    own = F.col("_lead.id").eqNullSafe(F.col("id")) & (F.col("_lead.mark") == F.col("mark"))
    salt = F.pmod(F.xxhash64("id", "mark", F.monotonically_increasing_id()), runs("_n")).cast("int")
    members = met.filter(~own).withColumn("leads", F.lit(False)).withColumn("salt", salt).select(*names)
    id_type = rows.schema["id"].dataType.simpleString()
    first = leaders.select(F.lit(True).alias("leads"), "text", F.lit(None).cast(id_type).alias("id"), F.lit("").alias("mark"), "fp", "n_bytes",
                           F.explode(F.sequence(F.lit(0), runs("n") - 1)).alias("salt"))
    dealt = members.unionByName(first.select(*names))
    runs_ = dealt.repartition("fp", "n_bytes", "salt").sortWithinPartitions("fp", "n_bytes", "salt", F.col("leads").desc())
    return runs_.select("leads", "text", "id", "mark", "fp", "n_bytes").mapInArrow(_different, f"id {id_type}, mark string, fp bigint, n_bytes bigint")


def duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", poly: Polynomial = Polynomial()) -> DataFrame:
    """One row per document: id, mark, keep_id, group_size, kept, text_sha256, fp, n_bytes."""
    ids = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    narrow = stage(fingerprints(ids, "id", "text", poly).withColumn("row", F.monotonically_increasing_id()), "exact")
    lead = F.max(F.struct("id", "mark")).alias("lead")
    label = narrow.withColumn("round", F.lit(0))
    groups, small = staged_small(narrow.groupBy("fp", "n_bytes").agg(lead, F.count(F.lit(1)).alias("n")).filter("n > 1"), "exact-groups")
    texts = fingerprints(ids, "id", "text", poly, keep_text=True).select("id", "mark", "fp", "n_bytes", "text")
    wrong = stage(_mismatches(texts, _leaders(ids, groups, small), groups, small), "exact-rest")
    turn = 0
    while not wrong.isEmpty():
        turn += 1
        others = wrong.distinct().select(F.col("id").alias("_i"), F.col("mark").alias("_m"), F.lit(turn).alias("_round"))
        mine = F.col("id").eqNullSafe(F.col("_i")) & (F.col("mark") == F.col("_m"))
        label = label.join(others, mine, "left").select(*narrow.columns, F.coalesce("_round", "round").alias("round"))
        groups, small = staged_small(wrong.groupBy("fp", "n_bytes").agg(lead, F.count(F.lit(1)).alias("n")).filter("n > 1"), "exact-groups")
        wrong = stage(_mismatches(texts.join(others, mine, "left_semi"), _leaders(ids, groups, small), groups, small), "exact-rest")
    classes, small = staged_small(
        label.groupBy("fp", "n_bytes", "round").agg(F.max(F.struct("id", "row")).alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select(F.col("fp").alias("_fp"), F.col("n_bytes").alias("_nb"), F.col("round").alias("_r"), "keep", "n"), "exact-classes")
    same = (F.col("fp") == F.col("_fp")) & (F.col("n_bytes") == F.col("_nb")) & (F.col("round") == F.col("_r"))
    lone = F.col("n").isNull()
    return label.join(join_side(classes, small), same, "left").select(
        F.col("id").alias(id_column), "mark", F.when(lone, F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"), (lone | (F.col("keep.row") == F.col("row"))).alias("kept"),
        "text_sha256", "fp", "n_bytes",
    )


def without_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents with one row of each group of equal texts, columns unchanged."""
    return kept_rows(docs, stage(duplicates(docs, id_column, text_column), "exact-kept"), id_column, text_column)
