"""What each order of a set of filters removes: sorted posting lists, united by galloping merges over id ranges.

A first pass writes one narrow row per document: a row number, its part, and the filters it fails. From these, every
(part, range of row numbers) keeps one sorted list of failing rows per filter, and the lists of its good and its toxic
rows. Of each set of filters the union of its lists is measured by a k-way merge that gallops: it takes the list with
the least head and leaps to the next list's head, so long runs cost a few probes. The sizes are summed by part, and
every figure of every order is a difference of such sums:
a filter removes, after the filters P, |P + f| - |P| documents.

Ranges are of row numbers, which are dense and differ for repeated ids, so no list grows with a part or a group of copies.

Defined results: null and empty texts have no words; a null source is the part of the empty string; repeated rows count
each time, but only a strictly smaller id's text makes a copy, so rows of one id are no copies of each other and a null
id neither makes nor is a copy; a document is good (toxic) if any row of ``labels`` with its id says so, a null id never;
very long texts are read in pieces that end between words; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwork.llm.common import text_bytes
from meterwork.session import stage

#: Rows of an id range: the lists of a block hold so many numbers at most.
RANGE = 1 << 16
#: Groups of copies that may be broadcast: those of 1 / LARGEST of all rows or more, of which there are LARGEST at most.
LARGEST = 10_000
_PIECE = 1 << 20
_SPACE = b" \t\n\r\x0b\x0c"
_UPPER = bytes(range(65, 91))
_CONTINUATION = bytes(range(0x80, 0xC0))
FILTERS = "ABCDE"


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    distinct_percent: int = 65
    upper_percent: int = 5
    marks: bytes = b"#$%&*|"


def _pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        end = min(len(text), at + _PIECE)
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        yield text[at:end]
        at = end


def failed(text: bytes, limits: Limits = Limits()) -> list[bool]:
    """Whether a text fails A, B, C, D."""
    words, distinct = 0, set()
    for piece in _pieces(text):
        found = piece.split()
        words += len(found)
        distinct.update(found)
    upper, points = len(text) - len(text.translate(None, _UPPER)), len(text.translate(None, _CONTINUATION))
    return [words < limits.min_words, 100 * len(distinct) < limits.distinct_percent * words, 100 * upper > limits.upper_percent * points,
            len(text.translate(None, limits.marks)) < len(text)]


def gallop(rows: list[int], at: int, to: int) -> int:
    """The first place from ``at`` on whose row is ``to`` or more: leaps that double, then a binary search."""
    leap = 1
    while at + leap < len(rows) and rows[at + leap] < to:
        leap *= 2
    return bisect_left(rows, to, at + leap // 2, min(len(rows), at + leap + 1))


def union_size(lists: list[list[int]]) -> int:
    """Distinct rows of sorted lists."""
    open_lists, total = [[x, 0] for x in lists if x], 0
    while len(open_lists) > 1:
        head = [x[at] for x, at in open_lists]
        least = min(head)
        leaders = [k for k, h in enumerate(head) if h == least]
        if len(leaders) > 1:  # one row of several lists
            total += 1
            for k in leaders:
                open_lists[k][1] += 1
        else:
            rows, at = open_lists[leaders[0]]
            end = gallop(rows, at, min(h for h in head if h != least))
            total += end - at
            open_lists[leaders[0]][1] = end
        open_lists = [x for x in open_lists if x[1] < len(x[0])]
    return total + sum(len(x) - at for x, at in open_lists)


def common(left: list[int], right: list[int]) -> list[int]:
    """Rows of both sorted lists; the shorter one leads the leaps through the longer."""
    if len(left) > len(right):
        left, right = right, left
    at, out = 0, []
    for row in left:
        at = gallop(right, at, row) if at < len(right) and right[at] < row else at
        if at == len(right):
            break
        if right[at] == row:
            out.append(row)
    return out


def union_sizes(lists: list[list[int]]) -> list[int]:
    """The size of the union of every set of lists, by the set's bits."""
    sizes = []
    for mask in range(1 << len(lists)):
        sizes.append(union_size([x for k, x in enumerate(lists) if mask >> k & 1]))
    return sizes


def flags(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source", limits: Limits = Limits()) -> DataFrame:
    """(id, part, A, B, C, D, digest) of every document."""
    columns = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"), text_bytes(text_column).alias("_text"))
    id_type = columns.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts, digests = [], []
            for value in batch.column(2):
                text = value.as_py() or b""
                verdicts.append(failed(text, limits))
                digests.append(hashlib.sha256(text).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array([v[k] for v in verdicts], pa.bool_()) for k in range(4)], pa.array(digests, pa.binary())],
                names=["id", "part", *FILTERS[:4], "digest"])

    return columns.mapInArrow(run, f"id {id_type}, part string, {', '.join(f'{x} boolean' for x in FILTERS[:4])}, digest binary")


def postings(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source",
             limits: Limits = Limits(), span: int = RANGE) -> DataFrame:
    """(part, block, n, A..E, good, toxic): sorted row numbers of a part's documents within one range of rows."""
    rows = stage(flags(docs, id_column, text_column, part_column, limits).withColumn("row", F.monotonically_increasing_id()), "audit")
    # Copies are told by SHA-256; only groups of several ids are joined back. Groups of
    # 1 / LARGEST of all rows or more are broadcast, so no key of the join by shuffling holds more than that.
    ids = [F.min("id").alias("_first"), F.max("id").alias("_last"), F.count(F.lit(1)).alias("_n")]
    groups = stage(rows.filter("id IS NOT NULL").groupBy(F.col("digest").alias("_d")).agg(*ids).filter("_first < _last").drop("_last"), "audit-copies")
    large = F.col("_n") * LARGEST >= rows.count()
    hot = groups.filter(large).select(F.col("_d").alias("_h"), F.col("_first").alias("_hot"))
    cold = groups.filter(~large).select("_d", "_first", F.lit(0).cast("bigint").alias("_c"))
    said = labels.groupBy(F.col(id_column).alias("_l")).agg(
        *[F.coalesce(F.max(F.col(c).cast("int") == 1), F.lit(False)).alias(out) for c, out in (("quality", "good"), ("toxic", "toxic"))]).filter("good OR toxic")
    # Rows without an id meet no label; the second key spreads them.
    spread = F.when(F.col("id").isNull(), F.col("row")).otherwise(F.lit(0))
    met = rows.join(F.broadcast(hot), F.col("digest") == F.col("_h"), "left")
    own = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.col("row"))  # rows of hot groups meet nothing here, anywhere
    met = met.join(cold, (F.col("digest") == F.col("_d")) & (own == F.col("_c")), "left")
    met = met.withColumn("E", F.coalesce(F.col("id") > F.coalesce("_hot", "_first"), F.lit(False))).drop("digest", "_d", "_c", "_first", "_h", "_hot")
    met = met.join(said.withColumn("_s", F.lit(0).cast("bigint")), (F.col("id") == F.col("_l")) & (spread == F.col("_s")), "left")
    listed = [F.sort_array(F.collect_list(F.when(F.col(c), F.col("row")))).alias(c) for c in (*FILTERS, "good", "toxic")]
    return met.groupBy("part", F.floor(F.col("row") / F.lit(span)).alias("block")).agg(F.count(F.lit(1)).alias("n"), *listed)


_KINDS = ("all", "good", "toxic")


def measured(lists: DataFrame) -> DataFrame:
    """(part, n, all, good, toxic): sizes of the unions of every set of filters, of all, good and toxic documents."""
    masks = 1 << len(FILTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = {name: batch.column(k) for k, name in enumerate(("part", "block", "n", *FILTERS, "good", "toxic"))}
            out: dict[str, list] = {k: [] for k in _KINDS}
            for i in range(batch.num_rows):
                failing = [held[f][i].as_py() for f in FILTERS]
                out["all"].append(union_sizes(failing))
                for kind in _KINDS[1:]:
                    marked = held[kind][i].as_py()
                    out[kind].append(union_sizes([common(x, marked) for x in failing]))
            yield pa.RecordBatch.from_arrays([held["part"], held["n"], *[pa.array(out[k], pa.list_(pa.int64())) for k in _KINDS]], names=["part", "n", *_KINDS])

    sizes = lists.mapInArrow(run, "part string, n bigint, " + ", ".join(f"`{k}` array<bigint>" for k in _KINDS))
    sums = [F.array(*[F.sum(F.col(k)[m]) for m in range(masks)]).alias(k) for k in _KINDS]
    return sizes.groupBy("part").agg(F.sum("n").alias("n"), *sums)


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, filters before, filter) as bit sets."""
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    return [("".join(o), k + 1, sum(bit[f] for f in o[:k]), bit[o[k]]) for o in permutations(FILTERS) for k in range(len(o))]


def audited(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per part, order of the filters and step; see the module's text."""
    sizes = stage(measured(stage(postings(docs, labels, **options), "postings")), "audit-sizes")
    everything = (1 << len(FILTERS)) - 1
    at = lambda kind, mask: F.col(kind)[mask]
    others = len(FILTERS) - 1
    # Of all orders, a filter comes after exactly the set P in |P|! (others - |P|)! of them.
    shares = []
    for k in range(len(FILTERS)):
        before = [p for p in range(everything + 1) if not p >> k & 1]
        weights = [(p, factorial(p.bit_count()) * factorial(others - p.bit_count())) for p in before]
        shares.append(sum((F.lit(w) * (at("all", p | 1 << k) - at("all", p)) for p, w in weights), F.lit(0)).cast("bigint"))
    totals = sizes.select("part", "n", *_KINDS, F.array(*shares).alias("shares"))
    plan = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(p).alias("before"), F.lit(f).alias("own")) for o, s, p, f in steps()])
    told = totals.withColumn("s", F.explode(plan)).select("part", "n", *_KINDS, "shares", "s.*")
    after = F.col("before").bitwiseOR(F.col("own"))
    lost = lambda kind: at(kind, after) - at(kind, F.col("before"))
    return told.select(
        "part", "filter_order", "step", (F.col("n") - at("all", after)).alias("kept"), lost("all").alias("removed"), (at("all", F.col("own")) - lost("all")).alias("redundant"),
        (at("all", F.lit(everything)) - at("all", F.lit(everything).bitwiseXOR(F.col("own")))).alias("unique_fails"), lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"), F.col("shares")[F.log2(F.col("own")).cast("int")].alias("shapley"))
