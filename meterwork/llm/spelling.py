"""Spelling variants: words one edit apart, found by search schemes over a bidirectional FM-index of the vocabulary.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. Cut a word into halves: of one
error, at most one half is touched. So a near word either begins with the word's first half, or ends with its second
half. Each search matches that half exactly and extends across the other one allowing one error. The index holds the
words between delimiters and keeps the suffix-rank intervals of the text and of the reversed text in step, so a match
grows to either side and both searches are located in one suffix array. All queries of a block move together in numpy.

The vocabulary is dealt twice, once by its words' first code points and once by their last, so a query meets only words
that can match its exact half. A first (or last) run of code points that many words share is cut into blocks of
``BLOCK`` words that its queries visit one after another; queries stream past an index and are never held.

A word's form is its near word of largest count (ties: the first in code-point order), if that count is ``ratio`` times
its own or more. Counts grow along forms, so chains are short; roots are found by pointer doubling.

Defined results: null texts hold no words and a null id is written as an empty text in the checksum; very long texts are
read in pieces that end between runs; repeated rows count each time; an empty table gives an empty one; other columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwork.llm.common import text_bytes
from meterwork.session import stage

#: Words of an index: about 160,000 symbols, two tables of some 30 MB.
BLOCK = 16_384
_QUERIES_AT_ONCE = 2_048
_PIECE = 1 << 20
_COUNTED_AT_ONCE = 200_000
_RUN = re.compile("[a-zÀ-ÿ]+")
#: Bytes that a piece may not begin with: letters, the first byte of À-ÿ, and continuation bytes.
_GOES_ON = [0x80 <= b < 0xC0 or b == 0xC3 or chr(b | 32) in "abcdefghijklmnopqrstuvwxyz" for b in range(256)]


def pieces(text: bytes, size: int = _PIECE) -> Iterator[str]:
    """A text, lower-cased A-Z only, in pieces that never cut a run of letters."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        while end < len(text) and _GOES_ON[text[end]]:
            end += 1
        yield text[at:end].lower().decode(errors="replace")
        at = end


def noisy(run: str, doc_prefix: int, every: int) -> str:
    """The run, or for one in ``every`` (by checksum) the run without one of its code points."""
    h = zlib.crc32(run.encode(), doc_prefix)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_length: int = 6, min_count: int = 5, every: int = 199) -> DataFrame:
    """(word, n): all words of ``min_length`` code points and ``min_count`` occurrences, after the planted deletions."""
    columns = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("_id"), text_bytes(text_column).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                prefix = zlib.crc32(f"{doc_id}:".encode())
                for piece in pieces(text.as_py()):
                    for found, n in Counter(_RUN.findall(piece)).items():
                        if len(found) >= min_length and len(word := noisy(found, prefix, every)) >= min_length:
                            held[word] += n
                    if len(held) > _COUNTED_AT_ONCE:
                        yield out()
        yield out()

    counted = columns.mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def rotations(symbols: np.ndarray) -> np.ndarray:
    """Starts of all rotations of a text in sorted order, by prefix doubling."""
    n, rank, step = len(symbols), symbols.astype(np.int64), 1
    while True:
        pair = rank * (int(rank.max()) + 1) + np.roll(rank, -step)
        order = np.argsort(pair, kind="stable")
        ordered = pair[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        step *= 2
        if rank[order[-1]] == n - 1 or step >= 2 * n:
            return order


class OneWay:
    """Ranks of one reading direction: how many symbols below c stand in the first i symbols of the transform."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.order = rotations(symbols)
        last = symbols[self.order - 1]
        self.less = np.zeros((len(symbols) + 1, sigma + 1), np.int32)
        self.less[np.arange(1, len(symbols) + 1), last + 1] = 1
        np.cumsum(self.less, axis=0, out=self.less)
        np.cumsum(self.less, axis=1, out=self.less)
        self.first = self.less[-1].copy()  # symbols below c in the whole text: where the rotations that begin with c start

    def grow(self, low: np.ndarray, size: np.ndarray, other: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals after one more symbol on this side; ``other`` are the lower ends in the other direction."""
        high = low + size
        below_low, below_high = self.less[low, c], self.less[high, c]
        at_low = self.less[low, c + 1] - below_low
        return self.first[c] + at_low, self.less[high, c + 1] - below_high - at_low, other + below_high - below_low

    def choices(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, symbol) of every symbol but the delimiter that occurs next."""
        below = self.less[low + size] - self.less[low]
        row, c = np.nonzero(below[:, 2:] > below[:, 1:-1])
        return row, c + 1


class BidirectionalIndex:
    """FM-index over delimited words, both directions kept in step."""

    def __init__(self, words: list[str]):
        """A symbol's code is its place in the words' alphabet plus one; the delimiter is 0, symbols of no word the last."""
        self.alphabet = np.unique(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32))
        codes, lengths = self.coded(words)
        starts = np.concatenate(([0], np.cumsum(lengths + 1)))
        text = np.zeros(int(starts[-1]) + 1, np.int64)
        text[np.arange(len(codes)) + np.repeat(np.arange(1, len(words) + 1), lengths)] = codes
        sigma = len(self.alphabet) + 2
        self.left, self.right = OneWay(text, sigma), OneWay(text[::-1].copy(), sigma)
        self.word_at = np.full(len(text), -1, np.int64)
        self.word_at[starts[:-1]] = np.arange(len(words))

    def coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.searchsorted(self.alphabet, points)
        known = np.append(self.alphabet, np.uint32(0xFFFFFFFF))[at] == points
        return np.where(known, at, len(self.alphabet)) + 1, np.fromiter(map(len, words), np.int64, len(words))

    def search(self, queries: list[str], forward: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) pairs one edit apart that share the first half (``forward``) or the second half of the query."""
        codes, lengths = self.coded(queries)
        most = int(lengths.max(initial=0))
        grid = np.zeros((len(queries), most + 1), np.int64)
        inside = np.arange(most + 1)[None, :] < lengths[:, None]
        grid[inside] = codes
        exact = lengths // 2
        if not forward:
            exact = lengths - exact
            turned = np.zeros_like(grid)
            turned[inside] = grid[np.nonzero(inside)[0], (lengths[:, None] - 1 - np.arange(most + 1)[None, :])[inside]]
            grid = turned
        side = self.right if forward else self.left
        q = np.arange(len(queries))
        start = int(side.first[1])  # all rotations that begin with the delimiter
        clean = (q, np.zeros(len(q), np.int64), np.full(len(q), start), np.zeros(len(q), np.int64))
        wrong: list = [[np.empty(0, np.int64)] * 4]
        found = []

        def grown(state, c):
            low, size, other = side.grow(state[1], state[2], state[3], c)
            some = size > 0
            return tuple(x[some].astype(np.int64) for x in (state[0], low, size, other))

        def taken(state, which):
            return tuple(x[which] for x in state)

        for t in range(most + 1):
            branching = taken(clean, t >= exact[clean[0]])
            row, c = side.choices(branching[1], branching[2])
            options, next_wrong = taken(branching, row), []
            wrong.append(grown(options, c))  # inserted
            here = tuple(np.concatenate(x) for x in zip(*wrong))
            ended = taken(here, lengths[here[0]] == t)
            found.append(grown(ended, np.zeros(len(ended[0]), np.int64)))
            here = taken(here, lengths[here[0]] > t)
            next_wrong.append(grown(here, grid[here[0], t]))
            more = lengths[options[0]] > t
            other = more & (grid[options[0], t] != c)
            next_wrong.append(grown(taken(options, other), c[other]))  # replaced
            next_wrong.append(taken(branching, lengths[branching[0]] > t))  # deleted
            clean = taken(clean, lengths[clean[0]] > t)
            clean = grown(clean, grid[clean[0], t])
            wrong = next_wrong
        query, low, size, other = (np.concatenate(x) for x in zip(*found))
        rank = low if not forward else other  # the interval in the text itself
        word = self.word_at[self.left.order[rank]]
        pairs = np.unique(query * (len(self.word_at) + 1) + word)
        return pairs // (len(self.word_at) + 1), pairs % (len(self.word_at) + 1)


def _searched(batches: Iterator[pa.RecordBatch], summed: bool) -> Iterator[pa.RecordBatch]:
    """Rows come by block, its words first, then the queries; a block may go on over many batches."""
    block, words, counts, index = None, [], [], None
    for batch in batches:
        sides, deals = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
        asked = batch.column(2).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((sides[1:] != sides[:-1]) | (deals[1:] != deals[:-1]) | (asked[1:] != asked[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if hi == lo:
                continue
            key, some, n = (bool(sides[lo]), int(deals[lo])), batch.column(3).slice(lo, hi - lo).to_pylist(), batch.column(4).slice(lo, hi - lo).to_pylist()
            if key != block:
                block, words, counts, index = key, [], [], None
            if not asked[lo]:
                words += some
                counts += n
                continue
            if index is None and words:
                index = BidirectionalIndex(words)
                order = np.empty(len(words), np.int64)
                order[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
                number = np.array(counts, np.int64)
            if index is None:
                continue
            for at in range(0, len(some), _QUERIES_AT_ONCE):
                queries = some[at : at + _QUERIES_AT_ONCE]
                q, w = index.search(queries, key[0])
                if not key[0]:  # words that begin with the first half are the other search's
                    new = np.array([not words[j].startswith(queries[i][: len(queries[i]) // 2]) for i, j in zip(q.tolist(), w.tolist())], bool)
                    q, w = q[new], w[new]
                if not len(q):
                    continue
                if summed:
                    ranked = np.lexsort((order[w], -number[w], q))
                    q, w = q[ranked], w[ranked]
                    heads = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
                    near, q, w = np.diff(np.append(heads, len(q))), q[heads], w[heads]
                else:
                    near = np.ones(len(q), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([queries[i] for i in q.tolist()], pa.string()), pa.array([words[j] for j in w.tolist()], pa.string()), pa.array(number[w]), pa.array(near)],
                    names=["word", "near", "near_n", "n_near"])


def _blocks(vocab: DataFrame, key_length: int, block: int) -> DataFrame:
    """(forward, deal, asked, word, n): every word as a text of one block, and as a query of every block that may hold near words."""
    sides = F.array(
        F.struct(F.lit(True).alias("forward"), F.substring("word", 1, key_length).alias("key")),
        F.struct(F.lit(False).alias("forward"), F.substring("word", -key_length, key_length).alias("key")))
    dealt = vocab.select("word", "n", F.explode(sides).alias("s")).select("word", "n", "s.forward", "s.key")
    keys = dealt.groupBy("forward", "key").agg(F.count(F.lit(1)).alias("held"))
    groups = max(1, -(-2 * vocab.count() // block))
    met = dealt.join(keys.withColumnRenamed("forward", "_f").withColumnRenamed("key", "_k"), (F.col("forward") == F.col("_f")) & (F.col("key") == F.col("_k")))
    parts = F.ceil(F.col("held") / F.lit(block)).cast("int")
    own = F.when(parts > 1, F.xxhash64("key", F.pmod(F.xxhash64("word"), parts).cast("int"))).otherwise(F.pmod(F.xxhash64("key"), F.lit(groups)))
    every = F.when(parts > 1, F.transform(F.sequence(F.lit(0), parts - 1), lambda p: F.xxhash64("key", p))).otherwise(F.array(F.pmod(F.xxhash64("key"), F.lit(groups))))
    rows = F.concat(F.array(F.struct(own.alias("deal"), F.lit(False).alias("asked"))), F.transform(every, lambda d: F.struct(d.alias("deal"), F.lit(True).alias("asked"))))
    return met.select("forward", "word", "n", F.explode(rows).alias("r")).select("forward", "r.deal", "r.asked", "word", "n")


def _search(vocab: DataFrame, summed: bool, min_length: int, block: int) -> DataFrame:
    rows = _blocks(vocab, min_length // 2, block).repartition("forward", "deal").sortWithinPartitions("forward", "deal", "asked")
    return rows.mapInArrow(lambda batches: _searched(batches, summed), "word string, near string, near_n bigint, n_near bigint")


def near_pairs(vocab: DataFrame, min_length: int = 6, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n) of all pairs one edit apart, in both orders; ``vocab(word, n)`` holds distinct words of ``min_length`` or more."""
    return _search(vocab, False, min_length, block).drop("n_near")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all words with a form, by doubling the pointers until none moves."""
    pointers = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = pointers.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        moved = pointers.join(ahead, F.col("root") == F.col("_at"), "left")
        pointers = stage(moved.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if pointers.filter("moved").isEmpty():
            return pointers.select("word", "root")


def variants(vocab: DataFrame, ratio: int = 5, min_length: int = 6, block: int = BLOCK) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a staged table ``vocab(word, n)``."""
    met = _search(vocab, True, min_length, block)
    near = met.groupBy(F.col("word").alias("_w")).agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = vocab.join(near, F.col("word") == F.col("_w"), "left")
    strong = -F.col("best.less") >= ratio * F.col("n")
    found = stage(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")), "variants")
    roots = _roots(found.filter("form IS NOT NULL")).withColumnRenamed("word", "_w")
    return found.join(roots, F.col("word") == F.col("_w"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """Variants of the words of whole texts."""
    return variants(stage(vocabulary(docs, id_column, text_column, **options), "vocabulary"))
