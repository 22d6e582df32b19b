"""Toxicity by a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word's input is the sum of a word vector (words of the vocabulary; others share one) and the scaled sum of hashed
vectors of its character trigrams and beginnings; the network reads windows of words, and attention weighs the states of a window into one
logit. Every text is read whole in overlapping windows; a document's score is that of its most toxic window. Units without white space
that are longer than ``UNIT`` bytes (unspaced scripts, glued words, long runs) enter as overlapping pieces, in training and scoring alike.

Training runs in numpy on the driver on a bounded sample (``Fit``): at most ``per_label`` documents of each label, drawn
by a hash of their id, ``piece`` characters from a drawn place each when they are longer. The first vector entries of
words and character inputs start as their log odds between the labels, smoothed and shrunk for rare words. As only some windows of a toxic document are
toxic, each toxic document teaches by the window that scores highest at that time (multiple-instance learning). At the end the
bias is set so that 0.5 is the score at which the fewest training documents err.

Defined results: null and empty texts score 0; rows with null ids or labels teach nothing; without rows of both
labels every text scores 0; repeated rows are scored alike; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwork.llm.common import slices, text_bytes, texts_of
from meterwork.llm.recurrent import Adam, Gru, by_length, padded, row_sums, windows

_BYTES_AT_ONCE = 1 << 21
_WINDOWS_AT_ONCE = 2048
#: New words whose character inputs, hundreds of bytes a word, a scorer holds at a time.
_WORDS_AT_ONCE = 8192
#: A clean document called toxic counts as so many missed toxic ones when the cut is set.
CLEAN_COST = 2.0
#: Bytes of the longest input. A longer unit is cut into pieces of ``_PIECE`` bytes, about as dense as words are, so that what is in
#: the midst of it weighs as much as in a word; they overlap by the longest character input.
UNIT, _PIECE, _LAP = 64, 16, 8
_TRIM = b".,;:!?\"'()[]{}<>*#$%&|/\\-_=+~`^@"


@dataclass(frozen=True)
class Fit:
    per_label: int = 2000
    piece: int = 2000
    vocabulary: int = 2048
    shrink: float = 10.0  # documents of a word that count half
    trusted: float = 0.9  # share of toxic documents, those that score highest, that teach; the rest may be mislabelled
    unknown: float = 0.1  # words of a training window read as unknown
    least_documents: int = 3
    char_rows: int = 8192
    width: int = 12
    hidden: int = 8
    window: int = 96
    overlap: int = 24
    batch: int = 96
    steps: int = 200
    rate: float = 0.01
    seed: int = 6


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words without punctuation around them; the pieces, in order, of those longer than ``UNIT``."""
    words = [w.strip(_TRIM) for w in text.lower().split()]
    if not words or max(map(len, words)) <= UNIT:
        return words
    cut = lambda w: [w[i : i + _PIECE] for i in range(0, len(w) - _LAP, _PIECE - _LAP)]
    return [x for w in words for x in (cut(w) if len(w) > UNIT else (w,))]


def grams(word: bytes, rows: int) -> tuple[int, ...]:
    """Hashed character inputs of a word: its trigrams, and its beginnings of four to seven bytes."""
    held = b"<" + word + b">"
    cut = [held[i : i + 3] for i in range(max(1, len(held) - 2))]
    return tuple([crc32(x) % rows for x in cut + [held[:n] for n in range(5, min(9, len(held)))]])


@dataclass
class Network:
    vocabulary: dict[bytes, int]
    weights: dict[str, np.ndarray]
    fit: Fit

    def word_inputs(self, words: list[bytes], drop: np.random.Generator | None = None, parts: dict[bytes, tuple[int, ...]] | None = None) -> tuple[np.ndarray, Callable]:
        """Vectors of distinct words, and a function from their gradient to those of the word and character rows.

        ``parts`` holds the character inputs of all words, where they are known.
        """
        w = self.weights
        known = np.fromiter((self.vocabulary.get(x, 0) for x in words), np.int64, len(words))
        if drop is not None:
            known = np.where(drop.random(len(known)) < self.fit.unknown, 0, known)
        found = [parts[x] for x in words] if parts else [grams(x, self.fit.char_rows) for x in words]
        count = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((g for gs in found for g in gs), np.int64, int(count.sum()))
        starts, scale = np.cumsum(count) - count, 1 / np.sqrt(count[:, None]).astype(np.float32)
        vectors = w["word"][known] + np.add.reduceat(w["char"][flat], starts, axis=0) * scale

        def back(d: np.ndarray) -> dict[str, np.ndarray]:
            spread = np.repeat(d * scale, count, axis=0)
            return {"word": row_sums(known, d, len(w["word"])), "char": row_sums(flat, spread, len(w["char"]))}

        return vectors, back

    def tables(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Gate inputs of every distinct word for both directions, padding last."""
        hold = Gru.hold_row(self.fit.hidden)[None]
        return [np.concatenate((vectors @ self.weights[f"in_{s}"] + self.weights[f"b_{s}"], hold)) for s in "fb"]

    def windows(self, ids: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Logit of every window of ``ids`` (time, batch)."""
        hid, w, pad = self.fit.hidden, self.weights, len(tables[0]) - 1
        # A state enters by its attention and its value, so two numbers per step are kept instead of the state.
        seen = np.zeros((*ids.shape, 2), np.float32)
        add = np.empty(seen.shape[1:], np.float32)
        both = np.stack((w["attention"], w["value"]), 1)
        for t, h in enumerate(Gru.states(tables[0], w["u_f"], ids)):
            np.matmul(h, both[:hid], out=seen[t])
        for t, h in enumerate(Gru.states(tables[1], w["u_b"], ids[::-1])):
            np.matmul(h, both[hid:], out=add)
            seen[len(ids) - 1 - t] += add
        pull, value = np.ascontiguousarray(seen[..., 0]), np.ascontiguousarray(seen[..., 1])
        pull[ids == pad] = -1e9
        share = np.exp(pull - pull.max(0))
        return (share * value).sum(0) / share.sum(0) + w["bias"][0]

class Scorer:
    """Scores documents; gate inputs of words met before are remembered by the process, up to ``remembered`` words."""

    def __init__(self, network: Network, remembered: int = 200_000):
        self.net, self.remembered = network, remembered
        self._forget()

    def _forget(self) -> None:
        self._number: dict[bytes, int] = {}
        empty = np.empty((0, 3 * self.net.fit.hidden), np.float32)
        self._tables = [empty, empty]

    def _numbers(self, split: list[list[bytes]]) -> np.ndarray:
        if len(self._number) > self.remembered:
            self._forget()
        number, known = self._number, len(self._number)
        flat = np.fromiter((number.setdefault(w, len(number)) for ws in split for w in ws), np.int32, sum(map(len, split)))
        if len(number) > known:
            fresh = list(islice(number, known, None))
            vectors = [self.net.word_inputs(fresh[i : i + _WORDS_AT_ONCE])[0] for i in range(0, len(fresh), _WORDS_AT_ONCE)]
            self._tables = [np.concatenate((old, new[:-1])) for old, new in zip(self._tables, self.net.tables(np.concatenate(vectors)))]
        return flat

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Probability of the most toxic window of every text; 0 for texts without a word."""
        split = [words_of(t) for t in texts]
        flat, out = self._numbers(split), np.zeros(len(texts))
        if not len(flat):
            return out
        hold = Gru.hold_row(self.net.fit.hidden)[None]
        tables = [np.concatenate((t, hold)) for t in self._tables]
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        begins = np.cumsum(lengths) - lengths
        doc, start, long = windows(lengths, self.net.fit.window, self.net.fit.overlap)
        logits = np.empty(len(doc), np.float32)
        for own in by_length(long, _WINDOWS_AT_ONCE):
            logits[own] = self.net.windows(padded(flat, begins[doc[own]] + start[own], long[own], len(tables[0]) - 1), tables)
        np.maximum.at(out, doc, 1 / (1 + np.exp(-logits.astype(np.float64))))
        return out


def _learn_windows(net: Network, flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, y: np.ndarray, words: list[bytes], parts: dict[bytes, tuple[int, ...]],
                   adam: Adam, rng: np.random.Generator) -> None:
    """One step on a batch of windows: cross-entropy through attention, both directions, word and character inputs."""
    hid, w = net.fit.hidden, net.weights
    ids = padded(flat, begins, sizes, -1)
    used, ids = np.unique(ids, return_inverse=True)
    ids = ids.reshape(-1, len(begins))
    pads = used[0] == -1
    ids = np.where(ids == 0, len(used) - 1, ids - 1) if pads else ids
    pad = len(used) - 1 if pads else len(used)
    vectors, back_words = net.word_inputs([words[i] for i in used[int(pads) :]], rng, parts)
    tables = net.tables(vectors)
    ahead, back_f = Gru.train(tables[0][ids], w["u_f"])
    behind, back_b = Gru.train(tables[1][ids[::-1]], w["u_b"])
    states = np.concatenate((ahead, behind[::-1]), 2)
    pull = states @ w["attention"]
    pull[ids == pad] = -1e9
    share = np.exp(pull - pull.max(0))
    share /= share.sum(0)
    value = states @ w["value"]
    logit = (share * value).sum(0) + w["bias"][0]
    d = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(np.float32)
    d_value = share * d
    d_pull = d_value * (value - (share * value).sum(0))
    d_states = d_value[..., None] * w["value"] + d_pull[..., None] * w["attention"]
    grads = {"value": np.einsum("tbh,tb->h", states, d_value), "attention": np.einsum("tbh,tb->h", states, d_pull), "bias": d.sum(keepdims=True)}
    d_vectors = np.zeros_like(vectors)
    for side, run, own, at in (("f", back_f, d_states[..., :hid], ids), ("b", back_b, d_states[::-1, :, hid:], ids[::-1])):
        da, grads[f"u_{side}"] = run(np.ascontiguousarray(own))
        rows = row_sums(at.ravel(), da.reshape(-1, da.shape[2]), pad + 1)[:pad]
        grads[f"in_{side}"], grads[f"b_{side}"] = vectors.T @ rows, rows.sum(0)
        d_vectors += rows @ w[f"in_{side}"].T
    adam.step(grads | back_words(d_vectors))


def train(texts: list[bytes], labels: list[int], fit: Fit = Fit(), toxic_share: float | None = None) -> Network:
    rng = np.random.default_rng(fit.seed)
    split, y = [words_of(t) for t in texts], np.array(labels, bool)
    toxic_share = y.mean() if toxic_share is None else toxic_share
    total = np.array([max(1, (~y).sum()), max(1, y.sum())], float)

    def leaning(units: list[set]) -> dict:
        """Smoothed log odds of units (words or character inputs) by the documents that have them, shrunk for rare ones."""
        clean, bad = (Counter(u for us, k in zip(units, y) if k == label for u in us) for label in (False, True))
        odds = lambda u: np.log((bad[u] + 2) / (total[1] + 4)) - np.log((clean[u] + 2) / (total[0] + 4))
        return {u: float(odds(u)) * (n := clean[u] + bad[u]) / (n + fit.shrink) for u in sorted(clean.keys() | bad.keys()) if clean[u] + bad[u] >= fit.least_documents}

    lean = leaning([set(ws) for ws in split])
    chosen = sorted(lean, key=lambda u: (-abs(lean[u]), u))[: fit.vocabulary]
    vocabulary = {u: i + 1 for i, u in enumerate(chosen)}
    make = lambda *shape, by=0.3: rng.normal(0, by, shape).astype(np.float32)
    w = {"word": make(len(vocabulary) + 1, fit.width, by=0.1), "char": make(fit.char_rows, fit.width, by=0.1),
         "attention": make(2 * fit.hidden), "value": make(2 * fit.hidden), "bias": np.full(1, -2, np.float32)}
    for u, i in vocabulary.items():
        w["word"][i, :2] = 0.5 * max(0.0, lean[u]), 0.5 * min(0.0, lean[u])
    parts = {u: grams(u, fit.char_rows) for ws in split for u in set(ws)}
    for i, x in leaning([{g for u in set(ws) for g in parts[u]} for ws in split]).items():
        w["char"][i, 2:4] = 0.5 * max(0.0, x), 0.5 * min(0.0, x)
    for s in "fb":
        w |= {f"in_{s}": make(fit.width, 3 * fit.hidden), f"b_{s}": np.zeros(3 * fit.hidden, np.float32), f"u_{s}": make(fit.hidden, 3 * fit.hidden)}
    net = Network(vocabulary, w, fit)
    number: dict[bytes, int] = {}
    flat = np.fromiter((number.setdefault(x, len(number)) for ws in split for x in ws), np.int64, sum(map(len, split)))
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    doc, start, long = windows(lengths, fit.window, fit.overlap)
    if not len(doc) or y.all() or not y.any():
        w["bias"][:], w["value"][:] = -1e3, 0
        return net
    begins, words = (np.cumsum(lengths) - lengths)[doc] + start, list(number)
    # Before the first pass the words' log odds say which window of a toxic document teaches.
    lean_of = np.array([max(lean.get(u, 0.0), max(float(w["char"][g, 2]) for g in parts[u])) for u in words])
    upto = np.concatenate(([0.0], np.cumsum(np.maximum(lean_of, 0)[flat])))
    score = upto[begins + long] - upto[begins]
    clean, adam, bad = np.flatnonzero(~y[doc]), Adam(w, fit.rate), None

    def all_scores() -> np.ndarray:
        return np.concatenate([_scores(net, flat, begins[i : i + 4096], long[i : i + 4096], words, parts) for i in range(0, len(doc), 4096)])

    for step in range(fit.steps):
        if step % 100 == 0:
            if step:
                score = all_scores()
            order = np.lexsort((-score, doc))
            first = order[np.r_[True, doc[order][1:] != doc[order][:-1]]]
            bad = first[y[doc[first]]]
            bad = bad[np.argsort(-score[bad], kind="stable")[: max(1, round(fit.trusted * len(bad)))]]
            worst = clean[np.argsort(-score[clean], kind="stable")[: max(1, len(clean) // 10)]]
        adam.rate = fit.rate * (1 - step / fit.steps) + 1e-4
        pick = np.concatenate((rng.choice(bad, fit.batch // 3), rng.choice(clean, fit.batch // 3), rng.choice(worst, fit.batch - 2 * (fit.batch // 3))))
        _learn_windows(net, flat, begins[pick], long[pick], y[doc[pick]].astype(float), words, parts, adam, rng)
    most = np.full(len(y), -np.inf)
    np.maximum.at(most, doc, all_scores())
    w["bias"] -= np.float32(_best_cut(most, y, toxic_share))
    return net


def _best_cut(logits: np.ndarray, y: np.ndarray, toxic_share: float) -> float:
    """The logit at which the fewest documents err (a clean one counts ``CLEAN_COST``), labels being weighted as frequent as they are in the corpus."""
    order = np.argsort(logits, kind="stable")
    bad = y[order] * (toxic_share / y.sum())
    clean = ~y[order] * (CLEAN_COST * (1 - toxic_share) / (~y).sum())
    errors = np.concatenate(([0.0], np.cumsum(bad))) + clean.sum() - np.concatenate(([0.0], np.cumsum(clean)))
    at = int(errors.argmin())
    ordered = logits[order]
    low, high = ordered[max(at - 1, 0)], ordered[min(at, len(ordered) - 1)]
    return float((low + high) / 2) if np.isfinite(low) else float(high)


def _scores(net: Network, flat: np.ndarray, begins: np.ndarray, long: np.ndarray, words: list[bytes], parts: dict[bytes, tuple[int, ...]]) -> np.ndarray:
    ids = padded(flat, begins, long, -1)
    used, where = np.unique(ids, return_inverse=True)
    pads = int(used[0] == -1)
    tables = net.tables(net.word_inputs([words[i] for i in used[pads:]], parts=parts)[0])
    where = where.reshape(ids.shape) - pads
    return net.windows(np.where(where < 0, len(tables[0]) - 1, where), tables)


def learn(docs: DataFrame, labels: DataFrame, label: str, teaches: Column, fit: Fit = Fit(), id_column: str = "doc_id", text_column: str = "text") -> Network:
    """Train on documents of ``labels`` whose id meets ``teaches`` (a condition on the id column)."""
    known = labels.filter(F.col(id_column).isNotNull() & F.col(label).isNotNull() & teaches).select(id_column, (F.col(label) > 0).cast("int").alias("_y"))
    drawn = F.xxhash64(id_column)
    sample = known.filter("_y = 1").orderBy(drawn, id_column).limit(fit.per_label).union(known.filter("_y = 0").orderBy(drawn, id_column).limit(fit.per_label))
    ours = docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_t"))
    rows = ours.join(F.broadcast(sample), F.col("_id") == F.col(id_column))  # 2 * per_label narrow rows at most
    place = (F.pmod(drawn, F.greatest(F.length("_t") - fit.piece, F.lit(1)).cast("bigint")) + 1).cast("int")
    pieces = rows.select(id_column, "_y", F.substr(F.col("_t"), place, F.lit(fit.piece)).alias("_t"))
    got = pieces.orderBy(F.xxhash64(id_column), id_column, "_y", "_t").limit(2 * fit.per_label).toPandas()
    share = known.agg(F.avg("_y")).first()[0]
    return train([t.encode() for t in got["_t"]], got["_y"].tolist(), fit, share)


def scored(docs: DataFrame, network: Network, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score) of every document."""
    columns = docs.select(F.col(id_column), text_bytes(text_column).alias("_text"))
    id_type = columns.schema[id_column].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = texts_of(batch)
            for lo, hi in slices(np.fromiter(map(len, texts), np.int64, len(texts)), _BYTES_AT_ONCE):
                found = scorer.documents(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(found)], names=[id_column, "score"])

    return columns.mapInArrow(run, f"`{id_column}` {id_type}, score double")
