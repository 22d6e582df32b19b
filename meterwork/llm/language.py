"""Language identification by a bidirectional gated recurrent network over bytes.

The network labels every byte of a text with a distribution over the learned languages; a document's distribution is
the mean over its bytes. Texts are read whole, in overlapping windows whose inner edges (half an overlap each) count
in the neighbour. Training runs in numpy on the driver on a bounded sample (``Fit``): at most ``per_language``
documents of each language, drawn by a hash of their id, one piece of ``piece`` characters from a drawn place each.
Prediction is one pass without shuffle; executors get the weights (tens of kilobytes).

Defined results: a null text, or one without a letter, is ``und`` with score 0; rows with a null language or id teach
nothing; with no language learned every text is ``und``; repeated rows are judged alike; an empty table gives an
empty one; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwork.llm.common import join_side, slices, staged_small, text_bytes, texts_of
from meterwork.llm.recurrent import Adam, Bidirectional, Gru, by_length, emissions, padded, windows

UNDETERMINED = "und"
_PAD = 256
_BYTES_AT_ONCE = 1 << 22
_FLOATS_AT_ONCE = 1 << 20
_LATIN = re.compile(rb"[A-Za-z]")


@dataclass(frozen=True)
class Fit:
    per_language: int = 1500
    piece: int = 200
    window: int = 64
    hidden: int = 8
    batch: int = 128
    steps: int = 240
    rate: float = 0.02
    seed: int = 4


@dataclass(frozen=True)
class Network:
    languages: tuple[str, ...]
    tables: tuple[np.ndarray, np.ndarray]
    recurrent: tuple[np.ndarray, np.ndarray]
    heads: tuple[np.ndarray, np.ndarray]
    bias: np.ndarray
    window: int = 256
    overlap: int = 16

    def positions(self, ids: np.ndarray) -> np.ndarray:
        """(languages, time, batch): the distribution at every byte."""
        planes = np.ascontiguousarray(emissions(Gru, self.tables, self.recurrent, self.heads, self.bias, ids).transpose(2, 0, 1))
        planes -= planes.max(0)
        np.exp(planes, out=planes)
        planes /= planes.sum(0)
        return planes

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): the mean distribution over the bytes of each text; empty texts have zeros."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = np.frombuffer(b"".join(texts), np.uint8)
        begins = np.cumsum(lengths) - lengths
        doc, start, size = windows(lengths, self.window, self.overlap)
        total = np.zeros((len(texts), len(self.languages)))
        most = max(64, _FLOATS_AT_ONCE // (self.window * len(self.languages)))
        for own in by_length(size, most):
            ids = padded(flat, begins[doc[own]] + start[own], size[own], _PAD)
            at = np.arange(len(ids))[:, None]
            edge = self.overlap // 2
            last = start[own] + size[own] == lengths[doc[own]]
            counted = (at >= np.where(start[own] > 0, edge, 0)) & (at < size[own] - np.where(last, 0, self.overlap - edge))
            counted = counted.astype(np.float32)
            for k, plane in enumerate(self.positions(ids)):
                plane *= counted
                total[:, k] += np.bincount(doc[own], plane.sum(0), len(texts))
        return total / np.maximum(lengths, 1)[:, None]


def train(texts: list[bytes], languages: list[str], fit: Fit = Fit()) -> Network:
    """Cross-entropy at every byte, back through time over windows drawn anew for every step."""
    names = tuple(sorted(set(languages)))
    rng = np.random.default_rng(fit.seed)
    net = Bidirectional(Gru, _PAD, fit.hidden, rng)
    net.weights |= {"head": rng.normal(0, 0.3, (2 * fit.hidden, len(names))).astype(np.float32), "bias": np.zeros(len(names), np.float32)}
    aim = np.array([names.index(x) for x in languages])
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    flat, begins = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lengths) - lengths
    members = [np.flatnonzero((aim == k) & (lengths > 0)) for k in range(len(names))]
    members = [m for m in members if len(m)]
    adam = Adam(net.weights, fit.rate)
    for step in range(fit.steps if len(members) > 1 else 0):
        adam.rate = fit.rate * (1 - step / fit.steps) + 1e-4
        pick = np.concatenate([rng.choice(m, -(-fit.batch // len(members))) for m in members])
        size = np.minimum(lengths[pick], fit.window)
        ids = padded(flat, begins[pick] + (rng.random(len(pick)) * (lengths[pick] - size + 1)).astype(np.int64), size, _PAD)
        states, back = net.forward(ids)
        logits = states @ net.weights["head"] + net.weights["bias"]
        p = np.exp(logits - logits.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        p[:, np.arange(len(pick)), aim[pick]] -= 1
        p *= ((ids != _PAD) / (ids != _PAD).sum())[..., None]
        p = p.astype(np.float32)
        grads = back(p @ net.weights["head"].T)
        grads |= {"head": states.reshape(-1, states.shape[2]).T @ p.reshape(-1, p.shape[2]), "bias": p.sum((0, 1))}
        adam.step(grads)
    head = net.weights["head"]
    return Network(names, net.tables(), net.recurrent(), (head[: fit.hidden].copy(), head[fit.hidden :].copy()), net.weights["bias"])


def learn(docs: DataFrame, teaches: Column, fit: Fit = Fit(), id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Network:
    """Train on documents whose id meets ``teaches``; their number is bounded for each language before they travel."""
    known = docs.filter(teaches & F.col(id_column).isNotNull() & F.col(lang_column).isNotNull() & (F.length(text_column) > 0)).select(
        F.col(lang_column).alias("lang"), F.col(id_column).alias("id"), F.xxhash64(id_column).alias("draw"), F.col(text_column).alias("text"))
    # Thinned by the draw to about three times what is wanted before languages are ranked, so that a common one stays small.
    counts, small = staged_small(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    wanted = F.pmod(F.col("draw"), F.lit(1 << 20)) < F.lit(3.0 * fit.per_language * (1 << 20)) / F.col("n")
    drawn = known.join(join_side(counts, small), "lang").filter(wanted)  # texts are not shuffled for it
    place = F.pmod(F.col("draw"), F.greatest(F.length("text") - fit.piece, F.lit(1)).cast("bigint")) + 1
    pieces = drawn.select("lang", "id", "draw", F.substr(F.col("text"), place.cast("int"), F.lit(fit.piece)).alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id", "text"))
    rows = pieces.withColumn("nth", nth).filter(F.col("nth") <= fit.per_language).select("lang", "nth", "text").toPandas().sort_values(["lang", "nth"])
    return train([t.encode() for t in rows["text"]], rows["lang"].tolist(), fit)


def has_letter(text: bytes) -> bool:
    return bool(_LATIN.search(text)) or any(map(str.isalpha, text.decode(errors="ignore")))


def predicted(docs: DataFrame, network: Network, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score, shares): the likeliest language, its share of the text, and all shares in the order of ``network.languages``."""
    columns = docs.select(F.col(id_column), text_bytes(text_column).alias("_text"))
    id_type = columns.schema[id_column].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        names = np.array([*net.languages, UNDETERMINED], object)
        for batch in batches:
            every = texts_of(batch)
            for lo, hi in slices(np.fromiter(map(len, every), np.int64, len(every)), _BYTES_AT_ONCE):
                texts = every[lo:hi]
                shares = net.documents(texts) if net.languages else np.zeros((len(texts), 0))
                told = np.array([has_letter(t) for t in texts], bool) & (shares.shape[1] > 0)
                best = np.where(told, shares.argmax(1) if shares.shape[1] else 0, len(net.languages))
                score = np.where(told, shares.max(1, initial=0), 0).clip(0, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(names[best], pa.string()), pa.array(score), pa.array(shares.tolist(), pa.list_(pa.float64()))],
                    names=[id_column, "lang_pred", "score", "shares"])

    return columns.mapInArrow(run, f"`{id_column}` {id_type}, lang_pred string, score double, shares array<double>")
