"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Shallow trees are boosted on statistics of labelled texts; every path from a root becomes a rule ("share_upper > 0.3
and words <= 80"). A logistic model over the rules is fitted with a lasso penalty, and the rules that keep a weight are
compiled into one Spark column expression. Trees and weights are fitted in numpy on at most ``Fit.rows`` labelled rows
(drawn by a hash of their id); scoring is an expression on the statistics, with no state and no shuffle.

Defined results: null and empty texts have statistics zero and are scored by the rules that hold for them; rows with
null ids or labels teach nothing; without any labelled row the score is 0.5; repeated rows are scored alike; an empty
table gives an empty one; other columns pass through ``scored`` and ``accepted``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType

from meterwork.llm.common import text_bytes, unused

STATISTICS = (
    "words", "word_length", "lines", "line_words", "share_upper", "share_digits", "share_symbols", "share_exclaim", "share_stops",
    "share_letters", "distinct_words", "repeated_next", "distinct_lines",
)
_UPPER, _DIGITS, _SYMBOLS = range(65, 91), range(48, 58), b"#*$%&|<>=_^~@"
_SPACES = b" \t\n\r\x0b\x0c"


def statistics(text: bytes) -> tuple[float, ...]:
    """The figures of ``STATISTICS`` for a text in UTF-8; shares are of its bytes without white space."""
    words = text.split()
    if not words:
        return (0.0,) * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines = [x for x in text.split(b"\n") if x.strip()]
    n, solid = len(words), len(text) - int(counts[list(_SPACES)].sum())
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    # Capitals beyond A-Z are told by their second byte after 0xC3.
    upper = counts[_UPPER.start : _UPPER.stop].sum() + (text.count(b"\xc3") and sum(text.count(b"\xc3" + bytes([c])) for c in range(0x80, 0x9F)))
    return (
        float(n), solid / n, float(len(lines)), n / len(lines), upper / solid, counts[_DIGITS.start : _DIGITS.stop].sum() / solid,
        counts[list(_SYMBOLS)].sum() / solid, counts[33] / solid, (counts[46] + counts[63]) / n, letters / solid,
        len(set(words)) / n, sum(map(eq, words, words[1:])) / n, len(set(lines)) / len(lines),
    )


@pandas_udf(StructType([StructField(s, DoubleType()) for s in STATISTICS]))
def _statistics(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([statistics(bytes(t)) for t in texts], columns=list(STATISTICS))


@dataclass(frozen=True)
class Fit:
    rows: int = 20_000  # labelled rows at most
    trees: int = 40
    depth: int = 3
    cuts: int = 48
    least_rows: int = 10
    rate: float = 0.3
    penalty: float = 3e-4
    steps: int = 600


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is above, cut)."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self, stats: str) -> Column:
        held = F.lit(True)
        for name, above, cut in self.tests:
            value = F.col(stats)[name]
            held = held & ((value > cut) if above else (value <= cut))
        return held

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, above, cut in self.tests:
            value = x[:, STATISTICS.index(name)]
            out &= value > cut if above else value <= cut
        return out


@dataclass(frozen=True)
class Ensemble:
    base: float
    rules: tuple[tuple[float, Rule], ...]

    def column(self, stats: str = "_stats") -> Column:
        """Probability of label 1 as a Spark expression on a struct of statistics."""
        total = F.lit(self.base)
        for weight, rule in self.rules:
            total = total + F.when(rule.column(stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for weight, rule in self.rules:
            total += weight * rule.holds(x)
        return 1 / (1 + np.exp(-total))


def _grow(codes: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, fit: Fit, path: tuple, found: list, leaf: np.ndarray) -> None:
    """Split by the gain of second-order boosting; ``found`` collects the path of every node."""
    value = -grad[rows].sum() / (hess[rows].sum() + 1.0)
    leaf[rows] = value
    if depth == 0 or len(rows) < 2 * fit.least_rows:
        return
    best, at = 1e-6, None
    g, h, whole = grad[rows], hess[rows], grad[rows].sum() ** 2 / (hess[rows].sum() + 1.0)
    for k in range(codes.shape[1]):
        c, size = codes[rows, k], fit.cuts + 1
        left_n, left_g, left_h = (np.cumsum(np.bincount(c, w, size))[:-1] for w in (None, g, h))
        gain = left_g**2 / (left_h + 1.0) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1.0) - whole
        gain[(left_n < fit.least_rows) | (len(rows) - left_n < fit.least_rows)] = 0
        if gain.max() > best:
            best, at = gain.max(), (k, int(gain.argmax()))
    if at is None:
        return
    above = codes[rows, at[0]] > at[1]
    for side in (False, True):
        longer = (*path, (at[0], side, at[1]))
        found.append(longer)
        _grow(codes, grad, hess, rows[above == side], depth - 1, fit, longer, found, leaf)


def _lasso(held: np.ndarray, y: np.ndarray, fit: Fit) -> tuple[float, np.ndarray]:
    """Logistic weights under an l1 penalty by accelerated proximal gradient; the base is not penalised."""
    x = np.hstack([np.ones((len(y), 1)), held])
    step = 4.0 * len(y) / (np.linalg.norm(x, 2) ** 2)
    w = v = np.zeros(x.shape[1])
    t = 1.0
    for _ in range(fit.steps):
        moved = v - step * x.T @ (1 / (1 + np.exp(-x @ v)) - y) / len(y)
        moved[1:] = np.sign(moved[1:]) * np.maximum(np.abs(moved[1:]) - step * fit.penalty, 0)
        ahead = (1 + math.sqrt(1 + 4 * t * t)) / 2
        w, v, t = moved, moved + (t - 1) / ahead * (moved - w), ahead
    return float(w[0]), w[1:]


def fit_ensemble(x: np.ndarray, y: np.ndarray, fit: Fit = Fit()) -> Ensemble:
    prior = (y.sum() + 1.0) / (len(y) + 2.0)
    if len(y) == 0 or y.min() == y.max():
        return Ensemble(math.log(prior / (1 - prior)), ())
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, fit.cuts + 2)[1:-1])) for k in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1)
    score, found = np.full(len(y), math.log(prior / (1 - prior))), []
    for _ in range(fit.trees):
        p, leaf = 1 / (1 + np.exp(-score)), np.empty(len(y))
        _grow(codes, p - y, p * (1 - p), np.arange(len(y)), fit.depth, fit, (), found, leaf)
        score += fit.rate * leaf
    # A cut codes as "value <= cuts[code]"; only the tightest bound of a statistic in one direction counts.
    rules: dict[Rule, None] = {}
    for path in found:
        tight: dict[tuple[int, bool], int] = {}
        for k, side, code in path:
            tight[k, side] = (max if side else min)(tight.get((k, side), code), code)
        rules[Rule(tuple((STATISTICS[k], side, float(cuts[k][code])) for (k, side), code in sorted(tight.items())))] = None
    if not rules:
        return Ensemble(math.log(prior / (1 - prior)), ())
    held = np.stack([r.holds(x) for r in rules], 1).astype(float)
    _, first = np.unique(held, axis=1, return_index=True)  # rules that hold for the same rows are one
    first = np.sort(first)
    base, weights = _lasso(held[:, first], y, fit)
    listed = list(rules)
    return Ensemble(base, tuple((float(w), listed[i]) for w, i in zip(weights, first) if w != 0))


def learn(docs: DataFrame, labels: DataFrame, label: str, teaches: Column, fit: Fit = Fit(), id_column: str = "doc_id", text_column: str = "text") -> Ensemble:
    """Fit on the documents of ``labels`` whose id meets ``teaches`` (a condition on the id column)."""
    drawn = F.xxhash64(id_column)
    known = labels.filter(F.col(id_column).isNotNull() & F.col(label).isNotNull() & teaches).select(id_column, F.col(label).cast("double").alias("_y"))
    sample = known.orderBy(drawn, id_column, "_y").limit(fit.rows)
    ours = docs.select(F.col(id_column).alias("_id"), text_bytes(text_column).alias("_t"))
    rows = ours.join(F.broadcast(sample), F.col("_id") == F.col(id_column))  # fit.rows narrow rows at most
    stats = rows.select(id_column, "_y", _statistics("_t").alias("_stats")).select(id_column, "_y", "_stats.*")
    got = stats.orderBy(F.xxhash64(id_column), id_column, "_y", *STATISTICS).limit(fit.rows).toPandas()
    return fit_ensemble(got[list(STATISTICS)].to_numpy(float), (got["_y"].to_numpy(float) > 0).astype(float), fit)


def scored(docs: DataFrame, model: Ensemble, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1; a column that is already called ``score_column`` is replaced."""
    stats = unused([*docs.columns, score_column], "_stats")
    return docs.withColumn(stats, _statistics(text_bytes(text_column))).withColumn(score_column, model.column(stats)).drop(stats)


def accepted(docs: DataFrame, model: Ensemble, least: float = 0.7, text_column: str = "text") -> DataFrame:
    """The documents that score ``least`` or more, columns unchanged."""
    score = unused(docs.columns, "_score")
    return scored(docs, model, text_column, score).filter(F.col(score) >= least).drop(score)
