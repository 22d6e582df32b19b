"""Quality rules, line first: every line is judged on its own, failing lines go, then documents that lost too much go.

A line with words fails for
- punctuation: no word of it ends in a closing mark, or it has a run of symbols for every third word;
- navigation: it has a menu separator for every fourth word;
- boilerplate: it holds one of the stock phrases of page furniture.
A document is kept if the lines that pass hold at least ``keep_share`` of its words, and the base rules hold: at least
``min_words`` words, of which at most half lie in three-word windows that occur twice or more.

Everything is computed per text in one pass over the table; there is no shuffle and no state between rows.

Defined results: null and empty texts have no words, fail the base rules and clean to an empty text; lines without a
word are neither judged nor counted and are kept as they are; repeated rows are judged alike; an empty table gives an
empty one; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwork.llm.common import text_bytes, texts_of

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))

CLOSING = "[.!?:;\"'”’»…)]([\\x20\\x09-\\x0D]|$)"
SYMBOL_RUN = "[!*#$%&~=_^]{2,}"
SEPARATOR = "[|»›•·]"
BOILERPLATE = (
    "javascript", "cookies", "all rights reserved", "privacy policy", "terms of use", "terms of service", "lorem ipsum", "sign up",
    "log in", "click here", "read more", "subscribe", "share this", "skip to content", "back to top",
)
REASONS = ("punctuation", "navigation", "boilerplate")


@dataclass(frozen=True)
class LineRules:
    keep_share: float = 0.5
    min_words: int = 50
    closing: str = CLOSING
    symbol_run: str = SYMBOL_RUN
    separator: str = SEPARATOR
    boilerplate: tuple[str, ...] = BOILERPLATE  # in lower case, A-Z


class Judge:
    def __init__(self, rules: LineRules):
        self.rules = rules
        self._closing, self._run, self._bar = (re.compile(x) for x in (rules.closing, rules.symbol_run, rules.separator))
        self._stock = [x.encode() for x in rules.boilerplate]

    def _stock_in(self, lowered: bytes) -> bool:
        return any(x in lowered for x in self._stock)

    def line(self, line: bytes, words: int, stock: bool = True) -> str | None:
        """The first rule that a line breaks. ``stock``: whether its document has a stock phrase at all."""
        text = line.decode(errors="replace")
        if not self._closing.search(text) or 3 * len(self._run.findall(text)) > words:
            return "punctuation"
        if 4 * len(self._bar.findall(text)) > words:
            return "navigation"
        return "boilerplate" if stock and self._stock_in(line.lower()) else None

    def text(self, text: bytes) -> dict:
        """All figures of a document, and its cleaned text."""
        words = text.split()
        n, seen, repeated, kept_words, kept = len(words), set(), 0, 0, []
        failed, stock = dict.fromkeys(REASONS, 0), self._stock_in(text.lower())
        for line in text.split(b"\n"):
            own = len(line.split())
            if own:
                repeated += line in seen
                seen.add(line)
                if reason := self.line(line, own, stock):
                    failed[reason] += 1
                    continue
                kept_words += own
            kept.append(line)
        again = repeat_words(words)
        base_failed = n < self.rules.min_words or 100 * again > 50 * n
        return {
            "n_words": n, "word_chars": len(text.translate(None, _CONTINUATION + SPACE)), "n_symbols": len(text) - len(text.translate(None, SYMBOLS)),
            "n_dup_lines": repeated, "n_repeat_words": again, "base_failed": base_failed,
            "kept": not base_failed and kept_words >= self.rules.keep_share * n, "kept_words": kept_words,
            **{f"lines_{k}": v for k, v in failed.items()}, "clean_text": b"\n".join(kept),
        }


def repeat_words(words: list[bytes], size: int = 3) -> int:
    """Words that lie in a window of ``size`` words found twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    windows = ids[:n]
    for k in range(1, size):  # windows are numbered anew when their codes would not fit a long
        if int(windows.max()) >= (1 << 62) // len(number):
            windows = np.unique(windows, return_inverse=True)[1]
        windows = windows * len(number) + ids[k : n + k]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    inside = np.zeros(len(words), bool)
    starts = np.flatnonzero(np.isin(windows, twice))
    for k in range(size):
        inside[starts + k] = True
    return int(inside.sum())


FIGURES = {
    "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean",
    "kept": "boolean", "kept_words": "bigint", **{f"lines_{k}": "bigint" for k in REASONS}, "clean_text": "binary",
}
_ARROW = {"bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def judged(docs: DataFrame, rules: LineRules = LineRules(), id_column: str = "doc_id", text_column: str = "text", with_text: bool = True) -> DataFrame:
    """(id, figures, verdict, failed lines by rule[, clean_text]) of every document."""
    columns = docs.select(F.col(id_column), text_bytes(text_column).alias("_text"))
    id_type = columns.schema[id_column].dataType.simpleString()
    figures = {k: v for k, v in FIGURES.items() if with_text or k != "clean_text"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(rules)
        for batch in batches:
            rows = [judge.text(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], _ARROW[v]) for k, v in figures.items()]], names=[id_column, *figures])

    out = columns.mapInArrow(run, ", ".join([f"`{id_column}` {id_type}", *[f"{k} {v}" for k, v in figures.items()]]))
    return out.withColumn("clean_text", F.col("clean_text").cast("string")) if with_text else out
