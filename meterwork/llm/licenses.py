"""Licence scans: matching statistics against a generalised suffix automaton of licence templates, chained into spans.

All templates are read into one automaton over their words. A text is streamed through it word by word; at every word it
knows the longest run ending there that occurs in some template, and where. Maximal runs of ``min_run`` words or more
are anchors (text place, template place, length). Anchors that follow each other in both the text and a template, with
gaps of at most ``max_gap`` words, form a chain; a chain that covers ``min_share`` of its template is a span of it. The
fixed phrases are read into the same automaton: a phrase stands where the current match is as long and ends in it.

Everything is computed per text in one pass over the table, without a shuffle; the templates are a parameter of a few
thousand words. Chains hold the anchors of the last ``max_gap`` words only.

Defined results: null and empty texts have no words, no labels and score 0; words are runs of anything but ASCII
characters that are neither letters nor digits; very long texts are read in pieces that end between words, with the
automaton's state carried on; repeated rows are scanned alike; an empty table gives an empty one; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwork.llm.common import text_bytes

# The phrases, and the wording of public licences as their notices give it.
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
                   "See the License for the specific language governing permissions and limitations under the License."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
                     "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
                     "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
                     "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors "
                     "may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
                "Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
            "copyright notice and this permission notice appear in all copies."),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
                "You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
                  "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PIECE = 1 << 20


@dataclass(frozen=True)
class ScanRules:
    phrases: tuple[tuple[str, str], ...] = PHRASES  # (label, words)
    templates: tuple[tuple[str, str], ...] = TEMPLATES
    min_run: int = 3
    max_gap: int = 12
    min_share: float = 0.8


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words."""
    return text.translate(_WORD_BYTES).split()


def pieces(text: bytes, size: int = _PIECE) -> Iterator[list[bytes]]:
    """The words of a text, a piece of the text at a time."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        while end < len(text) and _WORD_BYTES[text[end]] != 32:
            end += 1
        yield words_of(text[at:end])
        at = end


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences; every state knows the places where its words end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence):
                last = self._extended(last, word, ends)
                ends[last].append((number, place + 1))
        # A state's places are its own and those of the states whose suffix it is.
        self.ends = [set(x) for x in ends]
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] |= self.ends[state]
        self.ends[0] = set()

    def _added(self, length: int, ends: list) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        ends.append([])
        return len(self.length) - 1

    def _split(self, state: int, word: int, ends: list) -> int:
        """The state reached from ``state`` by ``word`` that holds no longer run than that; a copy is cut off if needed."""
        there = self.next[state][word]
        if self.length[there] == self.length[state] + 1:
            return there
        copy = self._added(self.length[state] + 1, ends)
        self.next[copy], self.link[copy] = dict(self.next[there]), self.link[there]
        self.link[there] = copy
        while state >= 0 and self.next[state].get(word) == there:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extended(self, last: int, word: int, ends: list) -> int:
        if word in self.next[last]:
            return self._split(last, word, ends)
        new = self._added(self.length[last] + 1, ends)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        self.link[new] = 0 if last < 0 else self._split(last, word, ends)
        return new


@dataclass
class Scan:
    """What a text holds: words, places of phrases (start, label) and spans (label, first word, end, covered, share)."""

    n_words: int = 0
    places: list[tuple[int, str]] = field(default_factory=list)
    spans: list[tuple[str, int, int, int, float]] = field(default_factory=list)
    share: float = 0.0


class Scanner:
    def __init__(self, rules: ScanRules = ScanRules()):
        self.rules = rules
        named = [*rules.phrases, *rules.templates]
        listed = [words_of(text.encode()) for _, text in named]
        self.labels, self.sizes = [label for label, _ in named], [len(x) for x in listed]
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for x in listed for w in x))}
        self.automaton = SuffixAutomaton([[self.number[w] for w in x] for x in listed])
        self.phrases = len(rules.phrases)
        # A phrase ends in a match when its whole state is the match's state or one of its suffixes.
        whole = {}
        for k in range(self.phrases):
            state = 0
            for w in listed[k]:
                state = self.automaton.next[state][self.number[w]]
            whole.setdefault(state, []).append(k)
        self.whole: list[list[int]] = []
        for state in range(len(self.automaton.length)):
            met, at = [], state
            while at > 0:
                met += whole.get(at, [])
                at = self.automaton.link[at]
            self.whole.append(met)
        self.shortest = min([rules.min_run, *self.sizes[: self.phrases]])
        # (template, end, longest run, next word) of the templates' places that a state or one of its suffixes ends in.
        self.places: list[list[tuple[int, int, int, int]]] = []
        for state in range(len(self.automaton.length)):
            met, at, cap = {}, state, self.automaton.length[state]
            while at > 0 and cap >= rules.min_run:
                for k, end in self.automaton.ends[at]:
                    if k >= self.phrases and (k, end) not in met:
                        met[k, end] = (k, end, cap, self.number[listed[k][end]] if end < len(listed[k]) else -1)
                at = self.automaton.link[at]
                cap = self.automaton.length[at]
            self.places.append(sorted(met.values()))

    def scan(self, text: bytes) -> Scan:
        out, chains = Scan(), Chains(self.sizes, self.labels, self.rules)
        step, link, length, whole = self.automaton.next, self.automaton.link, self.automaton.length, self.whole
        number, sizes, places, least = self.number, self.sizes, self.places, self.rules.min_run
        state = held = at = 0

        def stopped(word: int | None, end: int) -> None:
            """Runs that end before the text's word ``end`` and cannot be carried on with ``word``."""
            for template, place, cap, following in places[state]:
                if following != word:
                    chains.anchor(template, place, min(held, cap), end)

        for words in pieces(text):
            ids = list(map(number.get, words))
            known = np.flatnonzero(np.fromiter((x is not None for x in ids), bool, len(ids)))
            cuts = np.flatnonzero(np.diff(known) > 1) + 1
            starts = np.concatenate((known[:1], known[cuts])).tolist()
            stops = np.concatenate((known[cuts - 1], known[-1:])).tolist()
            if held >= least and ids and ids[0] is None:
                stopped(None, at)
            if ids and ids[0] is None:
                state = held = 0
            for a, b in zip(starts, stops):
                b += 1
                if b - a < self.shortest and a > 0 and b < len(ids):
                    continue  # too short for an anchor or a phrase, whatever it holds
                for i in range(a, b):
                    word = ids[i]
                    if held >= least:
                        stopped(word, at + i)
                    while state and word not in step[state]:
                        state = link[state]
                        held = length[state]
                    if word in step[state]:
                        state = step[state][word]
                        held += 1
                    for k in whole[state]:
                        if held >= sizes[k]:
                            out.places.append((at + i + 1 - sizes[k], self.labels[k]))
                if b < len(ids):
                    if held >= least:
                        stopped(None, at + b)
                    state = held = 0
            at += len(ids)
        if held >= least:
            stopped(None, at)
        out.n_words = at
        out.spans, out.share = chains.spans()
        if out.places:
            out.share = 1.0
        return out


class Chains:
    """Open chains by template: (text start, text end, template end, covered). Anchors come in the order of their text ends."""

    def __init__(self, sizes: list[int], labels: list[str], rules: ScanRules):
        self.sizes, self.labels, self.rules = sizes, labels, rules
        self.open: dict[int, list[tuple[int, int, int, int]]] = {}
        self.found: dict[int, list[tuple[int, int, int]]] = {}
        self.best = 0.0

    def anchor(self, template: int, end: int, length: int, text_end: int) -> None:
        """``length`` words that end before word ``end`` of the template and word ``text_end`` of the text."""
        if length < self.rules.min_run:
            return
        gap, size = self.rules.max_gap, self.sizes[template]
        text_start, start = text_end - length, end - length
        best, begins = length, text_start
        chains = [c for c in self.open.get(template, ()) if text_end - c[1] <= gap + size]  # no later run reaches further back
        for begun, text_at, template_at, covered in chains:
            if text_at < text_end and template_at < end and text_start - text_at <= gap and start - template_at <= gap:
                more = covered + min(length, text_end - text_at, end - template_at)
                if (more, begun) > (best, begins):
                    best, begins = more, begun
        self.open[template] = [*chains, (begins, text_end, end, best)]
        self.best = max(self.best, best / size)
        if best >= self.rules.min_share * size:
            self._note(template, begins, text_end, best)

    def _note(self, template: int, start: int, end: int, covered: int) -> None:
        """Spans of one template that overlap are one; the larger cover counts."""
        spans = self.found.setdefault(template, [])
        while spans and spans[-1][1] > start:
            old = spans.pop()
            start, end, covered = min(old[0], start), max(old[1], end), max(old[2], covered)
        spans.append((start, end, covered))

    def spans(self) -> tuple[list[tuple[str, int, int, int, float]], float]:
        rows = [(self.labels[t], a, b, c, c / self.sizes[t]) for t, spans in self.found.items() for a, b, c in spans]
        return sorted(rows, key=lambda r: (r[1], r[0], r[2], r[4])), self.best


_SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())])
_PLACE = pa.struct([("first", pa.int64()), ("label", pa.string())])


def scanned(docs: DataFrame, rules: ScanRules = ScanRules(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, places[first, label], spans[label, first, end, covered, share], score) of every document.

    ``places`` are those of the phrases. ``score`` is the largest share of a template that a chain covers, 1 where a
    phrase stands.
    """
    columns = docs.select(F.col(id_column), text_bytes(text_column).alias("_text"))
    id_type = columns.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            rows = [scanner.scan(t.as_py() or b"") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.n_words for r in rows], pa.int64()),
                 pa.array([[{"first": a, "label": k} for a, k in sorted(r.places)] for r in rows], pa.list_(_PLACE)),
                 pa.array([[dict(zip(("label", "first", "end", "covered", "share"), s)) for s in r.spans] for r in rows], pa.list_(_SPAN)),
                 pa.array([r.share for r in rows], pa.float64())],
                names=[id_column, "n_words", "places", "spans", "score"])

    return columns.mapInArrow(
        run, f"`{id_column}` {id_type}, n_words bigint, places array<struct<first:bigint,label:string>>, "
        "spans array<struct<label:string,first:bigint,end:bigint,covered:bigint,share:double>>, score double")
