"""Personal data by a character-level bidirectional LSTM with CRF transitions, beside exact base patterns.

Base spans (e-mail, IP address, card and phone number) come from fixed patterns, each kind on its own. A network over
characters then tags every position of every whole text: overlapping windows are decoded by Viterbi, every position
takes its tag from the window in which it lies deeper, and runs of one tag over the whole text are spans. Spans the
network adds must look like their kind (``plausible``) and touch no base span; base spans always stay.

Training runs in numpy on the driver on a bounded sample of labelled spans (``Fit``): snippets of at most ``rows`` drawn
documents around digits or "@", labelled by the base patterns, and rewritten variants of them (numbers grouped anew or
without "+", spelled-out "@") whose labels follow the rewriting. Tagging is one pass without shuffle.

Defined results: null and empty texts have no spans; rows with null ids teach nothing; without any labelled span the
network adds none; repeated rows are tagged alike; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwork.llm.common import slices, text_bytes, texts_of
from meterwork.llm.recurrent import Adam, Bidirectional, Lstm, by_length, emissions, padded, windows

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end in code points

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is tried from its first digit only: later starts fail the same way.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_OTHER, _PAD = 128, 129
_CHARS_AT_ONCE, _WINDOWS_AT_ONCE = 1 << 20, 2048
_FORBIDDEN = np.float32(-1e4)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches found from each "@" outwards, so a long run of letters is walked once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield 0, start, match.end()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start, then kind."""
    found = list(_emails(text))
    if _DIGIT.search(text):
        found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append((2, m.start(), m.end()))
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], s[0]))


#: Characters that a run of a kind is widened by, and what may part two runs of one span.
_AROUND = (frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-@"), frozenset("0123456789."), frozenset("0123456789"), frozenset("0123456789+("))
_SEPARATORS, _APART = " .-/()[]", 5


def plausible(kind: int, text: str) -> bool:
    """Whether text tagged by the network can be of its kind at all."""
    n = len(_digits(text))
    if kind == 0:
        return 6 <= len(text) <= 254 and text.count(" ") <= 4 and bool(re.search(r"@|\bat\b", text)) and bool(re.search(r"\.|\bdot\b", text))
    if kind == 1:
        return re.fullmatch(r"[0-9]{1,3}(?:[.\[\]() ]{1,5}[0-9]{1,3}){3}", text) is not None and all(int(x) <= 255 for x in re.findall("[0-9]+", text))
    if not re.fullmatch(r"[0-9+(][0-9 ().+/-]*[0-9]", text):
        return False
    return (14 <= n <= 19 and luhn(_digits(text))) if kind == 2 else 10 <= n <= 15 and re.search(r"[0-9][ ()./-]+[0-9]", text) is not None


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def symbols(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), _OTHER).astype(np.int16)


@dataclass(frozen=True)
class Fit:
    rows: int = 3000
    drawn: int = 30  # documents looked at for each row wanted
    around: int = 60
    hidden: int = 8
    batch: int = 96
    warm_up: int = 280
    steps: int = 400
    window: int = 80
    rate: float = 0.02
    seed: int = 10


@dataclass(frozen=True)
class Network:
    """Tags: 0 is outside, k + 1 is kind k. Transitions between kinds are forbidden."""

    tables: tuple[np.ndarray, np.ndarray]
    recurrent: tuple[np.ndarray, np.ndarray]
    heads: tuple[np.ndarray, np.ndarray]
    bias: np.ndarray
    transitions: np.ndarray  # from, to
    window: int = 512
    overlap: int = 64

    def viterbi(self, ids: np.ndarray) -> np.ndarray:
        """The likeliest tags (time, batch)."""
        planes = np.ascontiguousarray(emissions(Lstm, self.tables, self.recurrent, self.heads, self.bias, ids).transpose(0, 2, 1))
        pads = ids == _PAD
        planes[:, 1:, :][np.broadcast_to(pads[:, None, :], planes[:, 1:, :].shape)] = _FORBIDDEN
        move, kinds = self.transitions, range(1, planes.shape[1])
        score, a, b = planes[0], *(np.empty(ids.shape[1], np.float32) for _ in range(2))
        for t in range(1, len(ids)):
            now = planes[t]
            np.add(score[0], move[0, 0], out=a)
            for k in kinds:
                np.add(score[k], move[k, 0], out=b)
                np.maximum(a, b, out=a)
            now[0] += a
            for k in kinds:
                np.add(score[k], move[k, k], out=a)
                np.add(score[0], move[0, k], out=b)
                np.maximum(a, b, out=a)
                now[k] += a
            score = now
        tags = np.empty(ids.shape, np.int8)
        tags[-1] = score.argmax(0)
        stay, enter, leave = move.diagonal()[:, None], move[0][:, None], move[:, 0][:, None]
        for t in range(len(ids) - 2, -1, -1):
            after, score = tags[t + 1], planes[t]
            tags[t] = (score + leave).argmax(0)
            inside = np.flatnonzero(after)
            if len(inside):
                k, own = after[inside], score[:, inside]
                kept = own[k, np.arange(len(k))] + stay[k, 0] >= own[0] + enter[k, 0]
                tags[t, inside] = np.where(kept, k, 0)
        return tags

    def tagged(self, texts: list[str]) -> list[np.ndarray]:
        """Tags of all positions of every text, reconciled over its windows."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = symbols("".join(texts))
        begins = np.cumsum(lengths) - lengths
        doc, start, size = windows(lengths, self.window, self.overlap)
        tags, edge = np.zeros(len(flat), np.int8), self.overlap // 2
        for own in by_length(size, _WINDOWS_AT_ONCE):
            at = begins[doc[own]] + start[own]
            found = self.viterbi(padded(flat, at, size[own], _PAD))
            last = start[own] + size[own] == lengths[doc[own]]
            low, high = np.where(start[own] > 0, edge, 0), size[own] - np.where(last, 0, self.overlap - edge)
            place = np.arange(len(found))[:, None]
            t, w = np.nonzero((found != 0) & (place >= low) & (place < high))
            tags[at[w] + t] = found[t, w]
        return np.split(tags, np.cumsum(lengths)[:-1]) if len(texts) else []

    def added(self, text: str, tags: np.ndarray, base: list[Span]) -> list[Span]:
        """Spans of the tag runs that are plausible and touch no base span.

        Runs of one kind that only separators part are one. A run is widened to the characters of its kind around it,
        as tags may miss its ends; so no span ends inside a number or a name.
        """
        edges = np.flatnonzero(np.diff(tags, prepend=0, append=0)).tolist()
        runs: list[list[int]] = []
        for a, b in zip(edges, edges[1:]):
            if not tags[a]:
                continue
            kind = int(tags[a]) - 1
            if runs and runs[-1][0] == kind and a - runs[-1][2] <= _APART and not text[runs[-1][2] : a].strip(_SEPARATORS):
                runs[-1][2] = b
            else:
                runs.append([kind, a, b])
        out: list[Span] = []
        for kind, a, b in runs:
            choices = [(kind, *_widened(kind, text, a, b))]
            if kind:  # numbers written in groups: the tags may know only some of them
                around = _grouped(text, *choices[0][1:])
                choices += [(k, *around) for k in (2, 3) if k in (2, kind)]
            for k, begin, end in choices:
                piece = text[begin:end]
                begin += len(piece) - len(piece.lstrip(" .,;:\n\t"))
                end -= len(piece) - len(piece.rstrip(" .,;:\n\t"))
                if begin < end and plausible(k, text[begin:end]) and not any(x < end and begin < y for _, x, y in (*base, *out)):
                    out.append((k, begin, end))
                    break
        return out


def _grouped(text: str, a: int, b: int, most: int = 40) -> tuple[int, int]:
    """A run of digits with the groups of digits before and behind it, parted by a few separators each."""
    before = re.search(r"(?:[0-9+(]{1,19}[ .\-/()]{1,3})*$", text[max(0, a - most) : a])
    behind = re.match(r"(?:[ .\-/()]{1,3}[0-9]{1,19})*", text[b : b + most])
    return a - len(before[0]), b + len(behind[0])


def _widened(kind: int, text: str, a: int, b: int) -> tuple[int, int]:
    """A run with the characters of its kind right before and behind it."""
    own = _AROUND[kind]
    while a > 0 and text[a - 1] in own:
        a -= 1
    while b < len(text) and text[b] in own:
        b += 1
    return a, b


def _crf_gradient(em: np.ndarray, move: np.ndarray, tags: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the negative log likelihood of ``tags`` by forward and backward sums; ``real`` masks padding."""
    steps, batch, n = em.shape
    ahead, behind = (np.zeros((steps, batch, n)) for _ in range(2))
    weight = np.exp(move.astype(np.float64))
    e = np.exp(em.astype(np.float64) - em.max(2, keepdims=True))
    ahead[0] = e[0] / e[0].sum(1, keepdims=True)
    for t in range(1, steps):
        x = (ahead[t - 1] @ weight) * e[t]
        ahead[t] = np.where(real[t][:, None], x / x.sum(1, keepdims=True), ahead[t - 1])
    behind[-1] = 1
    for t in range(steps - 2, -1, -1):
        x = (behind[t + 1] * e[t + 1]) @ weight.T
        behind[t] = np.where(real[t + 1][:, None], x / x.sum(1, keepdims=True), behind[t + 1])
    post = ahead * behind
    post /= post.sum(2, keepdims=True)
    pairs = np.einsum("tbi,tbj->tbij", ahead[:-1], behind[1:] * e[1:]) * weight
    pairs /= pairs.sum((2, 3), keepdims=True)
    post[np.arange(steps)[:, None], np.arange(batch), tags] -= 1
    d_move = (pairs * real[1:, :, None, None]).sum((0, 1))
    np.subtract.at(d_move, (tags[:-1][real[1:]], tags[1:][real[1:]]), 1)
    return post * real[..., None], d_move


def _rewritten(text: str, span: Span, rng: np.random.Generator) -> tuple[str, Span]:
    """The same personal datum written another way, its span moved along."""
    kind, a, b = span
    piece = text[a:b]
    pick = lambda *x: x[rng.integers(len(x))]
    if kind == 0:
        new = piece.replace("@", pick(" at ", " (at) ", "[at]"))
    elif kind == 1:
        new = piece.replace(".", pick("[.]", " . ", "(.)", ". "))
    elif kind == 2:
        digits, size = _digits(piece), pick(4, 4, 5, 6)
        new = pick(" ", "-", ".", "/", "  ").join(digits[i : i + size] for i in range(0, len(digits), size))
    else:
        digits, mark = _digits(piece)[-10:], pick("-", ".", " ", "/")
        cuts = pick((3, 6), (4, 7), (3, 6, 8), (5,))
        groups = [digits[i:j] for i, j in zip((0, *cuts), (*cuts, len(digits)))]
        new = f"({groups[0]}) {mark.join(groups[1:])}" if rng.integers(3) == 0 else mark.join(groups)
    return text[:a] + new + text[b:], (kind, a, a + len(new))


def train(snippets: list[str], fit: Fit = Fit()) -> Network:
    """Log likelihood of the CRF over windows of labelled snippets, back through time."""
    rng = np.random.default_rng(fit.seed)
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    kinds: list[int] = []
    for text in snippets:
        spans = base_spans(text)
        versions = [(text, spans)]
        if len(spans) == 1:
            new, moved = _rewritten(text, spans[0], rng)
            versions.append((new, [moved]))
        for said, own in versions:
            tags = np.zeros(len(said), np.int64)
            for k, a, b in own:
                tags[a:b] = k + 1
            rows.append((symbols(said).astype(np.int64), tags))
            kinds.append(own[0][0] + 1 if own else 0)
    net = Bidirectional(Lstm, _PAD, fit.hidden, rng)
    tags_n = len(KINDS) + 1
    allowed = np.eye(tags_n, dtype=bool)
    allowed[0], allowed[:, 0] = True, True
    net.weights |= {"head": rng.normal(0, 0.3, (2 * fit.hidden, tags_n)).astype(np.float32), "bias": np.array([1.0] + [0.0] * len(KINDS), np.float32),
                    "move": np.where(allowed, 0, _FORBIDDEN).astype(np.float32)}
    members = [m for k in range(tags_n) if len(m := np.flatnonzero(np.array(kinds) == k))]
    taught = any(kinds)
    adam = Adam(net.weights, fit.rate)
    for step in range(fit.steps if taught else 0):
        adam.rate = fit.rate * (1 - step / fit.steps) + 1e-4
        pick = np.concatenate([rng.choice(m, -(-fit.batch // len(members))) for m in members])
        cut = [int(rng.integers(0, max(1, len(rows[i][0]) - fit.window + 1))) for i in pick]
        parts = [(rows[i][0][c : c + fit.window], rows[i][1][c : c + fit.window]) for i, c in zip(pick, cut)]
        parts = [x for x in parts if len(x[0])]
        long = max(len(x) for x, _ in parts)
        ids = np.stack([np.pad(x, (0, long - len(x)), constant_values=_PAD) for x, _ in parts], 1)
        tags = np.stack([np.pad(y, (0, long - len(y))) for _, y in parts], 1)
        states, back = net.forward(ids)
        em = states @ net.weights["head"] + net.weights["bias"]
        if step < fit.warm_up:  # each position on its own first, which is cheaper and finds the characters that matter
            d = np.exp(em - em.max(2, keepdims=True))
            d /= d.sum(2, keepdims=True)
            d[np.arange(len(ids))[:, None], np.arange(ids.shape[1]), tags] -= 1
            d, d_move = d * (ids != _PAD)[..., None], np.zeros((tags_n, tags_n))
        else:
            d, d_move = _crf_gradient(em, net.weights["move"], tags, ids != _PAD)
        scale = np.float32(1 / (ids != _PAD).sum())
        d = d.astype(np.float32) * scale
        grads = back(d @ net.weights["head"].T)
        grads |= {"head": states.reshape(-1, states.shape[2]).T @ d.reshape(-1, tags_n), "bias": d.sum((0, 1)), "move": np.where(allowed, d_move, 0).astype(np.float32) * scale}
        adam.step(grads)
    w, hid = net.weights, fit.hidden
    if not taught:
        w["bias"][1:] = _FORBIDDEN
    return Network(net.tables(), net.recurrent(), (w["head"][:hid].copy(), w["head"][hid:].copy()), w["bias"], w["move"])


def learn(docs: DataFrame, fit: Fit = Fit(), id_column: str = "doc_id", text_column: str = "text") -> Network:
    """Train on snippets of drawn documents: those with digits or "@" around the first of them, and as many without."""
    first = F.regexp_instr(F.col(text_column), F.lit(r"[0-9]{2}|\+[0-9]|@"))
    # Thinned by the draw first: what is sorted and sent stays the same however many documents there are.
    thin = F.pmod(F.xxhash64(id_column), F.lit(1 << 20)) < F.lit(fit.drawn * fit.rows * float(1 << 20) / max(1, docs.count()))
    drawn = docs.filter(F.col(id_column).isNotNull() & (F.length(text_column) > 0) & thin).select(
        F.col(id_column).alias("id"), F.xxhash64(id_column).alias("draw"), F.col(text_column).alias("text"), first.alias("first"))
    begin = F.greatest(F.col("first") - fit.around, F.lit(1))
    drawn = drawn.select("id", "draw", (F.col("first") > 0).alias("held"), F.substr("text", begin, F.lit(3 * fit.around)).alias("snippet"))
    some = [drawn.filter(c & (F.length("snippet") > 0)).orderBy("draw", "id", "snippet").limit(n).select("id", "held", "snippet")
            for c, n in ((F.col("held"), fit.rows), (~F.col("held"), fit.rows // 3))]
    return train([r["snippet"] for part in some for r in part.collect()], fit)


def found(docs: DataFrame, network: Network, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): base counts and digest, and all spans as text."""
    columns = docs.select(F.col(id_column), text_bytes(text_column).alias("_text"))
    id_type = columns.schema[id_column].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(network)
    names = [id_column, *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            every = [t.decode(errors="replace") for t in texts_of(batch)]
            for lo, hi in slices(np.fromiter(map(len, every), np.int64, len(every)), _CHARS_AT_ONCE):
                counts, digests, spans, more = [], [], [], []
                for text, tags in zip(every[lo:hi], net.tagged(every[lo:hi])):
                    base = base_spans(text)
                    extra = net.added(text, tags, base)
                    counts.append([sum(s[0] == k for s in base) for k in range(len(KINDS))])
                    digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    spans.append(joined(sorted(base + extra, key=lambda s: (s[1], s[0]))))
                    more.append(len(extra))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *[pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))],
                     pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64())], names=names)

    return columns.mapInArrow(run, f"`{id_column}` {id_type}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, n_added bigint")
