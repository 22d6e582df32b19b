import random
import re
import zlib
from collections import Counter

import pytest

from meterwork.llm import queries
from meterwork.llm.spelling import BidirectionalIndex, near_pairs, pieces, spelling_variants, variants
from tests.llm.conftest import AWKWARD


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_words(rows):
    lower, counts = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def slow_variants(words):
    out = {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        out[w] = [n, len(near), best if best and words[best] >= 5 * n else None]
    for w, row in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        row += [words[row[2]] if row[2] else None, root]
    return out


def found(df):
    return {r["word"]: [r["n"], r["n_near"], r["form"], r["form_n"], r["root"]] for r in df.collect()}


@pytest.mark.parametrize("seed", range(12))
def test_index_finds_what_comparing_finds(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(6, 9))) for _ in range(rng.choice([1, 3, 60]))})
    asked = [*words, "zzzzzz", "abababzb", "aaaaaaaaaaaaaaa"]
    index = BidirectionalIndex(words)
    for forward in (True, False):
        shares = (lambda q, w: w.startswith(q[: len(q) // 2])) if forward else (lambda q, w: w.endswith(q[len(q) // 2 :]))
        got = {(asked[i], words[j]) for i, j in zip(*(x.tolist() for x in index.search(asked, forward)))}
        assert got == {(q, w) for q in asked for w in words if one_edit(q, w) and shares(q, w)}


def test_both_directions_stay_in_step():
    words = ["banana", "bandana", "cabanas"]
    index = BidirectionalIndex(words)
    text = "\0" + "\0".join(words) + "\0"
    codes, _ = index.coded(["ana"])
    import numpy as np

    low, size, other = np.array([0]), np.array([len(text)]), np.array([0])
    low, size, other = index.left.grow(low, size, other, codes[1:2])  # n
    low, size, other = index.left.grow(low, size, other, codes[:1])  # an
    other, size, low = index.right.grow(other, size, low, codes[2:])  # ana, grown to the other side
    places = sorted(index.left.order[int(low[0]) : int(low[0] + size[0])].tolist())
    assert places == [m.start() for m in re.finditer("(?=ana)", text)]
    back = sorted(len(text) - p - 3 for p in index.right.order[int(other[0]) : int(other[0] + size[0])].tolist())
    assert back == places


def test_pieces_never_cut_a_run():
    text = "Straße über 漢字漢字 Ünïcode-wörds déjà vu 123abc " * 20
    for size in (1, 2, 7, 64):
        parts = list(pieces(text.encode(), size))
        assert "".join(parts) == "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        assert [r for p in parts for r in re.findall("[a-zà-ÿÀ-ß]+", p)] == re.findall("[a-zÀ-ÿ]+", "".join(parts))
        assert all("漢" not in p or len(p) < 80 for p in parts)


def corpus(seed, n=60):
    rng = random.Random(seed)
    stems = ["accord", "receive", "separate", "théâtre", "definite", "accordé", "abababab"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(80):
            w = rng.choice(stems)
            if rng.random() < 0.15:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + "x" + w[at:], w[:at] + "e" + w[at + 1 :]])
            words.append(w.title() if rng.random() < 0.1 else w)
        rows.append((i, " ".join(words)))
    return rows


def test_variants_equal_brute_force(docs):
    rows = corpus(5)
    want = slow_variants(slow_words(rows))
    assert any(r[2] for r in want.values()) and max(r[1] for r in want.values()) > 5
    assert found(spelling_variants(docs(rows))) == want


def test_hot_beginnings_are_cut_into_blocks(spark):
    rng = random.Random(2)
    words = {"con" + "".join(rng.choice("ab") for _ in range(rng.randrange(3, 7))) + "ion": rng.randrange(5, 500) for _ in range(150)} | {"zzzzzzz": 9}
    vocab = spark.createDataFrame(sorted(words.items()), "word string, n bigint")
    pairs = {(a, b) for a in words for b in words if one_edit(a, b)}
    for block in (16_384, 7):
        got = [(r["word"], r["near"], r["near_n"]) for r in near_pairs(vocab, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == {(a, b, words[b]) for a, b in pairs}
        assert found(variants(vocab, block=block)) == slow_variants(words)


def test_ties_and_chains(spark):
    words = {"aaaaaa": 10_000, "aaaaab": 1_000, "aaaabb": 100, "aaabbb": 10, "cccccc": 5, "cccccd": 50, "cccccb": 50, "dddddd": 7}
    got = found(variants(spark.createDataFrame(sorted(words.items()), "word string, n bigint")))
    assert got == slow_variants(words)
    assert got["aaabbb"][4] == "aaaaaa" and got["cccccc"][2] == "cccccb" and got["dddddd"] == [7, 0, None, None, "dddddd"]


def test_awkward_rows(docs):
    rows = AWKWARD + [(11, "wording " * 5), (11, "wording " * 5), (None, "wordings " * 6)]
    assert found(spelling_variants(docs(rows))) == slow_variants(slow_words(rows))
    assert spelling_variants(docs(rows).limit(0)).count() == 0


def test_query(spark, docs, tmp_path):
    docs(corpus(9, 30), clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op11_spelling_variants(spark, str(tmp_path))
    assert set(out.columns) == {"word", "form", "root", "n", "n_near", "form_n"}
    assert found(out) == slow_variants(slow_words(corpus(9, 30)))
