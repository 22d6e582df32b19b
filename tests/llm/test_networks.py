import gc
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterwork.llm import language, pii, recurrent, toxicity
from tests.llm.conftest import AWKWARD


@pytest.mark.parametrize("cell", [recurrent.Gru, recurrent.Lstm])
def test_gradients_and_lean_states(cell, monkeypatch):
    monkeypatch.setattr(recurrent, "LEAK", 0.0)
    assert max(recurrent.gradient_gap(cell, s) for s in range(4)) < 1e-3
    net = recurrent.Bidirectional(cell, 5, 4, np.random.default_rng(0))
    ids = np.array([[0, 1], [2, 5], [4, 5]])  # 5 is padding
    want, _ = cell.train(net.weights["table_f"][ids], net.weights["u_f"])
    got = np.stack([h.copy() for h in cell.states(net.weights["table_f"], net.weights["u_f"], ids)])
    assert np.allclose(got, want, atol=1e-6)
    assert np.allclose(got[0, 1], got[2, 1]) or cell is recurrent.Lstm  # padding holds a GRU's state


def test_windows_cover_every_position():
    doc, start, size = recurrent.windows(np.array([0, 1, 10, 11, 25]), 10, 4)
    for k, n in enumerate([0, 1, 10, 11, 25]):
        held = set()
        for s, z in zip(start[doc == k], size[doc == k]):
            held |= set(range(s, s + z))
        assert held == set(range(n))


LETTERS = {"xx": "abcdef", "yy": "uvwxyz", "zz": "éüñçß"}


def tongues(prose, n=150):
    return [(i, prose(i, 30, list(LETTERS.values())[i % 3]), list(LETTERS)[i % 3]) for i in range(n)]


def test_languages_held_out_and_awkward(docs, prose):
    df = docs(tongues(prose) + [(900, "text", None), (901, None, "xx")])
    net = language.learn(df, F.col("doc_id") % 3 < 2, language.Fit(steps=60, per_language=40))
    assert net.languages == ("xx", "yy") or set(net.languages) == set(LETTERS)
    net = language.learn(df, F.col("doc_id") % 5 != 1, language.Fit(steps=60, per_language=40))
    got = {r["doc_id"]: r for r in language.predicted(docs(tongues(prose)), net).collect()}
    held = [i for i in range(150) if i % 5 == 1]
    assert sum(got[i]["lang_pred"] == list(LETTERS)[i % 3] for i in held) >= 0.9 * len(held)
    rows = language.predicted(docs([*AWKWARD, (50, "123 !?")]), net).collect()
    assert len(rows) == len(AWKWARD) + 1 and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3, 50)} == {"und"} and all(r["lang_pred"] != "und" for r in rows if r["doc_id"] == 4)
    assert language.predicted(df.limit(0), net).count() == 0
    blank = language.learn(df.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in language.predicted(docs(AWKWARD), blank).collect()} == {"und"}


def test_pooled_shares_do_not_depend_on_batches(prose):
    net = language.train([t.encode() for _, t, _ in tongues(prose)], [x for _, _, x in tongues(prose)], language.Fit(steps=20))
    texts = [prose(k, n).encode() for k, n in enumerate((3, 40, 400, 2000))]
    together, apart = net.documents(texts), np.concatenate([net.documents([t]) for t in texts])
    assert np.allclose(together, apart, atol=1e-5) and np.allclose(together.sum(1), 1, atol=1e-4)


def rude(prose, n=240):
    rows = []
    for i in range(n):
        words = prose(i, 120 + i % 200).split()
        if i % 4 == 0:
            for _ in range(4):
                words[random.Random(i + _).randrange(len(words))] = random.Random(i * 7 + _).choice(["zounds", "knavexx", "knaveyy", "villain"])
        rows.append((i, " ".join(words)))
    return rows


def test_toxic_words_and_beginnings(docs, prose, spark):
    rows = rude(prose)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    net = toxicity.learn(docs(rows), labels, "toxic", F.col("doc_id") % 5 != 0, toxicity.Fit(steps=120))
    extra = [(1000, prose(1, 4000) + " zounds villain " + prose(2, 3000)), (1001, prose(3, 6000))]
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs(rows + extra), net).collect()}
    held = [i for i, _ in rows if i % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert got[1000] >= 0.5 > got[1001]
    again = toxicity.scored(docs(AWKWARD), net).collect()
    assert len(again) == len(AWKWARD) and all(r["score"] == 0 for r in again if r["doc_id"] in (1, 2, 3))
    assert toxicity.scored(docs(AWKWARD).limit(0), net).count() == 0
    blank = toxicity.learn(docs(rows), labels.limit(0), "toxic", F.lit(True))
    assert max(r["score"] for r in toxicity.scored(docs(rows), blank).collect()) < 0.5


def test_long_units_are_read_whole(docs, prose):
    unit = bytes(random.Random(1).randrange(97, 123) for _ in range(1000))
    for n in (0, 1, 63, 64, 65, 66, 72, 73, 1000):
        got = toxicity.words_of(unit[:n])
        assert got == [unit[:n]][:n] if n <= 64 else all(any(unit[i : min(i + 8, n)] in x for x in got) for i in range(n)) and max(map(len, got)) <= 64
    assert toxicity.words_of(b"Ab, (cd) -- " + b"x" * 64) == [b"ab", b"cd", b"", b"x" * 64]
    # Texts of one unit each with toxic words behind byte 64 only.
    rude_words, rows = ("zounds", "knavexx", "knaveyy", "villain"), []
    for i, text in rude(prose):
        words = [w for w in text.split() if w not in rude_words]
        for w in text.split():
            if w in rude_words:
                words.insert(random.Random(i).randrange(20, len(words)), w)
        rows.append((i, ["", "_", "\u00a0", "\u3000"][i % 7 % 4].join(words)))
        assert len(rows[-1][1].encode().split()) == 1 and not any(w in rows[-1][1][:64] for w in rude_words)
    for taught, least in ((rows, 1.0), (rude(prose), 0.75)):
        some = [(t.encode(), int(i % 4 == 0)) for i, t in taught if i % 5]
        net = toxicity.train([t for t, _ in some], [y for _, y in some], toxicity.Fit(steps=120))
        got = {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.scored(docs([x for x in rows if x[0] % 5 == 0]), net).collect()}
        assert not any(hit for i, hit in got.items() if i % 4)
        assert sum(hit for i, hit in got.items() if i % 4 == 0) >= least * sum(i % 4 == 0 for i in got)


PLANTED = "Write to Ann.Lee+x@mail.example.co.uk or call +1 (743) 555-3824, host 10.20.30.255, card 4785 3805 9239 1139."


def brute_base(text):
    import re

    found = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    found += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15]
    return sorted(found, key=lambda s: (s[1], s[0]))


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(5)
    assert [pii.KINDS[k] for k, _, _ in pii.base_spans(PLANTED)] == ["email", "phone", "ip", "card"]
    for _ in range(4000):
        text = "".join(rng.choice(["@", ".", "a", "b-", "1", "25", "300", " ", "+", "(", ")", "-", "é", "4785380592391139", "x@y.z", "1.2.3.4", "%"]) for _ in range(rng.randrange(0, 16)))
        assert pii.base_spans(text) == brute_base(text), text
    assert pii.base_spans("a" * 200_000 + "@") == [] and pii.base_spans("1" * 200_000) == []


def test_addresses_with_thousands_of_leading_zeros():
    zeros = "0" * 5000
    assert pii.base_spans(f"1.2.3.{zeros}") == [(1, 0, 5006)] == pii.base_spans(f"1.2.3.{zeros[:-3]}255") and pii.base_spans(f"1.2.3.{zeros}256") == []


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(4)
    moves = np.where(np.eye(5, dtype=bool) | (np.arange(5)[:, None] == 0) | (np.arange(5) == 0), rng.normal(0, 1, (5, 5)), -1e4).astype(np.float32)
    net = pii.train([PLANTED] * 4, pii.Fit(steps=3, warm_up=2))
    net = pii.Network(net.tables, net.recurrent, tuple(3 * h for h in net.heads), net.bias, moves)
    ids = rng.integers(0, 128, (5, 6))
    em = recurrent.emissions(recurrent.Lstm, net.tables, net.recurrent, net.heads, net.bias, ids)
    from itertools import product

    def value(path, b):
        return sum(em[t, b, y] for t, y in enumerate(path)) + sum(moves[x, y] for x, y in zip(path, path[1:]))

    for b in range(6):
        best = max(product(range(5), repeat=5), key=lambda p: value(p, b))
        assert abs(value(net.viterbi(ids)[:, b].tolist(), b) - value(best, b)) < 1e-3


def test_personal_data_found_and_added(docs, prose):
    rng = random.Random(8)
    rows = []
    for i in range(160):
        words = prose(i, 60).split()
        number = "".join(rng.choice("0123456789") for _ in range(15))
        card = next(number + str(k) for k in range(10) if pii.luhn(number + str(k)))
        words[rng.randrange(60)] = [f"{words[0].strip('.')}.{i}@mail{i % 9}.example.com", f"+1 ({200 + i}) 555-{1000 + i}", f"{i}.20.{i}.7", card, "plain"][i % 5]
        rows.append((i, " ".join(words)))
    df = docs(rows)
    net = pii.learn(df, pii.Fit(steps=160, warm_up=110))
    got = {r["doc_id"]: r for r in pii.found(df, net).collect()}
    for i, text in rows:
        base = pii.base_spans(text)
        assert got[i]["spans"] == pii.joined(base) or set(pii.joined(base).split(",")) <= set(got[i]["spans"].split(",")) | {""}
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == j for s in base) for j in range(4)]
    tags = net.tagged([t for _, t in rows])
    hits = [(g[a:b] == k + 1).mean() > 0.8 for (_, t), g in zip(rows, tags) for k, a, b in pii.base_spans(t)]
    assert sum(hits) >= 0.8 * len(hits) and sum(got[i]["n_added"] for i, _ in rows if i % 5 == 4) == 0
    awkward = pii.found(docs(AWKWARD), net).collect()
    assert len(awkward) == len(AWKWARD) and all(r["spans"] == "" for r in awkward if r["doc_id"] in (1, 2, 3))
    assert pii.found(docs(AWKWARD).limit(0), net).count() == 0
    blank = pii.learn(df.limit(0))
    assert sum(r["n_added"] for r in pii.found(df, blank).collect()) == 0


def test_scoring_new_words_leaves_nothing_in_the_process(prose):
    """Python workers are used again, so what a scorer knew of words must go with it, and words enter it a block at a time."""
    net = toxicity.train([prose(i, 20).encode() for i in range(12)], [i % 2 for i in range(12)], toxicity.Fit(steps=2))
    words = [b"%s%x" % (bytes([97 + i % 23]) * (i % 7), i) for i in range(30_000)]
    scorer = toxicity.Scorer(net)
    tracemalloc.start()
    try:
        scorer.documents([b" ".join(words)])
        peak = tracemalloc.get_traced_memory()[1]
        del scorer
        gc.collect()
        left = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert left < 1_000_000 and peak < 30_000_000
