"""The networks' scoring against plain loops: one document, one window, one step at a time."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import tiktoken
from tiktoken.load import load_tiktoken_bpe

from meterwork.llm import language, pii, queries, toxicity
from meterwork.llm.recurrent import Gru
from tests.llm.test_simhash import slow_components, slow_print




def lib_states(table, u, ids):
    return np.array([h[0].copy() for h in Gru.states(table, u, np.asarray(ids)[:, None])])


def cuts(n, size, overlap):
    """Windows as (start, end, first and last counted place)."""
    out, start = [], 0
    while n:
        end = min(n, start + size)
        out.append((start, end, start + overlap // 2 if start else 0, end - (overlap - overlap // 2) if end < n else n))
        if end == n:
            break
        start += size - overlap
    return out


def test_language_shares_equal_plain_loops(prose):
    texts = [prose(k, 40, a) for k in range(60) for a in ("abcdef", "uvwxyz")]
    net = language.train([t.encode() for t in texts], ["xx", "yy"] * 60, language.Fit(steps=15))
    for n in (1, 30, 70, 400):
        text = prose(n, n, "abcuvwxyz").encode()
        ids, total = list(text), np.zeros(len(net.languages))
        for start, end, low, high in cuts(len(ids), net.window, net.overlap):
            part = ids[start:end]
            ahead, behind = lib_states(net.tables[0], net.recurrent[0], part), lib_states(net.tables[1], net.recurrent[1], part[::-1])[::-1]
            logits = ahead @ net.heads[0] + behind @ net.heads[1] + net.bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            total += p[low - start : high - start].sum(0)
        assert np.allclose(net.documents([text])[0], total / len(ids), atol=1e-4)


def test_toxic_windows_equal_plain_loops(prose):
    rng = random.Random(3)
    texts = [prose(k, 60) + (" vilest scum" if k % 3 == 0 else "") for k in range(90)]
    net = toxicity.train([t.encode() for t in texts], [int(k % 3 == 0) for k in range(90)], toxicity.Fit(steps=30))
    w, hid = net.weights, net.fit.hidden
    for n in (1, 20, 150, 900):
        words = prose(n, n).split()
        words.insert(rng.randrange(len(words) + 1), "scum")
        text = " ".join(words).encode()
        split, best = toxicity.words_of(text), -np.inf
        vectors = np.array([net.word_inputs([x])[0][0] for x in split])
        for start, end, _, _ in cuts(len(split), net.fit.window, net.fit.overlap):
            part = vectors[start:end]
            tables = [np.concatenate((part @ w[f"in_{s}"] + w[f"b_{s}"], Gru.hold_row(hid)[None])) for s in "fb"]
            order = list(range(len(part)))
            states = np.concatenate((lib_states(tables[0], w["u_f"], order), lib_states(tables[1], w["u_b"], order[::-1])[::-1]), 1)
            pull = states @ w["attention"]
            share = np.exp(pull - pull.max())
            best = max(best, float((share * (states @ w["value"])).sum() / share.sum() + w["bias"][0]))
        assert abs(toxicity.Scorer(net).documents([text])[0] - 1 / (1 + np.exp(-best))) < 1e-4


def test_windows_of_tags_are_reconciled_by_place():
    """Every place takes its tag from the window in whose middle it lies."""
    text = ("call 1234 or +1 (743) 555-3824 now, " * 60)[:1500]
    net = pii.train([text[i : i + 150] for i in range(0, 1500, 150)] * 4, pii.Fit(steps=20, warm_up=15))
    want = np.zeros(len(text), np.int8)
    for start, end, low, high in cuts(len(text), net.window, net.overlap):
        tags = net.viterbi(pii.symbols(text[start:end])[:, None].astype(np.int64))[:, 0]
        want[low:high] = tags[low - start : high - start]
    assert np.array_equal(net.tagged([text])[0], want)


def unseen(kind, piece, rng):
    """Ways of writing that training does not use."""
    d = "".join(c for c in piece if c.isdigit())
    if kind == 0:
        user, host = piece.split("@")
        return rng.choice([f"{user} [at] {host}", f"{user}(at){host}"])
    if kind == 1:
        return piece.replace(".", rng.choice([" .", " [.] ", ".  "]))
    if kind == 2:
        return rng.choice([" - ", " / ", ". "]).join(d[i : i + 4] for i in range(0, len(d), 4))
    d = d[-10:]
    return rng.choice([f"{d[:3]}/{d[3:6]}-{d[6:]}", f"{d[:3]} ({d[3:6]}) {d[6:]}", f"({d[:3]}) {d[3:6]}/{d[6:8]}-{d[8:]}"])


def planted(prose, i, rng):
    words = prose(i, 50).split()
    number = "".join(rng.choice("123456789") for _ in range(15))
    card = next(number + str(k) for k in range(10) if pii.luhn(number + str(k)))
    kind = i % 4
    datum = [f"{words[0].strip('.')}.{i}@mail{i % 9}.example.com", f"{1 + i % 250}.{20 + i % 90}.{i % 199}.7", card, f"+1 ({200 + i % 700}) 555-{1000 + i % 9000}"][kind]
    return kind, words[:25], datum, words[25:]


def test_added_spans_on_writings_not_trained(prose):
    rng = random.Random(11)
    taught = [" ".join([*a, x, *b]) for _, a, x, b in (planted(prose, i, rng) for i in range(480))]
    net = pii.train(taught + [prose(10_000 + i, 40) + f" In {1900 + i} we sold {i * 37} of {i}." for i in range(160)])
    hit, seen = [0] * 4, [0] * 4
    for i in range(1000, 1240):
        kind, before, datum, after = planted(prose, i, rng)
        new, start = unseen(kind, datum, rng), len(" ".join(before)) + 1
        text = " ".join([*before, new, *after])
        base = pii.base_spans(text)
        if any(a < start + len(new) and start < b for _, a, b in base):
            continue
        seen[kind] += 1
        hit[kind] += (kind, start, start + len(new)) in net.added(text, net.tagged([text])[0], base)
    print("recall by kind", dict(zip(pii.KINDS, zip(hit, seen))))
    assert min(seen) >= 20 and all(h >= 0.8 * n for h, n in zip(hit, seen)), (hit, seen)
    clean = [prose(20_000 + i, 60) + f" Since {1950 + i}, {i}.5 percent of {i * 1000} in 10.{i % 90} parts." for i in range(200)]
    added = sum(len(net.added(t, tags, pii.base_spans(t))) for t, tags in zip(clean, net.tagged(clean)))
    assert added <= 2, added


def test_queries_of_scores_and_digests(spark, docs, prose, tmp_path):
    """What the queries make of the operators: folds, thresholds, hex digits, digests."""
    rng, rows, labels = random.Random(2), [], []
    for i in range(120):
        words = prose(i, rng.choice([3, 60, 90]), "abcdef" if i % 2 else "uvwxyz").split()
        if i % 4 == 0:
            words[1:1] = ["vilest", "scum"]
        if i % 3 == 0:
            words = ["###"] + words[:4] * 5
        rows.append((i, " ".join(words), "xx" if i % 2 else "yy"))
        labels.append((i, int(i % 3 != 0), int(i % 4 == 0)))
    rows += [(900, None, "xx"), (901, "", "yy")]
    docs(rows, clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf = str(tmp_path)
    fold = lambda i, n, k: zlib.crc32(str(i).encode()) % n == k
    for query, n, k, cut in ((queries.op5_rule_ensemble, 4, 2, 0.7), (queries.op6_attention_gru, 5, 0, 0.5)):
        got = {r["doc_id"]: r for r in query(spark, sf).collect()}
        assert len(got) == len(rows) and all(r["held_out"] == fold(i, n, k) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut) for i, r in got.items())
    told = {r["doc_id"]: r for r in queries.op4_byte_gru(spark, sf).collect()}
    assert all(r["held_out"] == fold(i, 3, 1) and r["lang_pred"] in ("xx", "yy", "und") and 0 <= r["score"] <= 1 for i, r in told.items())
    assert told[900]["lang_pred"] == told[901]["lang_pred"] == "und" and sum(told[i]["lang_pred"] == rows[i][2] for i in range(120)) >= 100
    ranks = load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in queries.op3_byte_bpe(spark, sf).collect():
        text = next(t for i, t, _ in rows if i == r["doc_id"]) or ""
        ids = coder.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(text.encode()))
    prints = [slow_print(t or "") for _, t, _ in rows]
    root = slow_components(prints)
    least = {r: min(rows[j][0] for j in range(len(rows)) if root[j] == r) for r in set(root)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op8_simhash_tiles(spark, sf).collect()}
    assert got == {i: (f"{p:016x}", least[r]) for (i, _, _), p, r in zip(rows, prints, root)}
    for r in queries.op10_pii_lstm(spark, sf).collect():
        base = pii.base_spans(next(t for i, t, _ in rows if i == r["doc_id"]) or "")
        assert r["base_sha256"] == sha(pii.joined(base).encode()) and [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == j for s in base) for j in range(4)]
