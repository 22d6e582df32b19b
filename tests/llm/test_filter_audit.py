import random
import re
from collections import defaultdict
from itertools import permutations

import pytest

from meterwork.llm import filter_audit, queries
from meterwork.llm.filter_audit import audited, common, failed, gallop, postings, union_size, union_sizes
from tests.llm.conftest import AWKWARD

LABELS = "doc_id bigint, quality int, toxic int"


def slow_failed(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text))]


def slow_audit(rows, labels):
    """Filters applied one after the other to lists of rows."""
    first = {}
    for doc, text, *_ in rows:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    good, toxic = ({r[0] for r in labels if r[0] is not None and r[k] == 1} for k in (1, 2))
    parts = defaultdict(list)
    for doc, text, _, source in rows:
        fails = dict(zip("ABCDE", [*slow_failed(text or ""), doc is not None and doc > first[text or ""]]))
        parts[source or ""].append((doc, fails))
    out, removed_of = {}, defaultdict(int)
    for part, docs in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if d[1][f]], [d for d in left if not d[1][f]]
                removed_of[part, f] += len(gone)
                only = sum(d[1][f] and sum(d[1].values()) == 1 for d in docs)
                out[part, order, step] = [len(left), len(gone), sum(d[1][f] for d in docs) - len(gone), only, sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)]
    return {k: (*v, removed_of[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    rows = df.collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in rows}
    assert len(got) == len(rows)
    return got


def texts(prose, seed, n):
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = prose(rng.randrange(40), rng.choice([5, 49, 50, 51, 120])).split()
        if rng.random() < 0.3:
            words = words[:20] * 4
        if rng.random() < 0.3:
            words = [w.upper() if rng.random() < 0.3 else w for w in words]
        if rng.random() < 0.3:
            words[0] += rng.choice("#$%&*|")
        rows.append((i, " ".join(words), "en", rng.choice(["hot", "hot", "a", "é", None, ""])))
    return rows


def test_merges_equal_sets():
    rng = random.Random(8)
    for _ in range(300):
        lists = [sorted(rng.sample(range(rng.choice([5, 40, 400])), rng.randrange(0, 5)) if rng.random() < 0.5 else set(range(a := rng.randrange(300), a + rng.randrange(100))))
                 for _ in range(5)]
        sets = [set(x) for x in lists]
        assert union_size(lists) == len(set().union(*sets)) and common(lists[0], lists[1]) == sorted(sets[0] & sets[1])
        assert union_sizes(lists[:3]) == [len(set().union(*(sets[k] for k in range(3) if m >> k & 1))) for m in range(8)]
    rows = list(range(0, 1000, 3))
    assert all(rows[gallop(rows, at, to) :] == [r for r in rows if r >= to] for at in (0, 5) for to in (rows[at] + 1, 400, 401, 998, 5000))


def test_filters_of_a_text(prose):
    for _, text, *_ in texts(prose, 3, 60):
        assert failed(text.encode()) == slow_failed(text)
    for text in ("", " ", "A", "ÀÉ" * 30, "a " * 49, "a b " * 40_000, "\x0bA\x0c B", "|"):
        assert failed(text.encode()) == slow_failed(text)


@pytest.mark.parametrize("largest", [1, 10_000])  # groups of copies joined by shuffling, or broadcast
def test_every_order_equals_brute_force(docs, prose, spark, monkeypatch, largest):
    monkeypatch.setattr(filter_audit, "LARGEST", largest)
    rows, rng = texts(prose, 1, 250), random.Random(6)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 0, 1])) for i in range(-3, 250, 2)] + [(7, 0, 1), (7, 1, 0), (None, 1, 1)]
    want = slow_audit(rows, labels)
    said = spark.createDataFrame(labels, LABELS)
    assert found(audited(docs(rows), said)) == want
    assert found(audited(docs(rows).repartition(7), said, span=10)) == want


def test_lists_are_cut_by_range(docs, prose, spark):
    lists = postings(docs([(i, "same", "en", "hot") for i in range(3000)]).repartition(3), spark.createDataFrame([], LABELS), span=100).collect()
    assert sum(r["n"] for r in lists) == 3000 and max(len(r["A"]) for r in lists) <= 100 and sum(len(r["E"]) for r in lists) == 2999
    assert all(list(r["A"]) == sorted(r["A"]) for r in lists)


def test_awkward_rows(docs, spark):
    rows = [(r[0], r[1], "en", s) for r, s in zip(AWKWARD + AWKWARD, [None, "", "a"] * 9)]
    labels = [(4, 1, None), (None, 1, 1), (9, None, 1)]
    assert found(audited(docs(rows), spark.createDataFrame(labels, LABELS))) == slow_audit(rows, labels)
    assert audited(docs(rows).limit(0), spark.createDataFrame(labels, LABELS)).count() == 0


def test_query(spark, docs, prose, tmp_path):
    rows, labels = texts(prose, 2, 60), [(i, i % 2, i % 3 == 0) for i in range(40)]
    docs(rows, clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(a, b, int(c)) for a, b, c in labels], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert found(queries.op13_filter_audit(spark, str(tmp_path))) == slow_audit(rows, labels)
