import random

from meterwork.llm.mixing import Mix, mix_documents, mix_sizes
from tests.llm.conftest import AWKWARD


def brute_targets(sizes, weights=(5, 2, 1)):
    """Share by weight, stop at three times the size, share the excess anew until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not above:
            return target | {s: level * weight[s] for s in free}
        for s in above:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= above
    return target


def table(seed, sources, n):
    rng = random.Random(seed)
    return [(i, "w " * rng.randrange(0, 40) if rng.random() < 0.95 else None, "en", rng.choice(sources)) for i in range(n)]


def check(got, rows):
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want, by, largest = brute_targets(sizes), {r[0]: r for r in rows}, {}
    taken = {}
    for r in got:
        source, size = by[r["doc_id"]][3], len((by[r["doc_id"]][1] or "").split())
        assert (r["size"], r["source_size"]) == (size, sizes[source])
        assert abs(r["target"] - want[source]) <= 1e-9 * max(1.0, want[source])
        assert r["taken"] <= 3 * size and r["taken"] == size * r["copies"] * (size > 0)
        taken[source] = taken.get(source, 0) + r["taken"]
        largest[source] = max(largest.get(source, 0), size)
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1e-6


def test_targets_and_sample(docs):
    for seed, sources in ((1, ["a", "b", "c", "d", None]), (2, ["a"] * 20 + ["b", "é", "z"]), (3, ["only"])):
        rows = table(seed, sources, 400)
        got = mix_sizes(docs(rows)).collect()
        check(got, rows)
        assert sorted(got) == sorted(mix_sizes(docs(rows).repartition(7)).collect())


def test_odds_weights_make_documents_likelier(docs):
    rows = [(i, "w " * 10, "en", "ab"[i % 2]) for i in range(2000)]
    df = docs(rows, clash=False).selectExpr("*", "CASE WHEN doc_id % 4 < 2 THEN 5.0 ELSE 1.0 END AS liking")
    got = mix_sizes(df, Mix(weights=(1, 9), odds_weight="liking")).collect()
    low = [r for r in got if r["doc_id"] % 2 == 0]  # source a is cut to a fifth
    share = [sum(r["copies"] for r in low if (r["doc_id"] % 4 < 2) == liked) for liked in (True, False)]
    assert abs(sum(share) - 200) <= 1 and share[0] > 2 * share[1]


def test_documents_are_repeated(docs):
    rows = table(5, ["a", "b", "c"], 200)
    df = docs(rows)
    copies = {r["doc_id"]: r["copies"] for r in mix_sizes(df).collect()}
    out = mix_documents(df)
    assert out.columns == df.columns
    counted = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counted == {k: v for k, v in copies.items() if v}


def test_awkward_rows(docs):
    got = mix_sizes(docs(AWKWARD)).collect()
    assert len(got) == len(AWKWARD) and all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mix_sizes(docs(AWKWARD).limit(0)).count() == 0 and mix_documents(docs(AWKWARD).limit(0)).count() == 0
    assert mix_sizes(docs([(1, None), (2, "")])).agg({"taken": "sum"}).first()[0] == 0


def test_long_documents_are_likelier_by_their_odds(docs):
    """Pareto order sampling: inclusion follows the expected copies, which are twice as many for long documents."""
    rows = [(i, "w " * (120 if i % 4 < 2 else 30), "en", "ab"[i % 2]) for i in range(6000)]
    got = mix_sizes(docs(rows, clash=False), Mix(weights=(1, 30))).collect()
    low = [r for r in got if r["doc_id"] % 2 == 0]
    p = {long: sum(r["copies"] for r in low if (r["size"] > 100) == long) / sum((r["size"] > 100) == long for r in low) for long in (True, False)}
    level = low[0]["target"] / (1500 * 120 * 2 + 1500 * 30)
    assert 0 < level < 0.5 and abs(p[True] - 2 * level) < 0.05 and abs(p[False] - level) < 0.05
    assert abs(sum(r["taken"] for r in low) - low[0]["target"]) <= 60


def test_repeated_rows_are_told_apart(docs):
    rows = [(None, "same words here", "en", s) for s in ("a", "b") for _ in range(500)]
    got = mix_sizes(docs(rows)).collect()
    for source in ("a", "b"):
        mine = [r for r in got if abs(r["target"] - (3000 * 5 / 7 if source == "a" else 3000 * 2 / 7)) < 1]
        assert len(mine) == 500 and abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 1.5
    out = mix_documents(docs(rows)).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in out} == {s: round(sum(r["copies"] for r in got if abs(r["target"] - 3000 * w / 7) < 1)) for s, w in (("a", 5), ("b", 2))}


def test_other_columns_come_through(docs):
    df = docs(table(7, ["a", "b"], 120))
    before = {r["doc_id"]: r for r in df.collect()}
    out = mix_documents(df)
    assert out.columns == df.columns and all(r == before[r["doc_id"]] for r in out.collect())
