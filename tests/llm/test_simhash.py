import random

import numpy as np
import xxhash

from meterwork.llm.components import components
from meterwork.llm.simhash import fingerprint, near_groups, one_of_each_group, tile_links
from tests.llm.conftest import AWKWARD


def slow_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def slow_components(prints, radius=4):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def near_texts(prose):
    rng, rows = random.Random(7), []
    for k in range(40):
        words = prose(k, rng.choice([2, 30, 300, 900])).split()
        for _ in range(rng.choice([1, 1, 2, 6])):
            if rng.random() < 0.7:
                words[rng.randrange(len(words))] = "changed"
            rows.append((len(rows) + 10, " ".join(words)))
    return rows + [(1, None), (2, ""), (3, "One"), (4, "oNE")]


def test_fingerprints_equal_the_plain_form(prose):
    for n in (0, 1, 3, 4, 5, 200):
        assert fingerprint(prose(n, n).encode()) == slow_print(prose(n, n))


def test_tiles_span_all_links():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 12, dtype=np.int64).view(np.uint64)
    near = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 63, 12).astype(np.uint64)) for _ in range(9)] + [base]))
    nodes, roots = tile_links(near, near, True, 4)
    assert len(nodes) < len(near) and all(r < n for n, r in zip(np.searchsorted(near, nodes), np.searchsorted(near, roots)))
    left, right = near[::2], near[1::2]
    a, b = tile_links(left, right, False, 4)
    for x, y in ((nodes, roots), (a, b)):
        assert len(x) == len(y)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(500, 540)] + [(9, 9), (-4, 12), (12, 3)]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[k] for k in range(500, 540)} | {got[5]} == {5}
    assert got[-4] == got[12] == got[3] == -4 and 9 not in got
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_groups_equal_brute_force(docs, prose):
    rows = near_texts(prose)
    prints = [slow_print(t or "") for _, t in rows]
    root = slow_components(prints)
    least = {}
    for (doc, _), r in zip(rows, root):
        least[r] = min(doc, least.get(r, doc))
    want = {doc: (p, least[r]) for (doc, _), p, r in zip(rows, prints, root)}
    for tile in (8192, 5):  # the second cuts bit counts into several tiles
        got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in near_groups(docs(rows), tile=tile).collect()}
        assert got == want
    kept = one_of_each_group(docs(rows))
    assert kept.columns == docs(rows).columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values()))


def test_awkward_rows(docs):
    got = near_groups(docs(AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    assert {r["component_id"] for r in got if r["fp"] == 0} == {1}
    assert {r["component_id"] for r in got if r["doc_id"] == 4} == {4} and sum(r["kept"] for r in got if r["doc_id"] == 4) == 1
    assert one_of_each_group(docs(AWKWARD)).count() == sum(r["kept"] for r in got)
    assert one_of_each_group(docs(AWKWARD).limit(0)).count() == 0
