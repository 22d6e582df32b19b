import random

from pyspark.sql import functions as F

from meterwork.llm.exact import Polynomial, chunked_hashes, duplicates, fingerprint_parts, same_text, without_duplicates
from tests.llm.conftest import AWKWARD


def slow(text, poly):
    out = []
    for base, prime in zip(poly.bases, poly.primes):
        h = 0
        for b in text:
            h = (h * base + b) % prime
        out.append(h)
    return poly.pack(out)


def test_chunks_combine_to_the_plain_polynomial():
    rng, poly = random.Random(1), Polynomial()
    texts = [rng.randbytes(n) for n in (0, 1, 5, 4095, 4096, 4097, 9000, 20_000)]
    assert chunked_hashes(texts, poly, poly.powers()) == [slow(t, poly) for t in texts]
    for a, b in zip(texts, texts[1:]):
        assert poly.combined(slow(a, poly), slow(b, poly), len(b)) == slow(a + b, poly)


def test_parts_of_a_document_hash_apart(spark):
    rng, poly = random.Random(2), Polynomial()
    whole = {k: "".join(rng.choice("abcé \n") for _ in range(rng.randrange(0, 9000))) for k in range(5)}
    cuts = [(k, i, t[i * 1000 : i * 1000 + 1000]) for k, t in whole.items() for i in range(-(-max(1, len(t)) // 1000))]
    got = {r["k"]: (r["fp"], r["n_bytes"]) for r in fingerprint_parts(spark.createDataFrame(cuts, "k int, i int, text string"), "k", "i").collect()}
    assert got == {k: (slow(t.encode(), poly), len(t.encode())) for k, t in whole.items()}


def test_comparison_reads_on_to_the_end():
    assert same_text(b"a" * 200_000, b"a" * 200_000) and not same_text(b"a" * 200_000, b"a" * 199_999 + b"b") and not same_text(b"a", b"")


def brute(rows):
    groups = {}
    for i, (doc, text) in enumerate(rows):
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        groups.setdefault(key, []).append((doc is not None, doc if doc is not None else 0, i))
    out = []
    for g in groups.values():
        keep = max(g)
        out += [(rows[i][0], rows[keep[2]][0], len(g)) for _, _, i in g]
    return sorted(out, key=repr), len(groups)


def check(df, rows, poly):
    got = duplicates(df, poly=poly).collect()
    want, groups = brute(rows)
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"]) for r in got], key=repr) == want
    assert sum(r["kept"] for r in got) == groups
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_groups_equal_brute_force(docs):
    rng = random.Random(4)
    rows = [(i, rng.choice(["Same TEXT", "same text", "Ä", "ä", "other", ""]) + str(rng.randrange(3)) if rng.random() < 0.8 else rng.choice([None, ""])) for i in range(300)]
    rows += [(1000 + i, "Hot copy") for i in range(500)]
    check(docs(rows), rows, Polynomial())


def test_colliding_fingerprints_are_told_apart(docs):
    rng = random.Random(5)
    rows = [(i, f"text {rng.randrange(10)}") for i in range(80)]
    check(docs(rows), rows, Polynomial(primes=(2, 2), bases=(1, 1)))


def test_awkward_rows(docs):
    check(docs(AWKWARD), AWKWARD, Polynomial())
    kept = without_duplicates(docs(AWKWARD))
    assert kept.columns == docs(AWKWARD).columns and kept.count() == brute(AWKWARD)[1]
    assert sorted(r["text"] or "" for r in kept.select("text").collect()) == sorted({"", " \n\t", "Word", "x" * 300_000, AWKWARD[8][1], AWKWARD[9][1]} - set())
    assert without_duplicates(docs(AWKWARD).limit(0)).count() == 0


def test_no_repeated_id_leaves_the_plain_join(docs):
    rows = [(1, "a"), (2, "A"), (3, "b")]
    assert sorted(r["doc_id"] for r in without_duplicates(docs(rows)).filter(F.lit(True)).collect()) == [2, 3]


def test_repeated_leaders_are_dealt_once(docs, spark):
    """Thousands of rows with one null id and one text: the text goes to the comparison a bounded number of times."""
    from meterwork.llm import exact as x

    rows = docs([(None, "one text", "en", "s")] * 3000 + [(5, "ONE text", "en", "s")] * 2, clash=False)
    got = x.duplicates(rows).collect()
    assert len(got) == 3002 and {(r["keep_id"], r["group_size"]) for r in got} == {(5, 3002)} and sum(r["kept"] for r in got) == 1
    ids = rows.selectExpr("doc_id AS id", "text")
    prints = x.fingerprints(ids, "id", "text", keep_text=True).select("id", "mark", "fp", "n_bytes", "text")
    groups = prints.groupBy("fp", "n_bytes").agg({"*": "count"}).withColumnRenamed("count(1)", "n").selectExpr("fp", "n_bytes", "named_struct('id', 5L, 'mark', md5('ONE text')) AS lead", "n")
    assert x._leaders(ids, groups, True).count() == 1
    assert x._mismatches(prints, x._leaders(ids, groups, True), groups, True).count() == 0


def test_stage_keeps_other_columns(docs):
    df = docs([(1, "a b"), (2, "A B"), (None, "a b"), (None, "x"), (None, "x"), (3, None), (3, ""), (4, "y")])
    before = [tuple(r) for r in df.collect()]
    out = without_duplicates(df)
    kept = [tuple(r) for r in out.collect()]
    assert out.columns == df.columns and all(r in before for r in kept) and sorted(str(r[1] or "").lower() for r in kept) == ["", "a b", "x", "y"]
