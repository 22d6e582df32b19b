import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from meterwork.llm import byte_bpe, mixing, queries, rule_ensemble
from tests.llm.test_rule_ensemble import labelled
from tests.llm.test_simhash import slow_components, slow_print


def fixture(spark, docs, prose, folder):
    df, labels = labelled(docs, prose, spark, 240)
    rows = [(r["doc_id"], r["text"], "en", f"s{r['doc_id'] % 4}") for r in df.select("doc_id", "text").collect()]
    good = [r for r in rows if r[0] % 3 > 0]
    rows += [(1000 + k, t.replace("a", "A"), "en", "s1") for k, (_, t, _, _) in enumerate(good[:30])]
    long = prose(77, 900)
    rows += [(2000, long, "en", "s2"), (2001, long.replace(" a", " b", 1) + " end", "en", None), (None, None, None, None), (3000, "", "en", "s0"), (3000, "", "en", "s0")]
    docs(rows, clash=False).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages_equal_brute_force(spark, docs, prose, tmp_path):
    sf = str(tmp_path)
    rows = fixture(spark, docs, prose, sf)
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_copies", "near_copies", "mix", "tokens"]
    held, now = {}, documents
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, sf).write.parquet(f"{sf}/out/{name}")
        now = spark.read.parquet(f"{sf}/out/{name}")
        held[name] = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in now.select("doc_id", "text", "lang", "source").collect()] if name != "tokens" else now.collect()
        assert name == "tokens" or now.columns == documents.columns

    model = queries.quality_model(spark, sf)
    score = model.probability(np.array([rule_ensemble.statistics((t or "").encode()) for _, t, _, _ in rows]))
    assert Counter(held["quality"]) == Counter(r for r, p in zip(rows, score) if p >= 0.7)
    assert {r[0] for r in rows if r[0] and r[0] < 240 and r[0] % 3 > 0} <= {r[0] for r in held["quality"]}

    groups = {}
    for r in held["quality"]:
        groups.setdefault((r[1] or "").lower(), []).append(r)
    want = Counter(max(g, key=lambda r: (r[0] is not None, r[0] or 0)) for g in groups.values())
    assert Counter(held["exact_copies"]) == want

    ordered = sorted(want, key=lambda r: (r[0] is None, r[0] or 0))
    root, first = slow_components([slow_print(r[1] or "") for r in ordered]), {}
    for r, k in zip(ordered, root):
        first.setdefault(k, r)
    assert Counter(held["near_copies"]) == Counter(first.values())

    sizes = {(r["doc_id"]): r for r in mixing.mix_sizes(spark.read.parquet(f"{sf}/out/near_copies")).collect()}
    assert Counter(held["mix"]) == Counter({r: sizes[r[0]]["copies"] for r in first.values() if sizes[r[0]]["copies"]})

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digests = Counter()
    for doc, text, _, source in held["mix"]:
        ids = library.encode_ordinary(text)
        digests[doc, source, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["source"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in held["tokens"]) == digests
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf).collect())) == Counter(map(tuple, held["tokens"]))


def test_empty_tables(spark, docs, prose, tmp_path):
    docs([], clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns_of_any_name(spark, docs, prose, tmp_path):
    """Every stage but the last hands on all columns of its documents, also those named like its own helpers."""
    rows = fixture(spark, docs, prose, str(tmp_path))
    now = docs(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/clash/{name}")
        after = spark.read.parquet(f"{tmp_path}/clash/{name}")
        assert after.columns == now.columns
        own = [c for c in after.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
        assert len(own) > 40 and after.count() > 0 and all(r[c] == r["doc_id"] for r in after.collect() for c in own)
        now = after
    assert byte_bpe.round_trip(now, queries.tokenizer()).count() == now.count()
