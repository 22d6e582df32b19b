import numpy as np
from pyspark.sql import functions as F

from meterwork.llm.rule_ensemble import STATISTICS, Fit, accepted, fit_ensemble, learn, scored, statistics
from tests.llm.conftest import AWKWARD


def labelled(docs, prose, spark, n=240):
    rows, marks = [], []
    for i in range(n):
        good = i % 3 > 0
        text = prose(i, 40 + i % 50)
        rows.append((i, text if good else (text.upper().replace(" ", "!! ") if i % 2 else " ".join(w + "$$$" for w in text.split()))))
        marks.append((i, int(good)))
    return docs(rows), spark.createDataFrame(marks, "doc_id bigint, quality int")


def test_statistics_of_small_texts():
    got = dict(zip(STATISTICS, statistics("Ab ab ab\nÉ9 $!.".encode())))
    assert got["words"] == 5 and got["lines"] == 2 and got["repeated_next"] == 1 / 5 and got["distinct_words"] == 4 / 5
    assert got["share_upper"] == 2 / 12 and statistics(b" \n") == (0.0,) * len(STATISTICS)


def test_columns_score_like_numpy(docs, prose, spark):
    df, labels = labelled(docs, prose, spark)
    model = learn(df, labels, "quality", F.col("doc_id") % 4 != 2, Fit(rows=200))
    assert model.rules and all(1 <= len(r.tests) <= 3 for _, r in model.rules)
    rows = scored(df, model, score_column="p").select("doc_id", "text", "p").collect()
    want = model.probability(np.array([statistics(r["text"].encode()) for r in rows]))
    assert np.allclose([r["p"] for r in rows], want)
    right = [(r["p"] >= 0.7) == (r["doc_id"] % 3 > 0) for r in rows if r["doc_id"] % 4 == 2]
    assert sum(right) >= 0.95 * len(right)
    kept = accepted(df, model)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in rows if r["p"] >= 0.7)


def test_the_lasso_keeps_few_rules():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (800, len(STATISTICS)))
    y = ((x[:, 4] > 0.3) & (x[:, 7] < 0.5)).astype(float)
    loose, tight = fit_ensemble(x, y, Fit(penalty=1e-4)), fit_ensemble(x, y, Fit(penalty=1e-2))
    assert len(tight.rules) < len(loose.rules) and ((loose.probability(x) > 0.5) == y).mean() > 0.97
    used = {name for _, r in tight.rules for name, _, _ in r.tests}
    assert {STATISTICS[4], STATISTICS[7]} <= used


def test_awkward_rows_and_empty_labels(docs, prose, spark):
    df, labels = labelled(docs, prose, spark, 60)
    model = learn(df, labels.union(spark.createDataFrame([(None, 1), (5, None)], labels.schema)), "quality", F.lit(True))
    got = scored(docs(AWKWARD), model, score_column="p").collect()
    assert len(got) == len(AWKWARD) and all(0 <= r["p"] <= 1 for r in got)
    blank = learn(df, labels.limit(0), "quality", F.lit(True))
    assert {r["p"] for r in scored(docs(AWKWARD), blank, score_column="p").collect()} == {0.5}
    assert scored(docs(AWKWARD).limit(0), model, score_column="p").count() == 0
