import random

import pytest

#: Names that operators use inside.
INTERNAL = ("_row", "_id", "_doc", "_m", "_mark", "_again", "_stay", "_size", "_draw", "_odds", "_weight", "_copies", "_copy", "_s", "_source", "_in", "_t", "_stats",
            "_score", "_nth", "_at", "_stretch", "_local", "_told", "n_tokens_", "lead", "salt", "leads", "_fp", "_lead", "_n", "_e", "_h", "_hot", "_c", "E", "part", "block")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    """(doc_id, text[, lang, source]) rows as a documents table with a few columns that clash with internal names."""

    def make(rows, clash=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if clash:
            for name in (*INTERNAL, "fp", "mark", "kept", "n", "score", "size", "row", "id", "_text", "words", "keep", "root", "q", "target"):
                df = df.withColumn(name, df["doc_id"])
        return df

    return make


@pytest.fixture(scope="session")
def prose():
    """Random prose of ``n`` words."""

    def make(seed, n, vocabulary="abcdefghij"):
        rng = random.Random(seed)
        words = ["".join(rng.choice(vocabulary) for _ in range(rng.randrange(2, 8))) for _ in range(n)]
        return " ".join(w + "." if i % 9 == 8 else w for i, w in enumerate(words)) + "."

    return make


AWKWARD = [(1, None), (2, ""), (3, " \n\t"), (4, "Word"), (4, "Word"), (None, "word"), (None, None), (7, "x" * 300_000), (8, "é ß 漢字 🙂 " * 50), (9, "a b c " * 40_000)]
