import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from meterwork.llm import byte_bpe
from tests.llm.conftest import AWKWARD

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    return byte_bpe.Tokenizer.of(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def texts():
    rng = random.Random(9)
    points = [(32, 127), (0, 14), (28, 33), (128, 0x240), (0x240, 0x3000), (0x4E00, 0x5000), (0x1F300, 0x1F600)]
    made = ["".join(chr(rng.randrange(*rng.choice(points[: rng.randrange(1, 8)]))) for _ in range(rng.randrange(0, 80))) for _ in range(3000)]
    return [*made, "a" * 50_000, " " * 3000 + "x", "<|endoftext|> isn't special", "1234567 ½ ٣ 4th"]


def test_ids_equal_the_library(tokenizer, library):
    codec, some = byte_bpe.Codec(tokenizer.model, tokenizer.pattern), texts()
    ids = codec.encode([t.encode() for t in some])
    assert [x.tolist() for x in ids] == [library.encode_ordinary(t) for t in some]
    assert [codec.spell(x) for x in ids] == [t.encode() for t in some]


def test_memory_of_pre_tokens_changes_nothing(tokenizer, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 20)
    codec = byte_bpe.Codec(tokenizer.model, tokenizer.pattern)
    for t in ["one two three", "four " * 9, "five six seven eight nine ten " * 3]:
        assert codec.encode([t.encode()])[0].tolist() == library.encode_ordinary(t)


def test_a_vocabulary_must_be_complete():
    with pytest.raises(ValueError):
        byte_bpe.serialised_model({b"a": 0})
    with pytest.raises(ValueError):
        byte_bpe.serialised_model({b"a": 1})


def test_columns_round_trip(docs, tokenizer, library):
    df = docs(AWKWARD)
    coded = byte_bpe.encode(df, tokenizer)
    assert coded.columns == [*df.columns, "token_ids"]
    back = byte_bpe.decode(coded, tokenizer).select("doc_id", "text", "token_ids", "decoded").collect()
    assert len(back) == len(AWKWARD)
    for r in back:
        assert bytes(r["decoded"]) == (r["text"] or "").encode() and r["token_ids"] == library.encode_ordinary(r["text"] or "")
    digests = byte_bpe.round_trip(df.select("doc_id", "text"), tokenizer).collect()
    want = sorted((len(x := library.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for _, t in AWKWARD)
    assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in digests) == want
    assert byte_bpe.encode(df.limit(0), tokenizer).count() == 0
