"""Byte-level BPE through a sentencepiece model that is serialised from a rank file.

Every byte is mapped to one character, every token to the string of its bytes' characters; the piece's score is its
negative rank, so sentencepiece merges in rank order, leftmost first. The model normalises nothing (identity, no dummy
prefix, no white space rules) and gets pre-tokens one at a time, so no merge crosses a boundary. A pre-token that is
itself a token is that token. Decoding joins the bytes of the ids.

The vocabulary is read once on the driver; executors get the serialised model (about a megabyte, the vocabulary's
size, whatever the data's) and build it once per process.

Defined results: null and empty texts have no ids and decode to no bytes; bytes that are not UTF-8 count as U+FFFD;
repeated rows are encoded alike; an empty table gives an empty one; other columns pass through.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meterwork.llm.common import slices, text_bytes, unused

#: Pre-tokens remembered by a process; the memory is emptied when it is full, results do not change.
REMEMBERED = 150_000
_BYTES_AT_ONCE = 1 << 20
#: Bytes are mapped to consecutive letters of Latin Extended and what follows, none of which sentencepiece treats specially.
_FIRST = 0x100
_BPE, _NORMAL, _UNKNOWN = 2, 1, 2


_MAPPED = {b: _FIRST + b for b in range(256)}


def _mapped(token: bytes) -> str:
    return token.decode("latin-1").translate(_MAPPED)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def serialised_model(ranks: dict[bytes, int]) -> bytes:
    """A ModelProto: pieces in rank order (id = rank), then one unknown piece; BPE; identity normaliser."""
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without a token: {missing}")
    pieces = [
        _block(1, _block(1, _mapped(t).encode()) + b"\x15" + struct.pack("<f", -float(rank)) + _number(3, _NORMAL))
        for rank, t in enumerate(tokens)
    ]
    pieces.append(_block(1, _block(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, _UNKNOWN)))
    trainer = _number(3, _BPE) + _number(4, len(pieces)) + _number(40, len(tokens))
    normaliser = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _block(2, trainer) + _block(3, normaliser)


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


#: UTF-8 lead bytes up to this one belong to code points below ``_LOW_END``.
_LOW_LEAD, _LOW_END = 0xC8, 0x240


def _low_class(name: str) -> str:
    """The members below ``_LOW_END`` of a character class, spelled out."""
    fits = regex.compile(name)
    return "".join(re.escape(chr(c)) for c in range(_LOW_END) if fits.fullmatch(chr(c)))


def low_pattern(pattern: str) -> str:
    """The same pattern with its classes spelled out for low code points; the standard ``re`` then runs it, twice as fast."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        size = 5 if pattern.startswith((r"\p{", r"\P{"), at) else 2 if pattern[at] == "\\" else 1
        piece = pattern[at : at + size]
        if size == 5 or piece in (r"\s", r"\S"):
            spelled = _low_class(piece)
            piece = spelled if inside else f"[{spelled}]"
        elif piece in "[]":
            inside = piece == "["
        out.append(piece)
        at += size
    return "".join(out)


class Spelling:
    """Joins the byte strings of many ids at once."""

    def __init__(self, strings: list[bytes]):
        self._flat = np.frombuffer(b"".join(strings), np.uint8)
        self._size = np.fromiter(map(len, strings), np.int64, len(strings))
        self._start = np.cumsum(self._size) - self._size

    def __call__(self, ids: np.ndarray) -> bytes:
        size = self._size[ids]
        ends = np.cumsum(size)
        if not len(ends):
            return b""
        return self._flat[np.repeat(self._start[ids] - ends + size, size) + np.arange(ends[-1])].tobytes()


class Codec:
    """Encodes pre-tokens with sentencepiece and decodes by the inverse mapping."""

    def __init__(self, model: bytes, pattern: str):
        self._pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        tokens = [bytes(ord(c) - _FIRST for c in self._pieces.id_to_piece(i)) for i in range(self._pieces.get_piece_size() - 1)]
        self._whole = {t: i for i, t in enumerate(tokens)}
        self.spell = Spelling(tokens)
        self.decimal = Spelling([b"%d " % i for i in range(len(tokens))])
        self._split = regex.compile(pattern).findall
        self._split_low = re.compile(low_pattern(pattern)).findall
        self._known: dict[str, bytes] = {}

    def _learn(self, tokens: list[str]) -> None:
        raw = [t.encode() for t in tokens]
        for token, key, ids in zip(tokens, raw, self._pieces.encode([_mapped(r) for r in raw], out_type=int, num_threads=1)):
            whole = self._whole.get(key)
            self._known[token] = array("i", ids if whole is None else [whole]).tobytes()

    def _pre_tokens(self, text: bytes) -> list[str]:
        low = text.isascii() or np.frombuffer(text, np.uint8).max() <= _LOW_LEAD
        return (self._split_low if low else self._split)(text.decode(errors="replace"))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of every text."""
        split = [self._pre_tokens(t) for t in texts]
        seen = set(chain.from_iterable(split))
        new = seen - self._known.keys()
        if len(self._known) + len(new) > REMEMBERED:
            self._known.clear()
            new = seen
        self._learn(list(new))
        known = self._known.__getitem__
        return [np.frombuffer(b"".join(map(known, tokens)), np.int32) for tokens in split]


@lru_cache(maxsize=2)
def _codec(model: bytes, pattern: str) -> Codec:
    return Codec(model, pattern)


@dataclass(frozen=True)
class Tokenizer:
    model: bytes
    pattern: str

    @classmethod
    def of(cls, path: str, pattern: str) -> Tokenizer:
        return cls(serialised_model(read_ranks(path)), pattern)


def _mapped_rows(df: DataFrame, given: Column, drop: list[str], added: str, tokenizer: Tokenizer, make) -> DataFrame:
    """``df`` with the columns that ``make(codec, values of given)`` returns, a few megabytes of text at a time.

    Columns that are already called like an added one are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast((tokenizer.model, tokenizer.pattern))
    new = StructType.fromDDL(added)
    kept = [c for c in df.columns if c not in (*drop, *new.names)]
    input_name = unused(df.columns, "_in")
    df = df.withColumn(input_name, given)
    schema = StructType([*df.select(*kept).schema.fields, *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*shared.value)
        for batch in batches:
            place = batch.column(batch.schema.get_field_index(input_name))
            sizes = pa.compute.binary_length(place) if pa.types.is_binary(place.type) else pa.compute.list_value_length(place)
            for lo, hi in slices(sizes.fill_null(0).to_numpy(zero_copy_only=False), _BYTES_AT_ONCE):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in kept], *make(codec, part.column(part.schema.get_field_index(input_name)).to_pylist())],
                                                 names=[*kept, *new.names])

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, tokenizer: Tokenizer, text_column: str = "text", ids_column: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of every text as an array column."""

    def make(codec: Codec, given: list):
        found = codec.encode([t or b"" for t in given])
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.empty(0, np.int32)])))]

    return _mapped_rows(docs, text_bytes(text_column), [], f"{ids_column} array<int>", tokenizer, make)


def decode(docs: DataFrame, tokenizer: Tokenizer, ids_column: str = "token_ids", bytes_column: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that an array of ids stands for; a null array gives no bytes."""

    def make(codec: Codec, given: list):
        return [pa.array([codec.spell(np.array(x or [], np.int64)) for x in given], pa.binary())]

    return _mapped_rows(docs, F.col(ids_column), [], f"{bytes_column} binary", tokenizer, make)


def round_trip(docs: DataFrame, tokenizer: Tokenizer, text_column: str = "text") -> DataFrame:
    """``docs`` without the text, with n_tokens and the SHA-256 of the ids (decimal, one space between) and of the decoded bytes.

    Encoding and decoding run in one pass, so ids never travel.
    """

    def make(codec: Codec, given: list):
        found = codec.encode([t or b"" for t in given])
        decimals = [hashlib.sha256(codec.decimal(ids)[:-1]).hexdigest() for ids in found]
        decoded = [hashlib.sha256(codec.spell(ids)).hexdigest() for ids in found]
        return [pa.array(map(len, found), pa.int64()), pa.array(decimals, pa.string()), pa.array(decoded, pa.string())]

    added = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _mapped_rows(docs, text_bytes(text_column), [text_column], added, tokenizer, make)
