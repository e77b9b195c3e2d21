"""Token ids of a byte-level BPE through a sentencepiece model made from its vocabulary."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the vocabularies lie; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
#: How GPT-style byte-level vocabularies cut a text before merging (fixed value: the published pattern).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens whose ids a worker remembers; beyond that it begins anew.
REMEMBERED = 1 << 18


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | str) -> bytes:
    """One protobuf field: a number as varint, bytes and strings with their length."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def byte_alphabet() -> dict[int, int]:
    """A printable code point for every byte: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


def bpe_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model whose piece ids are the ranks.

    A piece is a token's bytes in the byte alphabet and its score the negative
    rank, so the merge of the best score is the merge of the lowest rank.  The
    last piece is the unknown one, which no byte-mapped text can give.  The
    normalisation is the identity: no prefix, no white space removed or escaped.
    """
    import struct

    alphabet = byte_alphabet()
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = "".join(chr(alphabet[b]) for b in token)
        out.append(_field(1, _field(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _field(3, 1)))
    out.append(_field(1, _field(1, "<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, len(ranks))
    normalizer = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Encoder:
    """Encodes and decodes texts with the vocabulary of a rank file."""

    def __init__(self, path: str):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=bpe_model(ranks))
        self.table = byte_alphabet()
        self.back = {chr(c): b for b, c in self.table.items()}
        self.cut = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for null and for the empty text.  Lone surrogates count as U+FFFD."""
        if not text:
            return []
        parts = self.cut(text)
        known = self.known
        new = [p for p in dict.fromkeys(parts) if p not in known]
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list(dict.fromkeys(parts))
            mapped = [p.encode("utf-8", "replace").decode("latin-1").translate(self.table) for p in new]
            known.update(zip(new, self.model.encode(mapped)))
        out: list[int] = []
        for p in parts:
            out += known[p]
        return out

    def decode(self, ids: list[int]) -> str:
        pieces = "".join(self.model.id_to_piece(i) for i in ids)
        return bytes(self.back[c] for c in pieces).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per worker process."""
    return Encoder(path)


def vocabulary(name: str, folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, f"{name}.tiktoken")


def _mapped(df: DataFrame, keys: list[str], text: str, path: str, counts: bool) -> DataFrame:
    """``keys`` with ids (or n_tokens) of every row, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            texts = batch.column(len(keys))
            offsets, flat = [0], []
            for t in texts:
                ids = encode(t.as_py())
                if not counts:
                    flat.extend(ids)
                offsets.append(offsets[-1] + len(ids))
            if counts:
                result = pa.array([b - a for a, b in zip(offsets, offsets[1:])], pa.int64())
            else:
                result = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), result], [*keys, "n_tokens" if counts else "ids"])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n_tokens bigint" if counts else "ids array<int>"])
    return df.select(*keys, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def encode_texts(df: DataFrame, keys: list[str], text: str, vocab: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``keys`` and ``ids``, the token ids of each row's whole text without special tokens.

    Null and empty texts give an empty array; every row gives one row, repeats
    too; other columns are not read.  An empty table gives no rows.
    """
    return _mapped(df, keys, text, vocabulary(vocab, folder), False)


def count_tokens(df: DataFrame, keys: list[str], text: str, vocab: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``keys`` and ``n_tokens``, the number of token ids of each row's whole text."""
    return _mapped(df, keys, text, vocabulary(vocab, folder), True)


def decode_ids(ids: Column, vocab: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Column:
    """The texts of arrays of ids; null gives null."""
    path = vocabulary(vocab, folder)

    @F.pandas_udf("string")
    def run(series: pd.Series) -> pd.Series:
        decode = encoder(path).decode
        return series.map(lambda x: None if x is None else decode(list(x)))

    return run(ids)
