"""Encoding a corpus with a public byte-level BPE vocabulary through a sentencepiece model made from its ranks.

The rank file becomes a sentencepiece BPE model directly: every byte is one letter of a 256-letter alphabet, a
piece is its bytes in that alphabet and scores minus its rank, normalisation is the identity. Merging by best score
is then merging by lowest rank, so the ids of a pre-token are those of the vocabulary itself. Texts are split by the
vocabulary's pattern, each different pre-token of a batch is encoded once, and ids turn back by the inverse map.

Defined results: null and empty texts have an empty list; strings of special tokens are ordinary text; any length
of text or of pre-token is encoded whole; repeated rows stay repeated; other columns are dropped.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files are; a parameter of every function below.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The model is sent to executors whole; a vocabulary file beyond this is refused.
MAX_VOCABULARY_BYTES = 64_000_000
#: Fixed value: the pattern of this public vocabulary, which splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Byte b is letter 256 + b, all of which are plain letters of two bytes in UTF-8.
ALPHABET = {b: chr(256 + b) for b in range(256)}
_LONG, _REMEMBERED = 48, 300_000


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes | bool) -> bytes:
    """One field of protocol-buffers wire format."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(int(value))


def as_letters(raw: bytes) -> str:
    return raw.decode("latin-1").translate(ALPHABET)


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, by id."""
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranks[k] for k in range(len(ranks))]


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece model whose piece k is token k; one more piece, the last, stands for the unknown."""
    normal, unknown, bpe, none = 1, 2, 2, (1 << 64) - 1
    pieces = [_field(1, _field(1, as_letters(t).encode()) + _field(2, float(-k)) + _field(3, normal)) for k, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens)) + b"".join(_field(k, none) for k in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, False) + _field(4, False) + _field(5, False)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


@lru_cache(maxsize=4)
def model_bytes(path: str) -> bytes:
    return serialise_model(read_ranks(path))


class Encoder:
    """Encodes pre-tokens with the model and remembers the short ones; one per Python worker."""

    def __init__(self, model: bytes) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        words = [self.split(t) if t else [] for t in texts]
        if len(self.known) > _REMEMBERED:
            self.known.clear()
        new = list(set(chain.from_iterable(words)).difference(self.known))
        known = self.known
        if new:
            fresh = dict(zip(new, self.model.encode([as_letters(w.encode()) for w in new], num_threads=1)))
            long = {w for w in new if len(w) > _LONG}
            known.update((w, ids) for w, ids in fresh.items() if w not in long)
            if long:
                known = known | {w: fresh[w] for w in long}
        return [list(chain.from_iterable(map(known.__getitem__, ws))) for ws in words]


@lru_cache(maxsize=2)
def _encoder(model: bytes) -> Encoder:
    return Encoder(model)


#: Texts encoded at once in a worker, so that memory does not follow the size of Arrow's batches.
_AT_ONCE = 512


def _encoded(batches: Iterator[pa.RecordBatch], model: bytes, counts_only: bool) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(model)
    for batch in batches:
        for start in range(0, batch.num_rows, _AT_ONCE):
            part = batch.slice(start, _AT_ONCE)
            ids = encoder.encode_all(part.column(1).to_pylist())
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            if counts_only:
                out = pa.array(sizes)
            else:
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                values = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
                out = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            yield pa.RecordBatch.from_arrays([part.column(0), out], names=["key", "out"])


def _run(df: DataFrame, key: str, text: str, path: str, counts_only: bool) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(model_bytes(path))
    kind = df.select(F.col(f"`{key}`")).dtypes[0][1]
    shape = f"key {kind}, out {'bigint' if counts_only else 'array<int>'}"
    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(lambda it: _encoded(it, sent.value, counts_only), shape)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """(key, ids): the ids of every row's text."""
    return _run(df, key, text, path, False).select(F.col("key").alias(key), F.col("out").alias("ids"))


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """(key, tokens): how many ids every row's text has."""
    return _run(df, key, text, path, True).select(F.col("key").alias(key), F.col("out").alias("tokens"))


def _decoded(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    tokens = sent.value
    for batch in batches:
        lists = batch.column(1)
        texts = [b"".join(map(tokens.__getitem__, pc.fill_null(x.values, 0).to_pylist())).decode("utf-8", "replace") if x.is_valid else None for x in lists]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "out"])


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """(key, text) of lists of ids; a null list gives null."""
    sent = df.sparkSession.sparkContext.broadcast(read_ranks(path))
    kind = df.select(F.col(f"`{key}`")).dtypes[0][1]
    out = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{ids}`").alias("ids")).mapInArrow(lambda it: _decoded(it, sent), f"key {kind}, out string")
    return out.select(F.col("key").alias(key), F.col("out").alias("text"))
