"""Byte-level BPE encoding and decoding by a sentencepiece model that is written out from a rank table.

Every byte b stands for the character U+0100 + b, every rank for a piece of such characters scored by the negative
rank; normalisation is the identity. A text is split by the tokenizer's pattern and each match is encoded alone.

Nulls count as the empty text, which has no ids. Very long texts are encoded whole. Repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, text_of, tidy

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Encoded pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 200_000
_TO_CHARS = {b: 0x100 + b for b in range(256)}


def chars_of(piece: bytes) -> str:
    return piece.decode("latin-1").translate(_TO_CHARS)


def bytes_of(piece: str) -> bytes:
    return bytes(ord(c) - 0x100 for c in piece)


def read_ranks(path: str) -> list[bytes]:
    """Pieces by rank; the ranks run from 0 without gaps."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(piece) for piece, rank in map(bytes.split, lines)}
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def sentencepiece_model(pieces: list[bytes]) -> bytes:
    """The public ModelProto of a BPE model whose ids are the ranks, with the unknown piece after them."""
    normal, unknown, bpe = 1, 2, 2
    out = []
    for rank, piece in enumerate(pieces):
        entry = _block(1, chars_of(piece).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank))
        out.append(_block(1, entry + _number(3, normal)))
    unk = _block(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, unknown)
    out.append(_block(1, unk))
    trainer = _number(3, bpe) + _number(4, len(pieces) + 1) + _number(40, len(pieces))
    trainer += b"".join(_number(field, -1) for field in (41, 42, 43))
    normaliser = _block(1, b"identity") + b"".join(_number(field, 0) for field in (3, 4, 5))
    return b"".join(out) + _block(2, trainer) + _block(3, normaliser)


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, model: bytes, pieces: list[bytes], pattern: str) -> None:
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.whole = {piece: struct.pack("<I", rank) for rank, piece in enumerate(pieces)}
        self.known: dict[str, bytes] = {}

    def learn(self, tokens: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known = {}
            return self.learn(tokens)
        new = [t for t in tokens if t not in self.known]
        rest = []
        for token in new:
            if (found := self.whole.get(token.encode())) is not None:
                self.known[token] = found
            else:
                rest.append(token)
        for token, ids in zip(rest, self.model.encode([chars_of(t.encode()) for t in rest], num_threads=1) if rest else [], strict=True):
            self.known[token] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        tokens = self.split(text)
        try:
            return b"".join(map(self.known.__getitem__, tokens))
        except KeyError:
            self.learn(set(tokens))
            return b"".join(map(self.known.__getitem__, tokens))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit integers) of each row's whole text."""
    spark = docs.sparkSession
    small_batches(spark)
    pieces = read_ranks(path)
    shared = spark.sparkContext.broadcast((sentencepiece_model(pieces), pieces))  # as large as the vocabulary file

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value, pattern)
        for batch in batches:
            ids = [encoder.encode(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    rows = docs.select("doc_id", text_of().alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded (binary): the bytes that the ids stand for."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast([chars_of(piece) for piece in read_ranks(path)])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = list(map(bytes_of, shared.value))
        for batch in batches:
            out = []
            for ids in batch.column(1):
                data = ids.as_py()
                out.append(b"".join(map(pieces.__getitem__, struct.unpack(f"<{len(data) // 4}I", data))))
            yield pa.record_batch([*batch.columns, pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, ids binary, decoded binary")


def apply(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The round trip: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN
    return decode(encode(docs, path, pattern), path).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"))
