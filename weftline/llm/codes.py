"""Token ids as directly addressable codes: any token is read without decoding a block.

An id is split from its low bits into chunks, one for each level, as wide as ``WIDTHS`` says.
Level 0 has a chunk of every token; level l has those of tokens whose rest is not zero after
l chunks. Each level but the last that is used has a bitmap with a bit for each chunk (does
the token go on?) and a rank directory: the number of ones before every ``BLOCK`` bits. To
read token i, its chunk and bit are looked up, and as long as the bit is set, i becomes the
number of ones before it, which the directory and at most ``BLOCK`` bits give, on the next
level.

Blob, little-endian: byte 1 (version), byte levels, uint64 tokens; for each level: byte
width, byte bitmap (0 or 1), uint64 chunks; then for each level the packed chunks and, with a
bitmap, its bytes and the directory of uint32, or of uint64 in a level of 2**32 bits or over.

Cases: a null text or null id array gives a null blob; an empty one a blob of no tokens. Null
ids inside an array are an error. Ids must lie in [0, 2**32). Repeated rows are encoded each
on its own; an empty table gives an empty result. Extra columns are kept; one called like a
result column is replaced by it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.bpe import VOCABULARY, pretokens
from weftline.llm.common import appended, encoding, plus, table, texts, tokenizer_dir, utf8

WIDTHS = (8, 4, 4, 8, 8)
BLOCK = 512
RESULT = "n_tokens bigint, codes binary, levels int, n_bytes bigint"


def _packed(x: np.ndarray, width: int) -> bytes:
    if width == 8:
        return x.astype(np.uint8).tobytes()
    x = x.astype(np.uint8)
    if len(x) % 2:
        x = np.append(x, np.uint8(0))
    return (x[::2] | (x[1::2] << np.uint8(4))).tobytes()


def pack(ids: np.ndarray) -> bytes:
    """The blob of an array of ids."""
    rest = np.asarray(ids)
    if rest.dtype != np.uint32:
        if len(rest) and int(rest.max()) >= 1 << 32:
            raise ValueError("ids must be below 2**32")
        rest = rest.astype(np.uint32)
    heads, bodies = [], []
    for level, width in enumerate(WIDTHS):
        n = len(rest)
        low, more = rest & np.uint32((1 << width) - 1), rest >> np.uint32(width)
        on = more > 0
        last = level + 1 == len(WIDTHS) or not on.any()
        heads.append(struct.pack("<BBQ", width, not last, n))
        bodies.append(_packed(low, width))
        if last:
            break
        bits = np.packbits(on, bitorder="little")
        ones = np.add.reduceat(on.astype(np.int64), np.arange(0, n, BLOCK)) if n else np.zeros(0, np.int64)
        bodies += [bits.tobytes(), (np.cumsum(ones) - ones).astype("<u8" if n >= 1 << 32 else "<u4").tobytes()]
        rest = more[on]
    return b"".join([struct.pack("<BBQ", 1, len(heads), len(ids)), *heads, *bodies])


class Codes:
    """Reader of a blob."""

    def __init__(self, blob: bytes):
        self.blob = memoryview(blob)
        _, levels, self.n = struct.unpack_from("<BBQ", blob)
        at, self.levels = 10 + 10 * levels, []
        for k in range(levels):
            width, more, n = struct.unpack_from("<BBQ", blob, 10 + 10 * k)
            chunks, at = at, at + (n * width + 7) // 8
            bits, at = at, at + ((n + 7) // 8 if more else 0)
            size = 8 if n >= 1 << 32 else 4
            ranks, at = at, at + (-(-n // BLOCK) * size if more else 0)
            self.levels.append((width, more, n, chunks, bits, ranks, size))
        self.end = at

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = shift = 0
        for width, more, _, chunks, bits, ranks, size in self.levels:
            byte = self.blob[chunks + (i * width >> 3)]
            out |= (byte if width == 8 else byte >> 4 * (i & 1) & 15) << shift
            if not more or not self.blob[bits + (i >> 3)] >> (i & 7) & 1:
                return out
            shift += width
            b = i // BLOCK
            before = int.from_bytes(self.blob[ranks + size * b : ranks + size * (b + 1)], "little")
            word = int.from_bytes(self.blob[bits + b * (BLOCK // 8) : bits + (i >> 3) + 1], "little")
            i = before + (word & ((1 << (i - b * BLOCK)) - 1)).bit_count()
        return out

    def all(self) -> np.ndarray:
        """All ids, level by level."""
        out, at, shift = np.zeros(self.n, np.uint64), np.arange(self.n), 0
        for width, more, n, chunks, bits, _, _ in self.levels:
            raw = np.frombuffer(self.blob, np.uint8, (n * width + 7) // 8, chunks)
            low = raw if width == 8 else np.stack([raw & 15, raw >> 4], 1).ravel()[:n]
            out[at] |= low.astype(np.uint64) << np.uint64(shift)
            if more:
                at = at[np.unpackbits(np.frombuffer(self.blob, np.uint8, (n + 7) // 8, bits), count=n, bitorder="little").astype(bool)]
            shift += width
        return out.astype(np.int64)


class Encoder:
    """Ids of texts; keeps the ids of words it has seen."""

    def __init__(self, vocabulary: str, keep: int = 500_000):
        self.enc, self.keep = encoding(vocabulary), keep
        self.seen: dict[str, bytes] = {}

    def __call__(self, docs: list[str | None]) -> list[np.ndarray | None]:
        if len(self.seen) > self.keep:
            self.seen = {}
        split = [None if t is None else pretokens(utf8(t)) for t in docs]
        new: set[str] = set()
        for t in split:
            if t:
                new.update(t)
        for w in new.difference(self.seen):
            self.seen[w] = np.array(self.enc.encode_ordinary(w), np.uint32).tobytes()
        get = self.seen.__getitem__
        return [None if t is None else np.frombuffer(b"".join(map(get, t)), np.uint32) for t in split]


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One for each process, as tasks share most words."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def _columns(blobs: list[bytes | None], counts: list[int | None]) -> dict[str, pa.Array]:
    return {
        "n_tokens": pa.array(counts, pa.int64()), "codes": pa.array(blobs, pa.binary()),
        "levels": pa.array([None if b is None else b[1] for b in blobs], pa.int32()), "n_bytes": pa.array([None if b is None else len(b) for b in blobs], pa.int64()),
    }


def encode_texts(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``RESULT`` for the ids of ``text``; one pass, no shuffle."""
    schema = plus(docs.schema, RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                ids = enc(texts(batch, text))
                yield appended(batch, schema, _columns([None if x is None else pack(x) for x in ids], [None if x is None else len(x) for x in ids]))

    return docs.mapInArrow(run, schema)


def encode_ids(docs: DataFrame, ids: str = "token_ids") -> DataFrame:
    """``docs`` with the columns of ``RESULT`` for an array column of ids."""
    schema = plus(docs.schema, RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = texts(batch, ids)
            yield appended(batch, schema, _columns([None if x is None else pack(np.array(x, np.uint64)) for x in lists], [None if x is None else len(x) for x in lists]))

    return docs.mapInArrow(run, schema)


def read_ids(docs: DataFrame, codes: str = "codes", out: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of each blob."""
    schema = plus(docs.schema, f"{out} array<bigint>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield appended(batch, schema, {out: pa.array([None if b is None else Codes(b).all() for b in texts(batch, codes)], pa.list_(pa.int64()))})

    return docs.mapInArrow(run, schema)


def access(docs: DataFrame, position: str, codes: str = "codes", out: str = "token_id") -> DataFrame:
    """``docs`` with the token at the 0-based ``position`` of each row, null beyond its ends."""
    schema = plus(docs.schema, f"{out} bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for b, i in zip(texts(batch, codes), texts(batch, position)):
                c = None if b is None or i is None else Codes(b)
                got.append(c[i] if c is not None and 0 <= i < len(c) else None)
            yield appended(batch, schema, {out: pa.array(got, pa.int64())})

    return docs.mapInArrow(run, schema)


def op7_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document as directly addressable codes, and its middle token, read from them by its address."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_texts(docs, f"{tokenizer_dir(spark)}/{VOCABULARY}").drop("text")
    return access(coded.withColumn("middle", F.expr("n_tokens div 2")), "middle", out="middle_token")
