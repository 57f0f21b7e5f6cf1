"""Shared helpers of the training-data operators."""

from __future__ import annotations

import base64
import ctypes
import gc
import os
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.shared import Scratch, bucketed, release, remove, shared_dir, written, written_at  # noqa: F401

TOKENIZER_DIR = "/opt/tokenizers"
_LIBC = ctypes.CDLL(None) if hasattr(ctypes.CDLL(None), "malloc_trim") else None


def tokenizer_dir(spark: SparkSession) -> str:
    """Folder of the public vocabularies: the session's ``spark.weftline.tokenizers``, else the default."""
    return spark.conf.get("spark.weftline.tokenizers", TOKENIZER_DIR)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plus(schema: T.StructType, added: str | T.StructType) -> T.StructType:
    """``schema`` without columns that clash with ``added``, then those of ``added``."""
    more = T.StructType.fromDDL(added) if isinstance(added, str) else added
    names = {f.name.lower() for f in more}
    return T.StructType([f for f in schema if f.name.lower() not in names] + list(more))


def appended(batch: pa.RecordBatch, schema: T.StructType, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` cut to ``schema``'s columns with those in ``new`` put in."""
    names = [f.name for f in schema]
    return pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(batch.schema.get_field_index(n)) for n in names], names=names)


def texts(batch: pa.RecordBatch, column: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def size_of(df: DataFrame) -> int:
    """Bytes that the optimiser expects of ``df``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = 8 << 20) -> DataFrame:
    """A broadcast hint where the expected size is under ``limit``; else Spark shuffles both sides."""
    return F.broadcast(df) if size_of(df) <= limit else df


def by_hash(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows of the smallest hashes of ``key``; of ties, those of the smallest hashes of the row.

    Sorting out n rows sends n rows of every task to the driver, so rows over a cut go first,
    and the cut rises until n rows or all are under it.
    """
    h, share = F.xxhash64(key), min(1.0, 4 * n / max(1, df.count()))  # counted from files' footers
    while True:
        few = df.where(h <= F.lit(min(2**63 - 1, int(share * 2**64) - 2**63)))
        if share >= 1 or few.select(key).limit(n).count() >= n:
            return few.orderBy(h, key, F.xxhash64(*df.columns)).limit(n)
        share = min(1.0, 8 * share)


def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


#: The split that the byte-level vocabularies use before their merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODINGS: dict = {}


def encoding(path: str):
    """The byte-level encoder of a rank file, one per process."""
    if path not in _ENCODINGS:
        import tiktoken

        _ENCODINGS[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})
    return _ENCODINGS[path]


def utf8(text: str) -> str:
    """``text`` with lone surrogates replaced, so that every later encoding to UTF-8 works."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def tidy(cycles: bool = True) -> None:
    """Give memory that is free, but held by the allocators, back to the machine; workers live on between tasks."""
    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _trim_after_collection(phase: str, info: dict) -> None:
    if phase == "stop" and info["generation"] == 2:
        tidy(False)


#: Workers collect their garbage after each task: what the task held goes back to the machine then.
gc.callbacks.append(_trim_after_collection)


def put_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob, the bytes of each in planes."""
    heads = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)) for a in arrays)
    body = b"".join(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"" for a in arrays)
    return struct.pack("<Q", len(body)) + heads + (pa.Codec("zstd", 1).compress(body, asbytes=True) if body else b"")


def get_arrays(blob: bytes) -> list[np.ndarray]:
    size, count = struct.unpack_from("<QB", blob)
    heads = [struct.unpack_from("<2sQ", blob, 9 + 10 * i) for i in range(count)]
    body = np.frombuffer(pa.decompress(blob[9 + 10 * count :], decompressed_size=size, codec="zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
    out, at = [], 0
    for kind, n in heads:
        dt = np.dtype(kind.decode())
        out.append(np.ascontiguousarray(body[at : at + n * dt.itemsize].reshape(dt.itemsize, n).T).view(dt).ravel())
        at += n * dt.itemsize
    return out
