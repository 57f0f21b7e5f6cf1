"""Byte-level BPE encoding and decoding, each distinct word of the corpus encoded once.

Encoding. Tasks split their texts into pre-tokens and gather them in blocks: a block holds
its distinct words and, for each text, the positions' indices into them. The words of blocks
are shuffled by a hash of the word, so over the whole corpus every distinct word meets its
copies in one place and is encoded once; the ids are shuffled back to the blocks and each
text is put together by position. So what is shuffled are the distinct words of blocks, not
all positions: the blocks themselves are written in buckets and never move.

Decoding joins the distinct ids of blocks of texts with the vocabulary's table of token bytes, by
id. The table has as many rows as the vocabulary, whatever the corpus, so it is sent to all tasks;
a block's ids are exploded in order, stay in their task through the join, and its texts are put
together from the pieces there, by position: no shuffle.

Cases: a null text has null ids and decodes to null; an empty one has no ids and decodes to
an empty text. Lone surrogates count as U+FFFD. Texts of any length are encoded whole. Null
ids, repeated rows and equal texts are rows of their own. An empty table gives an empty
result. Extra columns are kept; one that is called like a result column is replaced by it.
Ids that the vocabulary lacks decode to nothing.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import PATTERN, bucketed, encoding, get_arrays, plus, put_arrays, ranks, table, texts, tidy, tokenizer_dir, utf8, written

VOCABULARY = "byte_bpe_50k.tiktoken"

#: Splits as PATTERN does where a text has none of the characters of RARE.
FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: White space and numbers that the two libraries class differently, and marks.
CONTROLS = "\x1c\x1d\x1e\x1f"
RARE = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c in CONTROLS or c == "\x85" or unicodedata.category(c) in ("Nl", "No", "Mn", "Mc", "Me"))
IS_RARE = np.zeros(sys.maxunicode + 1, bool)
IS_RARE[[ord(c) for c in RARE]] = True
#: PATTERN with white space as Unicode has it.
SPACE = r"\t-\r \x85\xa0  -     　"
EXACT = regex.compile(PATTERN.replace(r"[^\s\p", rf"[^{SPACE}\p").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))


def pretokens(text: str) -> list[str]:
    """The words of a text, in order; together they are the text."""
    rare = any(c in text for c in CONTROLS) if text.isascii() else IS_RARE[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any()
    return EXACT.findall(text) if rare else FAST.findall(text)


def _blocks(columns: list[str], text: str, block_chars: int, parts: int):
    """Function for mapInArrow: rows to blocks.

    A block has a row of part -1, with its rows as an Arrow stream, and the words' numbers and count of each text; and
    a row for each part of its words, sorted. Words are numbered in the order of those rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        seen: dict[str, int] = {}
        kept: list[pa.RecordBatch] = []
        codes: list[np.ndarray] = []
        lens: list[int] = []
        chars = 0

        def out() -> pa.RecordBatch:
            rows = pa.BufferOutputStream()
            with pa.ipc.new_stream(rows, kept[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for b in kept:
                    w.write_batch(b)
            by_part: dict[int, list[str]] = {}
            for w in seen:
                by_part.setdefault(xxhash.xxh32_intdigest(w) % parts, []).append(w)
            number, n = np.empty(len(seen), np.uint32), 0
            where, data = [-1], []
            for part in sorted(by_part):
                words = sorted(by_part[part])
                number[[seen[w] for w in words]] = np.arange(n, n + len(words))
                n += len(words)
                where.append(part)
                data.append(put_arrays(np.array(list(map(len, words)), np.uint32), np.frombuffer("".join(words).encode(), np.uint8)))
            flat = number[np.concatenate(codes)] if codes else np.zeros(0, np.uint32)
            data.insert(0, put_arrays(flat, np.array(lens, np.int64)))
            block = pa.array([(task << 32) | seq] * len(where), pa.int64())
            held = pa.array([rows.getvalue().to_pybytes()] + [None] * (len(where) - 1), pa.binary())
            return pa.RecordBatch.from_arrays([block, pa.array(where, pa.int32()), held, pa.array(data, pa.binary())], names=["block", "part", "rows", "data"])

        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                kept.append(batch.select(columns))
                for t in texts(batch, text):
                    if t is None:
                        lens.append(-1)
                        continue
                    words = pretokens(utf8(t))
                    for w in set(words).difference(seen):
                        seen[w] = len(seen)
                    codes.append(np.array(list(map(seen.__getitem__, words)), np.uint32))
                    lens.append(len(words))
                    chars += len(t)
                if chars >= block_chars:
                    yield out()
                    seq, chars = seq + 1, 0
                    seen, kept, codes, lens = {}, [], [], []
                    tidy()
        if kept:
            yield out()
            seen, kept, codes, lens = {}, [], [], []
        tidy()

    return run


def encode(docs: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None, block_chars: int = 4_000_000, part_bytes: int = 24 << 20, decoded: str | None = None, apart: bool = False) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``token_ids``, an array of the ids of ``text``.

    With ``decoded``, a column of that name has what ``decode`` makes of the ids: blocks go on as they are, or, ``apart``, are
    written between the two, which takes disk and spares a Python worker a task.
    """
    spark = docs.sparkSession
    columns = [c for c in (docs.columns if keep is None else keep) if c.lower() != "token_ids"]
    schema = plus(docs.select(*columns).schema, "token_ids array<int>")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(4, -(-size // part_bytes))  # a part has the words of so many bytes of text
    made = docs.select(*dict.fromkeys([*columns, text])).mapInArrow(_blocks(columns, text, block_chars, parts), "block bigint, part int, rows binary, data binary")
    blocks, _ = bucketed(made, "bpe-blocks", "block", max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, known = encoding(vocabulary), {}
        for batch in batches:
            out = []
            for blob in texts(batch, "data"):
                lens, raw = get_arrays(blob)
                joined, at, ids = raw.tobytes().decode(), 0, []
                for n in lens.tolist():
                    w = joined[at : at + n]
                    at += n
                    got = known.get(w)
                    if got is None:
                        got = known[w] = np.array(enc.encode_ordinary(w), np.uint32).tobytes()
                    ids.append(got)
                out.append(put_arrays(np.array(list(map(len, ids)), np.uint32) // 4, np.frombuffer(b"".join(ids), np.uint32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["block", "part", "data"])
        known.clear()
        tidy()

    words = blocks.where("part >= 0").select("block", "part", "data")
    coded = words.repartition(parts, "part").mapInArrow(encode_words, "block bigint, part int, data binary")

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        tidy(False)  # of the group before
        rows = pa.ipc.open_stream(left["rows"][0].as_py()).read_all()
        codes, lens = get_arrays(left["data"][0].as_py())
        blobs = [get_arrays(right["data"][int(i)].as_py()) for i in np.argsort(right["part"].to_numpy())]
        flat, offsets = np.zeros(0, np.uint32), np.zeros(len(lens) + 1, np.int32)
        if len(codes):
            many, pool = (np.concatenate(x) for x in zip(*blobs))
            del blobs
            first = (np.cumsum(many) - many).astype(np.int32)  # a block has under block_chars characters and one text more, of less than 2**31 bytes
            count = many.astype(np.int32)[codes]
            ends = np.cumsum(count, dtype=np.int32)
            offsets = np.concatenate([np.zeros(1, np.int32), ends])[np.concatenate([[0], np.cumsum(np.maximum(lens, 0))])]
            at = np.repeat(first[codes] - (ends - count), count)
            del codes, count
            at += np.arange(len(at), dtype=np.int32)
            flat = pool[at]
            del at
        tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int32), pa.int32()), mask=pa.array(lens < 0))
        got = pa.table([*(rows[c] for c in columns), tokens], names=[*columns, "token_ids"])
        if not decoded:
            return got
        mine = [c for c in got.column_names if c.lower() != decoded.lower()]
        parts = [_coded_block(b, mine, "token_ids") for b in got.combine_chunks().to_batches(max_chunksize=1024)]
        return pa.Table.from_batches(parts, CODED) if parts else CODED.empty_table()

    whole = blocks.where("part = -1").select("block", "rows", "data")
    both = whole.groupBy("block").cogroup(coded.groupBy("block"))
    if decoded:
        got = both.applyInArrow(assemble, BLOCK)
        return _decoded(written(got, "bpe-coded") if apart else got, vocabulary, plus(schema, f"{decoded} string"))
    return both.applyInArrow(assemble, schema)


def token_bytes(spark: SparkSession, vocabulary: str) -> DataFrame:
    """The table of a vocabulary: token_id, piece (its bytes)."""
    known = ranks(vocabulary)
    return spark.createDataFrame(pa.table({"token_id": pa.array(known.values(), pa.int32()), "piece": pa.array(known, pa.binary())}))


def _strings(pieces: list[bytes | None]) -> pa.Array:
    """Bytes as strings; what isn't UTF-8 becomes U+FFFD."""
    try:
        return pa.array(pieces, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if x is None else x.decode("utf-8", "replace") for x in pieces], pa.string())


#: A block of texts to decode: its distinct ids, its rows as an Arrow stream, and the rows' tokens as numbers of the ids.
BLOCK = "ids array<bigint>, rows binary, data binary"
CODED = pa.schema([("ids", pa.list_(pa.int64())), ("rows", pa.binary()), ("data", pa.binary())])


def _coded_block(batch: pa.RecordBatch, columns: list[str], ids: str) -> pa.RecordBatch:
    lists = batch.column(batch.schema.get_field_index(ids))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(flat) and (flat.min() < 0 or flat.max() >= 1 << 22):
        known, code = np.unique(flat, return_inverse=True)
    else:
        known = np.flatnonzero(np.bincount(flat.astype(np.int64)))
        number = np.zeros(int(known[-1]) + 1 if len(known) else 0, np.uint32)
        number[known] = np.arange(len(known))
        code = number[flat.astype(np.int64)]
    lens = np.where(lists.is_null().to_numpy(zero_copy_only=False), -1, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    rows = pa.BufferOutputStream()
    with pa.ipc.new_stream(rows, batch.select(columns).schema) as w:
        w.write_batch(batch.select(columns))
    blob = put_arrays(code.astype(np.uint32), lens.astype(np.int64))
    return pa.RecordBatch.from_arrays([pa.array([known], pa.list_(pa.int64())), pa.array([rows.getvalue().to_pybytes()], pa.binary()), pa.array([blob], pa.binary())], schema=CODED)


def _coded(columns: list[str], ids: str, most: int):
    """Function for mapInArrow: rows to blocks of about ``most`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = whole.column(whole.schema.get_field_index(ids)).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            block = np.concatenate([[0], np.cumsum(size)[:-1]]) // most
            cut = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), whole.num_rows] if whole.num_rows else []
            for lo, hi in zip(cut, cut[1:]):
                yield _coded_block(whole.slice(lo, hi - lo), columns, ids)
            tidy(False)

    return run


def decode(docs: DataFrame, vocabulary: str, ids: str = "token_ids", out: str = "decoded", block_tokens: int = 200_000) -> DataFrame:
    """``docs`` with the text that its ids stand for."""
    schema = plus(docs.schema, f"{out} string")
    return _decoded(docs.mapInArrow(_coded([f.name for f in schema][:-1], ids, block_tokens), BLOCK), vocabulary, schema)


def _decoded(blocks: DataFrame, vocabulary: str, schema: T.StructType) -> DataFrame:
    """The rows of blocks with the text of each as the last column of ``schema``."""
    *columns, out = (f.name for f in schema)
    cell = lambda i, first: F.struct(i.alias("id"), *(F.when(first, F.col(c)).alias(c) for c in ("rows", "data")))
    # a block goes with its first id, which may be of no token where it has none
    cells = F.transform(F.when(F.size("ids") > 0, F.col("ids")).otherwise(F.array(F.lit(-1).cast("bigint"))), lambda i, k: cell(i, k == 0))
    joined = blocks.select(F.inline(cells)).join(F.broadcast(token_bytes(blocks.sparkSession, vocabulary)), F.col("id") == F.col("token_id"), "left").select("rows", "data", "piece")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pieces = None, []

        def texts_of(held: tuple, pieces: list[bytes | None]) -> pa.RecordBatch:
            rows = pa.ipc.open_stream(held[0]).read_all().combine_chunks()
            code, lens = get_arrays(held[1])
            raw = pa.array([x or b"" for x in pieces], pa.large_binary()).take(pa.array(code))
            data = memoryview(raw.buffers()[2] or b"")
            at = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1)[np.concatenate([[0], np.cumsum(np.maximum(lens, 0))])].tolist()
            made = [None if n < 0 else bytes(data[a:b]) for n, a, b in zip(lens.tolist(), at, at[1:])]
            return pa.RecordBatch.from_arrays([*(c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in rows.columns), _strings(made)], names=[*columns, out])

        for batch in batches:
            first = np.flatnonzero(batch.column(0).is_valid().to_numpy(zero_copy_only=False)).tolist()
            got, at = batch.column(2).to_pylist(), 0
            for k in first:
                pieces += got[at:k]
                if held is not None:
                    yield texts_of(held, pieces)
                    tidy(False)
                held, pieces, at = (batch.column(0)[k].as_py(), batch.column(1)[k].as_py()), [], k
            pieces += got[at:]
        if held is not None:
            yield texts_of(held, pieces)
        del held, pieces
        tidy()

    return joined.mapInArrow(assemble, schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as ids, their number, and the text decoded from them."""
    vocabulary = f"{tokenizer_dir(spark)}/{VOCABULARY}"
    got = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, keep=["doc_id"], decoded="decoded")
    return got.withColumn("n_tokens", F.size("token_ids"))
