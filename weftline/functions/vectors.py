"""Hash embeddings and exact nearest neighbours, in numpy over Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.shared import folder, written, written_at

_BUCKETS: dict[int, dict[str, int]] = {}
#: Words whose buckets a worker remembers; characters and rows that it turns to vectors at a time.
KNOWN, CHARS, ROWS = 1 << 17, 1 << 20, 1024


def hash_embed(texts: list[str | None], dim: int) -> np.ndarray:
    """Counts of words by bucket (the word's MD5 as a number modulo ``dim``), scaled to length one; texts without a word are zero."""
    split = [t.lower().split() if t else [] for t in texts]
    known = _BUCKETS.setdefault(dim, {})
    if len(known) > KNOWN:
        known.clear()
    for w in set().union(*split).difference(known):
        known[w] = int(hashlib.md5(w.encode("utf-8", "replace")).hexdigest(), 16) % dim
    bucket = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in split])
    out = np.bincount(row * dim + bucket, minlength=len(texts) * dim).reshape(len(texts), dim).astype("f8")
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norm == 0, 1, norm)


def pieces(column: pa.Array, chars: int | None = None, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """(start, length) of slices of a text column, of about ``chars`` bytes and ``rows`` rows at most, one text at least."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype("i8")
    part = np.maximum.accumulate(np.maximum((np.cumsum(size) - 1) // (chars or CHARS), 0) if len(size) else size)
    at = np.flatnonzero(np.diff(part, prepend=-1))
    for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(size)]):
        for i in range(lo, hi, rows or ROWS):
            yield i, min(hi - i, rows or ROWS)


def embed(df: DataFrame, text: str = "text", out: str = "embedding", dim: int = 384, model: Callable[[list[str]], np.ndarray] | None = None, kind: str = "double") -> DataFrame:
    """``df`` with an embedding column of ``kind`` double or float; ``model`` maps texts to rows of unit vectors."""
    base = df.drop(out)
    schema = T.StructType([*base.schema.fields, T.StructField(out, T.ArrayType(T.FloatType() if kind == "float" else T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = whole.schema.get_field_index(text)
            for lo, n in pieces(whole.column(at)):
                batch = whole.slice(lo, n)
                read = batch.column(at).to_pylist()
                vec = np.asarray(model([t or "" for t in read]) if model else hash_embed(read, dim), "f4" if kind == "float" else "f8").reshape(len(read), -1)
                off = pa.array(np.arange(len(read) + 1, dtype=np.int32) * (vec.shape[1] if len(read) else 0))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(off, pa.array(vec.ravel()))], names=[*batch.schema.names, out])

    return base.mapInArrow(run, schema)


#: Bytes of request vectors that the driver and a task hold; more are searched shard by shard. Requests up to which no shards
#: are counted. Similarities that a task has at a time.
SHARD_BYTES, FEW, CELLS = 16 << 20, 4096, 1 << 21
RULES = ("tenant_id", "principals", "acl", "metadata", "metadata_filter")


class Rules:
    """Which items each request may see, as matrices: tenants, principals, and wanted metadata entries."""

    def __init__(self, requests: dict[str, list]):
        n = len(next(iter(requests.values()), []))
        self.tenants = requests.get("tenant_id")
        groups = [set(x or []) for x in requests.get("principals", [None] * n)]
        self.principals = {p: i for i, p in enumerate(sorted(set().union(*groups)))}
        self.member = np.zeros((n, len(self.principals)), "f4")
        for q, g in enumerate(groups):
            self.member[q, [self.principals[p] for p in g]] = 1
        wanted = [list(dict(x or {}).items()) for x in requests.get("metadata_filter", [None] * n)]
        self.entries = {e: i for i, e in enumerate(dict.fromkeys(e for w in wanted for e in w))}
        self.wants = np.zeros((n, len(self.entries)), "f4")
        for q, w in enumerate(wanted):
            self.wants[q, [self.entries[e] for e in w]] = 1

    def of(self, items: dict[str, list], n: int) -> np.ndarray:
        """(requests, items), true where the item may be seen."""
        fit = np.ones((len(self.member), n), bool)
        if self.tenants is not None and "tenant_id" in items:
            code = {t: i for i, t in enumerate(dict.fromkeys([*self.tenants, *items["tenant_id"]]))}
            mine = lambda x: np.array([code[t] if t is not None else -1 for t in x])
            fit &= (mine(self.tenants)[:, None] == mine(items["tenant_id"])[None]) & (mine(self.tenants) >= 0)[:, None]
        if "acl" in items:
            named = np.zeros((n, len(self.principals)), "f4")
            free = np.zeros(n, bool)
            for i, acl in enumerate(items["acl"]):
                free[i] = not acl
                named[i, [self.principals[p] for p in acl or [] if p in self.principals]] = 1
            fit &= free[None] | (self.member @ named.T > 0)
        if self.entries:
            lacks = np.ones((n, len(self.entries)), "f4")
            for i, m in enumerate(items.get("metadata", [None] * n)):
                have = dict(m or {})
                lacks[i] = [have.get(k) != v for k, v in self.entries]
            fit &= self.wants @ lacks.T == 0
        return fit


class Nearest:
    """The ``k`` most similar items of each request so far; ties go to the smaller id. Memory is that of the requests and of ``CELLS`` similarities."""

    def __init__(self, m: np.ndarray, k: int, digits: int, text_ids: bool = False):
        self.m, self.k, self.digits = m, k, digits
        self.sim = np.full((len(m), k), -np.inf)
        self.ids = np.full((len(m), k), "", object) if text_ids else np.zeros((len(m), k), "i8")

    def rows(self, requests: int | None = None) -> int:
        """How many items to add at a time."""
        return max(16, min(2048, CELLS // max(1, len(self.m) if requests is None else requests)))

    def add(self, ids: np.ndarray, x: np.ndarray, may: np.ndarray | None = None, at: np.ndarray | None = None, positive: bool = False) -> None:
        """Items with vectors ``x``; ``may`` has which request may see which, ``at`` the numbers of the requests that look at them, else all; ``positive`` leaves out what has nothing in common."""
        slack = 10.0**-self.digits  # what rounding may change
        sims = (self.m if at is None else self.m[at]) @ x.T
        ok = sims >= (self.sim[:, -1] if at is None else self.sim[at, -1])[:, None] - slack
        if may is not None:
            ok &= may
        if positive:
            ok &= sims > 0
        many = np.flatnonzero(np.count_nonzero(ok, axis=1) > 2 * self.k)
        if len(many):  # of many, all that may tie with the kth stay
            own = np.where(ok[many], sims[many], -np.inf)
            ok[many] &= own >= np.partition(own, len(ids) - self.k, axis=1)[:, len(ids) - self.k, None] - slack
        q, i = np.nonzero(ok)
        s, q, own = np.round(sims[q, i], self.digits) + 0.0, q if at is None else at[q], ids[i]
        new = (s > self.sim[q, -1]) | ((s == self.sim[q, -1]) & (own < self.ids[q, -1]))
        if new.any():
            self._merge(q[new], s[new], own[new])

    def _merge(self, q: np.ndarray, sim: np.ndarray, ids: np.ndarray) -> None:
        touched = q[np.flatnonzero(np.diff(q, prepend=-1))]
        q, sim, ids = np.concatenate([q, np.repeat(touched, self.k)]), np.concatenate([sim, self.sim[touched].ravel()]), np.concatenate([ids, self.ids[touched].ravel()])
        order = np.lexsort((ids if ids.dtype != object else np.unique(ids, return_inverse=True)[1], -sim, q))
        q, sim, ids = q[order], sim[order], ids[order]
        start = np.flatnonzero(np.diff(q, prepend=-1))
        rank = np.arange(len(q)) - np.repeat(start, np.diff(start, append=len(q)))
        best = rank < self.k
        self.sim[q[best], rank[best]], self.ids[q[best], rank[best]] = sim[best], ids[best]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the request, item, similarity)."""
        q, r = np.nonzero(self.sim > -np.inf)
        return q, self.ids[q, r], self.sim[q, r]


def top_k(queries: DataFrame, items: DataFrame, k: int, query_id: str, item_id: str, query_vec: str = "embedding", item_vec: str = "embedding", rules: bool = False, digits: int = 9, item_text: str | None = None, cells: tuple[str, str] | None = None) -> DataFrame:
    """(query_id, item_id, similarity, rank): the k most similar items of each query, exactly.

    A few queries are broadcast; each task multiplies its items with them and keeps its own best k, so what is shuffled
    is k rows for each query and task, not all pairs. More queries, or more than ``SHARD_BYTES`` of them, are written,
    and so are the items, and searched shard by shard: the driver and each task hold one shard at a time. With ``rules``,
    columns named in ``RULES`` decide which items a request may see: the same tenant (never a null one), an access list
    that is empty, null or names a principal, and every wanted metadata entry (a null one is met by a missing key); only
    tenants that ask are read. Similarities are rounded to ``digits``; ties go to the smaller id. Null and zero vectors
    have similarity 0. With ``item_text``, items have no vectors and tasks make them of that column's words. ``cells``
    names the packed bits of the cells that a query looks at, and the item's cell: other items aren't compared.
    """
    spark = queries.sparkSession
    q_extra = [c for c in RULES if rules and c in queries.columns]
    i_extra = [c for c in RULES if rules and c in items.columns]
    schema = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType), T.StructField(item_id, items.schema[item_id].dataType), T.StructField("similarity", T.DoubleType())])
    asked = queries.select(query_id, query_vec, *q_extra, *(cells[:1] if cells else ()))
    read = items.select(item_id, item_text or item_vec, *i_extra, *(cells[1:] if cells else ()))
    w = Window.partitionBy(query_id).orderBy(F.desc("similarity"), item_id)

    def search(rows: pa.Table, read: DataFrame) -> tuple[DataFrame, Broadcast]:
        """The best of one shard's queries, and what has been broadcast for them."""
        rows = rows.combine_chunks()
        col = lambda c: rows.column(c).combine_chunks() if len(rows) else pa.array([], rows.schema.field(c).type)
        vecs = col(query_vec)
        width = max(1, pc.max(pc.list_value_length(vecs)).as_py() or 1)
        bits = np.array([list(b) for b in col(cells[0]).to_pylist()], "u1").reshape(len(rows), -1) if cells else None
        shared = spark.sparkContext.broadcast((col(query_id), matrix(vecs, width), Rules({c: col(c).to_pylist() for c in q_extra}) if q_extra and len(rows) else None, bits))
        if "tenant_id" in q_extra and "tenant_id" in i_extra:
            asking = sorted({t for t in col("tenant_id").to_pylist() if t is not None})
            read = read.where(F.col("tenant_id").isin(asking)) if len(asking) <= 1000 else read  # a hint for the scan: the rules hold anyway
        kinds = [arrow_type(f.dataType) for f in schema]
        names = schema.names

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, m, seen, bits = shared.value
            best = Nearest(m, k, digits, pa.types.is_string(kinds[1]))
            for batch in batches if len(ids) else ():
                for lo, n in pieces(batch.column(1)) if item_text else [(0, batch.num_rows)]:
                    b = batch.slice(lo, n)
                    x = hash_embed(b.column(1).to_pylist(), width) if item_text else matrix(b.column(1), width)
                    ids_ = keys(b.column(0))
                    extra = {c: b.column(2 + j).to_pylist() for j, c in enumerate(i_extra)}
                    for of, at in [(np.arange(n), None)] if bits is None else _by_cell(b.column(b.num_columns - 1), bits):
                        step = best.rows(None if at is None else len(at))
                        for i in range(0, len(of), step):
                            own = of[i : i + step]
                            may = None if seen is None else seen.of({c: [v[j] for j in own] for c, v in extra.items()}, len(own))
                            best.add(ids_[own], x[own], may if at is None or may is None else may[at], at)
            q, i, s = best.found()
            for lo in range(0, len(q), 1 << 16):
                at = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q[at])), unkeyed(i[at], kinds[1]), pa.array(s[at])], names=names)

        return read.mapInArrow(run, schema), shared

    few = asked.limit(FEW + 1).toArrow()
    if few.num_rows <= FEW and few.nbytes <= SHARD_BYTES:
        return search(few, read)[0].withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    asked = written(asked, "top-k-queries")
    n, width = asked.agg(F.count("*"), F.max(F.size(query_vec))).first()
    shards = max(1, -(-n * max(1, width) * 8 // SHARD_BYTES))
    asked, _ = written_at(asked.withColumn("_shard", F.pmod(F.xxhash64(query_id), F.lit(shards)).cast("int")).repartition(shards, "_shard"), "top-k-shards", "_shard")
    tasks = spark.sparkContext.defaultParallelism
    read = written(read.repartition(tasks, cells[1]).sortWithinPartitions(cells[1]) if cells else read.repartition(tasks), "top-k-items")
    at = folder(spark, "top-k")
    for shard in range(shards):
        found, shared = search(asked.where(F.col("_shard") == shard).drop("_shard").toArrow(), read)
        found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).write.mode("append").option("compression", "zstd").parquet(at)
        shared.destroy()
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())])).parquet(at)


#: Stands for a null id in a task.
NO_ID = -(1 << 63)


def keys(column: pa.Array) -> np.ndarray:
    """Ids as ``Nearest`` takes them."""
    return np.array(column.to_pylist(), object) if pa.types.is_string(column.type) else column.cast(pa.int64()).fill_null(NO_ID).to_numpy()


def unkeyed(ids: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array([None if v == NO_ID else v for v in ids.tolist()], kind)


def _by_cell(column: pa.Array, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each cell of the items' ``column``: the numbers of its items, and of the requests that look at it."""
    cell = column.to_numpy(zero_copy_only=False)
    order = np.argsort(cell, kind="stable")
    start = np.flatnonzero(np.diff(cell[order], prepend=-1))
    for lo, hi in zip(start.tolist(), [*start[1:].tolist(), len(order)]):
        c = int(cell[order[lo]])
        at = np.flatnonzero(bits[:, c >> 3] >> (7 - (c & 7)) & 1)
        if len(at):
            yield order[lo:hi], at


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column as a matrix; null ones are zero."""
    flat = column.flatten()
    if column.null_count == 0 and flat.null_count == 0 and len(flat) == len(column) * width:
        return flat.to_numpy(zero_copy_only=False).astype("f8").reshape(-1, width)
    return np.array([v if v is not None else [0.0] * width for v in column.to_pylist()], "f8").reshape(-1, width)


def arrow_type(kind: T.DataType) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}[kind.simpleString()]
