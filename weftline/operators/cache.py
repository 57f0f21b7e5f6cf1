"""What a response cache would have hit, replayed from a log of lookups."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.config import Config


def _replay(log: DataFrame, by: str, order: list[str], columns: list[str], schema: str, begin: Callable, step: Callable) -> DataFrame:
    """A fold over each ``by``'s rows in their order, as a stream over sorted partitions: a task holds one state, never a group."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                if state is None or row[0] != now:
                    now, state = row[0], begin()
                out.append(step(state, row))
            yield pd.DataFrame(out, columns=names).astype({c: "Int64" for c, k in (x.split() for x in schema.split(", ")) if k in ("bigint", "int")})

    parted = log.select(by, *columns).repartition(by).sortWithinPartitions(by, *order)
    return parted.mapInPandas(run, schema)


def ttl_hits(log: DataFrame, order: list[str], cfg: Config = Config(), by: str | None = None) -> DataFrame:
    """``log`` with ``hit``: the key was computed no longer ago than its time to live, and has not been put out. A miss computes it, a hit doesn't.

    A hit does not renew the entry's time, but counts as its last use: each ``by`` (without it, each key by itself) holds
    ``cache_max_entries`` at most, and the least recently used goes first.
    """
    part = by or "key"
    rest = [c for c in dict.fromkeys(["ts", *order]) if c != part]
    columns = [*([] if part == "key" else ["key"]), *rest]
    kinds = {c: log.schema[c].dataType.simpleString() for c in (part, *columns)}
    key_at, ts_at, most, ttl = 0 if part == "key" else 1, 1 + columns.index("ts"), cfg.cache_max_entries, cfg.cache_ttl_s

    def step(held: OrderedDict, row: tuple) -> tuple:
        key, ts = row[key_at], row[ts_at]
        hit = key in held and ts - held[key] <= ttl
        if not hit:
            held[key] = ts
        held.move_to_end(key)
        while len(held) > most:
            held.popitem(last=False)
        return (*row, hit)

    schema = ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", hit boolean"
    return _replay(log, part, ["ts", *[c for c in order if c != "ts"]], columns, schema, OrderedDict, step)


def hit_rate(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    rate = F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_rate")
    agg = [F.count("*").alias("lookups"), rate]
    return hits.groupBy(*by).agg(*agg) if by else hits.agg(*agg)


class _Vectors:
    """Entries of one scope in the order of their arrival, as rows of one matrix."""

    def __init__(self):
        self.rows, self.n, self.keys = np.zeros((16, 1)), 0, []

    def best(self, v: np.ndarray) -> tuple[int, float]:
        sims = np.round(self.rows[: self.n] @ v, 9)
        j = int(np.argmax(sims))
        return j, float(sims[j])

    def drop(self, j: int) -> None:
        self.rows[j : self.n - 1] = self.rows[j + 1 : self.n].copy()
        del self.keys[j]
        self.n -= 1

    def add(self, v: np.ndarray, key: tuple) -> None:
        if self.rows.shape[1] != len(v):
            self.rows = np.zeros((len(self.rows), len(v)))
        if self.n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.n] = v
        self.keys.append(key)
        self.n += 1


def semantic_hits(log: DataFrame, order: str, by: str = "scope", cfg: Config = Config()) -> DataFrame:
    """(by, order, hit, source): answered by the most similar earlier miss of its scope, if similar enough and alive.

    Rows are taken in the order of ``ts`` and ``order``. A dead entry that would have answered is dropped. A scope holds
    ``cache_max_entries`` at most, and the oldest goes first.
    """
    key_kind = log.schema[order].dataType.simpleString()
    schema = f"{by} {log.schema[by].dataType.simpleString()}, {order} {key_kind}, hit boolean, source {key_kind}"
    ttl, at_least, most = cfg.cache_ttl_s, cfg.cache_hit_at, cfg.cache_max_entries

    def step(held: _Vectors, row: tuple) -> tuple:
        scope, k, ts, v = row
        v = np.asarray(v, float)
        if held.n:
            j, sim = held.best(v)
            if sim >= at_least:
                if ts - held.keys[j][1] <= ttl:
                    return scope, k, True, held.keys[j][0]
                held.drop(j)
        held.add(v, (k, ts))
        if held.n > most:
            held.drop(0)
        return scope, k, False, None

    return _replay(log, by, ["ts", order], [order, "ts", "embedding"], schema, _Vectors, step)


def invalidate(entries: DataFrame, prefix: str = "llm:") -> DataFrame:
    """Entries left once answers are dropped because the corpus changed."""
    return entries.where(~F.startswith("key", F.lit(prefix)))
