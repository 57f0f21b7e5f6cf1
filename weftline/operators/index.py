"""Vector indexes that an engine may use: exact, cells (IVF), or the client of a vector database."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import ann, retrieve


class VectorIndex(Protocol):
    name: str

    def search(self, requests: DataFrame, items: DataFrame, k: int, item_id: str, version: str = "") -> DataFrame:
        """(request_id, item_id, similarity, rank) of items that the request may see; ``version`` names the state of ``items``."""


class ExactIndex:
    name = "exact"

    def search(self, requests: DataFrame, items: DataFrame, k: int, item_id: str, version: str = "") -> DataFrame:
        return retrieve.vector_top_k(requests, items, k, item_id)


class IvfIndex:
    """Cells are fitted once for each version of the items, on a bounded sample; every item is placed.

    Only cells near the request are read, and rules are applied before the cut to ``k``.
    """

    name = "ivf"

    def __init__(self, cells: int | None = None, probes: int = 8, sample: int = 50_000):
        self.cells, self.probes, self.sample = cells, probes, sample
        self.built: tuple = (None, None, None)

    def search(self, requests: DataFrame, items: DataFrame, k: int, item_id: str, version: str = "") -> DataFrame:
        if self.built[0] != version or not version:
            self.built = (version, *ann.index(items, self.cells, sample=self.sample))
        _, placed, centers = self.built
        return ann.search(requests, placed, centers, k, self.probes, "request_id", item_id, rules=True)


class ClientIndex:
    """A vector database behind a client, made once in each task.

    ``connect()`` gives an object with ``search(vector, k, tenant_id, principals, metadata_filter)``, a list of (id,
    similarity), and ``upsert(rows)``, rows being dictionaries of id, embedding, tenant_id, acl and metadata. What the
    client returns is checked against the items again, so a rule that it doesn't know can't leak.
    """

    def __init__(self, connect: Callable, name: str = "client"):
        self.connect, self.name = connect, name

    def upsert(self, items: DataFrame, item_id: str, batch: int = 500) -> int:
        connect = self.connect

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client = connect()
            for f in frames:
                rows = f.rename(columns={item_id: "id"}).to_dict("records")
                for at in range(0, len(rows), batch):
                    client.upsert(rows[at : at + batch])
                yield pd.DataFrame({"n": [len(rows)]})

        return items.select(item_id, "embedding", "tenant_id", "acl", "metadata").mapInPandas(run, "n bigint").agg(F.sum("n")).first()[0] or 0

    def search(self, requests: DataFrame, items: DataFrame, k: int, item_id: str, version: str = "") -> DataFrame:
        connect = self.connect
        kind, key = items.schema[item_id].dataType.simpleString(), requests.schema["request_id"].dataType.simpleString()
        rules = [c for c in ("tenant_id", "principals", "metadata_filter") if c in requests.columns]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client = connect()
            for f in frames:
                out = []
                for r in f.to_dict("records"):
                    wanted = r.get("metadata_filter")
                    hits = client.search(list(r["embedding"]), k, r.get("tenant_id"), list(r["principals"]) if r.get("principals") is not None else [], dict(wanted) if wanted is not None else None)
                    out += [(r["request_id"], i, float(s)) for i, s in hits]
                yield pd.DataFrame(out, columns=["request_id", item_id, "similarity"])

        found = requests.select("request_id", "embedding", *rules).mapInPandas(run, f"request_id {key}, {item_id} {kind}, similarity double")
        ask = requests.select("request_id", *[F.col(c).alias(f"_{c}") for c in rules])
        both = found.join(items.select(item_id, *[c for c in ("tenant_id", "acl", "metadata") if c in items.columns]), item_id).join(retrieve.hinted(ask), "request_id")
        if "tenant_id" in rules:
            both = both.where(retrieve.authorized(F.col("_tenant_id"), F.col("_principals") if "principals" in rules else F.array().cast("array<string>"), F.col("tenant_id"), F.col("acl")))
        if "metadata_filter" in rules:
            both = both.where(retrieve.fits(F.col("metadata"), F.col("_metadata_filter")))
        w = Window.partitionBy("request_id").orderBy(F.desc("similarity"), item_id)
        return both.select("request_id", item_id, F.round("similarity", 9).alias("similarity")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def named(name: str, **options) -> VectorIndex:
    """An index by name: ``exact``, ``ivf`` (cells, probes, sample), or ``client`` (connect, name)."""
    kinds = {"exact": ExactIndex, "ivf": IvfIndex, "client": ClientIndex}
    if name not in kinds:
        raise ValueError(f"no index called {name}; there are {', '.join(kinds)}")
    return kinds[name](**options)
