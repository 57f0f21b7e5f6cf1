"""Approximate nearest neighbours by cells (IVF): k-means centroids, and the cells next to a query are searched exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import vectors


def index(items: DataFrame, cells: int | None = None, vec: str = "embedding", seed: int = 1, sample: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(items with ``cell``, centroids (cell, centroid)); by default as many cells as the root of the items.

    Centroids are fitted on about ``sample`` items at most; every item is placed in the cell of its nearest centroid.
    """
    total = items.count()
    n = cells or max(1, math.isqrt(total))
    n = min(n, items.select(vec).where(F.col(vec).isNotNull()).distinct().limit(n).count())
    kind = "cell int, centroid array<double>"
    if n < 2:  # the fit knows no single cell
        first = items.select(vec).where(F.col(vec).isNotNull()).first()
        return items.withColumn("cell", F.lit(0)), items.sparkSession.createDataFrame([(0, [float(x) for x in first[0]])] if first else [], kind)
    ready = items.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    few = ready if total <= sample else ready.sample(sample / total, seed=seed)
    model = KMeans(k=n, featuresCol="_v", predictionCol="cell", seed=seed, maxIter=10).fit(few)
    centers = items.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], kind)
    return model.transform(ready).drop("_v"), centers


def near(queries: DataFrame, centers: DataFrame, probes: int, vec: str = "embedding") -> DataFrame:
    """``queries`` with ``_cells``: the packed bits of the ``probes`` cells nearest to each.

    Centroids are as many as the fit was asked for, and held by every task; no query meets them as rows.
    """
    found = sorted((r["cell"], r["centroid"]) for r in centers.collect())
    shared = queries.sparkSession.sparkContext.broadcast(np.array([c for _, c in found], "f8").reshape(len(found), -1))
    cells = np.array([c for c, _ in found], "i8")
    bits = 8 * -(-(int(cells.max(initial=0)) + 1) // 8)
    base = queries.drop("_cells")
    schema = T.StructType([*base.schema.fields, T.StructField("_cells", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                looks = np.zeros((b.num_rows, bits), bool)
                if len(cells):
                    sims = vectors.matrix(b.column(b.schema.get_field_index(vec)), shared.value.shape[1]) @ shared.value.T
                    np.put_along_axis(looks, cells[np.argsort(-sims, axis=1, kind="stable")[:, :probes]], True, axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.tobytes() for x in np.packbits(looks, axis=1)], pa.binary())], names=[*b.schema.names, "_cells"])

    return base.mapInArrow(run, schema)


def search(queries: DataFrame, placed: DataFrame, centers: DataFrame, k: int, probes: int, query_id: str, item_id: str, vec: str = "embedding", rules: bool = False) -> DataFrame:
    """(query_id, item_id, similarity, rank) from the ``probes`` cells nearest to each query, in the manner of ``vectors.top_k``."""
    return vectors.top_k(near(queries, centers, probes, vec), placed, k, query_id, item_id, vec, vec, rules=rules, cells=("_cells", "cell"))


def recall(found: DataFrame, exact: DataFrame, query_id: str, item_id: str) -> DataFrame:
    """The share of exact neighbours that were found."""
    hit = exact.select(query_id, item_id).join(found.select(query_id, item_id, F.lit(1).alias("_h")), [query_id, item_id], "left")
    return hit.agg(F.round(F.avg(F.coalesce("_h", F.lit(0))), 6).alias("recall"), F.count("*").alias("neighbours"))
