"""Documents to chunks, and the upkeep of chunk tables: snapshots in, snapshots out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.config import Config
from weftline.functions import chunking, text, vectors
from weftline.shared import written

KEY = ["tenant_id", "doc_id", "chunk"]


class ModelMismatch(ValueError):
    """The table was embedded with another model."""


def chunk_documents(docs: DataFrame, cfg: Config = Config(), column: str = "text") -> DataFrame:
    """A row for each chunk: the columns of ``docs`` with ``column`` cut, ``chunk`` (0-based), ``chunk_id`` and ``tokens``."""
    columns = [c for c in docs.columns if c not in ("chunk", "chunk_id", "tokens")]
    base = docs.select(*columns)
    schema = T.StructType([*base.schema.fields, T.StructField("chunk", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                at = b.schema.get_field_index(column)
                cut = [chunking.chunks(t, cfg.chunk_tokens, cfg.chunk_overlap, cfg.fence_aware) for t in b.column(at).to_pylist()]
                rows = b.take(pa.array([i for i, c in enumerate(cut) for _ in c], pa.int64()))
                cols = list(rows.columns)
                cols[at] = pa.array([x for c in cut for x in c], pa.string())
                yield pa.RecordBatch.from_arrays([*cols, pa.array([i for c in cut for i in range(len(c))], pa.int32())], names=[f.name for f in schema])

    made = base.mapInArrow(run, schema)
    return made.withColumn("chunk_id", F.concat_ws(":", "doc_id", "chunk")).withColumn("tokens", text.token_count(column))


def embed_chunks(chunks: DataFrame, cfg: Config = Config(), model=None) -> DataFrame:
    return vectors.embed(chunks, "text", "embedding", cfg.dim, model)


def add(existing: DataFrame, new: DataFrame, key: list[str] = KEY) -> DataFrame:
    """``existing`` and those rows of ``new`` whose key it lacks; of equal new keys one."""
    fresh = new.dropDuplicates(key).join(existing.select(*key), key, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def delete(existing: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    return existing.join(ids.select(*on).distinct(), on, "left_anti")


def update(existing: DataFrame, new: DataFrame, document: list[str] = KEY[:2], key: list[str] = KEY) -> DataFrame:
    """All chunks of the updated documents replaced, within their tenant."""
    return delete(existing, new, document).unionByName(new.dropDuplicates(key).select(*existing.columns))


def compact(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows numbered anew from 0 in their order.

    Numbers need only be dense and ordered: rows are range-partitioned and numbered in their partition, from where
    the partitions before end. No single task sees all rows. They are written once, so that the numbers hold if a
    task runs again.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    kept = written(ranged.withColumn("_at", F.monotonically_increasing_id() % (1 << 33)), "compacted")
    before = kept.groupBy("_part").agg(F.count("*").alias("_n"))
    before = before.withColumn("_from", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    return kept.join(F.broadcast(before.select("_part", F.coalesce("_from", F.lit(0)).alias("_from"))), "_part").withColumn("row", F.col("_from") + F.col("_at")).drop("_part", "_at", "_from")


def tombstones(vectors_: DataFrame, live: DataFrame, key: list[str]) -> DataFrame:
    """(vectors, live, ratio): how much of the vector table belongs to deleted rows."""
    v = vectors_.agg(F.count("*").alias("vectors"))
    n = live.join(vectors_.select(*key), key, "left_semi").agg(F.count("*").alias("live"))
    return v.crossJoin(n).withColumn("ratio", F.round(F.coalesce(F.try_divide(F.col("vectors") - F.col("live"), F.col("vectors")), F.lit(0.0)), 6))


def check_model(stored: str, current: str) -> None:
    if stored and stored != current:
        raise ModelMismatch(f"embedded with {stored}, not {current}; embed again or change the model")
