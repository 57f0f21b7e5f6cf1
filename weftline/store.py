"""The chunk table of an engine: a base, deltas and tombstones, each committed as a whole.

    root/v00000001-base/chunks, model, commit
    root/v00000002-delta/chunks, gone, model, commit

A version counts once its ``commit`` has been written, which comes last, so a reader never sees half a write and a failed
one leaves the table as it was. A delta has the chunks that it adds and the documents (tenant_id, doc_id) whose older
chunks are gone, so ingesting a batch costs what the batch has. ``compact`` folds all into a new base; it runs by itself
after ``compact_after`` deltas. Chunks are partitioned by tenant. One writer at a time is assumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import ingest
from weftline.operators.retrieve import hinted
from weftline.shared import remove

COLUMNS = ["tenant_id", "doc_id", "chunk", "chunk_id", "text", "tokens", "source", "ts", "acl", "metadata", "embedding"]
SCHEMA = "tenant_id string, doc_id string, chunk int, chunk_id string, text string, tokens int, source string, ts double, acl array<string>, metadata map<string,string>, embedding array<double>"
GONE = "tenant_id string, doc_id string"


class ChunkStore:
    def __init__(self, spark: SparkSession, root: str, compact_after: int = 16):
        self.spark, self.root, self.compact_after = spark, root.rstrip("/"), compact_after

    def versions(self) -> list[str]:
        """Names of the committed versions from the newest base on, oldest first."""
        path, conf = self.spark._jvm.org.apache.hadoop.fs.Path, self.spark._jsc.hadoopConfiguration()
        root = path(self.root)
        fs = root.getFileSystem(conf)
        if not fs.exists(root):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith("v"))
        done = [n for n in names if fs.exists(path(f"{self.root}/{n}/commit/_SUCCESS"))]
        base = max((i for i, n in enumerate(done) if n.endswith("-base")), default=0)
        return done[base:]

    def _read(self, names: list[str], part: str, schema: str) -> DataFrame:
        out = None
        for n in names:
            one = self.spark.read.schema(schema).parquet(f"{self.root}/{n}/{part}").withColumn("_version", F.lit(int(n[1:9])))
            out = one if out is None else out.unionByName(one)
        return out

    def chunks(self) -> DataFrame | None:
        """The live chunks; null if there never was a write."""
        names = self.versions()
        if not names:
            return None
        rows = self._read(names, "chunks", SCHEMA)
        if len(names) > 1:
            gone = self._read(names[1:], "gone", GONE).select(F.col("tenant_id").alias("_t"), F.col("doc_id").alias("_d"), F.col("_version").alias("_g"))
            rows = rows.join(hinted(gone), (F.col("tenant_id") == F.col("_t")) & (F.col("doc_id") == F.col("_d")) & (F.col("_version") < F.col("_g")), "left_anti")
        return rows.select(*COLUMNS)

    def model(self) -> tuple[str, int]:
        """Name and dimension of the model that embedded the chunks; ('', 0) if there are none."""
        names = self.versions()
        row = self.spark.read.schema("model string, dim int").json(f"{self.root}/{names[-1]}/model").first() if names else None
        return (row["model"], row["dim"]) if row else ("", 0)

    def write(self, model: tuple[str, int], chunks: DataFrame | None = None, gone: DataFrame | None = None, base: bool = False) -> str:
        """A version: ``chunks`` added, and all older ones of the documents in ``gone`` dropped."""
        names = self.versions()
        name = f"v{int(names[-1][1:9]) + 1 if names else 1:08d}-{'base' if base or not names else 'delta'}"
        at = f"{self.root}/{name}"
        nothing = lambda schema: self.spark.createDataFrame([], schema)
        (chunks.select(*COLUMNS) if chunks is not None else nothing(SCHEMA)).write.mode("overwrite").partitionBy("tenant_id").parquet(f"{at}/chunks")
        if not name.endswith("-base"):
            (gone.select("tenant_id", "doc_id").distinct() if gone is not None else nothing(GONE)).write.mode("overwrite").parquet(f"{at}/gone")
        one = self.spark.createDataFrame([model], "model string, dim int").coalesce(1)
        one.write.mode("overwrite").json(f"{at}/model")
        one.write.mode("overwrite").json(f"{at}/commit")
        if len(names) > self.compact_after and not base:
            self.compact()
        return name

    def missing(self, made: DataFrame) -> DataFrame:
        """Those of the new chunks whose key the table lacks. Of the table only keys are read, and only those of new chunks are kept."""
        new = made.dropDuplicates(ingest.KEY)
        now = self.chunks()
        if now is None:
            return new
        there = now.select(*ingest.KEY).join(hinted(new.select(*ingest.KEY)), ingest.KEY, "left_semi")
        return new.join(there, ingest.KEY, "left_anti")

    def compact(self) -> None:
        """A new base of the live chunks. The chain before it is kept for those who still read it; older ones go."""
        names = self.versions()
        if len(names) < 2:
            return
        self.write(self.model(), self.chunks(), base=True)
        path, conf = self.spark._jvm.org.apache.hadoop.fs.Path, self.spark._jsc.hadoopConfiguration()
        root = path(self.root)
        for s in root.getFileSystem(conf).listStatus(root):
            old = s.getPath().getName()
            if old.startswith("v") and old < names[0]:
                remove(self.spark, f"{self.root}/{old}")

    def tombstones(self) -> DataFrame:
        """(vectors, live, ratio): how much of what is stored belongs to deleted rows."""
        stored = self._read(self.versions(), "chunks", SCHEMA).agg(F.count("*").alias("vectors"))
        live = self.chunks().agg(F.count("*").alias("live"))
        return stored.crossJoin(live).withColumn("ratio", F.round(F.coalesce(F.try_divide(F.col("vectors") - F.col("live"), F.col("vectors")), F.lit(0.0)), 6))
