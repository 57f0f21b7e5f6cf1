"""Incremental loading of a directory against a manifest of content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.shared import written
from weftline.sources import files

KEY = ["tenant_id", "root", "path"]


def listing(spark: SparkSession, root: str, tenant_id: str = "default", glob: str = "*") -> DataFrame:
    """(tenant_id, root, path, sha1) of the files that a loader exists for."""
    found = files.binary(spark, root, glob)
    return found.select(F.lit(tenant_id).alias("tenant_id"), F.lit(root).alias("root"), "path", F.sha1("content").alias("sha1"))


def diff(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """(tenant_id, root, path, action): added, updated, deleted or same."""
    a, b = now.select(*KEY, F.col("sha1").alias("_now")), manifest.select(*KEY, F.col("sha1").alias("_then"))
    action = F.when(F.col("_then").isNull(), "added").when(F.col("_now").isNull(), "deleted").when(F.col("_now") != F.col("_then"), "updated").otherwise("same")
    return a.join(b, KEY, "full_outer").select(*KEY, action.alias("action"))


def apply(manifest: DataFrame, now: DataFrame) -> DataFrame:
    """The manifest after a sync: that of the roots listed is replaced, others stay."""
    return manifest.join(now.select("tenant_id", "root").distinct(), ["tenant_id", "root"], "left_anti").select(*KEY, "sha1").unionByName(now.select(*KEY, "sha1"))


def run(engine, root: str, manifest: DataFrame, tenant_id: str = "default", glob: str = "*", **how) -> tuple[DataFrame, DataFrame]:
    """The engine brought in line with a directory: (the manifest after it, the changes). ``how`` goes to ``files.load``."""
    spark = manifest.sparkSession
    here = (F.col("tenant_id") == tenant_id) & (F.col("root") == root)
    now = written(listing(spark, root, tenant_id, glob), "listing")
    changes = written(diff(now, manifest.where(here)), "changes")
    engine.sync(files.load(spark, root, glob, tenant_id, **how), changes)
    return written(manifest.where(~here).select(*KEY, "sha1").unionByName(now.select(*KEY, "sha1")), "manifest"), changes
