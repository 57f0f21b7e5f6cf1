"""Text, Markdown, HTML, PDF and JSON Lines files as documents, and back."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text

TEXT, HTML, PDF = ("txt", "text", "md", "markdown"), ("html", "htm"), ("pdf",)
DOCUMENT = "doc_id string, text string, source string, metadata map<string,string>, ts double, tenant_id string, acl array<string>"
CORPUS = "doc_id string, text string, metadata map<string,string>, tenant_id string, acl array<string>"
QUERY = "query string, relevant array<string>, note string"


def suffix(path: str):
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def binary(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, content, modificationTime) of files below ``root`` that a loader exists for."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("ignoreCorruptFiles", "true").load(root)
    return found.where(suffix("path").isin(*TEXT, *HTML, *PDF))


def pdf_text(found: DataFrame) -> DataFrame:
    """(path, text) of PDF files; needs the optional package pypdf on the executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pypdf

        for f in frames:
            pages = [[p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(c)).pages] for c in f["content"]]
            yield pd.DataFrame({"path": f["path"], "text": ["\n\n".join(p) for p in pages]})

    return found.select("path", "content").mapInPandas(run, "path string, text string")


def load(spark: SparkSession, root: str, glob: str = "*", tenant_id: str = "default", acl: list[str] | None = None, source: str = "document", as_of: float | None = None, pdf: bool = False) -> DataFrame:
    """Files below ``root`` as rows of ``DOCUMENT``; others than ours are passed over. Bytes that aren't UTF-8 are replaced."""
    found = binary(spark, root, glob)
    plain = F.make_valid_utf8(F.col("content").cast("string"))
    read = found.where(~suffix("path").isin(*PDF)).withColumn("_t", plain)
    docs = read.select("path", F.when(suffix("path").isin(*HTML), text.html_text("_t")).otherwise(F.col("_t")).alias("text"), F.unix_micros("modificationTime").alias("_us"))
    if pdf:
        docs = docs.unionByName(pdf_text(found.where(suffix("path").isin(*PDF))).withColumn("_us", F.lit(0).cast("bigint")))
    ts = F.lit(as_of).cast("double") if as_of is not None else F.col("_us") / 1e6
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    access = F.array(*map(F.lit, acl or [])).cast("array<string>")
    return docs.select(F.col("path").alias("doc_id"), "text", F.lit(source).alias("source"), F.create_map(F.lit("path"), F.col("path"), F.lit("filename"), name).alias("metadata"), ts.alias("ts"), F.lit(tenant_id).alias("tenant_id"), access.alias("acl"))


def load_file(spark: SparkSession, path: str, **how) -> DataFrame:
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in (*TEXT, *HTML, *PDF):
        raise ValueError(f"no loader for .{kind}")
    return load(spark, path, pdf=kind in PDF, **how)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines of documents; blank lines are passed over, missing fields get defaults."""
    rows = spark.read.schema(CORPUS).json(path).where("text is not null or doc_id is not null")
    empty = F.array().cast("array<string>")
    return rows.select(F.coalesce("doc_id", F.lit("")).alias("doc_id"), "text", F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"), F.coalesce("tenant_id", F.lit("default")).alias("tenant_id"), F.coalesce("acl", empty).alias("acl"))


def write_corpus(docs: DataFrame, path: str, mode: str = "error") -> None:
    """All of ``CORPUS``, tenant and access list included."""
    docs.select("doc_id", "text", "metadata", "tenant_id", "acl").write.mode(mode).json(path)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUERY).json(path).where("query is not null").withColumn("note", F.coalesce("note", F.lit("")))


def write_queries(queries: DataFrame, path: str, mode: str = "error") -> None:
    queries.select("query", "relevant", "note").write.mode(mode).json(path)


FEEDBACK = "request_id string, query string, rating int, relevant array<string>, note string, ts double"


def write_feedback(rows: DataFrame, path: str) -> None:
    """Ratings of answers added to a folder of JSON Lines; columns of ``FEEDBACK`` that are missing are null."""
    kinds = dict(f.split() for f in FEEDBACK.split(", "))
    rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]).write.mode("append").json(path)


def feedback_queries(spark: SparkSession, path: str) -> DataFrame:
    """Positive ratings as labelled queries: (query, relevant, note), all that any rating of a query names."""
    rated = spark.read.schema(FEEDBACK).json(path).where("rating > 0 and query is not null")
    named = rated.select("query", F.explode_outer("relevant").alias("doc"))
    return named.groupBy("query").agg(F.array_sort(F.collect_set("doc")).alias("relevant")).withColumn("note", F.lit("feedback"))
