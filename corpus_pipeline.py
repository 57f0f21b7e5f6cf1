"""The corpus pipeline: documents to clean, distinct, tokenised documents.

Toxic documents go, of each group of near or exact copies one stays, documents that hold
benchmark passages go, personal data is replaced by labels, and what is left is encoded. Each
stage is written as Parquet to the folder that the cluster names in ``spark.checkpoint.dir``
and read again as the next one's input, so a lost executor never costs more than its stage.

Cases: null or empty texts are kept by every stage and have null or no ids; rows of a null id are
kept, and judged by their text like all others but for the second stage, which compares documents
with an id only. Of repeated rows (one id, one text) one stays, of copies that of the smallest id.
Texts of any length are taken whole. An empty table gives an empty result. Extra columns, whatever
their names, are kept; ``token_ids``, ``n_tokens`` and ``decoded`` of the documents are replaced by
the last stage. Stages set ``spark.sql.execution.arrow.maxRecordsPerBatch`` to at most 1000 rows,
as they are evaluated after they return; ``run``, which evaluates them itself, puts it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, decontaminate, jaccard, pii, toxicity
from weftline.llm.common import table, tokenizer_dir, written


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in batches of fewer rows than Spark's default, whose buffers would take a large part of an executor."""
    if not 0 < int(spark.conf.get(BATCH)) <= rows:
        spark.conf.set(BATCH, rows)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.clean(docs, toxicity.fit_tables(spark, sf_dir))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard.dedup(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = pii.fit(pii.sample(docs, pii.Config().max_docs))
    return pii.without(docs, model, length="n_chars" if "n_chars" in docs.columns else None)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, with ``token_ids``, ``n_tokens`` and the text ``decoded`` from the ids."""
    small_batches(spark)
    vocabulary = f"{tokenizer_dir(spark)}/{bpe.VOCABULARY}"
    return bpe.encode(docs, vocabulary, decoded="decoded", apart=True).withColumn("n_tokens", F.size("token_ids"))


STAGES = [
    ("toxicity", keep_civil),
    ("n-gram Jaccard join", keep_one_copy),
    ("benchmark decontamination", keep_uncontaminated),
    ("PII", replace_personal_data),
    ("byte-level BPE encoding and decoding", encode),
]

#: The first and fourth stage are trained networks, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), spark.conf.get(BATCH)
    try:
        for k, (_, stage) in enumerate(STAGES):
            docs = written(stage(spark, docs, sf_dir), f"stage{k}")
    finally:
        spark.conf.set(BATCH, before)
    return docs
