"""Evaluation of an engine on one's own corpus and labelled queries, in one call, and tuning of its weights."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.config import Config, Weights
from weftline.engine import Engine
from weftline.functions import text, vectors
from weftline.operators import evaluate, rank, retrieve
from weftline.shared import written
from weftline.sources import files

SIGNALS = ("rerank", "similarity", "bm25", "recency")


@dataclass
class Evaluation:
    """``scored`` has every metric by config and query, ``means`` their means with intervals, ``report`` the same as text."""

    rankings: DataFrame
    scored: DataFrame
    means: DataFrame
    report: DataFrame
    first_rank: DataFrame
    significance: dict[str, DataFrame]
    failures: list[str]


class RetrievalEvaluator:
    """``queries``: query_id (string) and message; ``labels``: query_id and doc_id of the documents that answer it."""

    def __init__(self, engine: Engine, queries: DataFrame, labels: DataFrame, k: int = 5, depth: int = 20, trials: int = 1000):
        self.engine, self.k, self.depth, self.trials = engine, k, depth, trials
        self.queries, self.labels = written(queries.select(F.col("query_id").cast("string").alias("query_id"), "message"), "queries"), written(labels.select(F.col("query_id").cast("string").alias("query_id"), F.col("doc_id").cast("string").alias("doc_id")), "labels")

    def _requests(self) -> DataFrame:
        """Evaluation is about ranking: everything is visible to everyone."""
        q = self.queries.select(F.col("query_id").alias("request_id"), F.col("message").alias("user_message"), F.lit("all").alias("tenant_id"), F.array().cast("array<string>").alias("principals"))
        return written(vectors.embed(q, "user_message", "embedding", self.engine.cfg.dim, self.engine.model), "eval-requests")

    def _candidates(self) -> DataFrame:
        """Every query's chunks of the two legs, with all signals."""
        cfg, ask = self.engine.cfg, self._requests()
        items = self.engine._items().withColumn("tenant_id", F.lit("all")).withColumn("acl", F.array().cast("array<string>"))
        vec = self.engine.vector_index.search(ask, items, cfg.recall_k, "chunk_key")
        lex = retrieve.lexical_top_k(ask, items, cfg.recall_k, "chunk_key")
        both = vec.select("request_id", "chunk_key", F.col("rank").alias("vec_rank")).join(lex.select("request_id", "chunk_key", F.col("rank").alias("lex_rank")), ["request_id", "chunk_key"], "full_outer")
        both = both.join(items.select("chunk_key", "doc_id", "text", "ts", "embedding"), "chunk_key").join(retrieve.hinted(ask.select("request_id", "user_message", F.col("embedding").alias("_q"))), "request_id")
        both = both.withColumn("similarity", F.round(text.dot(F.col("embedding"), F.col("_q")), 9)).drop("_q", "embedding")
        both = written(both, "eval-found")
        ranked = rank.model_rerank(both, self.engine.reranker) if self.engine.reranker else rank.identity_rerank(both)
        ranked = ranked.join(retrieve.local_bm25(both, "chunk_key"), ["request_id", "chunk_key"])
        part = lambda c: F.coalesce(1.0 / (cfg.rrf_k + F.col(c)), F.lit(0.0))
        newest = F.max("ts").over(Window.partitionBy("request_id"))
        ranked = ranked.withColumn("fused", part("vec_rank") + part("lex_rank")).withColumn("recency", F.exp(-(newest - F.col("ts")) / cfg.recency_tau_s)).withColumnRenamed("rerank_score", "rerank")
        return written(ranked.withColumnRenamed("request_id", "query_id"), "eval-signals")

    def rankings(self, found: DataFrame | None = None) -> DataFrame:
        """(config, query_id, doc_id, rank) by chance, by vectors, by words, fused, and reranked."""
        found = found if found is not None else self._candidates()
        by = {"vector": F.when(F.col("vec_rank").isNotNull(), F.col("similarity")), "lexical": -F.col("lex_rank").cast("double"), "fused": F.col("fused"), "reranked": F.col("rerank")}
        cells = F.explode(F.array(*(F.struct(F.lit(n).alias("config"), s.alias("score")) for n, s in by.items()))).alias("c")
        own = evaluate.document_ranks(found.select("query_id", "doc_id", cells).select("query_id", "doc_id", "c.*").where("score is not null"), ["config", "query_id"])
        docs = self.engine.chunks().select("doc_id").distinct()
        chance = evaluate.random_ranks(self.queries.select("query_id"), docs, self.depth).withColumn("config", F.lit("random"))
        return own.where(F.col("rank") <= self.depth).unionByName(chance.select(own.columns))

    def evaluate_all(self) -> Evaluation:
        """Every config against the labels, the fused one against permuted labels as well, and what speaks against a release."""
        rankings = written(self.rankings(), "eval-rankings")
        scored = evaluate.per_query(rankings, self.labels, self.k, ["config", "query_id"])
        null = evaluate.per_query(rankings.where("config = 'fused'").withColumn("config", F.lit("null")), evaluate.permuted(self.labels), self.k, ["config", "query_id"])
        scored = written(scored.unionByName(null), "eval-scored")
        means = written(evaluate.bootstrap(evaluate.long(scored, ["config", "query_id"]), ["config", "metric"], "query_id", "value", self.trials).drop("p_not_above_0"), "eval-means")
        at = {(r.config, r.metric): r["mean"] for r in means.collect()}
        pick = lambda c: scored.where(F.col("config") == c)
        against = {m: evaluate.paired(pick("vector"), pick("reranked"), "query_id", m, self.trials) for m in ("mrr", "ndcg")}
        first = evaluate.mean_first_rank(scored, F.lit(self.engine.chunks().select("doc_id").distinct().count()), ["config"])
        failures = evaluate.gate(at.get(("reranked", "recall"), 0.0), at.get(("null", "recall"), 0.0), at.get(("random", "recall"), 0.0))
        return Evaluation(rankings, scored, means, evaluate.report(means), first, against, failures)

    def tune(self, trials: int = 60) -> tuple[Weights, DataFrame]:
        """The weights of the best mean nDCG among drawn ones, the present ones first, and (trial, ndcg, weights) of all."""
        found, w = self._candidates(), self.engine.cfg.weights
        best = found.groupBy("query_id", "doc_id").agg(*(F.max(c).alias(c) for c in SIGNALS))
        now = [(0, *(float(getattr(w, c)) for c in SIGNALS))]
        spark = self.engine.spark
        pulls = spark.range(1, trials + 1).select(F.col("id").cast("int").alias("trial"), *(((evaluate.draw(F.col("id"), F.lit(i), F.lit(1000)) + 1) / 1000.0).alias(c) for i, c in enumerate(SIGNALS)))
        grid = written(spark.createDataFrame(now, "trial int, " + ", ".join(f"{c} double" for c in SIGNALS)).unionByName(pulls), "grid")
        got = evaluate.tune(best, self.labels, grid, list(SIGNALS), self.k).join(grid, "trial")
        top = got.orderBy(F.desc("ndcg"), "trial").first()
        total, share = sum(top[c] for c in SIGNALS), sum(getattr(w, c) for c in SIGNALS)
        return replace(w, **{c: round(top[c] / total * share, 6) for c in SIGNALS}), got


def evaluate_files(spark: SparkSession, corpus: str, queries: str, root: str, cfg: Config = Config(), tune: int = 0, **options) -> tuple[Evaluation, Weights | None]:
    """A corpus and labelled queries in JSON Lines, indexed at ``root`` and evaluated; with ``tune`` trials, weights as well."""
    engine = Engine(spark, root, cfg, **options)
    engine.ingest(files.read_corpus(spark, corpus))
    q = files.read_queries(spark, queries).select(F.sha1("query").alias("query_id"), F.col("query").alias("message"), "relevant")
    labels = q.select("query_id", F.explode("relevant").alias("doc_id"))
    e = RetrievalEvaluator(engine, q.select("query_id", "message"), labels)
    return e.evaluate_all(), e.tune(tune)[0] if tune else None
