"""Ingest and answer over a table of chunks: many documents and many requests at a time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.config import Config
from weftline.functions import text, vectors
from weftline.operators import assemble, cache, filter, index, ingest, llm_stage, memory, rank, retrieve, security
from weftline.operators.trace import Trace
from weftline.shared import written
from weftline.store import COLUMNS, ChunkStore

HASH_MODEL = "hash"


@dataclass
class Result:
    """What a batch of requests leaves. ``memories`` and ``cached`` are the new snapshots, where old ones were given."""

    answers: DataFrame
    metrics: DataFrame
    audit: DataFrame
    trace: Trace
    memories: DataFrame | None = None
    cached: DataFrame | None = None


class Engine:
    def __init__(self, spark: SparkSession, root: str, cfg: Config = Config(), model: Callable | None = None, model_name: str = HASH_MODEL, reranker: Callable | None = None, client: Callable | None = None, vector_index: index.VectorIndex | None = None, summarizer: Callable | None = None, client_name: str = "medium"):
        self.spark, self.cfg, self.store = spark, cfg, ChunkStore(spark, root)
        self.model, self.model_name, self.reranker, self.client = model, model_name, reranker, client
        self.vector_index, self.summarizer, self.client_name = vector_index or index.ExactIndex(), summarizer, client_name

    # ------------------------------------------------------------ chunks

    def chunks(self) -> DataFrame | None:
        return self.store.chunks()

    def _check(self) -> None:
        name, dim = self.store.model()
        ingest.check_model(name, self.model_name)
        if name and dim != self.cfg.dim:
            raise ingest.ModelMismatch(f"embedded in {dim} dimensions, not {self.cfg.dim}")

    def _cut(self, docs: DataFrame) -> DataFrame:
        """Chunks without embeddings."""
        has = set(docs.columns)
        empty = F.array().cast("array<string>")
        defaults = {"source": F.lit("document"), "ts": F.lit(0.0), "tenant_id": F.lit("default"), "acl": empty, "metadata": F.create_map().cast("map<string,string>")}
        full = docs.select("doc_id", "text", *[(F.coalesce(F.col(c), d) if c in has else d).alias(c) for c, d in defaults.items()])
        return ingest.chunk_documents(full.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("ts", F.col("ts").cast("double")), self.cfg)

    def _embedded(self, chunks: DataFrame) -> DataFrame:
        return ingest.embed_chunks(chunks, self.cfg, self.model).select(*COLUMNS)

    def ingest(self, docs: DataFrame) -> None:
        """Chunks that are not there yet, embedded and added; running it again changes nothing."""
        self._check()
        fresh = self.store.missing(written(self._cut(docs), "cut"))
        self.store.write((self.model_name, self.cfg.dim), self._embedded(fresh))

    def update(self, docs: DataFrame) -> None:
        """All chunks of these documents replaced, each within its tenant, in one version."""
        self._check()
        cut = written(self._cut(docs), "cut")
        self.store.write((self.model_name, self.cfg.dim), self._embedded(cut.dropDuplicates(ingest.KEY)), cut.select("tenant_id", "doc_id"))

    def delete(self, ids: DataFrame) -> None:
        """``ids`` has tenant_id and doc_id."""
        if self.store.versions():
            self.store.write(self.store.model(), gone=ids.select("tenant_id", F.col("doc_id").cast("string").alias("doc_id")))

    def sync(self, docs: DataFrame, changes: DataFrame) -> None:
        """A directory's changes, as ``sources.sync.diff`` finds them: new and changed files are loaded, lost ones deleted.

        ``docs`` has the text of files by ``doc_id``, which is the path in ``changes``.
        """
        ids = changes.select("tenant_id", F.col("path").alias("doc_id"), "action")
        changed = docs.join(ids.where("action in ('added', 'updated')").select("tenant_id", "doc_id"), ["tenant_id", "doc_id"], "left_semi")
        self.update(changed)
        self.delete(ids.where("action = 'deleted'"))

    def stats(self) -> DataFrame:
        now = self.chunks()
        if now is None:
            return self.spark.createDataFrame([], "tenant_id string, documents bigint, chunks bigint, tokens bigint")
        return now.groupBy("tenant_id").agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"))

    # ------------------------------------------------------------ requests

    def _items(self) -> DataFrame:
        return self.chunks().withColumn("chunk_key", F.concat_ws("\x1f", "tenant_id", "chunk_id"))

    def recall(self, requests: DataFrame) -> DataFrame:
        """(request_id, chunk_key, similarity, rrf, …) of vectors and words, fused; tenant, access and metadata rules hold in both."""
        items = self._items()
        ask = requests if "embedding" in requests.columns else vectors.embed(requests, "user_message", "embedding", self.cfg.dim, self.model)
        vec = self.vector_index.search(ask, items, self.cfg.recall_k, "chunk_key", (self.store.versions() or [""])[-1])
        return retrieve.fuse(vec, retrieve.lexical_top_k(requests, items, self.cfg.recall_k, "chunk_key"), self.cfg, "chunk_key")

    def _asked(self, requests: DataFrame) -> DataFrame:
        has = set(requests.columns)
        none = F.array().cast("array<string>")
        defaults = {"tenant_id": F.lit("default"), "principals": none, "conversation": none, "preferences": none}
        req = requests.select("request_id", "user_message", *(["metadata_filter"] if "metadata_filter" in has else []), *[(F.coalesce(F.col(c), d) if c in has else d).alias(c) for c, d in defaults.items()])
        return written(vectors.embed(req, "user_message", "embedding", self.cfg.dim, self.model).withColumn("scope", memory.scope()), "requests")

    def _own(self, req: DataFrame, as_of: Column, memories: DataFrame | None, sources: dict[str, DataFrame] | None) -> DataFrame:
        """Each request's own items: conversation, what was fetched for it, and memories; the best, and no weaker than the floor."""
        cfg, none = self.cfg, F.lit(None)
        own = llm_stage.collect(req, as_of, sources).where("source <> 'user_message'").withColumn("importance", F.lit(0.0)).withColumn("fact_key", none.cast("string")).withColumn("fact_value", none.cast("string"))
        if memories is not None:
            hits = memory.recall(req, memories, as_of, cfg).join(memories.select("memory_id", "text", "created", "importance", "fact_key", "fact_value"), "memory_id")
            own = own.unionByName(hits.select("request_id", F.lit("long_term_memory").alias("source"), "text", F.col("created").alias("ts"), F.lit(0).alias("pos"), F.when(F.col("pinned"), 1.0).otherwise(F.col("importance")).alias("importance"), "fact_key", "fact_value"))
        own = own.withColumn("item_id", F.concat_ws(":", text.item_id("source", "text"), "pos")).dropDuplicates(["request_id", "item_id"])
        own = vectors.embed(own, "text", "embedding", cfg.dim, self.model)
        best = retrieve.ephemeral_top_k(req, own, cfg).drop("rank")
        return own.join(best, ["request_id", "item_id"]).select("request_id", "item_id", "source", "text", "ts", "importance", "fact_key", "fact_value", none.cast("double").alias("expires_at"), "similarity", "embedding", none.cast("string").alias("doc_id"), none.cast("string").alias("chunk_id"))

    def _found(self, req: DataFrame) -> DataFrame:
        """Chunks for each request. ``expires_at``, ``fact_key`` and ``fact_value`` come from their metadata."""
        q = req.select("request_id", F.col("embedding").alias("_q"))
        far = self.recall(req).select("request_id", "chunk_key", "similarity").join(self._items().drop("tenant_id"), "chunk_key").join(retrieve.hinted(q), "request_id")
        far = far.withColumn("similarity", F.coalesce("similarity", F.round(text.dot(F.col("embedding"), F.col("_q")), 9)))  # found by words alone
        meta = lambda k: F.try_element_at("metadata", F.lit(k))
        return far.select("request_id", F.col("chunk_key").alias("item_id"), "source", "text", "ts", F.lit(0.0).alias("importance"), meta("fact_key").alias("fact_key"), meta("fact_value").alias("fact_value"), F.try_to_number(meta("expires_at"), F.lit("9999999999.999999")).cast("double").alias("expires_at"), "similarity", "embedding", "doc_id", "chunk_id")

    def prepare(self, requests: DataFrame, as_of: Column, memories: DataFrame | None = None, sources: dict[str, DataFrame] | None = None, trace: Trace | None = None) -> DataFrame:
        """A validated prompt for each request, and what is known of it: collect, retrieve, rerank, rank, filter, compress, budget, redact, build, validate."""
        cfg, mark = self.cfg, trace.stage if trace else (lambda _, df: df)
        req = requests if {"embedding", "scope"} <= set(requests.columns) else self._asked(requests)
        told = req.select("request_id", "user_message", "preferences")
        near = mark("collect", self._own(req, as_of, memories, sources))
        found = near if self.chunks() is None else self._found(req).unionByName(near)
        found = written(mark("retrieve", found.join(told, "request_id")), "found")

        ranked = rank.model_rerank(found, self.reranker) if self.reranker else rank.identity_rerank(found)
        ranked = rank.cut(ranked, cfg.rerank_k, [F.desc("rerank_score"), "item_id"])
        ranked = rank.confidence(ranked, "raw_rerank_score", cfg.abstain_below)
        ranked = written(mark("rerank", ranked.join(retrieve.local_bm25(found, "item_id"), ["request_id", "item_id"])), "reranked")
        sure = ranked.groupBy("request_id").agg(F.max("low_confidence").alias("low_confidence"), F.max("confidence").alias("confidence"))
        scored = written(mark("rank", rank.blend(ranked, as_of, cfg)), "ranked")
        kept, stats = filter.apply(scored, as_of, cfg, mark=mark)
        kept = kept.drop("embedding")
        if cfg.abstractive and self.summarizer:
            kept = llm_stage.summarize(kept, self.summarizer, cfg.max_item_tokens)
        small = mark("compress", assemble.compress(kept, cfg))
        room = assemble.available(F.lit(cfg.max_context_tokens), F.lit(cfg.reserve_output_tokens), F.lit(cfg.system), F.col("user_message"), cfg)
        fitted = assemble.fit(small.withColumn("available", room))
        if cfg.redact:
            fitted = assemble.redact_items(fitted, extra=security.FINANCIAL if cfg.redact_financial else (), count="pii")
        else:
            fitted = fitted.withColumn("pii", F.lit(0).cast("bigint"))
        items = written(mark("budget", fitted), "items")
        built = assemble.validate(assemble.prompts(told.select("request_id", "user_message"), items, cfg), cfg)
        flags = assemble.injections(items).groupBy("request_id").agg(F.array_sort(F.collect_list("flag")).alias("injection_flags"))
        private = items.where("included").groupBy("request_id").agg(F.sum("pii").alias("pii_redacted"))
        squeezed = items.groupBy("request_id").agg(F.round(F.sum("tokens") / F.sum("tokens_before"), 6).alias("compress_ratio"), F.sum(F.when(F.col("included"), F.col("tokens"))).alias("context_tokens"), F.count_if(~F.col("included")).alias("trimmed"))
        for df in (sure, flags, private, squeezed, stats):
            built = built.join(df, "request_id", "left")
        fill = {"low_confidence": F.lit(False), "confidence": F.lit(0.0), "injection_flags": F.array().cast("array<string>"), "compress_ratio": F.lit(1.0)}
        fill |= {c: F.lit(0).cast("bigint") for c in ("pii_redacted", "context_tokens", "trimmed", "expired", "low_signal", "contradictions", "duplicates")}
        built = built.withColumns({c: F.coalesce(c, d) for c, d in fill.items()})
        return mark("validate", built.join(req.select("request_id", "tenant_id", "principals", "scope"), "request_id"))

    def run(self, requests: DataFrame, as_of: Column, memories: DataFrame | None = None, cached: DataFrame | None = None, sources: dict[str, DataFrame] | None = None, fetchers: dict[str, Callable] | None = None) -> Result:
        """Requests answered, with everything that a batch leaves.

        ``requests`` has request_id and user_message and may have tenant_id, principals, conversation, preferences and
        metadata_filter. ``memories`` has what ``memory.recall`` reads and text, fact_key and fact_value. ``cached`` is
        the log of answers of earlier batches (scope, entry, ts, embedding, answer): a prompt as similar to one of its
        scope as ``cache_hit_at`` gets that answer. ``sources`` are items by source, ``fetchers`` functions that fetch
        them. A prompt that isn't ``ok`` is blocked and has no effect on memory or cache.
        """
        trace, req = Trace(), self._asked(requests)
        if fetchers:
            got = written(llm_stage.fetch(req, fetchers), "fetched")
            sources = (sources or {}) | {name: got.where(F.col("source") == name) for name in fetchers}
        built = written(self.prepare(req, as_of, memories, sources, trace), "built")
        ask, hits = built, None
        if cached is not None:
            fresh = vectors.embed(built.where("ok").select("scope", F.concat(F.lit("r"), F.col("request_id").cast("string")).alias("entry"), as_of.cast("double").alias("ts"), "user"), "user", "embedding", self.cfg.dim, self.model).drop("user")
            log = written(cached.select("scope", "entry", "ts", "embedding").unionByName(fresh), "lookups")
            hits = cache.semantic_hits(log, "entry", cfg=self.cfg).join(fresh.select("scope", "entry"), ["scope", "entry"], "left_semi")
            hits = written(hits, "hits")
            known = hits.where("hit").select(F.col("entry").alias("_e"), "source")
            ask = built.withColumn("_e", F.concat(F.lit("r"), F.col("request_id").cast("string"))).join(known, "_e", "left_anti").drop("_e")
        answered = written(llm_stage.respond(ask, self.client), "answered")
        if cached is not None:
            old = cached.select(F.col("entry").alias("_s"), F.col("answer").alias("_a"))
            new = answered.select(F.concat(F.lit("r"), F.col("request_id").cast("string")).alias("_s"), F.col("answer").alias("_a"))
            again = built.withColumn("_e", F.concat(F.lit("r"), F.col("request_id").cast("string"))).join(known, "_e").join(old.unionByName(new), F.col("source") == F.col("_s"), "left")
            again = llm_stage.from_cache(again.withColumn("answer", F.col("_a"))).select(*answered.columns)
            answered = written(answered.unionByName(again), "answers")
            misses = log.join(hits.where("not hit").select("scope", "entry"), ["scope", "entry"], "left_semi")
            cached = written(cached.select("scope", "entry", "ts", "embedding", "answer").unionByName(misses.join(new, F.col("entry") == F.col("_s")).select("scope", "entry", "ts", "embedding", F.col("_a").alias("answer"))), "cached")
        if memories is not None:
            memories = written(self.remember(req, answered, memories, as_of), "memories")
        facts = {"embed_backend": self.model_name, "index_backend": self.vector_index.name, "rerank_backend": "model" if self.reranker else "identity", "indexed_chunks": 0 if self.chunks() is None else self.chunks().count()}
        metrics = llm_stage.finalize(answered, self.client_name, facts)
        audit = llm_stage.log_lines(metrics.join(answered.select("request_id", "tenant_id", "principals", "user_message", F.transform("sources", lambda s: s["chunk_id"]).alias("retrieved_chunks")), "request_id").select("request_id", "tenant_id", "principals", F.col("user_message").alias("query"), "retrieved_chunks", "low_confidence", F.col("llm_backend").alias("backend"), "cost_usd"))
        return Result(answered, metrics, audit, trace, memories, cached)

    def remember(self, req: DataFrame, answered: DataFrame, memories: DataFrame, as_of: Column) -> DataFrame:
        """``memories`` with what the answered requests leave, facts written over and the store kept to its bound."""
        done = req.join(answered.where("ok").select("request_id"), "request_id", "left_semi")
        new = memory.capture(done, as_of).withColumn("memory_id", F.concat_ws(":", "scope", text.item_id("mtype", "text"), "request_id"))
        new = vectors.embed(new, "text", "embedding", self.cfg.dim, self.model)
        has = set(new.columns)
        plain = {"uses": F.lit(0), "last_used": as_of, "ttl_s": F.lit(None).cast("double"), "pinned": F.lit(False)}
        full = new.select(*[(F.col(c) if c in has else plain.get(c, F.lit(None))).cast(memories.schema[c].dataType).alias(c) for c in memories.columns])
        return memory.evict(memory.upsert(memories.unionByName(full), ["created", "memory_id"]), as_of, self.cfg.memory_bound, self.cfg)

    def run_batch(self, requests: DataFrame, as_of: Column, memories: DataFrame | None = None) -> DataFrame:
        """The answers of ``run``: a row for each request."""
        return self.run(requests, as_of, memories).answers
