"""Queries of the engine as a whole, approximate search and activity windows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftline.config import Config
from weftline.engine import Engine
from weftline.functions import vectors
from weftline.operators import ann
from weftline.plans import base, context, ingest, retrieval
from weftline.shared import shared_dir
from weftline.streaming import pipelines


CFG = Config(max_context_tokens=3000, reserve_output_tokens=500, duplicate_at=0.8)


def engine_answers(spark, sf_dir):
    """All documents chunked and embedded into a snapshot; the benchmark's items answered from it."""
    engine = Engine(spark, f"{shared_dir(spark)}/engine-{uuid.uuid4().hex}", CFG)
    engine.ingest(base.documents(spark, sf_dir).withColumn("source", F.lit("document")))
    got = engine.run_batch(base.requests(spark, sf_dir), F.lit(base.AS_OF))
    return got.select("request_id", "answer", "prompt_tokens", "n_items", "duplicates", "pii_redacted", "ok", "low_confidence")


CHUNK_DOCS = f"""{ingest.CHUNKS_CTE}, docs as (
  select lang || chr(31) || doc_id || ':' || chunk doc_id, c.text, 'document' source, lang tenant_id, ({base.AS_OF} - doc_id * 3600)::double ts,
         case doc_id % 4 when 0 then []::varchar[] when 1 then ['g1'] when 2 then ['g2'] else ['g1', 'g2'] end acl from chunks c join documents d using (doc_id)
)"""
BUDGET = f"greatest(0, trunc(({CFG.max_context_tokens} - {CFG.reserve_output_tokens} - {max(1, (len(CFG.system) + 3) // 4)} - {base.tokens('user_message')}) * {1 - CFG.safety_margin}))::integer"
W = CFG.weights
ENGINE_ANSWERS = f"""with recursive {retrieval.FUSED_CTE.replace(base.DOCS, CHUNK_DOCS)}, {retrieval.LOCAL_CTE}, found as (
  select request_id, doc_id, d.text, d.ts, user_message, round(coalesce(s, 0), 9) similarity from fused f join docs d using (doc_id) join requests using (request_id) left join dots using (request_id, doc_id)
), best as (select * from (select *, row_number() over (partition by request_id order by similarity desc, doc_id) r from found) where r <= {CFG.rerank_k}
), blended as (
  select *, row_number() over (partition by request_id order by score desc, doc_id) n from (
    select best.*, round({W.rerank} * similarity + {W.similarity} * similarity + {W.bm25} * bm25 + {W.recency} * exp(-greatest(0, {base.AS_OF} - ts) / {CFG.recency_tau_s}) + {W.importance} * (0.6 * 0.5)::double, 9) score
    from best join local using (request_id, doc_id)) where similarity >= 0
), alike as (
  select request_id, ny n, list(nx) earlier from (
    select x.request_id, x.n nx, y.n ny from blended x join blended y on x.request_id = y.request_id and x.n < y.n join dv a on a.doc_id = x.doc_id join dv b on b.doc_id = y.doc_id and a.bucket = b.bucket
    group by all having round(sum(a.weight * b.weight), 9) >= {CFG.duplicate_at}) group by all
), chosen(request_id, n, kept) as (
  select request_id, 0::bigint, []::bigint[] from blended where n = 1
  union all
  select c.request_id, b.n, case when list_has_any(c.kept, coalesce(a.earlier, [])) then c.kept else list_append(c.kept, b.n) end
  from chosen c join blended b on b.request_id = c.request_id and b.n = c.n + 1 left join alike a on a.request_id = b.request_id and a.n = b.n
), last as (select request_id, arg_max(kept, n) kept, max(n) total from chosen group by request_id
), ranked as (
  select request_id, doc_id, user_message, text, row_number() over (partition by request_id order by n)::integer as rank from blended join last using (request_id) where list_contains(kept, n)
), {context.COMPRESS_CTE}, costed as (select *, {base.tokens('text')} tokens, {BUDGET} available from compressed), {context.FIT_CTE}, {context.PROMPT_CTE}, lined as (
  select *, list_transform(list_filter(string_split(user, chr(10)), lambda x: regexp_matches(x, '^(- |\\[[0-9]+\\] ).')), lambda x: regexp_replace(x, '^(- |\\[[0-9]+\\] )', '')) l from sized
), hidden as (select request_id, sum(len(regexp_extract_all(text, '\\[REDACTED_')))::bigint n from items group by request_id)
select request_id, '[no model]' || chr(10) || chr(10) || 'Request: ' || regexp_replace(user_message, '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10) || len(l) || ' context line(s), first:' || chr(10)
    || case when len(l) > 0 then array_to_string(list_transform(l[1:4], lambda x: '  * ' || x), chr(10)) else '  (nothing in context)' end answer,
  prompt_tokens, n_items, coalesce(total - len(kept), 0)::bigint duplicates, coalesce(hidden.n, 0)::bigint pii_redacted, true ok, false low_confidence
from lined left join last using (request_id) left join hidden using (request_id)"""


def ann_ivf_recall(spark, sf_dir):
    """How many of every embedding's ten nearest a search of half of the cells finds."""
    e = base.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    placed, centers = ann.index(e)
    found = ann.search(q, placed, centers, 10, max(1, centers.count() // 2), "query_id", "vec_id")
    return ann.recall(found, vectors.top_k(q, e, 10, "query_id", "vec_id"), "query_id", "vec_id")


def activity_windows(spark, sf_dir):
    a = pipelines.activity(base.table(spark, sf_dir, "events"))
    return a.select(F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "event_type", "events")


ACTIVITY = "select epoch_us(date_trunc('day', ts)) start_us, event_type, count(*) events from events group by all"

QUERIES = {f.__name__: f for f in (engine_answers, ann_ivf_recall, activity_windows)}
ORACLE_SQL = {"engine_answers": ENGINE_ANSWERS, "activity_windows": ACTIVITY}
