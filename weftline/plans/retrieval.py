"""Queries of recall, fusion, reranking and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.config import Config, Weights
from weftline.functions import vectors
from weftline.operators import rank, retrieve
from weftline.plans import base
from weftline.shared import written

CFG = Config()


def vector_topk(spark, sf_dir):
    """The ten nearest of every embedding, itself among them."""
    e = base.table(spark, sf_dir, "embeddings")
    return vectors.top_k(e.select(F.col("vec_id").alias("query_id"), "embedding"), e.select("vec_id", "embedding"), 10, "query_id", "vec_id")


VECTOR_TOPK = """select query_id, vec_id, similarity, rank::integer rank from (
  select q.vec_id query_id, d.vec_id, s similarity, row_number() over (partition by q.vec_id order by s desc, d.vec_id) rank
  from embeddings q, embeddings d, lateral (select round(list_dot_product(q.embedding::double[], d.embedding::double[]), 9) s)) where rank <= 10"""


def _recall(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = base.documents(spark, sf_dir)
    req = base.requests(spark, sf_dir)
    vec = retrieve.vector_top_k(base.with_vectors(req, "user_message"), docs, CFG.recall_k, "doc_id", "text")
    return req, docs, vec


def document_topk(spark, sf_dir):
    return _recall(spark, sf_dir)[2]


VEC_CTE = f"""{base.DOCS}, {base.REQUESTS}, {base.vector_cte('dv', 'docs', 'doc_id', 'text')}, {base.vector_cte('rv', 'requests', 'request_id', 'user_message')}, dots as (
  select request_id, doc_id, sum(dv.weight * rv.weight) s from rv join dv using (bucket) group by all
), visible as (select request_id, doc_id from requests r join docs d on {base.VISIBLE}
), vec as (
  select * from (select request_id, doc_id, similarity, row_number() over (partition by request_id order by similarity desc, doc_id)::integer as rank
    from (select request_id, doc_id, round(coalesce(s, 0), 9) similarity from visible left join dots using (request_id, doc_id))) where rank <= {CFG.recall_k}
)"""
DOCUMENT_TOPK = f"with {VEC_CTE} select request_id, doc_id, similarity, rank from vec"


def lexical_topk(spark, sf_dir):
    return retrieve.lexical_top_k(base.requests(spark, sf_dir), base.documents(spark, sf_dir), CFG.recall_k, "doc_id")


LEX_CTE = f"""postings as (
  select doc_id, term, count(*)::double tf from (select doc_id, unnest({base.terms('text')}) term from docs) group by all
), dfs as (select term, count(*)::double df from postings group by term
), sizes as (select doc_id, len({base.terms('text')})::double dl from docs
), stats as (select count(*)::double n, avg(dl) avgdl from sizes
), wanted as (select distinct request_id, term from (select request_id, unnest({base.terms('user_message')}) term from requests) where length(term) > 1
), lex as (
  select * from (select request_id, doc_id, bm25, row_number() over (partition by request_id order by bm25 desc, doc_id)::integer as rank from (
    select request_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) bm25
    from wanted join postings using (term) join dfs using (term) join sizes using (doc_id) join stats on true
      join requests r using (request_id) join docs d using (doc_id) where {base.VISIBLE} group by all)) where rank <= {CFG.recall_k}
)"""
LEXICAL_TOPK = f"with {base.DOCS}, {base.REQUESTS}, {LEX_CTE} select request_id, doc_id, bm25, rank from lex"


def metadata_topk(spark, sf_dir):
    """Both legs for requests of which most want one source, some one that no document has."""
    req = base.requests(spark, sf_dir).withColumn("metadata_filter", F.expr("case request_id % 4 when 0 then null when 1 then map('source', 'none of them') else map('source', concat('src', request_id % 12)) end"))
    docs = base.documents(spark, sf_dir)
    vec = retrieve.vector_top_k(base.with_vectors(req, "user_message"), docs, CFG.recall_k, "doc_id", "text")
    lex = retrieve.lexical_top_k(req, docs, CFG.recall_k, "doc_id")
    return vec.select("request_id", "doc_id", F.lit("vector").alias("leg"), F.col("similarity").alias("score"), "rank").unionByName(lex.select("request_id", "doc_id", F.lit("words").alias("leg"), F.col("bm25").alias("score"), "rank"))


def _fused(spark, sf_dir):
    req, docs, vec = _recall(spark, sf_dir)
    return req, docs, retrieve.fuse(vec, retrieve.lexical_top_k(req, docs, CFG.recall_k, "doc_id"), CFG, "doc_id")


def rrf_fusion(spark, sf_dir):
    f = _fused(spark, sf_dir)[2]
    return f.select("request_id", "doc_id", F.round("rrf", 9).alias("rrf"), "vec_rank", "lex_rank", "rank")


FUSED_CTE = f"""{VEC_CTE}, {LEX_CTE}, fused as (
  select * from (select request_id, doc_id, v.similarity, v.rank vec_rank, l.rank lex_rank,
      coalesce(1.0::double / ({CFG.rrf_k} + v.rank), 0) + coalesce(1.0::double / ({CFG.rrf_k} + l.rank), 0) rrf,
      row_number() over (partition by request_id order by round(coalesce(1.0::double / ({CFG.rrf_k} + v.rank), 0) + coalesce(1.0::double / ({CFG.rrf_k} + l.rank), 0), 12) desc, v.rank nulls last, l.rank nulls last)::integer as rank
    from vec v full join lex l using (request_id, doc_id)) where rank <= {CFG.recall_k}
)"""
RRF_FUSION = f"with {FUSED_CTE} select request_id, doc_id, round(rrf, 9) rrf, vec_rank, lex_rank, rank from fused"

WANTED = f"{base.VISIBLE} and case r.request_id % 4 when 0 then true when 1 then false else d.source = 'src' || (r.request_id % 12) end"
METADATA_TOPK = f"""with {VEC_CTE.replace(base.VISIBLE, WANTED)}, {LEX_CTE.replace(base.VISIBLE, WANTED)}
select request_id, doc_id, 'vector' leg, similarity score, rank from vec union all select request_id, doc_id, 'words', bm25, rank from lex"""


def _candidates(spark, sf_dir):
    """Fused candidates with texts and the similarity that lexical hits lack."""
    req, docs, fused = _fused(spark, sf_dir)
    both = fused.join(docs, "doc_id").join(retrieve.hinted(req.select("request_id", "user_message")), "request_id")
    return written(both.drop("rank", "vec_rank", "lex_rank"), "candidates")  # some rows a request, read by what follows


def bm25_local(spark, sf_dir):
    return retrieve.local_bm25(_candidates(spark, sf_dir), "doc_id")


LOCAL_CTE = f"""cand as (select request_id, doc_id, user_message, text, {base.terms('text')} t from fused join requests using (request_id) join docs using (doc_id)
), shape as (select request_id, count(*)::double n, avg(len(t)) avgdl from cand group by request_id
), ctf as (select request_id, doc_id, term, count(*)::double tf from (select request_id, doc_id, unnest(t) term from cand) group by all
), cdf as (select request_id, term, count(*)::double df from ctf group by all
), qtf as (select request_id, term, count(*)::double times from (select request_id, unnest({base.terms('user_message')}) term from requests) group by all
), raw as (
  select request_id, doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avgdl))) s
  from ctf join qtf using (request_id, term) join cdf using (request_id, term) join shape using (request_id) join cand using (request_id, doc_id) group by all
), local as (
  select request_id, doc_id, round(case when max(coalesce(s, 0)) over (partition by request_id) > 0 then coalesce(s, 0) / max(coalesce(s, 0)) over (partition by request_id) else 0 end, 9) bm25
  from cand left join raw using (request_id, doc_id)
)"""
BM25_LOCAL = f"with {FUSED_CTE}, {LOCAL_CTE} select request_id, doc_id, bm25 from local"


def ephemeral_topk(spark, sf_dir):
    """Each conversation's last user turn against its other turns."""
    turns = base.table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id")
    last = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(w)
    v = vectors.embed(turns.withColumn("last", last).where("last is not null"), "text").withColumnRenamed("conv_id", "request_id")
    return retrieve.ephemeral_top_k(v.where("turn = last"), v.where("turn <> last"), CFG, "turn")


EPHEMERAL = f"""with c as (select conv_id, turn, text, conv_id || ':' || turn key, max(case when role = 'user' then turn end) over (partition by conv_id) as last from conversations
), {base.vector_cte('v', 'c', 'key', 'text')}, q as (select conv_id, bucket, weight from v join c using (key) where turn = last
), sims as (select conv_id, turn, round(coalesce(s, 0), 9) similarity from c left join (select conv_id, key, sum(v.weight * q.weight) s from v join c using (key) join q using (conv_id, bucket) where turn <> last group by all) using (conv_id, key) where turn <> last
), ranked as (select conv_id request_id, turn, similarity, row_number() over (partition by conv_id order by similarity desc, turn)::integer as rank from sims)
select request_id, turn, similarity, rank from ranked where rank <= {CFG.ephemeral_k} and similarity >= {CFG.min_similarity}"""


def rerank_minmax(spark, sf_dir):
    """Logits (here label plus first coordinate) scaled within each label, in the place of a model's."""
    e = base.table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("request_id"), "vec_id", (F.col("embedding")[0].cast("double") * 10).alias("raw"))
    out = rank.rescale(e, "raw", "rerank_score")
    return rank.confidence(out, "raw", CFG.abstain_below).select("request_id", "vec_id", F.round("rerank_score", 6).alias("rerank_score"), F.round("confidence", 6).alias("confidence"), "low_confidence")


RERANK = f"""select request_id, vec_id, round((raw - lo) / coalesce(nullif(hi - lo, 0), 1), 6) rerank_score, round(hi, 6) confidence, hi < {CFG.abstain_below} low_confidence
from (select *, min(raw) over (partition by request_id) lo, max(raw) over (partition by request_id) hi from (select label::bigint request_id, vec_id, embedding[1]::double * 10 raw from embeddings))"""


PREFERENCES = ("license", "und", "the")


def rank_blend(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    sims = c.withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    scored = sims.join(retrieve.local_bm25(c, "doc_id"), ["request_id", "doc_id"])
    scored = scored.withColumn("preferences", F.array(*map(F.lit, PREFERENCES))).withColumn("item_source", F.lit("document"))
    blended = rank.blend(rank.identity_rerank(scored), F.lit(base.AS_OF), CFG, source="item_source", order=["doc_id"])
    return blended.select("request_id", "doc_id", "score", "rank")


W = Weights()
BLEND_CTE = f"""{FUSED_CTE}, {LOCAL_CTE}, blended as (
  select request_id, doc_id, text, user_message, similarity, score, row_number() over (partition by request_id order by score desc, doc_id)::integer as rank from (
    select request_id, doc_id, text, user_message, similarity, round({W.rerank} * similarity + {W.similarity} * similarity + {W.bm25} * bm25
        + {W.recency} * exp(-greatest(0, {base.AS_OF} - ts) / {CFG.recency_tau_s}) + {W.importance} * greatest(0, 0.5 * 0.6)
        + {W.preference} * (case when {' or '.join(f"contains(lower(text), '{p}')" for p in PREFERENCES)} then 1 else 0 end), 9) score
    from (select request_id, doc_id, d.text, user_message, d.ts, coalesce(f.similarity, 0) similarity, bm25
      from fused f join docs d using (doc_id) join requests using (request_id) join local using (request_id, doc_id)))
)"""
RANK_BLEND = f"with {BLEND_CTE} select request_id, doc_id, score, rank from blended"

QUERIES = {f.__name__: f for f in (vector_topk, document_topk, lexical_topk, metadata_topk, rrf_fusion, bm25_local, ephemeral_topk, rerank_minmax, rank_blend)}
ORACLE_SQL = {
    "vector_topk": VECTOR_TOPK, "document_topk": DOCUMENT_TOPK, "lexical_topk": LEXICAL_TOPK, "metadata_topk": METADATA_TOPK, "rrf_fusion": RRF_FUSION, "bm25_local": BM25_LOCAL,
    "ephemeral_topk": EPHEMERAL, "rerank_minmax": RERANK, "rank_blend": RANK_BLEND,
}
