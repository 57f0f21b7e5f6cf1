"""Queries of evaluation, on the benchmark's items and the documents that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import vectors
from weftline.operators import evaluate, retrieve
from weftline.plans import base
from weftline.plans.ingest import SENTENCES
from weftline.shared import written

K, DEPTH, TRIALS = 5, 20, 200
STEPS = 5


def _open(df: DataFrame) -> DataFrame:
    """Everything visible to everyone: evaluation is about ranking."""
    return df.withColumn("tenant_id", F.lit("all")).withColumn("acl", F.array().cast("array<string>")).withColumn("principals", F.array().cast("array<string>"))


def _tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    q = base.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("message"))
    return q, base.table(spark, sf_dir, "documents").select("doc_id", "text")


def _labels(q: DataFrame, d: DataFrame) -> DataFrame:
    """Documents that contain a query's text."""
    return evaluate.containing(d, q)


def _rankings(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(config, query_id, doc_id, score, rank) by chance, by vectors, by words, and the labels."""
    q, d = _tables(spark, sf_dir)
    req = _open(q.select(F.col("query_id").alias("request_id"), F.col("message").alias("user_message")))
    items = _open(d)
    vec = retrieve.vector_top_k(vectors.embed(req, "user_message"), items, DEPTH, "doc_id", "text").select(F.lit("vector").alias("config"), F.col("request_id").alias("query_id"), "doc_id", F.col("similarity").alias("score"), "rank")
    lex = retrieve.lexical_top_k(req, items, DEPTH, "doc_id").select(F.lit("lexical").alias("config"), F.col("request_id").alias("query_id"), "doc_id", F.col("bm25").alias("score"), "rank")
    rand = evaluate.random_ranks(q.select("query_id"), d.select("doc_id"), DEPTH).withColumn("config", F.lit("random")).select(vec.columns)
    return written(vec.unionByName(lex).unionByName(rand), "rankings"), written(_labels(q, d), "labels")


def _scored(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    r, labels = _rankings(spark, sf_dir)
    return written(evaluate.per_query(r, labels, K, ["config", "query_id"]), "scored"), r, labels


RANKINGS_CTE = f"""q as (select item_id query_id, text message from benchmark), d as (select doc_id, text from documents),
labels as (select query_id, doc_id from d, q where contains(text, message)),
{base.vector_cte('dv', 'd', 'doc_id', 'text')}, {base.vector_cte('qv', 'q', 'query_id', 'message')},
sims as (select query_id, doc_id, round(coalesce(s, 0), 9) score from (select query_id, doc_id from q, d) left join (select query_id, doc_id, sum(dv.weight * qv.weight) s from qv join dv using (bucket) group by all) using (query_id, doc_id)),
postings as (select doc_id, term, count(*)::double tf from (select doc_id, unnest({base.terms('text')}) term from d) group by all),
dfs as (select term, count(*)::double df from postings group by term), sizes as (select doc_id, len({base.terms('text')})::double dl from d), stats as (select count(*)::double n, avg(dl) avgdl from sizes),
wanted as (select distinct query_id, term from (select query_id, unnest({base.terms('message')}) term from q) where length(term) > 1),
words as (select query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) score
  from wanted join postings using (term) join dfs using (term) join sizes using (doc_id) join stats on true group by all),
numbered as (select doc_id, row_number() over (order by doc_id) - 1 as row from d),
drawn as (
  select query_id, doc_id, row_number() over (partition by query_id order by i)::integer as rank from (
    select query_id, ('0x' || substr(md5(query_id || ':' || i), 1, 8))::bigint % (select count(*) from d) as row, min(i) i from q, unnest(range(0, {2 * DEPTH})) r(i) group by all) join numbered using (row)
), rankings as (
  select 'vector' config, query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id)::integer as rank from sims
  union all select 'lexical', query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id)::integer from words
  union all select 'random', query_id, doc_id, 0.0::double, rank from drawn
), ranked as (select * from rankings where rank <= {DEPTH})"""


def scored_cte(name: str, ranked: str, labels: str, by: str) -> str:
    """Per-query metrics of ``ranked`` (by, query_id, doc_id, rank)."""
    return f"""{name} as (
  select {by}, query_id, coalesce(h, 0) / n::double recall, coalesce(h, 0) / {K}::double as precision, (coalesce(h, 0) > 0)::integer::double hit, coalesce(1.0::double / f, 0) mrr,
         coalesce(g / list_sum(list_transform(range(1, least(n, {K}) + 1), lambda i: 1 / log2(i + 1))), 0) ndcg, f first_rank
  from (select distinct {by} from {ranked}) cross join (select query_id, count(*) n from (select distinct query_id, doc_id from {labels}) group by query_id)
  left join (select {by}, query_id, count(*) filter (rank <= {K}) h, min(rank) f, sum(case when rank <= {K} then 1 / log2(rank + 1) else 0 end) g from {ranked} join (select distinct query_id, doc_id from {labels}) using (query_id, doc_id) group by all) using ({by}, query_id)
)"""


SCORED_CTE = f"{RANKINGS_CTE}, {scored_cte('scored', 'ranked', 'labels', 'config')}"
LONG = " union all ".join(f"select config, query_id, '{m}' metric, {m} as value from scored" for m in evaluate.METRICS)


def eval_rankings(spark, sf_dir):
    return _rankings(spark, sf_dir)[0].select("config", "query_id", "doc_id", "score", "rank")


def eval_metrics(spark, sf_dir):
    s = _scored(spark, sf_dir)[0]
    return s.select("config", "query_id", *(F.round(m, 6).alias(m) for m in evaluate.METRICS))


EVAL_METRICS = f"with {SCORED_CTE} select config, query_id, {', '.join(f'round({m}, 6) as {m}' for m in evaluate.METRICS)} from scored"


def eval_first_rank(spark, sf_dir):
    s, _, _ = _scored(spark, sf_dir)
    n = base.table(spark, sf_dir, "documents").count()
    return evaluate.mean_first_rank(s, F.lit(n), ["config"])


FIRST_RANK = f"with {SCORED_CTE} select config, round(avg(coalesce(first_rank, (select count(*) from documents) + 1)), 6) mean_first_rank from scored group by config"


def eval_bootstrap(spark, sf_dir):
    return evaluate.bootstrap(evaluate.long(_scored(spark, sf_dir)[0], ["config", "query_id"]), ["config", "metric"], "query_id", "value", TRIALS).drop("p_not_above_0")


def bootstrap_cte(source: str, by: str) -> str:
    return f"""groups as (select {by}, list(value order by query_id) v from {source} group by all
), means as (
  select {by}, list_avg(v) a, list_avg(list_transform(range(0, len(v)), lambda i: v[(('0x' || substr(md5(t || ':' || i), 1, 8))::bigint % len(v)) + 1])) m from groups, unnest(range(0, {TRIALS})) r(t)
), cut as (select {by}, round(any_value(a), 6) mean, round(quantile_cont(m, 0.025), 6) low, round(quantile_cont(m, 0.975), 6) high, round(avg((m <= 0)::integer), 6) p from means group by all)"""


BOOTSTRAP = f"with {SCORED_CTE}, long as ({LONG}), {bootstrap_cte('long', 'config, metric')} select config, metric, mean, low, high from cut"


def eval_report(spark, sf_dir):
    means = evaluate.bootstrap(evaluate.long(_scored(spark, sf_dir)[0], ["config", "query_id"]), ["config", "metric"], "query_id", "value", TRIALS)
    return evaluate.report(means)


REPORT = f"""with {SCORED_CTE}, long as ({LONG}), {bootstrap_cte('long', 'config, metric')}, cells as (select config, metric, printf('%.2f [%.2f,%.2f]', round(mean::decimal(18, 6), 2)::double, round(low::decimal(18, 6), 2)::double, round(high::decimal(18, 6), 2)::double) c from cut)
select config, {', '.join(f"max(c) filter (metric = '{m}') as {m}" for m in evaluate.METRICS)} from cells group by config"""


def eval_paired(spark, sf_dir):
    """How much better words rank than vectors, by nDCG."""
    s = _scored(spark, sf_dir)[0]
    return evaluate.paired(s.where("config = 'vector'"), s.where("config = 'lexical'"), "query_id", "ndcg", TRIALS)


PAIRED = f"""with {SCORED_CTE}, diff as (select 0 g, query_id, b.ndcg - a.ndcg as value from (select * from scored where config = 'vector') a join (select * from scored where config = 'lexical') b using (query_id)),
{bootstrap_cte('diff', 'g')} select mean delta, low, high, p, (select round(avg((value > 0)::integer), 6) from diff) win_rate, (select count(*) from diff) n from cut"""


def eval_null_control(spark, sf_dir):
    """Metrics against other queries' labels."""
    r, labels = _rankings(spark, sf_dir)
    s = evaluate.per_query(r, evaluate.permuted(labels), K, ["config", "query_id"])
    return s.groupBy("config").agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


NULL_CTE = f"""ids as (select query_id, row_number() over (order by md5(query_id::varchar)) n, count(*) over () m from (select distinct query_id from labels)),
moved as (select b.query_id, a.query_id target from ids a join ids b on b.n = a.n % a.m + 1), permuted as (select target query_id, doc_id from labels join moved using (query_id)),
{scored_cte('control', 'ranked', 'permuted', 'config')}"""
NULL_CONTROL = f"with {RANKINGS_CTE}, {NULL_CTE} select config, round(avg(recall), 6) recall, round(avg(ndcg), 6) ndcg from control group by config"


def eval_tune(spark, sf_dir):
    """Mean nDCG of mixtures of both signals, each scaled by its best in the query."""
    r, labels = _rankings(spark, sf_dir)
    top = F.max("score").over(Window.partitionBy("config", "query_id"))
    scaled = r.where("config <> 'random'").withColumn("s", F.when(top > 0, F.col("score") / top).otherwise(0.0))
    signals = scaled.groupBy("query_id", "doc_id").agg(F.coalesce(F.max(F.when(F.col("config") == "vector", F.col("s"))), F.lit(0.0)).alias("vector"), F.coalesce(F.max(F.when(F.col("config") == "lexical", F.col("s"))), F.lit(0.0)).alias("lexical"))
    grid = spark.range(STEPS + 1).select(F.col("id").alias("trial"), (F.col("id") / F.lit(float(STEPS))).alias("vector"), (1 - F.col("id") / F.lit(float(STEPS))).alias("lexical"))
    return evaluate.tune(signals, labels, grid, ["vector", "lexical"], K)


TUNE = f"""with {RANKINGS_CTE}, scaled as (select *, case when max(score) over (partition by config, query_id) > 0 then score / max(score) over (partition by config, query_id) else 0 end s from ranked where config <> 'random'),
signals as (select query_id, doc_id, coalesce(max(s) filter (config = 'vector'), 0) a, coalesce(max(s) filter (config = 'lexical'), 0) b from scaled group by all),
trials as (select trial, query_id, doc_id, row_number() over (partition by trial, query_id order by round(a * (trial / {STEPS}::double) + b * (1 - trial / {STEPS}::double), 9) desc, doc_id) as rank from signals, unnest(range(0, {STEPS + 1})) r(trial)),
{scored_cte('tuned', 'trials', 'labels', 'trial')} select trial, round(avg(ndcg), 6) ndcg from tuned group by trial"""


def eval_groundedness(spark, sf_dir):
    """Assistant turns' claims against all user turns of their conversation."""
    c = base.table(spark, sf_dir, "conversations")
    said = c.where("role = 'assistant'").select("conv_id", "turn", F.posexplode(evaluate.claims("text")).alias("i", "text"))
    a = vectors.embed(said.select("conv_id", F.concat_ws(":", "turn", "i").alias("claim_id"), "text"))
    s = vectors.embed(c.where("role = 'user'").select("conv_id", "text"))
    return evaluate.groundedness(a, s, "conv_id", 0.3)


GROUNDEDNESS = f"""with said as (select conv_id, conv_id || ':' || turn || ':' || i key, s[i] claim from (select *, list_filter({SENTENCES.format('text')}, lambda x: length(x) > 8) s from conversations where role = 'assistant'), unnest(range(1, len(s) + 1)) r(i)),
src as (select conv_id, conv_id || ':' || turn key, text from conversations where role = 'user'), {base.vector_cte('av', 'said', 'key', 'claim')}, {base.vector_cte('sv', 'src', 'key', 'text')},
best as (select k, max(round(s, 9)) b from (select av.key k, sv.key, sum(av.weight * sv.weight) s from said join av on av.key = said.key join src using (conv_id) join sv on sv.key = src.key and sv.bucket = av.bucket group by all) group by k)
select conv_id, count(*) claims, count(*) filter (coalesce(b >= 0.3, false)) supported, round(count(*) filter (coalesce(b >= 0.3, false)) / count(*), 6) groundedness from said left join best on k = key group by conv_id"""

EVAL_RANKINGS = f"with {RANKINGS_CTE} select config, query_id, doc_id, score, rank from ranked"
QUERIES = {f.__name__: f for f in (eval_rankings, eval_metrics, eval_first_rank, eval_bootstrap, eval_report, eval_paired, eval_null_control, eval_tune, eval_groundedness)}
ORACLE_SQL = {
    "eval_rankings": EVAL_RANKINGS, "eval_metrics": EVAL_METRICS, "eval_first_rank": FIRST_RANK, "eval_bootstrap": BOOTSTRAP, "eval_report": REPORT,
    "eval_paired": PAIRED, "eval_null_control": NULL_CONTROL, "eval_tune": TUNE, "eval_groundedness": GROUNDEDNESS,
}


def eval_hard_stratum(spark, sf_dir):
    """What words gain or lose on queries that vectors miss at rank one."""
    s = _scored(spark, sf_dir)[0]
    return evaluate.hard_stratum(s.where("config = 'vector'"), s.where("config = 'lexical'"))


HARD = f"""with {SCORED_CTE}, p as (select a.mrr a, b.mrr b from (select * from scored where config = 'vector') a join (select * from scored where config = 'lexical') b using (query_id))
select count(*) queries, count(*) filter (a < 1) hard, round(avg((a < 1)::integer), 6) hard_share, count(*) filter (a < 1 and b > a) improved, count(*) filter (a < 1 and b < a) degraded, count(*) filter (a < 1 and b = a) tied from p"""
QUERIES["eval_hard_stratum"], ORACLE_SQL["eval_hard_stratum"] = eval_hard_stratum, HARD
