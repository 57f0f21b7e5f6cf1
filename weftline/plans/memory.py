"""Queries of memory, cache, collection, answers, cost and logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.config import Config
from weftline.functions import vectors
from weftline.operators import cache, llm_stage, memory, security
from weftline.plans import base, context
from weftline.plans.context import EVENTS_AS_OF, FACTS

CFG = Config()
BOUND = 500


def _records(spark, sf_dir):
    """Events as memory records of a scope for each user."""
    f = context._facts(spark, sf_dir)
    k = F.col("fact_value").cast("bigint")
    return f.select(
        F.col("event_id").alias("memory_id"), F.col("request_id").cast("string").alias("scope"), F.concat("fact_key", F.lit(" is "), "fact_value").alias("text"), (k / 100.0).alias("importance"),
        F.col("ts").alias("created"), F.col("ts").alias("last_used"), F.lit(0).cast("bigint").alias("uses"), F.when(F.col("event_id") % 2 == 0, (k + 1) * 3600.0).alias("ttl_s"),
        F.when(F.col("event_id") % 3 > 0, F.col("fact_key")).alias("fact_key"), "fact_value",
    )


RECORDS = f"""{FACTS}, records as (
  select event_id memory_id, request_id::varchar as scope, fact_key || ' is ' || fact_value as text, fact_value::bigint / 100.0::double importance, ts created, ts last_used,
         case when event_id % 2 = 0 then (fact_value::bigint + 1) * 3600.0::double end ttl_s, case when event_id % 3 > 0 then fact_key end fact_key, fact_value from facts
)"""


def memory_upsert(spark, sf_dir):
    return memory.upsert(_records(spark, sf_dir), ["created", "memory_id"]).select("memory_id", "scope", "text", F.round("importance", 6).alias("importance"), "fact_key", "fact_value")


UPSERT = f"""with {RECORDS}, w as (
  select *, row_number() over a n, last_value(text) over b t, last_value(fact_value) over b v, max(importance) over (partition by scope, fact_key) i from records
  window a as (partition by scope, fact_key order by created, memory_id), b as (partition by scope, fact_key order by created, memory_id rows between unbounded preceding and unbounded following))
select memory_id, scope, case when fact_key is null then text else t end as text, round(case when fact_key is null then importance else i end, 6) importance, fact_key,
       case when fact_key is null then fact_value else v end fact_value from w where fact_key is null or n = 1"""


def memory_expire(spark, sf_dir):
    return memory.live(_records(spark, sf_dir), F.lit(EVENTS_AS_OF)).select("memory_id", "scope")


EXPIRE = f"with {RECORDS} select memory_id, scope from records where ttl_s is null or {EVENTS_AS_OF} - created <= ttl_s"


def memory_evict(spark, sf_dir):
    return memory.evict(_records(spark, sf_dir), F.lit(base.AS_OF + 1e7), BOUND).select("memory_id")


EVICT = f"""with {RECORDS}, valued as (select memory_id, round(importance / (1 + greatest(0, {base.AS_OF + 1e7} - last_used) / 86400), 12) v from records where importance < {CFG.pinned_at}),
gone as (select memory_id from (select memory_id, row_number() over (order by v, memory_id) n from valued) where n <= (select greatest(0, count(*) - {BOUND}) from records))
select memory_id from records anti join gone using (memory_id)"""


def _asks(spark, sf_dir):
    """The user turns as requests of the scope that their conversation has."""
    c = base.table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.col("conv_id").cast("string").alias("scope"), "text", "turn", "conv_id")


def memory_topk(spark, sf_dir):
    """Each user turn against the conversation's assistant turns as memory."""
    c = base.table(spark, sf_dir, "conversations").where("role = 'assistant'")
    key = F.col("conv_id") * 1000 + F.col("turn")
    r = c.select(key.alias("memory_id"), F.col("conv_id").cast("string").alias("scope"), "text", (F.col("turn") % 10 / 10.0).alias("importance"), (base.AS_OF - key * 60.0).alias("created"), (base.AS_OF - key * 60.0).alias("last_used"), F.lit(None).cast("double").alias("ttl_s"))
    got = memory.recall(vectors.embed(_asks(spark, sf_dir)), vectors.embed(r), F.lit(base.AS_OF))
    return got.select("request_id", "memory_id", "score", "pinned", "rank")


TOPK = f"""with c as (select conv_id * 1000 + turn id, conv_id, turn, role, text from conversations), {base.vector_cte('v', 'c', 'id', 'text')},
pairs as (select q.id request_id, m.id memory_id, m.turn from c q join c m using (conv_id) where q.role = 'user' and m.role = 'assistant'),
near as (select request_id, memory_id, sum(a.weight * b.weight) s from pairs join v a on a.id = request_id join v b on b.id = memory_id and b.bucket = a.bucket group by all),
scored as (select request_id, memory_id, round(0.6 * coalesce(s, 0) + 0.25 * (turn % 10 / 10.0::double) + 0.15 / (1 + memory_id * 60.0::double / 86400), 9) score, turn % 10 / 10.0::double >= {CFG.pinned_at} pinned from pairs left join near using (request_id, memory_id)),
ranked as (select *, row_number() over (partition by request_id order by score desc, memory_id)::integer as rank from scored)
select request_id, memory_id, score, pinned, rank from ranked where rank <= {CFG.memory_k}"""


def memory_capture(spark, sf_dir):
    """Episodes and facts of all user turns, some of which state something."""
    a = _asks(spark, sf_dir)
    said = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("Team Uses Spark Uses "), F.col("text"))).when(F.col("turn") % 4 == 2, F.concat(F.lit("Ann likes tea. And "), F.col("text"))).otherwise(F.col("text"))
    r = a.select("request_id", said.alias("user_message"), F.lit("default").alias("tenant_id"), F.array().cast("array<string>").alias("principals"))
    return memory.capture(r, F.lit(base.AS_OF)).drop("created")


CAPTURE = r"""with c as (select conv_id * 1000 + turn request_id, case turn % 4 when 0 then 'Team Uses Spark Uses ' || text when 2 then 'Ann likes tea. And ' || text else text end m from conversations where role = 'user'),
f as (select *, lower(m) l, case when contains(lower(m), ' uses ') then ' uses ' when contains(lower(m), ' prefers ') then ' prefers ' when contains(lower(m), ' likes ') then ' likes ' end verb from c)
select request_id, 'global' as scope, 'User asked: ' || substr(regexp_replace(m, '^\s+|\s+$', '', 'g'), 1, 200) as text, 'episodic' mtype, 0.4::double importance, null fact_key, null fact_value from f
union all
select request_id, 'global', regexp_replace(m, '^\s+|\s+$', '', 'g'), 'semantic', 0.7::double, trim(substr(l, 1, instr(l, verb) - 1)) || trim(verb),
       substr(split_part(rtrim(regexp_replace(trim(substr(m, instr(l, verb) + length(verb))), '\.+$', '')), '.', 1), 1, 60) from f where verb is not null"""


def _lookups(spark, sf_dir):
    f = context._facts(spark, sf_dir)
    return f.select(F.concat_ws(":", F.lit("llm"), "fact_value").alias("key"), "ts", "event_id")


def cache_ttl_hits(spark, sf_dir):
    return cache.ttl_hits(_lookups(spark, sf_dir), ["ts", "event_id"]).select("key", "event_id", "hit")


CACHE = f"""with recursive {FACTS}, log as (select 'llm:' || fact_value as key, ts, event_id, row_number() over (partition by fact_value order by ts, event_id) n from facts),
step(key, n, event_id, made, hit) as (
  select key, n, event_id, ts, false from log where n = 1
  union all
  select l.key, l.n, l.event_id, case when l.ts - s.made <= {CFG.cache_ttl_s} then s.made else l.ts end, l.ts - s.made <= {CFG.cache_ttl_s} from step s join log l on l.key = s.key and l.n = s.n + 1
) select key, event_id, hit from step"""


def cache_hit_rate(spark, sf_dir):
    return cache.hit_rate(cache.ttl_hits(_lookups(spark, sf_dir), ["ts", "event_id"]), ["key"])


HIT_RATE = f"{CACHE.replace('select key, event_id, hit from step', 'select key, count(*) lookups, round(avg(hit::integer), 6) hit_rate from step group by key')}"


def cache_semantic(spark, sf_dir):
    """Embeddings as lookups of a scope for each label, at a similarity that occurs."""
    e = base.table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("scope"), F.col("vec_id").cast("bigint").alias("vec_id"), (F.col("vec_id") * 60.0).alias("ts"), "embedding")
    return cache.semantic_hits(e, "vec_id", "scope", Config(cache_hit_at=0.35, cache_ttl_s=10000.0))


def collect_items(spark, sf_dir):
    c = base.table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id")
    last = c.withColumn("last", F.max("turn").over(w))
    r = last.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == F.col("last"), F.col("text"))).alias("user_message"), F.array_sort(F.collect_list(F.when(F.col("turn") < F.col("last"), F.struct("turn", "text")))).alias("_c"))
    r = r.select(F.col("conv_id").alias("request_id"), "user_message", F.transform("_c", lambda x: x["text"]).alias("conversation"))
    return llm_stage.collect(r, F.lit(base.AS_OF))


COLLECT = f"""with c as (select *, max(turn) over (partition by conv_id) as last, (row_number() over (partition by conv_id order by turn) - 1)::integer i, count(*) over (partition by conv_id) - 1 n from conversations)
select conv_id request_id, 'user_message' source, text, {base.AS_OF}::double ts, 0 pos from c where turn = last
union all select conv_id, 'current_conversation', text, ({base.AS_OF} - (n - i))::double, i from c where turn < last"""


def _answers(spark, sf_dir):
    c = base.table(spark, sf_dir, "conversations")
    user = F.concat(F.lit("<conversation>\n- "), F.regexp_replace("text", "\n", "\n- "), F.lit("\n</conversation>\n\n<user_request>\n"), "role", F.lit("\n</user_request>"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), llm_stage.mock_answer(user).alias("answer"), F.length("text").alias("size"))


def mock_answers(spark, sf_dir):
    return _answers(spark, sf_dir).select("request_id", "answer")


ANSWERS_CTE = r"""answers as (select conv_id * 1000 + turn request_id, length(text)::integer size, '[no model]' || chr(10) || chr(10) || 'Request: ' || role || chr(10) || chr(10) || len(l) || ' context line(s), first:' || chr(10) ||
  case when len(l) > 0 then array_to_string(list_transform(l[1:4], lambda x: '  * ' || x), chr(10)) else '  (nothing in context)' end answer
  from (select *, list_filter(string_split(text, chr(10)), lambda x: x <> '') l from conversations))"""
ANSWERS = f"with {ANSWERS_CTE} select request_id, answer from answers"


def stream_tokens(spark, sf_dir):
    return llm_stage.stream_tokens(_answers(spark, sf_dir), "request_id", "answer")


STREAM = f"with {ANSWERS_CTE} select request_id, (i - 1)::integer pos, p[i] || case when i < len(p) then ' ' else '' end as token from (select request_id, string_split(answer, ' ') p from answers), unnest(range(1, len(p) + 1)) r(i)"


def answer_cost(spark, sf_dir):
    a = _answers(spark, sf_dir)
    name = F.element_at(F.array(*map(F.lit, ("small", "medium", "large", "other"))), (F.col("request_id") % 4 + 1).cast("int"))
    return a.select("request_id", llm_stage.cost(name, F.col("size"), F.length("answer"), F.col("size") % 50, F.col("size") % 30).alias("cost"))


COST = f"""with {ANSWERS_CTE} select request_id, round((((greatest(0, size - size % 50 - size % 30) + 1.25e0 * (size % 30) + 0.1e0 * (size % 50)) * [0.8e0, 3e0, 15e0, 3e0][request_id % 4 + 1] + length(answer) * [4e0, 15e0, 75e0, 15e0][request_id % 4 + 1]) / 1e6)::decimal(18, 9), 6)::double as cost from answers"""


def audit_tail(spark, sf_dir):
    e = base.table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type")
    return llm_stage.audit_tail(e, 20, ["us", "event_id"])


AUDIT = "select event_id, epoch_us(ts) us, event_type from events order by ts desc, event_id desc limit 20"


def feedback_examples(spark, sf_dir):
    """Positive ratings as labelled queries."""
    e = base.table(spark, sf_dir, "events").withColumn("rating", F.when(F.col("event_type") == "error", -1).otherwise(1))
    return e.where("rating > 0").groupBy(F.concat(F.lit("user "), "user_id").alias("query")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("relevant"))


FEEDBACK = "select 'user ' || user_id query, count(*) n, string_agg(distinct event_type, ',' order by event_type) relevant from events where event_type <> 'error' group by user_id"


def authenticate(spark, sf_dir):
    """Requests bear their user's key; every third user has none."""
    e = base.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("key-"), "user_id").alias("api_key"))
    keys = base.table(spark, sf_dir, "events").select("user_id").distinct().where("user_id % 3 > 0")
    keys = keys.select(F.sha2(F.concat(F.lit("key-"), "user_id"), 256).alias("key_hash"), F.concat(F.lit("t"), F.col("user_id") % 5).alias("tenant_id"), F.array(F.concat(F.lit("u"), "user_id")).alias("principals"))
    return security.authenticate(e, keys).select("event_id", "tenant_id", F.get("principals", F.lit(0)).alias("principal"), "authorized")


AUTH = "select event_id, case when user_id % 3 > 0 then 't' || user_id % 5 end tenant_id, case when user_id % 3 > 0 then 'u' || user_id end principal, user_id % 3 > 0 authorized from events"

QUERIES = {f.__name__: f for f in (memory_upsert, memory_expire, memory_evict, memory_topk, memory_capture, cache_ttl_hits, cache_hit_rate, cache_semantic, collect_items, mock_answers, stream_tokens, answer_cost, audit_tail, feedback_examples, authenticate)}
ORACLE_SQL = {
    "memory_upsert": UPSERT, "memory_expire": EXPIRE, "memory_evict": EVICT, "memory_topk": TOPK, "memory_capture": CAPTURE, "cache_ttl_hits": CACHE, "cache_hit_rate": HIT_RATE, "collect_items": COLLECT,
    "mock_answers": ANSWERS, "stream_tokens": STREAM, "answer_cost": COST, "audit_tail": AUDIT, "feedback_examples": FEEDBACK, "authenticate": AUTH,
}
