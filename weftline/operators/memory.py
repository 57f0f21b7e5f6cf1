"""Scoped memory: writing, facts, recall, expiry and bounds, as snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.config import Config
from weftline.functions import text

VERBS = (" uses ", " prefers ", " likes ")


def scope(tenant: str = "tenant_id", principals: str = "principals") -> Column:
    """``global`` for the default tenant without principals, else tenant and first principal."""
    first = F.coalesce(F.get(F.col(principals), F.lit(0)), F.lit("anon"))
    plain = (F.col(tenant) == "default") & (F.size(principals) == 0)
    return F.when(plain, F.lit("global")).otherwise(F.concat_ws(":", tenant, first))


def upsert(records: DataFrame, order: list[str]) -> DataFrame:
    """Of records with one ``fact_key`` in a scope: the first's row, with the last's text, value and creation, and the highest importance.

    Records without a key all stay.
    """
    w = Window.partitionBy("scope", "fact_key")
    first = F.row_number().over(w.orderBy(*order))
    whole = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = records.withColumn("_n", first)
    for c in ("text", "fact_value", "created"):
        out = out.withColumn(f"_{c}", F.last(c).over(whole))
    out = out.withColumn("_importance", F.max("importance").over(w))
    own = F.col("fact_key").isNull()
    changed = {c: F.when(own, F.col(c)).otherwise(F.col(f"_{c}")) for c in ("text", "fact_value", "created", "importance")}
    return out.where(own | (F.col("_n") == 1)).select(*[changed[c].alias(c) if c in changed else F.col(c) for c in records.columns])


def facts(message: str = "user_message") -> Column:
    """The fact that a message states as a struct (key, value), or null: subject and verb, and what follows up to a full stop."""
    out = F.lit(None).cast("struct<key:string,value:string>")
    low = F.lower(F.col(message))
    for verb in reversed(VERBS):
        at = F.instr(low, verb)
        key = F.concat(F.trim(F.substr(low, F.lit(1), at)), F.lit(verb.strip()))
        rest = F.rtrim(F.regexp_replace(F.trim(F.substr(F.col(message), at + len(verb))), r"\.+$", ""))
        value = F.substring(F.split_part(rest, F.lit("."), F.lit(1)), 1, 60)
        out = F.when(at > 0, F.struct(key.alias("key"), value.alias("value"))).otherwise(out)
    return out


def capture(requests: DataFrame, as_of: Column) -> DataFrame:
    """What an exchange leaves in memory: an episode, and the fact that the message states."""
    base = requests.select("request_id", scope().alias("scope"), F.col("user_message"), facts().alias("_f"))
    plain = lambda kind, imp, t, k, v: base.select("request_id", "scope", t.alias("text"), F.lit(kind).alias("mtype"), F.lit(imp).alias("importance"), as_of.alias("created"), k.alias("fact_key"), v.alias("fact_value"))
    none = F.lit(None).cast("string")
    episode = plain("episodic", 0.4, F.concat(F.lit("User asked: "), F.substring(text.stripped(F.col("user_message")), 1, 200)), none, none)
    known = plain("semantic", 0.7, text.stripped(F.col("user_message")), F.col("_f.key"), F.col("_f.value")).where("fact_key is not null")
    return episode.unionByName(known)


def live(records: DataFrame, as_of: Column) -> DataFrame:
    """Without those past their time to live."""
    return records.where(F.col("ttl_s").isNull() | (as_of - F.col("created") <= F.col("ttl_s")))


def recall(requests: DataFrame, records: DataFrame, as_of: Column, cfg: Config = Config(), key: str = "memory_id") -> DataFrame:
    """(request_id, key, score, pinned, rank): the best live records of each request's scope."""
    days = F.greatest(F.lit(0.0), as_of - F.col("last_used")) / 86400
    near = text.dot(F.col("embedding"), F.col("_q"))
    ask = requests.select("request_id", "scope", F.col("embedding").alias("_q"))
    fits = F.size("embedding") == F.size("_q")
    both = live(records, as_of).join(ask, "scope").where(fits)
    scored = both.withColumn("score", F.round(0.6 * near + 0.25 * F.col("importance") + 0.15 / (1 + days), 9)).withColumn("pinned", F.col("importance") >= cfg.pinned_at)
    w = Window.partitionBy("request_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cfg.memory_k).select("request_id", key, "score", "pinned", "rank")


def touch(records: DataFrame, hits: DataFrame, as_of: Column, key: str = "memory_id") -> DataFrame:
    """Records with the uses and time of last use that recall leaves."""
    n = hits.groupBy(key).agg(F.count("*").alias("_hits"))
    out = records.join(n, key, "left")
    return out.withColumn("uses", F.col("uses") + F.coalesce("_hits", F.lit(0))).withColumn("last_used", F.when(F.col("_hits").isNotNull(), as_of).otherwise(F.col("last_used"))).drop("_hits").select(*records.columns)


def evict(records: DataFrame, as_of: Column, bound: int, cfg: Config = Config(), key: str = "memory_id") -> DataFrame:
    """``records`` cut to ``bound`` over all scopes; the least valuable go, pinned ones never.

    Only the records to go are sorted out: a top-k, not a sort of the table.
    """
    over = records.count() - bound
    if over <= 0:
        return records
    value = F.round(F.col("importance") / (1 + F.greatest(F.lit(0.0), as_of - F.col("last_used")) / 86400), 12)
    gone = records.where(F.col("importance") < cfg.pinned_at).withColumn("_v", value).orderBy("_v", key).limit(over)
    return records.join(gone.select(key), key, "left_anti")


def forget(records: DataFrame, ids: DataFrame, key: str = "memory_id") -> DataFrame:
    """Records without those whose key, within their scope, is in ``ids`` (scope, key)."""
    return records.join(ids.select("scope", key), ["scope", key], "left_anti").select(*records.columns)


def count(records: DataFrame, as_of: Column | None = None) -> DataFrame:
    """(scope, records): how many each scope has; with ``as_of``, that are alive then."""
    return (records if as_of is None else live(records, as_of)).groupBy("scope").agg(F.count("*").alias("records"))
