"""Tables that the queries derive from the given ones, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import vectors

AS_OF = 1_700_000_000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with tenant, access list and time."""
    acl = "case doc_id % 4 when 0 then cast(array() as array<string>) when 1 then array('g1') when 2 then array('g2') else array('g1', 'g2') end acl"
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "text", "source", "lang tenant_id", acl, f"{AS_OF}D - doc_id * 3600 ts", "map('source', source) metadata")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items as requests of several tenants and groups; some want one source only."""
    tenant = "element_at(array('de', 'en', 'es', 'fr'), cast(item_id % 4 + 1 as int)) tenant_id"
    who = "case item_id % 3 when 0 then cast(array() as array<string>) when 1 then array('g1') else array('g2') end principals"
    return table(spark, sf_dir, "benchmark").selectExpr("item_id request_id", "text user_message", tenant, who)


def with_vectors(df: DataFrame, text: str = "text") -> DataFrame:
    return vectors.embed(df, text)


DOCS = f"""docs as (
  select doc_id, text, source, lang tenant_id, ({AS_OF} - doc_id * 3600)::double ts,
         case doc_id % 4 when 0 then []::varchar[] when 1 then ['g1'] when 2 then ['g2'] else ['g1', 'g2'] end acl from documents
)"""
REQUESTS = """requests as (
  select item_id request_id, text user_message, ['de', 'en', 'es', 'fr'][item_id % 4 + 1] tenant_id,
         case item_id % 3 when 0 then []::varchar[] when 1 then ['g1'] else ['g2'] end principals from benchmark
)"""


def bucket(md5: str, dim: int = 384) -> str:
    """A word's bucket from its MD5 in hexadecimal digits."""
    part = [f"('0x' || substr({md5}, {1 + 8 * i}, 8))::bigint" for i in range(4)]
    out = f"({part[0]} % {dim})"
    for p in part[1:]:
        out = f"(({out} * {2**32 % dim} + {p}) % {dim})"
    return out


def vector_cte(name: str, source: str, key: str, text: str) -> str:
    """Common table ``name`` (key, bucket, weight) of the hash vectors of ``source``."""
    return f"""{name}_words as (
  select {key}, md5(w) m from (select {key}, unnest(string_split_regex(lower({text}), '\\s+')) w from {source}) where w <> ''
), {name}_counts as (select {key}, {bucket('m')} bucket, count(*)::double c from {name}_words group by all
), {name} as (select {key}, bucket, c / sqrt(sum(c * c) over (partition by {key})) weight from {name}_counts)"""


VISIBLE = "r.tenant_id = d.tenant_id and (len(d.acl) = 0 or list_has_any(d.acl, r.principals))"


def terms(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z0-9]+')"


def tokens(text: str) -> str:
    return f"greatest(1, (length({text}) + 3) // 4)::integer"
