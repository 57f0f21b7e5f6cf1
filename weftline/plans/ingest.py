"""Queries of loading, chunking and index upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.config import Config
from weftline.functions import text, vectors
from weftline.operators import ingest
from weftline.plans import base
from weftline.sources import sync

CFG = Config()


def token_counts(spark, sf_dir):
    d = base.table(spark, sf_dir, "documents")
    return d.select("doc_id", text.token_count("text").alias("tokens"), F.size(text.terms("text")).cast("bigint").alias("terms"), F.size(text.query_terms("text")).cast("bigint").alias("distinct_terms"))


TOKEN_COUNTS = f"""select doc_id, {base.tokens('text')} tokens, len({base.terms('text')})::bigint terms,
  len(list_distinct(list_filter({base.terms('text')}, lambda t: length(t) > 1)))::bigint distinct_terms from documents"""


def item_ids(spark, sf_dir):
    d = base.table(spark, sf_dir, "documents")
    return d.select("doc_id", text.item_id("source", "text").alias("item_id"), text.document_id("text").alias("hash_id"), text.preview("text", 80).alias("preview"))


ITEM_IDS = r"""select doc_id, substr(sha1(source || ':' || text), 1, 12) item_id, substr(sha1(text), 1, 16) hash_id,
  case when length(f) <= 80 then f else substr(f, 1, 77) || '...' end preview
from (select *, trim(regexp_replace(text, '\s+', ' ', 'g')) f from documents)"""


def hash_vectors(spark, sf_dir):
    d = vectors.embed(base.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.posexplode("embedding").alias("bucket", "weight")).where("weight <> 0").select("doc_id", F.col("bucket").cast("bigint").alias("bucket"), F.round("weight", 9).alias("weight"))


HASH_VECTORS = f"with {base.vector_cte('v', 'documents', 'doc_id', 'text')} select doc_id, bucket::bigint bucket, round(weight, 9) weight from v"


def sentence_units(spark, sf_dir):
    d = base.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(text.sentences("text")).alias("pos", "sentence"))


SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"""
SENTENCE_UNITS = f"select doc_id, (i - 1)::integer pos, s[i] sentence from (select doc_id, {SENTENCES.format('text')} s from documents), unnest(range(1, len(s) + 1)) r(i)"


def chunks(spark, sf_dir):
    c = ingest.chunk_documents(base.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return c.select("doc_id", "chunk", "chunk_id", "tokens", "text")


#: Packs one unit of every document at a time. The tables have no headings and no code blocks.
CHUNKS_CTE = rf"""body as (
  select doc_id, t, {base.tokens('t')} n, list_concat_units u from (
    select doc_id, t, flatten(list_transform(string_split_regex(t, '\n\s*\n'), lambda p: {SENTENCES.format('p')})) list_concat_units
    from (select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') t from documents) where t <> '')
), packed as (
  with recursive step(doc_id, i, cur, held, done) as (
    select doc_id, 0::bigint, []::varchar[], 0::bigint, null::varchar from body where n > {CFG.chunk_tokens}
    union all
    select doc_id, i + 1,
      case when full_ then list_append(back, unit) else list_append(cur, unit) end,
      case when full_ then coalesce(list_sum(list_transform(back, lambda x: greatest(1, (length(x) + 3) // 4))), 0) + n else held + n end,
      case when full_ then array_to_string(cur, ' ') end
    from (
      select *, cur[len(cur) - keep + 1 :] back from (
        select *, coalesce(list_max(list_filter(range(1, len(cur) + 1), lambda k: list_sum(list_transform(cur[len(cur) - k + 1 :], lambda x: greatest(1, (length(x) + 3) // 4))) <= {CFG.chunk_overlap})), 0) keep
        from (
          select s.*, u[i + 1] unit, greatest(1, (length(u[i + 1]) + 3) // 4) n, len(cur) > 0 and held + greatest(1, (length(u[i + 1]) + 3) // 4) > {CFG.chunk_tokens} full_
          from step s join body using (doc_id) where i < len(u))))
  )
  select doc_id, i, done from step where done is not null
  union all
  select doc_id, i + 1, array_to_string(cur, ' ') from step join (select doc_id, len(u) m from body) using (doc_id) where i = m and len(cur) > 0
), chunks as (
  select doc_id, (row_number() over (partition by doc_id order by i) - 1)::integer chunk, text from (
    select doc_id, 0::bigint i, t as text from body where n <= {CFG.chunk_tokens} union all select doc_id, i, done from packed)
)"""
CHUNKS = f"with recursive {CHUNKS_CTE} select doc_id, chunk, doc_id || ':' || chunk chunk_id, {base.tokens('text')} tokens, text from chunks"


def html_text(spark, sf_dir):
    return base.table(spark, sf_dir, "pages").select("page_id", text.html_text("html").alias("text"))


HTML_TEXT = r"select page_id, regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g') text from pages"


def _versions(spark, sf_dir):
    """Documents as two loads: an old one, and a new one in which some have changed."""
    d = base.documents(spark, sf_dir).select("tenant_id", "doc_id", F.lit(0).alias("chunk"), "text")
    old = d.where("doc_id % 5 <> 4")
    new = d.where("doc_id % 5 >= 3").withColumn("text", F.concat("text", F.lit(" updated")))
    return old, new


VERSIONS = f"""{base.DOCS}, old as (select tenant_id, doc_id, 0 chunk, text from docs where doc_id % 5 <> 4),
new as (select tenant_id, doc_id, 0 chunk, text || ' updated' as text from docs where doc_id % 5 >= 3)"""


def add_documents(spark, sf_dir):
    return ingest.add(*_versions(spark, sf_dir))


ADD = f"with {VERSIONS} select * from old union all select * from new anti join old using (tenant_id, doc_id, chunk)"


def update_documents(spark, sf_dir):
    return ingest.update(*_versions(spark, sf_dir))


UPDATE = f"with {VERSIONS} select * from old anti join new using (tenant_id, doc_id) union all select * from new"


def delete_documents(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return ingest.delete(old, new, ["tenant_id", "doc_id"])


DELETE = f"with {VERSIONS} select * from old anti join new using (tenant_id, doc_id)"


def compact_rows(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return ingest.compact(ingest.delete(old, new, ["tenant_id", "doc_id"]).select("doc_id"), ["doc_id"])


COMPACT = f"with {VERSIONS} select doc_id, row_number() over (order by doc_id) - 1 as row from old anti join new using (tenant_id, doc_id)"


def tombstones(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return ingest.tombstones(old, ingest.delete(old, new, ["doc_id"]), ["doc_id"])


TOMBSTONES = f"with {VERSIONS}, live as (select * from old anti join new using (doc_id)) select v vectors, l live, round((v - l) / v, 6) ratio from (select (select count(*) from old) v, (select count(*) from live) l)"


def sync_diff(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    entry = lambda d: d.select("tenant_id", F.lit("docs").alias("root"), F.concat(F.col("doc_id"), F.lit(".txt")).alias("path"), F.sha1("text").alias("sha1"))
    return sync.diff(entry(new), entry(old))


SYNC_DIFF = f"""with {VERSIONS}, listing as (select tenant_id, 'docs' root, doc_id || '.txt' path, sha1(text) sha1 from new),
manifest as (select tenant_id, 'docs' root, doc_id || '.txt' path, sha1(text) sha1 from old)
select tenant_id, root, path, case when m.sha1 is null then 'added' when l.sha1 is null then 'deleted' when l.sha1 <> m.sha1 then 'updated' else 'same' end action
from listing l full join manifest m using (tenant_id, root, path)"""

QUERIES = {f.__name__: f for f in (token_counts, item_ids, hash_vectors, sentence_units, chunks, html_text, add_documents, update_documents, delete_documents, compact_rows, tombstones, sync_diff)}
ORACLE_SQL = {
    "token_counts": TOKEN_COUNTS, "item_ids": ITEM_IDS, "hash_vectors": HASH_VECTORS, "sentence_units": SENTENCE_UNITS, "chunks": CHUNKS, "html_text": HTML_TEXT,
    "add_documents": ADD, "update_documents": UPDATE, "delete_documents": DELETE, "compact_rows": COMPACT, "tombstones": TOMBSTONES, "sync_diff": SYNC_DIFF,
}
