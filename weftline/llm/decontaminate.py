"""Benchmark decontamination with one Aho-Corasick automaton.

Questions and answers are normalised (lower case, runs of letters and digits, single
spaces); every run of ``n`` words of an item is a pattern, and an item of fewer words is one
pattern as a whole. Each text is normalised alike and scanned once; hits that follow each
other merge into spans, and spans are mapped to character offsets of the original text,
also where lower-casing changes its length. A document with a span is contaminated.

Items of fewer than ``min_words`` words, which ordinary prose holds by chance, are found where
they are the whole text. The automaton is broadcast; a benchmark of more than ``shard_chars``
characters of patterns is searched with several, one after the other, with the same result.

Cases: null or empty texts have no span, nor have null items and those without a word. Texts of
any length are scanned whole. Null ids pass through, repeated rows are scanned each on its own,
items with equal words each get their span, and spans of several items may overlap. Empty tables
on either side give no spans. Extra columns, whatever their names, are kept by ``clean`` and
ignored by ``spans``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftline.llm.common import table, texts, tidy

WORD = re.compile(r"[^\W_]+")
#: The edges of a normalised text.
BEGIN, END = "\x02", "\x03"
SPANS = "doc_id bigint, item_id bigint, first_word int, words int, start int, end int, whole_item boolean"


@dataclass(frozen=True)
class Config:
    n: int = 8
    min_words: int = 4
    #: Characters of patterns in one automaton, which bounds what is broadcast.
    shard_chars: int = 40_000_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def offsets_of(text: str) -> list[tuple[int, int]]:
    """(start, end) in ``text`` of each of its words."""
    low = text.lower()
    if len(low) == len(text):
        return [m.span() for m in WORD.finditer(low)]
    back = [i for i, c in enumerate(text) for _ in c.lower()]
    return [(back[m.start()], back[m.end() - 1] + 1) for m in WORD.finditer(low)]


def patterns(items: list[tuple[int, str]], cfg: Config) -> tuple[dict[str, list[int]], list[int], list[int]]:
    """Pattern to positions in ``ids``; ids of the items and how many words each has."""
    found: dict[str, list[int]] = defaultdict(list)
    ids, count = [], []
    for item, text in items:
        w = words_of(text)
        if not w:
            continue
        if len(w) < cfg.min_words:
            found[f"{BEGIN} {' '.join(w)} {END}"].append(len(ids))
        for k in range(max(1, len(w) - cfg.n + 1) if len(w) >= cfg.min_words else 0):
            key = " " + " ".join(w[k : k + cfg.n]) + " "
            if not found[key] or found[key][-1] != len(ids):
                found[key].append(len(ids))
        ids.append(item)
        count.append(len(w))
    return found, ids, count


class Scanner:
    def __init__(self, items: list[tuple[int, str]], cfg: Config):
        self.cfg = cfg
        found, self.ids, self.count = patterns(items, cfg)
        self.auto = ahocorasick.Automaton()
        for key, owners in found.items():
            self.auto.add_word(key, (len(key.strip(f" {BEGIN}{END}").split(" ")), owners))
        if found:
            self.auto.make_automaton()
        self.any = bool(found)

    def hits(self, words: list[str]) -> list[tuple[int, tuple]]:
        """(end in the joined words between their edges, value) of every pattern met."""
        return list(self.auto.iter(f"{BEGIN} {' '.join(words)} {END}")) if self.any and words else []

    def spans(self, text: str | None) -> list[tuple]:
        """(item_id, first_word, words, start, end, whole_item), in order of item and place."""
        words = words_of(text)
        hits = self.hits(words)
        if not hits:
            return []
        ends = np.cumsum([len(w) + 1 for w in words])
        runs: dict[int, list[list[int]]] = defaultdict(list)
        for end, (n, owners) in hits:
            last = int(np.searchsorted(ends, min(end - 1, ends[-1])))
            for o in owners:
                mine = runs[o]
                if mine and last - n + 1 <= mine[-1][2] + 1:  # the next pattern of the run
                    mine[-1][1], mine[-1][2] = last, last - n + 1
                else:
                    mine.append([last - n + 1, last, last - n + 1])
        at = offsets_of(text)
        return [(self.ids[o], a, z - a + 1, at[a][0], at[z][1], z - a + 1 >= self.count[o]) for o in sorted(runs, key=lambda o: (self.ids[o] is None, self.ids[o] or 0, o)) for a, z, _ in runs[o]]


def _shards(items: DataFrame, cfg: Config) -> list[list[tuple[int, str]]]:
    rows = sorted(((r[0], r[1]) for r in items.select("item_id", "text").where("text is not null").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    out, load = [[]], 0
    for r in rows:
        cost = len(r[1]) * cfg.n
        if out[-1] and load + cost > cfg.shard_chars:
            out.append([])
            load = 0
        out[-1].append(r)
        load += cost
    return out


def spans(docs: DataFrame, items: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row of ``SPANS`` for each passage of an item in a document."""
    sc, out = docs.sparkSession.sparkContext, None
    for shard in _shards(items, cfg):
        shared = sc.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            scan = Scanner(shared.value, cfg)
            for batch in batches:
                rows = [(i, *s) for i, t in zip(batch.column(0).to_pylist(), texts(batch, "text")) for s in scan.spans(t)]
                cols = list(zip(*rows)) if rows else [[]] * 7
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "first_word", "words", "start", "end", "whole_item"])

        one = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SPANS)
        out = one if out is None else out.unionAll(one)
    return out


def clean(docs: DataFrame, items: DataFrame, cfg: Config = Config()) -> DataFrame:
    """``docs`` without those that hold a passage of an item; no shuffle."""
    sc, out = docs.sparkSession.sparkContext, docs
    for shard in _shards(items, cfg):
        shared = sc.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            scan = Scanner(shared.value, cfg)
            for batch in batches:
                yield batch.filter(pa.array([not scan.hits(words_of(t)) for t in texts(batch, "text")], pa.bool_()))
            del scan
            tidy()

        out = out.mapInArrow(run, docs.schema)
    return out


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of the benchmark in the documents."""
    return spans(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
with doc as (
  select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w,
         string_split_regex(lower(text), '[\p{L}\p{N}]+') s from documents where text is not null
), item as (
  select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from benchmark where text is not null
), piece as (
  select distinct item_id, len(w) item_words, least(len(w), 8) n,
         array_to_string(w[k + 1 : k + least(len(w), 8)], ' ') g
  from item, unnest(range(0, greatest(1, len(w) - 7))) t(k) where len(w) > 0
), gram as (
  select doc_id, k, z.n, len(w) doc_words, array_to_string(w[k + 1 : k + z.n], ' ') g
  from doc, (select distinct n from piece) z, unnest(range(0, len(w) - z.n + 1)) t(k)
), hit as (
  select doc_id, item_id, item_words, gram.n, k,
         k - row_number() over (partition by doc_id, item_id order by k) island
  from gram join piece on gram.g = piece.g and gram.n = piece.n and (item_words >= 4 or doc_words = item_words)
), run as (
  select doc_id, item_id, min(k) k0, max(k) + min(n) - 1 k1, min(item_words) item_words
  from hit group by doc_id, item_id, island
)
select doc_id, item_id, k0::integer first_word, (k1 - k0 + 1)::integer words,
       (list_sum(list_transform(s[1 : k0 + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1 : k0], lambda x: length(x))), 0))::integer "start",
       (list_sum(list_transform(s[1 : k1 + 1], lambda x: length(x))) + list_sum(list_transform(w[1 : k1 + 1], lambda x: length(x))))::integer "end",
       (k1 - k0 + 1) >= item_words whole_item
from run join doc using (doc_id)
"""
