"""Retrieval metrics, bootstrap intervals, controls, weight tuning and groundedness."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text, vectors
from weftline.operators import ingest

METRICS = ("recall", "precision", "hit", "mrr", "ndcg")


def document_ranks(chunks: DataFrame, by: list[str], score: str = "score", doc: str = "doc_id") -> DataFrame:
    """(by, doc, rank): documents by their best chunk."""
    best = chunks.groupBy(*by, doc).agg(F.max(score).alias("_s"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_s"), doc))).drop("_s")


def per_query(ranked: DataFrame, labels: DataFrame, k: int, by: list[str] = ["query_id"], doc: str = "doc_id") -> DataFrame:
    """The five metrics of every labelled query; without labels or hits they are 0. ``by`` ends with the query."""
    query = by[-1]
    want = labels.select(query, doc).distinct()
    size = want.groupBy(query).agg(F.count("*").alias("n"))
    groups = ranked.select(*by[:-1]).distinct().crossJoin(size) if len(by) > 1 else size
    hits = ranked.join(want, [query, doc]).groupBy(*by).agg(
        F.count_if(F.col("rank") <= k).alias("_h"), F.min("rank").alias("_f"), F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("_g")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    h = F.coalesce("_h", F.lit(0))
    return groups.join(hits, by, "left").select(
        *by, (h / F.col("n")).alias("recall"), (h / F.lit(k)).alias("precision"), (h > 0).cast("double").alias("hit"),
        F.coalesce(1 / F.col("_f"), F.lit(0.0)).alias("mrr"), F.coalesce(F.col("_g") / ideal, F.lit(0.0)).alias("ndcg"), F.col("_f").alias("first_rank"),
    )


def mean_first_rank(scored: DataFrame, corpus: Column, by: list[str]) -> DataFrame:
    """The mean rank of the first relevant document; a miss counts as one past the corpus."""
    return scored.groupBy(*by).agg(F.round(F.avg(F.coalesce(F.col("first_rank"), corpus + 1)), 6).alias("mean_first_rank"))


def draw(trial: Column, at: Column, n: Column) -> Column:
    """An index below ``n`` from an MD5, so that other engines draw alike."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", trial, at)), 1, 8), 16, 10).cast("bigint") % n


def random_ranks(queries: DataFrame, docs: DataFrame, depth: int, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """(query, doc, score, rank): ``depth`` documents drawn for each query, the first of each among twice as many draws.

    Documents are numbered and drawn numbers joined: no query meets all documents. Of few documents fewer may be drawn.
    """
    numbered = ingest.compact(docs.select(doc), [doc])
    n = numbered.agg(F.count("*").alias("_n"))
    pulls = queries.select(query, F.explode(F.sequence(F.lit(0), F.lit(2 * depth - 1))).alias("_i")).crossJoin(F.broadcast(n)).where("_n > 0")  # one row
    first = pulls.select(query, "_i", draw(F.col(query), F.col("_i"), F.col("_n")).alias("row")).groupBy(query, "row").agg(F.min("_i").alias("_i"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("_i"))).where(F.col("rank") <= depth)
    return ranked.join(numbered, "row").select(query, doc, F.lit(0.0).alias("score"), "rank")


def containing(docs: DataFrame, queries: DataFrame, query: str = "query_id", message: str = "message", doc: str = "doc_id", column: str = "text") -> DataFrame:
    """(query, doc): documents that hold a query's message, letter by letter, found by one automaton of all messages.

    The messages are those of an evaluation set, which people write, and are held by every task.
    """
    shared = docs.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in queries.select(query, message).where(F.length(message) > 0).collect()])
    schema = f"{query} {queries.schema[query].dataType.simpleString()}, {doc} {docs.schema[doc].dataType.simpleString()}"
    kinds = [vectors.arrow_type(queries.schema[query].dataType), vectors.arrow_type(docs.schema[doc].dataType)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for q, m in shared.value:
            found.add_word(m, (*found.get(m, ()), q))
        if shared.value:
            found.make_automaton()
        for b in batches:
            rows = [(q, i) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t and shared.value for q in {q for _, qs in found.iter(t) for q in qs}]
            cols = list(zip(*rows)) if rows else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[query, doc])

    return docs.select(doc, column).mapInArrow(run, schema)


def bootstrap(values: DataFrame, by: list[str], order: str, value: str, trials: int) -> DataFrame:
    """(by, mean, low, high): the mean, and percentiles 2.5 and 97.5 of resampled means.

    Every group's values are one array, so trials need no join; per-query values are few beside a corpus.
    """
    groups = values.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_v"))
    groups = groups.select(*by, F.transform("_v", lambda x: x[value]).alias("_v"))
    spread = groups.select(*by, "_v", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("_t"))
    n = F.size("_v")
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + F.get(F.col("_v"), draw(F.col("_t"), i, n).cast("int")))
    means = spread.select(*by, F.aggregate("_v", F.lit(0.0), lambda s, x: s + x).alias("_all"), n.alias("_n"), (total / n).alias("_m"))
    cut = F.percentile("_m", F.array(F.lit(0.025), F.lit(0.975)))
    out = means.groupBy(*by).agg(F.round(F.first("_all") / F.first("_n"), 6).alias("mean"), cut.alias("_c"), F.round(F.avg((F.col("_m") <= 0).cast("double")), 6).alias("p_not_above_0"))
    return out.select(*by, "mean", F.round(F.col("_c")[0], 6).alias("low"), F.round(F.col("_c")[1], 6).alias("high"), "p_not_above_0")


def paired(base: DataFrame, treated: DataFrame, order: str, metric: str, trials: int) -> DataFrame:
    """(delta, low, high, p, win_rate, n) of a metric's difference by query."""
    both = base.select(order, F.col(metric).alias("_a")).join(treated.select(order, F.col(metric).alias("_b")), order).select(F.lit(0).alias("_g"), order, (F.col("_b") - F.col("_a")).alias("_d"))
    wins = both.agg(F.round(F.avg((F.col("_d") > 0).cast("double")), 6).alias("win_rate"), F.count("*").alias("n"))
    ci = bootstrap(both, ["_g"], order, "_d", trials)
    return ci.select(F.col("mean").alias("delta"), "low", "high", F.col("p_not_above_0").alias("p")).crossJoin(wins)


def permuted(labels: DataFrame, query: str = "query_id") -> DataFrame:
    """Each query with another's labels, as a control: queries are shifted by one along a hash of their id."""
    ids = labels.select(query).distinct()
    w = Window.orderBy(F.md5(F.col(query).cast("string")))  # one row for each query
    n = ids.withColumn("_n", F.row_number().over(w))
    last = n.agg(F.max("_n").alias("_m"))
    moved = n.crossJoin(F.broadcast(last)).select(F.col(query).alias("_to"), (F.col("_n") % F.col("_m") + 1).alias("_n")).join(n, "_n")
    return labels.join(moved.select(query, "_to"), query).drop(query).withColumnRenamed("_to", query).select(*labels.columns)


def report(means: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(config, one text for each metric): mean [low,high]."""
    cell = F.format_string("%.2f [%.2f,%.2f]", *(F.round(c, 2) for c in ("mean", "low", "high")))
    return means.withColumn("_c", cell).groupBy("config").pivot("metric", list(metrics)).agg(F.first("_c"))


def long(scored: DataFrame, keep: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))
    return scored.select(*keep, F.explode(pairs).alias("x")).select(*keep, "x.*")


def tune(signals: DataFrame, labels: DataFrame, grid: DataFrame, columns: list[str], k: int, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """(trial, ndcg, weights): mean nDCG of every row of ``grid`` (trial and a weight for each of ``columns``)."""
    crossed = signals.crossJoin(F.broadcast(grid.select("trial", *(F.col(c).alias(f"_w_{c}") for c in columns))))  # a few hundred rows
    score = sum((F.col(c) * F.col(f"_w_{c}") for c in columns[1:]), F.col(columns[0]) * F.col(f"_w_{columns[0]}"))
    w = Window.partitionBy("trial", query).orderBy(F.desc("_s"), doc)
    ranked = crossed.withColumn("_s", F.round(score, 9)).withColumn("rank", F.row_number().over(w)).select("trial", query, doc, "rank")
    return per_query(ranked, labels, k, ["trial", query], doc).groupBy("trial").agg(F.round(F.avg("ndcg"), 6).alias("ndcg"))


def groundedness(answers: DataFrame, sources: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """(key, claims, supported, groundedness): sentences of over 8 characters that some source is near to.

    Both sides have ``embedding``; without claims 1, without sources 0.
    """
    pairs = answers.join(sources.select(key, F.col("embedding").alias("_s")), key, "left")
    best = pairs.groupBy(key, "claim_id").agg(F.max(F.round(text.dot(F.col("embedding"), F.col("_s")), 9)).alias("_m"))
    ok = F.count_if(F.coalesce(F.col("_m") >= threshold, F.lit(False)))
    return best.groupBy(key).agg(F.count("*").alias("claims"), ok.alias("supported")).withColumn("groundedness", F.round(F.col("supported") / F.col("claims"), 6))


def unsupported(answers: DataFrame, sources: DataFrame, key: str, threshold: float = 0.5, claim: str = "claim") -> DataFrame:
    """(key, unsupported): an answer's claims that no source is near to, in their order; keys without any have no row."""
    pairs = answers.join(sources.select(key, F.col("embedding").alias("_s")), key, "left")
    best = pairs.groupBy(key, "claim_id", claim).agg(F.max(F.round(text.dot(F.col("embedding"), F.col("_s")), 9)).alias("_m")).where(~F.coalesce(F.col("_m") >= threshold, F.lit(False)))
    return best.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("claim_id", claim))), lambda x: x[claim]).alias("unsupported"))


def claims(answer: str) -> Column:
    return F.filter(text.sentences(answer), lambda s: F.length(s) > 8)


def hard_stratum(base: DataFrame, treated: DataFrame, order: str = "query_id", metric: str = "mrr") -> DataFrame:
    """(queries, hard, hard_share, improved, degraded, tied): queries that the base does not answer at rank one."""
    both = base.select(order, F.col(metric).alias("_a")).join(treated.select(order, F.col(metric).alias("_b")), order)
    hard = F.col("_a") < 1
    count = lambda c, name: F.count_if(hard & c).alias(name)
    return both.agg(F.count("*").alias("queries"), F.count_if(hard).alias("hard"), F.round(F.avg(hard.cast("double")), 6).alias("hard_share"), count(F.col("_b") > F.col("_a"), "improved"), count(F.col("_b") < F.col("_a"), "degraded"), count(F.col("_b") == F.col("_a"), "tied"))


def gate(recall: float, null_recall: float, random_recall: float, least: float = 0.60, most_null: float = 0.30) -> list[str]:
    """What speaks against a release; empty if nothing does."""
    found = [f"recall {recall:.2f} is under {least:.2f}"] if recall < least else []
    found += [f"the control's recall {null_recall:.2f} is over {most_null:.2f}"] if null_recall > most_null else []
    return found + ([f"recall {recall:.2f} is no better than chance"] if recall <= random_recall else [])
