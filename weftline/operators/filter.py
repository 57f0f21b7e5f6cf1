"""Expired, weak, contradicting and duplicate items go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.config import Config
from weftline.functions import text
from weftline.shared import written


def fresh(as_of: Column, expires: str = "expires_at") -> Column:
    return F.col(expires).isNull() | (F.col(expires) >= as_of)


def strong(least: float, similarity: str = "similarity") -> Column:
    return F.col(similarity) >= least


def resolve_conflicts(items: DataFrame, order: list, by: str = "request_id") -> DataFrame:
    """Of items with one ``fact_key`` and several values only the best stays: score, then time, then ``order``.

    Items without a key, and of keys with one value, all stay.
    """
    w = Window.partitionBy(by, "fact_key")
    values = F.size(F.collect_set(F.coalesce("fact_value", F.lit("\x00"))).over(w))
    first = F.row_number().over(w.orderBy(F.desc("score"), F.desc("ts"), *order)) == 1
    kept = items.withColumn("_v", values).withColumn("_f", first).where("fact_key is null or _v = 1 or _f")
    return kept.drop("_v", "_f")


def drop_duplicates(items: DataFrame, threshold: float, order: str = "rank", by: str = "request_id", vec: str = "embedding", digits: int = 9) -> DataFrame:
    """In rank order an item goes if it is as similar as ``threshold`` to one that stays; those without a vector stay.

    A fold over each request's few items; near copies of dropped items may stay.
    """
    others = [c for c in items.columns if c not in (by, order, vec)]
    row = F.struct(order, F.struct(*others).alias("rest"), vec)
    grouped = items.groupBy(by).agg(F.array_sort(F.collect_list(row)).alias("_items"))
    kind = grouped.schema["_items"].dataType.simpleString()
    same = lambda k, x: F.round(text.dot(k[vec], x[vec]), digits) >= threshold
    fold = F.aggregate("_items", F.array().cast(kind), lambda kept, x: F.when(F.coalesce(F.exists(kept, lambda k: same(k, x)), F.lit(False)), kept).otherwise(F.concat(kept, F.array(x))))
    out = grouped.select(by, F.explode(fold).alias("_x"))
    return out.select(by, F.col(f"_x.{order}").alias(order), *[F.col(f"_x.rest.{c}").alias(c) for c in others], F.col(f"_x.{vec}").alias(vec)).select(*items.columns)


def counts(items: DataFrame, as_of: Column, least: float, by: str = "request_id") -> DataFrame:
    """How many items of each request expired or were too weak."""
    old = ~fresh(as_of)
    return items.groupBy(by).agg(F.count_if(old).alias("expired"), F.count_if(~old & ~strong(least)).alias("low_signal"), F.count("*").alias("items"))


def apply(items: DataFrame, as_of: Column, cfg: Config = Config(), order: list[str] = ["item_id"], by: str = "request_id", mark=lambda _, df: df) -> tuple[DataFrame, DataFrame]:
    """Ranked items without expired, weak, contradicting and duplicate ones, and (by, expired, low_signal, contradictions, duplicates).

    ``contradictions`` counts keys with several values, ``duplicates`` the items that went as such.
    """
    first = counts(items, as_of, cfg.keep_similarity, by).drop("items")
    alive = items.where(fresh(as_of) & strong(cfg.keep_similarity))
    values = F.size(F.collect_set(F.coalesce("fact_value", F.lit("\x00"))))
    clash = alive.where("fact_key is not null").groupBy(by, "fact_key").agg(values.alias("_v")).where("_v > 1").groupBy(by).agg(F.count("*").alias("contradictions"))
    settled = written(mark("settle", resolve_conflicts(alive, order, by)), "settled")
    kept = written(mark("filter", drop_duplicates(settled, cfg.duplicate_at, by=by)), "kept")
    left = settled.groupBy(by).agg(F.count("*").alias("_all")).join(kept.groupBy(by).agg(F.count("*").alias("_left")), by).select(by, (F.col("_all") - F.col("_left")).alias("duplicates"))
    return kept, first.join(clash, by, "left").join(left, by, "left")
