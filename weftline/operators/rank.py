"""Reranking, its scaling and confidence, and the weighted blend of signals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.config import Config, prior
from weftline.functions import text


def identity_rerank(items: DataFrame) -> DataFrame:
    """Without a model the similarity is the rerank score."""
    return items.withColumn("raw_rerank_score", F.col("similarity")).withColumn("rerank_score", F.col("similarity"))


def model_rerank(items: DataFrame, model: Callable[[list[str], list[str]], np.ndarray], message: str = "user_message", column: str = "text") -> DataFrame:
    """Logits of a pair model, then ``rescale``."""

    @F.pandas_udf("double")
    def logits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in batches:
            yield pd.Series(np.asarray(model(q.fillna("").tolist(), t.fillna("").tolist()), float))

    return rescale(items.withColumn("raw_rerank_score", logits(message, column)), "raw_rerank_score", "rerank_score")


def rescale(items: DataFrame, raw: str, out: str) -> DataFrame:
    """``raw`` from 0 to 1 within each request; where all are equal, 0."""
    w = Window.partitionBy("request_id")
    low, high = F.min(raw).over(w), F.max(raw).over(w)
    span = F.coalesce(F.nullif(high - low, F.lit(0.0)), F.lit(1.0))
    return items.withColumn(out, (F.col(raw) - low) / span)


def confidence(items: DataFrame, raw: str, abstain_below: float) -> DataFrame:
    """The best raw score of each request, and whether it is too low to answer."""
    best = F.max(raw).over(Window.partitionBy("request_id"))
    return items.withColumn("confidence", best).withColumn("low_confidence", F.coalesce(best, F.lit(0.0)) < abstain_below)


def cut(items: DataFrame, k: int, order: list) -> DataFrame:
    return items.withColumn("_r", F.row_number().over(Window.partitionBy("request_id").orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def importance(source: str, own: str | None = None, pinned: str | None = None) -> Column:
    """The largest of an item's own importance, 1 if it is pinned, and half of its source's prior."""
    parts = [prior(source) * 0.5]
    if own:
        parts.append(F.coalesce(F.col(own), F.lit(0.0)))
    if pinned:
        parts.append(F.coalesce(F.col(pinned).cast("int").cast("double"), F.lit(0.0)))
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


def preference(column: str, preferences: str = "preferences") -> Column:
    """1 if the text has any of the preferred terms, whatever the case."""
    low = F.lower(F.col(column))
    return F.when(F.exists(F.coalesce(F.col(preferences), F.array().cast("array<string>")), lambda t: F.contains(low, F.lower(t))), 1.0).otherwise(0.0)


def blend(items: DataFrame, as_of: Column, cfg: Config = Config(), source: str = "source", order: list[str] = ["item_id"]) -> DataFrame:
    """``score`` and ``rank`` of items that have rerank_score, similarity, bm25, ts and, where given, importance, pinned and preferences."""
    w, has = cfg.weights, set(items.columns)
    score = (
        w.rerank * F.col("rerank_score")
        + w.similarity * F.col("similarity")
        + w.bm25 * F.coalesce("bm25", F.lit(0.0))
        + w.recency * F.exp(-text.age("ts", as_of) / cfg.recency_tau_s)
        + w.importance * importance(source, "importance" if "importance" in has else None, "pinned" if "pinned" in has else None)
        + w.conversation * (F.col(source) == "current_conversation").cast("int")
        + w.preference * (preference("text") if "preferences" in has else F.lit(0.0))
    )
    scored = items.withColumn("score", F.round(score, 9))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), *order)))
