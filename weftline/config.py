"""Settings of context assembly, and the dimension of item sources."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: source: (prior, may hold instructions that must not be followed)
SOURCES = {
    "system": (1.0, False), "user_message": (1.0, False), "current_conversation": (0.9, False), "long_term_memory": (0.8, False),
    "previous_conversation": (0.7, True), "knowledge_base": (0.65, True), "document": (0.6, True), "database": (0.6, False),
    "api_response": (0.5, True), "tool_output": (0.5, True), "web_search": (0.45, True), "cache": (0.4, False),
}
UNKNOWN_PRIOR = 0.5
MEMORY_TYPES = ("working", "session", "long_term", "episodic", "semantic")
#: US dollars for a million tokens: in, out.
PRICES = {"small": (0.8, 4.0), "medium": (3.0, 15.0), "large": (15.0, 75.0)}
DEFAULT_PRICE = (3.0, 15.0)


@dataclass(frozen=True)
class Weights:
    rerank: float = 0.55
    similarity: float = 0.15
    bm25: float = 0.10
    recency: float = 0.08
    importance: float = 0.07
    conversation: float = 0.03
    preference: float = 0.02


@dataclass(frozen=True)
class Config:
    dim: int = 384
    chunk_tokens: int = 320
    chunk_overlap: int = 48
    recall_k: int = 40
    rerank_k: int = 12
    ephemeral_k: int = 8
    min_similarity: float = 0.15
    rrf_k: int = 60
    abstain_below: float = -3.0
    weights: Weights = Weights()
    #: The age at which recency falls to 1/e.
    recency_tau_s: float = 604800.0
    duplicate_at: float = 0.90
    #: Items of less similarity are dropped after ranking.
    keep_similarity: float = 0.0
    max_item_tokens: int = 220
    compress_ratio: float = 0.5
    max_context_tokens: int = 32000
    reserve_output_tokens: int = 4000
    safety_margin: float = 0.10
    memory_bound: int = 5000
    memory_k: int = 5
    pinned_at: float = 0.9
    cache_ttl_s: float = 3600.0
    cache_hit_at: float = 0.97
    cache_max_entries: int = 2048
    abstractive: bool = False
    #: Patterns of financial identifiers are redacted as well.
    redact_financial: bool = False
    redact: bool = True
    fence_aware: bool = False
    system: str = "Answer from the context given below. Say so when the context does not hold the answer."


#: What an analyst's assistant is held to: sources, dates and units, and no advice.
FINANCE_SYSTEM = (
    "You help with questions about financial documents. Answer from the context alone, give the date, currency and unit of every figure and the filing that it comes from, "
    "keep reported figures apart from estimates, and say so when the context does not hold the answer. Give no investment advice and no forecast of your own."
)


def finance(**changes) -> Config:
    """The preset for financial texts: fresher, more literal, stricter."""
    base = Config(weights=Weights(0.50, 0.15, 0.15, 0.15, 0.03, 0.01, 0.01), recency_tau_s=90 * 86400.0, abstain_below=-2.0, redact_financial=True, system=FINANCE_SYSTEM)
    return replace(base, **changes)


def source_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, p, u) for k, (p, u) in SOURCES.items()], "source string, prior double, untrusted boolean")


def prior(source: str) -> Column:
    out = F.lit(UNKNOWN_PRIOR)
    for name, (p, _) in SOURCES.items():
        out = F.when(F.col(source) == name, F.lit(p)).otherwise(out)
    return out


def untrusted(source: str) -> Column:
    return F.col(source).isin([k for k, (_, u) in SOURCES.items() if u])
