"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import bpe, codes, decontaminate, density, fertility, jaccard, katz, licences, pii, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": bpe.op1_bpe,
    "op2_fertility": fertility.op2_fertility,
    "op3_pii": pii.op3_pii,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_density": density.op5_density,
    "op6_jaccard_pairs": jaccard.op6_jaccard_pairs,
    "op7_codes": codes.op7_codes,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_licences": licences.op9_licences,
    "op10_katz": katz.op10_katz,
}

ORACLE_SQL: dict[str, str] = {
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op9_licences": licences.sql(),
    "op10_katz": katz.sql(),
}
