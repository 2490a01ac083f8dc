"""Queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from hearthlake.llm import chat, decontaminate, exact_dedup, hard_negatives, mixing, ngram_join, periodic, quality, sharding, substring_dedup, suffix_dedup, url_filter, warc

QUERIES: dict[str, Callable[..., DataFrame]] = {
    "op1_mixing": mixing.op1_mixing,
    "op2_warc": warc.op2_warc,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_chat": chat.op4_chat,
    "op5_ngram_jaccard": ngram_join.op5_ngram_jaccard,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_quality": quality.op7_quality,
    "op8_sharding": sharding.op8_sharding,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_repeated_passages": substring_dedup.op10_repeated_passages,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_suffix_dedup": suffix_dedup.op13_suffix_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": mixing.ORACLE,
    "op3_url_filter": url_filter.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op9_decontamination": decontaminate.ORACLE,
    "op11_periodic_runs": periodic.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_suffix_dedup": suffix_dedup.ORACLE,
}
