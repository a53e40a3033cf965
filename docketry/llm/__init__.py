"""Corpus operators for training-data pipelines; nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import bpe, decontaminate, exact_dedup, license_scan, lm_score, periodic_runs, phrases, sentencepieces, sharding, simhash, sstable, toxicity, url_filter

    return {
        "op1_sstable": sstable.op1_sstable,
        "op2_simhash": simhash.op2_simhash,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_bpe": bpe.op5_bpe,
        "op6_license_scan": license_scan.op6_license_scan,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_sharding": sharding.op8_sharding,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_lm_score": lm_score.op10_lm_score,
        "op11_periodic_runs": periodic_runs.op11_periodic_runs,
        "op12_sentencepieces": sentencepieces.op12_sentencepieces,
        "op13_phrases": phrases.op13_phrases,
    }


def oracle_sql() -> dict[str, str]:
    from . import decontaminate, exact_dedup, phrases, url_filter

    return {"op3_decontaminate": decontaminate.ORACLE, "op4_exact_dedup": exact_dedup.ORACLE, "op7_url_filter": url_filter.ORACLE, "op13_phrases": phrases.ORACLE}
