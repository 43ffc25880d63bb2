"""Registered queries of the package and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postwise.llm import (
    bpe,
    content_sort,
    decontamination,
    fill_middle,
    licenses,
    merkle,
    mixing,
    quality_rules,
    quality_votes,
    sharding,
    simhash,
    toxicity,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontamination.query,
    "op2_mixing": mixing.query,
    "op3_quality_votes": quality_votes.query,
    "op4_bpe": bpe.query,
    "op5_warc": warc.query,
    "op6_licenses": licenses.query,
    "op7_quality_rules": quality_rules.query,
    "op8_simhash": simhash.query,
    "op9_toxicity": toxicity.query,
    "op10_sharding": sharding.query,
    "op11_merkle": merkle.query,
    "op12_exact_dedup": content_sort.query,
    "op13_fill_middle": fill_middle.query,
}

ORACLES: dict[str, str] = {
    "op6_licenses": licenses.oracle_sql(),
    "op7_quality_rules": quality_rules.oracle_sql(),
    "op11_merkle": merkle.oracle_sql(),
    "op12_exact_dedup": content_sort.oracle_sql(),
    "op13_fill_middle": fill_middle.oracle_sql(),
}
