"""The registered queries of the subpackage, each with production parameters over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chunking, decontaminate, license, packing, pii, quality, secrets, simhash, toxicity, wrappers
from ._spark import documents, table


def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(documents(spark, sf_dir))


def op2_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op4_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fingerprints(documents(spark, sf_dir))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op8_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op9_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.licenses(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pii_spans, op2_simhash_near_duplicates, op3_best_fit_packing, op4_chunk_fingerprints, op5_secrets, op6_quality, op7_benchmark_matches, op8_html_wrappers, op9_toxicity_neighbours, op10_licenses)}

ORACLE_SQL: dict[str, str] = {}
