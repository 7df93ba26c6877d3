"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, PII, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but
the last return the columns of ``documents``. The stages handle null and repeated
rows, empty tables and further columns as the operators they call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from metrilark.llm import decontaminate, packing, pii, simhash, toxicity
from metrilark.llm._spark import cut, documents, table
from metrilark.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled neighbours vote toxic go."""
    return toxicity.drop_toxic(docs, table(ship(spark), sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verbatim match of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; all documents stay."""
    return pii.redact(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of a document gets its place in a bin."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_documents),
]

#: Votes of neighbours, EM and best-fit packing have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again."""
    docs = documents(ship(spark), sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(ship(spark), docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
