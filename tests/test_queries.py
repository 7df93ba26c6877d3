"""Every registered query of the engine against its SQL, on the smallest tables."""

from pathlib import Path

import pytest
from metrilark.plans.queries import ORACLE_SQL, QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    import oracle

    oracle.same(QUERIES[name](spark, SF), oracle.connect(SF), ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pushdown(spark):
    """Only the columns that are needed are read, and conditions reach the scan."""
    from metrilark.operators import shaping

    items = spark.read.parquet(f"{SF}/documents.parquet").withColumn("row_id", F.col("doc_id"))
    shaped = shaping.generation(items, reference="{{ source }}", rows=(10, None), keep={"{{ lang }}": "en"}, remove={"{{ source }}": "src0"}).select("doc_id", "references")
    plan = shaped._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "n_chars" not in plan.split("ReadSchema")[1]
    kept = {r["doc_id"] for r in shaped.collect()}
    assert kept == {r["doc_id"] for r in items.collect() if r["doc_id"] >= 10 and r["lang"] == "en" and r["source"] != "src0"}
