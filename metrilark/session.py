"""Session defaults, the package's code on the executors, and the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
#: Most bytes and rows that go to a Python worker at once: there, lists of words take many times their bytes.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1000


def session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings that the engine is tested under; settings of an active one are kept."""
    builder = SparkSession.builder.appName(PACKAGE.name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (("spark.sql.session.timeZone", "UTC"), ("spark.sql.adaptive.enabled", "true"), ("spark.ui.enabled", "false")):
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bounded(spark: SparkSession) -> SparkSession:
    """Arrow batches of the session are bounded, so that a worker's memory doesn't grow with the rows of its partition; smaller limits are kept."""
    for key, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key)
        now = int(now) if now.lstrip("-").isdigit() else spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the Python workers with Spark's own file distribution, once a context; they need no installation."""
    bounded(spark)
    context = spark.sparkContext
    if not getattr(context, "_metrilark_shipped", False):
        handle, path = tempfile.mkstemp(prefix=f"{PACKAGE.name}-", suffix=".zip")
        os.close(handle)
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
            for file in sorted(PACKAGE.rglob("*.py")):
                archive.write(file, str(file.relative_to(PACKAGE.parent)))
        context.addPyFile(path)
        context._metrilark_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark, "_metrilark_shared", None)
    if own is None:
        own = spark._metrilark_shared = "file://" + tempfile.mkdtemp(prefix="metrilark-")
    return own


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: without lineage, and kept when executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/metrilark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
