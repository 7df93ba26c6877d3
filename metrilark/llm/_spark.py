"""Session helpers of the subpackage: shared folder, cut lineage, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it is measured to have no more bytes than this.
BROADCAST_BYTES = 8 << 20


#: Bytes and rows of text that go to a Python worker at once.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are bounded by bytes, so that long texts don't add up in the workers."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark, "_metrilark_folder", None)
    if own is None:
        own = spark._metrilark_folder = "file://" + tempfile.mkdtemp(prefix="metrilark-")
    return own


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: no lineage, kept when executors are lost, sizes known to the planner."""
    path = f"{shared_folder(df.sparkSession)}/metrilark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are few; else as it is, for a shuffled join."""
    count = df.count() if rows is None else rows
    return F.broadcast(df) if count * row_bytes <= BROADCAST_BYTES else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
