"""What the operators of this subpackage share: shared scratch tables and text batches."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir of the session.

    Where that is unset, a local master gets a folder of this application, and a cluster an error,
    as its executors do not see the driver's folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), f"quillstone-{spark.sparkContext.applicationId}")


#: Bytes of text that a Python worker gets at a time while a table is staged.
BATCH_BYTES = 16 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def staged(df: DataFrame, name: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not the plan before it, and
    the next plan starts from a table of known size.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(batch_bytes))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
