"""Shared scratch tables of the engine's own jobs."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; a local one where that is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
    root = root or os.path.join(tempfile.gettempdir(), f"quillstone-{spark.sparkContext.applicationId}")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Bytes that a Python worker gets at a time while a table is written.
BATCH_BYTES = 16 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def kept(df: DataFrame, name: str) -> DataFrame:
    """`df` as a written table: its plan runs once, however many plans read it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)
