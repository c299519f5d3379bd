"""What jobs over large tables share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in a local session that names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """The path of a new folder, not yet made, that all nodes share."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of an Arrow batch that a Python worker gets, at most, unless the session already asks for less.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Keep the memory of Python workers and of their buffers low for long texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "64MB", "64m", "67108864"):  # the default
        spark.conf.set(name, str(BATCH_BYTES))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows evenly, or by keys, where each takes long to work on: by their bytes alone they would be few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
