"""Cutting lineage in the cluster's shared checkpoint folder.

``shapeframe.llm.common`` holds the same for its subpackage: that one and the rest can each be taken away.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is set and all runs on this machine, as in tests."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, materialised where every executor can read it again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and where it is.

    Unlike a checkpoint, a table that is read again has no constraints of the plan that it came from. In a loop, joins would
    infer filters from them, and the plan would double with every round.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path
