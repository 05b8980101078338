"""Tables that an operator writes and reads again: in the shared folder that the session names."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet under spark.checkpoint.dir and read back, so that all that reads it sees the same rows. Without that setting: a local folder in a local session, an error in any other."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _local_folder()
    path = f"{root}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
