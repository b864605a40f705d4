"""Tables staged in the folder that every executor reaches."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


#: Staged tables that hold pieces of texts: written denser.
TEXTS = ("stretches", "unlike")


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; a temporary one only in a local session without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = _local_root()
    return f"{root.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back; lineage ends there."""
    path = folder(df.sparkSession, name)
    (df.write.option("compression", "zstd") if name in TEXTS else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    """How many tasks a keyed exchange should have: the session's setting, which follows the input."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
