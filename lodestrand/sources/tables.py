"""Keyed tables on Parquet: snapshots, upserts and ledgers, laid out by tenant and namespace."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from ..operators.ingest import upserted


def write_snapshot(df: DataFrame, root: str, by: tuple[str, ...] = ("tenant", "namespace")) -> str:
    """Write a new version beside the old ones and return its path; readers of an old version are not disturbed."""
    path = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.partitionBy(*[c for c in by if c in df.columns]).parquet(path)
    return path


def upsert(spark: SparkSession, current: str | None, incoming: DataFrame, key: str, root: str, overwrite: bool = True) -> str:
    """A new version with incoming rows in place of those of the same key."""
    try:
        stored = spark.read.parquet(current) if current else None
    except AnalysisException:
        stored = None
    return write_snapshot(upserted(stored, incoming, key, overwrite) if stored is not None else incoming, root)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or with a local master a folder of our own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lodestrand-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written into the shared folder and read back: what reads it several times computes it once, and lost executors cost nothing of it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
