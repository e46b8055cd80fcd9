"""Cutting lineage through tables in the shared checkpoint folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session, as in tests, may do without it; on a cluster a missing setting is an error, because a
    machine-local folder would not be seen by the other executors.
    """
    folder = spark.conf.get(_SETTING, None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{_SETTING} must name a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="penstroke-")
        spark.conf.set(_SETTING, folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Later readers see fixed rows (also when executors are lost), prune columns, and give the optimizer a measured
    table size.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
