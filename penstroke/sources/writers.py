"""Writers."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penstroke.staging import fresh_path

FOLDERS, FILES_PER_FOLDER = 64, 1_000
"""Folders that many small files are dealt to at least, more than Spark lists one after the other on the driver (32), and how
many files a folder takes before there are more of them."""


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """A folder of Parquet files; chunks are best partitioned by source, batches by epoch and shard."""
    df.write.mode("overwrite").option("compression", "snappy").partitionBy(*partition_by).parquet(path)


def store_by_key(df: DataFrame, keys: Sequence[str], buckets: int | None = None, name: str = "stored") -> DataFrame:
    """A stored table whose rows lie in buckets by ``keys``, sorted in each: a join on all of these keys reads it in place
    and moves the other side only.

    Without ``buckets`` there are as many as shuffle partitions. The files lie in the shared folder, the entry in the
    session's catalog, as Spark keeps the layout there.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    table = f"{name}_{path.rsplit('-', 1)[-1]}"
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(n, *keys)  # one file per bucket
    dealt.write.bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return spark.table(table)


def write_text_files(texts: DataFrame, path: str, name: str = "name", text: str = "text") -> None:
    """One UTF-8 file per row below ``path``, with the row's own relative ``name``, which no other row has.

    The files are dealt to folders by their names. Tasks write them one by one, each under a hidden name until it is whole, so
    a repeated task writes the same again; a committer of folders would move each of them once more, on the driver. A row
    without a name has no file, one without a text an empty file.
    """
    folders = max(FOLDERS, math.ceil(texts.count() / FILES_PER_FOLDER))
    folder = F.lpad(F.pmod(F.xxhash64(name), F.lit(folders)).cast("string"), 8, "0")
    named = texts.where(F.col(name).isNotNull()).select(F.concat_ws("/", folder, name).alias("name"), F.coalesce(text, F.lit("")).alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
        for batch in batches:
            for file, content in zip(batch.column("name").to_pylist(), batch.column("text")):
                parent, last = f"{root}/{file}".rsplit("/", 1)
                hidden = f"{parent}/.{last}-{uuid.uuid4().hex}"
                files.create_dir(parent, recursive=True)
                with files.open_output_stream(hidden, compression=None) as stream:
                    stream.write(content.as_buffer())
                files.move(hidden, f"{parent}/{last}")
            yield batch.select(["name"])

    named.mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()


def write_counts(counts: DataFrame, path: str) -> None:
    """``(key, n)`` as Parquet, without zeros."""
    counts.where(F.col("n") > 0).select("key", "n").write.mode("overwrite").parquet(path)


def write_counts_json(counts: DataFrame, path: str) -> None:
    """Lines ``{"key": ..., "n": ...}`` in parallel, without zeros."""
    counts.where(F.col("n") > 0).select(F.col("key").cast("string").alias("key"), "n").write.mode("overwrite").json(path)


def write_predictions_csv(predictions: DataFrame | None, path: str) -> bool:
    """Predictions as CSV with a header; nothing is written for an empty table."""
    if predictions is None or predictions.isEmpty():
        return False
    predictions.write.mode("overwrite").option("header", True).csv(path)
    return True
