"""Count reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partition_report(df: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Rows and distinct authors per corpus, ordered."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_distinct("author").alias("n_authors"))
    return ordered_report(counts, keys)


def file_rollup_report(df: DataFrame, file: str = "file") -> DataFrame:
    """Rows and distinct authors per file, and over all files in a last row without a name."""
    rolled = df.rollup(file).agg(F.count("*").alias("n_rows"), F.count_distinct("author").alias("n_authors"))
    return ordered_report(rolled, [file])


def ordered_report(report: DataFrame, keys: Sequence[str]) -> DataFrame:
    """In the order of ``keys``, totals (null) last."""
    return report.orderBy(*(F.asc_nulls_last(k) for k in keys))


def corpus_coverage_report(meta: DataFrame, files: DataFrame, key: str = "id") -> DataFrame:
    """Documents and authors of the metadata with a file, and without. An author may be among both."""
    found = meta.join(files.select(key).distinct().withColumn("_found", F.lit(True)), key, "left")
    has = F.col("_found").isNotNull()
    return found.agg(
        F.count_if(has).alias("docs"),
        F.count_distinct(F.when(has, F.col("author"))).alias("authors"),
        F.count_if(~has).alias("missing_docs"),
        F.count_distinct(F.when(~has, F.col("author"))).alias("missing_authors"),
    )


def valid_author_ids(df: DataFrame, label: str, min_texts: int) -> DataFrame:
    """Labels with at least ``min_texts`` rows."""
    return df.groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") >= min_texts)
