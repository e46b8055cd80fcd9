"""Readers of raw corpora, chunks, counts and verification tables. Every schema is given, none is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penstroke.operators.chunking import CHUNK_SCHEMA
from penstroke.operators.corpus import RAW_COLUMNS, to_raw_schema

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
TWEET_COLUMNS = ("author", "tweet_id", "text", "created_at")
METADATA_COLUMNS = ("id", "author", "language")
CORPUS_COLUMNS = ("corpus", "author", "texttype", "text")
PROBLEM_COLUMNS = ("corpus", "known_author", "unknown_author")
BOOK_PATTERN = r"([^/]+)_text\.txt$"
COMPRESSED_PATTERN = r"\.(gz|bz2|deflate|lz4|snappy|zst)$"

# Field contents that count as missing in delimited files.
MISSING_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)


def fill_cores(df: DataFrame) -> DataFrame:
    """Spread a scan that has fewer partitions than the session has cores.

    A file of one row group is one task however large its rows are. On a table of many files this does nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def number_in_file_order(rows: DataFrame, name: str = "position") -> DataFrame:
    """Add the position from 0 in the order of files and of rows inside them, without moving a row.

    ``rows`` comes straight from a file reader. Rows are numbered where they are read; one counting pass gives the
    first row and the number of rows of every file split, and the offsets, one small row per split, are broadcast.
    """
    split = ["_pid", "_file", "_block"]
    read = rows.select(
        "*",
        F.spark_partition_id().alias("_pid"),
        F.col("_metadata.file_path").alias("_path"),
        F.xxhash64("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    spans = read.groupBy(*split, "_path").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.orderBy("_path", "_block")) - F.col("_n")
    offsets = spans.select(*split, (earlier - F.col("_first")).alias("_offset"))
    placed = read.join(F.broadcast(offsets), split)
    return placed.select(*rows.columns, (F.col("_offset") + F.col("_row")).alias(name))


def _positioned(rows: DataFrame, author: str, text: str, source: str) -> DataFrame:
    placed = number_in_file_order(rows, "_position")
    named = placed.withColumn("_doc_id", F.concat(F.lit(f"{source}_"), F.col("_position")))
    return to_raw_schema(named, author, text, "_doc_id", source)


def read_json_corpus(
    spark: SparkSession, path: str, source: str, author: str = "author", text: str = "body"
) -> DataFrame:
    """Line-delimited JSON; ``doc_id`` is the source and the position."""
    rows = spark.read.schema(f"`{author}` string, `{text}` string").json(path)
    return _positioned(rows, author, text, source)


def _delimited(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)
    return rows.withColumns({c: F.when(~F.col(c).isin(*MISSING_VALUES), F.col(c)) for c in columns})


def read_csv_corpus(
    spark: SparkSession, path: str, columns: Sequence[str], source: str, author: str = "id", text: str = "text"
) -> DataFrame:
    """CSV with a header, quoted fields with line breaks and doubled quotes; ``columns`` are all columns of the file.

    A field that counts as missing is null. Such a file cannot be split, so it is converted once.
    """
    rows = _delimited(spark, path, columns)
    return _positioned(rows, author, text, source)


def read_tsv_headerless(
    spark: SparkSession, paths: Sequence[str], source: str, columns: Sequence[str] = TWEET_COLUMNS,
    author: str = "author", text: str = "text", doc_id: str = "tweet_id",
) -> DataFrame:
    """Tab-separated lines without header or quotes. Lines with too many fields and empty lines are skipped, short
    lines are kept; a missing text is empty, a missing author or id is ``nan``. Paths that do not exist are skipped."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    existing = [p for p in paths if hadoop(p).getFileSystem(conf).exists(hadoop(p))]
    if not existing:
        raise FileNotFoundError(f"none of {list(paths)} exists")
    lines = spark.read.text(existing).where(F.length("value") > 0)
    fields = lines.select(F.split("value", "\t").alias("f")).where(F.size("f") <= len(columns))

    def field(name: str, missing: str):
        value = F.get("f", F.lit(list(columns).index(name)))
        return F.when(value.isNull() | value.isin(*MISSING_VALUES), missing).otherwise(value).alias(name)

    named = fields.select(field(author, "nan"), field(doc_id, "nan"), field(text, ""))
    return to_raw_schema(named, author, text, doc_id, source)


def read_metadata(spark: SparkSession, path: str, columns: Sequence[str] = METADATA_COLUMNS) -> DataFrame:
    """Metadata CSV with a header; ``columns`` are all columns of the file. A field that counts as missing is null."""
    rows = _delimited(spark, path, columns)
    return rows.select(*METADATA_COLUMNS)


def list_files(spark: SparkSession, path: str, id_pattern: str = BOOK_PATTERN) -> DataFrame:
    """``(id, path, length)`` of every file whose path has the pattern, without reading one.

    Spark's scans pass over empty files, so what the listing has and a scan of names and sizes has not is empty. The
    listing is the one that Spark's driver makes for any scan.
    """
    scan = _files(spark, path)
    filled = scan.select(_one_slash("_metadata.file_path").alias("path"), "length")
    sized = _listing(scan).join(filled, "path", "left")
    found = F.regexp_extract("path", id_pattern, 1)
    return sized.select(found.alias("id"), "path", F.coalesce("length", F.lit(0)).alias("length")).where(F.col("path").rlike(id_pattern))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def _listing(scan: DataFrame) -> DataFrame:
    """``path`` of every file that Spark has listed for a scan.

    The paths go from the listing straight to a table of the session; in Python each of them would be a call of its own.
    """
    spark = scan.sparkSession
    jvm = spark._jvm
    paths = jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(scan._jdf.inputFiles())
    made = spark._jsparkSession.createDataset(paths, jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(made.toDF(), spark).select(_one_slash("value").alias("path"))


def _one_slash(path: str) -> Column:
    """A local path as the scan and the listing both may write it."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def read_text_files(spark: SparkSession, path: str, id_pattern: str = BOOK_PATTERN) -> DataFrame:
    """``(id, text)``, one row per file whose path has the pattern; the id is its first group. An empty file has an
    empty text, a compressed one, known by its extension, its unpacked text.

    One listing serves the contents and the empty files, and a query that drops the texts opens no file that is not compressed.
    """
    scan = _files(spark, path)
    listed = _listing(scan).where(F.col("path").rlike(id_pattern))
    named, packed = F.col("_metadata.file_path"), lambda p: F.lower(p).rlike(COMPRESSED_PATTERN)
    found = lambda p: F.regexp_extract(p, id_pattern, 1).alias("id")
    names = scan.select(_one_slash("_metadata.file_path").alias("path"))
    plain = scan.where(named.rlike(id_pattern) & ~packed(named)).select(found(named), F.col("content").cast("string").alias("text"))
    texts = plain.unionByName(listed.join(names, "path", "left_anti").select(found("path"), F.lit("").alias("text")))
    if listed.where(packed(F.col("path"))).isEmpty():
        return texts
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True).where(named.rlike(id_pattern) & packed(named))
    return texts.unionByName(whole.select(found(named), F.col("value").alias("text")))


def join_metadata_files(meta: DataFrame, files: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Metadata rows with their file's text, and metadata rows without a file."""
    return meta.join(files, key), meta.join(files.select(key), key, "left_anti")


def union_files(spark: SparkSession, paths: Sequence[str], schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """Several Parquet inputs as one table."""
    return spark.read.schema(schema).parquet(*paths)


def read_corpora(spark: SparkSession, path: str, corpora: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Chunks of the listed corpora from a folder that ``write_parquet`` partitioned by source.

    ``corpora`` has ``source`` and may be computed by any query: what it holds is known when the scan starts, and only the
    folders of these corpora are read.
    """
    wanted = corpora.select("source").distinct()
    return read_chunks(spark, path, columns and [*dict.fromkeys([*columns, "source"])]).join(F.broadcast(wanted), "source", "left_semi")


def read_chunks(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Chunks, reading only the given columns."""
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    return chunks.select(*columns) if columns else chunks


def read_counts(spark: SparkSession, path: str, key: str = "string") -> DataFrame:
    """``(key, n)`` as ``write_counts`` leaves them."""
    return spark.read.schema(f"key {key}, n bigint").parquet(path)


def read_counts_json(spark: SparkSession, path: str) -> DataFrame:
    """``(key, n)`` from lines ``{"key": ..., "n": ...}`` or, for counts made elsewhere, from one JSON object.

    In an object every value is a count, so a text under ``key`` tells the two forms apart.
    """
    first = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.get_json_object("value", "$.n"), F.col("value").rlike(r'"key"\s*:\s*"')).first()
    if first is None or (first[0] is not None and first[1]):
        return spark.read.schema("key string, n bigint").json(path)
    parsed = F.from_json("value", "map<string,bigint>")
    return spark.read.text(path, wholetext=True).select(F.explode(parsed).alias("key", "n"))


def read_verification_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four tables ``train_corpus``, ``test_corpus``, ``train_problems`` and ``test_problems``, as CSV with header.

    Columns are found by name, in any order and among others; a missing one is an error. A field that counts as missing is
    null, but a missing text is ``nan``. Texts also get ``pos``, the position in file order, and ``doc_id``.
    """
    tables = {}
    for part in ("train", "test"):
        for kind, columns in (("corpus", CORPUS_COLUMNS), ("problems", PROBLEM_COLUMNS)):
            path = f"{folder.rstrip('/')}/{part}_{kind}.csv"
            names = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').columns
            lacking = [c for c in columns if c not in names]
            if lacking:
                raise ValueError(f"{path} has no column {', '.join(lacking)}")
            rows = _delimited(spark, path, names)
            if kind == "corpus":
                placed = number_in_file_order(rows, "_position").select(*columns, F.col("_position").alias("pos"))
                rows = placed.withColumns({"text": F.coalesce("text", F.lit("nan")), "doc_id": F.concat(F.lit(f"{part}_"), "pos")})
            tables[f"{part}_{kind}"] = rows if kind == "corpus" else rows.select(*columns)
    return tables
