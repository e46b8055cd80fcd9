"""Views over the given tables in the shapes the operators take. Every view covers its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penstroke.operators import chunking as C
from penstroke.operators import corpus as D
from penstroke.plans.training import CorpusSettings
from penstroke.sources.readers import fill_cores
from penstroke.staging import stage

LENGTH = 64
VOCAB_SIZE = 4096
SEED = "42"
TEXTS_PER_AUTHOR = 10
VAL_AUTHORS = 4
CAPS = {"en": 10}
VIEWS = 4
SLOTS = 4
WORLD = 2
DIMENSION = 32

SETTINGS = {
    "en": CorpusSettings(pack=False),
    "fr": CorpusSettings(),
    "de": CorpusSettings(
        separator_ids=C.BLANK_LINES_SEPARATOR[1], texts_per_author=TEXTS_PER_AUTHOR, social=True, sentinels=("None", "nan")
    ),
    "es": CorpusSettings(),
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as four corpora (by language) of forty author names each."""
    docs = fill_cores(table(spark, sf, "documents").select("doc_id", "lang", "text"))
    named = docs.withColumn("author", F.concat(F.lit("a"), F.col("doc_id") % 40))
    return D.to_raw_schema(named, "author", "text", "doc_id", F.col("lang"))


def vocab(docs: DataFrame) -> DataFrame:
    return stage(C.build_vocab(C.piece_counts(docs), VOCAB_SIZE), "vocab")


def encoded(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    return C.number_stored(C.encode(D.trim_text(docs), vocabulary if vocabulary is not None else vocab(docs)))


def packed_chunks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Chunks of the packed documents, and the vocabulary."""
    docs = raw_docs(spark, sf)
    vocabulary = vocab(docs)
    return C.chunk_packed(encoded(docs, vocabulary), length=LENGTH, seed=SEED), vocabulary


def stored_chunks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The same, stored, for queries that read the chunks more than once."""
    chunks, vocabulary = packed_chunks(spark, sf)
    return stage(chunks, "chunks"), vocabulary


def chunk_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks without their contents."""
    return packed_chunks(spark, sf)[0].select("source", "author", "doc_id", "chunk_idx")


def emb_views(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings by author, each author's vectors numbered as views."""
    from penstroke.operators.distributed import number_rows

    vectors = table(spark, sf, "embeddings").withColumnRenamed("label", "author")
    return number_rows(vectors, ["author"], "vec_id", [], "view")


def emb_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings in batches of 100 consecutive vectors."""
    vectors = table(spark, sf, "embeddings")
    return vectors.withColumn("batch_id", F.floor(F.col("vec_id") / 100))


def emb_part(spark: SparkSession, sf: str, part: int, parts: int = 2) -> DataFrame:
    """One role of the embeddings: known and unknown; with four parts train known, train unknown, test known, test unknown."""
    vectors = table(spark, sf, "embeddings").where(F.col("vec_id") % parts == part)
    return vectors.withColumn("author", F.col("label").cast("string"))


def emb_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of embedding authors, one per customer; the corpus is the market segment."""
    customers = table(spark, sf, "customer")
    return customers.select(
        "c_custkey",
        F.col("c_mktsegment").alias("corpus"),
        (F.col("c_custkey") % 10).cast("string").alias("known_author"),
        (F.col("c_nationkey") % 10).cast("string").alias("unknown_author"),
    )


def conv_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations: the user's turns are the known texts, the assistant's the unknown, in four corpora."""
    rows = table(spark, sf, "conversations")
    kind = F.when(F.col("role") == "user", "known").when(F.col("role") == "assistant", "unknown").otherwise("other")
    return rows.select(
        F.concat(F.lit("c"), F.col("conv_id") % 4).alias("corpus"),
        F.col("conv_id").cast("string").alias("author"),
        kind.alias("texttype"),
        "text",
        F.concat_ws(":", "conv_id", "turn").alias("doc_id"),
        F.col("turn").alias("pos"),
    )


def conv_problems(spark: SparkSession, sf: str, apart: int = 4) -> DataFrame:
    """Every conversation with itself and with a later one of its corpus, which may be missing."""
    conv = F.col("conv_id")
    each = table(spark, sf, "conversations").select("conv_id").distinct()
    return each.withColumn("step", F.explode(F.array(F.lit(0), F.lit(apart)))).select(
        F.concat(F.lit("c"), conv % 4).alias("corpus"),
        conv.cast("string").alias("known_author"),
        (conv + F.col("step")).cast("string").alias("unknown_author"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    """With a header, every field quoted, in the order of the rows."""
    df.write.csv(path, header=True, quoteAll=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of documents: quality as the truth, toxic as the prediction."""
    return table(spark, sf, "labels").select(
        F.concat(F.lit("a"), F.col("doc_id") % 40).alias("known_author"),
        F.concat(F.lit("d"), F.col("doc_id")).alias("unknown_author"),
        F.concat(F.lit("c"), F.col("doc_id") % 4).alias("corpus"),
        F.col("quality").alias("ground_truth"),
        F.col("toxic").alias("predicted"),
        (F.col("quality") == F.col("toxic")).cast("int").alias("correct"),
    )


def joined(array: str | Column) -> Column:
    """An array of numbers as text, for comparison."""
    column = F.col(array) if isinstance(array, str) else array
    return F.concat_ws(",", column.cast("array<string>"))


def long_vector(df: DataFrame, keys: list, vector: str) -> DataFrame:
    """One row per position of a vector, rounded."""
    return df.select(*keys, F.posexplode(vector).alias("pos", "value")).withColumn("value", F.round("value", 6) + 0.0)
