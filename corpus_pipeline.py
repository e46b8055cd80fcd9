"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstroke.llm import decontamination, language, near_duplicates, packing, pseudonyms
from penstroke.llm.queries import EXAMPLE_KEY, WORD_VOCABULARY, fold
from penstroke.llm.tokenization import vocabulary
from penstroke.staging import stage

SLICE_BYTES = 2 << 20
"""Text that the packing stage encodes at a time: its workers are those that the stages before have filled."""


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no letters, or n-grams much rarer than in the languages learned.

    The model learns from three quarters of the rows, as in its own query; ``lang`` is not changed.
    """
    model = language.fit_language_model(docs.where(fold("doc_id", 4) != 2).select("text", "lang"))
    predicted = language.predict_language(docs.select("*", F.struct("*").alias("__document")), model, strange="__strange")
    kept = predicted.where((F.col("lang_pred") != language.UNDETERMINED) & ~F.col("__strange"))
    return kept.select("__document.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id. A row without an id stays only if
    no other of its group has one; of several rows with that id, or without any, one stays."""
    return near_duplicates.one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold passages of the benchmark by its contamination rule."""
    found = decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = stage(found.where("contaminated").select("doc_id", "text_hash").distinct(), "contaminated")
    same = docs["doc_id"].eqNullSafe(bad["doc_id"]) & (F.xxhash64(docs["text"]) == bad["text_hash"])
    return docs.join(bad, same, "left_anti")


def replace_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace private values in the texts by pseudonyms; ``n_chars`` follows."""
    return pseudonyms.pseudonymize(docs, EXAMPLE_KEY, kinds_column=None).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens in sequences."""
    return packing.pack_documents(docs, vocabulary(WORD_VOCABULARY), slice_bytes=SLICE_BYTES)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("contamination", drop_contaminated),
    ("private_data", replace_private_data),
    ("packing", pack_sequences),
]

# Models, hashes and tokenizers have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on the stored result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
