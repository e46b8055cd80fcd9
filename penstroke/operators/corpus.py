"""Raw documents: schema, ids, filters, packed texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penstroke.functions import text as X
from penstroke.operators.chunking import PAGE_BREAK_SEPARATOR, cut_stream
from penstroke.operators.distributed import HOT_ROWS, global_rank, number_rows
from penstroke.operators.sampling import sample_per_author

RAW_COLUMNS = ("author", "text", "doc_id", "source")
PART_CHARS = 1_000_000
HOT_CHARS = 200_000_000
"""Characters one author may have before its texts are divided into ordered parts."""


def to_raw_schema(df: DataFrame, author: str, text: str, doc_id: str, source: str | Column) -> DataFrame:
    """``author, text, doc_id, source`` as strings; ``source`` is a constant or a column."""
    origin = F.lit(source) if isinstance(source, str) else source
    columns = (F.col(author), F.col(text), F.col(doc_id), origin)
    return df.select(*(c.cast("string").alias(name) for c, name in zip(columns, RAW_COLUMNS)))


def positional_doc_id(df: DataFrame, prefix: str, order_by: Sequence[str]) -> DataFrame:
    """``doc_id`` = prefix and position from 0 in the order of ``order_by``, which must be unique."""
    placed = global_rank(df, order_by, "_position")
    return placed.withColumn("doc_id", F.concat(F.lit(prefix), F.col("_position"))).drop("_position")


def prefixed_doc_id(df: DataFrame, prefix: str, column: str) -> DataFrame:
    return df.withColumn("doc_id", F.concat(F.lit(prefix), F.col(column).cast("string")))


def fill_missing_text(df: DataFrame) -> DataFrame:
    return df.withColumn("text", F.coalesce("text", F.lit("")))


def filter_language(df: DataFrame, value: str, column: str = "language") -> DataFrame:
    return df.where(F.col(column) == value)


def filter_anonymous_authors(df: DataFrame, column: str = "author") -> DataFrame:
    """Without rows whose author is missing or names no single person."""
    return df.where(~X.names_no_person(column))


def filter_sentinel_authors(df: DataFrame, values: Sequence[str] = X.SENTINEL_AUTHORS) -> DataFrame:
    return df.where(~X.is_sentinel_author("author", values))


def clean_social_text(df: DataFrame) -> DataFrame:
    return df.withColumn("text", X.clean_social_text("text"))


def trim_text(df: DataFrame) -> DataFrame:
    """Without blanks at both ends; other white space stays."""
    return df.withColumn("text", F.trim("text"))


def pass_through_documents(docs: DataFrame) -> DataFrame:
    """Trimmed documents of real authors, not packed."""
    return trim_text(filter_sentinel_authors(docs)).select(*RAW_COLUMNS)


def pack_authors(
    docs: DataFrame,
    separator: str = PAGE_BREAK_SEPARATOR[0],
    keys: Sequence[str] = ("source", "author"),
    order: str | None = None,
    seed: str = "42",
    part_chars: int = PART_CHARS,
    hot_chars: int = HOT_CHARS,
    trim: bool = True,
) -> DataFrame:
    """The packed text of every author in parts of ``part_chars`` characters.

    The parts of an author, joined by ``part``, are its texts, trimmed unless ``trim`` is off, joined by ``separator``. Texts follow each other
    by ``order`` (numeric; default a seeded digest of ``doc_id``); missing texts are skipped. An author whose text is short has one row; a long
    one spreads over rows and tasks, so no row or group grows with the author.
    """
    keys, gap = list(keys), len(separator)
    texts = docs.withColumn("text", F.trim("text")) if trim else docs
    texts = texts.withColumns({"_n": F.coalesce(F.length("text"), F.lit(0)), "_texts": F.col("text").isNotNull().cast("int")})
    if order is None:
        texts = texts.withColumn("_digest", X.seeded_digest("doc_id", seed=seed))
        texts = texts.withColumn("_order", X.digest_number("_digest"))
        order, ties = "_order", ["_digest", "doc_id"]
    else:
        ties = ["doc_id"]
    totals = {"_before": "_n", "_texts_before": "_texts"}
    rows = number_rows(texts, keys, order, ties, "_rn", totals, {"_first_id": "doc_id"}, hot_rows=hot_chars, weight="_n")
    follows = F.col("_texts_before") > 0
    rows = (
        rows.where(F.col("_texts") == 1)
        .select(
            *keys,
            "_first_id",
            "_texts_before",
            F.when(follows, F.concat(F.lit(separator), "text")).otherwise(F.col("text")).alias("text"),
            (F.col("_before") + gap * F.greatest(F.col("_texts_before") - 1, F.lit(0))).alias("_at"),
        )
        .where((F.length("text") > 0) | ~follows)
    )
    cells = cut_stream(rows, keys, F.col("_at"), F.length("text"), part_chars)
    fragment = F.struct("_at", "_texts_before", F.substring("text", F.col("from_") + 1, F.col("take")).alias("text"))
    return (
        cells.select(*keys, "cell", "_first_id", fragment.alias("fragment"))
        .groupBy(*keys, "cell")
        .agg(F.array_sort(F.collect_list("fragment")).alias("fragments"), F.min("_first_id").alias("_first_id"))
        .select(
            *keys,
            F.concat(F.lit("packed_"), "_first_id").alias("doc_id"),
            F.col("cell").alias("part"),
            F.array_join("fragments.text", "").alias("text"),
        )
    )


def pack_authors_sampled(
    docs: DataFrame,
    separator: str = "\n\n\n",
    k: int = 10_000,
    keys: Sequence[str] = ("source", "author"),
    seed: str = "42",
    part_chars: int = PART_CHARS,
    hot_rows: int = HOT_ROWS,
    hot_chars: int = HOT_CHARS,
) -> DataFrame:
    """``pack_authors`` over at most ``k`` drawn texts of every author, in the order of the draw."""
    sampled = sample_per_author(docs, k, seed, keys, hot_rows)
    return pack_authors(sampled, separator, keys, "rn", seed, part_chars, hot_chars)


def union_corpora(corpora: Sequence[DataFrame]) -> DataFrame:
    """The corpora as one table."""
    first, *others = corpora
    for other in others:
        first = first.unionByName(other)
    return first
