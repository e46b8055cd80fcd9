"""Seeded sampling and the split by author."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penstroke.functions import text as X
from penstroke.operators.distributed import HOT_ROWS, drop_members, keep_members, number_rows, salted_join
from penstroke.staging import stage

VALIDATION_AUTHORS = 256
TRAIN_CAP = 1270
TEXTS_PER_AUTHOR = 10_000
AUTHOR_KEYS = ("source", "author")


def number_by_digest(
    df: DataFrame,
    keys: Sequence[str],
    drawn: Sequence[Column | str],
    ties: Sequence[str],
    seed: str = "42",
    name: str = "rn",
    top: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Number the rows of every key in the order of a seeded digest of ``drawn``, several values joined by ``:``."""
    value = drawn[0] if len(drawn) == 1 else F.concat_ws(":", *(F.col(c).cast("string") if isinstance(c, str) else c for c in drawn))
    digested = df.withColumn("_digest", X.seeded_digest(value, seed=seed))
    digested = digested.withColumn("_order", X.digest_number("_digest"))
    numbered = number_rows(digested, keys, "_order", ["_digest", *ties], name, top=top, hot_rows=hot_rows)
    return numbered.drop("_digest", "_order")


def sample_per_author(
    docs: DataFrame,
    k: int = TEXTS_PER_AUTHOR,
    seed: str = "42",
    keys: Sequence[str] = ("author",),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """At most ``k`` documents of every author, drawn by seeded digest of the document id; ``rn`` is the draw."""
    return number_by_digest(docs, keys, ["doc_id"], ["doc_id"], seed, "rn", k, hot_rows)


def distinct_authors(df: DataFrame, keys: Sequence[str] = AUTHOR_KEYS) -> DataFrame:
    return df.select(*keys).distinct()


def val_authors(
    authors: DataFrame, k: int = VALIDATION_AUTHORS, seed: str = "42", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``k`` authors of every corpus for validation."""
    return number_by_digest(authors, ["source"], ["author"], ["author"], seed, "rn", k, hot_rows).drop("rn")


def train_candidates(authors: DataFrame, validation: DataFrame) -> DataFrame:
    """Authors not used for validation."""
    return drop_members(authors, validation, AUTHOR_KEYS)


def cap_train_authors(
    authors: DataFrame, caps: Mapping[str, int], seed: str = "42", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """At most ``caps[source]`` authors of each capped corpus, all authors of the others."""
    kept = authors.where(~F.col("source").isin(*caps))
    for source, cap in caps.items():
        of_source = authors.where(F.col("source") == source)
        capped = number_by_digest(of_source, ["source"], ["author"], ["author"], seed, "rn", cap, hot_rows)
        kept = kept.unionByName(capped.drop("rn"))
    return kept


def select_validation(chunks: DataFrame, validation: DataFrame) -> DataFrame:
    """Chunks of the validation authors."""
    return keep_members(chunks, validation, AUTHOR_KEYS)


def select_train(chunks: DataFrame, train: DataFrame) -> DataFrame:
    """Chunks of the training authors."""
    return keep_members(chunks, train, AUTHOR_KEYS)


def split_authors(
    authors: DataFrame,
    k: int = VALIDATION_AUTHORS,
    caps: Mapping[str, int] | None = None,
    seed: str = "42",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``(source, author, split)`` in one numbering: the first ``k`` validate, the rest, up to a cap, train.

    Candidates for training keep the order of the draw, so the n-th candidate is number ``k + n``.
    """
    numbered = number_by_digest(authors, ["source"], ["author"], ["author"], seed, "rn", hot_rows=hot_rows)
    split = F.when(F.col("rn") <= k, "val").otherwise("train")
    for source, cap in (caps or {}).items():
        numbered = numbered.where((F.col("source") != source) | (F.col("rn") <= k + cap))
    return numbered.select(*AUTHOR_KEYS, split.alias("split"))


def split_by_author(
    chunks: DataFrame,
    k: int = VALIDATION_AUTHORS,
    caps: Mapping[str, int] | None = None,
    seed: str = "42",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Chunks with ``split`` ('val' or 'train'), disjoint by corpus and author.

    ``chunks`` is read for its authors, which are stored, and once for the result, so it should be a stored table.
    """
    split = split_authors(stage(distinct_authors(chunks), "authors"), k, caps, seed, hot_rows)
    return salted_join(chunks, split, AUTHOR_KEYS)


def shuffle_within_author(chunks: DataFrame, seed: str = "42", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``chunk_rn``, a seeded random order of the chunks of every author."""
    drawn = ["doc_id", "chunk_idx"]
    return number_by_digest(chunks, AUTHOR_KEYS, drawn, drawn, seed, "chunk_rn", hot_rows=hot_rows)


def sample_views(
    chunks: DataFrame,
    n_views: int,
    epoch: int = 0,
    seed: str = "42",
    keys: Sequence[str] = ("author",),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``n_views`` chunks of every author without replacement, another draw for every epoch; ``view`` counts from 1.

    Authors with fewer chunks keep what they have; ``short_authors`` lists them.
    """
    drawn = ["doc_id", "chunk_idx", F.lit(str(epoch))]
    return number_by_digest(chunks, keys, drawn, ["doc_id", "chunk_idx"], seed, "view", n_views, hot_rows)


def fixed_val_views(chunks: DataFrame, n_views: int, seed: str = "42", **kwargs) -> DataFrame:
    """The one draw used in every validation."""
    return sample_views(chunks, n_views, 0, seed, **kwargs)


def short_authors(chunks: DataFrame, n_views: int, keys: Sequence[str] = ("author",)) -> DataFrame:
    """Authors with fewer than ``n_views`` chunks."""
    return chunks.groupBy(*keys).agg(F.count("*").alias("n_chunks")).where(F.col("n_chunks") < n_views)
