"""Embedding chunks, pooling and centroids."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penstroke.functions import vectors as V
from penstroke.operators import ranks as R

Encoder = Callable[[list[np.ndarray], list[np.ndarray]], np.ndarray]


def hashed_bag(dimension: int = 256) -> Callable[[], Encoder]:
    """The built-in encoder: how often a chunk's tokens fall into each of ``dimension`` buckets of token ids."""

    def load() -> Encoder:
        def encode(ids: list[np.ndarray], masks: list[np.ndarray]) -> np.ndarray:
            sizes = np.array([len(i) for i in ids])
            rows = np.repeat(np.arange(len(ids)), sizes)
            cells = rows * dimension + np.concatenate([*ids, np.empty(0, int)]).astype(np.int64) % dimension
            weights = np.concatenate([*masks, np.empty(0)])
            return np.bincount(cells, weights, len(ids) * dimension).reshape(len(ids), dimension)

        return encode

    return load


def token_identity() -> Encoder:
    """An encoder for trial runs: the token ids themselves."""

    def encode(ids: list[np.ndarray], masks: list[np.ndarray]) -> np.ndarray:
        return np.stack(ids).astype(float)

    return encode


def embed_chunks(
    chunks: DataFrame, load: Callable[[], Encoder], keep: Sequence[str], batch_rows: int = 64
) -> DataFrame:
    """Add ``embedding``, a vector of length 1, made by a user's encoder.

    ``load`` runs once per task and returns a function from token ids and attention masks of a batch of chunks to a
    matrix with one row per chunk. The chunk row carries its document and author, which is the chunk-to-document map.
    """
    keep = list(keep)
    schema = T.StructType(
        [*(chunks.schema[c] for c in keep), T.StructField("embedding", T.ArrayType(T.DoubleType()))]
    )
    masks = "attention_mask" if "attention_mask" in chunks.columns else F.transform("input_ids", lambda _: F.lit(1).cast("tinyint"))
    rows = chunks.select(*keep, F.col("input_ids").alias("_ids"), (F.col(masks) if isinstance(masks, str) else masks).alias("_mask"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load()
        for whole in batches:
            for at in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(at, batch_rows)
                ids = batch.column("_ids").to_numpy(zero_copy_only=False)
                mask = batch.column("_mask").to_numpy(zero_copy_only=False)
                matrix = np.asarray(encode(list(ids), list(mask)), dtype=float)
                matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
                offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
                vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), vectors], [*keep, "embedding"])

    return rows.mapInArrow(run, schema)


def embed_masked_chunks(
    chunks: DataFrame,
    load: Callable[[], Encoder],
    keep: Sequence[str],
    lookup: DataFrame | None = None,
    threshold: DataFrame | int | None = None,
    **kwargs,
) -> DataFrame:
    """``embed_chunks`` after masking content by token rank, when both ranks and a threshold are given."""
    if lookup is not None and threshold is not None:
        chunks = R.mask_content(R.attach_token_ranks(chunks, lookup), threshold)
    return embed_chunks(chunks, load, keep, **kwargs)


def normalize_embeddings(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    return embeddings.withColumn(column, V.l2_normalize(column))


def chunk_to_author(embeddings: DataFrame, documents: DataFrame) -> DataFrame:
    """Give chunk vectors the author of their document."""
    return embeddings.join(documents.select("doc_id", "author"), "doc_id")


def author_centroids(embeddings: DataFrame, keys: Sequence[str] = ("author",), column: str = "embedding") -> DataFrame:
    """The mean of the normalised vectors of every author, not normalised again.

    Vectors are summed on the map side, one running mean per author and task.
    """
    unit = array_to_vector(V.l2_normalize(column))
    mean = Summarizer.mean(F.col("_unit"))
    return embeddings.select(*keys, unit.alias("_unit")).groupBy(*keys).agg(vector_to_array(mean).alias("centroid"))


def masked_mean_pool(tokens: DataFrame, keys: Sequence[str], vector: str = "vector", mask: str = "mask") -> DataFrame:
    """Mean of the token vectors of a chunk, weighted by the mask; the weight sum counts as at least 1e-9.

    One row per key and position, summed on the map side.
    """
    placed = tokens.select(*keys, F.col(mask).cast("double").alias("_m"), F.posexplode(vector).alias("pos", "_x"))
    value = F.sum(F.col("_x").cast("double") * F.col("_m")) / F.greatest(F.sum("_m"), F.lit(1e-9))
    return placed.groupBy(*keys, "pos").agg(value.alias("value"))
