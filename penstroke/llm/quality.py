"""Quality from random-indexing word vectors pooled per document, and a two-layer network with calibrated probabilities.

Every word has a sparse random index vector; its word vector is the sum of the index vectors of the words next to it,
counted over all documents. A document is the mean, spread and mean step of the vectors of its words, and a small
network, fitted on a bounded sample of labelled documents, turns that into a probability.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penstroke.llm import tokenization as K
from penstroke.staging import stage

BUCKETS, DIMENSIONS = 1 << 15, 32
"""Words are hashed into buckets, so the word vectors are a table of fixed size."""

NONZERO, SEED = 4, 42
NEIGHBOURS = 2
"""Index vectors have so many places of +1 or -1; words so far away on either side count as neighbours."""

POSITIONS = 1 << 18
"""Words in running text whose vectors a task holds at a time."""

CACHED_TOKENS = 200_000
LABELLED_ROWS = 5_000
"""Documents per label that the network is fitted on; weights restore the shares of the labels."""

CALIBRATION_SHARE = 5
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 64, 3e-3, 1e-4
FEATURES = 3 * (DIMENSIONS + 1) + 1

_PARTS = re.compile(r"\w+|[^\w\s]+")


def words_of(token: str) -> list[str]:
    """The words of a token without blanks: letters and digits in small letters, signs apart; capitals are marked by a
    word of their own, a run of signs is cut to two."""
    if token.isalpha():
        return ["<capitals>", token.lower()] if len(token) > 1 and token.isupper() else [token.lower()]
    out = []
    for part in _PARTS.findall(token):
        if not part[0].isalnum():
            part = part[:2]
        elif len(part) > 1 and part.isupper():
            out.append("<capitals>")
        out.append(part.lower())
    return out


class TokenTable:
    """Buckets of the words of tokens, remembered within a task."""

    def __init__(self) -> None:
        self.known: dict[str, list[int]] = {}

    def positions(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(bucket, row)`` of the words of all texts in running order."""
        lists = pc.utf8_split_whitespace(texts.cast(pa.large_string()))
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        if len(self.known) > CACHED_TOKENS:
            self.known = {}
        tokens = coded.dictionary.to_pylist()
        for t in tokens:
            if t not in self.known:
                self.known[t] = [zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in words_of(t)]
        parts = [self.known[t] for t in tokens]
        size = np.array([len(p) for p in parts], np.int64)
        flat, start = np.array([b for p in parts for b in p], np.int32), np.cumsum(size) - size
        token = coded.indices.to_numpy()
        many = size[token]
        ends = np.cumsum(many)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start[token] - (ends - many), many)
        return flat[at], np.repeat(np.repeat(np.arange(len(texts)), counts), many)


def index_vectors() -> np.ndarray:
    """A sparse vector of +1 and -1 per bucket, the same everywhere, by dimension; the last column, all 0, is no word."""
    random = np.random.default_rng(SEED)
    out = np.zeros((BUCKETS + 1, DIMENSIONS), np.int8)
    places = random.random((BUCKETS, DIMENSIONS)).argsort(1)[:, :NONZERO]
    out[np.arange(BUCKETS)[:, None], places] = random.integers(0, 2, (BUCKETS, NONZERO)) * 2 - 1
    return np.ascontiguousarray(out.T)


def _apart(bucket: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The buckets of all texts with room before, between and after them, where no word is."""
    text = np.cumsum(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
    out = np.full(len(bucket) + NEIGHBOURS * (int(text[-1]) + 1 if len(text) else 1), BUCKETS, np.int32)
    out[np.arange(len(bucket)) + NEIGHBOURS * text] = bucket
    return out


def add_contexts(total: np.ndarray, bucket: np.ndarray, row: np.ndarray, index: np.ndarray) -> None:
    """Add to ``total`` the neighbours' index vectors of every word, and in the last column how often it occurs."""
    spread = _apart(bucket, row)
    for start in range(NEIGHBOURS, len(spread) - NEIGHBOURS, POSITIONS):
        end = min(start + POSITIONS, len(spread) - NEIGHBOURS)
        near, word = spread[start - NEIGHBOURS : end + NEIGHBOURS], spread[start:end]
        total[:, DIMENSIONS] += np.bincount(word, minlength=BUCKETS + 1)[:BUCKETS]
        n = end - start
        for d in range(DIMENSIONS):
            v = index[d][near]
            context = sum(v[k : k + n] for k in range(2 * NEIGHBOURS + 1) if k != NEIGHBOURS)
            total[:, d] += np.bincount(word, context, BUCKETS + 1)[:BUCKETS].astype(np.int64)


def _portions(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    texts = pc.fill_null(texts, "")
    return ((a, texts.slice(a, b - a)) for a, b in K.slices(texts))


def count_contexts(texts: DataFrame, text: str) -> np.ndarray:
    """Context sums and counts per bucket over all texts: partial sums per task, ``BUCKETS`` rows at most to the driver."""
    columns = [f"c{i}" for i in range(DIMENSIONS + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, index, table = np.zeros((BUCKETS, DIMENSIONS + 1), np.int64), index_vectors(), TokenTable()
        for batch in batches:
            for _, part in _portions(batch.column(0)):
                add_contexts(total, *table.positions(part), index)
        seen = np.flatnonzero(total[:, DIMENSIONS])
        yield pa.RecordBatch.from_arrays([pa.array(seen), *(pa.array(total[seen, i]) for i in range(DIMENSIONS + 1))], names=["bucket", *columns])

    counted = texts.select(text).mapInArrow(run, "bucket long, " + ", ".join(f"{c} long" for c in columns))
    rows = counted.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()
    total = np.zeros((BUCKETS, DIMENSIONS + 1))
    total[rows["bucket"].to_numpy()] = rows[columns].to_numpy()
    return total


def word_vectors(total: np.ndarray) -> np.ndarray:
    """Unit word vectors, less the mean of all words in running text, and the logarithm of a word's share, by dimension."""
    n = total[:, DIMENSIONS]
    mean = total[:, :DIMENSIONS].sum(0) / max(1.0, n.sum())
    vectors = total[:, :DIMENSIONS] / np.maximum(n, 1)[:, None] - mean
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None]
    share = np.log((n + 1) / (n.sum() + BUCKETS))
    return np.ascontiguousarray(np.concatenate([vectors, share[:, None] / 4], 1).T)


def pool(bucket: np.ndarray, row: np.ndarray, rows: int, vectors: np.ndarray) -> np.ndarray:
    """Per text the mean, the spread, and the mean size of the step to the next word, of the vectors of its words, and the
    logarithm of their number; zeros for a text without words. ``vectors`` are by dimension. Rounded, so the order of
    sums doesn't show."""
    width = len(vectors)
    sums = np.zeros((3, width, rows))
    n = np.bincount(row, minlength=rows)
    for start in range(0, len(bucket), POSITIONS):
        here, of = bucket[start : start + POSITIONS + 1], row[start : start + POSITIONS + 1]  # one word more for the last step
        size = min(len(here), POSITIONS)
        ends = np.flatnonzero(of[1:] != of[:-1])
        first = np.r_[0, ends[ends < size - 1] + 1]
        text = of[first]
        for d in range(width):
            v = vectors[d][here]
            step = np.abs(np.diff(v, append=v[-1:]))
            step[ends] = 0
            v, step = v[:size], step[:size]
            for k, x in enumerate((v, v * v, step)):
                sums[k, d, text] += np.add.reduceat(x, first)
    mean, square, step = (sums / np.maximum(n, 1)).transpose(0, 2, 1)
    spread = np.sqrt(np.maximum(square - mean * mean, 0))
    return np.round(np.concatenate([mean, spread, step, np.log1p(n)[:, None]], 1), 5)


def pooled_vectors(docs: DataFrame, vectors: np.ndarray, key: str, text: str) -> DataFrame:
    """``key`` and ``features`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # BUCKETS x (DIMENSIONS + 1) numbers

    @F.arrow_udf("array<float>")
    def pooled(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = TokenTable()
        for part in parts:
            found = [pool(*table.positions(texts), len(texts), shared.value).astype(np.float32) for _, texts in _portions(part)]
            flat = np.concatenate([np.empty(0, np.float32), *(f.ravel() for f in found)])
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * FEATURES), pa.array(flat))

    return docs.select(F.col(key), pooled(F.col(text)).alias("features"))


@dataclass(frozen=True)
class Network:
    """Two layers over standardised features; ``temperature`` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(x @ w1 + b1) @ w2 + b2[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _fit_layers(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Weights of both layers by Adam on the weighted log loss, with decaying steps."""
    random = np.random.default_rng(SEED)
    layers = [random.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), random.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    steps, total = 0, EPOCHS * -(-len(x) // BATCH)
    for _ in range(EPOCHS):
        order = random.permutation(len(x))
        for k in range(0, len(x), BATCH):
            at = order[k : k + BATCH]
            w1, b1, w2, b2 = layers
            hidden = np.tanh(x[at] @ w1 + b1)
            p = 1 / (1 + np.exp(-np.clip(hidden @ w2 + b2[0], -30, 30)))
            out = weight[at] * (p - y[at]) / len(at)
            back = out[:, None] * w2 * (1 - hidden * hidden)
            slopes = (x[at].T @ back + DECAY * w1, back.sum(0), hidden.T @ out + DECAY * w2, np.array([out.sum()]))
            steps += 1
            rate = RATE * (1 - steps / (total + 1))
            for p_, g, m, v in zip(layers, slopes, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p_ -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
    return tuple(layers)


def best_temperature(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The temperature of least weighted log loss, searched over its logarithm; 1 without rows."""
    if not len(y):
        return 1.0
    candidates = np.exp(np.linspace(np.log(0.25), np.log(16), 97))
    signed = np.where(y == 1, logits, -logits)
    return float(min(candidates, key=lambda t: (weight * np.logaddexp(0, -signed / t)).sum()))


def fit_network(features: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Network:
    """Fit on rows in a fixed order; every ``CALIBRATION_SHARE``-th sets the temperature only."""
    held = np.arange(len(y)) % CALIBRATION_SHARE == CALIBRATION_SHARE - 1
    mean, scale = features[~held].mean(0), np.maximum(features[~held].std(0), 1e-3)
    x = np.clip((features - mean) / scale, -8, 8)
    layers = _fit_layers(x[~held], y[~held].astype(float), weight[~held])
    network = Network(mean, scale, layers, 1.0)
    return Network(mean, scale, layers, best_temperature(network.logits(features[held]), y[held], weight[held]))


def fit_quality(pooled: DataFrame, labels: DataFrame, key: str, label: str) -> Network | float:
    """A network fitted on ``pooled`` rows with a label; without both labels, the share of label 1 (0.5 without any).

    Up to ``LABELLED_ROWS`` documents per label, those with the smallest digests of their ids, meet in one task, as
    vectors of ``FEATURES`` numbers; weights restore the shares of all labelled documents. Of several labels of an
    id the highest counts; of several documents of an id one is taken.
    """
    gold = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    gold = stage(gold.groupBy(key).agg((F.max(label) > 0).cast("int").alias("label")), "quality-labels")
    rows = stage(pooled.join(gold, key).groupBy(key, "label").agg(F.min("features").alias("features")), "quality-rows")
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return float(*n) if n else 0.5
    digest = F.xxhash64(key)
    # A digest below which about LABELLED_ROWS rows of the label lie keeps all others out of the shuffle.
    span = {y: min(1.0, 1.25 * LABELLED_ROWS / k + 50 / k) for y, k in n.items()}
    place = (digest.cast("double") / 2.0**64 + 0.5) <= F.when(F.col("label") == 1, span[1]).otherwise(span[0])
    first = Window.partitionBy("label").orderBy("_digest", key)
    near = rows.where(place).select("label", "features", digest.alias("_digest"), key)
    chosen = near.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= LABELLED_ROWS)

    def train(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_digest"], kind="stable")
        y = frame["label"].to_numpy()
        taken = np.bincount(y, minlength=2)
        weight = np.array([n[k] / max(1, taken[k]) for k in (0, 1)])
        weight = (weight / (weight * taken).sum() * len(y))[y]
        network = fit_network(np.stack(frame["features"]).astype(np.float64), y, weight)
        parts = [network.mean, network.scale, *(p.ravel() for p in network.layers), np.array([network.temperature])]
        return pd.DataFrame({"numbers": [np.concatenate(parts).astype("<f8").tobytes()]})

    one = chosen.select("label", "features", "_digest", F.lit(0).alias("_all")).groupBy("_all")
    numbers = np.frombuffer(one.applyInPandas(lambda frame: train(frame), "numbers binary").first()["numbers"], "<f8")
    shapes = ((FEATURES,), (FEATURES,), (FEATURES, HIDDEN), (HIDDEN,), (HIDDEN,), (1,), (1,))
    ends = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
    mean, scale, *layers, temperature = (p.reshape(s) for p, s in zip(np.split(numbers, ends), shapes))
    return Network(mean, scale, tuple(layers), float(temperature[0]))


def quality_scores(
    docs: DataFrame, labels: DataFrame, learnable: Column, key: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """``key`` and ``score``, the calibrated chance of label 1, of every row of ``docs``.

    The word vectors come from all texts; labels are learned only from ids for which ``learnable`` holds. Ids, the
    order of rows and other columns are no features. A missing text is an empty one; an empty text has a score like any
    other. Rows that share an id are scored one by one. The texts are read twice and cross no shuffle.
    """
    vectors = word_vectors(count_contexts(docs, text))
    pooled = stage(pooled_vectors(docs, vectors, key, text), "pooled")
    model = fit_quality(pooled.where(learnable), labels.select(key, label).where(learnable), key, label)
    if isinstance(model, float):
        return pooled.select(key, F.lit(model).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    @F.pandas_udf("double")
    def scored(features: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(np.stack(features).astype(np.float64)) if len(features) else [], dtype=float)

    return pooled.select(key, scored("features").alias("score"))
