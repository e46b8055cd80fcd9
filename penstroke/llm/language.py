"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penstroke.staging import stage

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SHARD_ROWS, SHARD_NGRAMS = 8_000, 20_000_000
"""Labelled rows, and distinct n-grams in them at 6 bytes each, about, that a classifier is fitted on in one go; the model is the
mean over all such shards."""

MANY_COPIES = 1_000
"""The copies of a text with more of them than this are counted, and their number is dealt evenly to the shards."""

CALIBRATION_SHARE = 5
"""One in this many of the labelled rows only sets the temperature."""

TEMPERATURES = np.exp(np.linspace(np.log(0.2), np.log(20), 185))
_WEIGHT_UNIT, _LOSS_UNIT, _BINS = 2.0**-28, 2.0**-20, 1 << 12
_ROWS, _FIRST_BIN = -1, -2

EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
UNDETERMINED = "und"

LEAST_NGRAMS = 60
"""N-grams of a text that tell whether it is strange; a shorter one is not called so."""

USUAL_SHARE = 0.99
"""Share of the rows fitted on below whose largest mean idf nothing is strange; the limit lies twice as far above it as it
lies above the median, so neither a few odd rows nor mislabelled ones move it much."""

_SLICE_CHARS = 1 << 18
"""Characters whose n-grams a worker holds at a time, at about 100 bytes each; results don't depend on it."""


@dataclass(frozen=True)
class LanguageModel:
    """``weights[bucket, language]``; ``idf`` per bucket; scores are divided by ``temperature``. A text with a larger mean
    idf than ``limit`` is strange."""

    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    limit: float

    def scores(self, bucket: np.ndarray, row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        """Probabilities of the languages for each of ``rows`` texts."""
        z = np.tile(self.bias, (rows, 1))
        for k in range(len(self.languages)):
            z[:, k] += np.bincount(row, value * self.weights[bucket, k], rows)
        return _softmax(z / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``_SLICE_CHARS`` characters each."""
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    edges = np.flatnonzero(np.diff(np.cumsum(sizes) // _SLICE_CHARS)) + 1
    bounds = [0, *edges.tolist(), len(texts)]
    return ((a, b) for a, b in zip(bounds, bounds[1:]) if a < b)


def ngram_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, bucket, count)`` of the character n-grams of whole texts, in small letters, hashed into ``BUCKETS``.

    Characters other than letters count as one blank, and runs of them as one.
    """
    cleaned = pc.replace_substring_regex(pc.utf8_lower(texts), r"\PL+", " ")
    cleaned = pc.binary_join_element_wise("", pc.utf8_trim(cleaned, " "), "", " ")
    lengths = pc.utf8_length(cleaned).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.frombuffer("".join(cleaned.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # characters from here to the end of the text
    keys = []
    for order in ORDERS:
        n = len(codes) - order + 1
        if n <= 0:
            continue
        mixed = np.full(n, order, np.uint64)
        for k in range(order):
            mixed = (mixed ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        inside = left[:n] >= order
        keys.append(row[:n][inside] * BUCKETS + (mixed[inside] >> np.uint64(11)).astype(np.int64) % BUCKETS)
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return key // BUCKETS, key % BUCKETS, count


def tf_idf(row: np.ndarray, bucket: np.ndarray, count: np.ndarray, idf: np.ndarray, rows: int) -> np.ndarray:
    """Values of unit length per row."""
    value = (1 + np.log(count)) * idf[bucket]
    norm = np.sqrt(np.bincount(row, value * value, rows))
    return value / norm[row]


def strangeness(row: np.ndarray, bucket: np.ndarray, count: np.ndarray, idf: np.ndarray, rows: int) -> np.ndarray:
    """The mean idf of the n-grams of each text; 0 for a text with few of them."""
    n = np.bincount(row, count, rows)
    return np.where(n >= LEAST_NGRAMS, np.bincount(row, count * idf[bucket], rows) / np.maximum(n, 1), 0.0)


def document_frequencies(texts: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Texts per n-gram bucket, and texts, over all rows. The driver gets ``BUCKETS`` numbers at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            texts = batch.column(0)
            rows += len(texts)
            for a, b in _portions(texts):
                total += np.bincount(ngram_counts(texts.slice(a, b - a))[1], minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(total[seen], rows))], names=["bucket", "n"])

    counted = texts.where(F.col(text).isNotNull()).select(text).mapInArrow(run, "bucket long, n long")
    collected = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS + 1, np.int64)
    df[collected["bucket"].to_numpy()] = collected["n"].to_numpy()
    return df[:BUCKETS], int(df[BUCKETS])


class FollowTheLeader:
    """Follow-the-regularised-leader with an elastic-net penalty.

    Per coordinate, ``z`` holds the gradients less the pull of past weights and ``n`` their squares; a weight is zero
    while ``|z|`` is below the first penalty. The last coordinate is the bias.
    """

    def __init__(self, classes: int):
        self.z, self.n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, bucket: np.ndarray, value: np.ndarray, label: int) -> None:
        at, x = np.append(bucket, BUCKETS), np.append(value, 1.0)
        w = self.weights(at)
        p = _softmax((x @ w)[None])[0]
        p[label] -= 1
        g, n = x[:, None] * p, self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] += g * g


def _fit_shards(languages: tuple[str, ...], idf: np.ndarray):
    """From rows ``(shard, digest, label, text, held, times)`` in the order of the first three to ``(key, value)`` of every shard, in
    whole numbers, so that sums don't depend on their order: weights times rows, how many rows there were, and a histogram of how
    strange the texts are. A row stands for ``times`` equal ones, and all are learned from ``EPOCHS`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {name: k for k, name in enumerate(languages)}
        small = np.min_scalar_type(BUCKETS - 1)
        shard, leader, rows, kept, bins = None, None, 0, [], np.zeros(0, np.int64)

        def learn(bucket: np.ndarray, value: np.ndarray, label: int, times: int) -> None:
            for _ in range(times):
                leader.learn(bucket, value, label)

        def fitted() -> pa.RecordBatch:
            for _ in range(EPOCHS - 1):
                for bucket, count, label, times in kept:
                    bucket = bucket.astype(np.int64)
                    learn(bucket, tf_idf(np.zeros(len(bucket), np.int64), bucket, count, idf, 1), label, times)
            w = leader.weights(slice(None)).ravel()
            at, seen = np.flatnonzero(w), np.flatnonzero(bins)
            key = np.concatenate([at, [_ROWS], _FIRST_BIN - seen])
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.concatenate([np.rint(w[at] * rows / _WEIGHT_UNIT).astype(np.int64), [rows], bins[seen]]))], names=["key", "value"])

        for batch in batches:
            of, held, times = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 4, 5))
            label = batch.column(2).to_pylist()
            for a, b in _portions(batch.column(3)):
                row, bucket, count = ngram_counts(batch.column(3).slice(a, b - a))
                value = tf_idf(row, bucket, count, idf, b - a)
                strange = strangeness(row, bucket, count, idf, b - a)
                ends = np.searchsorted(row, np.arange(b - a + 1))
                for i in range(b - a):
                    if of[a + i] != shard:
                        if shard is not None:
                            yield fitted()
                        shard, leader, rows, kept, bins = of[a + i], FollowTheLeader(len(languages)), 0, [], np.zeros(0, np.int64)
                    n = int(times[a + i])
                    if strange[i] > 0:
                        place = int(strange[i] * _BINS)
                        bins = np.pad(bins, (0, max(0, place + 1 - len(bins))))
                        bins[place] += n
                    if not held[a + i]:
                        own = slice(ends[i], ends[i + 1])
                        learn(bucket[own], value[own], number[label[a + i]], n)
                        kept.append((bucket[own].astype(small), count[own].astype(np.uint32), number[label[a + i]], n))
                        rows += n
        if shard is not None:
            yield fitted()

    return run


def _best_temperature(held: DataFrame, model: LanguageModel) -> float:
    """Of ``TEMPERATURES`` the one with the least log loss over all rows ``(text, label)`` held back."""
    number = {name: k for k, name in enumerate(model.languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(TEMPERATURES), np.int64)
        for batch in batches:
            y = np.array([number[v] for v in batch.column(1).to_pylist()], np.int64)
            for a, b in _portions(batch.column(0)):
                row, bucket, count = ngram_counts(batch.column(0).slice(a, b - a))
                z = np.log(np.maximum(model.scores(bucket, row, tf_idf(row, bucket, count, model.idf, b - a), b - a), 1e-300))
                for k, t in enumerate(TEMPERATURES):
                    p = _softmax(z / t)[np.arange(b - a), y[a:b]]
                    total[k] += np.rint(-np.log(np.maximum(p, 1e-12)) / _LOSS_UNIT).astype(np.int64).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "loss"])

    loss = held.select("text", "label").mapInArrow(run, "k long, loss long").groupBy("k").agg(F.sum("loss").alias("loss")).toPandas()
    loss = loss.sort_values("k")["loss"].to_numpy()
    return float(TEMPERATURES[loss.argmin()]) if len(loss) and loss.any() else 1.0


def _quantile(bins: np.ndarray, share: float) -> float:
    """The middle of the bin below which lies ``share`` of what a histogram counts."""
    return (np.searchsorted(np.cumsum(bins), share * bins.sum()) + 0.5) / _BINS


def fit_language_model(labelled: DataFrame, text: str = "text", label: str = "lang") -> LanguageModel | None:
    """Fit on all rows with a label and a letter; ``None`` if there are none.

    Document frequencies count all rows. The classifiers are fitted on shards of about ``SHARD_ROWS`` rows each, or fewer with
    many n-grams, dealt and ordered by the digest of the text, ``EPOCHS`` times over the rows; the model is their mean. Rows
    with a digest in one of ``CALIBRATION_SHARE`` parts are held back from this and set the temperature; how strange texts
    may be is told by all rows. Nothing depends on ids, order or partitioning; every copy of a text counts.
    """
    rows = labelled.where(F.col(label).isNotNull() & has_letter(text)).select(F.col(text).alias("text"), F.col(label).alias("label"))
    df, total = document_frequencies(rows, "text")
    if not total:
        return None
    idf = np.log((1 + total) / (1 + df)) + 1
    languages = tuple(sorted(r["label"] for r in rows.select("label").distinct().collect()))
    digest = F.xxhash64("text")
    rows = rows.withColumns({"digest": digest, "held": F.pmod(F.shiftrightunsigned(digest, 32), F.lit(CALIBRATION_SHARE)) == CALIBRATION_SHARE - 1})
    shards = max(1, -(-total // SHARD_ROWS), -(-int(df.sum()) // SHARD_NGRAMS))
    same = ["label", "digest", "held"]
    copied = stage(rows.groupBy(*same).agg(F.count("*").alias("n")).where(F.col("n") > MANY_COPIES).drop("n"), "copied-texts")
    own = F.pmod("digest", F.lit(shards))
    single = rows.join(F.broadcast(copied), same, "left_anti").withColumns({"shard": own, "times": F.lit(1).cast("long")})
    counted = rows.join(F.broadcast(copied), same, "left_semi").groupBy(*same).agg(F.min("text").alias("text"), F.count("*").alias("n"))
    parts = counted.withColumn("parts", F.least("n", F.lit(shards))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    share = F.floor(F.col("n") / F.col("parts")) + (F.col("part") < F.col("n") % F.col("parts")).cast("long")
    several = parts.withColumns({"shard": F.pmod(own + F.col("part"), F.lit(shards)), "times": share})
    columns = ["shard", "digest", "label", "text", "held", "times"]
    dealt = single.select(*columns).unionByName(several.select(*columns))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "digest", "label")
    found = dealt.mapInArrow(_fit_shards(languages, idf), "key long, value long")
    sums = found.groupBy("key").agg(F.sum("value").alias("value")).toPandas()
    key, value = sums["key"].to_numpy(), sums["value"].to_numpy()
    weights = np.zeros((BUCKETS + 1) * len(languages))
    weights[key[key >= 0]] = value[key >= 0] * _WEIGHT_UNIT / max(1, int(value[key == _ROWS].sum()))
    weights = weights.reshape(BUCKETS + 1, -1)
    place, limit = _FIRST_BIN - key[key <= _FIRST_BIN], np.inf
    if len(place):
        bins = np.zeros(place.max() + 1, np.int64)
        bins[place] = value[key <= _FIRST_BIN]
        usual = _quantile(bins, USUAL_SHARE)
        limit = usual + 2 * (usual - _quantile(bins, 0.5))
    model = LanguageModel(languages, idf, weights[:BUCKETS].copy(), weights[BUCKETS].copy(), 1.0, limit)
    return replace(model, temperature=_best_temperature(rows.where("held"), model))


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def predict_language(docs: DataFrame, model: LanguageModel | None, text: str = "text", strange: str | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score``, the calibrated probability of it, from the whole text.

    ``strange`` names a column that tells whether the text's n-grams are much rarer, on the mean, than those of the texts
    that the model was fitted on: then it is in none of the languages learned, whichever of them is likeliest.
    Rarity needs documents: a model of a few hundred calls hardly anything strange.

    A text that is missing or has no letter is ``und`` with score 0; so is every text without a model. Ties go to the
    first language in order. All columns are kept, but for clashing ones, which are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    if model is None:
        named = docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
        return named.withColumn(strange, F.lit(False)) if strange else named
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by BUCKETS and the languages

    # Texts stay in Arrow's buffers: as Python strings, a batch of them would be held three times over.
    @F.arrow_udf("struct<lang_pred string, score double, mean_idf double>")
    def predicted(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        names = pa.array(model.languages, pa.string())
        for part in parts:
            best, score, mean = np.zeros(len(part), np.int64), np.zeros(len(part)), np.zeros(len(part))
            for a, b in _portions(pc.fill_null(part, "")):
                row, bucket, count = ngram_counts(pc.fill_null(part.slice(a, b - a), ""))
                p = model.scores(bucket, row, tf_idf(row, bucket, count, model.idf, b - a), b - a)
                best[a:b], score[a:b] = p.argmax(1), p.max(1)
                mean[a:b] = strangeness(row, bucket, count, model.idf, b - a)
            yield pa.StructArray.from_arrays([names.take(pa.array(best)), pa.array(score), pa.array(mean)], ["lang_pred", "score", "mean_idf"])

    found = F.when(has_letter(text), predicted(F.col(text)))
    out = docs.withColumn("__language", found)
    added = {"lang_pred": F.coalesce("__language.lang_pred", F.lit(UNDETERMINED)), "score": F.coalesce("__language.score", F.lit(0.0))}
    if strange:
        added[strange] = F.coalesce(F.col("__language.mean_idf") > model.limit, F.lit(False))
    return out.withColumns(added).drop("__language")
