"""Toxicity by weak supervision: many noisy voters, a generative label model, and a linear classifier on its labels."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penstroke.llm import tokenization as K
from penstroke.staging import stage

# Insults that a voter knows from the start.
INSULTS = ("clown", "disgusting", "dumb", "fool", "garbage", "idiot", "jerk", "loser", "moron", "pathetic", "scum", "stupid", "trash", "ugly", "worthless")

LABELLED_ROWS = 4_000
"""Documents per label, and as many of the others, that the classifier is fitted on; weights restore their shares."""

LEAST_DOCUMENTS = 3
LEAST_SHARE = 3 / 4_000
LEAST_RATIO = 6.0
"""A voter takes a term up from this many toxic documents and this share of them on, if it is this many times likelier there."""

LEAST_GAIN = 15.0
"""Twice the log likelihood ratio of a term's counts against chance, about one in ten thousand terms without meaning."""

COUNTED_TERMS = 400_000
"""Terms that a task counts before it passes its counts on."""

SLICE_BYTES = 2 << 20
"""Text whose words a task takes apart at a time."""

BUCKETS = 1 << 18
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.2, 1.0, 0.5, 0.05
EM_ROUNDS = 50
ANNOTATOR = 20.0
"""Weight, in rows, of the assumption that a given label is right; what the votes say then corrects it."""

PREFIXES = (3, 4, 5, 6, 7)
SUFFIX = 4
WORD_LEXICONS = 4
VOTERS = ("insults", *(f"words {i}" for i in range(WORD_LEXICONS)), *(f"prefix {k}" for k in PREFIXES), "suffix", "several", "shouting")
"""Thirteen voters that fire or not, so there are 8192 patterns of votes at most."""

KINDS = 2 + len(PREFIXES)
_SEVERAL, _SHOUTING = VOTERS.index("several"), VOTERS.index("shouting")
_SHOUTS = r"!{2,}|\p{Lu}{4,}"
_INSULTS = frozenset(INSULTS)
_STEP, _FIRST, _SECOND = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind + 1) * _STEP) * _FIRST
    h = (h ^ (h >> np.uint64(29))) * _SECOND
    return h ^ (h >> np.uint64(32))


def term_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, there)`` per word and kind of term: the word, its beginnings of ``PREFIXES`` characters, its last ``SUFFIX``,
    where it is that long. A beginning is hashed like a word of those characters, but for its kind."""
    n = len(words)
    hashes, there = np.zeros((n, KINDS), np.uint64), np.zeros((n, KINDS), bool)
    if not n:
        return hashes, there
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    length = np.fromiter(map(len, words), np.int64, n)
    start = np.cumsum(length) - length
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(max(int(length.max()), SUFFIX, *PREFIXES), _STEP, np.uint64))
        place = np.arange(len(codes)) - np.repeat(start, length)
        hashes[:, 0], there[:, 0] = _mixed(np.add.reduceat(codes * power[place], start), 0), True
        for kind, k in enumerate(PREFIXES, 1):
            long = np.flatnonzero(length >= k)
            h = (codes[start[long][:, None] + np.arange(k)] * power[:k]).sum(axis=1, dtype=np.uint64)
            hashes[long, kind], there[long, kind] = _mixed(h, kind), True
        long = np.flatnonzero(length > SUFFIX)
        last = (start + length)[long][:, None] - SUFFIX + np.arange(SUFFIX)
        h = (codes[last] * power[:SUFFIX]).sum(axis=1, dtype=np.uint64)
        hashes[long, KINDS - 1], there[long, KINDS - 1] = _mixed(h, KINDS - 1), True
    return hashes, there


def terms_of(words: list[str]) -> np.ndarray:
    """The terms of each word as numbers that name the voter in their last four bits; 0 where a word is too short."""
    hashes, there = term_hashes(words)
    voter = np.tile(np.arange(WORD_LEXICONS, WORD_LEXICONS + KINDS, dtype=np.uint64), (len(words), 1))
    voter[:, 0] = np.uint64(1) + (hashes[:, 0] >> np.uint64(8)) % np.uint64(WORD_LEXICONS)
    return np.where(there, hashes & ~np.uint64(15) | voter, np.uint64(0)).view(np.int64)


def buckets_of(words: list[str]) -> np.ndarray:
    """The features of the terms of each word, ``BUCKETS`` where a word is too short."""
    hashes, there = term_hashes(words)
    return np.where(there, (hashes >> np.uint64(20)) % np.uint64(BUCKETS), np.uint64(BUCKETS)).astype(np.int64)


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """``(row, word number, words)``: every word of every text once, in small letters."""
    cleaned = pc.replace_substring_regex(pc.utf8_lower(texts.cast(pa.large_string())), r"[^\pL\pN]+", " ")
    lists = pc.split_pattern(cleaned, " ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    size = max(1, len(words))
    key = np.unique(np.repeat(np.arange(len(counts)), counts) * size + coded.indices.to_numpy())
    row, word = key // size, key % size
    # The empty word, between two signs or at an end, is left out.
    real = np.array([w != "" for w in words], bool)
    at = np.cumsum(real) - 1
    kept = real[word] if len(words) else np.empty(0, bool)
    return row[kept], at[word[kept]] if len(words) else word, [w for w in words if w]


def votes_of(texts: pa.Array, lexicon: np.ndarray) -> np.ndarray:
    """The bits of the voters that fire for each text; ``lexicon`` holds the sorted terms taken up."""
    row, word, words = distinct_words(texts)
    terms = terms_of(words)
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, terms), len(lexicon) - 1)
        named = np.bitwise_or.reduce(np.where(lexicon[at] == terms, 1 << (terms & 15), 0), axis=1)
    else:
        named = np.zeros(len(words), np.int64)
    named = (named | np.array([w in _INSULTS for w in words], np.int64))[word]
    out = np.zeros(len(texts), np.int64)
    for bit in range(_SEVERAL):
        out[row[(named >> bit & 1) == 1]] |= 1 << bit
    out[np.bincount(row, named != 0, len(texts)) >= 2] |= 1 << _SEVERAL
    out[pc.match_substring_regex(texts, _SHOUTS).to_numpy(zero_copy_only=False)] |= 1 << _SHOUTING
    return out


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(term, clean, toxic)``: in how many of the texts ``(text, toxic)`` of a task each term occurs, by label. A term
    may have several rows."""
    held = np.zeros((3, 0), np.int64)

    def counted() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["term", "clean", "toxic"])

    for batch in batches:
        toxic = batch.column(1).to_numpy() > 0
        for a, b in K.slices(batch.column(0), SLICE_BYTES):
            row, word, words = distinct_words(batch.column(0).slice(a, b - a))
            term, number = np.unique(terms_of(words), return_inverse=True)
            number = number.reshape(len(words), KINDS)
            pairs = [np.unique(row * len(term) + number[word, kind]) for kind in range(KINDS)]  # kinds share no term but 0
            key = np.concatenate([np.empty(0, np.int64), *pairs])
            n = [np.bincount(key[toxic[a + key // max(1, len(term))] == y] % max(1, len(term)), minlength=len(term)) for y in (False, True)]
            held = _merged(np.concatenate([held, np.array([term, *n], np.int64)], axis=1))
            if held.shape[1] > COUNTED_TERMS:
                yield counted()
                held = np.zeros((3, 0), np.int64)
    yield counted()


def _merged(counts: np.ndarray) -> np.ndarray:
    """Counts with a column per term other than 0."""
    counts = counts[:, np.argsort(counts[0], kind="stable")]
    counts = counts[:, counts[0] != 0]
    if not counts.shape[1]:
        return counts
    first = np.flatnonzero(np.r_[True, counts[0, 1:] != counts[0, :-1]])
    return np.stack([counts[0, first], *(np.add.reduceat(c, first) for c in counts[1:])])


def learn_lexicons(labelled: DataFrame, rows: dict[int, int]) -> np.ndarray:
    """The sorted terms, of all rows ``(text, toxic)``, that are in several toxic texts, much rarer in the others, and so
    by more than chance: twice the log likelihood ratio is at least ``LEAST_GAIN``. ``rows`` counts the rows of each label.

    Only the terms taken up, at most (terms of a toxic document) / ``LEAST_SHARE``, reach the driver.
    """
    n = labelled.mapInArrow(count_terms, "term long, clean long, toxic long")
    n = n.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    toxic, clean = (sum(k for y, k in rows.items() if (y > 0) == of) for of in (True, False))
    likelier = ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1))
    both, share = F.col("toxic") + F.col("clean"), (toxic + 0.5) / (toxic + clean + 1)
    part = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (both * p))).otherwise(0.0)
    gain = 2 * (part("toxic", share) + part("clean", 1 - share))
    found = n.where((F.col("toxic") >= max(LEAST_DOCUMENTS, LEAST_SHARE * toxic)) & (likelier >= LEAST_RATIO) & (gain >= LEAST_GAIN))
    return np.sort(np.array([r["term"] for r in found.select("term").collect()], np.int64))


@dataclass(frozen=True)
class LabelModel:
    """``P(votes, toxic)`` as a tree: every voter depends on the label and on the voter it is most correlated with.

    ``parent[j]`` is that voter or -1, ``table[j, y, v]`` the chance that ``j`` fires given label and parent's vote. A given
    label is one more vote: ``annotator[y]`` is the chance that it says toxic.
    """

    prior: float
    parent: np.ndarray
    table: np.ndarray
    annotator: np.ndarray

    def posterior(self, votes: np.ndarray, given: np.ndarray | None = None) -> np.ndarray:
        """The chance of toxic from the votes, and the given labels where there are some (-1: none)."""
        bits = votes[:, None] >> np.arange(len(self.parent)) & 1
        logs = np.zeros((len(votes), 2))
        for j, up in enumerate(self.parent.tolist()):
            above = bits[:, up] if up >= 0 else np.zeros(len(votes), np.int64)
            for y in (0, 1):
                p = self.table[j, y][above]
                logs[:, y] += np.log(np.where(bits[:, j] == 1, p, 1 - p))
        logs += np.log([1 - self.prior, self.prior])
        if given is not None:
            for y in (0, 1):
                p = self.annotator[y]
                logs[:, y] += np.where(given < 0, 0.0, np.log(np.where(given > 0, p, 1 - p)))
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """Chance that a voter fires for clean and toxic texts when its parent does not."""
        return {name: (float(self.table[j, 0, 0]), float(self.table[j, 1, 0])) for j, name in enumerate(VOTERS)}


def fit_label_model(votes: np.ndarray, label: np.ndarray, n: np.ndarray) -> LabelModel:
    """Fit by expectation-maximisation to the counts ``n`` of patterns of votes and given labels (-1 where there is none).

    Voters start as independent given the class, which starts as the given label. Their correlations given the class
    then choose a tree (the spanning tree of greatest conditional mutual information), and the tree's tables are
    fitted in the same way.
    """
    voters = len(VOTERS)
    bits = (votes[:, None] >> np.arange(voters) & 1).astype(float)
    fires = bits.any(1).astype(float)
    q = np.where(label >= 0, label, np.where(fires > 0, 0.5, 0.02))
    parent = np.full(voters, -1)
    model = _maximise(bits, q, n, parent, label)
    for tree in (False, True):
        if tree:
            parent = _correlation_tree(bits, q, n)
        for _ in range(EM_ROUNDS):
            model = _maximise(bits, q, n, parent, label)
            q = model.posterior(votes, label)
    return model


def _maximise(bits: np.ndarray, q: np.ndarray, n: np.ndarray, parent: np.ndarray, label: np.ndarray) -> LabelModel:
    table, annotator = np.zeros((bits.shape[1], 2, 2)), np.zeros(2)
    for y in (0, 1):
        mass = n * (q if y else 1 - q)
        given = mass * (label >= 0)
        annotator[y] = ((given * (label > 0)).sum() + ANNOTATOR * (0.99 if y else 0.01)) / (given.sum() + ANNOTATOR)
        for j, up in enumerate(parent.tolist()):
            above = bits[:, up] if up >= 0 else np.zeros(len(bits))
            for v in (0, 1):
                part = mass * (above == v)
                table[j, y, v] = ((part * bits[:, j]).sum() + 0.1) / (part.sum() + 10 if up < 0 or v == 0 else part.sum() + 0.2)
    table = np.clip(table, 1e-6, 1 - 1e-6)
    prior = float(np.clip((n * q).sum() / max(1.0, n.sum()), 1e-4, 0.5))
    return LabelModel(prior, parent.copy(), table, np.clip(annotator, 1e-6, 1 - 1e-6))


def _correlation_tree(bits: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
    voters = bits.shape[1]
    gain = np.zeros((voters, voters))
    total = max(1.0, n.sum())
    for y in (0, 1):
        mass = n * (q if y else 1 - q)
        whole = mass.sum() + 4e-3
        ones = (bits.T * mass) @ bits
        single = np.diag(ones)
        for a in (0, 1):
            for b in (0, 1):
                joint = ones if a and b else single[:, None] - ones if a else single[None, :] - ones if b else mass.sum() - single[:, None] - single[None, :] + ones
                joint = np.maximum(joint, 0) + 1e-3
                pa_ = np.where(a, single, mass.sum() - single) + 2e-3
                pb = np.where(b, single, mass.sum() - single) + 2e-3
                gain += joint / total * np.log(joint * whole / (pa_[:, None] * pb[None, :]))
    parent, inside = np.full(voters, -1), [0]
    best, link = gain[0].copy(), np.zeros(voters, int)
    while len(inside) < voters:
        best[inside] = -np.inf
        j = int(np.argmax(best))
        parent[j] = link[j]
        inside.append(j)
        nearer = gain[j] > best
        best, link = np.where(nearer, gain[j], best), np.where(nearer, j, link)
    return parent


def document_features(texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per text its hashed terms, and of how many distinct words each is a term."""
    row, word, words = distinct_words(texts)
    buckets = buckets_of(words)
    key = (row[:, None] * (BUCKETS + 1) + buckets[word]).ravel()
    key, n = np.unique(key[key % (BUCKETS + 1) != BUCKETS], return_counts=True)
    ends = np.searchsorted(key // (BUCKETS + 1), np.arange(len(texts) + 1))
    at = key % (BUCKETS + 1)
    return [at[a:b] for a, b in zip(ends, ends[1:])], [n[a:b] for a, b in zip(ends, ends[1:])]


def packed(at: np.ndarray, n: np.ndarray) -> bytes:
    """Features in little room: the steps from bucket to bucket, then the counts."""
    return zlib.compress(np.concatenate([np.diff(at, prepend=0), n]).astype("<u4").tobytes(), 1)


def unpacked(features: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of ``packed`` features, four bytes each: the documents of a fit are held so."""
    at, n = np.frombuffer(zlib.decompress(features), "<u4").reshape(2, -1)
    return np.cumsum(at, dtype=np.uint32), n.copy()


def train_classifier(features: Sequence[np.ndarray], counts: Sequence[np.ndarray], target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights per hashed term and a bias, by follow-the-regularised-leader on the log loss of soft labels.

    A document counts as ``weight`` documents. Its features are, per term, how many of its distinct words have it.
    """
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(at):
        return np.where(np.abs(z[at]) <= L1, 0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, x, y, many in zip(features, counts, target.tolist(), weight.tolist()):
            at, x = np.append(at, BUCKETS).astype(np.int64), np.append(x, 1).astype(float)  # widened for a document at a time
            w = weights(at)
            g = many * (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:BUCKETS], float(w[BUCKETS])


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: np.ndarray
    label_model: LabelModel
    weights: np.ndarray
    bias: float


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    return (texts.slice(a, b - a) for a, b in K.slices(texts, SLICE_BYTES))


def _smallest(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """``n`` rows per group with the smallest digest of the id; sorted out in every task before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.xxhash64("doc_id"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("rank")


def _sample_features(lexicon: np.ndarray):
    """From ``(doc_id, toxic, text)`` to the votes and features that the classifier is fitted on, without the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in K.slices(batch.column(2), SLICE_BYTES):
                part = batch.slice(a, b - a)
                features = [packed(at, n) for at, n in zip(*document_features(part.column(2)))]
                columns = [part.column(0), part.column(1), pa.array(votes_of(part.column(2), lexicon)), pa.array(features, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "toxic", "votes", "features"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit on ``docs`` (``doc_id``, ``text``) and ``labels`` (``doc_id``, ``toxic``), both without held-out rows.

    The classifier sees up to ``LABELLED_ROWS`` documents of each label and as many others, chosen by the digest of their
    id and weighted so that the three have the shares that they have in all of ``docs``. The lexicons count all labelled
    rows and the label model sees the votes on all of ``docs``. Ids and other columns are never features.
    Without labels only the fixed insults vote. Of several labels of one id the highest counts; of several texts
    of one id the lexicons and votes count all, and the classifier sees the first in the order of texts.
    """
    docs = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    gold = stage(labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")), "toxic-labels")
    # Labels grow with the documents, so they are joined in one way at every size.
    same = gold.hint("merge")
    others = docs.select("doc_id").where(F.col("doc_id").isNotNull()).join(same, "doc_id", "left_anti")
    others = others.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS).withColumn("toxic", F.lit(-1))
    chosen = stage(_smallest(gold, ["toxic"], LABELLED_ROWS).unionByName(others).distinct(), "toxic-chosen")
    sample = stage(docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxic-sample")

    rows = {r["toxic"]: r["n"] for r in docs.select("doc_id").join(same, "doc_id").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    lexicon = learn_lexicons(docs.join(same, "doc_id").select("text", "toxic"), rows)

    voted = stage(docs.select("doc_id", votes(F.col("text"), lexicon, docs).alias("votes")), "votes")
    patterns = voted.join(same, "doc_id", "left").groupBy("votes", F.coalesce("toxic", F.lit(-1)).alias("toxic")).agg(F.count("*").alias("n")).toPandas()
    patterns = patterns.sort_values(["votes", "toxic"])
    share = patterns.groupby("toxic")["n"].sum() / max(1, patterns["n"].sum())
    model = fit_label_model(patterns["votes"].to_numpy(), patterns["toxic"].to_numpy(), patterns["n"].to_numpy().astype(float))

    def classifier(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id", kind="stable")
        frame = frame.iloc[np.argsort([zlib.crc32(str(d).encode()) for d in frame["doc_id"]], kind="stable")]
        posterior = model.posterior(frame["votes"].to_numpy(), frame["toxic"].to_numpy())
        weight = frame["toxic"].map(share / frame["toxic"].value_counts(normalize=True)).to_numpy()  # one on average
        at, n = zip(*map(unpacked, frame["features"]))
        weights, bias = train_classifier(at, n, posterior, weight)
        return pd.DataFrame({"weights": [np.append(weights, bias).astype("<f8").tobytes()]})

    featured = sample.select("doc_id", "toxic", "text").mapInArrow(
        _sample_features(lexicon), f"doc_id {dict(sample.dtypes)['doc_id']}, toxic int, votes long, features binary"
    )
    one = featured.withColumn("all", F.lit(0)).groupBy("all")
    trained = one.applyInPandas(lambda frame: classifier(frame), "weights binary").toPandas()
    full = np.frombuffer(trained["weights"][0], "<f8") if len(trained) else np.append(np.zeros(BUCKETS), -3.0)
    return ToxicityModel(lexicon, model, full[:BUCKETS].copy(), float(full[BUCKETS]))


def votes(text: Column, lexicon: np.ndarray, docs: DataFrame) -> Column:
    """The bits of the voters that fire; 0 for a missing text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # bounded by the terms of a document / LEAST_SHARE

    @F.arrow_udf("long")
    def voted(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array(np.concatenate([np.empty(0, np.int64), *(votes_of(t, shared.value) for t in _slices(pc.fill_null(part, "")))]))

    return voted(text)


def scores_of(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """Scores from the summed weights of the terms of every text's distinct words."""
    row, word, words = distinct_words(texts)
    weight = np.append(weights, 0.0)[buckets_of(words)].sum(axis=1)
    z = bias + np.bincount(row, weight[word], len(texts))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(text: Column, model: ToxicityModel, docs: DataFrame) -> Column:
    """The chance that the whole text is toxic; a missing text scores as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # BUCKETS numbers

    @F.arrow_udf("double")
    def scored(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array(np.concatenate([np.empty(0), *(scores_of(t, *shared.value) for t in _slices(pc.fill_null(part, "")))]))

    return scored(text)
