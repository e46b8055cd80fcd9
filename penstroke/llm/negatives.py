"""Hard negatives by exact integer products: residues modulo small primes are multiplied in float32 and joined again.

Vectors are compared by integer inner products of ``floor(SCALE * component)``. A task multiplies the matrices of the
residues modulo several primes (every sum stays below 2**24, so float32 is exact), puts the signed scores together by
Chinese remaindering and selects from windows of scores. The anchors are a stated part of the rows; they meet
all rows in blocks: the rows are dealt into groups, and every group gets every anchor.
"""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penstroke.staging import stage

SCALE = 256
PRIMES = (1021, 1019, 1013, 1009, 997, 991, 983)
"""Fixed values: the largest primes whose residues, at most 510 in size, give exact float32 sums over 64 components."""

WIDTH = 2**24 // (PRIMES[0] // 2) ** 2
GROUP_ROWS, LEAST_GROUPS = 65_536, 32
"""Rows of a group at most, about, and the groups that small tables are dealt into all the same."""

ANCHORS_PER_GROUP = 16_384
CELL = 1 << 20
"""Scores that a task holds at a time."""


def primes_for(bound: int) -> tuple[int, ...]:
    """As many primes as tell all integers up to ``bound`` in size apart."""
    chosen, product = [], 1
    for p in PRIMES:
        if product > 2 * bound:
            break
        chosen.append(p)
        product *= p
    if product <= 2 * bound:
        raise ValueError(f"inner products up to {bound} do not fit 64 bits")
    return tuple(chosen)


def _centred(x: np.ndarray, p: int) -> np.ndarray:
    """Residues of the integers ``x`` from -(p // 2) to p // 2."""
    return x - p * np.rint(x / p)


def integer_products(a: np.ndarray, b: np.ndarray, primes: tuple[int, ...]) -> np.ndarray:
    """All inner products of the rows of ``a`` and ``b`` (integers held as float64), exact as int64.

    The digits of a score in the mixed radix of the primes, each centred on 0, follow from its residues one by one.
    """
    digits: list[np.ndarray] = []
    score, radix = np.zeros((len(a), len(b)), np.int64), 1
    for p in primes:
        left, right = (_centred(x, p).astype(np.float32) for x in (a, b))
        residue = np.zeros((len(a), len(b)))
        for k in range(0, a.shape[1], WIDTH):
            residue += left[:, k : k + WIDTH] @ right[:, k : k + WIDTH].T
            if k:
                residue = _centred(residue, p)
        known, weight = np.zeros_like(residue), 1
        for q, digit in zip(primes, digits):
            known += digit * (weight % p)
            weight *= q
        digit = _centred(_centred(residue - known, p) * pow(radix, -1, p), p)
        digits.append(digit)
        score += digit.astype(np.int64) * radix
        radix *= p
    return score


def sorted_places(owner: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The order by owner; higher scores first, then smaller ids."""
    return np.lexsort((ids, -score, owner))


def leading(owner: np.ndarray, n: int) -> np.ndarray:
    """Which of the rows, sorted by ``owner``, are among the first ``n`` of theirs."""
    if not len(owner):
        return np.empty(0, bool)
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    return np.arange(len(owner)) - np.repeat(starts, np.diff(np.r_[starts, len(owner)])) < n


def _numbers(table: pa.Table, column: str) -> np.ndarray:
    return table[column].to_numpy().astype(np.int64)


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Scaled integers of the vectors as float64, which holds them exactly; missing components at the end are 0."""
    parts = [c for c in vectors.chunks if len(c)]
    sizes = np.concatenate([np.empty(0, np.int64), *(c.value_lengths().to_numpy(zero_copy_only=False) for c in parts)]).astype(np.int64)
    flat = np.concatenate([np.empty(0), *(c.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in parts)])
    out = np.zeros((len(sizes), width))
    start = np.cumsum(sizes) - sizes
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(start, sizes)] = np.floor(SCALE * flat)
    return out


def _table(parts: list[tuple[np.ndarray, ...]], schema: pa.Schema) -> pa.Table:
    columns = [np.concatenate([np.empty(0, np.int64), *c]) for c in zip(*parts)] if parts else [[]] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_FOUND = pa.schema([(c, pa.int64()) for c in ("no", "positive_id", "positive_score")])
_MINED = pa.schema([(c, pa.int64()) for c in ("no", "anchor_id", "positive_id", "positive_score", "k", "negative_id", "negative_score")])


def _nearest_of_label(anchors: pa.Table, rows: pa.Table, width: int, primes: tuple[int, ...], n: int) -> pa.Table:
    """The first ``n`` rows of an anchor's label among ``rows``; only rows of one label are multiplied."""
    a, b = _matrix(anchors["vec"], width), _matrix(rows["vec"], width)
    no, a_id, a_label = (_numbers(anchors, c) for c in ("no", "id", "label"))
    b_id, b_label = _numbers(rows, "id"), _numbers(rows, "label")
    parts = []
    for label in np.unique(a_label):
        mine, those = np.flatnonzero(a_label == label), np.flatnonzero(b_label == label)
        step = max(1, CELL // max(1, len(those)))
        for k in range(0, len(mine) if len(those) else 0, step):
            at = mine[k : k + step]
            score = integer_products(a[at], b[those], primes)
            other = a_id[at][:, None] != b_id[those][None, :]
            ranked = np.where(other, score, np.iinfo(np.int64).min)
            least = np.partition(ranked, -n, axis=1)[:, -n] if len(those) > n else np.full(len(at), np.iinfo(np.int64).min)
            i, j = np.nonzero(other & (ranked >= least[:, None]))
            order = sorted_places(i, score[i, j], b_id[those[j]])
            order = order[leading(i[order], n)]
            i, j = i[order], j[order]
            parts.append((no[at[i]], b_id[those[j]], score[i, j]))
    return _table(parts, _FOUND)


def _windowed(anchors: pa.Table, rows: pa.Table, width: int, primes: tuple[int, ...], n: int) -> pa.Table:
    """The first ``n`` rows of other labels in the window of each positive of the anchors."""
    a, b = _matrix(anchors["vec"], width), _matrix(rows["vec"], width)
    no, a_id, a_label = (_numbers(anchors, c) for c in ("no", "id", "label"))
    b_id, b_label = _numbers(rows, "id"), _numbers(rows, "label")
    positives = anchors["positives"].to_pylist()
    most = max(map(len, positives), default=0)
    found = np.array([[(p["id"], p["score"], 1) for p in ps] + [(0, 0, 0)] * (most - len(ps)) for ps in positives], np.int64)
    found = found.reshape(len(positives), most, 3)
    ids, high, real = (found[:, :, c] for c in range(3))
    low = np.where(real == 1, high - high // 5, 1)  # four fifths, rounded up; a window from 1 to 0 is empty
    parts = []
    step = max(1, CELL // max(1, len(b)))
    for start in range(0, len(a) if most and len(b) else 0, step):
        at = slice(start, start + step)
        score = integer_products(a[at], b, primes)
        inside = (score >= low[at].min(axis=1)[:, None]) & (score <= high[at].max(axis=1)[:, None])
        i, j = np.nonzero(inside & (b_label[None, :] != a_label[at][:, None]))
        s = score[i, j]
        order = sorted_places(i, s, b_id[j])
        i, j, s = i[order], j[order], s[order]
        for k in range(most):
            of = start + i
            here = np.flatnonzero((s >= low[of, k]) & (s <= high[of, k]))
            here = here[leading(i[here], n)]
            of = of[here]
            parts.append((no[of], a_id[of], ids[of, k], high[of, k], np.full(len(of), k), b_id[j[here]], s[here]))
    return _table(parts, _MINED)


def usable_rows(df: DataFrame, key: str, label: str | Column, vector: str) -> DataFrame:
    """``id, label, vec`` of the rows that take part, stored: all but those with a null id, label, vector or component, or
    with a component that is not finite. Rows that agree in all three count once."""
    name = F.col(label) if isinstance(label, str) else label
    rows = df.select(F.col(key).cast("long").alias("id"), name.cast("long").alias("label"), F.col(vector).alias("vec")).dropna()
    poor = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return stage(rows.where(~poor).dropDuplicates(), "vectors")


def _in_cells(anchors: DataFrame, rows: DataFrame, groups: int, blocks: int):
    """Anchors and rows grouped by cells: every anchor meets every group of rows once."""
    cell, cells = ["_rows", "_anchors"], groups * blocks
    held = rows.withColumn("_rows", F.pmod(F.xxhash64("id", "vec"), F.lit(groups)).cast("int"))
    held = held.withColumn("_anchors", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asking = anchors.withColumn("_anchors", F.pmod(F.xxhash64("no"), F.lit(blocks)).cast("int"))
    asking = asking.withColumn("_rows", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return (x.repartition(cells, *cell).groupBy(*cell) for x in (asking, held))


def mine_hard_negatives(
    df: DataFrame,
    anchors: str | Column,
    key: str = "vec_id",
    label: str | Column = "label",
    vector: str = "embedding",
    positives: int = 5,
    negatives: int = 5,
) -> DataFrame:
    """The hardest negatives of the rows for which ``anchors``, a condition on ``id``, holds.

    Positives of an anchor are the first ``positives`` rows of its label with another id. Negatives of a positive are the
    first ``negatives`` rows of other labels whose score is at least four fifths of the positive's and at most as
    high. Higher scores come first, then smaller ids. Result: ``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``, with no row for an anchor or positive without any.

    Equal rows count once; rows that share an id and differ each count. A vector shorter than the longest ends in
    zeros, an empty one scores 0. Scores that might not fit 63 bits are an error. Other columns are not read.
    """
    rows = usable_rows(df, key, label, vector)
    length = F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.pow(F.abs(x.cast("double")) * SCALE + 1, F.lit(2.0)))
    asked = F.expr(anchors) if isinstance(anchors, str) else anchors
    n, n_anchors, width, longest = rows.agg(F.count("*"), F.count_if(asked), F.max(F.size("vec")), F.max(length)).first()
    width = width or 0
    primes = primes_for(math.ceil((longest or 0.0) * (1 + 1e-9)))  # no product exceeds the longest vector's own
    groups, blocks = max(LEAST_GROUPS, -(-n // GROUP_ROWS)), max(1, -(-n_anchors // ANCHORS_PER_GROUP))
    asking = stage(rows.where(asked).withColumn("no", F.monotonically_increasing_id()), "anchors")

    left, right = _in_cells(asking, rows, groups, blocks)
    near = left.cogroup(right).applyInArrow(
        lambda a, b: _nearest_of_label(a, b, width, primes, positives), "no long, positive_id long, positive_score long"
    )
    best = Window.partitionBy("no").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("at", F.row_number().over(best)).where(F.col("at") <= positives)
    found = F.array_sort(F.collect_list(F.struct("at", F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))))
    near = near.groupBy("no").agg(found.alias("positives"))
    asking = stage(asking.join(near, "no"), "positives")

    left, right = _in_cells(asking, rows, groups, blocks)
    mined = left.cogroup(right).applyInArrow(
        lambda a, b: _windowed(a, b, width, primes, negatives),
        "no long, anchor_id long, positive_id long, positive_score long, k long, negative_id long, negative_score long",
    )
    hardest = Window.partitionBy("no", "k").orderBy(F.desc("negative_score"), "negative_id")
    mined = mined.withColumn("rank", F.row_number().over(hardest)).where(F.col("rank") <= negatives)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
