"""Expressions over vectors held as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from penstroke.functions.arrays import with_value


def _doubles(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(a: Column | str) -> Column:
    """The vector divided by its length, which counts as at least 1e-12."""
    a = _doubles(a)
    return with_value(F.greatest(norm(a), F.lit(1e-12)), lambda length: F.transform(a, lambda x: x / length))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-12)) * F.greatest(norm(b), F.lit(1e-12)))


def siamese_features(a: Column | str, b: Column | str) -> Column:
    """``[a, b, |a - b|, a * b]``."""
    a, b = _doubles(a), _doubles(b)
    return F.concat(a, b, F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.zip_with(a, b, lambda x, y: x * y))


def cosine_feature(a: Column | str, b: Column | str) -> Column:
    """The cosine as the only feature of a pair."""
    return F.array(cosine_similarity(a, b))


def pair_label(known: Column | str, unknown: Column | str) -> Column:
    """1 for a pair by one author, else 0."""
    known = F.col(known) if isinstance(known, str) else known
    return (known == (F.col(unknown) if isinstance(unknown, str) else unknown)).cast("int")
