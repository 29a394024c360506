"""Arithmetic of vectors, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to this width a product with a known vector is written out, which keeps it in generated code.
UNROLLED = 256


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def dot_with(a: Column | str, known: Sequence[float]) -> Column:
    """Product with a vector that is known now."""
    a = _col(a)
    if len(known) > UNROLLED:
        return dot(a, F.array(*[F.lit(float(x)) for x in known]))
    total = F.lit(0.0)
    for i, x in enumerate(known):
        total = total + a[i].cast("double") * F.lit(float(x))
    return total


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalized(a: Column | str) -> Column:
    """A vector of length 1; one of length 0 stays as it is."""
    a = _col(a)
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))


def truncated(a: Column | str, dimensions: int) -> Column:
    """The first ``dimensions`` of a vector, normalised anew."""
    return l2_normalized(F.slice(_col(a), 1, dimensions))


def score_of_cosine(c: Column | str) -> Column:
    """The positive score that inner-product indexes give for a cosine."""
    c = _col(c)
    return F.when(c >= 0, 1 + c).otherwise(1 / (1 - c))


def cosine_of_score(s: Column | str) -> Column:
    s = _col(s)
    return F.when(s <= 0, F.raise_error(F.lit("a score must be positive")).cast("double")).when(s >= 1, s - 1).otherwise(1 - 1 / s)
