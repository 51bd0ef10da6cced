"""Vector distances and small scalar functions as Column expressions.

All take arrays of doubles and stay in the JVM.  A ratio whose denominator is zero is null, which
no threshold passes.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def fold(p: Column, q: Column, term: Callable[[Column, Column], Column]) -> Column:
    """The sum of ``term`` over aligned components."""
    return F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda a, x: a + x)


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x)


def dot(p: Column, q: Column) -> Column:
    return fold(p, q, lambda a, b: a * b)


def norm(p: Column) -> Column:
    return F.sqrt(F.aggregate(p, F.lit(0.0), lambda a, x: a + x * x))


def euclidean(p: Column, q: Column) -> Column:
    return F.sqrt(fold(p, q, lambda a, b: (a - b) * (a - b)))


def cosine(p: Column, q: Column) -> Column:
    """The negated cosine, so that smaller is nearer."""
    return -F.try_divide(dot(p, q), norm(p) * norm(q))


def correlation(p: Column, q: Column) -> Column:
    """One minus the correlation of the components."""
    centre = lambda x: F.transform(x, lambda a: a - total(x) / F.size(x))
    a, b = centre(p), centre(q)
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def chi_square(p: Column, q: Column) -> Column:
    return fold(p, q, lambda a, b: (a - b) * (a - b) / (a + b + EPS))


def intersection(p: Column, q: Column) -> Column:
    """A similarity; ranked ascending like the distances."""
    return fold(p, q, lambda a, b: F.least(a, b))


def _bin_ratio(p: Column, q: Column, weight: Callable[[Column, Column], Column], power: int) -> Column:
    a = F.abs(1 - dot(p, q))

    def term(x: Column, y: Column) -> Column:
        s, top = x + y, (x - y) * (x - y) + 2 * a * (x * y)
        below = s * s if power == 2 else s * s * s
        return weight(x, y) * top / (below + EPS)

    return F.abs(fold(p, q, term))


def bin_ratio(p: Column, q: Column) -> Column:
    return _bin_ratio(p, q, lambda x, y: F.lit(1.0), 2)


def l1_bin_ratio(p: Column, q: Column) -> Column:
    return _bin_ratio(p, q, lambda x, y: F.abs(x - y), 2)


def chi_square_bin_ratio(p: Column, q: Column) -> Column:
    return _bin_ratio(p, q, lambda x, y: (x - y) * (x - y), 3)


DISTANCES: dict[str, Callable[[Column, Column], Column]] = {
    "euclidean": euclidean, "cosine": cosine, "correlation": correlation, "chi_square": chi_square, "intersection": intersection,
    "bin_ratio": bin_ratio, "l1_bin_ratio": l1_bin_ratio, "chi_square_bin_ratio": chi_square_bin_ratio,
}

#: The metric of each kind of descriptor in exact search.
METRIC_OF = {"SIFT": "minkowski", "SURF": "minkowski", "ORB": "hamming", "BRISK": "hamming", "BRIEF": "hamming", "FREAK": "hamming"}


def metric_of(kind: str) -> str:
    if kind.upper() not in METRIC_OF:
        raise ValueError(f"no metric for descriptor {kind}")
    return METRIC_OF[kind.upper()]


def metric_column(kind: Column) -> Column:
    """The metric of the kind of descriptor in a column; null for an unknown one."""
    return F.create_map(*[F.lit(x) for pair in METRIC_OF.items() for x in pair])[F.upper(kind)]


def steps(first: Column, last: Column, step: int) -> Column:
    """The numbers from ``first`` to at most ``last`` as an array; none where last comes before first."""
    return F.when(last >= first, F.sequence(first, F.greatest(first, last), F.lit(step))).otherwise(F.slice(F.sequence(first, first), 1, 0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def image_label(path: Column) -> Column:
    """A path's base name without its last part after an underscore, the rest joined by blanks."""
    parts = F.split(F.element_at(F.split(path, "/"), -1), "_")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), " ")


def red_green(f: Column) -> Column:
    """A share between 0 and 1 as a colour from red to green."""
    return F.format_string("#%02x%02x11", (255 * (1 - f)).cast("int"), (255 * f).cast("int"))


def powers_of_two(first: int, last: int, step: int) -> list[float]:
    """The grid of a parameter search, both ends included."""
    n = (last - first) // step
    return [math.pow(2.0, first + i * step) for i in range(n + 1)]


def sign_words(v: Column, bits: int = 32) -> Column:
    """Sign bits of a vector packed into words, least significant first: a binary descriptor."""
    word = lambda k: F.aggregate(
        F.transform(F.slice(v, k * bits + 1, bits), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda a, x: a + x,
    )
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / bits).cast("int") - 1), word)


def bit_hamming(a: Column, b: Column) -> Column:
    """Unequal bits of two arrays of words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
