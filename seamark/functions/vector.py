"""Vector algebra as built-in column expressions, and the block kernel that large searches use.

Elements are widened to double before they are multiplied. Vectors of different lengths give the value that each function names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a distance is where there is none (lengths differ, a vector is zero).
FAR = 1.7976931348623157e308


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once, however often f names it: a lambda function makes what it names anew for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _paired(a: Column, b: Column, f) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), f))


def _same(a: Column, b: Column) -> Column:
    return F.size(a) == F.size(b)


def dot(a: Column, b: Column) -> Column:
    """Sum of products; 0 for different lengths or empty vectors."""
    return F.when(_same(a, b), _paired(a, b, lambda x, y: x * y)).otherwise(F.lit(0.0))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(v), lambda x: x * x)))


def normalise(v: Column) -> Column:
    """Unit length in single precision; a zero vector stays."""
    def by(w: Column, n: Column) -> Column:
        return F.when(n == 0, w).otherwise(F.transform(w, lambda x: (x * (F.lit(1.0) / n).cast("float")).cast("float")))

    return once(v, lambda w: once(norm(w), lambda n: by(w, n)))


def dot_distance(a: Column, b: Column) -> Column:
    """1 - dot: the cosine distance of unit vectors."""
    return F.when(_same(a, b), 1 - _paired(a, b, lambda x, y: x * y)).otherwise(F.lit(FAR))


def cosine_distance(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(~_same(a, b) | (size == 0), F.lit(FAR)).otherwise(1 - _paired(a, b, lambda x, y: x * y) / size)


def cosine_similarity(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(~_same(a, b) | (size == 0), F.lit(0.0)).otherwise(_paired(a, b, lambda x, y: x * y) / size)


def squared_l2(a: Column, b: Column) -> Column:
    return _paired(a, b, lambda x, y: (x - y) * (x - y))


def l2_distance(a: Column, b: Column) -> Column:
    return F.when(_same(a, b), F.sqrt(squared_l2(a, b))).otherwise(F.lit(FAR))


def parse_vector(text: Column) -> Column:
    """[a,b,...] as a vector; null if it is none."""
    return F.from_json(text, "array<float>")


def format_vector(v: Column) -> Column:
    return F.to_json(v)


def top_k_indices(values: Column, k: int) -> Column:
    """Positions (from 0) of the k least values, ties by position."""
    pairs = F.transform(values, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: p["i"])
