"""Vector expressions over array columns, in double precision: products, distances and relevance scores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.columns import ColumnOrName, col


def _doubles(v: ColumnOrName) -> Column:
    return col(v).cast("array<double>")


def _fold(a: ColumnOrName, b: ColumnOrName, f) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), f), F.lit(0.0), lambda s, x: s + x)


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def norm(a: ColumnOrName) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Cosine similarity; 0 where a vector is all zeros or the result isn't a number. Different widths are an error."""
    product = F.sqrt(dot(a, a) * dot(b, b))
    value = F.when(product > 0, dot(a, b) / product).otherwise(0.0)
    value = F.when(F.isnan(value), 0.0).otherwise(value)
    wrong = F.raise_error(F.concat(F.lit("vector widths differ: "), F.size(col(a)).cast("string"), F.lit(" and "), F.size(col(b)).cast("string")))
    return F.when(F.size(col(a)) == F.size(col(b)), value).otherwise(wrong.cast("double"))


def euclidean(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y)))


def manhattan(a: ColumnOrName, b: ColumnOrName) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x - y))


def chebyshev(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.array_max(F.zip_with(_doubles(a), _doubles(b), lambda x, y: F.abs(x - y)))


def hamming(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Share of places that differ."""
    return _fold(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0)) / F.size(col(a))


METRICS = {"cosine": cosine, "ip": dot, "l2": euclidean, "l1": manhattan, "linf": chebyshev, "hamming": hamming}
#: metrics of which more is nearer
SIMILARITIES = frozenset({"cosine", "ip"})


def euclidean_relevance(distance: ColumnOrName) -> Column:
    return 1.0 - col(distance) / math.sqrt(2)


def cosine_relevance(distance: ColumnOrName) -> Column:
    return 1.0 - col(distance)


def inner_product_relevance(distance: ColumnOrName) -> Column:
    return F.when(col(distance) > 0, 1.0 - col(distance)).otherwise(-col(distance))


def scaled_cosine_relevance(similarity: ColumnOrName) -> Column:
    return (col(similarity) + 1.0) / 2.0


def normalized(v: ColumnOrName) -> Column:
    return F.transform(_doubles(v), lambda x: x / norm(v))


def sparse_dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Product of sparse vectors: structs of indices and values."""
    left, right = (F.map_from_arrays(col(x)["indices"], col(x)["values"]) for x in (a, b))
    return F.aggregate(F.map_entries(left), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(right, e["key"]), F.lit(0.0)))
