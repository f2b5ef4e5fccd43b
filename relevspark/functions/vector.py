"""Vector functions on ``array<float>`` columns, summed in double precision in the order of the elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from relevspark.functions.text import col


def dot(a: str | Column, b: str | Column) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda s, x: s + x)


def norm(v: str | Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: str | Column, least: float = 1e-9) -> Column:
    """The vector at length 1; a vector shorter than ``least`` is divided by ``least``."""
    n = F.greatest(norm(v), F.lit(least))
    return F.transform(col(v), lambda x: x.cast("double") / n)


def cosine(a: str | Column, b: str | Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-9)) * F.greatest(norm(b), F.lit(1e-9)))
