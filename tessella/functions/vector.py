"""Numbers, vectors and boxes as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / (norm(a) + F.lit(1e-12)))


def cosine01(a: Column, b: Column) -> Column:
    """Cosine from 0 (opposite) to 1."""
    return (dot(a, b) / (norm(a) * norm(b) + F.lit(1e-12)) + 1) / 2


def logistic(x: Column, limit: float = 12.0) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-limit)), F.lit(limit))))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def overlap_of_boxes(a: Column, b: Column) -> Column:
    """Intersection over union of boxes [left, top, right, bottom]."""
    side = lambda i: F.greatest(F.lit(0.0), F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    both = side(0) * side(1)
    return both / (area(a) + area(b) - both + F.lit(1e-12))


def scaled_box(box: Column, width: Column, height: Column, units: float = 1000.0) -> Column:
    """A box in thousandths of the page to points."""
    return F.array(box[0] * width / units, box[1] * height / units, box[2] * width / units, box[3] * height / units)
