"""Vector functions as Columns: distances, scale, quantisation, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Half the 16-bit range, so that differences of two values fit 16 bits.
CAP = 16383
TOP_K = 5


def l2_float(a: Column, b: Column) -> Column:
    """Squared distance, summed in double from the first dimension on."""
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def l2_int(a: Column, b: Column) -> Column:
    """Squared distance of quantised vectors: exact."""
    parts = F.zip_with(a, b, lambda x, y: (x.cast("long") - y.cast("long")) * (x.cast("long") - y.cast("long")))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s + x)


def abs_max(vectors: DataFrame, col: str) -> float:
    """The largest absolute coordinate over all rows; 0 without any."""
    found = vectors.agg(F.max(F.array_max(F.transform(col, F.abs))).cast("double")).first()[0]
    return float(found or 0.0)


def fit_scale(largest: float) -> float:
    return CAP / largest if largest > 0 else 1.0


def quantize(v: Column, scale: float | Column) -> Column:
    """Round half away from zero, within +-CAP, as array<smallint>."""
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    one = lambda x: F.least(F.greatest(F.round(x.cast("double") * scale), F.lit(-float(CAP))), F.lit(float(CAP))).cast("smallint")
    return F.transform(v, one)


def approved(count: Column) -> Column:
    """Score under 0.6, that is under three of five; counts stay integers."""
    return count < 3


def decision_json(count: Column) -> Column:
    """{"approved":...,"fraud_score":...} for a count of 0 to 5."""
    score = (count / F.lit(float(TOP_K))).cast("double")
    return F.to_json(F.struct(approved(count).alias("approved"), score.alias("fraud_score")))
