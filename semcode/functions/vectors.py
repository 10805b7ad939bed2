"""Dense-vector arithmetic on ARRAY<FLOAT|DOUBLE> columns, in Spark SQL.

Used where a vector meets a vector row by row (normalising, inertia, small
formulas).  The N x M similarity product itself is done in Arrow batches by
``semcode.operators.match`` because Spark SQL lambdas are not code-generated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scores are compared (threshold, argmax, ties) after rounding to this many
# decimals in every plan and in the oracle, so that summation order cannot
# flip a decision.
SCORE_DECIMALS = 9


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def norm(a) -> Column:
    a = _c(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 (not NaN) when either vector has zero norm."""
    na, nb = norm(a), norm(b)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def l2_normalize(a) -> Column:
    """Unit-length vector as ARRAY<DOUBLE>; a zero vector stays zero."""
    a = _c(a)
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n))


def round_score(c) -> Column:
    return F.round(_c(c), SCORE_DECIMALS)
