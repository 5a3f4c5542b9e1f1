"""Vector and score helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scores are summed and ranked as integers in units of 1e-9. Integer sums do not
# depend on the order in which a shuffle delivers the terms, so rankings and
# ties are reproducible across runs and engines.
SCORE_SCALE = 1_000_000_000


def fixed_point(x: Column) -> Column:
    """Round a non-negative or negative double to a long in units of 1e-9."""
    return F.floor(x * F.lit(float(SCORE_SCALE)) + F.lit(0.5)).cast("long")


def from_fixed(x: Column) -> Column:
    return x.cast("double") / F.lit(float(SCORE_SCALE))


def l2_normalize(vec: Column | str) -> Column:
    """Unit-length copy of an array<double>; a zero vector stays zero."""
    v = F.col(vec) if isinstance(vec, str) else vec
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(
        F.transform(v, lambda x: x.cast("double"))
    )
