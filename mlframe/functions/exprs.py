"""Column expressions with IEEE semantics, which Spark's own differ from: x / 0, ln(0), NaN in comparisons. All stay inside generated code."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing(c) -> Column:
    """NULL or NaN."""
    c = col(c)
    return c.isNull() | F.isnan(c)


def nan_to_null(c) -> Column:
    """NaN becomes NULL, which every aggregate skips."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def total(columns: list[Column]) -> Column:
    return reduce(add, columns) if columns else F.lit(0.0)


def ieee_div(a, b) -> Column:
    """a / b with x / 0 = inf of the right sign and 0 / 0 = NaN; a NaN on either side gives NaN. A zero divisor counts as positive: SQL does not tell -0.0 from 0.0."""
    a, b = col(a).cast("double"), col(b).cast("double")
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def ieee_ln(x) -> Column:
    """ln with ln(0) = -inf and NaN below zero."""
    x = col(x).cast("double")
    return F.when(F.isnan(x), x).when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(F.ln(x))


def sign(x) -> Column:
    """+1, -1 or 0; NaN gives 0."""
    x = col(x)
    return F.when(F.isnan(x), F.lit(0.0)).when(x > 0, F.lit(1.0)).when(x < 0, F.lit(-1.0)).when(x == 0, F.lit(0.0))


def maximum(a, b) -> Column:
    """The larger one; a NaN loses to a number."""
    a, b = col(a), col(b)
    return F.greatest(F.nanvl(a, b), F.nanvl(b, a))


def sigmoid(z) -> Column:
    """Logistic function, by the branch that cannot overflow."""
    z = col(z)
    return F.when(z >= 0, 1.0 / (1.0 + F.exp(-z))).otherwise(F.exp(z) / (1.0 + F.exp(z)))


def dot(columns: list[Column], weights: list[float]) -> Column:
    """Weighted sum of columns."""
    if len(columns) != len(weights):
        raise ValueError(f"{len(columns)} columns and {len(weights)} weights")
    return total([c * F.lit(float(w)) for c, w in zip(columns, weights, strict=True)])


# Arrays of doubles as vectors.


def _same_size(a: Column, b: Column, out: Column) -> Column:
    return F.when(F.size(a) == F.size(b), out).otherwise(F.raise_error(F.lit("vectors of different length")))


def array_op(a, b, op) -> Column:
    """Element by element; unequal lengths are an error."""
    a, b = col(a), col(b)
    return _same_size(a, b, F.zip_with(a, b, op))


def array_sum(a) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x.cast("double"))


def array_dot(a, b) -> Column:
    return array_sum(array_op(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def array_mean(a) -> Column:
    """Mean of a vector; 0 for an empty one."""
    a = col(a)
    return F.when(F.size(a) > 0, array_sum(a) / F.size(a)).when(F.size(a) == 0, F.lit(0.0))
