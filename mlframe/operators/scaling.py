"""Scalers of columns and of rows."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from mlframe.errors import InvalidParameter
from mlframe.functions.exprs import INF, ieee_div, nan_to_null, total
from mlframe.operators.base import Model, Step
from mlframe.plans.selection import Quantiles


@dataclass
class AffineModel(Model):
    """(x - shift) * factor + base, column by column; the inverse multiplies by ``back``."""

    input_cols: list[str]
    shift: list[float]
    factor: list[float]
    base: list[float]
    back: list[float]
    info: dict

    def outputs(self, columns: list[Column]) -> list[tuple[str, Column]]:
        return [(n, (c - s) * f + b) for n, c, s, f, b in zip(self.input_cols, columns, self.shift, self.factor, self.base, strict=True)]

    def inverse_outputs(self, columns: list[Column]) -> list[tuple[str, Column]]:
        return [(n, (c - b) * r + s) for n, c, s, r, b in zip(self.input_cols, columns, self.shift, self.back, self.base, strict=True)]

    def to_dict(self) -> dict:
        return asdict(self)


@dataclass
class DividingModel(Model):
    """(x - shift) / scale, column by column."""

    input_cols: list[str]
    shift: list[float]
    scale: list[float]
    info: dict

    def outputs(self, columns: list[Column]) -> list[tuple[str, Column]]:
        return [(n, (c - m) / s) for n, c, m, s in zip(self.input_cols, columns, self.shift, self.scale, strict=True)]

    def inverse_outputs(self, columns: list[Column]) -> list[tuple[str, Column]]:
        return [(n, c * s + m) for n, c, m, s in zip(self.input_cols, columns, self.shift, self.scale, strict=True)]

    def to_dict(self) -> dict:
        return asdict(self)


@dataclass
class StandardScaler(Step):
    """Mean 0 and population deviation 1; a constant column has deviation 1. NaN spreads, NULL is skipped."""

    with_mean: bool = True
    with_std: bool = True

    def aggregates(self, columns):
        return {f"mean {c}": F.avg(c) for c in columns} | {f"std {c}": F.stddev_pop(c) for c in columns}

    def model(self, columns, found):
        mean = [found[f"mean {c}"] if found[f"mean {c}"] is not None else 0.0 for c in columns]
        std = [found[f"std {c}"] or 1.0 for c in columns]
        return DividingModel(columns, mean if self.with_mean else [0.0] * len(columns), std if self.with_std else [1.0] * len(columns), {"mean": mean, "std": std})


@dataclass
class MinMaxScaler(Step):
    """Maps the fitted minimum and maximum to a range; a constant column is shifted to its lower end. NaN is skipped while fitting."""

    low: float = 0.0
    high: float = 1.0

    def __post_init__(self):
        if not self.high > self.low:
            raise InvalidParameter("the range is empty")

    def aggregates(self, columns):
        return {f"min {c}": F.coalesce(F.min(nan_to_null(c)), F.lit(INF)) for c in columns} | {f"max {c}": F.coalesce(F.max(nan_to_null(c)), F.lit(-INF)) for c in columns}

    def model(self, columns, found):
        low, high = ([float(found[f"{k} {c}"]) for c in columns] for k in ("min", "max"))
        span = [h - m for m, h in zip(low, high, strict=True)]
        factor = [(self.high - self.low) / s if s else 1.0 for s in span]
        return AffineModel(columns, low, factor, [self.low] * len(columns), [1.0 / f if f else 0.0 for f in factor], {"min": low, "max": high, "range": span})


@dataclass
class RobustScaler(Step):
    """Centres on the mean of two quantiles (with ``centre`` = "median", on the median) and scales by their distance (0: 1); exact interpolated quantiles of what is not missing, or ``accuracy`` for approximate ones."""

    lower: float = 25.0
    upper: float = 75.0
    with_centering: bool = True
    with_scaling: bool = True
    centre: str = "midhinge"
    accuracy: int | None = None

    def __post_init__(self):
        if not 0 <= self.lower < self.upper <= 100:
            raise InvalidParameter("quantiles must be within 0 and 100, the lower one first")
        if self.centre not in ("midhinge", "median"):
            raise InvalidParameter(f"unknown centre {self.centre!r}")

    def aggregates(self, columns):
        at = [self.lower / 100, self.upper / 100, 0.5]
        return {c: F.percentile_approx(nan_to_null(c), at, self.accuracy) if self.accuracy else Quantiles(nan_to_null(c), at) for c in columns}

    def model(self, columns, found):
        quantiles = [found[c] or [0.0, 0.0, 0.0] for c in columns]
        centre = [q[2] if self.centre == "median" else (q[0] + q[1]) / 2 for q in quantiles]
        scale = [(q[1] - q[0]) or 1.0 for q in quantiles]
        n = len(columns)
        return DividingModel(columns, centre if self.with_centering else [0.0] * n, scale if self.with_scaling else [1.0] * n, {"center": centre, "scale": scale})


@dataclass
class MaxAbsScaler(Step):
    """Divides by the largest absolute value; an all-zero column stays, and its inverse is 0."""

    def aggregates(self, columns):
        return {c: F.coalesce(F.max(F.abs(nan_to_null(c))), F.lit(0.0)) for c in columns}

    def model(self, columns, found):
        most, n = [float(found[c]) for c in columns], len(columns)
        return AffineModel(columns, [0.0] * n, [1.0 / m if m else 1.0 for m in most], [0.0] * n, most, {"max_abs": most})


@dataclass
class NormalizerModel(Model):
    """Divides every row by its norm; a row of norm 0 stays."""

    input_cols: list[str]
    norm: str

    def outputs(self, columns: list[Column]) -> list[tuple[str, Column]]:
        norm = row_norm(columns, self.norm)
        return [(n, F.when(norm == 0, c).otherwise(ieee_div(c, norm))) for n, c in zip(self.input_cols, columns, strict=True)]

    def to_dict(self) -> dict:
        return asdict(self)


def row_norm(columns: list[Column], norm: str) -> Column:
    """L1, L2 or max norm over columns; the max norm ignores NaN."""
    if norm == "l1":
        return total([F.abs(c) for c in columns])
    if norm == "l2":
        return F.sqrt(total([c * c for c in columns]))
    return F.greatest(F.lit(0.0), F.lit(0.0), *[F.coalesce(nan_to_null(F.abs(c)), F.lit(0.0)) for c in columns])


@dataclass
class Normalizer(Step):
    """Row-wise scaling to norm 1; nothing to learn, so fitting runs no aggregate. There is no inverse."""

    norm: str = "l2"

    def __post_init__(self):
        if self.norm not in ("l1", "l2", "max"):
            raise InvalidParameter(f"unknown norm {self.norm!r}")

    def aggregates(self, columns):
        return {}

    def model(self, columns, found):
        return NormalizerModel(columns, self.norm)


def normalize_array(vector: Column, norm: str = "l2") -> Column:
    """The same for a row's vector in one array column."""
    if norm == "max":
        size = F.coalesce(F.array_max(F.transform(vector, lambda x: F.coalesce(nan_to_null(F.abs(x.cast("double"))), F.lit(0.0)))), F.lit(0.0))
    else:
        power = (lambda x: F.abs(x.cast("double"))) if norm == "l1" else (lambda x: x.cast("double") * x.cast("double"))
        size = F.aggregate(vector, F.lit(0.0), lambda s, x: s + power(x))
        size = F.sqrt(size) if norm == "l2" else size
    return F.transform(vector, lambda x: F.when(size == 0, x.cast("double")).otherwise(x.cast("double") / size))
