"""Filling of missing values."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from mlframe.errors import InvalidParameter
from mlframe.functions.exprs import missing, nan_to_null
from mlframe.operators.base import Model, Step
from mlframe.plans.selection import MostFrequent, Quantiles


@dataclass
class ImputerModel(Model):
    input_cols: list[str]
    statistics: list[float]

    def outputs(self, columns: list[Column]) -> list[tuple[str, Column]]:
        return [(n, F.when(missing(c), F.lit(s)).otherwise(c)) for n, c, s in zip(self.input_cols, columns, self.statistics, strict=True)]

    def to_dict(self) -> dict:
        return asdict(self)


@dataclass
class SimpleImputer(Step):
    """NULL and NaN become the column's mean, median, most frequent value (the smallest on ties) or a constant.

    A column without any value is filled with 0 by every strategy, the constant one included. There is no inverse.
    """

    strategy: str = "mean"
    fill: float = 0.0

    def __post_init__(self):
        if self.strategy not in ("mean", "median", "most_frequent", "constant"):
            raise InvalidParameter(f"unknown strategy {self.strategy!r}")

    def aggregates(self, columns):
        of = {"mean": F.avg, "median": lambda c: Quantiles(c, [0.5]), "most_frequent": MostFrequent, "constant": lambda c: F.when(F.count(c) > 0, F.lit(float(self.fill)))}[self.strategy]
        return {c: of(nan_to_null(c)) for c in columns}

    def model(self, columns, found):
        plain = [found[c][0] if isinstance(found[c], list) else found[c] for c in columns]
        return ImputerModel(columns, [0.0 if v is None else float(v) for v in plain])
