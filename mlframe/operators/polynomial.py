"""Polynomial features."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import reduce
from itertools import combinations, combinations_with_replacement
from operator import mul

from pyspark.sql import Column
from pyspark.sql import functions as F

from mlframe.errors import InvalidParameter
from mlframe.operators.base import Model, Step


@dataclass
class PolynomialModel(Model):
    input_cols: list[str]
    degree: int
    include_bias: bool
    interaction_only: bool

    def terms(self) -> list[tuple[int, ...]]:
        """Monomials as column numbers: by degree, then in lexicographic order."""
        choose = combinations if self.interaction_only else combinations_with_replacement
        powers = [t for d in range(1, self.degree + 1) for t in choose(range(len(self.input_cols)), d)]
        return [(), *powers] if self.include_bias else powers

    def outputs(self, columns: list[Column]) -> list[tuple[str, Column]]:
        return [("*".join(self.input_cols[k] for k in t) or "1", reduce(mul, [columns[k] for k in t], F.lit(1.0)) if not t else reduce(mul, [columns[k] for k in t])) for t in self.terms()]

    def to_dict(self) -> dict:
        return asdict(self)


@dataclass
class PolynomialFeatures(Step):
    """All products of up to ``degree`` columns, with ``interaction_only`` of different ones; there is nothing to learn and no inverse. Degree 0 leaves the bias column, or no column."""

    degree: int = 2
    include_bias: bool = True
    interaction_only: bool = False

    def __post_init__(self):
        if self.degree < 0:
            raise InvalidParameter("the degree is negative")

    def aggregates(self, columns):
        return {}

    def model(self, columns, found):
        return PolynomialModel(columns, self.degree, self.include_bias, self.interaction_only)
