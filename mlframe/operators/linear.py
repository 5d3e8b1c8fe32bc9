"""Linear models: losses, regularizers, the optimizer, and prediction as a projection."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlframe.errors import FeatureMismatch
from mlframe.functions.exprs import dot, sigmoid, sign
from mlframe.operators.base import Model


class Loss(ABC):
    """A loss by two hooks that give column expressions, so one of a user's own stays in generated code; and the same slope in numpy for the sequential trainer."""

    quadratic = False

    @abstractmethod
    def value(self, prediction: Column, target: Column) -> Column:
        """One row's loss; the loss of a batch is the mean."""

    @abstractmethod
    def slope(self, prediction: Column, target: Column) -> Column:
        """One row's derivative by the prediction; a batch divides by its rows."""

    @abstractmethod
    def slope_array(self, prediction: np.ndarray, target: np.ndarray) -> np.ndarray: ...

    @abstractmethod
    def value_array(self, prediction: np.ndarray, target: np.ndarray) -> np.ndarray: ...


class MSELoss(Loss):
    """(p - t)**2, with the slope p - t: the factor 2 is left to the learning rate."""

    quadratic = True

    def value(self, prediction, target):
        return (prediction - target) * (prediction - target)

    def slope(self, prediction, target):
        return prediction - target

    def slope_array(self, prediction, target):
        return prediction - target

    def value_array(self, prediction, target):
        return (prediction - target) ** 2


class MAELoss(Loss):
    def value(self, prediction, target):
        return F.abs(prediction - target)

    def slope(self, prediction, target):
        return sign(prediction - target)

    def slope_array(self, prediction, target):
        return np.nan_to_num(np.sign(prediction - target), nan=0.0)

    def value_array(self, prediction, target):
        return np.abs(prediction - target)


class BCEWithLogitsLoss(Loss):
    """Cross-entropy of a logit, in the form that cannot overflow."""

    def value(self, prediction, target):
        return F.greatest(prediction, F.lit(0.0)) - prediction * target + F.log1p(F.exp(-F.abs(prediction)))

    def slope(self, prediction, target):
        return sigmoid(prediction) - target

    def slope_array(self, prediction, target):
        e = np.exp(-np.abs(prediction))
        return np.where(prediction >= 0, 1 / (1 + e), e / (1 + e)) - target

    def value_array(self, prediction, target):
        return np.maximum(prediction, 0) - prediction * target + np.log1p(np.exp(-np.abs(prediction)))


@dataclass(frozen=True)
class L2:
    """strength * |w|**2, gradient 2 * strength * w; the bias is free."""

    strength: float

    def penalty(self, theta: np.ndarray) -> float:
        return self.strength * float(theta[:-1] @ theta[:-1])


@dataclass(frozen=True)
class NoRegularizer:
    strength: float = 0.0

    def penalty(self, theta: np.ndarray) -> float:
        return 0.0


@dataclass(frozen=True)
class SGD:
    """theta - rate * gradient; no state."""

    rate: float

    def step(self, theta: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        return theta - self.rate * gradient


@dataclass
class LinearModel(Model):
    """Weights and a bias. ``prediction`` is the raw sum; for a logistic model that is the logit."""

    input_cols: list[str]
    weights: list[float]
    bias: float

    def score(self, columns: list[Column]) -> Column:
        return dot(columns, self.weights) + F.lit(float(self.bias))

    def outputs(self, columns: list[Column]) -> list[tuple[str, Column]]:
        return [("prediction", self.score(columns))]

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Adds the prediction; all columns stay."""
        return super().transform(df, list(df.columns) if keep is None else keep)

    def __add__(self, other: LinearModel) -> LinearModel:
        """Sum of the parameters, of models on the same columns."""
        if other.input_cols != self.input_cols:
            raise FeatureMismatch("models on different columns")
        return LinearModel(list(self.input_cols), [a + b for a, b in zip(self.weights, other.weights, strict=True)], self.bias + other.bias)

    def scale(self, factor: float) -> LinearModel:
        """The parameters times a number."""
        return LinearModel(list(self.input_cols), [w * factor for w in self.weights], self.bias * factor)

    def probability(self) -> Column:
        return sigmoid(self.score([F.col(c) for c in self.input_cols]))

    def decision(self, threshold: float = 0.5) -> Column:
        return (self.probability() >= threshold).cast("double")

    def to_dict(self) -> dict:
        return asdict(self)
