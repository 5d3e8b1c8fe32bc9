"""Evaluation of predictions, each set of metrics in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlframe.functions.exprs import ieee_div
from mlframe.plans.selection import Quantiles, quantiles


def regression_metrics(label: Column, prediction: Column, guard: bool = True) -> list[Column]:
    """mse, rmse, mae and r2; all 0 without rows. r2 of a constant label is 1 for a perfect prediction, else 0; without ``guard`` it is what the division gives (NaN or minus infinity)."""
    error = prediction - label
    squares = F.coalesce(F.sum(error * error), F.lit(0.0))
    spread = F.var_pop(label) * F.count(label)
    mse = F.coalesce(F.avg(error * error), F.lit(0.0))
    r2 = F.when(F.count(label) == 0, 0.0).when(spread == 0, F.when(squares == 0, 1.0).otherwise(0.0)).otherwise(1.0 - F.try_divide(squares, spread))
    if not guard:
        r2 = 1.0 - ieee_div(squares, F.coalesce(spread, F.lit(0.0)))
    return [mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.coalesce(F.avg(F.abs(error)), F.lit(0.0)).alias("mae"), r2.alias("r2")]


def classification_metrics(label: Column, predicted: Column) -> list[Column]:
    """accuracy, precision, recall and f1 of class 1; 0 where a ratio has no denominator."""
    hit = lambda a, b: F.count_if((label == a) & (predicted == b))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn = hit(1, 1), hit(0, 1), hit(1, 0)
    return [ratio(F.count_if(label == predicted), F.count(label)).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]


def evaluate_regression(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.agg(*regression_metrics(F.col(label), F.col(prediction)))


def evaluate_classification(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return df.agg(*classification_metrics(F.col(label), F.col(predicted)))


def timing_summary(df: DataFrame, column: str) -> DataFrame:
    """mean, std, min, max, and median, p95 and p99 as members of the sample (the one at index floor(n * q), the last at most); all null without rows."""
    members = quantiles(df, [Quantiles(F.col(column), [0.5, 0.95, 0.99], member=True)])[0] or [None] * 3
    return df.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"), *[F.lit(v).cast("double").alias(name) for name, v in zip(("median", "p95", "p99"), members, strict=True)])
