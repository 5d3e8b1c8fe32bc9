"""Fitting plans: the aggregates of all independent steps run as one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlframe.errors import EmptyData, FeatureMismatch
from mlframe.plans.selection import MostFrequent, Quantiles, most_frequent, quantiles


def need_columns(df: DataFrame, names: list[str]) -> None:
    """Raises where a column is not there."""
    lost = [c for c in names if c not in df.columns]
    if lost:
        raise FeatureMismatch(f"no such columns: {', '.join(lost)}")


def run_aggregates(df: DataFrame, wanted: dict[str, Column | Quantiles | MostFrequent]) -> dict:
    """All aggregates in one pass over ``df``, by name; equal expressions are worked out once by the planner. Quantiles and most frequent values take passes of their own, for all columns together. No rows: EmptyData."""
    plain = {name: c for name, c in wanted.items() if isinstance(c, Column)}
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[c.alias(f"a{k}") for k, c in enumerate(plain.values())]).first() if plain else {"_rows": not df.isEmpty()}
    if not row["_rows"]:
        raise EmptyData("no rows to fit on")
    found = {name: row[f"a{k}"] for k, name in enumerate(plain)}
    for kind, run in ((Quantiles, quantiles), (MostFrequent, most_frequent)):
        names = [name for name, c in wanted.items() if isinstance(c, kind)]
        if names:
            found |= dict(zip(names, run(df, [wanted[n] for n in names]), strict=True))
    return found


def fit_together(df: DataFrame, steps: list[tuple]) -> list:
    """Fits steps (step, columns) that do not depend on each other together: one aggregation, and what quantiles and most frequent values need beside it."""
    wanted: dict[str, Column | Quantiles | MostFrequent] = {}
    for k, (step, columns) in enumerate(steps):
        need_columns(df, columns)
        wanted |= {f"{k}/{name}": c for name, c in step.aggregates(columns).items()}
    found = run_aggregates(df, wanted) if wanted else {}
    if not wanted and df.isEmpty():
        raise EmptyData("no rows to fit on")
    return [step.model(columns, {name.partition("/")[2]: v for name, v in found.items() if name.startswith(f"{k}/")}) for k, (step, columns) in enumerate(steps)]
