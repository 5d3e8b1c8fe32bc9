"""Exact order statistics and most frequent values, without all values of a column in one task."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts into which a bracket of values is cut at a time.
PARTS = 4096


@dataclass
class Quantiles:
    """Interpolated quantiles of what is not null, as a wanted aggregate; None without values. ``member``: the value at rank floor(n * share), the last at most, instead."""

    value: Column
    shares: list[float]
    member: bool = False

    def ranks(self, n: int) -> list[tuple[int, int, float]]:
        """For each share the ranks below and above, and how far between them it lies."""
        if self.member:
            return [(min(math.floor(n * p), n - 1),) * 2 + (0.0,) for p in self.shares]
        at = [p * (n - 1) for p in self.shares]
        return [(math.floor(x), math.ceil(x), x - math.floor(x)) for x in at]


@dataclass
class MostFrequent:
    """The most frequent value that is not null, the smallest on ties, as a wanted aggregate; None without values."""

    value: Column


def quantiles(df: DataFrame, wanted: list[Quantiles]) -> list[list[float] | None]:
    """All wanted quantiles, exact.

    Each column's range of values is cut into PARTS, and one aggregation with partial sums counts the rows of each part and takes its least and largest value. The counts tell which part holds a rank; that part's values are cut again, until it is of a single value. A column of few values is done after one round, one that spreads evenly over its range after two or three, and any after six or so. What reaches the driver is PARTS rows for each bracket at most.
    """
    values = df.select(*[w.value.cast("double").alias(f"v{k}") for k, w in enumerate(wanted)])
    finite = lambda k: F.when(F.abs(f"v{k}") < F.lit(float("inf")), F.col(f"v{k}"))
    row = values.agg(*[a for k in range(len(wanted)) for a in (F.count(f"v{k}"), F.min(finite(k)), F.max(finite(k)))]).first()
    sizes = row[0::3]
    found: dict[tuple[int, int], float] = {}
    # A bracket: column, least and largest finite value, whether it is cut for the first time, rows below it, ranks sought in it.
    open_ = [(k, row[3 * k + 1] or 0.0, row[3 * k + 2] or 0.0, True, 0, sorted({r for pair in w.ranks(sizes[k]) for r in pair[:2]})) for k, w in enumerate(wanted) if sizes[k]]
    while open_:
        parts = []
        for i, (k, low, high, whole, _, _) in enumerate(open_):
            v = F.col(f"v{k}")
            span = high / 2 - low / 2
            part = F.least(F.floor((v / 2 - low / 2) / span * PARTS).cast("int"), F.lit(PARTS - 1)) if span > 0 else F.lit(0)
            part = F.when(v < low, -1).when(v > high, PARTS).otherwise(part)  # the infinities
            parts.append(F.when(v.isNotNull() if whole else v.between(low, high), F.struct(F.lit(i).alias("i"), part.alias("part"), v.alias("v"))))
        cells = values.select(F.explode(F.array_compact(F.array(*parts))).alias("c")).groupBy("c.i", "c.part").agg(F.count("*").alias("n"), F.min("c.v").alias("low"), F.max("c.v").alias("high")).collect()
        cells.sort(key=lambda r: (r["i"], r["part"]))
        later = []
        for i, (k, _, _, _, below, ranks) in enumerate(open_):
            for r in (c for c in cells if c["i"] == i):
                inside = [x for x in ranks if below <= x < below + r["n"]]
                if inside and r["low"] == r["high"]:
                    found |= {(k, x): r["low"] for x in inside}
                elif inside:
                    later.append((k, r["low"], r["high"], False, below, inside))
                below += r["n"]
        open_ = later
    out = []
    for k, w in enumerate(wanted):
        out.append([found[k, a] if found[k, a] == found[k, b] else (1 - part) * found[k, a] + part * found[k, b] for a, b, part in w.ranks(sizes[k])] if sizes[k] else None)
    return out


def most_frequent(df: DataFrame, wanted: list[MostFrequent]) -> list[float | None]:
    """All wanted values in one job: values are counted by themselves, with partial sums, and each column keeps its best."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), w.value.cast("double").alias("v")) for k, w in enumerate(wanted)])
    counted = df.select(F.explode(pairs).alias("p")).where("p.v is not null").groupBy("p.k", "p.v").agg(F.count("*").alias("n"))
    best = {r["k"]: -r["m"]["w"] for r in counted.groupBy("k").agg(F.max(F.struct("n", (-F.col("v")).alias("w"))).alias("m")).collect()}
    return [best.get(k) for k in range(len(wanted))]
