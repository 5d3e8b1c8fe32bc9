"""Reading, numbering, batching and splitting of rows."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mlframe.errors import EmptyData, FeatureMismatch, InvalidParameter


def from_rows(spark: SparkSession, features: list[list[float]], target: list[float], names: list[str] | None = None) -> DataFrame:
    """row_id, the features and label from lists; equal lengths, at least one row, rows of one width."""
    if not features:
        raise EmptyData("no rows")
    if len(features) != len(target):
        raise FeatureMismatch(f"{len(features)} rows and {len(target)} targets")
    if len({len(r) for r in features}) != 1:
        raise FeatureMismatch("rows of different width")
    names = names or [f"f{k}" for k in range(len(features[0]))]
    schema = T.StructType([T.StructField("row_id", T.LongType(), False), *[T.StructField(n, T.DoubleType()) for n in names], T.StructField("label", T.DoubleType())])
    return spark.createDataFrame([(k, *map(float, r), float(t)) for k, (r, t) in enumerate(zip(features, target, strict=True))], schema)


def to_rows(df: DataFrame, features: list[str], label: str, order_by: str, max_rows: int = 1_000_000) -> tuple[list[list[float]], list[float]]:
    """The reverse of :func:`from_rows`: features and targets as lists, in order. More than ``max_rows`` rows are an error, as they go to the driver."""
    found = df.orderBy(order_by).select(*features, label).limit(max_rows + 1).collect()
    if len(found) > max_rows:
        raise InvalidParameter(f"more than {max_rows} rows")
    return [[float(v) for v in r[:-1]] for r in found], [float(r[-1]) for r in found]


def read_csv(spark: SparkSession, path: str, names: list[str], strict: bool = False) -> DataFrame:
    """Columns of doubles from a file with a header. An unreadable cell is 0, or with ``strict`` an error; rows of another width are kept with what they have, or with ``strict`` left out."""
    raw = spark.read.csv(path, header=True, schema=T.StructType([T.StructField(n, T.StringType()) for n in names]), enforceSchema=True, mode="DROPMALFORMED" if strict else "PERMISSIVE")
    if strict:
        return raw.select(*[F.col(n).cast("double").alias(n) for n in names])
    return raw.select(*[F.coalesce(F.col(n).try_cast("double"), F.lit(0.0)).alias(n) for n in names])


def write_report(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def _range_of(key: Column, cuts: list[float]) -> Column:
    """Number of ``cuts`` (rising) at or below the key: by halving, and beyond 256 cuts by a row of them that halving picks."""
    if len(cuts) > 256:
        width = math.isqrt(len(cuts)) + 1
        rows = [cuts[k : k + width] for k in range(0, len(cuts), width)]
        at = _range_of(key, [row[0] for row in rows[1:]])
        own = F.element_at(F.from_json(F.lit(json.dumps(rows)), "array<array<double>>"), at + 1)
        return (at * width + F.size(F.filter(own, lambda c: c <= key))).cast("int")

    def halve(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        half = (low + high) // 2
        return F.when(key < F.lit(cuts[half]), halve(low, half)).otherwise(halve(half + 1, high))

    return halve(0, len(cuts))


def with_row_ids(df: DataFrame, order_by: str, name: str = "row_id", ranges: int | None = None) -> DataFrame:
    """Numbers rows from 0 in the order of a numeric column, without putting all rows into one task.

    Quantiles from a sketch cut the keys into ``ranges`` (as many as there are shuffle partitions); an aggregate counts each range's rows, and a row's number is its place within its range plus the rows of the ranges before. Only the counts, one number a range, are broadcast. A missing or repeated key is an error at execution: it has no place in the order.
    """
    if not isinstance(df.schema[order_by].dataType, T.NumericType):
        raise InvalidParameter("order_by has to be a numeric column")
    ranges = max(1, min(1 << 16, ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))))
    key = F.col(order_by).cast("double")
    shares = F.from_json(F.lit(json.dumps([k / ranges for k in range(1, ranges)])), "array<double>") if ranges > 1 else F.array(F.lit(0.5))
    cuts = df.agg(F.percentile_approx(key, shares, F.lit(max(1000, 10 * ranges)))).first()[0] or []
    cuts = sorted({c for c in cuts if c == c}) if ranges > 1 else []
    checked = F.when(key.isNull() | F.isnan(key), F.raise_error(F.lit(f"missing key in {order_by}")).cast("int")).otherwise(_range_of(key, cuts))
    parted = df.withColumn("_part", checked)
    counts = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    order = Window.partitionBy("_part").orderBy(order_by)
    place = F.when(F.lag(order_by).over(order) == F.col(order_by), F.raise_error(F.lit(f"repeated key in {order_by}")).cast("int")).otherwise(F.row_number().over(order) - 1)
    within = parted.withColumn("_place", place)
    return within.join(F.broadcast(before), "_part").withColumn(name, (F.col("_place") + F.col("_before")).cast("long")).drop("_part", "_place", "_before")


def with_batches(df: DataFrame, order_by: str, size: int) -> DataFrame:
    """batch_id: rows in order, ``size`` to a batch, the last one may be shorter."""
    if size < 1:
        raise InvalidParameter("the batch size is below 1")
    return with_row_ids(df, order_by, "_row").withColumn("batch_id", F.floor(F.col("_row") / size).cast("long")).drop("_row")


def get_batch(df: DataFrame, start: int, stop: int, row_id: str = "row_id") -> DataFrame:
    """Rows numbered start to stop - 1."""
    return df.where((F.col(row_id) >= start) & (F.col(row_id) < stop))


def batches(df: DataFrame, size: int, row_id: str = "row_id") -> Iterator[DataFrame]:
    """The batches of a numbered DataFrame one by one, each a lazy DataFrame."""
    if size < 1:
        raise InvalidParameter("the batch size is below 1")
    n = df.count()
    for start in range(0, n, size):
        yield get_batch(df, start, start + size, row_id)


def select_features(df: DataFrame, numbers: list[int], others: list[str]) -> DataFrame:
    """Columns by number, 0.0 for a number that is out of range (named Unknown), and the columns ``others``."""
    pick: list[Column] = [F.col(df.columns[k]) if 0 <= k < len(df.columns) else F.lit(0.0).alias("Unknown") for k in numbers]
    return df.select(*pick, *others)


def split(df: DataFrame, ratio: float, row_id: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """The first trunc(n * ratio) rows, and the rest."""
    first = int(df.count() * ratio)
    return df.where(F.col(row_id) < first), df.where(F.col(row_id) >= first)


def split3(df: DataFrame, train: float, validation: float, row_id: str = "row_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three runs of rows: shares ``train`` and ``validation``, and what is left."""
    n = df.count()
    a = int(n * train)
    b = a + int(n * validation)
    at = F.col(row_id)
    return df.where(at < a), df.where((at >= a) & (at < b)), df.where(at >= b)
