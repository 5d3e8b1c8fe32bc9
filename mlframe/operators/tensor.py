"""Matrix operations over a block of columns (rows of a DataFrame are rows of the matrix)."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mlframe.errors import EmptyData, FeatureMismatch, InvalidParameter
from mlframe.functions.exprs import INF, dot, ieee_div, nan_to_null


def zeros_1d(n: int) -> Column:
    """A vector of zeros in one array column."""
    return F.array_repeat(F.lit(0.0), n)


def zeros_2d(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    """row_id and columns c0, c1, ... of zeros."""
    return spark.range(rows).select(F.col("id").alias("row_id"), *[F.lit(0.0).alias(f"c{k}") for k in range(columns)])


def from_vec_1d(values: list[float], single: bool = False) -> Column:
    """A vector in one array column; with ``single`` the numbers go through 32 bits."""
    numbers = F.array(*[F.lit(float(v)) for v in values]) if values else F.array().cast("array<double>")
    return numbers.cast("array<float>").cast("array<double>") if single else numbers


def from_vec_2d(spark: SparkSession, values: list[float], rows: int, columns: int) -> DataFrame:
    """row_id and columns c0, c1, ... from numbers in row order."""
    if len(values) != rows * columns:
        raise InvalidParameter(f"{len(values)} numbers for {rows} rows of {columns}")
    schema = ", ".join(["row_id long", *[f"c{k} double" for k in range(columns)]])
    return spark.createDataFrame([(k, *map(float, values[k * columns : (k + 1) * columns])) for k in range(rows)], schema)


def shape(df: DataFrame, columns: list[str]) -> tuple[int, int]:
    return df.count(), len(columns)


def ravel(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """The cells in row order as a vector: index (``row`` counts from 0) and value; no shuffle."""
    cells = F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("k", "value")
    return df.select(F.col(row).alias("_row"), cells).select((F.col("_row") * len(columns) + F.col("k")).cast("long").alias("index"), "value")


def col_sum(c: str) -> Column:
    """Sum of a column; 0 without rows."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def sum_all(columns: list[str]) -> Column:
    """Sum of all cells; 0 without rows."""
    return F.coalesce(reduce(add, [F.sum(c) for c in columns]), F.lit(0.0))


def mean_all(columns: list[str]) -> Column:
    """Mean of all cells: of one column 0 without rows, of several an error."""
    if len(columns) == 1:
        return F.coalesce(F.avg(columns[0]), F.lit(0.0))
    return F.when(F.count(F.lit(1)) == 0, F.raise_error(F.lit("mean of an empty matrix")).cast("double")).otherwise(reduce(add, [F.avg(c) for c in columns]) / len(columns))


def col_min(c: str) -> Column:
    """NaN is skipped; inf without values."""
    return F.coalesce(F.min(nan_to_null(c)), F.lit(INF))


def col_max(c: str) -> Column:
    return F.coalesce(F.max(nan_to_null(c)), F.lit(-INF))


def col_std(c: str, ddof: int = 0) -> Column:
    """Standard deviation with ``ddof`` degrees of freedom taken off; an error where none are left."""
    n = F.count(c)
    return F.when(n <= ddof, F.raise_error(F.lit("as many degrees of freedom as rows")).cast("double")).otherwise(F.sqrt(F.var_pop(c) * n / (n - ddof)))


def row_sum(columns: list[str]) -> Column:
    return reduce(add, [F.col(c) for c in columns])


def matvec(columns: list[str], vector: list[float]) -> Column:
    return dot([F.col(c) for c in columns], vector)


def matvec_transposed(columns: list[str], vector: str) -> list[Column]:
    """One aggregate a column: the transpose is never made."""
    return [F.sum(F.col(c) * F.col(vector)).alias(c) for c in columns]


def gram(columns: list[str]) -> list[Column]:
    """Upper triangle of the product of the transpose and the matrix."""
    return [F.sum(F.col(a) * F.col(b)).alias(f"{a}*{b}") for k, a in enumerate(columns) for b in columns[k:]]


def broadcast_rows(columns: list[str], vector: list[float], op: str) -> list[Column]:
    """Each column with its own number: add, sub, mul or div (by zero as IEEE has it)."""
    if len(columns) != len(vector):
        raise FeatureMismatch(f"{len(columns)} columns and {len(vector)} numbers")
    ops = {"add": lambda c, v: c + v, "sub": lambda c, v: c - v, "mul": lambda c, v: c * v, "div": ieee_div}
    if op not in ops:
        raise InvalidParameter(f"unknown operation {op!r}")
    return [ops[op](F.col(c), F.lit(float(v))).alias(c) for c, v in zip(columns, vector, strict=True)]


def select_columns(df: DataFrame, numbers: list[int]) -> DataFrame:
    """Columns by number, in any order, as often as wanted; a repeated one gets its place behind its name."""
    if any(not 0 <= k < len(df.columns) for k in numbers):
        raise InvalidParameter("column number out of range")
    seen: dict[str, int] = {}
    out = []
    for k in numbers:
        name = df.columns[k]
        seen[name] = seen.get(name, 0) + 1
        out.append(F.col(f"`{name}`").alias(name if seen[name] == 1 else f"{name}_{seen[name]}"))
    return df.select(*out)


def hcat(df: DataFrame, blocks: list[list[tuple[str, Column]]]) -> DataFrame:
    """Blocks of expressions over one DataFrame side by side; there is no joining of rows by position."""
    if not blocks:
        raise InvalidParameter("nothing to put side by side")
    return df.select(*[c.alias(n) for block in blocks for n, c in block])


def one_hot_indices(index: Column, k: int) -> list[Column]:
    """k indicator columns; an index that is no whole number from 0 to k - 1 is an error."""
    good = (index >= 0) & (index < k) & (F.floor(index) == index)
    return [F.when(good, (index == j).cast("double")).otherwise(F.raise_error(F.lit("index out of range")).cast("double")).alias(f"c{j}") for j in range(k)]


def transpose(df: DataFrame, row: str, columns: list[str], max_rows: int = 1000) -> DataFrame:
    """A small matrix turned: one row for each column, one column for each row."""
    keys = [r[0] for r in df.select(row).orderBy(row).limit(max_rows + 1).collect()]
    if not keys:
        raise EmptyData("nothing to transpose")
    if len(keys) > max_rows:
        raise InvalidParameter(f"more than {max_rows} rows would become columns; aggregate with matvec_transposed instead")
    tall = df.select(row, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for k, c in enumerate(columns)])).alias("e")).select(row, "e.*")
    return tall.groupBy("k", "column").pivot(row, keys).agg(F.first("v")).orderBy("k").drop("k")
