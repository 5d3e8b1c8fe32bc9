"""Encoders of numeric categories."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlframe.errors import InvalidParameter
from mlframe.functions.exprs import NAN, missing
from mlframe.operators.base import Model, Step

#: How near a value has to be to a category.
NEAR = 1e-6
#: Range of a 32-bit integer, which keys saturate at.
LEAST, MOST = -(2**31), 2**31 - 1


def finite(c: Column) -> Column:
    return ~missing(c) & (F.abs(c) != F.lit(float("inf")))


def key_of(c: Column) -> Column:
    """The value rounded half away from zero, within 32 bits; missing stays missing (NULL)."""
    return F.when(~missing(c), F.least(F.greatest(F.round(c), F.lit(float(LEAST))), F.lit(float(MOST))).cast("int"))


def stop(message: str, kind: str) -> Column:
    """An error when a row gets here."""
    return F.raise_error(F.lit(message)).cast(kind)


@dataclass
class OneHotModel(Model):
    """A block of 0/1 columns for each input: one for each category seen, in order."""

    input_cols: list[str]
    categories: list[list[int]]
    unknown: str

    def outputs(self, columns: list[Column]) -> list[tuple[str, Column]]:
        out = []
        for name, c, categories in zip(self.input_cols, columns, self.categories, strict=True):
            # The category of a row, once for all its columns: generated code shares what every output begins with.
            whole = F.round(c)
            key = F.when(~missing(c) & (F.abs(c - whole) < NEAR) & whole.between(0.0, float(MOST)), whole.cast("int"))
            if self.unknown == "ignore":
                key = F.coalesce(key, F.lit(-1))
            else:
                known = F.find_in_set(key.cast("string"), F.lit(",".join(map(str, categories)))) > 0
                key = F.when(known, key).otherwise(stop(f"unknown category in {name}", "int"))
            out += [(f"{name}_{k}", (key == F.lit(k)).cast("double")) for k in categories]
        return out

    def inverse_outputs(self, columns: list[Column]) -> list[tuple[str, Column]]:
        out, at = [], 0
        for name, categories in zip(self.input_cols, self.categories, strict=True):
            block = columns[at : at + len(categories)]
            at += len(categories)
            out.append((name, F.coalesce(*[F.when(~missing(c) & (c > 0.5), F.lit(float(k))) for c, k in zip(block, categories, strict=True)], F.lit(NAN))))
        return out

    @property
    def n_values(self) -> list[int]:
        return [len(c) for c in self.categories]

    def to_dict(self) -> dict:
        return asdict(self)


#: Categories of a column beyond which encoding it in columns, or by a table in the plan, is an error.
MAX_CATEGORIES = 20_000


def sorted_categories(name: str, found: list[int]) -> list[int]:
    if len(found) > MAX_CATEGORIES:
        raise InvalidParameter(f"{name} has {len(found)} categories, {MAX_CATEGORIES} are allowed")
    return sorted(found)


def _check_unknown(unknown: str) -> None:
    if unknown not in ("error", "ignore"):
        raise InvalidParameter(f"unknown handling {unknown!r}")


@dataclass
class OneHotEncoder(Step):
    """Non-negative integers to indicator columns. Anything else while fitting is an error.

    A value not seen while fitting, or a missing one, is an error at execution, or all zeros with ``unknown`` = "ignore".
    """

    unknown: str = "error"

    def __post_init__(self):
        _check_unknown(self.unknown)

    def aggregates(self, columns):
        good = {c: finite(F.col(c)) & (F.col(c) >= 0) & (F.floor(F.col(c)) == F.col(c)) & (F.col(c) <= MOST) for c in columns}
        return {f"bad {c}": F.count_if(~F.coalesce(g, F.lit(False))) for c, g in good.items()} | {f"set {c}": F.collect_set(F.when(g, F.col(c)).try_cast("int")) for c, g in good.items()}

    def model(self, columns, found):
        bad = [c for c in columns if found[f"bad {c}"]]
        if bad:
            raise InvalidParameter(f"not only non-negative integers: {', '.join(bad)}")
        return OneHotModel(columns, [sorted_categories(c, found[f"set {c}"]) for c in columns], self.unknown)


@dataclass
class OrdinalModel(Model):
    """Category to its place among the sorted categories."""

    input_cols: list[str]
    categories: list[list[int]]
    unknown: str

    def outputs(self, columns: list[Column]) -> list[tuple[str, Column]]:
        out = []
        for name, c, categories in zip(self.input_cols, columns, self.categories, strict=True):
            other = F.lit(NAN) if self.unknown == "ignore" else stop(f"unknown category in {name}", "double")
            place = F.array_position(F.array(*[F.lit(k) for k in categories]), key_of(c))
            out.append((name, F.when(place > 0, (place - 1).cast("double")).otherwise(other)))
        return out

    def inverse_outputs(self, columns: list[Column]) -> list[tuple[str, Column]]:
        out = []
        for name, c, categories in zip(self.input_cols, columns, self.categories, strict=True):
            whole = F.when(~missing(c) & (c > -1) & (c < len(categories)), F.floor(F.greatest(c, F.lit(0.0))).cast("int"))
            out.append((name, F.coalesce(F.try_element_at(F.array(*[F.lit(float(k)) for k in categories]), whole + 1), F.lit(NAN))))
        return out

    def mapping(self, k: int) -> dict[int, int]:
        return {category: place for place, category in enumerate(self.categories[k])}

    def to_dict(self) -> dict:
        return asdict(self)


@dataclass
class OrdinalEncoder(Step):
    """Finite numbers, rounded, to 0 .. k - 1 in order; other values while fitting are an error.

    Unknown and missing values are an error at execution, or NaN with ``unknown`` = "ignore" (a missing value is not taken for category 0).
    """

    unknown: str = "error"

    def __post_init__(self):
        _check_unknown(self.unknown)

    def aggregates(self, columns):
        return {f"bad {c}": F.count_if(~F.coalesce(finite(F.col(c)), F.lit(False))) for c in columns} | {f"set {c}": F.collect_set(key_of(F.col(c))) for c in columns}

    def model(self, columns, found):
        bad = [c for c in columns if found[f"bad {c}"]]
        if bad:
            raise InvalidParameter(f"not finite: {', '.join(bad)}")
        return OrdinalModel(columns, [sorted_categories(c, found[f"set {c}"]) for c in columns], self.unknown)


@dataclass
class LabelModel:
    """Classes of one target column."""

    label_col: str
    classes: list[int]

    def encode(self, c: Column) -> Column:
        place = F.array_position(F.array(*[F.lit(k) for k in self.classes]), key_of(c))
        return F.when(place > 0, (place - 1).cast("double")).otherwise(stop("unknown label", "double"))

    def decode(self, c: Column) -> Column:
        at = F.when(~missing(c) & (c > -0.5) & (c < len(self.classes) - 0.5), F.round(c).cast("int"))
        return F.coalesce(F.try_element_at(F.array(*[F.lit(float(k)) for k in self.classes]), at + 1), stop("no such class", "double"))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.label_col, self.encode(F.col(self.label_col)))

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.label_col, self.decode(F.col(self.label_col)))


class LabelEncoder:
    """Encodes a target column; unknown labels are always an error. Not a step of pipelines, as it has one column of its own."""

    def fit(self, df: DataFrame, label_col: str) -> LabelModel:
        found = OrdinalEncoder().fit(df, [label_col])
        return LabelModel(label_col, found.categories[0])
