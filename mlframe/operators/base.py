"""What fitted and unfitted steps have in common.

A step is fitted by aggregates and applied as column expressions, so a fitted step is a projection: lazy, without a shuffle, and as good on a stream as on a table.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mlframe.errors import InvalidParameter, MlframeError, SerializationError
from mlframe.plans.fusion import fit_together, need_columns

#: Fitted classes by name, for loading.
REGISTRY: dict[str, type[Model]] = {}


class Model(ABC):
    """A fitted step."""

    input_cols: list[str]

    def __init_subclass__(cls) -> None:
        REGISTRY[cls.__name__] = cls

    @abstractmethod
    def outputs(self, columns: list[Column]) -> list[tuple[str, Column]]:
        """Names and expressions of the outputs, given the inputs in the order of ``input_cols``."""

    def inverse_outputs(self, columns: list[Column]) -> list[tuple[str, Column]]:
        """Names and expressions that undo :meth:`outputs`."""
        raise MlframeError(f"{type(self).__name__} has no inverse")

    @property
    def output_cols(self) -> list[str]:
        return [name for name, _ in self.outputs([F.lit(0.0)] * len(self.input_cols))]

    @property
    def n_features_in(self) -> int:
        return len(self.input_cols)

    @property
    def n_features_out(self) -> int:
        return len(self.output_cols)

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """The outputs beside the columns ``keep``: by default all that are not inputs."""
        need_columns(df, self.input_cols)
        keep = [c for c in df.columns if c not in self.input_cols] if keep is None else keep
        return df.select(*keep, *[c.alias(name) for name, c in self.outputs([F.col(c) for c in self.input_cols])])

    def inverse_transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        need_columns(df, self.output_cols)
        keep = [c for c in df.columns if c not in self.output_cols] if keep is None else keep
        return df.select(*keep, *[c.alias(name) for name, c in self.inverse_outputs([F.col(c) for c in self.output_cols])])

    @abstractmethod
    def to_dict(self) -> dict:
        """Plain values that :meth:`from_dict` takes; floats stay 64 bit."""

    @classmethod
    def from_dict(cls, values: dict) -> Model:
        return cls(**values)

    def save(self, path: str) -> None:
        write_text(path, json.dumps(pack(self)))

    @staticmethod
    def load(path: str) -> Model:
        try:
            return unpack(json.loads(read_text(path)))
        except (ValueError, KeyError, TypeError) as e:
            raise SerializationError(f"{path}: {e}") from e


def _file_system(path: str):
    """Spark's file system for a path and the path in it, so a model can go wherever tables can; (None, path) without a session."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return None, path
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def write_text(path: str, text: str) -> None:
    system, place = _file_system(path)
    if system is None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        return
    out = system.create(place, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(path: str) -> str:
    system, place = _file_system(path)
    if system is None:
        with open(path, encoding="utf-8") as f:
            return f.read()
    stream = system.open(place)
    try:
        return SparkSession.getActiveSession().sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def pack(model: Model) -> dict:
    return {"class": type(model).__name__, "values": model.to_dict()}


def unpack(data: dict) -> Model:
    if data.get("class") not in REGISTRY:
        raise SerializationError(f"unknown class {data.get('class')!r}")
    return REGISTRY[data["class"]].from_dict(data["values"])


class Step(ABC):
    """An unfitted step: the aggregates it needs, and the model they make."""

    @abstractmethod
    def aggregates(self, columns: list[str]) -> dict[str, Column]:
        """Aggregates by name."""

    @abstractmethod
    def model(self, columns: list[str], found: dict) -> Model:
        """The model from the aggregates' values."""

    def fit(self, df: DataFrame, columns: list[str]) -> Model:
        if not columns:
            raise InvalidParameter("no columns to fit")
        return fit_together(df, [(self, list(columns))])[0]

    def fit_transform(self, df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
        return self.fit(df, columns).transform(df, keep)
