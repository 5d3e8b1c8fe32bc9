"""Steps in a row, steps side by side, and both before a model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlframe.errors import FeatureMismatch, InvalidParameter
from mlframe.operators.base import Model, Step, pack, unpack
from mlframe.plans.fusion import fit_together, need_columns


@dataclass
class PipelineModel(Model):
    names: list[str]
    steps: list[Model]

    @property
    def input_cols(self) -> list[str]:
        return self.steps[0].input_cols

    def __len__(self) -> int:
        return len(self.steps)

    @property
    def is_empty(self) -> bool:
        return not self.steps

    @property
    def step_names(self) -> list[str]:
        return list(self.names)

    def outputs(self, columns: list[Column]) -> list[tuple[str, Column]]:
        named = list(zip(self.input_cols, columns, strict=True))
        for step in self.steps:
            named = step.outputs([c for _, c in named])
        return named

    def inverse_outputs(self, columns: list[Column]) -> list[tuple[str, Column]]:
        if len(columns) != self.n_features_in:
            raise FeatureMismatch(f"{len(columns)} columns, {self.n_features_in} were fitted: a pipeline that changes the number of columns has no inverse")
        named = list(zip(self.input_cols, columns, strict=True))
        for step in reversed(self.steps):
            named = step.inverse_outputs([c for _, c in named])
        return named

    def to_dict(self) -> dict:
        return {"names": self.names, "steps": [pack(s) for s in self.steps]}

    @classmethod
    def from_dict(cls, values: dict) -> PipelineModel:
        return cls(values["names"], [unpack(s) for s in values["steps"]])


class Pipeline:
    """Steps in a row, each fitted on what those before it make. One job for each step that learns anything."""

    def __init__(self, steps: list[tuple[str, Step]]):
        if not steps:
            raise InvalidParameter("a pipeline without steps")
        self.steps = steps

    def fit(self, df: DataFrame, columns: list[str]) -> PipelineModel:
        need_columns(df, columns)
        fitted, now, names = [], df.select(*columns), list(columns)
        for _, step in self.steps:
            fitted.append(step.fit(now, names))
            now, names = fitted[-1].transform(now), fitted[-1].output_cols
        return PipelineModel([n for n, _ in self.steps], fitted)


@dataclass
class ColumnTransformerModel(Model):
    input_cols: list[str]
    parts: list[tuple[str, Model]]

    def __len__(self) -> int:
        return len(self.parts)

    @property
    def is_empty(self) -> bool:
        return not self.parts

    @property
    def step_names(self) -> list[str]:
        return [name for name, _ in self.parts]

    def outputs(self, columns: list[Column]) -> list[tuple[str, Column]]:
        by_name = dict(zip(self.input_cols, columns, strict=True))
        return [(f"{name}__{out}", c) for name, model in self.parts for out, c in model.outputs([by_name[i] for i in model.input_cols])]

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """One projection; columns that no part names go, but for ``keep``."""
        return super().transform(df, keep or [])

    def to_dict(self) -> dict:
        return {"input_cols": self.input_cols, "parts": [[n, pack(m)] for n, m in self.parts]}

    @classmethod
    def from_dict(cls, values: dict) -> ColumnTransformerModel:
        return cls(values["input_cols"], [(n, unpack(m)) for n, m in values["parts"]])


class ColumnTransformer:
    """Parts (name, columns, step or pipeline) side by side on the original columns, outputs in the order of the parts.

    Columns are names, or their numbers, or a slice, or "all". What the parts have to learn runs level by level, one job for all parts of a level (the k-th steps of their pipelines).
    """

    def __init__(self, parts: list[tuple]):
        if not parts:
            raise InvalidParameter("a column transformer without parts")
        self.parts = parts

    @staticmethod
    def resolve(df: DataFrame, spec) -> list[str]:
        if isinstance(spec, str):
            return list(df.columns) if spec == "all" else [spec]
        if isinstance(spec, (slice, range)):
            spec = list(range(*spec.indices(len(df.columns)))) if isinstance(spec, slice) else list(spec)
        if any(isinstance(k, int) and not 0 <= k < len(df.columns) for k in spec):
            raise InvalidParameter("column number out of range")
        names = [df.columns[k] if isinstance(k, int) else k for k in spec]
        if any(n not in df.columns for n in names):
            raise InvalidParameter(f"no such columns: {[n for n in names if n not in df.columns]}")
        return names

    def fit(self, df: DataFrame) -> ColumnTransformerModel:
        parts = [(name, self.resolve(df, spec), step.steps if isinstance(step, Pipeline) else [("", step)]) for name, spec, step in self.parts]
        inputs = list(dict.fromkeys(c for _, columns, _ in parts for c in columns))
        fitted: list[list[Model]] = [[] for _ in parts]
        for level in range(max(len(steps) for _, _, steps in parts)):
            on = [k for k, (_, _, steps) in enumerate(parts) if level < len(steps)]
            columns, todo = [], []
            for k in on:
                named = [(c, F.col(f"`{c}`")) for c in parts[k][1]]
                for model in fitted[k]:
                    named = model.outputs([c for _, c in named])
                columns += [c.alias(f"{k}|{n}") for n, c in named]
                todo.append((parts[k][2][level][1], [n for n, _ in named]))
            wide = df.select(*columns)
            shared = fit_together(wide, [(_Renamed(step, k), [f"{k}|{n}" for n in names]) for k, (step, names) in zip(on, todo, strict=True)])
            for k, model in zip(on, shared, strict=True):
                fitted[k].append(model)
        models = [(name, m[0] if not isinstance(step, Pipeline) else PipelineModel([n for n, _ in step.steps], m)) for (name, _, step), m in zip(self.parts, fitted, strict=True)]
        return ColumnTransformerModel(inputs, models)

    def fit_transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        return self.fit(df).transform(df, keep)


class _Renamed(Step):
    """A step that is fitted on columns with a part's number before their names, and forgets the number."""

    def __init__(self, step: Step, part: int):
        self.step, self.start = step, len(f"{part}|")

    def aggregates(self, columns):
        return self.step.aggregates(columns)

    def model(self, columns, found):
        names = [c[self.start :] for c in columns]
        swap = dict(zip(columns, names, strict=True))
        clean = {}
        for key, value in found.items():
            for old, new in swap.items():
                if key == old or key.endswith(f" {old}"):
                    key = key[: len(key) - len(old)] + new
                    break
            clean[key] = value
        return self.step.model(names, clean)


@dataclass
class PredictivePipeline(Model):
    """Fitted preprocessing, optional polynomial features and a model, as one projection that adds ``prediction``."""

    preprocessor: Model
    predictor: Model
    polynomial: Model | None = None

    @property
    def input_cols(self) -> list[str]:
        return self.preprocessor.input_cols

    def preprocess(self, columns: list[Column]) -> list[tuple[str, Column]]:
        named = self.preprocessor.outputs(columns)
        return self.polynomial.outputs([c for _, c in named]) if self.polynomial else named

    def outputs(self, columns: list[Column]) -> list[tuple[str, Column]]:
        return self.predictor.outputs([c for _, c in self.preprocess(columns)])

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Adds the prediction; all columns stay."""
        return super().transform(df, list(df.columns) if keep is None else keep)

    def to_dict(self) -> dict:
        return {"preprocessor": pack(self.preprocessor), "predictor": pack(self.predictor), "polynomial": pack(self.polynomial) if self.polynomial else None}

    @classmethod
    def from_dict(cls, values: dict) -> PredictivePipeline:
        return cls(unpack(values["preprocessor"]), unpack(values["predictor"]), unpack(values["polynomial"]) if values["polynomial"] else None)
