"""Fitted values, transforms, inverses, saving, and edge cases of every step."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from mlframe.errors import EmptyData, FeatureMismatch, InvalidParameter, MlframeError, SerializationError
from mlframe.operators.base import Model
from mlframe.operators.compose import ColumnTransformer, Pipeline, PredictivePipeline
from mlframe.operators.encoding import LabelEncoder, OneHotEncoder, OrdinalEncoder
from mlframe.operators.imputation import SimpleImputer
from mlframe.operators.linear import LinearModel
from mlframe.operators.polynomial import PolynomialFeatures
from mlframe.operators.scaling import MaxAbsScaler, MinMaxScaler, Normalizer, RobustScaler, StandardScaler

NAN = float("nan")


def frame(spark, rows, names="abcdefgh"):
    width = len(rows[0]) if rows else 2
    schema = "row_id long, " + ", ".join(f"{n} double" for n in names[:width])
    return spark.createDataFrame([(k, *[None if v is None else float(v) for v in r]) for k, r in enumerate(rows)], schema), list(names[:width])


def values(df):
    return [list(r)[1:] for r in df.orderBy("row_id").collect()]


def close(got, want):
    for g, w in zip(got, want, strict=True):
        assert len(g) == len(w)
        assert all((math.isnan(a) and math.isnan(b)) if isinstance(b, float) and math.isnan(b) else abs(a - b) < 1e-6 for a, b in zip(g, w, strict=True)), (got, want)


CASES = [
    (StandardScaler(), [[0, 1], [0, 1], [1, 3]], [[-0.707107, -0.707107], [-0.707107, -0.707107], [1.414214, 1.414214]]),
    (StandardScaler(with_std=False), [[5, 1], [5, 3]], [[0, -1], [0, 1]]),
    (MinMaxScaler(), [[0, 1], [0, 1], [1, 3]], [[0, 0], [0, 0], [1, 1]]),
    (MinMaxScaler(-1, 1), [[0, 1], [0, 1], [1, 3]], [[-1, -1], [-1, -1], [1, 1]]),
    (MinMaxScaler(), [[5, 5], [5, 5]], [[0, 0], [0, 0]]),
    (RobustScaler(), [[1, 2], [2, 4], [3, 6], [4, 8], [5, 100]], [[-1, -1], [-0.5, -0.5], [0, 0], [0.5, 0.5], [1, 23.5]]),
    (RobustScaler(), [[1], [2], [4], [100]], [[(1 - 14.875) / 26.25], [(2 - 14.875) / 26.25], [(4 - 14.875) / 26.25], [(100 - 14.875) / 26.25]]),
    (MaxAbsScaler(), [[-1, 2], [0, 4], [1, -6]], [[-1, 1 / 3], [0, 2 / 3], [1, -1]]),
    (MaxAbsScaler(), [[0, 0], [0, 0]], [[0, 0], [0, 0]]),
]


@pytest.mark.parametrize("step,rows,want", CASES, ids=lambda x: type(x).__name__ if not isinstance(x, list) else None)
def test_scalers(spark, step, rows, want, tmp_path):
    df, names = frame(spark, rows)
    model = step.fit(df, names)
    close(values(model.transform(df)), want)
    close(values(model.inverse_transform(model.transform(df))), rows)
    model.save(str(tmp_path / "m.json"))
    close(values(Model.load(str(tmp_path / "m.json")).transform(df)), want)
    plan = model.transform(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_normalizer(spark):
    df, names = frame(spark, [[3, 4], [1, 0], [0, 0]])
    close(values(Normalizer().fit_transform(df, names)), [[0.6, 0.8], [1, 0], [0, 0]])
    close(values(Normalizer("l1").fit_transform(df, names)), [[3 / 7, 4 / 7], [1, 0], [0, 0]])
    close(values(Normalizer("max").fit_transform(df, names)), [[0.75, 1], [1, 0], [0, 0]])
    with pytest.raises(MlframeError):
        Normalizer().fit(df, names).inverse_transform(df)


@pytest.mark.parametrize("hole", [NAN, None])
def test_imputer(spark, hole):
    df, names = frame(spark, [[1, hole], [3, 4], [5, 6]])
    assert SimpleImputer("mean").fit(df, names).statistics == [3, 5]
    assert SimpleImputer("median").fit(df, names).statistics == [3, 5]
    assert SimpleImputer("constant", -1).fit(df, names).statistics == [-1, -1]
    close(values(SimpleImputer().fit_transform(df, names)), [[1, 5], [3, 4], [5, 6]])
    mode, names = frame(spark, [[1, hole], [1, 2], [1, 2]])
    assert SimpleImputer("most_frequent").fit(mode, names).statistics == [1, 2]
    ties, names = frame(spark, [[2], [1], [2], [1]])
    assert SimpleImputer("most_frequent").fit(ties, names).statistics == [1]
    empty, names = frame(spark, [[1, hole], [2, hole]])
    for strategy in ("mean", "median", "most_frequent", "constant"):
        assert SimpleImputer(strategy, -1).fit(empty, names).statistics[1] == 0


def test_one_hot(spark):
    df, names = frame(spark, [[0, 1], [1, 0]])
    model = OneHotEncoder().fit(df, names)
    close(values(model.transform(df)), [[1, 0, 0, 1], [0, 1, 1, 0]])
    close(values(model.inverse_transform(model.transform(df))), [[0, 1], [1, 0]])
    gap, names = frame(spark, [[0], [2]])
    assert OneHotEncoder().fit(gap, names).n_values == [2]
    seen, _ = frame(spark, [[0], [1]])
    new, _ = frame(spark, [[2], [NAN], [None]])
    close(values(OneHotEncoder("ignore").fit(seen, ["a"]).transform(new)), [[0, 0]] * 3)
    with pytest.raises(PySparkException):
        OneHotEncoder().fit(seen, ["a"]).transform(new).collect()
    for bad in ([-1], [0.5], [NAN], [float("inf")]):
        with pytest.raises(InvalidParameter):
            OneHotEncoder().fit(frame(spark, [[0], bad])[0], ["a"])


def test_ordinal(spark):
    df, names = frame(spark, [[0], [5], [10]])
    model = OrdinalEncoder().fit(df, names)
    close(values(model.transform(df)), [[0], [1], [2]])
    close(values(model.inverse_transform(model.transform(df))), [[0], [5], [10]])
    assert model.mapping(0) == {0: 0, 5: 1, 10: 2}
    odd, _ = frame(spark, [[7], [NAN], [None], [5.4]])
    close(values(OrdinalEncoder("ignore").fit(df, names).transform(odd)), [[NAN], [NAN], [NAN], [1]])
    close(values(model.inverse_transform(frame(spark, [[5], [1.9], [NAN]])[0])), [[NAN], [5], [NAN]])
    with pytest.raises(PySparkException):
        model.transform(odd).collect()


def test_label(spark):
    df = spark.createDataFrame([(0, 10.0), (1, 5.0), (2, 0.0)], "row_id long, y double")
    model = LabelEncoder().fit(df, "y")
    assert model.classes == [0, 5, 10]
    close(values(model.transform(df)), [[2], [1], [0]])
    close(values(model.inverse_transform(model.transform(df))), [[10], [5], [0]])
    with pytest.raises(PySparkException):
        model.transform(spark.createDataFrame([(0, 3.0)], "row_id long, y double")).collect()
    with pytest.raises(EmptyData):
        LabelEncoder().fit(df.limit(0), "y")


@pytest.mark.parametrize(
    "step,row,want",
    [
        (PolynomialFeatures(2), [1, 2], [1, 1, 2, 1, 2, 4]),
        (PolynomialFeatures(2, False), [1, 2], [1, 2, 1, 2, 4]),
        (PolynomialFeatures(2, False, True), [1, 2, 3], [1, 2, 3, 2, 3, 6]),
        (PolynomialFeatures(3), [1, 2], [1, 1, 2, 1, 2, 4, 1, 2, 4, 8]),
        (PolynomialFeatures(0), [1, 2], [1]),
        (PolynomialFeatures(0, False), [1, 2], []),
    ],
)
def test_polynomial(spark, step, row, want):
    df, names = frame(spark, [row])
    model = step.fit(df, names)
    close(values(model.transform(df)), [want])
    assert model.n_features_out == len(want)


def test_pipeline(spark, tmp_path):
    df, names = frame(spark, [[0, 1], [0, 1], [1, 3]])
    model = Pipeline([("s", StandardScaler()), ("m", MinMaxScaler())]).fit(df, names)
    close(values(model.transform(df)), [[0, 0], [0, 0], [1, 1]])
    close(values(model.inverse_transform(model.transform(df))), [[0, 1], [0, 1], [1, 3]])
    model.save(str(tmp_path / "p.json"))
    close(values(Model.load(str(tmp_path / "p.json")).transform(df)), [[0, 0], [0, 0], [1, 1]])
    wide = Pipeline([("o", OneHotEncoder())]).fit(frame(spark, [[0, 1], [1, 0]])[0], names)
    with pytest.raises(FeatureMismatch):
        wide.inverse_transform(wide.transform(frame(spark, [[0, 1]])[0]))
    with pytest.raises(InvalidParameter):
        Pipeline([])


def test_column_transformer(spark, tmp_path):
    df, names = frame(spark, [[1, 10, 0], [2, 20, 1], [3, 30, 0]])
    parts = [("num", [0, 1], Pipeline([("i", SimpleImputer()), ("s", StandardScaler())])), ("cat", ["c"], OneHotEncoder())]
    model = ColumnTransformer(parts).fit(df.select(*names))
    assert model.output_cols == ["num__a", "num__b", "cat__c_0", "cat__c_1"]
    got = values(model.transform(df, ["row_id"]))
    close(got, [[-1.224745, -1.224745, 1, 0], [0, 0, 0, 1], [1.224745, 1.224745, 1, 0]])
    model.save(str(tmp_path / "c.json"))
    close(values(Model.load(str(tmp_path / "c.json")).transform(df, ["row_id"])), got)
    twice = ColumnTransformer([("x", ["a"], StandardScaler()), ("y", ["a"], MinMaxScaler())]).fit(df)
    assert twice.output_cols == ["x__a", "y__a"]
    for bad in ([], [("x", [9], StandardScaler())], [("x", ["nope"], StandardScaler())]):
        with pytest.raises(InvalidParameter):
            ColumnTransformer(bad).fit(df)


def test_column_transformer_fits_a_level_in_one_job(spark):
    df, _ = frame(spark, [[1, 10, 0], [2, 20, 1], [3, 30, 0]])
    spark.sparkContext.setJobGroup("fit", "fit")
    ColumnTransformer([("a", ["a"], StandardScaler()), ("b", ["b"], MinMaxScaler()), ("c", ["c"], OneHotEncoder())]).fit(df)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("fit")
    spark.sparkContext.setJobGroup("", "")
    assert len(jobs) <= 2  # map and reduce side of one aggregate


def test_predictive_pipeline(spark, tmp_path):
    df, names = frame(spark, [[1, 2], [3, 4]])
    pre = ColumnTransformer([("s", names, StandardScaler())]).fit(df)
    model = PredictivePipeline(pre, LinearModel(pre.output_cols, [1.0, 1.0], 0.0))
    got = [r["prediction"] for r in model.transform(df).orderBy("row_id").collect()]
    assert got == pytest.approx([-2, 2])
    model.save(str(tmp_path / "x.json"))
    again = [r["prediction"] for r in Model.load(str(tmp_path / "x.json")).transform(df).orderBy("row_id").collect()]
    assert again == pytest.approx(got)


def test_errors(spark, tmp_path):
    df, names = frame(spark, [[1, 2]])
    for step in (StandardScaler(), MinMaxScaler(), RobustScaler(), MaxAbsScaler(), Normalizer(), SimpleImputer(), OneHotEncoder(), OrdinalEncoder(), PolynomialFeatures()):
        with pytest.raises(EmptyData):
            step.fit(df.limit(0), names)
        with pytest.raises(FeatureMismatch):
            step.fit(df, ["nope"])
    with pytest.raises(FeatureMismatch):
        StandardScaler().fit(df, names).transform(df.drop("b"))
    with pytest.raises(InvalidParameter):
        MinMaxScaler(1, 1)
    with pytest.raises(InvalidParameter):
        RobustScaler(75, 25)
    (tmp_path / "bad.json").write_text('{"class": "Nope", "values": {}}')
    with pytest.raises(SerializationError):
        Model.load(str(tmp_path / "bad.json"))


def test_fit_does_not_depend_on_partitions(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), F.sin("id").alias("a"), F.cos("id").alias("b"))
    one, many = StandardScaler().fit(df.coalesce(1), ["a", "b"]), StandardScaler().fit(df.repartition(13), ["a", "b"])
    assert one.shift == pytest.approx(many.shift, abs=1e-12) and one.scale == pytest.approx(many.scale, abs=1e-12)


def test_wide_projection(spark):
    df = spark.range(200).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("a"))
    model = OneHotEncoder().fit(df, ["a"])
    assert values(model.transform(df))[150][150] == 1.0 and model.n_features_out == 200


def test_stream(spark, tmp_path):
    from mlframe.streaming.scoring import score_stream

    df = spark.range(50).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("a"))
    df.write.parquet(str(tmp_path / "in"))
    model = MinMaxScaler().fit(df, ["a"])
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    score_stream(stream, model, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 50 and out.agg(F.max("a")).first()[0] == pytest.approx(1.0)
