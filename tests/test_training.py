"""Training against a plain loop over rows, losses, metrics, and the handling of datasets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mlframe.errors import EmptyData, FeatureMismatch, InvalidParameter, NumericalError
from mlframe.functions import exprs as X
from mlframe.operators import tensor
from mlframe.operators.linear import L2, SGD, BCEWithLogitsLoss, LinearModel, MAELoss, MSELoss, NoRegularizer
from mlframe.operators.metrics import evaluate_classification, evaluate_regression, timing_summary
from mlframe.operators.trainer import Trainer, search_rates
from mlframe.sources.dataset import batches, from_rows, get_batch, read_csv, select_features, split, split3, with_batches, with_row_ids

SLOPES = {
    MSELoss: lambda p, t: p - t,
    MAELoss: lambda p, t: np.sign(p - t),
    BCEWithLogitsLoss: lambda p, t: 1 / (1 + np.exp(-p)) - t,
}


def by_hand(x, y, loss, rate, size, epochs, ridge=0.0):
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(epochs):
        for at in range(0, len(y), size or len(y)):
            part = slice(at, at + (size or len(y)))
            slope = SLOPES[loss](x[part] @ w + b, y[part]) / len(y[part])
            w, b = w - rate * (x[part].T @ slope + 2 * ridge * w), b - rate * slope.sum()
    return w, b


@pytest.mark.parametrize("loss", [MSELoss, MAELoss, BCEWithLogitsLoss])
@pytest.mark.parametrize("size", [None, 7])
@pytest.mark.parametrize("ridge", [0.0, 0.1])
def test_same_iterates_as_a_plain_loop(spark, loss, size, ridge):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 2))
    y = (x @ [1, -2] + 0.5 > 0).astype(float) if loss is BCEWithLogitsLoss else x @ [1, -2] + 0.5 + rng.normal(size=40) * 0.1
    df = from_rows(spark, x.tolist(), y.tolist()).repartition(3)
    model = Trainer(loss(), SGD(0.1), L2(ridge) if ridge else NoRegularizer(), size, 4).fit(df, ["f0", "f1"], "label", "row_id")
    w, b = by_hand(x, y, loss, 0.1, size, 4, ridge)
    assert model.weights == pytest.approx(w.tolist(), abs=1e-9) and model.bias == pytest.approx(b, abs=1e-9)


def test_known_fits(spark):
    df = from_rows(spark, [[1, 0], [0, 1], [1, 1], [2, 3]], [3, 4, 6, 14])
    model = Trainer(MSELoss(), SGD(0.1), batch_size=4, epochs=100).fit(df, ["f0", "f1"], "label", "row_id")
    assert [*model.weights, model.bias] == pytest.approx([1.978641, 3.001579, 1.025741], abs=1e-5)
    line = from_rows(spark, [[1], [2], [3]], [2, 4, 6])
    model = Trainer(MSELoss(), SGD(0.01), L2(1.0), 3, 500).fit(line, ["f0"], "label", "row_id")
    assert [*model.weights, model.bias] == pytest.approx([0.631492, 2.585706], abs=1e-5)


def test_warm_start_divergence_and_settings(spark):
    df = from_rows(spark, [[1.0], [2.0]], [1, 2])
    half = Trainer(MSELoss(), SGD(0.1), batch_size=None, epochs=3).fit(df, ["f0"], "label")
    whole = Trainer(MSELoss(), SGD(0.1), batch_size=None, epochs=3).fit(df, ["f0"], "label", initial=half)
    assert whole.weights == pytest.approx(Trainer(MSELoss(), SGD(0.1), batch_size=None, epochs=6).fit(df, ["f0"], "label").weights)
    with pytest.raises(NumericalError):
        Trainer(MSELoss(), SGD(1e6), batch_size=None, epochs=200).fit(df, ["f0"], "label")
    for wrong in ({"batch_size": 0}, {"epochs": -1}):
        with pytest.raises(InvalidParameter):
            Trainer(MSELoss(), SGD(0.1), **wrong)
    with pytest.raises(InvalidParameter):
        Trainer(MSELoss(), SGD(0.1)).fit(df, ["f0"], "label")
    with pytest.raises(EmptyData):
        Trainer(MSELoss(), SGD(0.1), batch_size=None).fit(df.limit(0), ["f0"], "label")


def test_rates_in_parallel(spark):
    df = from_rows(spark, [[1.0], [2.0], [3.0]], [1, 2, 3])
    found = {r["rate"]: r for r in search_rates(Trainer(MAELoss(), SGD(0), batch_size=2, epochs=5), df, ["f0"], "label", "row_id", [0.01, 0.1]).collect()}
    for rate, row in found.items():
        one = Trainer(MAELoss(), SGD(rate), batch_size=2, epochs=5).fit(df, ["f0"], "label", "row_id")
        assert row["theta"] == pytest.approx([*one.weights, one.bias])


def test_losses(spark):
    df = spark.createDataFrame([(3.0, 1.0), (5.0, 2.0)], "p double, t double")
    assert df.agg(F.avg(MSELoss().value(F.col("p"), F.col("t")))).first()[0] == 6.5
    bce = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0), (-2.0, 0.0)], "p double, t double")
    assert bce.agg(F.avg(BCEWithLogitsLoss().value(F.col("p"), F.col("t")))).first()[0] == pytest.approx(0.315668, abs=1e-5)
    big = spark.createDataFrame([(1000.0, 1.0), (-1000.0, 0.0)], "p double, t double")
    assert all(np.isfinite(r[0]) and np.isfinite(r[1]) for r in big.select(BCEWithLogitsLoss().value(F.col("p"), F.col("t")), BCEWithLogitsLoss().slope(F.col("p"), F.col("t"))).collect())
    assert L2(0.5).penalty(np.array([3.0, 4.0, 1.0])) == 12.5


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.5), (3.0, 3.0)], "label double, prediction double")
    row = evaluate_regression(df).first()
    assert row["mse"] == pytest.approx(0.25 / 3) and row["mae"] == pytest.approx(0.5 / 3) and row["r2"] == pytest.approx(1 - 0.25 / 2)
    assert evaluate_regression(df.limit(0)).first().asDict() == {"mse": 0, "rmse": 0, "mae": 0, "r2": 0}
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "label double, prediction double")
    assert evaluate_regression(flat).first()["r2"] == 0
    assert evaluate_regression(flat.limit(1)).first()["r2"] == 1
    c = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "label int, predicted int")
    assert evaluate_classification(c).first().asDict() == {"accuracy": 0.5, "precision": 0.5, "recall": 0.5, "f1": 0.5}
    assert evaluate_classification(c.limit(0)).first()["f1"] == 0
    times = timing_summary(spark.range(1, 101).select(F.col("id").cast("double").alias("t")), "t").first()
    assert (times["median"], times["p95"], times["p99"]) == (51, 96, 100)


def test_datasets(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5)
    got = with_row_ids(df, "k")
    assert got.where("k <> row_id").count() == 0 and got.count() == 1000
    assert [r[1] for r in with_batches(df, "k", 300).groupBy("batch_id").count().orderBy("batch_id").collect()] == [300, 300, 300, 100]
    assert sorted(r["k"] for r in get_batch(got, 3, 6).collect()) == [3, 4, 5]
    assert [b.count() for b in batches(got.where("row_id < 3"), 2)] == [2, 1]
    assert [p.count() for p in split(got, 0.333)] == [333, 667]
    assert [p.count() for p in split3(got, 0.5, 0.2)] == [500, 200, 300]
    small = from_rows(spark, [[1, 2]], [3])
    assert select_features(small.select("f0", "f1"), [1, 9], []).first()[1] == 0.0
    (tmp_path / "x.csv").write_text("a,b\n1,2\nx,3\n")
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "x.csv"), ["a", "b"]).collect()] == [(1.0, 2.0), (0.0, 3.0)]
    for rows, target, error in (([], [], EmptyData), ([[1]], [1, 2], FeatureMismatch), ([[1], [1, 2]], [1, 2], FeatureMismatch)):
        with pytest.raises(error):
            from_rows(spark, rows, target)


def test_ieee(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (nan, 2.0), (6.0, 3.0)], "a double, b double")
    shown = lambda rows: [str(r[0]) for r in rows]
    assert shown(df.select(X.ieee_div("a", "b")).collect()) == ["inf", "-inf", "nan", "nan", "2.0"]
    assert [r[0] for r in df.select(X.sign("a")).collect()] == [1, -1, 0, 0, 1]
    assert [r[0] for r in df.select(X.maximum("a", "b")).collect()] == [1, 0, 0, 2, 6]
    assert shown(df.select(X.ieee_ln("b")).collect())[:1] == [str(-inf)]
    assert [r[0] for r in df.where("not isnan(a)").select(X.sigmoid(F.col("a") * 1000)).collect()][:2] == [1.0, 0.0]


def test_tensor_errors(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    with pytest.raises(Exception, match="degrees of freedom"):
        df.agg(tensor.col_std("a", 1)).collect()
    with pytest.raises(Exception, match="empty matrix"):
        df.limit(0).agg(tensor.mean_all(["a", "b"])).collect()
    assert df.limit(0).agg(tensor.mean_all(["a"]), tensor.sum_all(["a"]), tensor.col_min("a")).first()[:] == (0.0, 0.0, float("inf"))
    with pytest.raises(InvalidParameter):
        tensor.select_columns(df, [2])
    with pytest.raises(InvalidParameter):
        tensor.hcat(df, [])
    with pytest.raises(Exception, match="out of range"):
        df.select(*tensor.one_hot_indices(F.lit(5.0), 2)).collect()


def test_model_on_other_columns(spark):
    with pytest.raises(FeatureMismatch):
        LinearModel(["nope"], [1.0], 0.0).transform(spark.range(1))


def test_quantiles_against_sorting(spark, monkeypatch):
    from mlframe.plans import selection
    from mlframe.plans.selection import MostFrequent, Quantiles, most_frequent, quantiles

    rng = np.random.default_rng(6)
    monkeypatch.setattr(selection, "PARTS", 16)  # several rounds on small data
    columns = {
        "even": rng.random(3000), "steep": np.exp(30 * rng.random(3000)), "few": rng.integers(0, 3, 3000).astype(float), "same": np.full(3000, 7.0),
        "wide": np.concatenate([[-1.7e308, 1.7e308, np.inf, -np.inf, np.inf], rng.normal(size=2995)]), "holes": np.where(rng.random(3000) < 0.3, np.nan, rng.normal(size=3000)),
    }
    names = list(columns)
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in zip(*columns.values(), strict=True)], ", ".join(f"{n} double" for n in names))
    shares = [0.0, 0.01, 0.25, 0.5, 0.7501, 0.99, 1.0]
    got = quantiles(df, [Quantiles(F.col(n), shares) for n in names])
    for n, found in zip(names, got, strict=True):
        v = np.sort(columns[n][~np.isnan(columns[n])])
        for share, x in zip(shares, found, strict=True):
            at = share * (len(v) - 1)
            a, b, part = v[int(np.floor(at))], v[int(np.ceil(at))], at - np.floor(at)
            assert x == (a if a == b else pytest.approx((1 - part) * a + part * b, rel=1e-12))
    members = quantiles(df, [Quantiles(F.col("even"), [0.5, 0.99, 1.0], member=True)])[0]
    v = np.sort(columns["even"])
    assert members == [v[1500], v[2970], v[2999]]
    assert quantiles(df.limit(0), [Quantiles(F.col("even"), [0.5])]) == [None] and most_frequent(df.limit(0), [MostFrequent(F.col("even"))]) == [None]
    counts = np.bincount(columns["few"].astype(int))
    assert most_frequent(df, [MostFrequent(F.col("same")), MostFrequent(F.col("few")), MostFrequent(F.lit(None).cast("double"))]) == [7.0, float(counts.argmax()), None]


def test_folding_equals_steps_one_by_one(spark, monkeypatch):
    from mlframe.operators import trainer

    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(157, 2)), rng.normal(size=157)
    df = from_rows(spark, x.tolist(), y.tolist())
    monkeypatch.setattr(trainer, "FOLD_BYTES", 24 * 16 * 3)  # three maps at a time, so several levels
    for ridge in (NoRegularizer(), L2(0.02)):
        model, history = Trainer(MSELoss(), SGD(0.05), ridge, batch_size=4, epochs=3).fit_history(df, ["f0", "f1"], "label", "row_id")
        theta, losses = np.zeros(3), []
        for _ in range(3):
            own = said = 0.0
            for at in range(0, 157, 4):
                a, b = np.column_stack([x[at : at + 4], np.ones(len(x[at : at + 4]))]), y[at : at + 4]
                error = a @ theta - b
                own += (error**2).sum()
                said += (error**2).mean() + ridge.penalty(theta)
                theta = theta - 0.05 * (a.T @ error / len(b) + 2 * ridge.strength * np.append(theta[:2], 0))
            losses.append((own / 157, said / 157))
        assert [*model.weights, model.bias] == pytest.approx(theta.tolist())
        assert [(h["loss"], h["reported"]) for h in history] == [pytest.approx(v) for v in losses]
    one = Trainer(MAELoss(), SGD(0.05), batch_size=4, epochs=2, verbose=True)
    assert len(one.fit_history(df, ["f0", "f1"], "label", "row_id")[1]) == 2
    with pytest.raises(InvalidParameter):
        Trainer(MAELoss(), SGD(0.05), batch_size=4, epochs=2, max_sequential_rows=100).fit(df, ["f0", "f1"], "label", "row_id")


def test_row_ids_with_many_ranges_and_bad_keys(spark):
    df = spark.range(5000).select((F.pow(F.col("id"), 2) - 1e6).alias("k"), F.col("id")).repartition(7)
    for ranges in (1, 3, 700):
        assert with_row_ids(df, "k", ranges=ranges).where("id <> row_id").count() == 0
    for bad in (df.withColumn("k", F.when(F.col("id") != 9, F.col("k"))), df.withColumn("k", F.floor(F.col("k") / 1e5))):
        with pytest.raises(Exception, match="key in k"):
            with_row_ids(bad, "k").count()
            with_row_ids(bad, "k").agg(F.sum("row_id")).collect()
    assert with_row_ids(df.limit(0), "k").count() == 0


def test_too_many_categories(spark, monkeypatch):
    from mlframe.operators import encoding

    monkeypatch.setattr(encoding, "MAX_CATEGORIES", 3)
    with pytest.raises(InvalidParameter):
        encoding.OneHotEncoder().fit(spark.range(9).select(F.col("id").cast("double").alias("a")), ["a"])
