"""Training of linear models by gradient descent in batches of rows in order.

Three plans give the same iterates: for the squared loss, one aggregation of the batches' moments, folded on the executors, whatever the number of epochs; for other losses with all rows in one batch, one aggregation an epoch; else the steps one after another in a single task, several models side by side.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlframe.errors import EmptyData, InvalidParameter, NumericalError
from mlframe.operators.linear import SGD, LinearModel, Loss, NoRegularizer
from mlframe.plans.fusion import need_columns
from mlframe.plans.workers import let_workers_import
from mlframe.sources.dataset import with_batches

#: Bytes of maps and forms that are folded at a time, in one task or on the driver.
FOLD_BYTES = 128 << 20


def fold(maps: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One affine map for maps in a row, and the sum of quadratic forms of the parameters that each of them meets, as a form of the first ones.

    Parameters are (weights, bias, 1); ``maps`` is (n, d, d), ``forms`` (n, several, d, d). Neighbours are joined pairwise.
    """
    with np.errstate(all="ignore"):
        while len(maps) > 1:
            odd = len(maps) % 2
            first, second = maps[: len(maps) - odd : 2], maps[1::2]
            turned = second @ first
            pulled = np.swapaxes(first, 1, 2)[:, None] @ forms[1::2] @ first[:, None]
            joined = forms[: len(forms) - odd : 2] + pulled
            maps = np.concatenate([turned, maps[-1:]]) if odd else turned
            forms = np.concatenate([joined, forms[-1:]]) if odd else joined
    return maps[0], forms[0]


@dataclass
class Trainer:
    loss: Loss
    optimizer: SGD
    regularizer: object = field(default_factory=NoRegularizer)
    batch_size: int | None = 32  # None: all rows
    epochs: int = 1000
    verbose: bool = False  # prints each epoch's loss
    max_sequential_rows: int = 50_000_000  # for losses other than the squared one in batches, which one task works through

    def __post_init__(self):
        if self.batch_size is not None and self.batch_size < 1:
            raise InvalidParameter("the batch size is below 1")
        if self.epochs < 0:
            raise InvalidParameter("the number of epochs is negative")

    def fit(self, df: DataFrame, features: list[str], label: str, order_by: str | None = None, initial: LinearModel | None = None) -> LinearModel:
        """Fits on rows in the order of ``order_by`` (unique; not needed for one batch). Zero parameters or those of ``initial`` at the start."""
        return self.fit_history(df, features, label, order_by, initial)[0]

    def fit_history(self, df: DataFrame, features: list[str], label: str, order_by: str | None = None, initial: LinearModel | None = None) -> tuple[LinearModel, list[dict]]:
        """The model, and for each epoch: ``loss``, the mean over rows of the loss at the parameters that their batch met, and ``reported``, the sum over batches of mean loss and penalty divided by the number of rows.

        Losses other than the squared one, in batches, have no parallel form: their steps run in one task, and more than ``max_sequential_rows`` rows are an error.
        """
        need_columns(df, [*features, label])
        if self.batch_size is not None and order_by is None:
            raise InvalidParameter("batches need order_by: rows of a DataFrame have no order")
        theta = np.array([*initial.weights, initial.bias], float) if initial else np.zeros(len(features) + 1)
        if self.loss.quadratic:
            theta, losses = self._by_moments(df, features, label, order_by, theta)
        elif self.batch_size is None:
            theta, losses = self._by_epochs(df, features, label, theta)
        else:
            rows = df.select(F.lit(0).alias("model"), F.col(order_by).alias("at"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.col(label).cast("double").alias("y"))
            row = self.fit_groups(rows, theta).first()
            theta, losses = np.array(row["theta"]), list(zip(row["losses"], row["reported"], strict=True))
        if not np.isfinite(theta).all():
            raise NumericalError("training diverged; lower the learning rate or scale the features")
        history = [{"epoch": k, "loss": float(own), "reported": float(said)} for k, (own, said) in enumerate(losses, 1)]
        if self.verbose:
            for h in history:
                print(f"epoch {h['epoch']}: loss {h['loss']:.6g}")
        return LinearModel(list(features), theta[:-1].tolist(), float(theta[-1])), history

    def _by_moments(self, df: DataFrame, features: list[str], label: str, order_by: str | None, theta: np.ndarray) -> tuple[np.ndarray, list]:
        """Every batch's step is an affine map of its moments only, and its loss a quadratic form. Executors fold them, as many at a time as FOLD_BYTES hold, and an epoch is their product, made once."""
        x = [F.col(c).cast("double") for c in features] + [F.lit(1.0), F.col(label).cast("double")]
        d = len(x) - 1
        pairs = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
        moments = [F.sum(x[i] * x[j]).alias(f"m{i}_{j}") for i, j in pairs] + [F.count(F.lit(1)).alias("n")]
        names = [f"m{i}_{j}" for i, j in pairs]
        ridge = np.diag([2.0 * self.regularizer.strength] * (d - 1) + [0.0])
        rate, strength = self.optimizer.rate, self.regularizer.strength
        size = max(2, FOLD_BYTES // (24 * (d + 1) ** 2))

        def maps_of(sums: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            every = np.zeros((len(n), d + 1, d + 1))
            for k, (i, j) in enumerate(pairs):
                every[:, i, j] = every[:, j, i] = sums[:, k] / n
            maps = np.tile(np.eye(d + 1), (len(n), 1, 1))
            maps[:, :d, :d] -= rate * (every[:, :d, :d] + ridge)
            maps[:, :d, d] = rate * every[:, :d, d]
            sign = np.append(np.ones(d), -1.0)  # (score - y)**2 as a form of (weights, bias, 1)
            mean = every * sign[:, None] * sign
            said = mean.copy()
            said[:, range(d - 1), range(d - 1)] += strength
            return maps, np.stack([mean * n[:, None, None], said], axis=1)

        def as_row(chunk: int, made: tuple[np.ndarray, np.ndarray]) -> pa.Table:
            flat = np.concatenate([made[0].ravel(), made[1].ravel()]).tolist()
            return pa.table({"chunk": pa.array([chunk], pa.int64()), "map": pa.array([flat], pa.list_(pa.float64()))})

        def read_rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            flat = np.array(table["map"].to_pylist()).reshape(table.num_rows, 3, d + 1, d + 1)
            return flat[:, 0], flat[:, 1:]

        def made_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            table = table.sort_by("batch_id")
            return fold(*maps_of(np.column_stack([table[c].to_numpy() for c in names]), table["n"].to_numpy()))

        def first_level(group: pa.Table) -> pa.Table:
            return as_row(group["batch_id"][0].as_py() // size, made_of(group))

        def next_level(group: pa.Table) -> pa.Table:
            return as_row(group["chunk"][0].as_py() // size, fold(*read_rows(group.sort_by("chunk"))))

        if self.batch_size is None:
            row = df.agg(*moments).first()
            if not row["n"]:
                raise EmptyData("no rows to fit on")
            made = maps_of(np.array([[row[c] if row[c] is not None else np.nan for c in names]]), np.array([row["n"]]))
            whole, total = fold(*made), row["n"]
        else:
            let_workers_import(df.sparkSession)
            schema = "chunk long, map array<double>"
            batches = with_batches(df, order_by, self.batch_size).groupBy("batch_id").agg(*moments)
            total = df.count()
            if not total:
                raise EmptyData("no rows to fit on")
            groups = -(-total // self.batch_size)
            if groups <= size:  # few enough for the driver as they are
                whole = made_of(batches.toArrow())
            else:
                level = batches.withColumn("g", F.floor(F.col("batch_id") / size)).groupBy("g").applyInArrow(first_level, schema)
                groups = -(-groups // size)
                while groups > size:
                    level = level.withColumn("g", F.floor(F.col("chunk") / size)).groupBy("g").applyInArrow(next_level, schema)
                    groups = -(-groups // size)
                whole = fold(*read_rows(level.toArrow().sort_by("chunk")))
        step, form = whole
        now, losses = np.append(theta, 1.0), []
        with np.errstate(all="ignore"):
            for _ in range(self.epochs):
                losses.append((now @ form[0] @ now / total, now @ form[1] @ now / total))
                now = step @ now
        return now[:-1], losses

    def _by_epochs(self, df: DataFrame, features: list[str], label: str, theta: np.ndarray) -> tuple[np.ndarray, list]:
        """One aggregation an epoch over cached rows. Adaptive execution is off meanwhile: a result of one row has nothing to adapt, and without it an epoch takes half the time."""
        session, adaptive = df.sparkSession, "spark.sql.adaptive.enabled"
        before = session.conf.get(adaptive)
        rows = df.select(*[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(features)], F.col(label).cast("double").alias("y")).persist()
        x, losses = [F.col(f"x{k}") for k in range(len(features))], []
        try:
            session.conf.set(adaptive, "false")
            for _ in range(self.epochs):
                scored = rows.select(*x, "y", LinearModel([], theta[:-1].tolist(), float(theta[-1])).score(x).alias("p")).select(*x, self.loss.slope(F.col("p"), F.col("y")).alias("s"), self.loss.value(F.col("p"), F.col("y")).alias("l"))
                found = scored.agg(F.count(F.lit(1)), F.avg("l"), *[F.avg(F.col("s") * c) for c in x], F.avg("s")).first()
                if not found[0]:
                    raise EmptyData("no rows to fit on")
                losses.append((found[1], (found[1] + self.regularizer.penalty(theta)) / found[0]))
                gradient = np.array(found[2:], float)
                gradient[:-1] += 2.0 * self.regularizer.strength * theta[:-1]
                theta = self.optimizer.step(theta, gradient)
        finally:
            session.conf.set(adaptive, before)
            rows.unpersist()
        return theta, losses

    def fit_groups(self, rows: DataFrame, theta: np.ndarray | None = None) -> DataFrame:
        """Sequential training, one model for each value of ``model``, each in one task: columns model, at (order), x (array), y in; model, theta (weights and bias), loss (that of the last epoch), losses and reported (as :meth:`fit_history` has them, one number an epoch) out."""
        loss, rate, regularizer, size, epochs = self.loss, self.optimizer.rate, self.regularizer, self.batch_size, self.epochs

        def train(group: pa.Table) -> pa.Table:
            group = group.sort_by("at").combine_chunks()
            n = group.num_rows
            x = np.column_stack([group["x"].chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(n, -1), np.ones(n)])
            y = group["y"].to_numpy()
            own = np.zeros(x.shape[1]) if theta is None else theta.copy()
            ridge = np.full(x.shape[1], 2.0 * regularizer.strength)
            ridge[-1] = 0.0
            losses, reported = [], []
            with np.errstate(all="ignore"):
                for _ in range(epochs):
                    whole = said = 0.0
                    for at in range(0, n, size or n):
                        part = slice(at, at + (size or n))
                        score = x[part] @ own
                        values = loss.value_array(score, y[part])
                        whole += float(values.sum())
                        said += float(values.mean()) + regularizer.penalty(own)
                        own = own - rate * (x[part].T @ loss.slope_array(score, y[part]) / len(score) + ridge * own)
                    losses.append(whole / n)
                    reported.append(said / n)
            floats = pa.list_(pa.float64())
            return pa.table({"model": group["model"].slice(0, 1), "theta": pa.array([own.tolist()], floats), "loss": pa.array([losses[-1] if losses else 0.0], pa.float64()), "losses": pa.array([losses], floats), "reported": pa.array([reported], floats)})

        let_workers_import(rows.sparkSession)
        n = rows.count()
        if not n:
            raise EmptyData("no rows to fit on")
        if n > self.max_sequential_rows:
            raise InvalidParameter(f"{n} rows for one task, of which {self.max_sequential_rows} are allowed: train in one batch, on a sample, or with the squared loss")
        kind = rows.schema["model"].dataType.simpleString()
        return rows.select("model", "at", "x", "y").groupBy("model").applyInArrow(train, f"model {kind}, theta array<double>, loss double, losses array<double>, reported array<double>")

    def loss_of(self, model: LinearModel, df: DataFrame, label: str) -> float:
        """Mean loss over all rows plus the penalty."""
        row = df.agg(F.avg(self.loss.value(model.score([F.col(c) for c in model.input_cols]), F.col(label)))).first()
        return (row[0] or 0.0) + self.regularizer.penalty(np.array([*model.weights, model.bias]))


def search_rates(trainer: Trainer, df: DataFrame, features: list[str], label: str, order_by: str, rates: list[float]) -> DataFrame:
    """A model for each learning rate: rate, theta, loss (that of the last epoch). For the squared loss each rate is one aggregation; else they are trained in parallel tasks, and the rows are sent once a rate."""
    if trainer.loss.quadratic:
        found = []
        for rate in rates:
            model, history = dataclasses.replace(trainer, optimizer=SGD(rate)).fit_history(df, features, label, order_by)
            found.append((float(rate), [*model.weights, model.bias], history[-1]["loss"] if history else 0.0))
        return df.sparkSession.createDataFrame(found, "rate double, theta array<double>, loss double")
    parts = []
    for rate in rates:
        rows = df.select(F.lit(float(rate)).alias("model"), F.col(order_by).alias("at"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.col(label).cast("double").alias("y"))
        parts.append(dataclasses.replace(trainer, optimizer=SGD(rate)).fit_groups(rows).select("model", "theta", "loss"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.withColumnRenamed("model", "rate")
