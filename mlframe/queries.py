"""One query for each operator, over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mlframe.errors import MlframeError
from mlframe.functions import exprs as X
from mlframe.operators import tensor
from mlframe.operators.base import Model, Step
from mlframe.operators.compose import ColumnTransformer, Pipeline, PipelineModel, PredictivePipeline
from mlframe.operators.encoding import LabelEncoder, OneHotEncoder, OrdinalEncoder
from mlframe.operators.imputation import SimpleImputer
from mlframe.operators.linear import L2, SGD, BCEWithLogitsLoss, LinearModel, MAELoss, MSELoss
from mlframe.operators.metrics import classification_metrics, regression_metrics, timing_summary
from mlframe.operators.polynomial import PolynomialFeatures
from mlframe.operators.scaling import MaxAbsScaler, MinMaxScaler, Normalizer, RobustScaler, StandardScaler, normalize_array
from mlframe.operators.trainer import Trainer, search_rates
from mlframe.sources.dataset import from_rows, get_batch, read_csv, select_features, split, split3, to_rows, with_batches, with_row_ids, write_report

FEATURES = ["l_quantity", "l_discount", "l_tax"]
KEYS = ["l_orderkey", "l_linenumber"]


@dataclass
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places, zero without a sign: sums of doubles depend on their order in the last bits."""
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def line(spark: SparkSession, d: str) -> DataFrame:
    """lineitem's numeric columns as doubles."""
    return table(spark, d, "lineitem").select(*KEYS, *[F.col(c).cast("double").alias(c) for c in [*FEATURES, "l_extendedprice"]], "l_returnflag")


def holes(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with missing discounts (as NULL) and taxes (as NaN)."""
    return line(spark, d).withColumn("l_discount", F.when(F.round("l_discount", 2) != 0.05, F.col("l_discount"))).withColumn("l_tax", F.when(F.round("l_tax", 2) == 0.03, F.lit(float("nan"))).otherwise(F.col("l_tax")))


HOLES = "h AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS l_quantity, CASE WHEN round(l_discount, 2) <> 0.05 THEN CAST(l_discount AS DOUBLE) END AS l_discount, CASE WHEN round(l_tax, 2) <> 0.03 THEN CAST(l_tax AS DOUBLE) END AS l_tax FROM lineitem)"


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"


def one_row(spark: SparkSession, values: dict) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def params(spark: SparkSession, model: LinearModel, digits: int = 6) -> DataFrame:
    return rounded(one_row(spark, {f"w{k}": float(w) for k, w in enumerate(model.weights)} | {"bias": float(model.bias)}), digits)


SCALERS = {
    "standard": (StandardScaler, "avg({c})", "stddev_pop({c})", "({c} - a_{c}) / b_{c}"),
    "robust": (RobustScaler, "(quantile_cont({c}, 0.25) + quantile_cont({c}, 0.75)) / 2", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)", "({c} - a_{c}) / b_{c}"),
    "minmax": (MinMaxScaler, "min({c})", "max({c}) - min({c})", "({c} - a_{c}) / b_{c}"),
}


def scaler_sql(a: str, b: str, out: str) -> tuple[str, str]:
    """SQL of the fitted numbers and of the transformed rows."""
    stats = ", ".join(f"{a.format(c=c)} AS a_{c}, {b.format(c=c)} AS b_{c}" for c in FEATURES)
    fit = f"WITH s AS (SELECT {stats} FROM lineitem) SELECT {', '.join(r(f'{k}_{c}', f'{k}_{c}') for c in FEATURES for k in 'ab')} FROM s"
    rows = f"WITH s AS (SELECT {stats} FROM lineitem) SELECT l_orderkey, l_linenumber, {', '.join(r(out.format(c=c), c) for c in FEATURES)} FROM lineitem, s"
    return fit, rows


def scaler_queries() -> dict[str, Query]:
    out = {}
    for name, (make, a, b, formula) in SCALERS.items():
        fit_sql, rows_sql = scaler_sql(a, b, formula)

        def fit(spark, d, make=make, name=name):
            m = make().fit(line(spark, d), FEATURES)
            shift, scale = m.shift, (m.info["range"] if name == "minmax" else m.scale)
            return rounded(one_row(spark, {f"{k}_{c}": float(v) for c, s, f in zip(FEATURES, shift, scale, strict=True) for k, v in (("a", s), ("b", f))}))

        out[f"{name}_scaler_fit"] = Query(fit, fit_sql)
        out[f"{name}_scaler_transform"] = Query(lambda spark, d, make=make: rounded(make().fit_transform(line(spark, d), FEATURES, KEYS)), rows_sql)
        back = lambda spark, d, make=make: rounded((m := make().fit(line(spark, d), FEATURES)).inverse_transform(m.transform(line(spark, d)), KEYS))
        out[f"{name}_scaler_inverse"] = Query(back, f"SELECT l_orderkey, l_linenumber, {', '.join(r(f'CAST({c} AS DOUBLE)', c) for c in FEATURES)} FROM lineitem")
    out["minmax_custom_range"] = Query(lambda s, d: rounded(MinMaxScaler(-1, 3).fit_transform(line(s, d), FEATURES, KEYS)), scaler_sql("min({c})", "max({c}) - min({c})", "({c} - a_{c}) * (4 / b_{c}) - 1")[1])
    constant = lambda s, d: table(s, d, "part").select("p_partkey", F.lit(5.0).alias("x"), F.col("p_size").cast("double").alias("y"))
    out["minmax_constant"] = Query(lambda s, d: rounded(MinMaxScaler().fit_transform(constant(s, d), ["x", "y"])), "SELECT p_partkey, 0.0 AS x, round((p_size - (SELECT min(p_size) FROM part)) / CAST((SELECT max(p_size) - min(p_size) FROM part) AS DOUBLE), 6) AS y FROM part")
    out["standard_constant"] = Query(lambda s, d: rounded(StandardScaler().fit_transform(constant(s, d), ["x", "y"])), "SELECT p_partkey, 0.0 AS x, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part), 6) + 0.0 AS y FROM part")
    out["robust_quantile_10_90"] = Query(lambda s, d: rounded(RobustScaler(10, 90).fit_transform(line(s, d), FEATURES, KEYS)), scaler_sql("(quantile_cont({c}, 0.1) + quantile_cont({c}, 0.9)) / 2", "quantile_cont({c}, 0.9) - quantile_cont({c}, 0.1)", "({c} - a_{c}) / b_{c}")[1])
    balance = lambda s, d: table(s, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    out["maxabs_fit"] = Query(lambda s, d: one_row(s, {"max_abs": MaxAbsScaler().fit(balance(s, d), ["c_acctbal"]).info["max_abs"][0]}), "SELECT CAST(max(abs(c_acctbal)) AS DOUBLE) AS max_abs FROM customer")
    out["maxabs_transform"] = Query(lambda s, d: rounded(MaxAbsScaler().fit_transform(balance(s, d), ["c_acctbal"])), "SELECT c_custkey, round(c_acctbal / (SELECT max(abs(c_acctbal)) FROM customer), 6) + 0.0 AS c_acctbal FROM customer")
    norms = {"l1": "abs(l_quantity) + abs(l_discount) + abs(l_tax)", "l2": "sqrt(l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax)", "max": "greatest(abs(l_quantity), abs(l_discount), abs(l_tax))"}
    for norm, sql in norms.items():
        out[f"normalizer_{norm}"] = Query(lambda s, d, norm=norm: rounded(Normalizer(norm).fit_transform(line(s, d), FEATURES, KEYS)), f"SELECT l_orderkey, l_linenumber, {', '.join(r(f'CASE WHEN ({sql}) = 0 THEN {c} ELSE {c} / ({sql}) END', c) for c in FEATURES)} FROM lineitem")
    out["normalizer_embedding_l2"] = Query(
        lambda s, d: rounded(table(s, d, "embeddings").select("vec_id", normalize_array(F.col("embedding")).alias("v")).select("vec_id", F.col("v")[0].alias("first"), F.col("v")[63].alias("last"), X.array_sum("v").alias("total"))),
        "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM e) SELECT vec_id, round(e[1] / n, 6) + 0.0 AS first, round(e[64] / n, 6) + 0.0 AS last, round(list_sum(e) / n, 6) + 0.0 AS total FROM n",
    )
    return out


def imputer_queries() -> dict[str, Query]:
    statistic = {
        "mean": "avg({c})",
        "median": "quantile_cont({c}, 0.5)",
        "most_frequent": "(SELECT {c} FROM h WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)",
        "constant": "-1.0",
    }
    out = {}
    for strategy, sql in statistic.items():
        of = lambda c, sql=sql: sql.format(c=c) if sql[0] in "(-" else f"(SELECT {sql.format(c=c)} FROM h)"
        out[f"impute_{strategy}"] = Query(
            lambda s, d, strategy=strategy: rounded(SimpleImputer(strategy, -1.0).fit_transform(holes(s, d), FEATURES, KEYS)),
            f"WITH {HOLES} SELECT l_orderkey, l_linenumber, {', '.join(r(f'coalesce({c}, {of(c)})', c) for c in FEATURES)} FROM h",
        )
    nothing = lambda s, d: table(s, d, "part").select("p_partkey", F.lit(None).cast("double").alias("x"), F.lit(float("nan")).alias("y"))
    out["impute_all_missing"] = Query(lambda s, d: SimpleImputer("constant", -1.0).fit_transform(nothing(s, d), ["x", "y"]), "SELECT p_partkey, 0.0 AS x, 0.0 AS y FROM part")
    error = lambda s, d: table(s, d, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("value").cast("double")).alias("value"))
    out["impute_events_mean"] = Query(lambda s, d: rounded(SimpleImputer("mean").fit_transform(error(s, d), ["value"])), "WITH e AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(value AS DOUBLE) END AS value FROM events) SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM e)), 6) + 0.0 AS value FROM e")
    return out


def encoder_queries() -> dict[str, Query]:
    part = lambda s, d: table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"))
    flags = lambda s, d: line(s, d).select(*KEYS, F.ascii("l_returnflag").cast("double").alias("flag"), F.col("l_linenumber").cast("double").alias("number"))
    low = lambda s, d: part(s, d).where("p_size <= 25")
    nations = lambda s, d: table(s, d, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("nation"))
    back = lambda s, d: (m := OneHotEncoder().fit(flags(s, d), ["flag", "number"])).inverse_transform(m.transform(flags(s, d)), KEYS)
    tens = ", ".join(f"CASE WHEN p_size = {k} THEN 1.0 ELSE 0.0 END AS p_size_{k}" for k in range(1, 51))
    few = ", ".join(f"CASE WHEN p_size = {k} THEN 1.0 ELSE 0.0 END AS p_size_{k}" for k in range(1, 26))
    fit = lambda s, d: one_row(s, {"n": sum(m.n_values), "first": m.categories[0][0], "last": m.categories[1][-1]}) if (m := OneHotEncoder().fit(flags(s, d), ["flag", "number"])) else None
    order_fit = lambda s, d: s.createDataFrame([(int(k), int(v)) for k, v in OrdinalEncoder().fit(part(s, d), ["p_size"]).mapping(0).items()], "category long, place long")
    inverse = lambda s, d: (m := OrdinalEncoder().fit(nations(s, d), ["nation"])).inverse_transform(m.transform(nations(s, d)))
    target = lambda s, d: line(s, d).select(*KEYS, F.ascii("l_returnflag").cast("double").alias("label"))
    decode = lambda s, d: (m := LabelEncoder().fit(target(s, d), "label")).inverse_transform(m.transform(target(s, d)))
    return {
        "onehot_fit": Query(fit, "SELECT CAST(count(DISTINCT l_returnflag) + count(DISTINCT l_linenumber) AS INTEGER) AS n, CAST(min(ascii(l_returnflag)) AS INTEGER) AS first, CAST(max(l_linenumber) AS INTEGER) AS last FROM lineitem"),
        "onehot_transform": Query(lambda s, d: OneHotEncoder().fit_transform(part(s, d), ["p_size"]), f"SELECT p_partkey, {tens} FROM part"),
        "onehot_ignore": Query(lambda s, d: OneHotEncoder("ignore").fit(low(s, d), ["p_size"]).transform(part(s, d)), f"SELECT p_partkey, {few} FROM part"),
        "onehot_inverse": Query(back, "SELECT l_orderkey, l_linenumber, CAST(ascii(l_returnflag) AS DOUBLE) AS flag, CAST(l_linenumber AS DOUBLE) AS number FROM lineitem"),
        "ordinal_fit": Query(order_fit, "SELECT CAST(p_size AS BIGINT) AS category, row_number() OVER (ORDER BY p_size) - 1 AS place FROM (SELECT DISTINCT p_size FROM part)"),
        "ordinal_transform": Query(lambda s, d: OrdinalEncoder().fit_transform(part(s, d), ["p_size"]), "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_size) - 1 AS DOUBLE) AS p_size FROM part"),
        "ordinal_ignore": Query(lambda s, d: OrdinalEncoder("ignore").fit(low(s, d), ["p_size"]).transform(part(s, d)).select("p_partkey", F.nanvl("p_size", F.lit(-1.0)).alias("p_size")), "SELECT p_partkey, CASE WHEN p_size <= 25 THEN CAST(dense_rank() OVER (ORDER BY p_size) - 1 AS DOUBLE) ELSE -1.0 END AS p_size FROM part"),
        "ordinal_inverse": Query(inverse, "SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS nation FROM customer"),
        "label_encode": Query(lambda s, d: LabelEncoder().fit(target(s, d), "label").transform(target(s, d)), "SELECT l_orderkey, l_linenumber, CAST(dense_rank() OVER (ORDER BY ascii(l_returnflag)) - 1 AS DOUBLE) AS label FROM lineitem"),
        "label_decode": Query(decode, "SELECT l_orderkey, l_linenumber, CAST(ascii(l_returnflag) AS DOUBLE) AS label FROM lineitem"),
    }


def polynomial_queries() -> dict[str, Query]:
    q, t, x = "CAST(l_quantity AS DOUBLE)", "CAST(l_discount AS DOUBLE)", "CAST(l_tax AS DOUBLE)"
    name = lambda df: df.toDF(*KEYS, *[f"p{k}" for k in range(len(df.columns) - 2)])

    def sql(terms: list[str]) -> str:
        return f"SELECT l_orderkey, l_linenumber, {', '.join(r(e, f'p{k}') for k, e in enumerate(terms))} FROM lineitem"

    two = [q, t]
    deg3 = ["1.0", *two, *[f"{a} * {b}" for a, b in ((q, q), (q, t), (t, t))], *[f"{a} * {b} * {c}" for a, b, c in ((q, q, q), (q, q, t), (q, t, t), (t, t, t))]]
    return {
        "poly_deg2": Query(lambda s, d: rounded(name(PolynomialFeatures(2, False).fit_transform(line(s, d), FEATURES, KEYS))), sql([q, t, x, f"{q} * {q}", f"{q} * {t}", f"{q} * {x}", f"{t} * {t}", f"{t} * {x}", f"{x} * {x}"])),
        "poly_interaction": Query(lambda s, d: rounded(name(PolynomialFeatures(2, False, True).fit_transform(line(s, d), FEATURES, KEYS))), sql([q, t, x, f"{q} * {t}", f"{q} * {x}", f"{t} * {x}"])),
        "poly_deg3_bias": Query(lambda s, d: rounded(name(PolynomialFeatures(3).fit_transform(line(s, d), FEATURES[:2], KEYS))), sql(deg3)),
    }


def compose_queries() -> dict[str, Query]:
    steps = lambda: Pipeline([("impute", SimpleImputer("mean")), ("scale", StandardScaler())])
    inverse = lambda s, d: rounded((m := Pipeline([("standard", StandardScaler()), ("minmax", MinMaxScaler())]).fit(line(s, d), FEATURES)).inverse_transform(m.transform(line(s, d)), KEYS))
    filled = ", ".join(f"coalesce({c}, (SELECT avg({c}) FROM h)) AS {c}" for c in FEATURES)
    scaled = lambda c: f"({c} - (SELECT avg({c}) FROM i)) / (SELECT stddev_pop({c}) FROM i)"
    mixed = lambda: ColumnTransformer([("num", FEATURES, steps()), ("cat", ["l_linenumber"], OneHotEncoder())])
    lines = ", ".join(f"CASE WHEN l_linenumber = {k} THEN 1.0 ELSE 0.0 END AS cat__l_linenumber_{k}" for k in range(1, 8))
    numbered = lambda s, d: holes(s, d).withColumn("key", F.col("l_linenumber")).withColumn("l_linenumber", F.col("l_linenumber").cast("double"))
    twice = lambda: ColumnTransformer([("a", ["l_quantity"], StandardScaler()), ("b", ["l_quantity"], MinMaxScaler())])

    def predictive(s, d):
        rows = numbered(s, d)
        pre = ColumnTransformer([("num", FEATURES, steps())]).fit(rows)
        poly = PolynomialFeatures(2, False, True).model(pre.output_cols, {})
        return rounded(PredictivePipeline(pre, LinearModel(poly.output_cols, [1.0, -2.0, 0.5, 0.25, 0.0, 3.0], 7.0), poly).transform(rows, KEYS[:1] + ["key"]))

    z = {c: scaled(c) for c in FEATURES}
    formula = f"{z['l_quantity']} - 2 * ({z['l_discount']}) + 0.5 * ({z['l_tax']}) + 0.25 * ({z['l_quantity']}) * ({z['l_discount']}) + 3 * ({z['l_discount']}) * ({z['l_tax']}) + 7"
    filled_cte = f"WITH {HOLES}, i AS (SELECT l_orderkey, l_linenumber, {filled} FROM h)"
    return {
        "pipeline_impute_scale": Query(lambda s, d: rounded(steps().fit(holes(s, d), FEATURES).transform(holes(s, d), KEYS)), f"{filled_cte} SELECT l_orderkey, l_linenumber, {', '.join(r(z[c], c) for c in FEATURES)} FROM i"),
        "pipeline_inverse": Query(inverse, f"SELECT l_orderkey, l_linenumber, {', '.join(r(f'CAST({c} AS DOUBLE)', c) for c in FEATURES)} FROM lineitem"),
        "column_transformer_mixed": Query(lambda s, d: rounded(mixed().fit(numbered(s, d)).transform(numbered(s, d), ["l_orderkey", "key"])), f"{filled_cte} SELECT l_orderkey, l_linenumber AS key, {', '.join(r(z[c], f'num__{c}') for c in FEATURES)}, {lines} FROM i"),
        "column_transformer_duplicate": Query(lambda s, d: rounded(twice().fit(line(s, d)).transform(line(s, d), KEYS)), "WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS v, min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, round((l_quantity - m) / v, 6) + 0.0 AS a__l_quantity, round((l_quantity - a) / CAST(b - a AS DOUBLE), 6) + 0.0 AS b__l_quantity FROM lineitem, s"),
        "predictive_pipeline": Query(predictive, f"{filled_cte} SELECT l_orderkey, l_linenumber AS key, {r(formula, 'prediction')} FROM i"),
    }


def train_rows(s: SparkSession, d: str) -> DataFrame:
    """lineitem with features near 1 and the price in thousands."""
    return line(s, d).select(*KEYS, (F.col("l_quantity") / 50).alias("x0"), (F.col("l_discount") * 10).alias("x1"), (F.col("l_extendedprice") / 10000).alias("y"))


TRAIN = "t AS (SELECT CAST(l_quantity AS DOUBLE) / 50 AS x0, CAST(l_discount AS DOUBLE) * 10 AS x1, CAST(l_extendedprice AS DOUBLE) / 10000 AS y FROM lineitem)"


def order_rows(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", (F.pmod(F.col("o_custkey"), F.lit(97)) / 97.0).alias("x0"), (F.col("o_totalprice").cast("double") / 100000).alias("y"))


def descent_sql(slope: str, epochs: int, rate: float, ridge: float = 0.0, data: str = TRAIN) -> str:
    """Full-batch descent as a recursion of one aggregate an epoch."""
    return f"""WITH RECURSIVE {data}, g AS (
  SELECT 0 AS e, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS b
  UNION ALL
  SELECT e + 1, any_value(w0) - {rate} * (avg(s * x0) + 2 * {ridge} * any_value(w0)), any_value(w1) - {rate} * (avg(s * x1) + 2 * {ridge} * any_value(w1)), any_value(b) - {rate} * avg(s)
  FROM (SELECT e, w0, w1, b, x0, x1, {slope} AS s FROM g, t WHERE e < {epochs}) GROUP BY e
) SELECT round(w0, 6) + 0.0 AS w0, round(w1, 6) + 0.0 AS w1, round(b, 6) + 0.0 AS bias FROM g WHERE e = {epochs}"""


LOGISTIC = "t AS (SELECT CAST(l_quantity AS DOUBLE) / 50 AS x0, CAST(l_discount AS DOUBLE) * 10 AS x1, CASE WHEN l_extendedprice > 25000 THEN 1.0 ELSE 0.0 END AS y FROM lineitem)"
#: Orders of the mini-batch query in its order, and batches of 512.
MINI = """WITH RECURSIVE o AS (SELECT (o_custkey % 97) / 97.0::DOUBLE AS x, CAST(o_totalprice AS DOUBLE) / 100000 AS y, (row_number() OVER (ORDER BY o_orderkey) - 1) // 512 AS k FROM orders),
m AS (SELECT k, avg(x * x) AS xx, avg(x) AS sx, avg(x * y) AS xy, avg(y) AS sy FROM o GROUP BY k), n AS (SELECT count(*) AS n FROM m), g AS (
  SELECT 0::BIGINT AS i, 0.0::DOUBLE AS w, 0.0::DOUBLE AS b
  UNION ALL
  SELECT i + 1, w - 0.1 * (xx * w + sx * b - xy), b - 0.1 * (sx * w + b - sy) FROM g, n, m WHERE i < 3 * n.n AND m.k = i % n.n
) SELECT round(w, 6) + 0.0 AS w0, round(b, 6) + 0.0 AS bias FROM g, n WHERE i = 3 * n.n"""
MINI_MAE = """WITH RECURSIVE o AS (SELECT (o_custkey % 97) / 97.0::DOUBLE AS x, CAST(o_totalprice AS DOUBLE) / 100000 AS y, (row_number() OVER (ORDER BY o_orderkey) - 1) // 512 AS k FROM orders),
n AS (SELECT max(k) + 1 AS n FROM o), g AS (
  SELECT 0::BIGINT AS i, 0.0::DOUBLE AS w, 0.0::DOUBLE AS b
  UNION ALL
  SELECT i + 1, any_value(w) - 0.1 * avg(s * x), any_value(b) - 0.1 * avg(s) FROM (SELECT i, w, b, x, sign(w * x + b - y) AS s FROM g, n, o WHERE i < 2 * n.n AND o.k = i % n.n) GROUP BY i
) SELECT round(w, 6) + 0.0 AS w0, round(b, 6) + 0.0 AS bias FROM g, n WHERE i = 2 * n.n"""


def training_queries() -> dict[str, Query]:
    def full(loss, rate, epochs, ridge=None, data=train_rows):
        return lambda s, d: params(s, Trainer(loss, SGD(rate), *([L2(ridge)] if ridge else []), batch_size=None, epochs=epochs).fit(data(s, d), ["x0", "x1"], "y"))

    logistic = lambda s, d: train_rows(s, d).withColumn("y", (F.col("y") > 2.5).cast("double"))
    model = LinearModel(["x0", "x1"], [3.5, -0.25], 0.125)
    raw = "3.5 * x0 - 0.25 * x1 + 0.125"
    sigmoid = f"1 / (1 + exp(-({raw})))"

    def scored(s, d):
        return model.transform(train_rows(s, d), ["y"]).withColumnRenamed("y", "label")

    def classified(s, d):
        return logistic(s, d).select(F.col("y").alias("label"), (model.probability() >= 0.9).cast("double").alias("predicted"))

    truth = f"SELECT y, {raw} AS p FROM t"
    flagged = f"SELECT y, CASE WHEN {sigmoid} >= 0.9 THEN 1.0 ELSE 0.0 END AS p FROM t"
    losses = lambda s, d: rounded(train_rows(s, d).select(model.score([F.col("x0"), F.col("x1")]).alias("p"), "y", (F.col("y") > 2.5).cast("double").alias("c")).agg(F.avg(MSELoss().value(F.col("p"), F.col("y"))).alias("mse"), F.avg(MAELoss().value(F.col("p"), F.col("y"))).alias("mae"), F.avg(BCEWithLogitsLoss().value(F.col("p"), F.col("c"))).alias("bce"), F.avg(BCEWithLogitsLoss().slope(F.col("p"), F.col("c"))).alias("slope")))
    return {
        "sgd_full_batch_mse": Query(full(MSELoss(), 0.3, 20), descent_sql("w0 * x0 + w1 * x1 + b - y", 20, 0.3)),
        "sgd_l2": Query(full(MSELoss(), 0.3, 20, 0.05), descent_sql("w0 * x0 + w1 * x1 + b - y", 20, 0.3, 0.05)),
        "sgd_mae": Query(full(MAELoss(), 0.3, 10), descent_sql("sign(w0 * x0 + w1 * x1 + b - y)", 10, 0.3)),
        "sgd_logistic": Query(full(BCEWithLogitsLoss(), 0.5, 10, data=logistic), descent_sql("1 / (1 + exp(-(w0 * x0 + w1 * x1 + b))) - y", 10, 0.5, data=LOGISTIC)),
        "sgd_minibatch_mse": Query(lambda s, d: params(s, Trainer(MSELoss(), SGD(0.1), batch_size=512, epochs=3).fit(order_rows(s, d), ["x0"], "y", "o_orderkey")), MINI),
        "sgd_minibatch_mae": Query(lambda s, d: params(s, Trainer(MAELoss(), SGD(0.1), batch_size=512, epochs=2).fit(order_rows(s, d), ["x0"], "y", "o_orderkey")), MINI_MAE),
        "predict_linear": Query(lambda s, d: rounded(model.transform(train_rows(s, d), KEYS)), f"SELECT l_orderkey, l_linenumber, {r(raw, 'prediction')} FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) / 50 AS x0, CAST(l_discount AS DOUBLE) * 10 AS x1 FROM lineitem)"),
        "predict_proba": Query(lambda s, d: rounded(train_rows(s, d).select(*KEYS, model.probability().alias("probability"), model.decision(0.9).alias("decision"))), f"SELECT l_orderkey, l_linenumber, {r(sigmoid, 'probability')}, CASE WHEN {sigmoid} >= 0.9 THEN 1.0 ELSE 0.0 END AS decision FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) / 50 AS x0, CAST(l_discount AS DOUBLE) * 10 AS x1 FROM lineitem)"),
        "losses": Query(losses, f"WITH {TRAIN} SELECT {r('avg((p - y) ** 2)', 'mse')}, {r('avg(abs(p - y))', 'mae')}, {r('avg(greatest(p, 0) - p * c + ln(1 + exp(-abs(p))))', 'bce')}, {r('avg(1 / (1 + exp(-p)) - c)', 'slope')} FROM (SELECT y, CASE WHEN y > 2.5 THEN 1.0 ELSE 0.0 END AS c, {raw} AS p FROM t)"),
        "metrics_regression": Query(lambda s, d: rounded(scored(s, d).agg(*regression_metrics(F.col("label"), F.col("prediction")))), f"WITH {TRAIN} SELECT {r('avg((p - y) ** 2)', 'mse')}, {r('sqrt(avg((p - y) ** 2))', 'rmse')}, {r('avg(abs(p - y))', 'mae')}, {r('1 - sum((p - y) ** 2) / (var_pop(y) * count(*))', 'r2')} FROM ({truth})"),
        "metrics_classification": Query(lambda s, d: rounded(classified(s, d).agg(*classification_metrics(F.col("label"), F.col("predicted")))), f"WITH {LOGISTIC}, f AS ({flagged}), c AS (SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = p) AS good, count(*) AS n FROM f) SELECT {r('good / n', 'accuracy')}, {r('coalesce(tp / nullif(tp + fp, 0), 0.0)', 'precision')}, {r('coalesce(tp / nullif(tp + fn, 0), 0.0)', 'recall')}, {r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0)', 'f1')} FROM c"),
    }


def dataset_queries() -> dict[str, Query]:
    orders = lambda s, d: table(s, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    numbered = "n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, count(*) OVER () AS n FROM orders)"
    part = lambda df, name: df.select("o_orderkey", F.lit(name).alias("part"))

    def two(s, d):
        a, b = split(with_row_ids(orders(s, d), "o_orderkey"), 0.8)
        return part(a, "train").unionAll(part(b, "test"))

    def three(s, d):
        a, b, c = split3(with_row_ids(orders(s, d), "o_orderkey"), 0.7, 0.2)
        return part(a, "train").unionAll(part(b, "validation")).unionAll(part(c, "test"))

    return {
        "row_ids": Query(lambda s, d: with_row_ids(orders(s, d), "o_orderkey").select("o_orderkey", "row_id"), f"WITH {numbered} SELECT o_orderkey, row_id FROM n"),
        "batch_assign": Query(lambda s, d: with_batches(orders(s, d), "o_orderkey", 32).groupBy("batch_id").agg(F.count("*").alias("rows"), F.min("o_orderkey").alias("first")), f"WITH {numbered} SELECT row_id // 32 AS batch_id, count(*) AS rows, min(o_orderkey) AS first FROM n GROUP BY 1"),
        "get_batch": Query(lambda s, d: get_batch(with_row_ids(orders(s, d), "o_orderkey"), 100, 164).select("o_orderkey", "row_id"), f"WITH {numbered} SELECT o_orderkey, row_id FROM n WHERE row_id BETWEEN 100 AND 163"),
        "prefix_split": Query(two, f"WITH {numbered} SELECT o_orderkey, CASE WHEN row_id < floor(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM n"),
        "split3": Query(three, f"WITH {numbered} SELECT o_orderkey, CASE WHEN row_id < floor(n * 0.7) THEN 'train' WHEN row_id < floor(n * 0.7) + floor(n * 0.2) THEN 'validation' ELSE 'test' END AS part FROM n"),
    }


def tensor_queries() -> dict[str, Query]:
    def element() -> dict[str, Column]:
        a, b = F.col("l_quantity"), F.col("l_extendedprice")
        return {"add": a + b, "sub": a - b, "mul": a * b, "scaled": a * 2.5, "shifted": a + 1.5, "absolute": F.abs(a - 25), "sign": X.sign(a - 25), "larger": X.maximum(a, b / 1000), "exponential": F.exp(a / 50), "logarithm": X.ieee_ln(a), "root": F.sqrt(a), "quotient": X.ieee_div(b, a + 0.37)}
    element_sql = {"add": "a + b", "sub": "a - b", "mul": "a * b", "scaled": "a * 2.5", "shifted": "a + 1.5", "absolute": "abs(a - 25)", "sign": "CAST(sign(a - 25) AS DOUBLE)", "larger": "greatest(a, b / 1000)", "exponential": "exp(a / 50)", "logarithm": "ln(a)", "root": "sqrt(a)", "quotient": "b / (a + 0.37::DOUBLE)"}
    edge = lambda: {"div": X.ieee_div("y", "x"), "ln": X.ieee_ln("x"), "sign": X.sign("x"), "larger": X.maximum("x", "y"), "sigmoid": X.sigmoid("x")}
    shown = lambda c: F.when(F.isnan(c), F.lit("nan")).when(c == float("inf"), F.lit("inf")).when(c == float("-inf"), F.lit("-inf")).otherwise(F.format_number(c, 4))
    sized = lambda c: f"CASE WHEN isnan({c}) THEN 'nan' WHEN {c} = 'inf'::DOUBLE THEN 'inf' WHEN {c} = '-inf'::DOUBLE THEN '-inf' ELSE format('{{:,.4f}}', {c}) END"
    regions = lambda s, d: table(s, d, "region").select("r_regionkey", F.when(F.col("r_regionkey") == 4, F.lit(float("nan"))).otherwise(F.col("r_regionkey") - 1.0).alias("x"), (F.col("r_regionkey") - 1.0).alias("y"))
    edge_sql = {"div": "CASE WHEN isnan(x) THEN x WHEN x = 0 THEN CASE WHEN y > 0 THEN 'inf'::DOUBLE WHEN y < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END ELSE y / x END", "ln": "CASE WHEN isnan(x) OR x < 0 THEN 'nan'::DOUBLE WHEN x = 0 THEN '-inf'::DOUBLE ELSE ln(x) END", "sign": "CASE WHEN isnan(x) THEN 0.0 ELSE CAST(sign(x) AS DOUBLE) END", "larger": "CASE WHEN isnan(x) THEN y ELSE greatest(x, y) END", "sigmoid": "CASE WHEN isnan(x) THEN x ELSE 1 / (1 + exp(-x)) END"}
    nan = lambda s, d: line(s, d).withColumn("l_tax", F.when(F.round("l_tax", 2) == 0.03, F.lit(float("nan"))).otherwise(F.col("l_tax")))
    stats = lambda s, d: rounded(nan(s, d).agg(tensor.sum_all(["l_quantity", "l_discount"]).alias("sum_all"), tensor.mean_all(["l_quantity", "l_discount"]).alias("mean_all"), F.avg("l_quantity").alias("col_mean"), tensor.col_std("l_quantity").alias("std0"), tensor.col_std("l_quantity", 1).alias("std1"), tensor.col_min("l_tax").alias("low"), tensor.col_max("l_tax").alias("high"), F.isnan(F.avg("l_tax")).alias("nan_spreads")))
    stats_sql = f"SELECT {r('sum(l_quantity) + sum(l_discount)', 'sum_all')}, {r('(avg(l_quantity) + avg(l_discount)) / 2', 'mean_all')}, {r('avg(l_quantity)', 'col_mean')}, {r('stddev_pop(l_quantity)', 'std0')}, {r('stddev_samp(l_quantity)', 'std1')}, {r('CAST(min(l_tax) FILTER (round(l_tax, 2) <> 0.03) AS DOUBLE)', 'low')}, {r('CAST(max(l_tax) FILTER (round(l_tax, 2) <> 0.03) AS DOUBLE)', 'high')}, true AS nan_spreads FROM lineitem"
    mat = lambda s, d: rounded(line(s, d).select(*KEYS, tensor.row_sum(FEATURES).alias("total"), tensor.matvec(FEATURES, [1.0, -2.0, 0.5]).alias("product"), *[c.alias(f"b_{op}") for op in ("add", "sub", "mul", "div") for c in tensor.broadcast_rows(["l_quantity"], [4.0], op)]))
    turned = lambda s, d: rounded(tensor.transpose(regions(s, d).select("r_regionkey", "y", (F.col("y") * 2).alias("z")), "r_regionkey", ["y", "z"]).toDF("name", *[f"r{k}" for k in range(5)]))
    hot = lambda s, d: table(s, d, "region").select("r_regionkey", *tensor.one_hot_indices(F.col("r_regionkey").cast("double"), 5))
    joined = lambda s, d: tensor.select_columns(tensor.hcat(table(s, d, "nation"), [[("n", F.col("n_nationkey"))], [("r", F.col("n_regionkey"))]]), [1, 0, 1])
    vectors = lambda s, d: rounded(table(s, d, "embeddings").select("vec_id", X.array_sum("embedding").alias("total"), X.array_mean("embedding").alias("mean"), X.array_dot("embedding", "embedding").alias("squares"), X.array_sum(X.array_op("embedding", "embedding", lambda x, y: x.cast("double") + y.cast("double"))).alias("doubled")))
    made = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
    return {
        "tensor_elementwise": Query(lambda s, d: rounded(line(s, d).select(*KEYS, *[c.alias(k) for k, c in element().items()])), f"SELECT l_orderkey, l_linenumber, {', '.join(r(e, k) for k, e in element_sql.items())} FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS a, CAST(l_extendedprice AS DOUBLE) AS b FROM lineitem)"),
        "tensor_ieee_edges": Query(lambda s, d: regions(s, d).select("r_regionkey", *[shown(c).alias(k) for k, c in edge().items()]), f"WITH e AS (SELECT r_regionkey, CASE WHEN r_regionkey = 4 THEN 'nan'::DOUBLE ELSE r_regionkey - 1.0::DOUBLE END AS x, r_regionkey - 1.0::DOUBLE AS y FROM region), v AS (SELECT r_regionkey, {', '.join(f'{e} AS {k}' for k, e in edge_sql.items())} FROM e) SELECT r_regionkey, {', '.join(f'{sized(k)} AS {k}' for k in edge_sql)} FROM v"),
        "tensor_col_stats": Query(stats, stats_sql),
        "tensor_matvec": Query(mat, f"SELECT l_orderkey, l_linenumber, {r('l_quantity + l_discount + l_tax', 'total')}, {r('l_quantity - 2 * l_discount + 0.5 * l_tax', 'product')}, {r('l_quantity + 4.0::DOUBLE', 'b_add')}, {r('l_quantity - 4.0::DOUBLE', 'b_sub')}, {r('l_quantity * 4.0::DOUBLE', 'b_mul')}, {r('l_quantity / 4.0::DOUBLE', 'b_div')} FROM lineitem"),
        "tensor_tdot": Query(lambda s, d: rounded(line(s, d).agg(*tensor.matvec_transposed(FEATURES, "l_extendedprice")), 1), f"SELECT {', '.join(r(f'sum(CAST({c} AS DOUBLE) * CAST(l_extendedprice AS DOUBLE))', c, 1) for c in FEATURES)} FROM lineitem"),
        "tensor_gram": Query(lambda s, d: rounded(line(s, d).agg(*tensor.gram(FEATURES)).toDF(*[f"g{k}" for k in range(6)]), 3), f"SELECT {', '.join(r(f'sum(CAST({x} AS DOUBLE) * CAST({y} AS DOUBLE))', f'g{k}', 3) for k, (x, y) in enumerate((x, y) for i, x in enumerate(FEATURES) for y in FEATURES[i:]))} FROM lineitem"),
        "tensor_transpose": Query(turned, "SELECT 'y' AS name, -1.0 AS r0, 0.0 AS r1, 1.0 AS r2, 2.0 AS r3, 3.0 AS r4 UNION ALL SELECT 'z', -2.0, 0.0, 2.0, 4.0, 6.0"),
        "tensor_one_hot_indices": Query(hot, f"SELECT r_regionkey, {', '.join(f'CASE WHEN r_regionkey = {k} THEN 1.0 ELSE 0.0 END AS c{k}' for k in range(5))} FROM region"),
        "tensor_hcat_select": Query(joined, "SELECT n_regionkey AS r, n_nationkey AS n, n_regionkey AS r_2 FROM nation"),
        "tensor_vectors": Query(vectors, f"WITH e AS (SELECT vec_id, {made} AS e FROM embeddings) SELECT vec_id, {r('list_sum(e)', 'total')}, {r('list_sum(e) / len(e)', 'mean')}, {r('list_sum(list_transform(e, lambda x: x * x))', 'squares')}, {r('2 * list_sum(e)', 'doubled')} FROM e"),
    }


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``), or in a local one where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{(shared or tempfile.mkdtemp(prefix='mlframe-')).rstrip('/')}/mlframe-{uuid.uuid4().hex}-{name}"


def reloaded(spark: SparkSession, model: Model) -> Model:
    """The model after saving and loading."""
    path = scratch(spark, "model.json")
    model.save(path)
    return Model.load(path)


def raises(run: Callable[[], object]) -> bool:
    try:
        run()
    except MlframeError:
        return True
    return False


def source_queries() -> dict[str, Query]:
    def csv(s, lines, strict):
        path = scratch(s, "csv")
        s.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
        return read_csv(s, path, ["a", "b"], strict)

    def report(s, d):
        path = scratch(s, "report")
        write_report(table(s, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).select(F.col("c_nationkey").cast("long").alias("nation"), "n"), path)
        return s.read.schema("nation long, n long").json(path)

    def there_and_back(s, d):
        rows = table(s, d, "nation").select(F.col("n_nationkey").cast("double").alias("key"), F.col("n_regionkey").cast("double").alias("region"), (F.col("n_nationkey") * 2.0).alias("label"))
        return from_rows(s, *to_rows(rows, ["key", "region"], "label", "key"), ["key", "region"])

    return {
        "source_rows": Query(lambda s, d: from_rows(s, [[1, 2], [3, 4], [5, 6]], [7, 8, 9]), "SELECT * FROM (VALUES (0, 1.0, 2.0, 7.0), (1, 3.0, 4.0, 8.0), (2, 5.0, 6.0, 9.0)) v(row_id, f0, f1, label)"),
        "source_csv_lenient": Query(lambda s, d: csv(s, ["a,b", "1,2", "x,3.5", ",4"], False), "SELECT * FROM (VALUES (1.0, 2.0), (0.0, 3.5), (0.0, 4.0)) v(a, b)"),
        "source_csv_strict": Query(lambda s, d: csv(s, ["a,b", "1,2", "3", "4,5,6", "7,8.5"], True), "SELECT * FROM (VALUES (1.0, 2.0), (7.0, 8.5)) v(a, b)"),
        "source_len": Query(lambda s, d: one_row(s, {"n": (o := table(s, d, "orders")).count(), "empty": o.isEmpty(), "none": o.limit(0).isEmpty()}), "SELECT CAST(count(*) AS INTEGER) AS n, count(*) = 0 AS empty, true AS none FROM orders"),
        "select_features": Query(lambda s, d: select_features(line(s, d).select(*FEATURES, *KEYS), [2, 0, 99], KEYS), "SELECT CAST(l_tax AS DOUBLE) AS l_tax, CAST(l_quantity AS DOUBLE) AS l_quantity, 0.0 AS \"Unknown\", l_orderkey, l_linenumber FROM lineitem"),
        "to_rows": Query(there_and_back, "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS row_id, CAST(n_nationkey AS DOUBLE) AS key, CAST(n_regionkey AS DOUBLE) AS region, n_nationkey * 2.0 AS label FROM nation"),
        "json_report": Query(report, "SELECT CAST(c_nationkey AS BIGINT) AS nation, count(*) AS n FROM customer GROUP BY 1"),
    }


def saved_queries() -> dict[str, Query]:
    """Every kind of fitted object after saving and loading, against the SQL of the object itself."""
    composed, scaled, encoded, poly = compose_queries(), scaler_queries(), encoder_queries(), polynomial_queries()
    steps = lambda: Pipeline([("impute", SimpleImputer("mean")), ("scale", StandardScaler())])
    numbered = lambda s, d: holes(s, d).withColumn("key", F.col("l_linenumber")).withColumn("l_linenumber", F.col("l_linenumber").cast("double"))
    sizes = lambda s, d: table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"))

    def predictive(s, d):
        rows = numbered(s, d)
        pre = ColumnTransformer([("num", FEATURES, steps())]).fit(rows)
        terms = PolynomialFeatures(2, False, True).model(pre.output_cols, {})
        whole = PredictivePipeline(pre, LinearModel(terms.output_cols, [1.0, -2.0, 0.5, 0.25, 0.0, 3.0], 7.0), terms)
        return rounded(reloaded(s, whole).transform(rows, KEYS[:1] + ["key"]))

    mixed = lambda: ColumnTransformer([("num", FEATURES, steps()), ("cat", ["l_linenumber"], OneHotEncoder())])
    linear = LinearModel(["x0", "x1"], [3.5, -0.25], 0.125)
    out = {
        f"saved_{name}_scaler": Query(lambda s, d, make=make: rounded(reloaded(s, make().fit(line(s, d), FEATURES)).transform(line(s, d), KEYS)), scaled[f"{name}_scaler_transform"].sql) for name, (make, *_) in SCALERS.items()
    }
    return out | {
        "saved_imputer": Query(lambda s, d: rounded(reloaded(s, SimpleImputer("mean").fit(holes(s, d), FEATURES)).transform(holes(s, d), KEYS)), imputer_queries()["impute_mean"].sql),
        "saved_normalizer": Query(lambda s, d: rounded(reloaded(s, Normalizer("l2").fit(line(s, d), FEATURES)).transform(line(s, d), KEYS)), scaled["normalizer_l2"].sql),
        "saved_onehot": Query(lambda s, d: reloaded(s, OneHotEncoder().fit(sizes(s, d), ["p_size"])).transform(sizes(s, d)), encoded["onehot_transform"].sql),
        "saved_ordinal": Query(lambda s, d: reloaded(s, OrdinalEncoder().fit(sizes(s, d), ["p_size"])).transform(sizes(s, d)), encoded["ordinal_transform"].sql),
        "saved_polynomial": Query(lambda s, d: rounded((t := reloaded(s, PolynomialFeatures(2, False).fit(line(s, d), FEATURES)).transform(line(s, d), KEYS)).toDF(*KEYS, *[f"p{k}" for k in range(len(t.columns) - 2)])), poly["poly_deg2"].sql),
        "saved_pipeline": Query(lambda s, d: rounded(reloaded(s, steps().fit(holes(s, d), FEATURES)).transform(holes(s, d), KEYS)), composed["pipeline_impute_scale"].sql),
        "pipeline_from_params": Query(lambda s, d: rounded(PipelineModel.from_dict(json.loads(json.dumps(steps().fit(holes(s, d), FEATURES).to_dict()))).transform(holes(s, d), KEYS)), composed["pipeline_impute_scale"].sql),
        "saved_column_transformer": Query(lambda s, d: rounded(reloaded(s, mixed().fit(numbered(s, d))).transform(numbered(s, d), ["l_orderkey", "key"])), composed["column_transformer_mixed"].sql),
        "saved_predictive_pipeline": Query(predictive, composed["predictive_pipeline"].sql),
        "saved_linear": Query(lambda s, d: rounded(reloaded(s, linear).transform(train_rows(s, d), KEYS)), training_queries()["predict_linear"].sql),
        "saved_bits": Query(lambda s, d: one_row(s, {"third": reloaded(s, LinearModel(["a"], [1 / 3], 0.1)).weights[0]}), "SELECT CAST(1 AS DOUBLE) / 3 AS third"),
    }


def contract_queries() -> dict[str, Query]:
    """What fitted objects say of themselves, and what they refuse."""
    def refused(s, d):
        rows = line(s, d)
        made = {
            "imputer": SimpleImputer().fit(rows, FEATURES), "normalizer": Normalizer().fit(rows, FEATURES), "polynomial": PolynomialFeatures(2).fit(rows, FEATURES),
            "column_transformer": ColumnTransformer([("a", FEATURES, StandardScaler())]).fit(rows), "standard": StandardScaler().fit(rows, FEATURES),
        }
        return s.createDataFrame([(name, raises(lambda m=m: m.inverse_transform(m.transform(rows)))) for name, m in made.items()], "step string, refused boolean")

    def described(s, d):
        rows = line(s, d).withColumn("number", F.col("l_linenumber").cast("double"))
        pipe = Pipeline([("fill", SimpleImputer()), ("scale", StandardScaler())])
        whole = ColumnTransformer([("num", FEATURES, pipe), ("cat", ["number"], Pipeline([("hot", OneHotEncoder())]))]).fit(rows)
        inner, hot = whole.parts[0][1], whole.parts[1][1].steps[0]
        return one_row(s, {"parts": len(whole), "part_names": ",".join(whole.step_names), "steps": len(inner), "step_names": ",".join(inner.step_names), "is_empty": inner.is_empty or whole.is_empty, "n_in": whole.n_features_in, "n_out": whole.n_features_out, "n_values": hot.n_values[0], "categories": ",".join(map(str, hot.categories[0])), "label_is_step": issubclass(LabelEncoder, Step)})

    only = "WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS v FROM lineitem) SELECT l_orderkey, l_linenumber, round({}, 6) + 0.0 AS l_quantity FROM lineitem, s"
    arithmetic = lambda s, d: (m := (LinearModel(["a", "b"], [1.0, 2.0], 3.0) + LinearModel(["a", "b"], [0.5, 0.5], 1.0)).scale(2.0)) and one_row(s, {"w0": m.weights[0], "w1": m.weights[1], "bias": m.bias})
    return {
        "no_inverse": Query(refused, "SELECT * FROM (VALUES ('imputer', true), ('normalizer', true), ('polynomial', true), ('column_transformer', true), ('standard', false)) v(step, refused)"),
        "introspection": Query(described, "SELECT 2 AS parts, 'num,cat' AS part_names, 2 AS steps, 'fill,scale' AS step_names, false AS is_empty, 4 AS n_in, CAST(3 + count(DISTINCT l_linenumber) AS INTEGER) AS n_out, CAST(count(DISTINCT l_linenumber) AS INTEGER) AS n_values, (SELECT string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) FROM (SELECT DISTINCT l_linenumber AS n FROM lineitem)) AS categories, false AS label_is_step FROM lineitem"),
        "poly_degree0": Query(lambda s, d: PolynomialFeatures(0, True).fit_transform(line(s, d), FEATURES, KEYS).toDF(*KEYS, "p0"), "SELECT l_orderkey, l_linenumber, 1.0 AS p0 FROM lineitem"),
        "poly_degree0_no_bias": Query(lambda s, d: PolynomialFeatures(0, False).fit_transform(line(s, d), FEATURES, KEYS), "SELECT l_orderkey, l_linenumber FROM lineitem"),
        "standard_mean_only": Query(lambda s, d: rounded(StandardScaler(with_std=False).fit_transform(line(s, d), ["l_quantity"], KEYS)), only.format("l_quantity - m")),
        "standard_std_only": Query(lambda s, d: rounded(StandardScaler(with_mean=False).fit_transform(line(s, d), ["l_quantity"], KEYS)), only.format("l_quantity / v")),
        "linear_params": Query(arithmetic, "SELECT 3.0 AS w0, 5.0 AS w1, 8.0 AS bias"),
    }


def history_queries() -> dict[str, Query]:
    def history(s, d):
        _, losses = Trainer(MSELoss(), SGD(0.3), L2(0.05), batch_size=None, epochs=5).fit_history(train_rows(s, d), ["x0", "x1"], "y")
        n = train_rows(s, d).count()
        return rounded(s.createDataFrame([(h["epoch"], h["loss"], h["reported"] * n) for h in losses], "epoch long, loss double, reported_times_n double"))

    def batches(s, d):
        _, losses = Trainer(MAELoss(), SGD(0.1), batch_size=512, epochs=1).fit_history(order_rows(s, d).where("o_orderkey <= 2000"), ["x0"], "y", "o_orderkey")
        _, same = Trainer(MSELoss(), SGD(0.0), batch_size=512, epochs=2).fit_history(order_rows(s, d), ["x0"], "y", "o_orderkey")
        return rounded(one_row(s, {"epochs": len(losses), "mean_square": same[0]["loss"], "again": same[1]["loss"]}))

    def searched(s, d):
        found = search_rates(Trainer(MSELoss(), SGD(0), batch_size=None, epochs=20), train_rows(s, d), ["x0", "x1"], "y", "l_orderkey", [0.1, 0.3])
        return rounded(found.select("rate", F.col("theta")[0].alias("w0"), F.col("theta")[1].alias("w1"), F.col("theta")[2].alias("bias")))

    slope = "w0 * x0 + w1 * x1 + b - y"
    rates = " UNION ALL ".join(f"SELECT {rate}::DOUBLE AS rate, * FROM ({descent_sql(slope, 20, rate)})" for rate in (0.1, 0.3))
    steps = descent_sql(slope, 4, 0.3, 0.05).partition(") SELECT")[0]
    flat = lambda s, d, guard: rounded(table(s, d, "nation").select(F.lit(2.0).alias("label"), F.col("n_regionkey").cast("double").alias("p")).agg(*regression_metrics(F.col("label"), F.col("p"), guard)).withColumn("r2", F.greatest(F.col("r2"), F.lit(-1e9))))
    times = "SELECT list_sort(list(CAST(value AS DOUBLE))) AS v FROM events"
    member = lambda q: f"v[CAST(least(floor(len(v) * {q}) + 1, len(v)) AS BIGINT)]"
    return {
        "training_history": Query(history, f"{steps}) SELECT CAST(e + 1 AS BIGINT) AS epoch, {r('avg((w0 * x0 + w1 * x1 + b - y) ** 2)', 'loss')}, {r('avg((w0 * x0 + w1 * x1 + b - y) ** 2) + 0.05 * (any_value(w0) ** 2 + any_value(w1) ** 2)', 'reported_times_n')} FROM g, t GROUP BY e"),
        "training_history_batches": Query(batches, f"WITH o AS (SELECT CAST(o_totalprice AS DOUBLE) / 100000 AS y FROM orders) SELECT 1 AS epochs, {r('avg(y * y)', 'mean_square')}, {r('avg(y * y)', 'again')} FROM o"),
        "search_rates": Query(searched, rates),
        "metrics_unguarded": Query(lambda s, d: flat(s, d, False), "SELECT round(avg((n_regionkey - 2) ** 2), 6) AS mse, round(sqrt(avg((n_regionkey - 2) ** 2)), 6) AS rmse, round(avg(abs(n_regionkey - 2)), 6) AS mae, -1e9::DOUBLE AS r2 FROM nation"),
        "metrics_guarded": Query(lambda s, d: flat(s, d, True), "SELECT round(avg((n_regionkey - 2) ** 2), 6) AS mse, round(sqrt(avg((n_regionkey - 2) ** 2)), 6) AS rmse, round(avg(abs(n_regionkey - 2)), 6) AS mae, 0.0 AS r2 FROM nation"),
        "timing_summary": Query(lambda s, d: rounded(timing_summary(table(s, d, "events").select(F.col("value").cast("double").alias("value")), "value")), f"SELECT {r('list_avg(v)', 'mean')}, {r('list_stddev_pop(v)', 'std')}, {r('v[1]', 'min')}, {r('v[-1]', 'max')}, {r(member(0.5), 'median')}, {r(member(0.95), 'p95')}, {r(member(0.99), 'p99')} FROM ({times})"),
    }


def vector_queries() -> dict[str, Query]:
    cells = lambda s, d: table(s, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("double").alias("a"), (F.col("n_nationkey") * 0.5).alias("b"))
    return {
        "tensor_zeros": Query(lambda s, d: tensor.zeros_2d(s, 4, 2).withColumn("width", F.size(tensor.zeros_1d(7))).withColumn("total", X.array_sum(tensor.zeros_1d(7))), "SELECT range AS row_id, 0.0 AS c0, 0.0 AS c1, 7 AS width, 0.0 AS total FROM range(4)"),
        "tensor_from_vec": Query(lambda s, d: tensor.from_vec_2d(s, [1, 2, 3, 4, 5, 6], 3, 2).withColumn("third", F.element_at(tensor.from_vec_1d([0.5, 0.25, 1 / 3]), 3)).withColumn("single", F.element_at(tensor.from_vec_1d([1 / 3], single=True), 1)), "SELECT * FROM (VALUES (0, 1.0, 2.0), (1, 3.0, 4.0), (2, 5.0, 6.0)) v(row_id, c0, c1), (SELECT CAST(1 AS DOUBLE) / 3 AS third, CAST(CAST(CAST(1 AS DOUBLE) / 3 AS FLOAT) AS DOUBLE) AS single)"),
        "tensor_scalar": Query(lambda s, d: rounded(table(s, d, "region").select("r_regionkey", *[c.alias(k) for k, c in {"added": F.lit(2.5) + 0.5, "taken": F.lit(2.5) - 0.5, "times": F.lit(2.5) * 4, "over": X.ieee_div(F.lit(2.5), F.lit(2.0)), "root": F.sqrt(F.lit(6.25)), "absolute": F.abs(F.lit(-2.5)), "power": F.exp(F.lit(0.0))}.items()])), "SELECT r_regionkey, 3.0 AS added, 2.0 AS taken, 10.0 AS times, 1.25 AS over, 2.5 AS root, 2.5 AS absolute, 1.0 AS power FROM region"),
        "tensor_col_sum": Query(lambda s, d: rounded(line(s, d).agg(*[tensor.col_sum(c).alias(c) for c in FEATURES]), 3), f"SELECT {', '.join(r(f'sum(CAST({c} AS DOUBLE))', c, 3) for c in FEATURES)} FROM lineitem"),
        "tensor_ravel": Query(lambda s, d: tensor.ravel(cells(s, d), "n_nationkey", ["a", "b"]), "SELECT CAST(n_nationkey * 2 AS BIGINT) AS index, CAST(n_regionkey AS DOUBLE) AS value FROM nation UNION ALL SELECT CAST(n_nationkey * 2 + 1 AS BIGINT), n_nationkey * 0.5 FROM nation"),
        "tensor_shape": Query(lambda s, d: one_row(s, dict(zip(("rows", "columns"), tensor.shape(cells(s, d), ["a", "b"]), strict=True))), "SELECT CAST(count(*) AS INTEGER) AS rows, 2 AS columns FROM nation"),
    }


def catalogue() -> dict[str, Query]:
    parts = (scaler_queries, imputer_queries, encoder_queries, polynomial_queries, compose_queries, training_queries, dataset_queries, tensor_queries, source_queries, saved_queries, contract_queries, history_queries, vector_queries)
    return {name: query for part in parts for name, query in part().items()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Scales lineitem's features, fits a linear model of the price by descent in one aggregation, scores and evaluates it."""
    rows = line(spark, d)
    model = StandardScaler().fit(rows, FEATURES)
    scaled = model.transform(rows)
    fitted = Trainer(MSELoss(), SGD(0.1), batch_size=None, epochs=200).fit(scaled, FEATURES, "l_extendedprice")
    scored = fitted.transform(scaled, ["l_extendedprice"])
    return scored.agg(*regression_metrics(F.col("l_extendedprice"), F.col("prediction")), F.count("*").alias("rows"))
