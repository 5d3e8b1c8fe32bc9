"""Exact top-k search by aggregation of sorted lists without random access."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mlframe.plans.workers import let_workers_import

#: How far the lists are read before each look at the bounds, as shares of their length.
DEPTHS = (0.5, 0.75, 0.875, 0.9375)
RESULT = "query_id long, vec_id long, score long"


class SortedLists:
    """The lists of one block of vectors: per dimension, its components in falling and in rising order.

    A query reads a dimension's list from the end that suits the sign of its own component, all lists to the same depth. What has been read of a falling list is the components of at least the value at that depth, of a rising list those of at most that value, so bounds of many queries and vectors come from a few matrix products.
    """

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.rising = np.sort(vectors, axis=0)

    def bounds(self, queries: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all scores (queries in rows) after ``depth`` entries of each list.

        An entry that has not been read lies between the last value read and the far end of its list.
        """
        x, n = self.vectors, len(self.vectors)
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        if depth >= n:
            exact = queries @ x.T
            return exact, exact
        high, low = self.rising[n - depth], self.rising[depth - 1]
        upper = plus @ np.maximum(x, high).T + minus @ np.minimum(x, low).T
        lower = plus @ np.where(x >= high, x, self.rising[0]).T + minus @ np.where(x <= low, x, self.rising[-1]).T
        return lower, upper


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, lists: SortedLists, k: int, depths: tuple[float, ...] = DEPTHS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query, the ids and scores of its k best vectors of this block, ties to the smaller id, never a vector of the query's own id.

    Lists are read to growing depths. The k-th best lower bound is what a result needs; a query stops when at most an eighth of the block, or 4 k vectors, have an upper bound as high, and these get their final scores; what is left after the last round is read to the end.
    """
    vectors, n = lists.vectors, len(ids)
    enough = max(4 * k, n // 8)
    open_ = np.arange(len(query_ids))
    schedule = sorted({max(1, int(n * share)) for share in depths} | {n})
    for depth in schedule:
        if not len(open_):
            return
        lower, upper = lists.bounds(queries[open_], depth)
        own = query_ids[open_, None] == ids[None, :]
        if own.any():
            lower, upper = np.where(own, -np.inf, lower), np.where(own, -np.inf, upper)
        kth = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(open_), -np.inf)
        alive = (upper >= kth[:, None]) & (upper > -np.inf)
        stop = alive.sum(1) <= enough if depth < n else np.ones(len(open_), bool)
        for row in np.flatnonzero(stop):
            some = np.flatnonzero(alive[row])
            final = vectors[some] @ queries[open_[row]]
            best = np.lexsort((ids[some], -final))[:k]
            if len(best):
                yield int(query_ids[open_[row]]), ids[some][best], final[best]
        open_ = open_[~stop]


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, query_block: int = 16384, vector_block: int = 8192, depths: tuple[float, ...] = DEPTHS) -> DataFrame:
    """The k vectors of highest integer inner product for every query, exact; components are floor(scale * x).

    Both tables are cut into blocks by a hash of the id, for each length of vectors by itself; each pair of blocks is one group of bounded size, worked on by :func:`search_block` for some of its queries at a time; the k best of each pair meet in a window that keeps k per task before the shuffle. A vector is copied once for every ``query_block`` queries of its length and a query once for every ``vector_block`` vectors. Nothing is broadcast, and what reaches the driver is two counts for each length of vectors.

    Columns: query_id, rank (from 1), vec_id, score. Ties go to the smaller vec_id; a vector with the query's own id takes no part, repeated rows included, while repeated ids of other vectors count each for itself; of a repeated query id the shortest and then smallest vector counts. A query meets the vectors of its own length. Null ids and vectors, empty vectors, and vectors with null or non-finite components take no part. Fewer candidates than k give fewer rows; an empty table gives none. Other columns are not read.
    """
    def numbers(df: DataFrame) -> DataFrame:
        vector = F.col(vector_col)
        whole = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
        return df.where(F.col(id_col).isNotNull() & vector.isNotNull()).where(whole).where(F.size(vector) > 0).select(F.col(id_col).cast("long").alias("id"), F.size(vector).alias("width"), F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double")).alias("v"))

    let_workers_import(vectors.sparkSession)
    q = numbers(queries).groupBy("id").agg(F.min(F.struct("width", "v")).alias("m")).select("id", "m.*")
    x = numbers(vectors)
    blocks = {}
    for side, (table, size) in enumerate(((q, query_block), (x, vector_block))):
        for r in table.groupBy("width").agg(F.count("*").alias("n")).collect():
            blocks.setdefault(r["width"], [0, 0])[side] = -(-r["n"] // size)
    both = {width: n for width, n in blocks.items() if all(n)} or {0: [1, 1]}
    number = lambda which: F.create_map(*[F.lit(v) for width, n in both.items() for v in (width, n[which])])[F.col("width")]
    sized = lambda df: df.where(F.col("width").isin(list(both))).withColumn("n_q", number(0)).withColumn("n_x", number(1))
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = sized(q).select("width", F.pmod(F.xxhash64("id"), "n_q").cast("int").alias("qb"), span("n_x").alias("xb"), "id", "v")
    x = sized(x).select("width", F.pmod(F.xxhash64("id", "v"), "n_x").cast("int").alias("xb"), span("n_q").alias("qb"), "id", "v")

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            ids, lists = right["id"].to_numpy(), SortedLists(np.stack(right["v"].to_numpy()))
            for at in range(0, len(left), 1024):
                some = left.iloc[at : at + 1024]
                found += search_block(some["id"].to_numpy(), np.stack(some["v"].to_numpy()), ids, lists, k, depths)
        if not found:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        return pd.DataFrame({"query_id": np.repeat([f[0] for f in found], [len(f[1]) for f in found]), "vec_id": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found]).astype(np.int64)})

    cell = ["width", "qb", "xb"]
    best = q.groupBy(*cell).cogroup(x.groupBy(*cell)).applyInPandas(work, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark, sf_dir: str) -> DataFrame:
    """Contract query: vectors whose id is divisible by 50 against all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
