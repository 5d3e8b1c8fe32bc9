"""Connected components over edges that never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlframe.llm.common import discard, materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from every node of ``edges`` (columns a and b, any orderable type): node, component.

    Alternating large-star and small-star steps: in a large-star step every node links its larger neighbours to the smallest one around it, in a small-star step its smaller neighbours and itself. The number of edges never grows, a node of very many neighbours is worked on by a partial minimum before the shuffle and a join that adaptive execution may split, and the rounds grow as the logarithm of the longest path. Each round is written to the shared folder, so lost executors cost one round.

    Null ends, loops and repeated edges are left out; a table without edges gives no rows. Raises if ``max_rounds`` do not settle it.
    """
    pairs = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    now = materialize(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    state = None
    for _ in range(max_rounds):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        before, now = now, materialize(small)
        discard(before)
        last, state = state, now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
