"""Connected components of an edge table, by large stars and small stars in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.staging import cut, scope


def components(edges: DataFrame, name: str = "components", rounds: int = 200) -> DataFrame:
    """``node, root``: the smallest node reachable, for nodes with an edge; ``edges`` has a > b.

    Each node's neighbours are hung on the smallest one.  A round joins nothing larger than the edges and
    shuffles them by node with minima pre-aggregated; the rounds grow with the logarithm of the longest
    chain.  An input that has not settled after ``rounds`` raises an error.
    """
    with scope(edges.sparkSession):
        work = cut(edges.select("a", "b").distinct(), f"{name}-e")
        before, empty = None, work.isEmpty()
        for _ in range(0 if empty else rounds):
            both = work.unionByName(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
            large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            low = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            work = cut(small.where("a <> b").distinct(), f"{name}-e")
            state = work.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("b")).first()
            if state == before:
                break
            before = state
        else:
            if not empty:
                raise RuntimeError(f"components have not settled after {rounds} rounds")
        return cut(work.select(F.col("a").alias("node"), F.col("b").alias("root")), name, keep=True)
