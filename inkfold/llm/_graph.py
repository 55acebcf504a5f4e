"""Connected components over edge tables by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm._common import cut


def _signature(edges: DataFrame):
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node, component (smallest reachable node) for every node that has an edge.

    Rounds of large-star and small-star on plain min-aggregates and joins: a hub's
    minimum is combined map-side and its edge list is never gathered into one row.
    Stops when the edge set is a star forest. An empty table gives an empty result;
    edges with a null end and self-loops are ignored.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = cut(e)
    before = _signature(e)
    for _ in range(most_rounds):
        if before[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("w").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("w"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("w").alias("v")), F.struct(F.col("v").alias("u"), F.col("w").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        e = cut(small)
        after = _signature(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
