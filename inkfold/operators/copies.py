"""Equal outlines: what depends on their points alone is computed for the first of them and told for all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.operators.graph import cut


def classes(outlines: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, ring_id, first: every ring with the smallest ring of its keys that has the same points at the same places.

    Points are summed up by two 64-bit hashes in halves, so no ring is one group and the sums cannot overflow.
    """
    parts = ("pos", "x", "y", "x IS NULL", "y IS NULL")
    marks = {"p": f"xxhash64({', '.join(parts)})", "q": f"xxhash64('again', {', '.join(reversed(parts))})"}
    halves = [F.sum(F.expr(e)).alias(f"{c}{k}") for c in marks for k, e in enumerate((f"shiftright({c}, 32)", f"{c} & 4294967295"))]
    sums = cut(outlines.select(*keys, "ring_id", *(F.expr(e).alias(c) for c, e in marks.items())).groupBy(*keys, "ring_id").agg(F.count("*").alias("n"), *halves))
    same = [*keys, "n", *(f"{c}{k}" for c in marks for k in (0, 1))]
    return cut(sums.join(sums.groupBy(*same).agg(F.min("ring_id").alias("first")), same).select(*keys, "ring_id", "first"))


def firsts(outlines: DataFrame, of: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The outlines of the first ring of every class."""
    return outlines.join(of.where("ring_id = first").select(*keys, "ring_id"), [*keys, "ring_id"], "left_semi")


def for_all(told: DataFrame, of: DataFrame, keys: tuple[str, ...] = (), ring: str = "ring_id") -> DataFrame:
    """What is told of first rings, for every ring."""
    names = told.columns
    return told.withColumnRenamed(ring, "first").join(of.select(*keys, F.col("ring_id").alias(ring), "first"), [*keys, "first"]).select(*names)


def next_rings(rings: DataFrame, measure: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """pair_id and what measure(rings, ways) tells of it: every ring with the ring of the next number; pairs of equal rings are measured once.

    ways(pair_id, way, from_id, to_id): both ways of a pair, 0 from the ring of its number.
    """
    of = classes(rings)
    pairs = of.select(F.col("ring_id").alias("pair_id"), F.col("first").alias("a")).join(of.select((F.col("ring_id") - 1).alias("pair_id"), F.col("first").alias("b")), "pair_id")
    kinds = cut(pairs.groupBy("a", "b").agg(F.min("pair_id").alias("kind")))
    ways = kinds.selectExpr("kind AS pair_id", "inline(array(named_struct('way', 0, 'from_id', a, 'to_id', b), named_struct('way', 1, 'from_id', b, 'to_id', a)))")
    told = measure(firsts(rings, of), ways).withColumnRenamed("pair_id", "kind")
    return pairs.join(kinds, ["a", "b"]).select("pair_id", "kind").join(told, "kind").drop("kind")
