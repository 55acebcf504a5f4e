"""Mixing sources to target weights by Poisson replication, all in DataFrame functions.

Each source gets a mean repetition rate so that its expected share of the output is its
target weight. A document's count is a Poisson variable with that mean, inverted from a
uniform number that its id and the seed determine; the document is exploded by its count
and the copies are ordered by another hash. A mean above ``MOST_MEAN`` is a sum of equal
smaller ones, each inverted from a uniform number of its own, so the work follows the
number of copies whatever the rate. No row's fate depends on another row or on
the partitioning, so a lost task repeats exactly.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm._common import cut, small_enough

MOST_MEAN = 64.0
_BLOCK = 4096  # copies of one document that a task makes at a time
_BITS = 13  # hex digits of an MD5 that make one uniform number: 52 bits, exact in a double


def uniform(key: Column, salt: str) -> Column:
    """A number in [0, 1) that the key (as text) and the salt determine."""
    digest = F.md5(F.concat_ws("|", F.lit(salt), key.cast("string")))
    return F.conv(F.substring(digest, 1, _BITS), 16, 10).cast("long") / F.lit(float(16**_BITS))


def poisson_cdf(mean: Column) -> Column:
    """array<double>: P(count <= k) for k = 0, 1, ... until the tail is below the grid of the uniform numbers; mean: at most MOST_MEAN."""
    top = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.when(mean > 0, F.aggregate(F.sequence(F.lit(1), top), start, step)["cdf"]).otherwise(F.array(F.lit(1.0)))


def poisson(cdf: Column, parts: Column, key: Column, salt: str) -> Column:
    """The sum of ``parts`` variables, each the number of cdf steps at or below a uniform number of the key; the first takes the salt as it is."""
    one = lambda u: F.size(F.filter(cdf, lambda c: c <= u)).cast("long")
    more = F.transform(F.sequence(F.lit(1), parts - 1), lambda j: one(uniform(F.concat_ws("|", j.cast("string"), key.cast("string")), f"{salt}-part")))
    return one(uniform(key, salt)) + F.when(parts > 1, F.aggregate(more, F.lit(0).cast("long"), lambda acc, x: acc + x)).otherwise(F.lit(0).cast("long"))


def rates(docs: DataFrame, source_col: str, weights: Mapping[str, float] | None, total: float | None) -> DataFrame:
    """source, n, rate per source; unnamed sources weigh 1.0, null is a source of its own."""
    counts = cut(docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n")))
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        if w < 0:
            raise ValueError(f"weight of {name!r} is negative")
        weight = F.when(F.col("source") == name, float(w)).otherwise(weight)
    counts = counts.withColumn("weight", weight)
    sums = counts.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weights"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    goal = float(total) if total is not None else float(sums["rows"])
    rate = goal * F.col("weight") / sums["weights"] / F.col("n") if sums["weights"] > 0 else F.lit(0.0)
    return counts.select("source", "n", rate.alias("rate"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: Mapping[str, float] | None = None,
    total: float | None = None,
    seed: int = 42,
    most_broadcast: int = 10_000,
) -> DataFrame:
    """The input columns with rate, copy (0, 1, ...) and shuffle_key added, in global order of shuffle_key.

    total: expected output rows (default: as many as the input). Rows with a null id share
    one uniform number; repeated ids get equal counts. The table of sources is broadcast
    only if it has at most most_broadcast rows, else joined by a shuffle whose large
    partitions Spark splits. An input column that is itself named rate, copy or shuffle_key
    is kept under its name with ``_in`` added. Texts of any kind, null or empty too, pass
    through unread; an empty table gives an empty one.
    """
    found = rates(docs, source_col, weights, total)
    parts = F.greatest(F.ceil(F.col("rate") / MOST_MEAN), F.lit(1)).cast("int")
    known = found.select(F.col("source").alias("known"), "rate", parts.alias("parts"), poisson_cdf(F.col("rate") / parts).alias("cdf"))
    if small_enough(found, most_broadcast):
        known = F.broadcast(known)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"))
    counted = rows.join(known, F.col("source").eqNullSafe(F.col("known"))).select("row", "id", "rate", poisson(F.col("cdf"), F.col("parts"), F.col("id"), f"count-{seed}").alias("n")).where("n > 0")
    first, last = F.lit(0).cast("long"), F.col("n") - 1
    if (found.agg(F.max("rate").alias("most")).first()["most"] or 0.0) > _BLOCK:  # many copies of one row: dealt out in blocks
        counted = counted.withColumn("first", F.explode(F.sequence(first, last, F.lit(_BLOCK).cast("long")))).repartition("id", "first")
        first, last = F.col("first"), F.least(F.col("first") + _BLOCK - 1, last)
    copies = counted.select("row", "id", "rate", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("copy"))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(f"order-{seed}"), F.col("id").cast("string"), F.col("copy").cast("string"))))
    ordered = keyed.orderBy("shuffle_key", "id", "copy")
    return ordered.select(*[F.col("row")[c].alias(_free(c, docs.columns)) for c in docs.columns], "rate", "copy", "shuffle_key")


def _free(name: str, taken: list[str]) -> str:
    out = name
    while out in ("rate", "copy", "shuffle_key") or (out != name and out in taken):
        out += "_in"
    return out
