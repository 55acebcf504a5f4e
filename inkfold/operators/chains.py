"""Chains and rings of linked edges: order along next-links without a group per image or document.

Edges are followed inside tiles first, one task a tile; what leaves a tile is a chain of a
known length, and only chains are followed across tiles, by pointer doubling.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.operators.graph import cut


def _heads(up: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Furthest predecessor and distance to it over 2**rounds steps; a head is its own predecessor."""
    far = (up != np.arange(len(up))).astype(np.int64)
    for _ in range(rounds):
        far = far + far[up]
        up = up[up]
    return up, far


def follow_local(e: np.ndarray, nxt: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """chain (number of its first edge), place in it, whether it closes here, and whether the edge is the last of an open chain."""
    order = np.argsort(e, kind="stable")
    inside = np.zeros(len(e), bool)
    at = np.minimum(np.searchsorted(e[order], nxt), len(e) - 1)
    inside = linked & (e[order][at] == nxt)
    target = order[at]
    up = np.arange(len(e))
    up[target[inside]] = np.flatnonzero(inside)
    rounds = int(len(e)).bit_length() + 1
    head, far = _heads(up.copy(), rounds)
    closed = up[head] != head  # no head was reached: a ring inside the tile
    if closed.any():
        low, step = e.copy(), up.copy()
        for _ in range(rounds):
            low = np.minimum(low, low[step])
            step = step[step]
        first = closed & (e == low)
        up[first] = np.flatnonzero(first)
        again, far2 = _heads(up.copy(), rounds)
        head, far = np.where(closed, again, head), np.where(closed, far2, far)
    return e[head], far, closed | (linked & (nxt == e)), ~inside


def follow(links: DataFrame, keys: list[str], tile: list[str], carry: tuple[str, ...] = (), most_rounds: int = 64) -> DataFrame:
    """keys, e, carry, ring, pos, n, closed: place of every edge on its ring or open chain.

    links: keys (long), tile columns, e (long, unique within keys), nxt (long or null),
    carried columns (long); an edge follows at most one other. ring is the number of the first edge: of an open chain
    its head, of a ring the smallest edge of the first chain found to close it.
    """
    names = [*keys, *tile]

    def local(rows: pa.Table) -> pa.Table:
        e = rows.column("e").to_numpy()
        nxt = rows.column("nxt").combine_chunks()
        chain, far, closed, last = follow_local(e, nxt.fill_null(0).to_numpy(zero_copy_only=False), nxt.is_valid().to_numpy(zero_copy_only=False))
        out = pa.array(nxt.fill_null(0).to_numpy(zero_copy_only=False), mask=~(last & nxt.is_valid().to_numpy(zero_copy_only=False)))
        return pa.table([*(rows.column(k) for k in [*keys, *carry]), rows.column("e"), pa.array(chain), pa.array(far), pa.array(closed), out], names=[*keys, *carry, "e", "chain", "off", "closed", "out"])

    schema = ", ".join(f"{k} long" for k in [*keys, *carry]) + ", e long, chain long, off long, closed boolean, out long"
    edges = cut(links.select(*names, *carry, "e", "nxt").groupBy(*names).applyInArrow(local, schema))
    chains = cut(edges.groupBy(*keys, "chain").agg(F.count("*").alias("len"), F.max("out").alias("out"), F.first("closed").alias("closed")))
    loose = chains.where("NOT closed")
    if loose.where("out IS NOT NULL").limit(1).count():
        placed = _across(loose, keys, most_rounds)
        placed = placed.unionByName(chains.where("closed").select(*keys, "chain", F.col("chain").alias("ring"), F.lit(0).cast("long").alias("base"), "closed"))
    else:
        placed = chains.select(*keys, "chain", F.col("chain").alias("ring"), F.lit(0).cast("long").alias("base"), "closed")
    sizes = placed.join(chains.select(*keys, "chain", "len"), [*keys, "chain"]).groupBy(*keys, "ring").agg(F.sum("len").alias("n"))
    found = placed.join(sizes, [*keys, "ring"])
    return edges.drop("closed", "out").join(found, [*keys, "chain"]).select(*keys, "e", *carry, "ring", (F.col("base") + F.col("off")).alias("pos"), "n", "closed")


def _doubled(state: DataFrame, keys: list[str], most_rounds: int) -> DataFrame:
    """keys, chain, up, base, low after every chain has looked up to its head, or all round its ring."""
    size = state.groupBy(*keys).count().agg(F.max("count")).first()[0]
    for _ in range(min(most_rounds, int(size).bit_length() + 1)):
        above = state.select(*keys, F.col("chain").alias("up"), F.col("up").alias("up2"), F.col("base").alias("base2"), F.col("low").alias("low2"), F.col("head").alias("head2"))
        state = cut(
            state.join(above, [*keys, "up"], "left").select(
                *keys, "chain", F.col("up2").alias("up"), (F.col("base") + F.coalesce("base2", F.lit(0))).alias("base"),
                F.least("low", F.coalesce("low2", "low")).alias("low"), F.coalesce("head2", "head").alias("head"),
            )
        )
        if not state.where("up IS NOT NULL").limit(1).count():
            break
    return state


def _across(loose: DataFrame, keys: list[str], most_rounds: int) -> DataFrame:
    """keys, chain, ring, base, closed of chains that go on in other tiles."""
    before = loose.where("out IS NOT NULL").select(*keys, F.col("out").alias("chain"), F.col("chain").alias("up"), F.col("len").alias("base"))
    linked = cut(loose.select(*keys, "chain").join(before, [*keys, "chain"], "left"))
    start = linked.select(*keys, "chain", "up", F.coalesce("base", F.lit(0)).alias("base"), F.col("chain").alias("low"), F.when(F.col("up").isNull(), F.col("chain")).alias("head"))
    state = _doubled(start, keys, most_rounds)
    opened = state.where("up IS NULL").select(*keys, "chain", F.coalesce("head", "chain").alias("ring"), "base", F.lit(False).alias("closed"))
    round_trip = state.where("up IS NOT NULL").select(*keys, "chain", "low")
    if not round_trip.limit(1).count():
        return opened
    # A ring is cut before its smallest chain and measured from there.
    first = F.col("chain") == F.col("low")
    again = round_trip.join(linked, [*keys, "chain"]).select(
        *keys, "chain", F.when(~first, F.col("up")).alias("up"), F.when(first, F.lit(0).cast("long")).otherwise(F.col("base")).alias("base"), "low", F.when(first, F.col("chain")).alias("head")
    )
    ringed = _doubled(again, keys, most_rounds)
    return opened.unionByName(ringed.select(*keys, "chain", F.col("low").alias("ring"), "base", F.lit(True).alias("closed")))
