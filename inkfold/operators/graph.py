"""Iterative operators: components, flood fill, merging, levels. Loops of set-based steps, lineage cut by checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, a temporary one only on a single machine where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        sc = spark.sparkContext
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="inkfold-"))
        folder = sc._jsc.sc().getCheckpointDir().get()
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read back: no lineage, and its true size for the plans of the next round.

    A checkpoint would carry the estimate of its plan along, which a loop of joins multiplies round by round.
    """
    path = f"{scratch_dir(df.sparkSession)}/inkfold-cut-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_WRITTEN: list[str] = []  # tables of cut() not yet discarded, oldest first


def scratch_mark() -> str | None:
    """The last table written, to which discard() can go back."""
    return _WRITTEN[-1] if _WRITTEN else None


def discard(spark: SparkSession, since: str | None = None) -> None:
    """Delete the tables that cut() wrote after a mark; for when results made from them are written or dropped. Queries that run at the same time need marks of one caller."""
    first = _WRITTEN.index(since) + 1 if since in _WRITTEN else 0
    for path in _WRITTEN[first:]:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    del _WRITTEN[first:]


MOST_SENT = 200_000  # rows of a table that a join may send through the driver


def few(df: DataFrame) -> DataFrame:
    """The table as it is where its rows are few, else to be joined by a shuffle: files of sorted numbers are small, and the planner would broadcast millions of rows by their size.

    Give it tables that cut() wrote, which are counted without being made again.
    """
    return df if df.limit(MOST_SENT + 1).count() <= MOST_SENT else df.hint("merge")


def _local_roots(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For every edge the smallest node of its component, among these edges alone."""
    pairs = np.stack([np.concatenate([group, group]), np.concatenate([a, b])], axis=1)
    nodes, at = np.unique(pairs, axis=0, return_inverse=True)
    at = at.reshape(-1)
    p, q = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[p], root[q])
        before = root.copy()
        np.minimum.at(root, root[p], low)
        np.minimum.at(root, root[q], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            return nodes[root[p], 1]


def _stars(edges: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, node, other: edges from every node to the smallest node of its component within an Arrow batch of neighbouring edges; long chains become stars before they are followed across batches."""
    slim = edges.where(F.col(a) != F.col(b)).select(*keys, F.col(a).cast("long").alias("node"), F.col(b).cast("long").alias("other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.zeros(batch.num_rows, np.int64)
            for k in range(len(keys)):
                group = np.unique(np.stack([group, pc.rank(batch.column(k), tiebreaker="dense").to_numpy().astype(np.int64)], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
            node, other = batch.column(len(keys)).to_numpy(), batch.column(len(keys) + 1).to_numpy()
            root = pa.array(_local_roots(group, node, other))
            names = [*keys, "node", "other"]
            for end in (len(keys), len(keys) + 1):
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], batch.column(end), root], names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema)
    near = slim.repartitionByRange(*keys, "node").sortWithinPartitions(*keys, "node", "other")
    return near.mapInArrow(run, schema).where("node <> other").distinct()


def components(edges: DataFrame, keys: list[str], a: str, b: str, most_rounds: int = 200) -> DataFrame:
    """keys, node, component: smallest node reachable over edges, within equal keys.

    Edges are first settled batch by batch. Then each round a node takes the smallest label
    among its neighbours and its label's own label, so a path of length n settles in about
    log n rounds. Nodes that only meet themselves are their own component.
    """
    loops = edges.where(F.col(a) == F.col(b)).select(*keys, F.col(a).cast("long").alias("node"), F.col(a).cast("long").alias("other"))
    star = cut(_stars(edges, keys, a, b).unionByName(loops))
    both = star.unionByName(star.select(*keys, F.col("other").alias("node"), F.col("node").alias("other"))).distinct()
    label = both.groupBy(*keys, "node").agg(F.least("node", F.min("other")).alias("component"))
    label = cut(label)
    joined = (lambda df: df) if few(label) is label else (lambda df: df.hint("merge"))  # rounds keep the number of nodes
    for _ in range(most_rounds):
        other = label.select(*keys, F.col("node").alias("other"), F.col("component").alias("theirs"))
        near = both.join(joined(other), [*keys, "other"]).groupBy(*keys, "node").agg(F.min("theirs").alias("theirs"))
        stepped = label.join(joined(near), [*keys, "node"]).select(*keys, "node", F.col("component").alias("was"), F.least("component", "theirs").alias("component"))
        root = stepped.select(*keys, F.col("node").alias("component"), F.col("component").alias("up"))
        jumped = cut(stepped.join(joined(root), [*keys, "component"], "left").select(*keys, "node", "was", F.least("component", "up").alias("component")))
        label = jumped.drop("was")
        if not jumped.where("was <> component").limit(1).count():
            return label
    raise RuntimeError("components did not settle")


def labelled_runs(cells: DataFrame, value: str = "label") -> DataFrame:
    """image_id, y, v, x0, x1, n, component: row runs of cells of one value with their 4-connected component.

    Cells are compressed to runs within a row first; runs that overlap in neighbouring
    rows are the edges, so the graph has a node per run, not per cell.
    """
    cells = cells.where(F.col(value).isNotNull()).select("image_id", "x", "y", F.col(value).alias("v"))
    runs = cells.sparkSession.sql("""
        WITH marked AS (SELECT *, CASE WHEN lag(x) OVER w = x - 1 AND lag(v) OVER w = v THEN 0 ELSE 1 END AS fresh FROM {cells} WINDOW w AS (PARTITION BY image_id, y ORDER BY x)),
        numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY image_id, y ORDER BY x) AS k FROM marked)
        SELECT image_id, y, v, min(x) AS x0, max(x) AS x1, count(*) AS n FROM numbered GROUP BY image_id, y, v, k""", cells=cells)
    runs = cut(runs.withColumn("node", F.col("y") * (1 << 31) + F.col("x0")))
    sent = few(runs)
    up = sent.select("image_id", (F.col("y") + 1).alias("y"), "v", F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("node").alias("up"))
    edges = runs.join(up, ["image_id", "y", "v"]).where("x0 <= u1 AND u0 <= x1").select("image_id", "node", "up")
    found = components(edges, ["image_id"], "node", "up")
    return runs.join(few(found), ["image_id", "node"], "left").withColumn("component", F.coalesce("component", "node")).drop("node")


def pixel_components(cells: DataFrame, value: str = "label") -> DataFrame:
    """image_id, component, value, area, bounds of 4-connected cells of one value."""
    return labelled_runs(cells, value).groupBy("image_id", "component", F.col("v").alias(value)).agg(
        F.sum("n").alias("area"), F.min("x0").alias("min_x"), F.max("x1").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y")
    )


def connected_components(shapes: DataFrame) -> DataFrame:
    """image_id, label, area and bounds of every 4-connected component."""
    return pixel_components(shapes).select("image_id", "label", "area", "min_x", "max_x", "min_y", "max_y")


def border_flood_fill(shapes: DataFrame) -> DataFrame:
    """Background components that touch the border of their image: the removable background; the others are holes."""
    width = shapes.groupBy("image_id").agg(F.max("x").alias("w"), F.max("y").alias("h"))
    free = pixel_components(shapes.where("label IS NULL").withColumn("free", F.lit(0).cast("long")), "free")
    return free.join(width, "image_id").select("image_id", "area", "min_x", "min_y", ((F.col("min_x") == 0) | (F.col("min_y") == 0) | (F.col("max_x") == F.col("w")) | (F.col("max_y") == F.col("h"))).alias("outside"))


def merge_regions(edges: DataFrame, colour: float = 0.09, weak: float = 0.20, strong: float = 0.45, coverage: float = 0.72) -> DataFrame:
    """image_id, region, merged: regions joined over weak, colour-compatible boundaries; the result does not depend on the order of edges, which are made once."""
    edges = cut(edges.select("image_id", "region_a", "region_b", "color_dist", "coverage_diff", "max_strength", "avg_strength"))
    ok = edges.where((F.col("color_dist") <= colour) & (F.col("coverage_diff") <= coverage) & (F.col("max_strength") < strong) & (F.col("avg_strength") <= weak))
    regions = edges.select("image_id", F.col("region_a").alias("region")).unionByName(edges.select("image_id", F.col("region_b").alias("region"))).distinct()
    found = components(ok, ["image_id"], "region_a", "region_b").withColumnRenamed("node", "region")
    return regions.join(found, ["image_id", "region"], "left").select("image_id", "region", F.coalesce("component", "region").alias("merged"))


def _doublings(steps: DataFrame) -> int:
    """Rounds of pointer jumping that reach over the largest plan."""
    largest = steps.groupBy("plan_id").count().agg(F.max("count")).first()[0] or 0
    return int(largest).bit_length() + 1


def step_levels(steps: DataFrame) -> DataFrame:
    """plan_id, step_id, level: 1 + the level of the step it depends on; steps on a cycle, after one or after a missing dependency get none.

    Every step doubles the distance it looks up in each round, so a chain of n steps takes about log n rounds.
    """
    rounds = _doublings(steps)
    state = cut(
        steps.select("plan_id", "step_id", F.col("depends_on").alias("up"), F.when(F.col("depends_on").isNull(), 0).otherwise(1).cast("long").alias("level"), F.lit(True).alias("rooted"))
    )
    for _ in range(rounds):
        above = state.select("plan_id", F.col("step_id").alias("up"), F.col("up").alias("up2"), F.col("level").alias("level2"), F.col("rooted").alias("rooted2"))
        joined = state.join(above, ["plan_id", "up"], "left")
        state = cut(
            joined.select(
                "plan_id", "step_id", F.col("up2").alias("up"), (F.col("level") + F.coalesce("level2", F.lit(0))).alias("level"),
                (F.col("rooted") & (F.col("up").isNull() | F.coalesce("rooted2", F.lit(False)))).alias("rooted"),
            )
        )
        if not state.where("up IS NOT NULL").limit(1).count():
            break
    return state.where("up IS NULL AND rooted").select("plan_id", "step_id", "level")


def blocked_steps(steps: DataFrame) -> DataFrame:
    """plan_id, step_id of steps that a failed or blocked step is under, at any distance, and that are not completed; a completed step between ends the reach."""
    rounds = _doublings(steps)
    above = steps.select("plan_id", F.col("step_id").alias("depends_on"), F.col("status").alias("over"))
    state = cut(
        steps.where("status <> 'COMPLETED'")
        .join(above, ["plan_id", "depends_on"], "left")
        .select("plan_id", "step_id", F.col("depends_on").alias("up"), F.coalesce(F.col("over").isin("FAILED", "BLOCKED"), F.lit(False)).alias("hit"))
    )
    for _ in range(rounds):
        over = state.select("plan_id", F.col("step_id").alias("up"), F.col("up").alias("up2"), F.col("hit").alias("hit2"))
        state = cut(
            state.join(over, ["plan_id", "up"], "left").select("plan_id", "step_id", F.col("up2").alias("up"), (F.col("hit") | F.coalesce("hit2", F.lit(False))).alias("hit"))
        )
        if not state.where("up IS NOT NULL").limit(1).count():
            break
    return state.where("hit").select("plan_id", "step_id").distinct()
