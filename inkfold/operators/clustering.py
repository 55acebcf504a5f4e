"""Colour clusters of images with a mask each, whatever the order of pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfold.functions import expressions as E
from inkfold.operators.graph import cut


def partial_clusters(pixels: DataFrame) -> DataFrame:
    """image_id, cell, n, r, g, b, l, ca, cb: visible pixels by cells of five bits a channel, 32,768 at most an image, with mean colour and its Oklab.

    Sums of whole numbers, so partial results of any partitioning merge to the same means.
    """
    cell = F.expr("CAST(floor(r / 8) * 1024 + floor(g / 8) * 32 + floor(b / 8) AS BIGINT)")
    sums = pixels.where("a > 0").groupBy("image_id", cell.alias("cell")).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{c}") for c in "rgb"])
    mean = sums.selectExpr("image_id", "cell", "n", *(f"s{c} / n AS {c}" for c in "rgb"))
    ok = E.oklab("r", "g", "b")
    return mean.selectExpr("*", *(f"{E.rounded(e, 9)} AS {n}" for e, n in zip(ok, ("l", "ca", "cb"), strict=True)))


def leaders(parts: DataFrame, threshold: float) -> DataFrame:
    """image_id, leader, cell: every partial cluster with its nearest leader.

    Clusters rank by size, then cell. One leads if no leader of higher rank lies within the
    threshold, as if they were taken one after the other; here all whose higher neighbours
    are settled are settled at once, round after round. Neighbours are found in grid cells of
    the threshold's size. Ties between leaders go to the higher rank.
    """
    grid = parts.selectExpr("image_id", "cell", "n", "l", "ca", "cb", *(f"CAST(floor({c} / {threshold}) AS BIGINT) AS g{k}" for k, c in enumerate(("l", "ca", "cb"))))
    around = grid
    for k in range(3):
        around = around.withColumn(f"g{k}", F.explode(F.expr(f"array(g{k} - 1, g{k}, g{k} + 1)")))
    names = ["cell", "n", "l", "ca", "cb"]
    other = grid.select("image_id", "g0", "g1", "g2", *(F.col(c).alias(f"o_{c}") for c in names))
    gap = "sqrt((l - o_l) * (l - o_l) + (ca - o_ca) * (ca - o_ca) + (cb - o_cb) * (cb - o_cb))"
    near = around.join(other, ["image_id", "g0", "g1", "g2"]).where(f"cell <> o_cell AND {gap} <= {threshold}")
    near = cut(near.selectExpr("image_id", "cell", "o_cell AS high", "o_n AS high_n", f"{E.rounded(gap, 9)} AS gap", "o_n > n OR (o_n = n AND o_cell < cell) AS above"))
    above = near.where("above").select("image_id", "cell", "high")
    state = cut(parts.select("image_id", "cell", F.lit(None).cast("boolean").alias("leads")))
    while state.where("leads IS NULL").limit(1).count():
        told = above.join(state.select("image_id", F.col("cell").alias("high"), F.col("leads").alias("high_leads")), ["image_id", "high"])
        seen = told.groupBy("image_id", "cell").agg(F.max(F.coalesce("high_leads", F.lit(False))).alias("beaten"), F.count(F.when(F.col("high_leads").isNull(), 1)).alias("open"))
        decided = F.when(F.coalesce("beaten", F.lit(False)), F.lit(False)).when(F.coalesce("open", F.lit(0)) == 0, F.lit(True))
        state = cut(state.join(seen, ["image_id", "cell"], "left").select("image_id", "cell", F.coalesce("leads", decided).alias("leads")))
    heads = state.where("leads").select("image_id", F.col("cell").alias("high"))
    joined = near.join(heads, ["image_id", "high"]).groupBy("image_id", "cell").agg(F.min(F.struct("gap", (-F.col("high_n")).alias("size"), "high"))["high"].alias("leader"))
    return state.join(joined, ["image_id", "cell"], "left").select("image_id", F.when(F.col("leads"), F.col("cell")).otherwise(F.col("leader")).alias("leader"), "cell")


def colour_masks(pixels: DataFrame, threshold: float = 0.025) -> DataFrame:
    """image_id, cluster, r, g, b, pixels, coverage, min_x, min_y, max_x, max_y: clusters of visible colours by size, mean colour, share of the visible pixels and box of their mask.

    Transparent pixels belong to no mask; an image without visible pixels has none.
    """
    marked = mask_pixels(pixels, threshold)
    sums = marked.groupBy("image_id", "leader").agg(F.count("*").alias("pixels"), *[F.sum(c).alias(f"s{c}") for c in "rgb"], F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))
    image, order = Window.partitionBy("image_id"), Window.partitionBy("image_id").orderBy(F.desc("pixels"), "leader")
    ranked = sums.withColumns({"cluster": (F.row_number().over(order) - 1).cast("long"), "coverage": F.col("pixels") / F.sum("pixels").over(image)})
    return ranked.selectExpr("image_id", "cluster", *(f"CAST(floor(s{c} / pixels + 0.5) AS BIGINT) AS {c}" for c in "rgb"), "pixels", f"{E.rounded('coverage')} AS coverage", "min_x", "min_y", "max_x", "max_y")


def mask_pixels(pixels: DataFrame, threshold: float = 0.025) -> DataFrame:
    """image_id, x, y, r, g, b, leader: the mask of every visible pixel."""
    found = leaders(cut(partial_clusters(pixels)), threshold)
    cell = F.expr("CAST(floor(r / 8) * 1024 + floor(g / 8) * 32 + floor(b / 8) AS BIGINT)")
    return pixels.where("a > 0").select("image_id", "x", "y", "r", "g", "b", cell.alias("cell")).join(found, ["image_id", "cell"]).select("image_id", "x", "y", "r", "g", "b", "leader")
