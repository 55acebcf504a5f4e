"""Small fragments given to the neighbour whose colour they belong to, under an invariant of covered area."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfold.functions import expressions as E
from inkfold.operators.graph import cut

#: Fills that count as background. Fixed values.
WHITES = ("#ffffff", "#fefefe")
_REACH = 2.5


def _areas(outlines: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id", "ring_id").orderBy("pos")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sides = outlines.select("doc_id", "ring_id", "x", "y", *(F.coalesce(F.lead(c).over(order), F.first(c).over(whole)).alias(f"n{c}") for c in ("x", "y")))
    return sides.groupBy("doc_id", "ring_id").agg(F.abs(F.sum(F.expr("x * ny - nx * y")) / 2).alias("area"))


def _channels(fill: str) -> list[str]:
    return [f"CAST(conv(substr({fill}, {k}, 2), 16, 10) AS DOUBLE)" for k in (2, 4, 6)]


def reassign_fragments(outlines: DataFrame, fills: DataFrame, least_area: float = 25.0, confidence: float = 0.5, most_change: float = 5.0) -> DataFrame:
    """doc_id, ring_id, area, fill, owner, score, confidence, action: every fragment below least_area with the colour it should have.

    outlines(doc_id, ring_id, pos, x, y); fills(doc_id, ring_id, fill '#rrggbb', r, g, b of the
    picture under it). Owners are the colours of larger rings with a point within 2.5 of one of
    the fragment's, white ones only if there is no other. A colour scores 20 for every pair of
    points closer than 1, up to 10 by its least distance and up to 50 by how near it is to the
    picture in CIELAB; ties go to the smaller colour. The best is taken if its hundredth reaches
    the confidence. Shapes keep their outline, so only area that turns white or ceases to be
    white can be lost: a document whose area that is not white would change by more than
    most_change keeps the fills of the fragments that change it (ROLLED_BACK).
    Points meet in grid cells of the reach, so documents spread over tasks.
    """
    rings = cut(_areas(outlines).join(fills, ["doc_id", "ring_id"]))
    small, large = rings.where(F.col("area") < least_area), rings.where(F.col("area") >= least_area)
    spots = outlines.selectExpr("doc_id", "ring_id", "x", "y", f"CAST(floor(x / {_REACH}) AS BIGINT) AS cx", f"CAST(floor(y / {_REACH}) AS BIGINT) AS cy")
    mine = spots.join(small.select("doc_id", "ring_id"), ["doc_id", "ring_id"])
    around = mine.selectExpr("doc_id", "ring_id", "x", "y", "cx", "explode(array(cy - 1, cy, cy + 1)) AS cy").selectExpr("doc_id", "ring_id", "x", "y", "explode(array(cx - 1, cx, cx + 1)) AS cx", "cy")
    theirs = spots.join(large.select("doc_id", "ring_id", "fill"), ["doc_id", "ring_id"]).select("doc_id", "cx", "cy", F.col("fill").alias("owner"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    gap = "sqrt((x - ox) * (x - ox) + (y - oy) * (y - oy))"
    met = around.join(theirs, ["doc_id", "cx", "cy"]).where(f"{gap} < {_REACH}").groupBy("doc_id", "ring_id", "owner").agg(F.count(F.when(F.expr(f"{gap} < 1"), 1)).alias("shared"), F.min(F.expr(gap)).alias("least"))
    white = F.col("owner").isin(*WHITES)
    coloured = F.max(~white).over(Window.partitionBy("doc_id", "ring_id"))
    offers = met.withColumn("coloured", coloured).where(~F.col("coloured") | ~white).join(small, ["doc_id", "ring_id"])
    own, under = E.cielab("o0", "o1", "o2"), E.cielab("r", "g", "b")
    off = E.distance(*zip(own, under, strict=True))
    wide = offers.selectExpr("*", *(f"{c} AS o{k}" for k, c in enumerate(_channels("owner"))))
    scored = wide.selectExpr("doc_id", "ring_id", "owner", f"round(20 * shared + greatest(0e0, 10 - 2 * least) + greatest(0e0, 50 - {off}), 6) AS score")
    best = scored.groupBy("doc_id", "ring_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "owner")).alias("b")).selectExpr("doc_id", "ring_id", "-b.s AS score", "b.owner")
    sure = F.when(F.col("score") > 10, F.least(F.lit(1.0), F.col("score") / 100)).otherwise(0.0)
    told = small.join(best, ["doc_id", "ring_id"], "left").withColumn("confidence", F.coalesce(sure, F.lit(0.0)))
    told = told.withColumn("moves", F.coalesce((F.col("confidence") >= confidence) & (F.col("owner") != F.col("fill")), F.lit(False)))
    is_white = lambda c: F.col(c).isin(*WHITES).cast("int")
    change = F.when(F.col("moves"), (is_white("fill") - is_white("owner")) * F.col("area")).otherwise(0.0)
    kept = told.withColumn("change", change).withColumn("off", F.abs(F.sum("change").over(Window.partitionBy("doc_id"))) > most_change)
    action = F.when(~F.col("moves"), "PRESERVED").when(F.col("off") & (F.col("change") != 0), "ROLLED_BACK").otherwise("REASSIGNED")
    return kept.withColumn("action", action).select(
        "doc_id", "ring_id", F.round("area", 6).alias("area"), "fill", F.when(F.col("action") == "REASSIGNED", F.col("owner")).otherwise(F.col("fill")).alias("owner"), "score", F.round("confidence", 6).alias("confidence"), "action"
    )
