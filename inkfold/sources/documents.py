"""JSON documents, manifests and snapshots with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARGIN = "struct<enabled:boolean,top_mm:double,right_mm:double,bottom_mm:double,left_mm:double>"
NODE = "struct<id:string,type:string,name:string,visible:boolean,locked:boolean,x_mm:double,y_mm:double,width_mm:double,height_mm:double,opacity:double,parentId:string,fill:string,d:string>"
DOCUMENT = f"struct<id:string,version:string,profileId:string,dimensions:struct<width_mm:double,height_mm:double>,productionSettings:struct<bleed:{MARGIN},safetyMargin:{MARGIN}>,rootNodeIds:array<string>,nodes:map<string,{NODE}>>"
GOLDEN = "case_id string, route string, backend string, humanApproved boolean, stats struct<paths:bigint,subpaths:bigint,anchors:bigint,holes:bigint,svgSize:bigint>"


def parse(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """doc struct per row; text that is no document gives null."""
    return rows.withColumn("doc", F.from_json(json_col, DOCUMENT))


def nodes(parsed: DataFrame) -> DataFrame:
    """doc_id, is_root, and the node's fields, a row per node."""
    rows = parsed.where("doc IS NOT NULL").select(F.col("doc.id").alias("doc_id"), F.col("doc.rootNodeIds").alias("roots"), F.explode("doc.nodes").alias("key", "node"))
    return rows.select("doc_id", F.coalesce(F.array_contains("roots", F.col("key")), F.lit(False)).alias("is_root"), "node.*")


def manifest(documents: DataFrame, issues: DataFrame) -> DataFrame:
    """doc_id, manifest: JSON of node counts and validation summary per document."""
    counts = issues.groupBy("doc_id").agg(F.count("*").alias("issues"), F.sum(F.when(F.col("severity") == "error", 1).otherwise(0)).alias("errors"))
    nodes_of = documents.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.array_sort(F.collect_set("type")).alias("types"))
    joined = nodes_of.join(counts, "doc_id", "left").fillna(0, ["issues", "errors"])
    return joined.select("doc_id", F.to_json(F.struct("nodes", "types", "issues", "errors")).alias("manifest"))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLDEN).option("multiLine", True).option("mode", "FAILFAST").json(path)


def update_golden(golden: DataFrame, candidate: DataFrame, force: bool = False) -> DataFrame:
    """Golden rows with approved cases kept and others replaced by the candidate's; force replaces all that have one."""
    new = candidate.select("case_id", F.col("stats").alias("fresh"))
    keep = F.col("fresh").isNull() | (F.lit(not force) & F.coalesce("humanApproved", F.lit(False)))
    return golden.join(new, "case_id", "left").withColumn("stats", F.when(keep, F.col("stats")).otherwise(F.col("fresh"))).drop("fresh")


def snapshot_digest(labels: DataFrame) -> DataFrame:
    """image_id, digest: an order-independent fingerprint of a label map; equal maps have equal digests."""
    cell = F.xxhash64("x", "y", F.coalesce("label", F.lit(-1))).cast("decimal(38,0)")
    return labels.groupBy("image_id").agg(F.count("*").alias("cells"), F.sha2(F.sum(cell).cast("string"), 256).alias("digest"))
