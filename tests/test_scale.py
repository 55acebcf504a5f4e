"""Crowds of equal shapes: pairs are made of distinct ones, so that time and rows grow with the input and not with its square."""

import threading
import time

import pytest

from inkfold.operators import documents, governance, rings

COPIES = 60_000


@pytest.fixture
def soon(spark):
    """Jobs of a test that compares all copies with all are cancelled, which fails it."""
    timer = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    timer.start()
    began = time.perf_counter()
    yield
    timer.cancel()
    assert time.perf_counter() - began < 90


def crowd(spark, copies=COPIES):
    """Three boxes of one document again and again: small ones inside of middle ones inside of large ones, in the order of their numbers, and one in the next document."""
    boxes = spark.range(copies).selectExpr("CAST(1 AS BIGINT) AS doc_id", "id AS node_id", "10e0 * (2 - id % 3) AS x_mm", "10e0 * (2 - id % 3) AS y_mm", "20e0 + 40 * (id % 3) AS w_mm", "20e0 + 40 * (id % 3) AS h_mm")
    other = spark.range(1).selectExpr("CAST(2 AS BIGINT) AS doc_id", f"{copies} + id AS node_id", "0e0 AS x_mm", "0e0 AS y_mm", "100e0 AS w_mm", "100e0 AS h_mm")
    return boxes.unionByName(other).selectExpr("*", "'vector_path' AS type", "CAST(NULL AS STRING) AS fill")


def test_hole_provenance_of_copies(spark, soon):
    got = governance.hole_provenance(nodes=crowd(spark)).selectExpr("node_id % 3 AS kind", "front", "round(gap, 3) AS gap", "class").groupBy("kind", "front", "gap", "class").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 14.142, "COUNTERFORM", COPIES // 3), (1, 2, 14.142, "COUNTERFORM", COPIES // 3)]


def test_containment_tree_of_copies(spark, soon):
    got = rings.containment_tree(nodes=crowd(spark)).where("doc_id = 1").selectExpr("node_id % 3 AS kind", "parent_region", "depth").groupBy("kind", "parent_region", "depth").count().collect()
    third = COPIES // 3
    assert sorted(tuple(r) for r in got if r["kind"] < 2) == [(0, 1, 2 * third, third), (1, 2, third, third)]
    assert [tuple(r) for r in got if r["kind"] == 2] == [(2, None, 0, third)]


def test_component_correspondence_of_copies(spark, soon):
    nodes = crowd(spark)
    many = nodes.unionByName(nodes.where("doc_id = 1").selectExpr("CAST(2 AS BIGINT) AS doc_id", f"node_id + {COPIES + 1} AS node_id", "x_mm", "y_mm", "w_mm", "h_mm", "type", "fill"))
    got = documents.component_correspondence(nodes=many).selectExpr("a_id % 3 AS kind", "b_id", "iou", "centroid_distance").groupBy("kind", "b_id", "iou", "centroid_distance").count().collect()
    third = COPIES // 3
    assert sorted(tuple(r) for r in got) == [(0, COPIES + 1, 1.0, 0.0, third), (1, COPIES + 2, 1.0, 0.0, third), (2, COPIES, 1.0, 0.0, third)]
