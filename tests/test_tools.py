import pytest

from inkfold.plans.tools import DEFAULT, Registry, Step, ordered

SCHEMA = "node_id long, type string, parent_id long, fill string, stroke string, stroke_mm double, visible boolean, opacity double, x_mm double, y_mm double"
ROWS = [(1, "vector_path", None, "#AAAAAA ", "#000", 0.1, True, 1.0, 0.0, 0.0), (2, "vector_path", 9, None, None, 0.5, True, 1.0, 1.0, 1.0), (3, "group", None, None, None, 0.0, False, 0.0, 2.0, 2.0)]


def test_tools(spark):
    nodes = spark.createDataFrame(ROWS, SCHEMA)
    run = lambda *steps, done=frozenset(): DEFAULT.execute(nodes, list(steps), done)
    out, receipts = run(Step("a", "replace_fill", {"old": "#aaaaaa", "new": "#111111"}), Step("b", "move", {"dx": 1.0, "dy": 2.0}, ("a",)), Step("c", "group_nodes", {"node_ids": [1], "group_id": 9}))
    assert receipts == [("a", "COMPLETED"), ("b", "COMPLETED"), ("c", "COMPLETED")]
    assert [tuple(r) for r in out.select("node_id", "fill", "x_mm", "parent_id").orderBy("node_id").collect()] == [(1, "#111111", 1.0, 9), (2, None, 2.0, 9), (3, None, 3.0, None)]
    out, receipts = run(Step("a", "delete_nodes", {"node_ids": [1]}), Step("b", "ungroup", {"group_id": 9}), done={"a"})
    assert receipts == [("a", "SKIPPED"), ("b", "COMPLETED")] and out.count() == 3 and out.where("parent_id IS NOT NULL").count() == 0
    out, _ = DEFAULT.execute(nodes, DEFAULT.skills["clean_artwork"])
    assert sorted(tuple(r) for r in out.select("node_id", "stroke_mm").collect()) == [(1, 0.25), (3, 0.0)]


def test_blocked_steps_block_what_follows(spark):
    nodes = spark.createDataFrame([(1, "x")], "node_id long, type string")
    _, receipts = DEFAULT.execute(nodes, [Step("b", "summary", {}, ("a",)), Step("a", "move", {"dx": 1.0, "dy": 1.0})])
    assert receipts == [("a", "BLOCKED"), ("b", "BLOCKED")]


def test_registration_rules():
    r = Registry()
    r.tool("t", "read_only")(lambda n: n)
    r.tool("t", "selection")(lambda n: n)
    assert r.tools["t"].effect == "selection"
    r.skill("s", [Step("a", "t")])
    with pytest.raises(ValueError):
        r.skill("s", [Step("a", "t")])
    with pytest.raises(ValueError):
        r.tool("u", "other")
    with pytest.raises(ValueError):
        ordered([Step("a", "t", {}, ("b",)), Step("b", "t", {}, ("a",))])
    with pytest.raises(ValueError):
        ordered([Step("a", "t", {}, ("z",))])
