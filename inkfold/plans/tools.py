"""Named transforms, composite plans and receipts: the extension surface.

A tool is a function DataFrame -> DataFrame with an effect class. Registering a tool
again replaces it; skills (ordered plans of tools) refuse duplicates. A plan runs its
steps in order of dependency and skips those that a receipt marks as done.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EFFECTS = ("selection", "document_mutation", "read_only")
Transform = Callable[..., DataFrame]


@dataclass(frozen=True)
class Tool:
    name: str
    effect: str
    run: Transform
    needs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Step:
    step_id: str
    tool: str
    args: dict = field(default_factory=dict)
    depends_on: tuple[str, ...] = ()


class Registry:
    def __init__(self) -> None:
        self.tools: dict[str, Tool] = {}
        self.skills: dict[str, list[Step]] = {}

    def tool(self, name: str, effect: str, needs: tuple[str, ...] = ()) -> Callable[[Transform], Transform]:
        if effect not in EFFECTS:
            raise ValueError(f"effect must be one of {EFFECTS}")

        def add(run: Transform) -> Transform:
            self.tools[name] = Tool(name, effect, run, needs)
            return run

        return add

    def skill(self, name: str, steps: list[Step]) -> None:
        if name in self.skills:
            raise ValueError(f"skill {name!r} is already registered")
        missing = sorted({s.tool for s in steps} - set(self.tools))
        if missing:
            raise ValueError(f"unknown tools: {missing}")
        self.skills[name] = ordered(steps)

    def execute(self, nodes: DataFrame, steps: list[Step], done: set[str] = frozenset()) -> tuple[DataFrame, list[tuple[str, str]]]:
        """The nodes after all steps, and a receipt (step, status) each; a step whose tool lacks a column is blocked with all that depend on it."""
        receipts: list[tuple[str, str]] = []
        state: dict[str, str] = {}
        for step in ordered(steps):
            tool = self.tools[step.tool]
            if step.step_id in done:
                state[step.step_id] = "SKIPPED"
            elif any(state.get(d) == "BLOCKED" for d in step.depends_on) or not set(tool.needs) <= set(nodes.columns):
                state[step.step_id] = "BLOCKED"
            else:
                out = tool.run(nodes, **step.args)
                nodes = nodes if tool.effect == "read_only" else out
                state[step.step_id] = "COMPLETED"
            receipts.append((step.step_id, state[step.step_id]))
        return nodes, receipts


def ordered(steps: list[Step]) -> list[Step]:
    """Steps after those they depend on, else in the given order; a cycle or an unknown dependency raises ValueError."""
    known = {s.step_id for s in steps}
    if any(d not in known for s in steps for d in s.depends_on):
        raise ValueError("a step depends on an unknown step")
    out, placed = [], set()
    while len(out) < len(steps):
        ready = [s for s in steps if s.step_id not in placed and set(s.depends_on) <= placed]
        if not ready:
            raise ValueError("steps depend on each other in a cycle")
        out.append(ready[0])
        placed.add(ready[0].step_id)
    return out


DEFAULT = Registry()


@DEFAULT.tool("select_by_fill", "selection", ("fill",))
def select_by_fill(nodes: DataFrame, fill: str) -> DataFrame:
    return nodes.where(F.lower(F.trim("fill")) == fill.lower())


@DEFAULT.tool("replace_fill", "document_mutation", ("fill",))
def replace_fill(nodes: DataFrame, old: str, new: str) -> DataFrame:
    return nodes.withColumn("fill", F.when(F.lower(F.trim("fill")) == old.lower(), F.lit(new)).otherwise(F.col("fill")))


@DEFAULT.tool("delete_nodes", "document_mutation", ("node_id",))
def delete_nodes(nodes: DataFrame, node_ids: list[int]) -> DataFrame:
    return nodes.where(~F.col("node_id").isin(node_ids))


@DEFAULT.tool("group_nodes", "document_mutation", ("node_id", "parent_id"))
def group_nodes(nodes: DataFrame, node_ids: list[int], group_id: int) -> DataFrame:
    kind = nodes.schema["parent_id"].dataType
    return nodes.withColumn("parent_id", F.when(F.col("node_id").isin(node_ids), F.lit(group_id).cast(kind)).otherwise(F.col("parent_id")))


@DEFAULT.tool("ungroup", "document_mutation", ("parent_id",))
def ungroup(nodes: DataFrame, group_id: int) -> DataFrame:
    return nodes.withColumn("parent_id", F.when(F.col("parent_id") == group_id, None).otherwise(F.col("parent_id")))


@DEFAULT.tool("move", "document_mutation", ("x_mm", "y_mm"))
def move(nodes: DataFrame, dx: float, dy: float) -> DataFrame:
    return nodes.withColumns({"x_mm": F.col("x_mm") + dx, "y_mm": F.col("y_mm") + dy})


@DEFAULT.tool("remove_invisible", "document_mutation", ("visible", "opacity", "fill", "stroke"))
def remove_invisible(nodes: DataFrame) -> DataFrame:
    unseen = ~F.col("visible") | (F.col("opacity") <= 0) | (F.col("fill").isNull() & F.col("stroke").isNull())
    return nodes.where(~((F.col("type") == "vector_path") & unseen))


@DEFAULT.tool("minimum_stroke", "document_mutation", ("stroke_mm",))
def minimum_stroke(nodes: DataFrame, least_mm: float) -> DataFrame:
    return nodes.withColumn("stroke_mm", F.when(F.col("stroke").isNotNull(), F.greatest("stroke_mm", F.lit(least_mm))).otherwise(F.col("stroke_mm")))


@DEFAULT.tool("summary", "read_only", ("type",))
def summary(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").count()


DEFAULT.skill("clean_artwork", [Step("drop", "remove_invisible"), Step("strokes", "minimum_stroke", {"least_mm": 0.25}, ("drop",)), Step("report", "summary", {}, ("strokes",))])
