"""Registered queries of the reference's operators over the derived relations."""

from __future__ import annotations

from inkfold.operators import curves, documents, golden, governance, graph, kernels, masks, prepress, raster, regions, rings, selection
from inkfold.operators.template import Operator
from inkfold.plans.oracles import ORACLES
from inkfold.plans.registry import register
from inkfold.plans.views import oracle, view
from inkfold.sources import documents as json_documents
from inkfold.sources import package, png
from inkfold.streaming import telemetry


# Operators shown on a derived relation of another name than their input.
_SHOWN_ON = {"path_simplify": {"rings": "worn_rings"}, "mixture_endpoint": {"pixels": "blended"}, "palette_snap": {"pixels": "blended"}}

# Relations that a query reads more than once, directly or through others: written once, in this order.
_HELD = {"prepress_issues": ("path_points", "cut_rings", "cut_checks")}


def _declared(name: str, operator: Operator) -> None:
    shown = {n: _SHOWN_ON.get(name, {}).get(n, n) for n in operator.inputs}

    def query(spark, sf_dir):
        held = {}
        for v in _HELD.get(name, ()):
            held[v] = graph.cut(view(spark, sf_dir, v, held))
        return operator(**{n: view(spark, sf_dir, v, held) for n, v in shown.items()})

    # The operator's own text names its inputs; an oracle of its own names what it is shown on.
    text = ORACLES.get(name) or operator.text.format(**shown).replace("/*g*/", ", 'g'")
    register(name, query, oracle(text, list(shown.values())))


for _module in (raster, masks, regions, rings, curves, documents, golden, prepress, governance, selection):
    for _name, _value in list(vars(_module).items()):
        if isinstance(_value, Operator) and not _name.startswith("_"):
            _declared(_name, _value)

# Operators on rings that measure equal ones once.
for _measure in (rings.chamfer_hausdorff, rings.point_in_ring, curves.point_to_segment, curves.boundary_distance, curves.shared_edge_absorption):
    register(_measure.__name__, lambda spark, sf_dir, f=_measure: f(view(spark, sf_dir, "rings")), oracle(ORACLES[_measure.__name__], ["rings"]))

_CC = """
WITH cells AS (SELECT image_id, y * 64 + x AS id, x, y, {value} AS v FROM shapes WHERE {value} IS NOT NULL),
links AS (SELECT a.image_id, a.id AS p, b.id AS q FROM cells a JOIN cells b ON b.image_id = a.image_id AND b.v = a.v AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
walk AS (SELECT image_id, id, id AS root FROM cells UNION SELECT w.image_id, l.q AS id, w.root FROM walk w JOIN links l ON l.image_id = w.image_id AND l.p = w.id AND l.q > w.root),
roots AS (SELECT image_id, id, min(root) AS root FROM walk GROUP BY image_id, id)
SELECT image_id, label, CAST(count(*) AS BIGINT) AS area, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y
FROM (SELECT r.image_id, r.root, c.v AS label, c.x, c.y FROM roots r JOIN cells c ON c.image_id = r.image_id AND c.id = r.id) q GROUP BY image_id, root, label"""
register(
    "connected_components",
    lambda spark, sf_dir: graph.connected_components(view(spark, sf_dir, "shapes")),
    oracle(_CC.format(value="label"), ["shapes"], recursive=True),
)

register(
    "accent_components",
    lambda spark, sf_dir: graph.connected_components(view(spark, sf_dir, "accents")),
    oracle(_CC.format(value="label").replace("FROM shapes", "FROM accents"), ["accents"], recursive=True),
)

# Runs of background per row keep the recursion short: a component is walked from the runs that touch the border.
_FLOOD = """
WITH cells AS (SELECT image_id, x, y FROM shapes WHERE label IS NULL),
marked AS (SELECT *, CASE WHEN lag(x) OVER (PARTITION BY image_id, y ORDER BY x) = x - 1 THEN 0 ELSE 1 END AS fresh FROM cells),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY image_id, y ORDER BY x) AS k FROM marked),
runs AS (SELECT image_id, y, y * 1000000 + min(x) AS id, min(x) AS x0, max(x) AS x1, count(*) AS n FROM numbered GROUP BY image_id, y, k),
links AS (SELECT a.image_id, a.id AS p, b.id AS q FROM runs a JOIN runs b ON b.image_id = a.image_id AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1),
walk AS (SELECT image_id, id, id AS root FROM runs UNION SELECT w.image_id, l.q, w.root FROM walk w JOIN links l ON l.image_id = w.image_id AND l.p = w.id AND l.q > w.root),
roots AS (SELECT image_id, id, min(root) AS root FROM walk GROUP BY image_id, id),
size AS (SELECT image_id, max(x) AS w, max(y) AS h FROM shapes GROUP BY image_id),
parts AS (SELECT r.image_id, r.root, sum(n) AS area, min(x0) AS x0, max(x1) AS x1, min(y) AS y0, max(y) AS y1 FROM roots r JOIN runs USING (image_id, id) GROUP BY r.image_id, r.root)
SELECT p.image_id, CAST(area AS BIGINT) AS area, x0 AS min_x, y0 AS min_y, x0 = 0 OR y0 = 0 OR x1 = w OR y1 = h AS outside FROM parts p JOIN size s ON s.image_id = p.image_id"""
register("border_flood_fill", lambda spark, sf_dir: graph.border_flood_fill(view(spark, sf_dir, "shapes")), oracle(_FLOOD, ["shapes"], recursive=True))

def _merge(spark, sf_dir):
    return graph.merge_regions(regions.rag_edges(**{n: view(spark, sf_dir, n) for n in regions.rag_edges.inputs}))


register("merge_regions", _merge, oracle(ORACLES["merge_regions"].replace("WITH RECURSIVE", "WITH", 1), ["pixels", "labels_map"], recursive=True))

_LEVELS = """
WITH levels AS (
  SELECT plan_id, step_id, CAST(0 AS BIGINT) AS level FROM steps WHERE depends_on IS NULL
  UNION ALL SELECT s.plan_id, s.step_id, l.level + 1 FROM levels l JOIN steps s ON s.plan_id = l.plan_id AND s.depends_on = l.step_id
)
SELECT plan_id, step_id, level FROM levels"""
register("step_levels", lambda spark, sf_dir: graph.step_levels(view(spark, sf_dir, "steps")), oracle(_LEVELS, ["steps"], recursive=True))

_BLOCKED = """
WITH stuck AS (
  SELECT plan_id, step_id, 0 AS far FROM steps WHERE status IN ('FAILED', 'BLOCKED')
  UNION ALL SELECT s.plan_id, s.step_id, k.far + 1 FROM stuck k JOIN steps s ON s.plan_id = k.plan_id AND s.depends_on = k.step_id AND s.status <> 'COMPLETED'
)
SELECT DISTINCT plan_id, step_id FROM stuck WHERE far > 0"""
register("blocked_steps", lambda spark, sf_dir: graph.blocked_steps(view(spark, sf_dir, "steps")), oracle(_BLOCKED, ["steps"], recursive=True))

register("diverse_palette", lambda spark, sf_dir: kernels.diverse_palette(view(spark, sf_dir, "colours")))

register("png_round_trip", lambda spark, sf_dir: png.write_images(view(spark, sf_dir, "pixels")).selectExpr("image_id", "width", "height", "length(png) AS bytes"))
register(
    "document_manifest",
    lambda spark, sf_dir: json_documents.manifest(
        view(spark, sf_dir, "nodes"), documents.validation_issues(**{n: view(spark, sf_dir, n) for n in documents.validation_issues.inputs})
    ),
)
register("cut_lines", lambda spark, sf_dir: package.cut_lines(view(spark, sf_dir, "cut_rings"), view(spark, sf_dir, "docs")))


def _packages(spark, sf_dir):
    docs, nodes = view(spark, sf_dir, "docs"), view(spark, sf_dir, "nodes")
    status = documents.doc_status(**{n: view(spark, sf_dir, n) for n in documents.doc_status.inputs})
    images = png.write_images(view(spark, sf_dir, "artwork")).withColumnRenamed("image_id", "art_id")
    art = docs.selectExpr("doc_id", "doc_id % 10 AS art_id").join(images, "art_id").select("doc_id", "png")
    manifests = json_documents.manifest(nodes, view(spark, sf_dir, "issues"))
    made = package.production_packages(docs, status, art, package.cut_lines(view(spark, sf_dir, "cut_rings"), docs), manifests)
    return made.selectExpr("doc_id", "status", "files", "length(zip) AS bytes", "crc32(zip) AS crc")


register("production_packages", _packages)
register("snapshot_digest", lambda spark, sf_dir: json_documents.snapshot_digest(view(spark, sf_dir, "shapes")))
register(
    "telemetry_windows",
    lambda spark, sf_dir: telemetry.hourly(view(spark, sf_dir, "telemetry")),
    oracle("SELECT date_trunc('hour', ts) AS hour, provider_id, count(*) AS requests, CAST(sum(credits_charged) AS BIGINT) AS credits_charged FROM telemetry GROUP BY date_trunc('hour', ts), provider_id", ["telemetry"]),
)
_SESSIONS = """
WITH gaps AS (SELECT organization_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY organization_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM telemetry),
numbered AS (SELECT organization_id, ts, sum(fresh) OVER (PARTITION BY organization_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM gaps)
SELECT organization_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS requests FROM numbered GROUP BY organization_id, k"""
register("telemetry_sessions", lambda spark, sf_dir: telemetry.sessions(view(spark, sf_dir, "telemetry")), oracle(_SESSIONS, ["telemetry"]))
