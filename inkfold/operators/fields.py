"""Label fields grown over pixels, and components joined over gaps; no image is held in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfold.functions import expressions as E
from inkfold.operators.graph import components, cut, few, labelled_runs, pixel_components

_STEPS = "explode(array(named_struct('dx', 1, 'dy', 0), named_struct('dx', -1, 'dy', 0), named_struct('dx', 0, 'dy', 1), named_struct('dx', 0, 'dy', -1)))"


def seed_components(regions: DataFrame, edges: DataFrame, prototypes: DataFrame) -> DataFrame:
    """image_id, label, component, proto_id, pl, pa, pb: structural regions with their nearest prototype, adjacent ones of one prototype joined.

    regions(image_id, label, ok_l, ok_a, ok_b, structural); edges(image_id, region_a, region_b);
    prototypes(proto_id, ok_l, ok_a, ok_b), a palette small enough to meet every region. Ties go
    to the smaller prototype; a component is named by its smallest label.
    """
    palette = prototypes.selectExpr("proto_id", "ok_l AS pl", "ok_a AS pa", "ok_b AS pb")
    gap = F.expr("(ok_l - pl) * (ok_l - pl) + (ok_a - pa) * (ok_a - pa) + (ok_b - pb) * (ok_b - pb)")
    near = regions.where("structural").join(F.broadcast(palette)).groupBy("image_id", "label").agg(F.min(F.struct(gap.alias("gap"), "proto_id", "pl", "pa", "pb")).alias("p"))
    near = near.select("image_id", "label", "p.proto_id", "p.pl", "p.pa", "p.pb")
    kind = near.select("image_id", "label", "proto_id")
    same = (
        edges.join(kind.withColumnsRenamed({"label": "region_a", "proto_id": "kind_a"}), ["image_id", "region_a"])
        .join(kind.withColumnsRenamed({"label": "region_b", "proto_id": "kind_b"}), ["image_id", "region_b"])
        .where("kind_a = kind_b")
    )
    joined = components(same, ["image_id"], "region_a", "region_b").withColumnRenamed("node", "label")
    return near.join(joined, ["image_id", "label"], "left").withColumn("component", F.coalesce("component", "label"))


_TILE = 128  # pixels along a side of a tile
_ROW = "image_id long, tx long, ty long, what int, x long, y long, label long, other long, own long, proto_id long, ok_l double, ok_a double, ok_b double, pl double, pa double, pb double, edge int, wave long"
_PIXEL, _WALL, _TOLD = range(3)  # what a row of a tile is: a pixel (edge -1: of a neighbour), a wall between two labels, the wave and component of a pixel that is known
_WHOLE = 16  # bit of an edge: the image has no other tile


def _ranks(values: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and the place of each value among them, -1 for null."""
    names = np.unique(values.drop_null().to_numpy())
    return names, np.where(values.is_null().to_numpy(), -1, np.searchsorted(names, values.fill_null(0).to_numpy()))


class _Tile:
    """A tile of an image with the neighbours' pixels along its sides, as a flat grid with one cell more all around."""

    def __init__(self, rows: pa.Table):
        what, x, y, edge = (rows[c].fill_null(0).to_numpy() for c in ("what", "x", "y", "edge"))
        pixel, self.told = np.flatnonzero(what == _PIXEL), np.flatnonzero(what == _TOLD)
        self.x0, self.y0 = int(x[pixel].min()) - 1, int(y[pixel].min()) - 1
        self.width = int(x[pixel].max()) - self.x0 + 2
        self.cells = self.width * (int(y[pixel].max()) - self.y0 + 2)
        place = (y - self.y0) * self.width + x - self.x0
        self.steps = (-1, 1, -self.width, self.width)
        self.at, self.edge = place[pixel[edge[pixel] >= 0]], edge[pixel[edge[pixel] >= 0]]
        names, label = _ranks(pa.chunked_array([*rows["label"].chunks, *rows["other"].chunks], pa.int64()))
        self.names, own = _ranks(rows["own"])
        protos, proto = _ranks(rows["proto_id"])
        self.label, self.own, self.proto = (self._grid(place[pixel], v[pixel]) for v in (label[: len(what)], own, proto))
        self.colour = np.full((self.cells, 3), np.nan)
        self.colour[place[pixel]] = np.stack([rows[c].fill_null(np.nan).to_numpy()[pixel] for c in ("ok_l", "ok_a", "ok_b")], axis=1)
        named = own >= 0
        self.kind, self.shade = np.zeros(len(self.names), np.int64), np.zeros((len(self.names), 3))
        self.kind[own[named]] = protos[proto[named]]
        self.shade[own[named]] = np.stack([rows[c].fill_null(np.nan).to_numpy()[named] for c in ("pl", "pa", "pb")], axis=1)
        wall = np.flatnonzero(what == _WALL)
        self.labels = len(names)
        self.walls = np.unique(label[wall] * self.labels + label[len(what) + wall])
        self.told, self.told_wave, self.told_own = place[self.told], rows["wave"].fill_null(-1).to_numpy()[self.told], own[self.told]
        self.inside = self.own[self.at] >= 0
        for bit, step in zip((1, 2, 4, 8), self.steps, strict=True):
            self.inside &= (self.own[self.at + step] == self.own[self.at]) | (self.edge & bit > 0)

    def _grid(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.full(self.cells, -1)
        out[at] = values
        return out

    def xy(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return at % self.width + self.x0, at // self.width + self.y0

    def alone(self) -> np.ndarray:
        """The first pixel, from the top left, of every component that has none inside."""
        held = np.zeros(len(self.names) + 1, bool)
        held[self.own[self.at[self.inside]]] = True
        left = np.sort(self.at[(self.own[self.at] >= 0) & ~held[self.own[self.at]]])
        return left[np.unique(self.own[left], return_index=True)[1]]

    def grow(self, gap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Wave and component of every cell, and whether it is ambiguous; -1 where none came."""
        wave, got, unsure = np.full(self.cells, -1), np.full(self.cells, -1), np.zeros(self.cells, bool)
        seeds = self.at[self.inside] if not len(self.at) or not self.edge[0] & _WHOLE else np.concatenate([self.at[self.inside], self.alone()])
        wave[seeds], got[seeds] = 0, self.own[seeds]
        wave[self.told], got[self.told] = self.told_wave, self.told_own
        free = np.zeros(self.cells, bool)
        free[self.at] = wave[self.at] < 0
        front, last, step = np.flatnonzero(wave == 0), max(self.told_wave, default=0), 0
        while len(front) or step <= last:
            step += 1
            to, origin = np.concatenate([front + s for s in self.steps]), np.tile(front, 4)
            open_ = free[to]
            to, origin = to[open_], origin[open_]
            by, d = got[origin], self.colour[to] - self.shade[got[origin]]
            a, b = self.label[to], self.label[origin]
            pair = np.minimum(a, b) * self.labels + np.maximum(a, b)
            crossed = (a >= 0) & (b >= 0) & (a != b) & (self.proto[to] != self.proto[origin]) & np.isin(pair, self.walls)
            cost = float(step) + 12 * np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]) + np.where(crossed, 1000.0, 0.0)
            order = np.lexsort((by, cost, to))
            to, by, cost = to[order], by[order], cost[order]
            first = np.append(True, to[1:] != to[:-1])[: len(to)]
            group, best, least = np.cumsum(first) - 1, by[first], cost[first]
            rest = by != best[group]
            second, k = np.unique(group[rest], return_index=True)
            front = to[first]
            wave[front], got[front], free[front] = step, best, False
            unsure[front[second[cost[rest][k] - least[second] <= gap]]] = True
            front = np.concatenate([front, self.told[self.told_wave == step]])
        return wave, got, unsure


def _tiles(pixels: DataFrame, bounds: DataFrame) -> DataFrame:
    """Pixels dealt to the tiles of their image, those along a side also to the tile beyond it (edge -1)."""
    tile = {c: E.whole(f"{c} / {_TILE}") for c in "xy"}
    whole = " AND ".join(f"{E.whole(f'min_{c} / {_TILE}')} = {E.whole(f'max_{c} / {_TILE}')}" for c in "xy")
    bits = " + ".join(f"CASE WHEN {c} = {f}_{c} THEN {bit} ELSE 0 END" for bit, (c, f) in zip((1, 2, 4, 8), (("x", "min"), ("x", "max"), ("y", "min"), ("y", "max")), strict=True))
    rim = [f"CASE WHEN pmod({c}, {_TILE}) = {side} AND {c} <> {f}_{c} THEN named_struct('tx', {tile['x']} + {dx}, 'ty', {tile['y']} + {dy}, 'edge', -1) END" for c, f, side, dx, dy in (("x", "min", 0, -1, 0), ("x", "max", _TILE - 1, 1, 0), ("y", "min", 0, 0, -1), ("y", "max", _TILE - 1, 0, 1))]
    places = f"filter(array(named_struct('tx', {tile['x']}, 'ty', {tile['y']}, 'edge', {bits} + CASE WHEN {whole} THEN {_WHOLE} ELSE 0 END), {', '.join(rim)}), p -> p IS NOT NULL)"
    return pixels.join(bounds, "image_id").selectExpr("*", f"explode({places}) AS p").selectExpr(*pixels.columns, "p.tx AS tx", "p.ty AS ty", "p.edge AS edge")


def _rows(df: DataFrame, what: int) -> DataFrame:
    """A table as rows of tiles; columns it has not are null."""
    fields = [f.rsplit(" ", 1) for f in _ROW.split(", ")]
    df = df.withColumn("what", F.lit(what))
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in fields])


def _by_tile(rows: DataFrame, run, schema: str) -> DataFrame:
    """run(tile, image, tx, ty), columns of a result, for every tile that has pixels. Tiles are dealt to all tasks: their work is not told by their bytes."""
    names = [f.split()[0] for f in schema.split(", ")]
    types = pa.schema([(n, {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[f.split()[1]]) for n, f in zip(names, schema.split(", "), strict=True)])

    def each(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if not pc.any(pc.equal(table["what"], _PIXEL)).as_py():
            return types.empty_table()
        return pa.table(dict(zip(names, run(_Tile(table), *(k.as_py() for k in key)), strict=True)), types)

    keys = ["image_id", "tx", "ty"]
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).groupBy(*keys).applyInArrow(each, schema)


def _settled(several: DataFrame, gap: float, most_rounds: int) -> DataFrame:
    """What tiles of images of several tiles have to be told: first pixels of components without any inside, and the field along their sides, which tiles grow anew until none tells its neighbours anything else."""
    keys = ["image_id", "tx", "ty"]

    def seen(t: _Tile, image: int, tx: int, ty: int) -> list[np.ndarray]:
        at = t.at[t.own[t.at] >= 0]
        x, y = t.xy(at)
        own = t.own[at]
        first = np.lexsort((x, y, ~t.inside[t.own[t.at] >= 0], own))
        first = first[np.unique(own[first], return_index=True)[1]]
        return [np.full(len(first), image), np.full(len(first), tx), np.full(len(first), ty), x[first], y[first], t.names[own[first]], t.kind[own[first]], *t.shade[own[first]].T, t.inside[t.own[t.at] >= 0][first]]

    held = _by_tile(several, seen, "image_id long, tx long, ty long, x long, y long, own long, proto_id long, pl double, pa double, pb double, held boolean")
    spots = held.groupBy("image_id", "own").agg(F.max("held").alias("held"), F.min(F.struct("y", "x", "tx", "ty", "proto_id", "pl", "pa", "pb")).alias("p")).where("NOT held")
    alone = cut(_rows(spots.selectExpr("image_id", "own", "p.*", "CAST(0 AS BIGINT) AS wave"), _TOLD))

    def sides(t: _Tile, image: int, tx: int, ty: int) -> list[np.ndarray]:
        wave, got, _ = t.grow(gap)
        at = t.at[wave[t.at] >= 0]
        x, y = t.xy(at)
        out = []
        for dx, dy, ok in ((-1, 0, x == tx * _TILE), (1, 0, x == tx * _TILE + _TILE - 1), (0, -1, y == ty * _TILE), (0, 1, y == ty * _TILE + _TILE - 1)):
            k = at[ok]
            out.append([*(np.full(len(k), v) for v in (image, tx + dx, ty + dy, tx, ty)), *t.xy(k), t.names[got[k]], t.kind[got[k]], *t.shade[got[k]].T, wave[k]])
        return [np.concatenate(c) for c in zip(*out, strict=True)]

    schema = "image_id long, tx long, ty long, from_x long, from_y long, x long, y long, own long, proto_id long, pl double, pa double, pb double, wave long"
    told, active = None, several.select(*keys).distinct()
    for _ in range(most_rounds):
        known = alone if told is None else alone.unionByName(_rows(told, _TOLD))
        again = cut(_by_tile(several.unionByName(known).join(active, keys, "left_semi"), sides, schema))
        by = active.withColumnsRenamed({"tx": "from_x", "ty": "from_y"})
        now = again if told is None else cut(again.unionByName(told.join(by, ["image_id", "from_x", "from_y"], "left_anti")))
        changed = now if told is None else now.exceptAll(told).unionByName(told.exceptAll(now))
        active, told = cut(changed.select(*keys).distinct()), now
        if not active.limit(1).count():
            return alone.unionByName(_rows(told, _TOLD))
    raise RuntimeError("the field did not settle")


def prototype_field(pixels: DataFrame, regions: DataFrame, edges: DataFrame, prototypes: DataFrame, strong: float = 0.45, gap: float = 0.5, most_rounds: int = 100_000) -> DataFrame:
    """image_id, x, y, component, proto_id, wave, ambiguous: the field that seed components grow over all pixels.

    pixels(image_id, x, y, r, g, b, label); edges also hold avg_strength. Seeds are the pixels of
    a component whose four neighbours are in it too, else its first pixel. In each wave every
    free pixel beside the last wave takes the component with the least cost: the wave, twelve
    times the colour distance to the component's prototype, and 1000 where a boundary of
    strength `strong` or more between regions of different prototypes is crossed; ties go to the
    smaller component. Where the best of another component is within `gap`, the pixel is
    ambiguous and has no component in the result, but carries the wave on. Pixels that no
    seed reaches have null wave. An image without seeds keeps null everywhere.

    Waves run inside tiles of 128 by 128 pixels, so pixels are shuffled once. Tiles of a larger
    image are told the field along their sides and grow again while that changes, most_rounds times at most.
    """
    edges = cut(edges.select("image_id", "region_a", "region_b", "avg_strength"))
    seeds = few(cut(seed_components(regions, edges, prototypes)))
    ok_l, ok_a, ok_b = E.oklab("r", "g", "b")
    kind = seeds.select("image_id", "label", F.col("component").alias("own"), "proto_id", "pl", "pa", "pb")
    base = pixels.selectExpr("image_id", "x", "y", "label", f"{ok_l} AS ok_l", f"{ok_a} AS ok_a", f"{ok_b} AS ok_b").join(kind, ["image_id", "label"], "left")
    bounds = cut(pixels.groupBy("image_id").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y") for f in (F.min, F.max)]))
    walls = edges.where(F.col("avg_strength") >= strong).select("image_id", F.least("region_a", "region_b").alias("label"), F.greatest("region_a", "region_b").alias("other"))
    dealt = _tiles(base, few(bounds))
    present = _tiles(pixels.select("image_id", "x", "y", "label"), few(bounds)).select("image_id", "tx", "ty", "label").distinct()
    rows = _rows(dealt, _PIXEL).unionByName(_rows(walls.join(present, ["image_id", "label"]), _WALL))
    large = bounds.where(" OR ".join(f"{E.whole(f'min_{c} / {_TILE}')} <> {E.whole(f'max_{c} / {_TILE}')}" for c in "xy")).select("image_id")
    if large.limit(1).count():
        rows = rows.unionByName(_settled(cut(rows.join(few(large), "image_id", "left_semi")), gap, most_rounds))

    def told(t: _Tile, image: int, tx: int, ty: int) -> list:
        wave, got, unsure = (v[t.at] for v in t.grow(gap))
        none = unsure | (got < 0)
        names, kinds = (np.append(v, 0)[got] for v in (t.names, t.kind))
        return [np.full(len(t.at), image), *t.xy(t.at), pa.array(names, mask=none), pa.array(kinds, mask=none), pa.array(wave, mask=wave < 0), unsure]

    return _by_tile(rows, told, "image_id long, x long, y long, component long, proto_id long, wave long, ambiguous boolean")


def remove_islands(labels: DataFrame, least_area: int = 12) -> DataFrame:
    """image_id, x, y, label, island: the map with every component below least_area given to the label it borders most.

    Sides to cells of other labels count, ties go to the smaller label; borders to nothing do
    not count, so an island among holes stays as it is. All islands are judged on the map as given.
    """
    runs = cut(labelled_runs(labels))
    small = runs.groupBy("image_id", "component").agg(F.sum("n").alias("area")).where(F.col("area") < least_area).select("image_id", "component")
    small = few(cut(small))
    cells = cut(runs.join(small, ["image_id", "component"]).select("image_id", "component", "y", "v", F.explode(F.sequence("x0", "x1")).alias("x")))
    sent = few(cells)
    beside = sent.withColumn("s", F.expr(_STEPS)).select("image_id", "component", "v", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
    around = beside.join(labels.select("image_id", "x", "y", "label"), ["image_id", "x", "y"]).where("label <> v").groupBy("image_id", "component", "label").count()
    owner = around.groupBy("image_id", "component").agg(F.min(F.struct((-F.col("count")).alias("n"), "label"))["label"].alias("owner"))
    given = sent.join(owner, ["image_id", "component"], "left").select("image_id", "x", "y", "owner", F.lit(True).alias("island"))
    given = given if sent is cells else given.hint("merge")
    return labels.join(given, ["image_id", "x", "y"], "left").select("image_id", "x", "y", F.coalesce("owner", "label").alias("label"), F.coalesce("island", F.lit(False)).alias("island"))


def bridged_components(labels: DataFrame, gap: float = 2.0, cell: int = 32) -> DataFrame:
    """image_id, label, logical, parts, area, min_x, max_x, min_y, max_y: 4-connected components of a label, joined where their boxes are at most `gap` pixels apart.

    Boxes meet in the grid cells that they reach into, gap included, and only in the first
    cell they share; the joined boxes' components are then contracted once more. logical
    numbers the components of an image by their first part (top, then left).
    """
    parts = few(cut(pixel_components(labels)))
    reach = int(-(-gap // 1)) + 1
    span = lambda low, high: f"explode(sequence(CAST(floor(({low}) / {cell}) AS BIGINT), CAST(floor(({high}) / {cell}) AS BIGINT)))"
    lines = parts.selectExpr("*", span(f"min_x - {reach}", "max_x") + " AS cx")
    cells = lines.selectExpr("*", span(f"min_y - {reach}", "max_y") + " AS cy").selectExpr("*", f"CAST(floor((min_x - {reach}) / {cell}) AS BIGINT) AS fx", f"CAST(floor((min_y - {reach}) / {cell}) AS BIGINT) AS fy")
    keys = ["image_id", "label", "cx", "cy"]
    other = cells.select(*keys, *(F.col(c).alias(f"o_{c}") for c in ("component", "min_x", "max_x", "min_y", "max_y", "fx", "fy")))
    apart = "sqrt(power(greatest(0, min_x - o_max_x - 1, o_min_x - max_x - 1), 2) + power(greatest(0, min_y - o_max_y - 1, o_min_y - max_y - 1), 2))"
    near = cells.join(other, keys).where(f"component < o_component AND cx = greatest(fx, o_fx) AND cy = greatest(fy, o_fy) AND {apart} <= {gap}")
    joined = components(near.select("image_id", "component", "o_component"), ["image_id"], "component", "o_component").withColumnsRenamed({"component": "root", "node": "component"})
    whole = parts.join(joined, ["image_id", "component"], "left").withColumn("root", F.coalesce("root", "component"))
    sums = whole.groupBy("image_id", "label", "root").agg(F.count("*").alias("parts"), F.sum("area").alias("area"), F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"), F.min("min_y").alias("min_y"), F.max("max_y").alias("max_y"))
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("root")) - 1
    return sums.withColumn("logical", number.cast("long")).drop("root")
