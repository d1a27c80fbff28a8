"""Exact overlay of polygons: how many ids cover each place, as trapezoids.

Polygons are cut into tiles by halving, so a task never holds more of a polygon than it has read. In a tile a line sweeps
upwards: between two heights at which an edge begins, ends or crosses another one, edges keep their order, and walking
along them tells which ids' polygons are entered and left. Each stretch with the same number of ids becomes a trapezoid.
Union, intersection and whatever else asks for a number of ids are filters over these rows, and areas and centroids are
sums over them, exact but for rounding.

Within an id, polygons are united; within a polygon, rings count by the even-odd rule, so holes are outside and rings may
touch. Rings are arrays of struct<lon, lat>, closed or not, and don't cross the date line. Null polygons, rings with fewer
than three points and points that aren't finite numbers count as nothing. Tiles with more than ``MAX_EDGES`` edges are
halved both ways until they have fewer or are ``SPLITS`` times smaller; equal pieces of an id in a tile count once first. Ids that have the same polygons (told by 128
bits of hashes) are worked as one that weighs their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraline.functions import geo
from terraline.session import discard, written

#: Edges in a tile above which it is split, and how often.
MAX_EDGES, SPLITS = 512, 6

_EDGE = "size double, ty long, tx long, part long, edges array<double>"
TRAPEZOID = "y0 double, y1 double, left0 double, right0 double, left1 double, right1 double"


def _clip(ring: np.ndarray, axis: int, at: float, above: bool) -> np.ndarray:
    """The part of a ring (points x 2) on one side of a line; pieces stay joined along the line, which parity ignores."""
    if not len(ring):
        return ring
    side = ring[:, axis] - at
    inside = side >= 0 if above else side <= 0
    if inside.all():
        return ring
    if not inside.any():
        return ring[:0]
    following = np.roll(np.arange(len(ring)), -1)
    crosses = inside != inside[following]
    with np.errstate(divide="ignore", invalid="ignore"):
        share = side / (side - side[following])
        met = ring + share[:, None] * (ring[following] - ring)
    met[:, axis] = at
    out = np.empty((2 * len(ring), 2))
    out[0::2], out[1::2] = ring, met
    return out[np.stack([inside, crosses], axis=1).ravel()]


def _tiles(rings: list[np.ndarray], size: float):
    """(ty, tx, rings) of the tiles that rings reach, by halving the range of tiles they span."""
    low, high = np.floor(np.min([r.min(axis=0) for r in rings], axis=0) / size), np.floor(np.max([r.max(axis=0) for r in rings], axis=0) / size)
    stack = [(int(low[1]), int(high[1]), int(low[0]), int(high[0]), rings)]
    while stack:
        y0, y1, x0, x1, held = stack.pop()
        held = [r for r in held if len(r) > 2]
        if not held:
            continue
        if y0 == y1 and x0 == x1:
            yield y0, x0, held
        elif y1 - y0 >= x1 - x0:
            mid = (y0 + y1) // 2
            stack.append((y0, mid, x0, x1, [_clip(r, 1, (mid + 1) * size, False) for r in held]))
            stack.append((mid + 1, y1, x0, x1, [_clip(r, 1, (mid + 1) * size, True) for r in held]))
        else:
            mid = (x0 + x1) // 2
            stack.append((y0, y1, x0, mid, [_clip(r, 0, (mid + 1) * size, False) for r in held]))
            stack.append((y0, y1, mid + 1, x1, [_clip(r, 0, (mid + 1) * size, True) for r in held]))


def _edges(rings: list[np.ndarray]) -> np.ndarray:
    """Edges (x0, y0, x1, y1) with y0 < y1, in order; edges that are there twice cancel out."""
    both = np.concatenate([np.concatenate([r, np.roll(r, -1, axis=0)], axis=1) for r in rings])
    both = both[both[:, 1] != both[:, 3]]
    down = both[:, 1] > both[:, 3]
    both[down] = both[down][:, [2, 3, 0, 1]]
    different, n = np.unique(both, axis=0, return_counts=True)
    return different[n % 2 == 1]


def _rings(value) -> list[np.ndarray]:
    out = []
    for ring in value or []:
        points = [(p["lon"], p["lat"]) for p in ring or [] if p is not None and p["lon"] is not None and p["lat"] is not None]
        array = np.array(points, float).reshape(-1, 2)
        if len(array) > 2 and np.isfinite(array).all():
            out.append(array[:-1] if (array[0] == array[-1]).all() else array)
    return [r for r in out if len(r) > 2]


def tiled(polygons: DataFrame, keys: list[str], tile_deg: float) -> DataFrame:
    """(keys, size, ty, tx, part, edges) of polygons (keys, rings, _part) cut into tiles; edges are four numbers each."""
    schema = T.StructType([polygons.schema[c] for c in keys] + T._parse_datatype_string(_EDGE).fields)
    names = [f.name for f in schema.fields]
    kinds = {c: i for i, c in enumerate(names)}

    def run(batches):
        for batch in batches:
            out = {c: [] for c in kinds}
            for i in range(len(batch)):
                rings = _rings(batch.column("rings")[i].as_py())
                for ty, tx, held in _tiles(rings, tile_deg) if rings else ():
                    edges = _edges(held)
                    if len(edges):
                        row = {"size": tile_deg, "ty": ty, "tx": tx, "part": batch.column("_part")[i].as_py(), "edges": edges.ravel()}
                        for c in names:
                            out[c].append(row[c] if c in row else batch.column(c)[i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(out[c], type=pa.list_(pa.float64())) if c == "edges" else pa.array(out[c], type=batch.column(c).type) if c in keys else pa.array(out[c], pa.float64() if c == "size" else pa.int64()) for c in names], names)

    return polygons.select(*keys, "rings", "_part").mapInArrow(run, schema)


def _halves(keys: list[str], schema: T.StructType):
    """Rows of tiles to the rows of their quarters."""
    names = [f.name for f in schema.fields]

    def cut(edges: np.ndarray, axis: int, at: float, above: bool) -> np.ndarray:
        """Edges on one side; what lies beyond moves onto the line, so that parity stays as it is."""
        points = edges.reshape(-1, 2, 2).copy()
        side = points[:, :, axis] - at
        side = side if above else -side
        cross = (side[:, 0] < 0) != (side[:, 1] < 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            share = side[:, 0] / (side[:, 0] - side[:, 1])
            met = points[:, 0] + share[:, None] * (points[:, 1] - points[:, 0])
        met[:, axis] = at
        pieces = []
        for first, last, use in ((points[:, 0], points[:, 1], ~cross), (points[:, 0], met, cross), (met, points[:, 1], cross)):
            some = np.stack([first, last], axis=1)[use]
            middle = some[:, :, axis].sum(axis=1) / 2 - at
            beyond = middle < 0 if above else middle > 0
            some[beyond, :, axis] = at
            pieces.append(some)
        flat = np.concatenate(pieces).reshape(-1, 4)
        return flat[flat[:, 1] < flat[:, 3]]

    def run(batches):
        for batch in batches:
            out = {c: [] for c in names}
            for row in batch.to_pylist():
                edges, size = np.array(row["edges"]).reshape(-1, 4), row["size"] / 2
                for j in (0, 1):
                    rows = cut(edges, 1, (2 * row["ty"] + 1) * size, j == 1)
                    for i in (0, 1):
                        quarter = cut(rows, 0, (2 * row["tx"] + 1) * size, i == 1) if len(rows) else rows
                        different, n = np.unique(quarter, axis=0, return_counts=True)
                        quarter = different[n % 2 == 1]
                        if len(quarter):
                            new = row | {"size": size, "ty": 2 * row["ty"] + j, "tx": 2 * row["tx"] + i, "edges": quarter.ravel()}
                            for c in names:
                                out[c].append(new[c])
            yield pa.RecordBatch.from_arrays([pa.array(out[c], type=batch.column(c).type) for c in names], names)

    return run


def _crossings(e: np.ndarray) -> np.ndarray:
    """Heights at which edges cross inside of both."""
    found = []
    d = e[:, 2:] - e[:, :2]
    for i in range(len(e) - 1):
        o = e[i + 1 :]
        near = (o[:, 1] < e[i, 3]) & (o[:, 3] > e[i, 1]) & (np.minimum(o[:, 0], o[:, 2]) <= max(e[i, 0], e[i, 2])) & (np.maximum(o[:, 0], o[:, 2]) >= min(e[i, 0], e[i, 2]))
        o, do = o[near], d[i + 1 :][near]
        turn = d[i, 0] * do[:, 1] - d[i, 1] * do[:, 0]
        gap = o[:, :2] - e[i, :2]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (gap[:, 0] * do[:, 1] - gap[:, 1] * do[:, 0]) / turn
            u = (gap[:, 0] * d[i, 1] - gap[:, 1] * d[i, 0]) / turn
        t = t[(turn != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)]
        found.append(e[i, 1] + t * d[i, 1])
    return np.concatenate(found) if found else np.zeros(0)


def sweep(edges: np.ndarray, part: np.ndarray, owner: np.ndarray, weight: np.ndarray) -> list[tuple]:
    """(number of ids, y0, y1, left0, right0, left1, right1) of a tile's trapezoids. ``part``: the polygon of each edge;
    ``owner``: the id of each polygon, as numbers; ``weight``: how many ids each polygon's owner stands for."""
    heavy = weight.tolist()
    heights = np.unique(np.concatenate([edges[:, 1], edges[:, 3], _crossings(edges)]))
    order = np.argsort(edges[:, 1], kind="stable")
    edges, part = edges[order], part[order]
    upto = np.searchsorted(edges[:, 1], heights[:-1], side="right")
    slope = (edges[:, 2] - edges[:, 0]) / (edges[:, 3] - edges[:, 1])
    active, seen, out = np.zeros(0, int), 0, []
    for k, (y0, y1) in enumerate(zip(heights[:-1], heights[1:])):
        active = np.concatenate([active[edges[active, 3] > y0], np.arange(seen, upto[k])])
        active = active[edges[active, 3] > y0]
        seen = upto[k]
        if not len(active):
            continue
        low = np.where(edges[active, 1] == y0, edges[active, 0], edges[active, 0] + slope[active] * (y0 - edges[active, 1]))
        high = np.where(edges[active, 3] == y1, edges[active, 2], edges[active, 0] + slope[active] * (y1 - edges[active, 1]))
        walk = np.argsort(low + high, kind="stable")
        inside, held, ids, begin = set(), {}, 0, None
        for i in walk:
            p = int(part[active[i]])
            o, before = int(owner[p]), ids
            if p in inside:
                inside.remove(p)
                held[o] -= 1
                ids -= heavy[p] * (held[o] == 0)
            else:
                inside.add(p)
                held[o] = held.get(o, 0) + 1
                ids += heavy[p] * (held[o] == 1)
            if ids != before:
                if before and low[i] + high[i] > low[begin] + high[begin]:
                    out.append((before, y0, y1, low[begin], low[i], high[begin], high[i]))
                begin = i
    return out


def _classes(polygons: DataFrame, keys: list[str]) -> DataFrame:
    """Polygons (keys, _id, rings) of one id for all that have the same polygons, with ``_weight``, the number of these ids."""
    different = polygons.dropDuplicates([*keys, "_id", "rings"])
    digests = [F.bit_xor(F.xxhash64(F.lit(k), "rings")).alias(f"_h{k}") for k in (0, 1)]
    of = different.groupBy(*keys, "_id").agg(*digests).groupBy(*keys, "_h0", "_h1").agg(F.min("_id").alias("_id"), F.count("*").alias("_weight"))
    of = of.select(*[F.col(c).alias(f"_of_{c}") for c in (*keys, "_id")], "_weight")
    same = F.lit(True)
    for c in (*keys, "_id"):
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return different.join(of, same).select(*keys, "_id", "rings", "_weight")


def coverage(polygons: DataFrame, id: str = "id", by: str | None = None, tile_deg: float = 0.05) -> DataFrame:
    """(by, n, y0, y1, left0, right0, left1, right1): trapezoids between the heights y0 and y1 that ``n`` of the ids of
    polygons (id, rings) cover; with ``by`` polygons meet only those of the same value. Trapezoids don't overlap."""
    keys = [by] if by else []
    part = _classes(polygons.select(*keys, F.col(id).alias("_id"), "rings").where("rings is not null"), keys).withColumn("_part", F.xxhash64("_id", "rings"))
    tile = [*keys, "size", "ty", "tx"]
    rows = tiled(part, [*keys, "_id", "_weight"], tile_deg).dropDuplicates([*tile, "_id", "edges"])
    rows = written(rows, "overlay-tiles")
    for _ in range(SPLITS):
        many = rows.groupBy(*tile).agg(F.sum(F.size("edges")).alias("_n")).where(F.col("_n") > 4 * MAX_EDGES).drop("_n")
        if not many.limit(1).count():
            break
        on = [rows[c].eqNullSafe(many[c]) for c in tile]
        condition = on[0]
        for o in on[1:]:
            condition = condition & o
        quarters = rows.join(many, condition, "left_semi").mapInArrow(_halves(keys, rows.schema), rows.schema).dropDuplicates([*tile, "_id", "edges"])
        new = written(rows.join(many, condition, "left_anti").unionByName(quarters), "overlay-tiles")
        discard(rows)
        rows = new
    schema = T.StructType([rows.schema[c] for c in keys] + T._parse_datatype_string(f"n long, {TRAPEZOID}").fields)
    names = [f.name for f in schema.fields]

    def run(key, table):
        lists = table.column("edges").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy()) // 4
        edges = lists.flatten().to_numpy().reshape(-1, 4)
        owner = table.column("_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        out = sweep(edges, np.repeat(np.arange(len(sizes)), sizes), owner, table.column("_weight").to_numpy())
        columns = list(zip(*out)) if out else [[] for _ in range(7)]
        mine = {by: pa.array([key[0].as_py()] * len(out), type=table.column(by).type)} if by else {}
        values = dict(zip(names[len(keys) :], columns))
        return pa.table({c: mine[c] if c in mine else pa.array(values[c], pa.int64() if c == "n" else pa.float64()) for c in names})

    return rows.groupBy(*tile).applyInArrow(run, schema)


def union(pieces: DataFrame) -> DataFrame:
    return pieces.where("n >= 1")


def intersection(pieces: DataFrame, ids: int | Column) -> DataFrame:
    """What all of ``ids`` ids cover; nothing if they are under 2."""
    ids = F.lit(ids) if isinstance(ids, int) else ids
    return pieces.where((F.col("n") == ids) & (ids >= 2))


def rings_of(pieces: DataFrame) -> Column:
    """array<array<struct<lon, lat>>> of a trapezoid, to write it or to overlay it again."""
    corner = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    return F.array(F.array(corner("left0", "y0"), corner("right0", "y0"), corner("right1", "y1"), corner("left1", "y1"), corner("left0", "y0")))


def measured(pieces: DataFrame, by: str | None = None) -> DataFrame:
    """(by, area_deg2, area_km2, lat, lon, south, north, west, east): area, centroid and box of trapezoids; square
    kilometres by the scale at the centroid's latitude. Without ``by`` one row, of nulls if there is none."""
    w0, w1, h = F.col("right0") - F.col("left0"), F.col("right1") - F.col("left1"), F.col("y1") - F.col("y0")
    area = (w0 + w1) / 2 * h
    # Moments of a trapezoid whose ends are linear in the height.
    my = F.col("y0") * area + h * h * (w0 + 2 * w1) / 6
    square = lambda a, b: (F.col(a) * F.col(a) + F.col(a) * F.col(b) + F.col(b) * F.col(b)) / 3
    mx = h * (square("right0", "right1") - square("left0", "left1")) / 2
    sums = [F.sum(area).alias("area_deg2"), F.sum(my).alias("_my"), F.sum(mx).alias("_mx"), F.min("y0").alias("south"), F.max("y1").alias("north"), F.min(F.least("left0", "left1")).alias("west"), F.max(F.greatest("right0", "right1")).alias("east")]
    out = (pieces.groupBy(by) if by else pieces.groupBy()).agg(*sums).withColumns({"lat": F.try_divide("_my", "area_deg2"), "lon": F.try_divide("_mx", "area_deg2")})
    km2 = F.col("area_deg2") * geo.KM_PER_DEGREE_LAT * geo.KM_PER_DEGREE_LON * F.cos(F.radians("lat"))
    return out.select(*([by] if by else []), "area_deg2", km2.alias("area_km2"), "lat", "lon", "south", "north", "west", "east")
