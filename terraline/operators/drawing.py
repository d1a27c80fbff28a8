"""Where the rooms of a plan are drawn: on a circle, by springs between them, and the curves that link them."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraline.session import dealt

#: How strongly a score draws two rooms together; of other scores, the last one.
PULL = {3: 4.0, 2: 2.5, 1: 1.0, -1: 0.02}
OTHER_PULL = 1.0
#: The least size of a room's mark, its size for a square metre, how far a curve is bent and its points.
LEAST_MARK, MARK_PER_M2 = 44.0, 7.0
BEND, CURVE_POINTS = 0.15, 30


def on_circle(rooms: DataFrame) -> DataFrame:
    """(project, room, x, y, size): rooms (project, ord, room, net) in their order round the unit circle, from the right
    and against the clock; ``ord`` counts from 0 in a project."""
    turn = 2 * F.pi() * F.col("ord") / F.count("*").over(Window.partitionBy("project"))
    size = F.greatest(F.lit(LEAST_MARK), F.col("net") * MARK_PER_M2)
    return rooms.select("project", "room", F.cos(turn).alias("x"), F.sin(turn).alias("y"), size.alias("size"))


def curve(x0: Column, y0: Column, x1: Column, y1: Column, bend: float = BEND, points: int = CURVE_POINTS) -> Column:
    """Points (struct x, y) of a quadratic Bezier curve: its control point is beside the middle by ``bend`` times the
    length, on the left if the sum of the first end's coordinates is over 1 modulo 2, else on the right. Ends that fall
    together give the one point; a null coordinate gives null."""
    known = x0.isNotNull() & y0.isNotNull() & x1.isNotNull() & y1.isNotNull()
    apart = (x0 != x1) | (y0 != y1)
    along = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: _on_curve(x0, y0, x1, y1, i / (points - 1), bend))
    return F.when(known & apart, along).when(known, F.array(F.struct(x0.cast("double").alias("x"), y0.cast("double").alias("y"))))


def _on_curve(x0: Column, y0: Column, x1: Column, y1: Column, t: Column, bend: float) -> Column:
    """The point (struct x, y) at ``t`` of a curve."""
    side = F.when(F.pmod(x0 + y0, F.lit(2.0)) > 1, bend).otherwise(-bend)
    cx, cy = (x0 + x1) / 2 - (y1 - y0) * side, (y0 + y1) / 2 + (x1 - x0) * side
    on = lambda a, b, c: (1 - t) * (1 - t) * a + 2 * (1 - t) * t * b + t * t * c
    return F.struct(on(x0, cx, x1).alias("x"), on(y0, cy, y1).alias("y"))


def curves(links: DataFrame, keys: list[str], x0: Column, y0: Column, x1: Column, y1: Column, bend: float = BEND, points: int = CURVE_POINTS) -> DataFrame:
    """(keys, i, x, y): a row for each point of ``curve`` of each link, without holding a curve as an array."""
    ends = dealt(links.select(*keys, x0.cast("double").alias("_x0"), y0.cast("double").alias("_y0"), x1.cast("double").alias("_x1"), y1.cast("double").alias("_y1")).dropna(subset=["_x0", "_y0", "_x1", "_y1"]))
    c = [F.col(k) for k in ("_x0", "_y0", "_x1", "_y1")]
    apart = (c[0] != c[2]) | (c[1] != c[3])
    rows = ends.withColumn("i", F.explode(F.sequence(F.lit(0), F.when(apart, points - 1).otherwise(0))))
    p = _on_curve(*c, F.col("i") / (points - 1), bend)
    x, y = F.when(apart, p["x"]).otherwise(c[0]), F.when(apart, p["y"]).otherwise(c[1])
    return rows.select(*keys, "i", x.alias("x"), y.alias("y"))


def _settled(n: int, pull: np.ndarray, seed: int, rounds: int) -> np.ndarray:
    """Fruchterman and Reingold's placement: all pairs push by k^2 / d, linked ones pull by weight * d^2 / k, no step is
    longer than a temperature that falls to nothing; centred, and scaled to reach 1."""
    at = np.random.default_rng(seed).random((n, 2))
    k, heat = n**-0.5, 0.1
    for i in range(rounds):
        apart = at[:, None] - at[None]
        d = np.maximum(np.sqrt((apart**2).sum(-1)), 0.01)
        push = (apart * (k * k / d**2 - pull * d / k)[..., None]).sum(1)
        length = np.maximum(np.sqrt((push**2).sum(-1)), 0.01)
        at = at + push * (np.minimum(length, heat * (1 - i / rounds)) / length)[:, None]
    at = at - at.mean(0)
    far = np.abs(at).max()
    return at / far if far > 0 else at


def by_springs(rooms: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(project, room, x, y) of rooms (project, ord, room), placed by springs: edges (project, room1, room2, score) draw
    rooms together by ``PULL``. The start follows from a digest of the project's links, so every run gives the same places.
    Links with a room that isn't there, or from a room to itself, don't count; of links said twice the last by score
    counts; a room alone is at the origin. A plan's rooms are a few rows, one group each."""

    def place(pool: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        if pool.empty:
            return pd.DataFrame([], columns=["project", "room", "x", "y"])
        p = pool.sort_values(["ord", "room"])
        number = {room: i for i, room in enumerate(p.room)}
        pull, said = np.zeros((len(p), len(p))), set()
        for a, b, score in links.sort_values("score")[["room1", "room2", "score"]].itertuples(index=False):
            if a in number and b in number and a != b:
                i, j = number[a], number[b]
                pull[i, j] = pull[j, i] = PULL.get(score, OTHER_PULL)
                said.add(" - ".join(sorted((a, b))))
        seed = int.from_bytes(hashlib.sha256("\n".join(sorted(said)).encode()).digest()[:8], "little")
        at = _settled(len(p), pull, seed, rounds)
        return pd.DataFrame({"project": p.project.to_numpy(), "room": p.room.to_numpy(), "x": at[:, 0], "y": at[:, 1]})

    kind = rooms.schema["project"].dataType.simpleString()
    pools, links = rooms.select("project", "ord", "room").groupBy("project"), edges.select("project", "room1", "room2", "score").groupBy("project")
    return pools.cogroup(links).applyInPandas(place, f"project {kind}, room string, x double, y double")


def by_height(rooms: DataFrame, places: DataFrame) -> DataFrame:
    """``rooms`` with ``ord`` anew from 0: the highest of ``places`` (project, room, y) first, ties by name."""
    order = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("y"), "room")) - 1
    return rooms.join(places.select("project", "room", "y"), ["project", "room"]).withColumn("ord", order).drop("y").select(*rooms.columns)
