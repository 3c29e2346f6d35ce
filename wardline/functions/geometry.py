"""Planar geometry on array columns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def interpolate_along(points: Column, frac: Column) -> Column:
    """Point at a share of a polyline's planar length, as struct<x, y>.

    The share is clamped to [0, 1]; a line of zero length gives its first point.
    """
    n = F.size(points)
    first, last = F.element_at(points, 1), F.element_at(points, -1)
    legs = F.zip_with(
        F.slice(points, F.lit(1), n - 1), F.slice(points, F.lit(2), n - 1),
        lambda a, b: F.struct(
            a["x"].alias("x0"), a["y"].alias("y0"),
            (b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy"),
            F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"])
                   + (b["y"] - a["y"]) * (b["y"] - a["y"])).alias("d")))
    total = F.aggregate(legs, F.lit(0.0), lambda acc, leg: acc + leg["d"])
    target = total * F.greatest(F.lit(0.0), F.least(F.lit(1.0), frac))

    def step(acc: Column, leg: Column) -> Column:
        here = ~acc["found"] & (acc["done"] + leg["d"] >= target)
        t = F.when(leg["d"] > 0, (target - acc["done"]) / leg["d"]).otherwise(0.0)
        return F.struct(
            F.when(acc["found"], acc["done"]).otherwise(acc["done"] + leg["d"]).alias("done"),
            (acc["found"] | here).alias("found"),
            F.when(here, leg["x0"] + t * leg["dx"]).otherwise(acc["x"]).alias("x"),
            F.when(here, leg["y0"] + t * leg["dy"]).otherwise(acc["y"]).alias("y"))

    start = F.struct(F.lit(0.0).alias("done"), F.lit(False).alias("found"),
                     last["x"].cast("double").alias("x"), last["y"].cast("double").alias("y"))
    walked = F.aggregate(legs, start, step)
    at_start = (n < 2) | (total == 0)
    return F.struct(
        F.when(at_start, first["x"]).otherwise(walked["x"]).alias("x"),
        F.when(at_start, first["y"]).otherwise(walked["y"]).alias("y"))


def strictly_inside(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd test over all rings; a point on an edge is outside."""
    def edges(ring: Column) -> Column:
        n = F.size(ring)
        return F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1),
                          lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        # try_divide: a level edge never spans, so its null is not used
        at = a["x"] + (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"])
        return spans & (x < at)

    def touches(e: Column) -> Column:
        a, b = e["a"], e["b"]
        cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        return ((cross == 0) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"]))
                & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"])))

    all_edges = F.flatten(F.transform(rings, edges))
    hits = F.aggregate(all_edges, F.lit(0),
                       lambda acc, e: acc + F.when(crosses(e), 1).otherwise(0))
    return ~F.exists(all_edges, touches) & (hits % 2 == 1)


def ring_edges(rings: Column) -> Column:
    """All edges of all rings as structs of their ends."""
    def edges(ring: Column) -> Column:
        n = F.size(ring)
        return F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1),
                          lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))

    return F.flatten(F.transform(rings, edges))


def _positive(e: Column, x: Column, y: Column) -> Column:
    """Whether a point, moved up by a hair and right by a hair of a hair, lies left of the edge's direction.
    The move decides points on the edge's line, always alike."""
    dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
    cross = dx * (y - e["ay"]) - dy * (x - e["ax"])
    return F.when(cross != 0, cross > 0).when(dx != 0, dx > 0).otherwise(dy < 0)


def _beyond(e: Column, x: Column, y: Column) -> Column:
    """The edge meets the ray from the (moved) point to the right."""
    return ((e["ay"] > y) != (e["by"] > y)) & (_positive(e, x, y) == (e["by"] > e["ay"]))


def _above(e: Column, x: Column, y: Column) -> Column:
    """The edge meets the ray from the (moved) point upwards."""
    return ((e["ax"] > x) != (e["bx"] > x)) & (_positive(e, x, y) != (e["bx"] > e["ax"]))


def crossings_right(e: Column, x: Column, y: Column) -> Column:
    return _beyond(e, x, y).cast("int")


def crossings_to_corner(e: Column, x: Column, y: Column, right: Column, top: Column) -> Column:
    """How often an edge crosses the way from a point rightwards, then upwards to (right, top)."""
    level = _beyond(e, x, y) & ~_beyond(e, right, y)
    return level.cast("int") + (_above(e, right, y) & ~_above(e, right, top)).cast("int")


def on_edge(e: Column, x: Column, y: Column) -> Column:
    cross = (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])
    return ((cross == 0) & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"]))
            & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])))


def meets_box(e: Column, left: Column, bottom: Column, right: Column, top: Column) -> Column:
    """Whether an edge may touch a closed box; a hair of rounding counts as touching."""
    dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
    sides = [dx * (y - e["ay"]) - dy * (x - e["ax"]) for x in (left, right) for y in (bottom, top)]
    hair = (F.abs(dx) + F.abs(dy)) * 1e-14 * (F.abs(left) + F.abs(right) + F.abs(bottom) + F.abs(top)
                                              + F.abs(e["ax"]) + F.abs(e["ay"]))
    return ((F.greatest(e["ax"], e["bx"]) >= left) & (F.least(e["ax"], e["bx"]) <= right)
            & (F.greatest(e["ay"], e["by"]) >= bottom) & (F.least(e["ay"], e["by"]) <= top)
            & (F.least(*sides) <= hair) & (F.greatest(*sides) >= -hair))


def local_metres(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Equirectangular metres around a centre."""
    x = (lon - lon0) * C.METRES_PER_DEGREE_LON * F.cos(F.radians(lat0))
    y = (lat - lat0) * C.METRES_PER_DEGREE_LAT
    return x, y
