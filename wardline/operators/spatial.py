"""Point-in-polygon, nearest neighbours and click lookup by grid cells."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import geometry
from ..functions.rounding import safe_ratio
from ..session import cut
from .groups import first_n


def _cell(c: Column, size: Column) -> Column:
    return F.floor(c / size).cast("bigint")


#: A cell with more edges of a polygon is split, down to cells of 2 ** LEAST_LEVEL.
CELL_EDGES = 32
LEAST_LEVEL = -30
#: A split halves a cell's side this often; levels are multiples of it, so few are in use.
_STEP = 2
#: A cell is split on while it holds more points than this and edges of more polygons.
FEW = 16


def _box(size: Column) -> list[Column]:
    cx, cy = F.col("cx"), F.col("cy")
    return [cx * size, cy * size, (cx + 1) * size, (cy + 1) * size]


def _with_points(cells: DataFrame, points: DataFrame) -> DataFrame:
    """Cells that can change the smallest id at a point: they hold points, and no polygon of smaller id covers them whole.
    With the number of their points and of polygons that have edges in them."""
    place = ["level", "cx", "cy"]
    levels = cells.agg(F.collect_set("level")).scalar()
    size = F.pow(F.lit(2.0), F.col("level"))
    held = points.withColumn("level", F.explode(levels)).select("level", _cell(F.col("px"), size).alias("cx"), _cell(F.col("py"), size).alias("cy"))
    met = cells.join(held.groupBy(*place).agg(F.count(F.lit(1)).alias("points")), place)
    shared = met.groupBy(*place).agg(F.min(F.when((F.col("n") == 0) & F.col("inside"), F.col("id"))).alias("whole"),
                                     F.count(F.when(F.col("n") > 0, 1)).alias("entries"))
    return met.join(shared, place).filter(F.col("whole").isNull() | (F.col("id") <= F.col("whole"))).drop("whole")


def cell_cover(polygons: DataFrame, polygon_id: str = "geoid", most: int = CELL_EDGES, least: int = LEAST_LEVEL,
               points: DataFrame | None = None, few: int = FEW) -> DataFrame:
    """Cells (polygon_id, part, level, cx, cy) that cover each row of polygons, without overlap, with its edges
    that meet the cell and whether the cell's upper right corner is inside. A cell without edges is inside
    as a whole. ``part`` tells rows of one id apart.

    A cell of level l has the side 2 ** l, so all borders are exact. A polygon starts with the one to four cells
    of its size; cells with many edges are split by rounds, each edge going to the children it meets. A
    child's corner is inside or not by its parent's corner and the parent's edges between the two: no round reads
    a polygon whole, and no row holds more than a cell's edges.

    With distinct ``points`` (px, py), cells that can't change the smallest id at any of them are left out, and
    edges of more than ``few`` polygons together with more than ``few`` points are split on: where many polygons
    overlap, a point meets those whose edges pass near it, not all of its surroundings."""
    def along(c: str) -> Column:
        return F.transform(F.flatten("rings"), lambda p: p[c])

    boxed = polygons.select(F.col(polygon_id).alias("id"), "rings", *(
        f(along(c)).alias(f"{c}{k}") for c in "xy" for k, f in enumerate((F.array_min, F.array_max)))).filter("x0 is not null and y0 is not null")
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(2.0 ** least))
    level = F.ceil(F.log2(extent) / _STEP).cast("int") * _STEP
    size = F.pow(F.lit(2.0), F.col("level"))

    def span(c: str) -> Column:
        return F.explode(F.sequence(_cell(F.col(f"{c}0"), size), _cell(F.col(f"{c}1"), size)))

    boxed = cut(boxed.withColumn("part", F.monotonically_increasing_id()))
    edges = boxed.withColumn("level", level).withColumn("e", F.explode(geometry.ring_edges(F.col("rings")))).drop("rings")
    key, above = ["id", "part", "level", "cx", "cy"], ["up_level", "up_cx", "up_cy"]
    rooted = edges.withColumn("cx", span("x")).withColumn("cy", span("y"))
    left, bottom, right, top = _box(size)
    rooted = rooted.select(*key, "e", geometry.crossings_right(F.col("e"), right, top).alias("crossed"),
                           geometry.meets_box(F.col("e"), left, bottom, right, top).alias("meets"))

    def counted(df: DataFrame) -> DataFrame:
        return df.groupBy(*key).agg(F.sum("crossed").alias("crossed"), F.count(F.when(F.col("meets"), 1)).alias("n"))

    cells = cut(counted(rooted).select(*key, (F.col("crossed") % 2 == 1).alias("inside"), "n"))
    parts = cut(rooted.filter("meets").select(*key, "e"))
    done = []
    ways = 1 << _STEP
    while True:
        crowded = F.col("n") > most
        if points is not None:
            cells = cut(_with_points(cells, points))
            crowded |= (F.col("n") > 0) & (F.col("points") > few) & (F.col("entries") > few)
        crowded &= F.col("level") - _STEP >= least
        kept = cells.filter(~crowded).filter("inside or n > 0")
        done.append(kept.join(parts, key, "left").groupBy(*key, "inside").agg(F.collect_list("e").alias("edges")))
        split = cells.filter(crowded).select(*key, "inside")
        if split.isEmpty():
            break
        steps = F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))
        up = F.pow(F.lit(2.0), F.col("level"))
        corners = [F.col("cx") + 1, F.col("cy") + 1]
        children = split.withColumns({"right": corners[0] * up, "top": corners[1] * up}).withColumn("i", steps).withColumn("j", steps)
        children = children.select("id", "part", *(F.col(c[3:]).alias(c) for c in above), "inside", "right", "top",
                                   (F.col("level") - _STEP).alias("level"), (F.col("cx") * ways + F.col("i")).alias("cx"),
                                   (F.col("cy") * ways + F.col("j")).alias("cy"))
        near = parts.select("id", "part", *(F.col(c[3:]).alias(c) for c in above), "e").join(children, ["id", "part", *above])
        left, bottom, right, top = _box(size)
        near = near.select(*key, "e", geometry.crossings_to_corner(F.col("e"), right, top, F.col("right"), F.col("top")).alias("crossed"),
                           geometry.meets_box(F.col("e"), left, bottom, right, top).alias("meets")).filter("meets or crossed > 0")
        near = cut(near)
        cells = cut(children.select(*key, "inside").join(counted(near), key, "left").select(
            *key, (F.col("inside") != (F.coalesce("crossed", F.lit(0)) % 2 == 1)).alias("inside"), F.coalesce("n", F.lit(0)).alias("n")))
        parts = near.filter("meets").select(*key, "e")
    return reduce(DataFrame.unionByName, done).withColumnRenamed("id", polygon_id)


def locate_in_polygons(points: DataFrame, polygons: DataFrame, polygon_id: str = "geoid",
                       x: str = "lon", y: str = "lat", most: int = CELL_EDGES) -> DataFrame:
    """Distinct points with the polygon they lie strictly within; others are left out.

    Points meet the cells of ``cell_cover``: a cell without edges answers at once, another by its own
    edges between the point and its corner. So a point pays for few edges, however large the polygon, and
    rings are not exchanged. Where polygons overlap, the smallest id is kept.
    """
    pts = cut(points.select(F.col(x).alias("px"), F.col(y).alias("py")).dropna().distinct())
    cover = cut(cell_cover(polygons, polygon_id, most, points=pts))
    levels = cover.agg(F.collect_set("level")).scalar()  # a handful
    size = F.pow(F.lit(2.0), F.col("level"))
    probes = pts.withColumn("level", F.explode(levels)).withColumns({"cx": _cell(F.col("px"), size), "cy": _cell(F.col("py"), size)})
    # the rows are small and their test is dear, so the number of tasks is not left to their size
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = probes.repartition(tasks, "level", "cx", "cy").join(cover.hint("shuffle_merge"), ["level", "cx", "cy"])
    px, py = F.col("px"), F.col("py")
    left, bottom, right, top = _box(size)
    ways = F.aggregate("edges", F.lit(0), lambda n, e: n + geometry.crossings_to_corner(e, px, py, right, top))
    inside = ~F.exists("edges", lambda e: geometry.on_edge(e, px, py)) & (F.col("inside") != (ways % 2 == 1))
    return near.filter(F.when(F.size("edges") == 0, F.col("inside")).otherwise(inside)).groupBy(
        F.col("px").alias(x), F.col("py").alias(y)).agg(F.min(polygon_id).alias(polygon_id))


def attach_polygon(people: DataFrame, located: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    return people.join(located, [x, y], "left")


def metric_points(points: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """Distinct points with local metres around their mean."""
    p = points.select(x, y).dropna().distinct()
    c = p.agg(F.struct(F.avg(x).alias("x"), F.avg(y).alias("y")).alias("c")).scalar()
    mx, my = geometry.local_metres(F.col(x), F.col(y), c["x"], c["y"])
    return p.withColumns({"mx": mx, "my": my})


def nearest_points(points: DataFrame, point_id: str, k: int = C.KNN_K, max_level: int = 26,
                   x: str = "mx", y: str = "my") -> DataFrame:
    """The k nearest other points of every point: (id, neighbor, distance, rank). Exact.

    Points on one spot share their answers, so spots search: each offers its k + 1
    smallest ids (ties go by id) and finds the k + 1 nearest, of which a point
    leaves out itself.

    Cells halve per level. A spot searches on the finest level at which its own
    cell holds more than k offered points: the k-th neighbour is then no farther
    than the cell's far corner, and every cell within that distance is looked at. As
    a finer cell of the spot holds at most k points, few spots search a crowded
    cell, and the candidate pairs grow linearly with the points.
    """
    own = points.select(F.col(point_id).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"))
    # the points of a spot in order; adding 0.0 makes one spot of both zeros
    own = own.withColumns({"x": F.col("x") + 0.0, "y": F.col("y") + 0.0})
    p = (first_n(own, ["x", "y"], ["id"], k + 1, "r").groupBy("x", "y")
         .agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("id", F.col("ids")[0]))
    box = p.agg(F.struct(
        F.min("x").alias("x"), F.min("y").alias("y"),
        F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-9)).alias("w"))
        .alias("b")).scalar()
    side = 1 << max_level
    p = p.withColumn("box", box)

    def fine(c: Column, low: Column) -> Column:
        return F.least(F.lit(side - 1), F.floor((c - low) / F.col("box.w") * side)).cast("bigint")

    # counted, searched and offered below, so the placed points are stored once
    p = cut(p.withColumns({"fx": fine(F.col("x"), F.col("box.x")),
                           "fy": fine(F.col("y"), F.col("box.y"))}))

    def at_level(c: str) -> Column:
        return F.call_function("shiftright", F.col(c), F.lit(max_level) - F.col("level"))

    cells = p.groupBy("fx", "fy").agg(F.sum(F.size("ids")).alias("n"))
    stacked = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(max_level)))) \
        .withColumns({"cx": at_level("fx"), "cy": at_level("fy")})
    full = stacked.groupBy("level", "cx", "cy").agg(F.sum("n").alias("n")).filter(F.col("n") > k)
    levels = stacked.drop("n").join(full, ["level", "cx", "cy"]).groupBy("fx", "fy").agg(
        F.max("level").alias("level"))
    seek = p.join(levels, ["fx", "fy"], "left").fillna(0, ["level"])
    size = F.col("box.w") / F.pow(F.lit(2.0), F.col("level"))
    seek = seek.withColumn("s", size).withColumns({
        "lx": F.col("box.x") + at_level("fx") * F.col("s"),
        "ly": F.col("box.y") + at_level("fy") * F.col("s")})
    reach = F.sqrt(F.pow(F.greatest(F.col("x") - F.col("lx"), F.col("lx") + F.col("s") - F.col("x")), F.lit(2.0))
                   + F.pow(F.greatest(F.col("y") - F.col("ly"), F.col("ly") + F.col("s") - F.col("y")), F.lit(2.0)))
    # a hair wider, so that rounding never hides a neighbour on the rim
    seek = seek.withColumn("reach", reach * (1 + 1e-9))
    # at level 0 one cell holds everything
    whole = F.col("level") == 0

    def span(c: str, low: str) -> Column:
        lo = F.greatest(F.lit(0), F.floor((F.col(c) - F.col("reach") - F.col(f"box.{low}")) / F.col("s")))
        top = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("level").cast("int")) - 1
        hi = F.least(top, F.floor((F.col(c) + F.col("reach") - F.col(f"box.{low}")) / F.col("s")))
        return F.sequence(F.when(whole, F.lit(0)).otherwise(lo).cast("bigint"),
                          F.when(whole, F.lit(0)).otherwise(hi).cast("bigint"))

    asks = (seek.withColumn("cx", F.explode(span("x", "x")))
            .withColumn("cy", F.explode(span("y", "y")))
            .select("id", "x", "y", "reach", "level", "cx", "cy"))
    used = levels.agg(F.collect_set("level")).scalar()
    offered = p.withColumn("level", F.explode(F.when(F.size(used) > 0, used)
                                              .otherwise(F.array(F.lit(0))))) \
        .withColumns({"cx": at_level("fx"), "cy": at_level("fy")}) \
        .select("ids", F.col("x").alias("nx"), F.col("y").alias("ny"), "level", "cx", "cy")
    d2 = (F.col("x") - F.col("nx")) * (F.col("x") - F.col("nx")) \
        + (F.col("y") - F.col("ny")) * (F.col("y") - F.col("ny"))
    pairs = (asks.join(offered, ["level", "cx", "cy"])
             .withColumn("distance", F.sqrt(d2))
             .filter((F.col("level") == 0) | (F.col("distance") <= F.col("reach")))
             .select("id", F.explode("ids").alias("neighbor"), "distance"))
    top = first_n(pairs, ["id"], ["distance", "neighbor"], k + 1, "r").drop("r").withColumnRenamed("id", "spot")
    spots = p.select(F.col("id").alias("spot"), "x", "y")
    other = own.join(spots, ["x", "y"]).join(top, "spot").filter(F.col("id") != F.col("neighbor"))
    return first_n(other.select("id", "neighbor", "distance"), ["id"], ["distance", "neighbor"], k, "rank").withColumnRenamed(
        "id", point_id)


#: Levels of the click grid: a level's cells have a quarter of the side of the level's before.
CLICK_LEVELS = range(0, 13, 2)


def _click_candidates(clicks: DataFrame, spots: DataFrame, r: float) -> DataFrame:
    """Clicks with the spots (h_lat, h_lon, household_id) that may be their nearest within ``r``.

    A click looks on the finest level on which its own cell holds a spot: the nearest is no farther than that cell's far
    corner. Its cell on the next level is empty, so the pairs grow with clicks and spots, not with both together.
    A click whose cell is empty on all levels looks as far as ``r``.
    """
    last = CLICK_LEVELS[-1]
    fine = r / (1 << last)

    def fine_cell(c: Column) -> Column:
        return F.floor(c / fine).cast("bigint")

    def at_level(c: Column) -> Column:
        return F.call_function("shiftright", c, F.lit(last) - F.col("level"))

    def placed(df: DataFrame, lon: str, lat: str, levels: Column) -> DataFrame:
        return df.withColumn("level", F.explode(levels)).withColumns(
            {"cx": at_level(fine_cell(F.col(lon))), "cy": at_level(fine_cell(F.col(lat)))})

    every = F.array(*[F.lit(x) for x in CLICK_LEVELS])
    full = placed(spots, "h_lon", "h_lat", every).select("level", "cx", "cy").distinct()
    own = placed(clicks.select("lat", "lon").dropna().distinct(), "lon", "lat", every).join(full, ["level", "cx", "cy"]).groupBy(
        "lat", "lon").agg(F.max("level").alias("level"))
    seek = clicks.join(own, ["lat", "lon"], "left").withColumn("empty", F.col("level").isNull()).fillna(0, ["level"])
    shrink = F.cos(F.radians("lat"))
    side = F.lit(fine) * F.pow(F.lit(2.0), F.lit(last) - F.col("level"))

    def far(c: str) -> Column:
        low = at_level(fine_cell(F.col(c))) * side
        return F.greatest(F.col(c) - low, low + side - F.col(c))

    dx, dy = far("lon") * shrink, far("lat")
    # a hair wider, so that rounding never hides a spot on the rim
    seek = seek.withColumn("reach", F.when(F.col("empty"), F.lit(r)).otherwise(
        F.least(F.lit(r), F.sqrt(dx * dx + dy * dy) * (1 + 1e-6))))
    lon_reach = safe_ratio(F.col("reach"), shrink)

    def span(c: Column, reach: Column) -> Column:
        return F.explode(F.sequence(at_level(fine_cell(c - reach)), at_level(fine_cell(c + reach))))

    asks = seek.withColumn("cx", span(F.col("lon"), lon_reach)).withColumn("cy", span(F.col("lat"), F.col("reach"))).drop("empty", "reach")
    return asks.join(placed(spots, "h_lon", "h_lat", every), ["level", "cx", "cy"])


def nearest_household(clicks: DataFrame, households: DataFrame, cutoff: float = C.CLICK_CUTOFF_DEG2,
                      scored_only: bool = True) -> DataFrame:
    """Nearest household per click in degrees with the longitude shrunk by latitude, the smallest id of equally near ones.

    ``clicks``: click_id, lat, lon. Only cells within the cutoff are looked at.
    """
    h = households.filter((F.coalesce("lat", F.lit(0.0)) != 0) & (F.coalesce("lon", F.lit(0.0)) != 0))
    if scored_only:
        h = h.filter(F.col("score_total") != 0)
    # households on one spot are equally near; the cells and the candidates read the spots
    spots = cut(h.groupBy(F.col("lat").alias("h_lat"), F.col("lon").alias("h_lon")).agg(F.min("household_id").alias("household_id")))
    dlat = F.col("h_lat") - F.col("lat")
    dlon = (F.col("h_lon") - F.col("lon")) * F.cos(F.radians("lat"))
    return (_click_candidates(clicks.select("click_id", "lat", "lon"), spots, cutoff ** 0.5).withColumn("d", dlat * dlat + dlon * dlon)
            .filter(F.col("d") < cutoff).groupBy("click_id")
            .agg(F.min(F.struct("d", "household_id")).alias("m"))
            .select("click_id", "m.household_id", F.col("m.d").alias("distance_deg2")))


def polygon_area_km2(aland: Column) -> Column:
    return F.greatest(aland, F.lit(1)) / 1e6
