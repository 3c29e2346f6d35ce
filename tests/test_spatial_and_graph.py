import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.operators import graph, spatial, splits
from wardline.session import cut


def _brute(xy, k):
    out = {}
    for i, p in enumerate(xy):
        d = np.hypot(xy[:, 0] - p[0], xy[:, 1] - p[1])
        order = sorted((d[j], j) for j in range(len(xy)) if j != i)[:k]
        out[i] = [j for _, j in order]
    return out


@pytest.mark.parametrize("shape", ["clustered", "line", "few"])
def test_nearest_points_equal_brute_force(spark, shape):
    rng = np.random.default_rng(5)
    if shape == "clustered":      # a third of the points in a tiny spot, some far away
        xy = np.vstack([rng.normal(0, 1e-3, (150, 2)), rng.uniform(-500, 500, (250, 2)), [[1e5, 1e5], [-2e5, 3e4]]])
    elif shape == "line":
        xy = np.column_stack([np.arange(120) ** 2.0, np.zeros(120)])
    else:
        xy = rng.uniform(0, 1, (4, 2))
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, mx double, my double")
    got = {}
    for r in spatial.nearest_points(df, "id", 10).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["neighbor"]
    want = _brute(xy, 10)
    assert {i: [g[k] for k in sorted(g)] for i, g in got.items()} == want


def test_point_on_an_edge_is_not_located(spark):
    sq = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]]
    big = [[(2.0, 0.0), (9.0, 0.0), (9.0, 9.0), (2.0, 9.0), (2.0, 0.0)]]
    polys = spark.createDataFrame([("A", sq), ("B", big)], "geoid string, rings array<array<struct<x:double,y:double>>>")
    pts = spark.createDataFrame([(0.5, 0.5), (1.0, 0.5), (3.0, 8.0), (1.5, 0.5), (None, 1.0)], "lon double, lat double")
    got = {(r["lon"], r["lat"]): r["geoid"] for r in spatial.locate_in_polygons(pts, polys).collect()}
    assert got == {(0.5, 0.5): "A", (3.0, 8.0): "B"}


def _inside(px, py, rings):
    """Strictly inside by exact arithmetic."""
    px, py, odd = Fraction(px), Fraction(py), False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            ax, ay, bx, by = map(Fraction, (ax, ay, bx, by))
            cross = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
            if cross == 0 and min(ax, bx) <= px <= max(ax, bx) and min(ay, by) <= py <= max(ay, by):
                return False
            if (ay > py) != (by > py) and px < ax + (bx - ax) * (py - ay) / (by - ay):
                odd = not odd
    return odd


def test_cell_cover(spark, most=12):
    """Cells of few and of many edges answer as exact arithmetic does: on a grid that cell borders share,
    with holes, spikes, crossings, points on edges and corners, one polygon over all others, equal rows."""
    rng = random.Random(most)

    def star(x, y, r, n):
        return [(x + r * (0.3 + rng.random()) * math.cos(2 * math.pi * k / n), y + r * (0.3 + rng.random()) * math.sin(2 * math.pi * k / n)) for k in range(n)]

    def grid(n):
        return [(rng.randint(-8, 8) / 4, rng.randint(-8, 8) / 4) for _ in range(n)]

    rings = {"A": [star(0, 0, 3, 60)], "B": [[(0, 0), (2, 0), (2, 2), (0, 2)], [(0.5, 0.5), (1, 0.5), (1, 1), (0.5, 1)]], "C": [grid(9)], "D": [grid(15)],
             "0E": [star(1.3, -1, 0.01, 7)], "0F": [[(-1, -1), (1, 1), (-1, 1), (1, -1)]], "G": [[(0, 0), (1, 0)]], "Z": [star(0, 0, 40, 700)], "H": [star(-73.9, 40.7, 0.2, 90)]}
    rings = {k: [r + r[:1] for r in v] for k, v in rings.items()}
    pts = [(rng.randint(-12, 12) / 4, rng.randint(-12, 12) / 4) for _ in range(150)] + [(rng.uniform(-4, 4), rng.uniform(-4, 4)) for _ in range(150)]
    pts += [p for r in rings.values() for q in r for p in q[:20]] + [(rng.uniform(-60, 60), rng.uniform(-60, 60)) for _ in range(100)]
    pts += [(1.3 + rng.uniform(-.012, .012), -1 + rng.uniform(-.012, .012)) for _ in range(60)] + [(-73.9 + rng.uniform(-.3, .3), 40.7 + rng.uniform(-.3, .3)) for _ in range(80)]
    rows = [(k, [[{"x": float(x), "y": float(y)} for x, y in r] for r in v]) for k, v in rings.items()]
    polys = spark.createDataFrame(rows + rows[1:2] + [("N", None), ("M", [])], "geoid string, rings array<array<struct<x:double,y:double>>>")
    df = spark.createDataFrame([(float(x), float(y)) for x, y in pts] + [(None, 1.0)], "lon double, lat double")
    got = {(r["lon"], r["lat"]): r["geoid"] for r in spatial.locate_in_polygons(df, polys, most=most).collect()}
    want = {p: min((k for k, v in rings.items() if _inside(*p, v)), default=None) for p in {(float(x), float(y)) for x, y in pts}}
    assert got == {p: k for p, k in want.items() if k}
    assert set(got.values()) >= {"0E", "0F", "A", "B", "D", "H", "Z"}
    cover = spatial.cell_cover(polys, most=most).withColumn("n", F.size("edges"))
    big = cover.filter("geoid = 'Z'").agg(F.max("n").alias("n"), F.min("n").alias("free")).first()
    assert big["free"] == 0 and big["n"] <= most
    assert spatial.locate_in_polygons(df, polys.filter("geoid = 'none'")).count() == 0


def test_overlapping_polygons_meet_few_points(spark):
    """Many polygons over many points: smallest ids as by exact arithmetic, without pairing all of a place."""
    rng = random.Random(9)
    rings = {f"G{i:03d}": [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]
             for i in range(300) for x, y, w in [(rng.uniform(0, .04), rng.uniform(0, .04), rng.uniform(.035, .06))]}
    pts = [(rng.uniform(-.01, .11), rng.uniform(-.01, .11)) for _ in range(600)]
    polys = spark.createDataFrame([(k, [[{"x": x, "y": y} for x, y in r]]) for k, r in rings.items()],
                                  "geoid string, rings array<array<struct<x:double,y:double>>>")
    df = spark.createDataFrame(pts, "lon double, lat double")
    got = {(r["lon"], r["lat"]): r["geoid"] for r in spatial.locate_in_polygons(df, polys).collect()}
    want = {p: min((k for k, r in rings.items() if _inside(*p, [r])), default=None) for p in pts}
    assert got == {p: k for p, k in want.items() if k} and 100 < len(got) < 600
    cover = spatial.cell_cover(polys, points=df.toDF("px", "py"))
    size = F.pow(F.lit(2.0), F.col("level"))
    met = df.crossJoin(cover).filter((F.floor(F.col("lon") / size) == F.col("cx")) & (F.floor(F.col("lat") / size) == F.col("cy")))
    assert met.count() < 600 * 300 // 4


def test_click_cutoff(spark):
    h = spark.createDataFrame([(1, 40.0, -73.0, 5), (2, 40.001, -73.0, 0), (3, 40.0012, -73.0, 1)],
                              "household_id long, lat double, lon double, score_total int")
    c = spark.createDataFrame([(1, 40.0005, -73.0), (2, 40.01, -73.0), (3, 40.001, -73.0)], "click_id long, lat double, lon double")
    got = {r["click_id"]: r["household_id"] for r in spatial.nearest_household(c, h).collect()}
    assert got == {1: 1, 3: 3}


def test_clicks_meet_few_households(spark):
    """Exact on crowds, lone and shared spots, and far clicks; crowded cells are not paired as a whole."""
    rng = np.random.default_rng(5)
    r = 0.06
    at = np.concatenate([rng.uniform(0, 0.05, (1200, 2)), rng.normal(0.3, 1e-4, (300, 2)), rng.uniform(-1, 1, (30, 2))]) + [40.5, -73.9]
    at = np.concatenate([at, at[:200]])
    click = np.concatenate([rng.uniform(0, 0.05, (800, 2)), rng.normal(0.3, 2e-4, (200, 2)), rng.uniform(-1.2, 1.2, (60, 2))]) + [40.5, -73.9]
    click = np.concatenate([click, at[:50]])
    h = spark.createDataFrame([(len(at) - i, float(y), float(x), 1) for i, (y, x) in enumerate(at)], "household_id long, lat double, lon double, score_total int")
    c = spark.createDataFrame([(i, float(y), float(x)) for i, (y, x) in enumerate(click)] + [(9999, None, -73.9)], "click_id long, lat double, lon double")
    got = {x["click_id"]: x["household_id"] for x in spatial.nearest_household(c, h, r * r).collect()}
    want = {}
    for i, (y, x) in enumerate(click):
        d = (at[:, 0] - y) ** 2 + ((at[:, 1] - x) * math.cos(math.radians(y))) ** 2
        best = min((float(v), len(at) - j) for j, v in enumerate(d))
        if best[0] < r * r:
            want[i] = best[1]
    assert got == want and 1000 < len(want) < len(click)
    spots = h.select(F.col("lat").alias("h_lat"), F.col("lon").alias("h_lon"), "household_id")
    crowd = c.filter("click_id < 800")
    assert spatial._click_candidates(crowd, spots, r).count() < 100 * 800  # all in one cell of side r: 1200 each


@pytest.fixture(scope="module")
def nodes(spark):
    # group 0 holds 60 % of the nodes, one group has a single node
    return spark.range(1001).select(F.col("id").alias("node"), F.when(F.col("id") == 1000, 99).when(
        F.col("id") % 5 < 3, 0).otherwise(F.col("id") % 20).alias("g"), (F.col("id") % 2).alias("side"))


def test_sampled_peers(spark, nodes):
    e = graph.sample_group_peers(nodes, "g", 5)
    g = {r["node"]: r["g"] for r in nodes.collect()}
    rows = [(r["u"], r["v"]) for r in e.collect()]
    assert rows and all(u < v and g[u] == g[v] for u, v in rows)
    assert len(rows) == len(set(rows)) <= 5 * 1001
    assert not any(1000 in r for r in rows)
    again = {(r["u"], r["v"]) for r in graph.sample_group_peers(nodes.repartition(7), "g", 5).collect()}
    assert again == set(rows)


def test_sampled_peers_exclude_same(nodes):
    rows = graph.sample_group_peers(nodes, "g", 5, exclude="side").collect()
    assert rows and all(r["u"] % 2 != r["v"] % 2 for r in rows)


def test_household_edges_sample_only_large_households(spark):
    p = spark.createDataFrame([(i, 0) for i in range(3)] + [(i, 1) for i in range(3, 30)] + [(30, 2)],
                              "person_row long, household_row long")
    rows = {(r["u"], r["v"]) for r in graph.household_edges(p).collect()}
    assert {(0, 1), (0, 2), (1, 2)} <= rows
    large = [r for r in rows if r[0] >= 3]
    assert len(large) <= 27 * 5 and all(3 <= u < v < 30 for u, v in large)


def test_committee_size_limits(spark):
    d = spark.createDataFrame([(i, "BIG") for i in range(12)] + [(0, "ONE"), (1, "MID"), (2, "MID"), (1, "MID"),
                                                                (3, "winred"), (4, "WinRed")], "person_row long, committee string")
    got = {(r["node"], r["committee"]) for r in graph.codonor_members(d, high=10).collect()}
    assert got == {(1, "MID"), (2, "MID")}
    edges = graph.codonor_edges(d)
    assert all(r["u"] < r["v"] for r in edges.collect())


def test_spatial_edges_link_other_points(spark):
    p = spark.createDataFrame([(i, -73.0 - (i // 4) * 0.001, 40.0) for i in range(60)], "person_row long, lon double, lat double")
    rows = graph.spatial_edges(p, k=3).collect()
    assert rows and all(r["u"] < r["v"] and r["u"] // 4 != r["v"] // 4 for r in rows)
    assert all(abs(r["u"] // 4 - r["v"] // 4) <= 3 for r in rows)


def _walk(spark, pairs, n, steps, **kw):
    e = spark.createDataFrame([(u, v) for a, b in pairs for u, v in ((a, b), (b, a))], "u long, v long")
    c = spark.range(n).select(F.col("id").alias("person_row"), F.lit(0).alias("cluster"))
    return {r["person_row"]: [r[f"rw{k}"] for k in range(1, steps + 1)]
            for r in graph.random_walk_encoding(e, c, steps, **kw).collect()}


@pytest.mark.parametrize("limit", [{}, {"block": 1}])
def test_walks_on_known_graphs(spark, limit):
    cycle = _walk(spark, [(i, (i + 1) % 6) for i in range(6)], 7, 4, **limit)
    assert cycle[0] == pytest.approx([0, 0.5, 0, 0.375])       # bipartite: odd steps are 0
    assert cycle[6] == [0, 0, 0, 0]                            # isolated
    star = _walk(spark, [(0, i) for i in range(1, 5)], 5, 4, **limit)
    assert star[0] == pytest.approx([0, 1, 0, 1]) and star[2] == pytest.approx([0, .25, 0, .25])
    full = _walk(spark, [(i, j) for i in range(4) for j in range(i)], 4, 3, **limit)
    assert full[1] == pytest.approx([0, 1 / 3, 2 / 9])


def test_join_form_equals_numpy_form(spark):
    rng = np.random.default_rng(1)
    pairs = {tuple(sorted(map(int, rng.choice(40, 2, replace=False)))) for _ in range(90)}
    a = _walk(spark, pairs, 40, 5)
    b = _walk(spark, pairs, 40, 5, block=7)
    e = spark.createDataFrame([(u, v) for x, y in pairs for u, v in ((x, y), (y, x))], "u long, v long")
    c = {(r["node"], r["k"]): r["p"] for r in graph.return_probabilities_by_join(e, 5).collect()}
    for i in a:
        assert a[i] == b[i] and all(0 <= x <= 1 for x in a[i])
        assert a[i] == pytest.approx([c.get((i, k), 0.0) for k in range(1, 6)], abs=1e-12)


def test_walks_of_groups_are_not_exchanged(spark, monkeypatch):
    """Groups of both kinds, loops and repeated edges answer as one graph does; the powers move no rows."""
    rng = np.random.default_rng(3)
    pairs = [(g * 10 + int(a), g * 10 + int(b)) for g in range(4) for a, b in rng.integers(0, 4 + 2 * g, (12, 2))]
    rows = [(u // 10, u, v) for x, y in pairs for u, v in ((x, y), (y, x))]
    e = spark.createDataFrame(rows, "cluster long, u long, v long")
    want = {(r["node"], r["k"]): r["p"] or 0.0 for r in graph.return_probabilities_by_join(e.select("u", "v"), 7).collect()}
    for most in (2048, 7, 0):
        found = graph.return_probabilities_by_join(e, 7, "cluster", most)
        got = {(r["node"], r["k"]): r["p"] or 0.0 for r in found.collect()}
        assert got.keys() >= want.keys()
        assert all(p == pytest.approx(want.get(k, 0.0), abs=1e-12) for k, p in got.items())
    plans = []
    with monkeypatch.context() as m:
        m.setattr(graph, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
        graph.return_probabilities_by_join(e, 8, "cluster")
    plan = plans[-1]
    assert plan.count("SortMergeJoin") + plan.count("HashJoin") >= 6
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") > 0


def test_one_way_edges_give_one_answer(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3)], "u long, v long")
    c = spark.range(1, 4).select(F.col("id").alias("person_row"), F.lit(0).alias("cluster"))
    got = [{r["person_row"]: r["rw2"] for r in graph.random_walk_encoding(e, c, 2, block=b).collect()} for b in (1, 2048)]
    assert got[0] == got[1] == {1: 0.5, 2: 0.0, 3: 0.5}


def test_splits_keep_districts_whole(spark):
    p = spark.range(20000).select(F.concat(F.lit("E"), (F.col("id") % 400).cast("string")).alias("ed_key"),
                                  F.concat(F.lit("C"), (F.col("id") % 2).cast("string")).alias("county"))
    s = splits.split_by_people(p, 1)
    rows = s.collect()
    assert len(rows) == 400
    share = {}
    for r in rows:
        share[r["split"]] = share.get(r["split"], 0) + r["n_persons"] / 20000
    assert share["train"] == pytest.approx(.8, abs=.02) and share["val"] == pytest.approx(.1, abs=.02)
    assert {(r["ed_key"], r["split"]) for r in splits.split_by_people(p.repartition(5), 1).collect()} == {
        (r["ed_key"], r["split"]) for r in rows}


def test_bands_follow_numpy_quantiles_with_repeats(spark):
    rng = np.random.default_rng(2)
    lats = np.round(rng.uniform(40, 41, 230), 2)
    lats[:60] = 40.5
    df = spark.createDataFrame([(f"E{i}", "C", float(x)) for i, x in enumerate(lats)], "ed_key string, county string, lat double")
    q = min(20, max(1, len(lats) // 50))
    edges = np.unique(np.percentile(lats, np.linspace(0, 100, q + 1)))
    want = {f"E{i}": max(0, int((edges < x - 1e-12).sum()) - 1) for i, x in enumerate(lats)}
    assert {r["ed_key"]: r["band"] for r in splits.latitude_bands(df).collect()} == want


def test_packing_closes_at_the_first_district_that_reaches_the_target(spark):
    rng = np.random.default_rng(4)
    rows = [(f"E{i:03d}", "AB"[i % 2], int(rng.integers(0, 3)), float(rng.uniform(0, 1)), int(rng.integers(1, 90))) for i in range(80)]
    df = spark.createDataFrame(rows, "ed_key string, county string, band int, lon double, n long")
    got = {r["ed_key"]: r["cluster"] for r in splits.pack_districts(df, target=200).collect()}
    want, cid = {}, 0
    for county in "AB":
        cum = 0
        mine = sorted((b, lon if b % 2 == 0 else -lon, e, n) for e, c, b, lon, n in rows if c == county)
        for _, _, e, n in mine:
            if cum >= 200:
                cid, cum = cid + 1, 0
            want[e] = cid
            cum += n
        cid += 1
    assert got == want


def test_metric_scale(spark):
    p = spark.createDataFrame([(-73.0, 40.0), (-72.0, 40.0)], "lon double, lat double")
    xs = [r["mx"] for r in spatial.metric_points(p).collect()]
    assert abs(xs[0] - xs[1]) == pytest.approx(111320 * math.cos(math.radians(40)))
