"""Queries over places, graph, splits, features, measures and models."""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import (context, donations, features, geocode, graph, history, metrics, models,
                         spatial, splits)
from ..session import cut
from ..sources import files
from .donation_queries import CUTOFF
from .registry import query
from .standin import REF_YEAR, TARGET, Views

# ----------------------------------------------------------------------- places

_GEO_SQL = """side AS (
         SELECT p_partkey AS ordinal, 'STREET' || (p_partkey % 40) || ' AVE' AS street, 0 AS side,
           CASE WHEN p_partkey % 5 = 0 THEN b + 48 ELSE b END AS lo,
           CASE WHEN p_partkey % 5 = 0 THEN b ELSE b + 48 END AS hi,
           CASE WHEN p_partkey % 4 = 1 THEN '' ELSE lpad(CAST(p_partkey % 25 AS VARCHAR), 5, '0') END AS sz
         FROM (SELECT *, (p_partkey // 40 % 8) * 50 + 1 AS b FROM part)
         UNION ALL
         SELECT p_partkey, 'STREET' || (p_partkey % 40) || ' AVE', 1, b + 1,
           CASE WHEN p_partkey % 50 = 7 THEN b + 1 ELSE b + 49 END,
           CASE WHEN p_partkey % 4 = 2 THEN '' ELSE lpad(CAST(p_partkey % 25 AS VARCHAR), 5, '0') END
         FROM (SELECT *, (p_partkey // 40 % 8) * 50 + 1 AS b FROM part)),
       addr AS (SELECT c_custkey AS address_id, CASE WHEN c_custkey % 31 <> 0 THEN c_custkey * 13 % 410 + 1 END AS n,
         'STREET' || (c_custkey % 42) || ' AVE' AS street,
         CASE WHEN c_custkey % 12 = 0 THEN '' ELSE lpad(CAST(c_custkey * 3 % 25 AS VARCHAR), 5, '0') END AS zip
         FROM customer),
       hit AS (SELECT *, zip = '' OR sz = zip AS ok, zip <> '' AND sz <> '' AND sz <> zip AS clash
         FROM addr JOIN side USING (street) WHERE n BETWEEN least(lo, hi) AND greatest(lo, hi)),
       pick AS (SELECT address_id, any_value(n) AS n,
         CASE WHEN count(*) FILTER (ok) > 0 THEN arg_min((ordinal, lo, hi), (ordinal, side)) FILTER (ok)
           WHEN count(*) FILTER (NOT ok AND clash) > 0 THEN NULL
           ELSE arg_min((ordinal, lo, hi), (ordinal, side)) FILTER (NOT ok AND NOT clash) END AS s
         FROM hit GROUP BY 1),
       spot AS (SELECT address_id, s[1] AS o, CASE WHEN s[2] = s[3] THEN 0.5
           ELSE (n - s[2]) / (s[3] - s[2]) END * 0.0010381 AS t FROM pick WHERE s IS NOT NULL),
       coded AS (SELECT address_id, round_even(-73.9 + (o % 100) * 0.001 + least(t, 0.00062), 5) AS lon,
         round_even(40.5 + (o // 100 % 100) * 0.001 + greatest(t - 0.00062, 0), 5) AS lat FROM spot)"""


@query("geocode", "J8 F1 F2 F3 S11 D11", "address_id:i lon:d lat:d",
       f"WITH {_GEO_SQL} SELECT address_id, lon, lat FROM addr LEFT JOIN coded USING (address_id)")
def _(v):
    return geocode.geocode(v.addresses, v.segments)


@query("geocode_rate", "J8 A39", "addresses:i geocoded:i",
       f"""WITH {_GEO_SQL} SELECT count(*) AS addresses, count(lon) AS geocoded FROM addr
       LEFT JOIN coded USING (address_id)""")
def _(v):
    return geocode.match_rate(geocode.geocode(v.addresses, v.segments))


@query("major_roads", "P15 U1", "ordinal:i name:s points:i first_lat:d",
       """SELECT p_partkey AS ordinal, 'Street' || (p_partkey % 40)
         || CASE WHEN p_partkey % 3 = 0 THEN ' Ave' ELSE ' Avenue' END AS name, 6 AS points,
       round_even(40.5 + (p_partkey // 100 % 100) * 0.001, 5) AS first_lat FROM part
       WHERE p_partkey % 6 IN (0, 1) AND -73.9 + (p_partkey % 100) * 0.001 + 0.00062 >= -73.88
         AND -73.9 + (p_partkey % 100) * 0.001 <= -73.83""")
def _(v):
    r = geocode.major_roads(v.segments, F.lit(-73.88), F.lit(-73.83), F.lit(40.0), F.lit(41.0),
                            C.MAJOR_ROAD_CLASSES)
    return r.select("ordinal", "name", F.size("line").alias("points"), F.get("line", F.lit(0)).alias("first_lat"))


@query("first_seen_codes", "F17 U1 K3", "county:s street:s code:i",
       """SELECT county, street, row_number() OVER (PARTITION BY county ORDER BY min(household_row)) - 1 AS code
       FROM household GROUP BY county, street""")
def _(v):
    return geocode.first_seen_codes(v.households, "street", "household_row", ["county"], block=20)


_POLY_SQL = """poly AS (SELECT 'G' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS geoid, s_suppkey AS s,
         -0.35 + (s_suppkey % 10) * 0.07 AS x, -0.35 + (s_suppkey // 10 % 10) * 0.07 AS y,
         0.02 + (s_suppkey % 3) * 0.02 AS w FROM supplier)"""


@query("point_in_polygon", "J7 S12 D12", "vec_id:i geoid:s",
       f"""WITH {_POLY_SQL}, g AS (SELECT vec_id, min(geoid) AS geoid FROM pt JOIN poly
         ON lon > x AND lon < x + w AND lat > y AND lat < y + w AND (s % 2 = 0 OR (lon - x) + (lat - y) < w)
         GROUP BY 1) SELECT vec_id, geoid FROM pt LEFT JOIN g USING (vec_id)""")
def _(v):
    return spatial.attach_polygon(v.points, spatial.locate_in_polygons(v.points, v.polygons))


def _star() -> list[str]:
    """Corners of a star around all points, for i from 0 to 3999, in the dialect of both engines."""
    r, t = "(0.2 + 0.25 * (i * 7919 % 97) / 97)", "(i * 2 * pi() / 4000)"
    return [f"{r} * cos({t}) AS px", f"{r} * sin({t}) AS py"]


@query("point_in_large_polygon", "J7 S12 D12", "vec_id:i geoid:s",
       f"""WITH {_POLY_SQL}, corner AS (SELECT range AS i0, range % 4000 AS i FROM range(4001)),
       c AS (SELECT i0, {', '.join(_star())} FROM corner),
       edge AS (SELECT px, py, lead(px) OVER (ORDER BY i0) AS qx, lead(py) OVER (ORDER BY i0) AS qy FROM c),
       big AS (SELECT vec_id FROM pt JOIN edge ON (py > lat) <> (qy > lat) AND lon < px + (qx - px) * (lat - py) / (qy - py)
         GROUP BY 1 HAVING count(*) % 2 = 1),
       h AS (SELECT vec_id, geoid FROM pt JOIN poly ON lon > x AND lon < x + w AND lat > y AND lat < y + w AND (s % 2 = 0 OR (lon - x) + (lat - y) < w)
         UNION ALL SELECT vec_id, 'H' FROM big),
       g AS (SELECT vec_id, min(geoid) AS geoid FROM h GROUP BY 1) SELECT vec_id, geoid FROM pt LEFT JOIN g USING (vec_id)""")
def _(v):
    corners = v.spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(4000))).alias("i0")).selectExpr("i0", "i0 % 4000 AS i").selectExpr("i0", *_star())
    ring = F.transform(F.array_sort(F.collect_list(F.struct("i0", F.col("px").alias("x"), F.col("py").alias("y")))),
                       lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y")))
    big = corners.agg(F.array(ring).alias("rings")).select(F.lit("H").alias("geoid"), "rings")
    polygons = v.polygons.select("geoid", "rings").unionByName(big)
    return spatial.attach_polygon(v.points, spatial.locate_in_polygons(v.points, polygons))


@query("polygon_areas", "S13", "geoid:s area_km2:d",
       f"WITH {_POLY_SQL} SELECT geoid, greatest(s * 12345 % 7, 1) / 1e6 * 1e6 AS area_km2 FROM poly")
def _(v):
    return v.polygons.select("geoid", (spatial.polygon_area_km2(F.col("aland")) * 1e6).alias("area_km2"))


@query("nearest_points", "J17 F18", "vec_id:i neighbor:i rank:i distance:d",
       """WITH c AS (SELECT avg(lon) AS lon0, avg(lat) AS lat0 FROM (SELECT DISTINCT lon, lat FROM pt)),
       m AS (SELECT vec_id, (lon - lon0) * 111320 * cos(radians(lat0)) AS x, (lat - lat0) * 110540 AS y FROM pt, c),
       d AS (SELECT a.vec_id, b.vec_id AS neighbor, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance
         FROM m a, m b WHERE a.vec_id <> b.vec_id)
       SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor) AS rank FROM d)
       WHERE rank <= 10""")
def _(v):
    m = spatial.metric_points(v.points).join(v.points, ["lon", "lat"])
    return spatial.nearest_points(m, "vec_id")


@query("nearest_points_shared_spot", "J17 F18", "vec_id:i neighbor:i rank:i distance:d",
       """WITH m AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE lon END::DOUBLE AS x,
           CASE WHEN vec_id % 3 = 0 THEN 0 ELSE lat END::DOUBLE AS y FROM pt),
       d AS (SELECT a.vec_id, b.vec_id AS neighbor, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance
         FROM m a, m b WHERE a.vec_id <> b.vec_id)
       SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor) AS rank FROM d)
       WHERE rank <= 10""")
def _(v):
    spot = F.col("vec_id") % 3 == 0
    return spatial.nearest_points(v.points.select("vec_id", F.when(spot, 0.0).otherwise(F.col("lon")).alias("mx"),
                                                  F.when(spot, 0.0).otherwise(F.col("lat")).alias("my")), "vec_id")


@query("click_lookup", "J21", "click_id:i household_id:i distance_deg2:d",
       """WITH click AS (SELECT s_suppkey AS click_id, 40.5 + (s_suppkey * 977 % 5000) / 10000.0 AS lat,
         -73.9 + (s_suppkey * 1733 % 9000) / 10000.0 AS lon FROM supplier),
       d AS (SELECT click_id, household_id, (h.lat - c.lat) ** 2 + ((h.lon - c.lon) * cos(radians(c.lat))) ** 2 AS d
         FROM click c, household h WHERE h.lat IS NOT NULL AND score_total <> 0)
       SELECT click_id, arg_min(household_id, (d, household_id)) AS household_id, min(d) * 1e3 AS distance_deg2
       FROM d WHERE d < 3.5e-3 GROUP BY 1""")
def _(v):
    s = F.col("s_suppkey")
    clicks = v.table("supplier").select(
        s.alias("click_id"), (40.5 + (s * 977 % 5000) / 10000.0).alias("lat"),
        (-73.9 + (s * 1733 % 9000) / 10000.0).alias("lon"))
    # a wide cutoff, so that the sparse test households are within reach
    n = spatial.nearest_household(clicks, v.households, cutoff=3.5e-3)
    return n.withColumn("distance_deg2", F.col("distance_deg2") * 1e3)


def _census(v: Views) -> DataFrame:
    tables = [files.clean_census_table(df, C.CENSUS_TABLES[t], ["1500000US36059"])
              for t, df in v.census_tables()]
    return features.merge_census(tables)


def _n(i: int) -> str:
    return (f"CASE WHEN s % 11 = {i % 11} THEN NULL WHEN s % 7 = {i % 7} THEN 0 WHEN s % 23 = {i % 23} THEN NULL "
            f"ELSE s * {i + 3} % 500 + 1 END")


@query("census_features", "S10 J4 F22 D13",
       "bg_geoid:s acs_median_hh_income:d acs_median_age:d acs_pct_white:d acs_pct_black:d acs_pct_asian:d "
       "acs_pct_hispanic:d acs_pct_bachelors:d acs_pct_owner_occ:d acs_pop_density:d",
       f"""WITH n AS (SELECT s_suppkey AS s, '36059' || lpad(CAST(s_suppkey AS VARCHAR), 7, '0') AS bg_geoid
         FROM supplier WHERE s_suppkey % 10 <> 9),
       c AS (SELECT s, bg_geoid, CASE WHEN s % 13 <> 0 THEN {_n(0)} END AS inc, CASE WHEN s % 13 <> 1 THEN {_n(5)} END AS age,
         CASE WHEN s % 13 <> 2 THEN {_n(10)} END AS pop, CASE WHEN s % 13 <> 2 THEN {_n(11)} END AS wh,
         CASE WHEN s % 13 <> 2 THEN {_n(12)} END AS bl, CASE WHEN s % 13 <> 2 THEN {_n(13)} END AS az,
         CASE WHEN s % 13 <> 2 THEN {_n(14)} END AS hi, CASE WHEN s % 13 <> 3 THEN {_n(15)} END AS edu,
         CASE WHEN s % 13 <> 3 THEN coalesce({_n(16)}, 0) + coalesce({_n(17)}, 0) + coalesce({_n(18)}, 0)
           + coalesce({_n(19)}, 0) END AS deg,
         CASE WHEN s % 13 <> 4 THEN {_n(20)} END AS ten, CASE WHEN s % 13 <> 4 THEN {_n(21)} END AS own FROM n)
       SELECT bg_geoid, inc AS acs_median_hh_income, age AS acs_median_age, wh / nullif(pop, 0) AS acs_pct_white,
         bl / nullif(pop, 0) AS acs_pct_black, az / nullif(pop, 0) AS acs_pct_asian, hi / nullif(pop, 0) AS acs_pct_hispanic,
         deg / nullif(edu, 0) AS acs_pct_bachelors, own / nullif(ten, 0) AS acs_pct_owner_occ,
         pop / (s % 5 + 1) AS acs_pop_density FROM c""")
def _(v):
    s = F.col("s_suppkey")
    area = v.table("supplier").select(F.concat(F.lit("36059"), F.lpad(s.cast("string"), 7, "0")).alias("bg_geoid"),
                                      (s % 5 + 1).alias("area_km2"))
    return features.census_features(_census(v), area)


@query("people_with_census", "J4 K2", "person_row:i acs_median_age:d",
       f"""WITH n AS (SELECT s_suppkey AS s FROM supplier WHERE s_suppkey % 10 <> 9 AND s_suppkey % 13 <> 1)
       SELECT person_row, {_n(5)} AS acs_median_age FROM person LEFT JOIN n ON s = person_row % 97""")
def _(v):
    p = v.people.withColumn("bg_geoid", F.concat(F.lit("36059"), F.lpad(
        (F.col("person_row") % 97).cast("string"), 7, "0"))).withColumn("acs_median_age", F.lit(-1.0))
    feats = _census(v).select("bg_geoid", F.col("median_age").alias("acs_median_age"))
    return features.attach_census(p, feats)


# ------------------------------------------------------------------------ graph

_CLIQUE_SQL = """clique AS (SELECT a.person_row AS u, b.person_row AS v FROM person a JOIN person b USING (household_row)
         WHERE a.person_row < b.person_row)"""
_EDGE_SQL = f"""{_CLIQUE_SQL},
       edge AS (SELECT u, v, arg_min(etype, p) AS etype FROM (
         SELECT u, v, 'household' AS etype, 0 AS p FROM clique
         UNION ALL SELECT person_row, person_row + 1, 'ed', 4 FROM person
         UNION ALL SELECT person_row, person_row + 3, 'spatial_knn', 3 FROM person WHERE person_row % 5 <> 0
         UNION ALL SELECT person_row, person_row + 1, 'donation', 2 FROM person WHERE person_row % 2 = 0)
         WHERE v <= (SELECT max(person_row) FROM person) GROUP BY 1, 2),
       way AS (SELECT u, v, etype FROM edge UNION ALL SELECT v, u, etype FROM edge),
       inner_way AS (SELECT *, u // 40 AS cluster FROM way WHERE u // 40 = v // 40)"""


@query("household_edges", "G2 J16", "u:i v:i", f"WITH {_CLIQUE_SQL} SELECT u, v FROM clique")
def _(v):
    return graph.household_edges(v.people)


def _draw(*parts: str) -> str:
    """``ids.draw`` in SQL."""
    return "CAST('0x' || substr(md5(" + " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "), 1, 15) AS BIGINT)"


def _peers(nodes: str, draws: str, seed: int) -> str:
    """Sampled pairs of the members (g, node, x) of groups; members of one x are no pair."""
    return f"""SELECT DISTINCT least(a.node, b.node) AS u, greatest(a.node, b.node) AS v FROM (
           SELECT *, unnest(range(1, {draws} + 1)) AS draw FROM {nodes}_placed) a
         JOIN {nodes}_placed b ON a.g = b.g AND b.pos = {_draw(seed + 1, 'a.node', 'a.draw')} % a.size
         WHERE a.node <> b.node AND a.x <> b.x"""


def _placed(nodes: str, seed: int) -> str:
    return f"""{nodes}_placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY {_draw(seed, 'node')}, node) - 1 AS pos,
         count(*) OVER (PARTITION BY g) AS size FROM {nodes} WHERE g IS NOT NULL)"""


_HOUSE_SQL = f"""house AS (SELECT household_row AS g, person_row AS node, person_row AS x FROM person
         WHERE household_row IN (SELECT household_row FROM person GROUP BY 1 HAVING count(*) > 2)), {_placed('house', 0)}"""
_ADDRESS_SQL = f"""placed_person AS (SELECT p.person_row AS node, p.household_row AS x,
           p.county || '|' || p.city || '|' || street || '|' || address_num AS g FROM person p JOIN household h USING (household_row)),
       address AS (SELECT * FROM placed_person WHERE g IN (SELECT g FROM placed_person GROUP BY 1 HAVING count(DISTINCT x) > 1)), {_placed('address', 10)}"""
_DISTRICT_SQL = f"district AS (SELECT ed_key AS g, person_row AS node, person_row AS x FROM person), {_placed('district', 20)}"
_CODONOR_SQL = f"""gave AS (SELECT DISTINCT person_row AS node, coalesce(committee, '') AS g FROM person JOIN donation USING (donor_key)
         WHERE confirmed AND donation_date < DATE '2000-11-07' AND upper(coalesce(committee, '')) NOT IN ('ACTBLUE', 'WINRED')),
       codonor AS (SELECT g, node, node AS x FROM gave WHERE g IN (SELECT g FROM gave GROUP BY 1 HAVING count(*) BETWEEN 2 AND 5000)),
       {_placed('codonor', 40)}"""
_NEAR_SQL = f"""located AS (SELECT person_row AS node, lon, lat FROM person JOIN pt ON vec_id = person_row % (SELECT count(*) FROM pt)),
       spot AS (SELECT lon, lat, min(node) AS point FROM located GROUP BY 1, 2),
       metre AS (SELECT point, (lon - (avg(lon) OVER ())) * 111320.0::DOUBLE * cos(radians(avg(lat) OVER ())) AS x,
         (lat - (avg(lat) OVER ())) * 110540.0::DOUBLE AS y FROM spot),
       near AS (SELECT * FROM (SELECT a.point, b.point AS neighbor, row_number() OVER (PARTITION BY a.point
         ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.point) AS r FROM metre a JOIN metre b ON a.point <> b.point) WHERE r <= 10),
       member AS (SELECT point AS g, node, node AS x FROM located JOIN spot USING (lon, lat)), {_placed('member', 30)},
       knn AS (SELECT DISTINCT least(m.node, p.node) AS u, greatest(m.node, p.node) AS v FROM member m JOIN near ON near.point = m.g
         JOIN (SELECT g, any_value(size) AS n FROM member_placed GROUP BY 1) z ON z.g = neighbor
         JOIN member_placed p ON p.g = neighbor AND p.pos = {_draw(31, 'm.node', 'neighbor')} % n)"""


@query("household_peers", "G2 G1", "u:i v:i", f"""WITH {_CLIQUE_SQL}, {_HOUSE_SQL}
       SELECT u, v FROM clique WHERE u NOT IN (SELECT node FROM house) UNION ALL {_peers('house', '5', 0)}""")
def _(v):
    return graph.household_edges(v.people, limit=2)


@query("same_address_edges", "G3 G1", "u:i v:i", f"WITH {_ADDRESS_SQL} {_peers('address', '5', 10)}")
def _(v):
    return graph.same_address_edges(v.placed_people, seed=10)


@query("district_edges", "G4 G1", "u:i v:i", f"WITH {_DISTRICT_SQL} {_peers('district', '5', 20)}")
def _(v):
    return graph.ed_edges(v.people, seed=20)


@query("spatial_edges", "G5 G1 J17", "u:i v:i", f"WITH {_NEAR_SQL} SELECT u, v FROM knn")
def _(v):
    return graph.spatial_edges(_at_points(v), seed=30)


def _at_points(v: Views) -> DataFrame:
    """People on the points of the embeddings, several on each."""
    n = v.points.agg(F.count(F.lit(1))).scalar()
    return v.people.withColumn("vec_id", F.col("person_row") % n).join(v.points.select("vec_id", "lon", "lat"), "vec_id")


@query("codonor_edges", "G6 G1", "u:i v:i", f"WITH {_CODONOR_SQL} {_peers('codonor', 'least(5, size - 1)', 40)}")
def _(v):
    return graph.codonor_edges(donations.donor_committees(v.people, v.donations, CUTOFF), seed=40)


@query("shared_addresses", "W7 G3", "node:i addr:s",
       """WITH a AS (SELECT p.person_row, p.household_row, p.county || '|' || p.city || '|' || street || '|' || address_num
         AS addr FROM person p JOIN household h USING (household_row))
       SELECT person_row AS node, addr FROM a WHERE addr IN (SELECT addr FROM a GROUP BY 1
         HAVING count(DISTINCT household_row) > 1)""")
def _(v):
    return graph.same_address_groups(v.placed_people)


@query("codonor_members", "G6", "node:i committee:s donors:i",
       """WITH d AS (SELECT DISTINCT person_row AS node, coalesce(committee, '') AS committee FROM person
         JOIN donation USING (donor_key) WHERE confirmed AND donation_date < DATE '2000-11-07'
         AND upper(coalesce(committee, '')) NOT IN ('ACTBLUE', 'WINRED'))
       SELECT * FROM (SELECT node, committee, count(*) OVER (PARTITION BY committee) AS donors FROM d)
       WHERE donors BETWEEN 2 AND 5000""")
def _(v):
    return graph.codonor_members(donations.donor_committees(v.people, v.donations, CUTOFF))


@query("combined_edges", "G7 W6", "u:i v:i etype:s", f"WITH {_EDGE_SQL} SELECT * FROM way")
def _(v):
    return v.directed_edges


@query("edge_counts", "A44", "etype:s edges:i", f"WITH {_EDGE_SQL} SELECT etype, count(*) AS edges FROM edge GROUP BY 1")
def _(v):
    return graph.edge_counts(v.edges())


@query("intra_cluster_edges", "G9", "cluster:i edges:i",
       f"WITH {_EDGE_SQL} SELECT cluster, count(*) AS edges FROM inner_way GROUP BY 1")
def _(v):
    e = graph.intra_cluster_edges(v.directed_edges, v.clusters)
    return e.groupBy("cluster").agg(F.count(F.lit(1)).alias("edges"))


_WALK_COLUMNS = "person_row:i " + " ".join(f"rw{k}:d" for k in range(1, C.RWSE_STEPS + 1))
# every power of the walk matrix, one from the other
_WALK_SQL = f"""WITH {_EDGE_SQL}, p AS (SELECT u, v, 1.0::DOUBLE / count(*) OVER (PARTITION BY u) AS w FROM inner_way),
       w1 AS MATERIALIZED (SELECT u AS i, v AS j, sum(w) AS w FROM p GROUP BY 1, 2), {", ".join(
    f"w{k} AS MATERIALIZED (SELECT i, v AS j, sum(x.w * p.w) AS w FROM w{k - 1} x JOIN p ON p.u = x.j GROUP BY 1, 2)" for k in range(2, C.RWSE_STEPS + 1))}
       SELECT person_row, {", ".join(f"coalesce((SELECT w FROM w{k} WHERE i = person_row AND j = person_row), 0) + 1e-9 AS rw{k}" for k in range(1, C.RWSE_STEPS + 1))}
       FROM person"""


@query("random_walk_encoding", "G10", _WALK_COLUMNS, _WALK_SQL)
@query("random_walk_encoding_all_steps", "G10", _WALK_COLUMNS, _WALK_SQL)
def _(v):
    return _lifted(graph.random_walk_encoding(v.directed_edges, v.clusters))


def _lifted(walks: DataFrame) -> DataFrame:
    """A hair more, in SQL too: shares such as 1/64 are halves of the last digit compared."""
    return walks.select("person_row", *[(F.col(f"rw{k}") + 1e-9).alias(f"rw{k}") for k in range(1, C.RWSE_STEPS + 1)])


@query("random_walk_by_join", "G10", _WALK_COLUMNS, _WALK_SQL)
@query("random_walk_by_join_all_steps", "G10", _WALK_COLUMNS, _WALK_SQL)
def _(v):
    intra = cut(graph.intra_cluster_edges(v.directed_edges, v.clusters, "person_row").select("cluster", "u", "v"))
    by_join = graph.return_probabilities_by_join(intra, C.RWSE_STEPS, "cluster").groupBy(F.col("node").alias("person_row")).agg(
        *[F.max(F.when(F.col("k") == k, F.col("p"))).alias(f"rw{k}") for k in range(1, C.RWSE_STEPS + 1)])
    return _lifted(v.clusters.select("person_row").join(by_join, "person_row", "left").fillna(0.0))


@query("neighbor_means", "G12", "person_row:i etype:s hop:i age:d tier_count:d",
       f"""WITH {_EDGE_SQL}, h1 AS (SELECT u, etype, avg(age) AS age, avg(tier_count) AS tier_count
         FROM way JOIN person ON person_row = v GROUP BY 1, 2),
       h2 AS (SELECT w.u, w.etype, avg(age) AS age, avg(tier_count) AS tier_count
         FROM way w JOIN h1 ON h1.u = w.v AND h1.etype = w.etype GROUP BY 1, 2)
       SELECT u AS person_row, etype, 1 AS hop, age, tier_count FROM h1
       UNION ALL SELECT u, etype, 2, age, tier_count FROM h2""")
def _(v):
    return graph.neighbor_means(v.stored("directed_edges"), v.stored("people"), ["age", "tier_count"], hops=2)


@query("sampled_edges", "G1 G2 G3 G4 G5 G6 G7 W6", "u:i v:i etype:s",
       f"""WITH {_CLIQUE_SQL}, {_ADDRESS_SQL}, {_DISTRICT_SQL}, {_CODONOR_SQL}, {_NEAR_SQL},
       every AS (SELECT u, v, 0 AS p, 'household' AS etype FROM clique
         UNION ALL SELECT u, v, 1, 'same_address' FROM ({_peers('address', '5', 10)})
         UNION ALL SELECT u, v, 2, 'donation' FROM ({_peers('codonor', 'least(5, size - 1)', 40)})
         UNION ALL SELECT u, v, 3, 'spatial_knn' FROM knn
         UNION ALL SELECT u, v, 4, 'ed' FROM ({_peers('district', '5', 20)}))
       SELECT u, v, arg_min(etype, p) AS etype FROM every GROUP BY 1, 2""")
def _(v):
    donors = cut(donations.donor_committees(v.people, v.donations, CUTOFF))
    # addresses are the households', points those of the embeddings
    people = _at_points(v).join(v.placed_people.select("person_row", "address_number", "street_name"), "person_row")
    return graph.build_edges(cut(people), donors)


@query("district_centroids", "A20", "ed_key:s county:s lat:d lon:d n:i",
       """WITH e AS (SELECT ed_key, any_value(p.county) AS county, avg(CAST(lat AS DECIMAL(12,7))) AS lat,
         avg(CAST(lon AS DECIMAL(12,7))) AS lon, count(*) AS n
         FROM person p JOIN household h USING (household_row) GROUP BY 1)
       SELECT ed_key, county, coalesce(lat, avg(lat) OVER ()) AS lat, coalesce(lon, avg(lon) OVER ()) AS lon, n FROM e""")
def _(v):
    return splits.district_centroids(v.placed_people)


@query("latitude_bands", "W9", "household_row:i band:i",
       """WITH e AS (SELECT household_row, county, lat FROM household WHERE lat IS NOT NULL),
       q AS (SELECT county, quantile_cont(lat, [0, 0.25, 0.5, 0.75, 1]) AS edges, count(*) AS n FROM e GROUP BY 1),
       c AS (SELECT county, least(20, greatest(1, n // 50)) AS k FROM q),
       x AS (SELECT e.county, i, lo + (hi - lo) * frac AS edge FROM (
           SELECT county, i, (list_sort(list(lat)))[CAST(floor((count(*) - 1) * i / k) AS INT) + 1] AS lo,
             (list_sort(list(lat)))[CAST(least(floor((count(*) - 1) * i / k) + 1, count(*) - 1) AS INT) + 1] AS hi,
             (count(*) - 1) * i / k - floor((count(*) - 1) * i / k) AS frac
           FROM e JOIN c USING (county), unnest(range(0, 21)) AS r(i) WHERE i <= k GROUP BY county, i, k) e)
       SELECT household_row, greatest(0, (SELECT count(DISTINCT edge) FROM x WHERE x.county = e.county AND edge < e.lat) - 1)
         AS band FROM e""")
def _(v):
    h = v.households.filter("lat is not null").select("household_row", "county", "lat")
    return splits.latitude_bands(h)


_SPLIT_SQL = f"""ed AS (SELECT ed_key, any_value(county) AS county, count(*) AS n_persons FROM person GROUP BY 1),
       cum AS (SELECT *, sum(n_persons) OVER (PARTITION BY county ORDER BY {_draw(models.SEED, 'ed_key')}, ed_key) AS cum,
         sum(n_persons) OVER (PARTITION BY county) AS total FROM ed),
       split AS (SELECT ed_key, county, n_persons, CASE WHEN cum <= 0.8 * total THEN 'train' WHEN cum <= 0.9 * total THEN 'val'
         ELSE 'test' END AS split FROM cum)"""


@query("district_splits", "W5 A20", "ed_key:s county:s n_persons:i split:s", f"WITH {_SPLIT_SQL} SELECT * FROM split")
def _(v):
    return splits.split_by_people(v.people, models.SEED)


@query("split_shares", "W5 J6", "split:s persons:i", f"WITH {_SPLIT_SQL} SELECT split, count(*) AS persons FROM person JOIN split USING (ed_key) GROUP BY 1")
def _(v):
    p = splits.attach_split(v.people, splits.split_by_people(v.people, models.SEED))
    return p.groupBy("split").agg(F.count(F.lit(1)).alias("persons"))


@query("split_by_count", "W5b", "ed_key:s split:s",
       f"""SELECT ed_key, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.9) THEN 'val' ELSE 'test' END AS split FROM (
         SELECT ed_key, row_number() OVER (ORDER BY {_draw(models.SEED, 'ed_key')}, ed_key) AS r, count(*) OVER () AS n
         FROM (SELECT DISTINCT ed_key FROM person))""")
def _(v):
    return splits.split_by_count(v.people, models.SEED, "ed_key")


# bands by latitude as in latitude_bands, then one row after the other in snake order
_CLUSTER_SQL = """e0 AS (SELECT ed_key, any_value(p.county) AS county, avg(CAST(lat AS DECIMAL(12,7))) AS lat,
         avg(CAST(lon AS DECIMAL(12,7))) AS lon, count(*) AS n FROM person p JOIN household h USING (household_row) GROUP BY 1),
       e AS (SELECT ed_key, county, coalesce(lat, avg(lat) OVER ()) AS lat, coalesce(lon, avg(lon) OVER ()) AS lon, n FROM e0),
       l AS (SELECT county, list_sort(list(lat)) AS lats, count(*) AS m, least(20, greatest(1, count(*) // 50)) AS q FROM e GROUP BY 1),
       x AS (SELECT DISTINCT county, lats[CAST(floor((m - 1) * i / q) AS INT) + 1] + (lats[CAST(least(floor((m - 1) * i / q) + 1, m - 1) AS INT) + 1]
           - lats[CAST(floor((m - 1) * i / q) AS INT) + 1]) * ((m - 1) * i / q - floor((m - 1) * i / q)) AS edge FROM l, unnest(range(0, 21)) AS r(i) WHERE i <= q),
       b AS (SELECT *, greatest(0, (SELECT count(*) FROM x WHERE x.county = e.county AND edge < e.lat) - 1) AS band FROM e),
       o AS (SELECT ed_key, county, n, row_number() OVER (PARTITION BY county ORDER BY band, CASE WHEN band % 2 = 0 THEN lon ELSE -lon END, ed_key) AS i FROM b),
       pack AS (SELECT ed_key, county, i, n AS cum, 0 AS c FROM o WHERE i = 1 UNION ALL
         SELECT o.ed_key, o.county, o.i, CASE WHEN cum >= 120 THEN o.n ELSE cum + o.n END, c + CASE WHEN cum >= 120 THEN 1 ELSE 0 END
         FROM pack JOIN o ON o.county = pack.county AND o.i = pack.i + 1),
       used AS (SELECT county, max(c) + 1 AS used FROM pack GROUP BY 1),
       first AS (SELECT county, coalesce(sum(used) OVER (ORDER BY county ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM used),
       cluster AS (SELECT ed_key, c + first AS cluster FROM pack JOIN first USING (county))"""


@query("district_clusters", "G8 W9 W10", "person_row:i cluster:i",
       f"WITH RECURSIVE {_CLUSTER_SQL} SELECT person_row, cluster FROM person JOIN cluster USING (ed_key)")
def _(v):
    return splits.assign_clusters(v.placed_people, target=120)


@query("cluster_sizes", "G8 W9 W10 A44", "clusters:i smallest:i median:i largest:i",
       f"""WITH RECURSIVE {_CLUSTER_SQL}, z AS (SELECT cluster, count(*) AS n FROM person JOIN cluster USING (ed_key) GROUP BY 1)
       SELECT count(*) AS clusters, min(n) AS smallest, floor(quantile_cont(n, 0.5)) AS median, max(n) AS largest FROM z""")
def _(v):
    return splits.cluster_sizes(splits.assign_clusters(v.placed_people, target=120))


# --------------------------------------------------------- features and measures

@query("train_statistics", "A43", "feature:s median:d mean:d std:d",
       """SELECT feature, median(x) AS median, avg(x) AS mean, stddev_samp(x) AS std FROM (
         SELECT feature, coalesce(x, (median(x) OVER (PARTITION BY feature))) AS x FROM (
           SELECT 'age' AS feature, CAST(nullif(age, 40) AS DOUBLE) AS x FROM person WHERE person_row % 3 <> 0
           UNION ALL SELECT 'tier_count', tier_count FROM person WHERE person_row % 3 <> 0)) GROUP BY 1""")
def _(v):
    return features.train_statistics(_split_people(v), ["age", "tier_count"])


def _split_people(v: Views) -> DataFrame:
    return v.people.withColumn("split", F.when(F.col("person_row") % 3 != 0, "train").otherwise("test")) \
        .withColumn("age", F.nullif("age", F.lit(40)))


@query("standardized_features", "G11 A43", "person_row:i age:d tier_count:d",
       """WITH t AS (SELECT median(a) AS ma, avg(coalesce(a, m)) AS aa, stddev_samp(coalesce(a, m)) AS sa, avg(tc) AS tm, stddev_samp(tc) AS st
         FROM (SELECT CAST(nullif(age, 40) AS DOUBLE) AS a, tier_count AS tc,
             median(CAST(nullif(age, 40) AS DOUBLE)) OVER () AS m FROM person WHERE person_row % 3 <> 0))
       SELECT person_row, (coalesce(nullif(age, 40), ma) - aa) / sa AS age, (tier_count - tm) / st AS tier_count
       FROM person, t""")
def _(v):
    p = _split_people(v)
    cols = ["age", "tier_count"]
    return features.standardize(p, cols, features.train_statistics(p, cols), "person_row")


@query("category_codes", "G11", "person_row:i city:s city_code:i",
       """SELECT person_row, coalesce(nullif(city, 'NATION_5'), 'nan') AS city,
       dense_rank() OVER (ORDER BY coalesce(nullif(city, 'NATION_5'), 'nan')) AS city_code FROM person""")
def _(v):
    return features.encode_category(v.people.withColumn("city", F.nullif("city", F.lit("NATION_5"))), "city")


@query("task_features", "P13 P14 D16", "task:s feature:s kind:s filled:i",
       """WITH f AS (SELECT count(age) AS age, count(tier_count) AS tier_count, count(party) AS party,
         count(tier_letter) AS tier_letter, count(county) AS county, count(nullif(city, 'NATION_5')) AS city,
         count(congressional_district) AS congressional_district, count(senate_district) AS senate_district,
         count(assembly_district) AS assembly_district FROM person),
       u AS (UNPIVOT f ON COLUMNS(*) INTO NAME feature VALUE filled)
       SELECT task, feature, CASE WHEN feature IN ('age', 'tier_count') THEN 'numeric' ELSE 'categorical' END AS kind,
       filled FROM u, (VALUES ('turnout'), ('party')) t(task)
       WHERE NOT (task = 'turnout' AND feature IN ('tier_count', 'tier_letter')) AND NOT (task = 'party' AND feature = 'party')""")
def _(v):
    p = v.people.withColumn("city", F.nullif("city", F.lit("NATION_5")))
    chosen = [(t, f, kind) for t in ("turnout", "party")
              for kind, names in zip(("numeric", "categorical"), features.task_features(t, p.columns))
              for f in names]
    counts = p.agg(*[F.count(f).alias(f) for f in {f for _, f, _ in chosen}])
    return counts.select(F.explode(F.array(*[F.struct(
        F.lit(t).alias("task"), F.lit(f).alias("feature"), F.lit(kind).alias("kind"),
        F.col(f).alias("filled")) for t, f, kind in chosen])).alias("r")).select("r.*")


_SCORED_SQL = """scored AS (SELECT person_row, ed_key, y_party, age, tier_count, y_turnout AS y,
         round(CASE WHEN y_turnout = 1 THEN 0.2 + 0.7 * ((person_row * 37) % 101) / 101.0
           ELSE 0.05 + 0.75 * ((person_row * 37) % 101) / 101.0 END, 2) AS p FROM labelled WHERE y_turnout >= 0)"""


@query("binary_metrics", "A34 F24", "auc:d pr_auc:d log_loss:d brier:d base_rate:d n:i",
       f"""WITH {_SCORED_SQL}, g AS (SELECT p, sum(y) AS pos, count(*) AS c FROM scored GROUP BY 1),
       r AS (SELECT *, sum(c - pos) OVER (ORDER BY p) - (c - pos) / 2 AS below, sum(pos) OVER (ORDER BY p DESC) AS tp,
         sum(c) OVER (ORDER BY p DESC) AS k, sum(pos) OVER () AS np, sum(c - pos) OVER () AS nn FROM g)
       SELECT sum(pos * below) / any_value(np * nn) AS auc, sum(pos / np * tp / k) AS pr_auc,
       (SELECT avg(-(y * ln(p) + (1 - y) * ln(1 - p))) FROM scored) AS log_loss,
       (SELECT avg((y - p) ** 2) FROM scored) AS brier, (SELECT avg(y) FROM scored) AS base_rate, sum(c) AS n FROM r""")
def _(v):
    return metrics.binary_metrics(v.scored_labels)


def _classes(v: Views) -> DataFrame:
    k = F.col("person_row")
    a, b = ((k * 29) % 50 + 1) / 200.0, ((k * 43) % 60 + 1) / 150.0
    dem = F.col("y_party") == 0
    return v.labelled.filter("y_party >= 0").select(
        F.col("y_party").alias("y"), F.array(F.when(dem, 1 - a - b / 2).otherwise(a),
                                             F.when(dem, b / 2).otherwise(b),
                                             F.when(dem, a).otherwise(1 - a - b)).alias("probs"))


@query("multiclass_metrics", "A35 M7", "accuracy:d log_loss:d macro_f1:d n:i",
       """WITH c AS (SELECT y_party AS y, CASE WHEN y_party = 0 THEN [1 - a - b / 2, b / 2, a] ELSE [a, b, 1 - a - b] END AS pr
         FROM (SELECT *, ((person_row * 29) % 50 + 1) / 200.0 AS a, ((person_row * 43) % 60 + 1) / 150.0 AS b
           FROM labelled WHERE y_party >= 0)),
       q AS (SELECT y, list_position(pr, list_max(pr)) - 1 AS q, pr[y + 1] AS py FROM c),
       f AS (SELECT k, 2 * count(*) FILTER (y = k AND q = k) / nullif(count(*) FILTER (y = k) + count(*) FILTER (q = k), 0) AS f1
         FROM q, (VALUES (0), (1), (2)) t(k) GROUP BY k)
       SELECT avg(CASE WHEN y = q THEN 1 ELSE 0 END) AS accuracy, avg(-ln(py)) AS log_loss,
       (SELECT avg(f1) FROM f) AS macro_f1, count(*) AS n FROM q""")
def _(v):
    return metrics.multiclass_metrics(_classes(v))


@query("reliability", "A36", "bin:i n:i mean_p:d mean_y:d",
       f"""WITH {_SCORED_SQL} SELECT least(floor(p * 15), 14) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS mean_y
       FROM scored GROUP BY 1""")
def _(v):
    return metrics.reliability(v.scored_labels)


@query("calibration_error", "A36", "ece:d n:i",
       f"""WITH {_SCORED_SQL} SELECT sum(n * abs(mp - my)) / sum(n) AS ece, sum(n) AS n FROM (
       SELECT count(*) AS n, avg(p) AS mp, avg(y) AS my FROM scored GROUP BY least(floor(p * 15), 14))""")
def _(v):
    return metrics.calibration_error(v.scored_labels)


@query("district_validation", "A37", "mae:d bias:d districts:i",
       f"""WITH {_SCORED_SQL} SELECT avg(abs(a - b)) AS mae, avg(a - b) AS bias, count(*) AS districts FROM (
       SELECT avg(p) AS a, avg(y) AS b FROM scored GROUP BY ed_key HAVING count(*) >= 10)""")
def _(v):
    return metrics.district_validation(v.scored_labels, min_n=10)


@query("score_summary", "A40", "mean:d p10:d p90:d corr:d",
       f"""WITH {_SCORED_SQL} SELECT avg(p) AS mean, quantile_cont(p, 0.1) AS p10, quantile_cont(p, 0.9) AS p90,
       corr(tier_count, age) AS corr FROM scored""")
def _(v):
    s = v.scored_labels
    c = s.agg(F.corr("tier_count", "age")).scalar()
    return metrics.score_summary(s, "p").withColumn("corr", c)


@query("feature_aucs", "A40", "feature:s auc:d n:i",
       f"""WITH {_SCORED_SQL}, l AS (SELECT 'age' AS feature, age AS x, y FROM scored
         UNION ALL SELECT 'tier_count', tier_count, y FROM scored),
       g AS (SELECT feature, x, sum(y) AS pos, count(*) - sum(y) AS neg FROM l GROUP BY 1, 2),
       r AS (SELECT *, sum(neg) OVER (PARTITION BY feature ORDER BY x) - neg / 2 AS below FROM g)
       SELECT feature, sum(pos * below) / (sum(pos) * sum(neg)) AS auc, sum(pos + neg) AS n FROM r GROUP BY 1""")
def _(v):
    return metrics.feature_aucs(v.scored_labels, ["age", "tier_count"], "y")


@query("model_comparison", "J22 K11", "metric:s first:d second:d",
       f"""WITH {_SCORED_SQL}, a AS (SELECT avg(p) AS mean, quantile_cont(p, 0.1) AS p10, quantile_cont(p, 0.9) AS p90 FROM scored),
       b AS (SELECT avg(1 - p) AS mean, quantile_cont(1 - p, 0.1) AS p10, quantile_cont(1 - p, 0.9) AS p90 FROM scored)
       SELECT metric, first, second FROM (SELECT a.mean AS m1, a.p10 AS l1, a.p90 AS h1, b.mean AS m2, b.p10 AS l2, b.p90 AS h2
         FROM a, b), LATERAL (VALUES ('mean', m1, m2), ('p10', l1, l2), ('p90', h1, h2)) t(metric, first, second)""")
def _(v):
    s = v.scored_labels
    a = metrics.as_long(metrics.score_summary(s, "p"))
    b = metrics.as_long(metrics.score_summary(s.withColumn("p", 1 - F.col("p")), "p"))
    return metrics.compare_models(a, b, ("first", "second"))


# ----------------------------------------------------------------------- models

def model_table(v: Views) -> DataFrame:
    """People with history, shares, donations, labels and split.

    Made in steps, as the driver runs all stages of one plan side by side: people are made once, and
    what is small beside them (givers, districts) before the rest.
    """
    v = v.over_stored("people")
    split = cut(splits.split_by_people(v.people, models.SEED))
    given = cut(donations.donation_features(v.donations, CUTOFF))
    p = v.labelled
    p = context.district_shares(context.household_shares(p))
    p = donations.attach_donation_features(p, given)
    p = p.join(history.history_features(v.people, v.ballots, TARGET, REF_YEAR), "person_row")
    # training passes over the table many times
    return cut(splits.attach_split(p, split))


def _numeric_features(t: DataFrame) -> list[str]:
    """Every numeric feature of the manifest that the table has."""
    return [n for n, m in features.manifest().items() if m["type"] == "numeric" and n in t.columns]


@query("feature_aucs_all_features", "A40", "feature:s auc:d n:i")
def _(v):
    t = model_table(v)
    return metrics.feature_aucs(t.filter("y_turnout >= 0"), _numeric_features(t), "y_turnout")


@query("train_statistics_all_features", "A43", "feature:s median:d mean:d std:d")
def _(v):
    t = model_table(v)
    return features.train_statistics(t, _numeric_features(t))


@query("standardized_features_all_features", "G11 A43", "person_row:i feature:s z:d")
def _(v):
    t = model_table(v)
    names = _numeric_features(t)
    z = features.standardize(t, names, features.train_statistics(t, names), "person_row")
    return z.unpivot(["person_row"], names, "feature", "z")


def held_out_predictions(v: Views) -> DataFrame:
    """(model, ed_key, y, p) of the held-out people: boosted trees, and age alone."""
    t = model_table(v)
    num, cat, _ = features.task_features("turnout", t.columns)
    held = t.filter("split = 'test' and y_turnout >= 0").withColumnRenamed("y_turnout", "y")
    boosted = models.predict(models.fit_turnout(t, num, cat), held, num, cat)
    floor = models.predict(models.fit_age_floor(t), held, ["age"], [])
    return cut(boosted.withColumn("model", F.lit("boosted")).unionByName(floor.withColumn("model", F.lit("age_floor"))).select(
        "model", "ed_key", "y", F.get("probs", F.lit(1)).alias("p")))


@query("turnout_model", "M1 M3 A34", "model:s metric:s value:d")
def _(v):
    scored = held_out_predictions(v)
    return reduce(DataFrame.unionByName, [  # one model at a time, see model_table
        cut(metrics.as_long(metrics.binary_metrics(scored.filter(F.col("model") == m)))).withColumn("model", F.lit(m)) for m in ("boosted", "age_floor")])


@query("party_model", "M2 M6 A35", "registered_party:s n:i in_range:i sums_to_one:i dem:d rep:d other:d turnout:d")
def _(v):
    t = model_table(v)
    tn, tc, _ = features.task_features("turnout", t.columns)
    pn, pc, _ = features.task_features("party", t.columns)
    s = models.score_people(t, models.fit_turnout(t, tn, tc),
                            models.fit_party(t, pn, pc), 1.2, 0.9)
    total = F.col("p_dem_lean") + F.col("p_rep_lean") + F.col("p_other")
    return s.groupBy("registered_party").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.col("turnout_propensity").between(0, 1).cast("int")).alias("in_range"),
        F.min((F.abs(total - 1) < 1e-9).cast("int")).alias("sums_to_one"),
        F.avg("p_dem_lean").alias("dem"), F.avg("p_rep_lean").alias("rep"), F.avg("p_other").alias("other"),
        F.avg("turnout_propensity").alias("turnout"))


@query("temporal_backtest", "M4 F23", "metric:s forward:d same_year:d gap:d")
def _(v):
    t = v.labelled.select("person_row", "ed_key", "party", "county", "city", "age")
    t = splits.attach_split(t, splits.split_by_people(v.people, models.SEED))
    t = cut(t)
    h = {e: cut(history.history_features(v.people, v.ballots, e, REF_YEAR)) for e in (1998, TARGET)}
    return models.backtest(t, h[1998], h[TARGET], 1998, TARGET, REF_YEAR)


# the least log-loss on a grid of steps of 0.001 in ln T, refined around the best of a coarse one
@query("temperature_scaling", "M5", "ln_t:i n:i",
       f"""WITH {_SCORED_SQL}, z AS MATERIALIZED (SELECT ln(c / (1 - c)) * 3 AS z, y, count(*) AS k FROM (
         SELECT greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, p)) AS c, y FROM scored) GROUP BY 1, 2),
       coarse AS (SELECT arg_min(s, loss) AS s FROM (SELECT s, sum(k * (greatest(z / exp(s / 20.0), 0) - z / exp(s / 20.0) * y
         + ln(1 + exp(-abs(z / exp(s / 20.0)))))) AS loss FROM z, range(-60, 61) AS r(s) GROUP BY 1)),
       fine AS (SELECT arg_min(f, loss) AS f FROM (SELECT f, sum(k * (greatest(z / exp(f / 1000.0), 0) - z / exp(f / 1000.0) * y
         + ln(1 + exp(-abs(z / exp(f / 1000.0)))))) AS loss FROM z, (SELECT unnest(range(s * 50 - 60, s * 50 + 61)) AS f FROM coarse) GROUP BY 1))
       SELECT f AS ln_t, (SELECT count(*) FROM scored) AS n FROM fine""")
def _(v):
    s = cut(v.scored_labels.withColumn("logit", models.logit(F.col("p")) * 3))
    t = models.fit_temperature(s)
    return s.agg(F.round(F.lit(1000 * math.log(t))).alias("ln_t"), F.count(F.lit(1)).alias("n"))
