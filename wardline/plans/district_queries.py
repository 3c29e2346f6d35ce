"""Queries over districts, contests, ZIP scores, map views, audiences and search."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audience, districts, donations, households
from ..sources import files
from .registry import half_even, query
from .standin import Views

_CHAMBER_SQL = """(SELECT *, 'assembly' AS chamber, assembly_district AS district FROM {t}
       UNION ALL SELECT *, 'senate', senate_district FROM {t}
       UNION ALL SELECT *, 'congressional', congressional_district FROM {t})"""

_HH_SQL = """hhp AS (SELECT h.household_row, h.assembly_district, h.senate_district,
         h.congressional_district, h.gap, n, dem, rep, con, blk, drp, rel, low FROM household h JOIN (
         SELECT household_row, count(*) AS n, count(*) FILTER (party = 'DEM') AS dem,
           count(*) FILTER (party = 'REP') AS rep, count(*) FILTER (party = 'CON') AS con,
           count(*) FILTER (party = 'BLK') AS blk,
           count(*) FILTER (party = 'DEM' AND tier IN ('I0','F1','L1')) AS drp,
           count(*) FILTER (tier_letter = 'X' AND tier_count >= 4) AS rel,
           count(*) FILTER (tier IN ('I0','F1','L1','F2','L2')) AS low
         FROM person GROUP BY 1) USING (household_row))"""


@query("district_metrics", "A7 S3",
       "chamber:s district:i total_households:i total_voters:i dem_pct:d rep_pct:d blk_pct:d "
       "dropoff_dem_count:i avg_engagement_gap:d reliable_pct:d low_engage_pct:d registration_gap:d",
       f"""WITH {_HH_SQL}, m AS (SELECT chamber, district, count(*) AS total_households, sum(n) AS total_voters,
         round_even(sum(dem) / greatest(sum(dem + rep + con + blk), 1) * 100, 1) AS dem_pct,
         round_even(sum(rep) / greatest(sum(dem + rep + con + blk), 1) * 100, 1) AS rep_pct,
         round_even(sum(blk) / greatest(sum(dem + rep + con + blk), 1) * 100, 1) AS blk_pct,
         sum(drp) AS dropoff_dem_count, round_even(avg(gap), 2) AS avg_engagement_gap,
         round_even(sum(rel) / sum(n) * 100, 1) AS reliable_pct,
         round_even(sum(low) / sum(n) * 100, 1) AS low_engage_pct
         FROM {_CHAMBER_SQL.format(t="hhp")} GROUP BY 1, 2)
       SELECT *, round_even(dem_pct - rep_pct, 1) AS registration_gap FROM m""")
def _(v):
    return districts.district_metrics(v.packed)


@query("district_metrics_served", "A8 J1",
       "chamber:s district:i total_voters:i dem_pct:d rep_pct:d blk_pct:d registration_gap:d "
       "reliable_pct:d dropoff_dem_count:i avg_engagement_gap:d",
       f"""WITH sp AS (SELECT s.party, s.tier_letter, s.turnout_prob, h.assembly_district, h.senate_district,
         h.congressional_district FROM served s JOIN household h USING (household_id))
       SELECT chamber, district, count(*) AS total_voters,
         round(count(*) FILTER (party = 'DEM') / count(*) * 100, 1) AS dem_pct,
         round(count(*) FILTER (party = 'REP') / count(*) * 100, 1) AS rep_pct,
         round(count(*) FILTER (party NOT IN ('DEM','REP')) / count(*) * 100, 1) AS blk_pct,
         round((count(*) FILTER (party = 'DEM') - count(*) FILTER (party = 'REP')) / count(*) * 100, 1)
           AS registration_gap,
         round(count(*) FILTER (tier_letter = 'X') / count(*) * 100, 1) AS reliable_pct,
         count(*) FILTER (party = 'DEM' AND tier_letter IN ('F','L')) AS dropoff_dem_count,
         round(avg(1 - turnout_prob), 3) AS avg_engagement_gap
       FROM {_CHAMBER_SQL.format(t="sp")} GROUP BY 1, 2""")
def _(v):
    p = v.served_people.drop("assembly_district", "senate_district", "congressional_district")
    return districts.district_metrics_served(p, v.households)


_ZIP_SQL = """zc AS (SELECT lpad(CAST((l_suppkey * l_suppkey) % 37 % 25 AS VARCHAR), 5, '0') AS zip,
         count(*) AS count FROM lineitem GROUP BY 1 HAVING zip <> '00000'),
       zs AS (SELECT zip, count, round_even((ln(1 + count) - min(ln(1 + count)) OVER ())
         / (max(ln(1 + count)) OVER () - min(ln(1 + count)) OVER ()) * 100, 0) AS score FROM zc)"""


@query("zip_scores", "A9 F11 S8", "zip:s score:i count:i", f"WITH {_ZIP_SQL} SELECT * FROM zs")
def _(v):
    return v.zip_scores


@query("zip_scores_alias", "F11 P17", "zip:s score:i count:i",
       f"""WITH {_ZIP_SQL} SELECT * FROM zs WHERE score >= 40
       UNION ALL SELECT ltrim(zip, '0') AS zip, count, score FROM zs WHERE score >= 40""")
def _(v):
    return districts.zip_aliases(districts.minimum_score(v.zip_scores, 40))


@query("regional_zips", "P17", "zip:s n:i",
       """SELECT zip, count(*) AS n FROM (SELECT CAST(11000 + c_custkey % 1500 AS VARCHAR) AS zip FROM customer
       UNION ALL SELECT lpad(CAST(6380 + c_custkey % 20 AS VARCHAR), 5, '0') FROM customer)
       WHERE zip LIKE '11%' OR zip = '06390' GROUP BY 1""")
def _(v):
    k = F.col("c_custkey")
    z = v.table("customer").select(F.explode(F.array(
        (11000 + k % 1500).cast("string"), F.lpad((6380 + k % 20).cast("string"), 5, "0"))).alias("zip"))
    return districts.regional_zips(z).groupBy("zip").agg(F.count(F.lit(1)).alias("n"))


@query("household_zip_scores", "J14", "household_id:i ev_score:i ev_count:i",
       f"""WITH {_ZIP_SQL} SELECT household_id, coalesce(score, 0) AS ev_score, coalesce(count, 0) AS ev_count
       FROM household LEFT JOIN zs USING (zip)""")
def _(v):
    return households.with_zip_score(v.households, v.zip_scores)


_CONTEST_SQL = """prec AS (SELECT trim((['State Assembly',' State Senate','U.S. House','Governor'])
           [CAST(l_orderkey % 4 AS INT) + 1]) AS office, l_suppkey % 24 AS district,
         'Cand ' || (l_linenumber % 5) AS candidate,
         upper((['DEM','rep','CON','WOR'])[CAST((l_linenumber + l_partkey % 2) % 4 AS INT) + 1]) AS party,
         CAST(l_quantity AS INT) AS votes, 2020 + l_orderkey % 3 * 2 AS year,
         l_orderkey * 10 + l_linenumber AS ordinal FROM lineitem),
       ok AS (SELECT CASE office WHEN 'State Assembly' THEN 'assembly' WHEN 'State Senate' THEN 'senate'
           ELSE 'congressional' END AS race, * FROM prec
         WHERE (office = 'State Assembly' AND district BETWEEN 1 AND 22)
           OR (office = 'State Senate' AND district BETWEEN 1 AND 9)
           OR (office = 'U.S. House' AND district BETWEEN 1 AND 4)),
       line AS (SELECT race, year, district, candidate, party, sum(votes) AS lv, min(ordinal) AS seen
         FROM ok GROUP BY ALL),
       cand AS (SELECT race, year, district, candidate, sum(lv) AS tv, min(seen) AS seen,
         arg_max(party, (lv, -seen)) AS best FROM line GROUP BY ALL),
       led AS (SELECT race, year, district,
         arg_max(candidate, (lv, -seen)) FILTER (party = 'DEM') AS dc,
         arg_max(candidate, (lv, -seen)) FILTER (party = 'REP') AS rc FROM line GROUP BY ALL),
       tot AS (SELECT race, year, district, sum(tv) AS total_votes, arg_max(best, (tv, -seen)) AS top
         FROM cand GROUP BY ALL),
       res0 AS (SELECT t.*, coalesce(dc, '') AS dem_candidate, coalesce(rc, '') AS rep_candidate,
         coalesce(d.tv, 0) AS dem_votes, coalesce(r.tv, 0) AS rep_votes
         FROM tot t JOIN led l USING (race, year, district)
         LEFT JOIN cand d ON d.race = t.race AND d.year = t.year AND d.district = t.district AND d.candidate = dc
         LEFT JOIN cand r ON r.race = t.race AND r.year = t.year AND r.district = t.district AND r.candidate = rc),
       res AS (SELECT race, year, district, dem_votes, rep_votes,
         greatest(0, total_votes - dem_votes - rep_votes) AS other_votes, total_votes, dem_candidate,
         rep_candidate, round_even(dem_votes / total_votes * 100, 1) AS dem_pct,
         round_even((dem_votes - rep_votes) / total_votes * 100, 1) AS margin_pct,
         CASE WHEN dem_candidate <> '' AND dem_votes > rep_votes THEN 'DEM'
           WHEN rep_candidate <> '' AND rep_votes > dem_votes THEN 'REP' ELSE top END AS winner
         FROM res0 WHERE total_votes <> 0)"""

_CONTEST_COLUMNS = ("race:s year:i district:i dem_votes:i rep_votes:i other_votes:i total_votes:i "
                    "dem_candidate:s rep_candidate:s dem_pct:d margin_pct:d winner:s")


def _results(v: Views) -> DataFrame:
    return districts.contest_results(districts.precinct_rows(v.precincts), ["race", "year", "district"])


@query("contest_results", "A10 S9 U1", _CONTEST_COLUMNS, f"WITH {_CONTEST_SQL} SELECT * FROM res")
def _(v):
    return _results(v)


@query("contest_winners_served", "A10 D14", "race:s year:i winner:s n:i",
       f"""WITH {_CONTEST_SQL} SELECT race, year, CASE WHEN winner IN ('DEM','REP') THEN winner ELSE 'OTHER' END
       AS winner, count(*) AS n FROM res GROUP BY ALL""")
def _(v):
    w = districts.served_winner(_results(v))
    return w.groupBy("race", "year", "winner").agg(F.count(F.lit(1)).alias("n"))


_EXPECT_SQL = """expct AS (SELECT race, year, district FROM (SELECT 'assembly' AS race, unnest(range(1, 23)) AS district
         UNION ALL SELECT 'senate', unnest(range(1, 10)) UNION ALL SELECT 'congressional', unnest(range(1, 5)))
         CROSS JOIN (VALUES (2020), (2022), (2024), (2026)) y(year))"""


@query("contest_template", "P23 J19", _CONTEST_COLUMNS,
       f"""WITH {_CONTEST_SQL}, {_EXPECT_SQL} SELECT race, year, district,
       coalesce(CASE WHEN k THEN 1 ELSE dem_votes END, 0) AS dem_votes, coalesce(CASE WHEN k THEN 2 ELSE rep_votes END, 0) AS rep_votes,
       coalesce(CASE WHEN k THEN 0 ELSE other_votes END, 0) AS other_votes,
       coalesce(CASE WHEN k THEN 3 ELSE total_votes END, 0) AS total_votes,
       coalesce(CASE WHEN k THEN 'A' ELSE dem_candidate END, '') AS dem_candidate,
       coalesce(CASE WHEN k THEN 'B' ELSE rep_candidate END, '') AS rep_candidate,
       coalesce(CASE WHEN k THEN 33.3 ELSE dem_pct END, 0) AS dem_pct,
       coalesce(CASE WHEN k THEN -33.3 ELSE margin_pct END, 0) AS margin_pct,
       coalesce(CASE WHEN k THEN 'REP' ELSE winner END, '') AS winner
       FROM (SELECT e.*, year = 2024 AND district % 2 = 0 AS k FROM expct e) LEFT JOIN res USING (race, year, district)""")
def _(v):
    expected = districts.expected_contests(v.spark, [2020, 2022, 2024, 2026])
    kept = expected.filter("year = 2024 and int(district) % 2 = 0").select(
        "race", "year", "district", F.lit(1).alias("dem_votes"), F.lit(2).alias("rep_votes"),
        F.lit(0).alias("other_votes"), F.lit(3).alias("total_votes"), F.lit("A").alias("dem_candidate"),
        F.lit("B").alias("rep_candidate"), F.lit(33.3).alias("dem_pct"), F.lit(-33.3).alias("margin_pct"),
        F.lit("REP").alias("winner"))
    return districts.results_template(expected, _results(v), kept)


@query("missing_contests", "P21", "race:s year:i district:i",
       f"""WITH {_CONTEST_SQL}, {_EXPECT_SQL} SELECT race, year, district FROM expct
       WHERE (race, year, district) NOT IN (SELECT (race, year, district) FROM res)""")
def _(v):
    expected = districts.expected_contests(v.spark, [2020, 2022, 2024, 2026])
    return districts.missing_contests(expected, _results(v))


@query("contest_swing", "J18", "race:s year:i district:i dem_pct:d swing:d",
       f"""WITH {_CONTEST_SQL} SELECT a.race, a.year, a.district, a.dem_pct, a.dem_pct - b.dem_pct AS swing
       FROM res a LEFT JOIN res b ON a.race = b.race AND a.district = b.district AND b.year = a.year - 2""")
def _(v):
    return districts.with_swing(_results(v))


@query("tossup_counts", "P16", "race:s year:i tossups:i",
       f"""WITH {_CONTEST_SQL} SELECT race, year, count(*) FILTER (abs(margin_pct) <= 5) AS tossups
       FROM res GROUP BY 1, 2""")
def _(v):
    return districts.tossup_counts(_results(v))


@query("map_measures", "F21", "race:s district:i year:i m_dem_pct:d m_margin:d m_swing:d m_reg_gap:d m_dropoff:d",
       f"""WITH {_CONTEST_SQL}, {_EXPECT_SQL}, {_HH_SQL}, m AS (SELECT chamber AS race, district, round_even(
           round_even(sum(dem) / greatest(sum(dem + rep + con + blk), 1) * 100, 1)
           - round_even(sum(rep) / greatest(sum(dem + rep + con + blk), 1) * 100, 1), 1) AS gap, sum(drp) AS drp
         FROM {_CHAMBER_SQL.format(t="hhp")} GROUP BY 1, 2),
       r AS (SELECT race, year, district, dem_pct, margin_pct, total_votes FROM expct LEFT JOIN res USING (race, year, district)),
       j AS (SELECT a.*, CASE WHEN a.total_votes > 0 AND b.total_votes > 0 THEN a.dem_pct - b.dem_pct END AS swing, gap, drp
         FROM r a LEFT JOIN r b ON a.race = b.race AND a.district = b.district AND b.year = a.year - 2
         LEFT JOIN m ON m.race = a.race AND m.district = a.district)
       SELECT race, district, year, CASE WHEN total_votes > 0 OR gap IS NOT NULL THEN greatest(0, least(1,
           CASE WHEN total_votes > 0 THEN (dem_pct - 30) / 40 ELSE (50 + gap / 2 - 30) / 40 END)) END AS m_dem_pct,
         CASE WHEN total_votes > 0 THEN greatest(0, least(1, (margin_pct + 20) / 40)) END AS m_margin,
         CASE WHEN swing IS NOT NULL THEN greatest(0, least(1, (swing + 10) / 20)) END AS m_swing,
         CASE WHEN gap IS NOT NULL THEN greatest(0, least(1, (gap + 20) / 40)) END AS m_reg_gap,
         CASE WHEN drp IS NOT NULL THEN greatest(0, least(1, drp / 2000)) END AS m_dropoff FROM j""")
def _(v):
    full = districts.results_template(
        districts.expected_contests(v.spark, [2020, 2022, 2024, 2026]), _results(v))
    return districts.map_measures(districts.with_swing(full), districts.district_metrics(v.packed))


@query("results_from_json", "S14", "race:s year:i district:i total_votes:i dem_pct:d winner:s",
       f"WITH {_CONTEST_SQL} SELECT race, year, district, total_votes, dem_pct, winner FROM res")
def _(v):
    r = _results(v)
    rec = F.struct(*[c for c in r.columns if c not in ("race", "year", "district")])
    d = r.groupBy("race", "year").agg(F.map_from_entries(F.collect_list(F.struct("district", rec))).alias("m"))
    y = d.groupBy("race").agg(F.map_from_entries(F.collect_list(
        F.struct(F.col("year").cast("string"), "m"))).alias("m"))
    j = y.select(F.to_json(F.create_map("race", "m")).alias("j"))
    return files.explode_results(j, "j")


@query("district_counts", "A19", "district:i county:s households:i",
       "SELECT assembly_district AS district, county, count(*) AS households FROM household GROUP BY 1, 2")
def _(v):
    return districts.district_counts(v.households)


@query("town_centroids", "A18", "city:s lat:d lon:d n:i",
       f"""SELECT city, {half_even("avg(CAST(lat AS DECIMAL(12,7)))", 5)} AS lat,
       {half_even("avg(CAST(lon AS DECIMAL(12,7)))", 5)} AS lon, count(*) AS n FROM household
       WHERE lat IS NOT NULL GROUP BY 1 HAVING count(*) >= 15""")
def _(v):
    return districts.town_centroids(v.households, minimum=15)


@query("data_bounds", "A18", "lon_min:d lon_max:d lat_min:d lat_max:d",
       """SELECT min(lon) - 0.01 AS lon_min, max(lon) + 0.01 AS lon_max, min(lat) - 0.01 AS lat_min,
       max(lat) + 0.01 AS lat_max FROM household""")
def _(v):
    return districts.data_bounds(v.households)


_HEAT_SQL = """heat AS (SELECT *, CASE WHEN people_count >= 3 AND household_row % 6 = 0 THEN 'cx'
         WHEN score_wake_ups >= score_unaffiliated AND score_wake_ups >= score_dropoff THEN 'lev'
         WHEN score_unaffiliated >= score_dropoff THEN 'so' ELSE 're' END AS bucket
       FROM household WHERE lat IS NOT NULL AND score_total > 0)"""


def _heat(v: Views) -> DataFrame:
    h = v.households.withColumn("people_count", F.when(F.col("household_row") % 6 == 0, F.col("people_count"))
                                .otherwise(1))
    return districts.heat_buckets(h, 3)


@query("heat_caps", "A41", "bucket:s cap:i points:i max_heat:d",
       f"""WITH {_HEAT_SQL}, r AS (SELECT bucket, score_total AS w, row_number() OVER (PARTITION BY bucket
         ORDER BY score_total) - 1 AS i, count(*) OVER (PARTITION BY bucket) AS n FROM heat)
       SELECT bucket, least(w, CASE WHEN bucket = 'cx' THEN 400 ELSE 60 END) AS cap, n AS points,
       sqrt(least(w, CASE WHEN bucket = 'cx' THEN 400 ELSE 60 END)) AS max_heat
       FROM r WHERE i = CAST(floor(n * 0.95) AS BIGINT)""")
def _(v):
    return districts.heat_caps(_heat(v))


@query("heat_grid", "A42", "bucket:s cx:i cy:i weight:d",
       f"""WITH {_HEAT_SQL} SELECT 'all' AS bucket, floor(lon / 0.05) AS cx, floor(lat / 0.05) AS cy,
       sum(sqrt(score_total)) AS weight FROM heat GROUP BY 1, 2, 3""")
def _(v):
    return districts.heat_grid(_heat(v), 0.05).withColumn("bucket", F.lit("all"))


# ---------------------------------------------------------- audience and search

def _audience(v: Views, spec: dict, **kw) -> DataFrame:
    p = v.served_people.drop("assembly_district", "senate_district", "congressional_district", "county",
                             "household_row")
    return audience.select_audience(p, v.households, donations.donor_summaries(v.donations), spec, **kw)


_AUD = """SELECT person_id, s.age, s.party, s.tier_letter, turnout_prob, h.score_total,
       coalesce(total_donated, 0) AS total_donated, coalesce(donation_count, 0) AS donation_count
       FROM served s JOIN household h USING (household_id) LEFT JOIN summary d ON d.donor_key = s.donor_key
       WHERE {where} ORDER BY tier_rank, {order}, person_id LIMIT {limit}"""
_AUD_COLUMNS = "person_id:i age:i party:s tier_letter:s turnout_prob:d score_total:i total_donated:d donation_count:i"


@query("audience_default", "P9 O1 J1 J2", _AUD_COLUMNS,
       _AUD.format(where="1 = 1", order="h.score_total DESC NULLS LAST", limit=500))
def _(v):
    return _audience(v, {}, sort_by="no_such_column")


@query("audience_wide_filter", "P9 O1", _AUD_COLUMNS,
       _AUD.format(where="""s.party IN ('DEM','BLK','IND') AND s.age >= 20 AND s.age <= 80
         AND upper(h.city) IN ('NATION_3','NATION_7','NATION_12') AND s.tier_letter IN ('X','F','L')
         AND turnout_prob >= 0.1 AND turnout_prob <= 0.9 AND dem_lean_prob >= 0.05 AND dem_lean_prob <= 0.95
         AND rep_lean_prob >= 0.01 AND rep_lean_prob <= 0.99""", order="rep_lean_prob ASC NULLS LAST", limit=500))
def _(v):
    return _audience(v, {
        "party": ["DEM", "BLK", "IND"], "age_min": 20, "age_max": 80,
        "cities": ["nation_3", "Nation_7", "NATION_12"], "tier_letters": ["X", "F", "L"],
        "min_turnout_prob": 0.1, "max_turnout_prob": 0.9, "min_dem_lean_prob": 0.05,
        "max_dem_lean_prob": 0.95, "min_rep_lean_prob": 0.01, "max_rep_lean_prob": 0.99},
        sort_by="rep_lean_prob", descending=False)


@query("audience_lapsed", "P9 O1", _AUD_COLUMNS,
       _AUD.format(where="""h.county = 'ASIA' AND coalesce(list_contains(years, 1996), false)
         AND NOT coalesce(list_contains(years, 1999), false)""", order="s.age DESC NULLS LAST", limit=500))
def _(v):
    return _audience(v, {"county": "asia", "voted_in_years": [1996], "skipped_years": [1999]}, sort_by="age")


@query("audience_skipped_null_history", "P9", _AUD_COLUMNS,
       _AUD.format(where="NOT coalesce(list_contains(years, 1998), false) AND h.assembly_district = 4",
                   order="turnout_prob DESC NULLS LAST", limit=500))
def _(v):
    return _audience(v, {"skipped_years": [1998], "assembly_district": 4, "party": [], "cities": None},
                     sort_by="turnout_prob")


@query("audience_donors", "P9 O1 A15", _AUD_COLUMNS,
       _AUD.format(where="donation_count > 0 AND coalesce(total_donated, 0) >= 100",
                   order="coalesce(total_donated, 0) DESC NULLS LAST", limit=500))
def _(v):
    return _audience(v, {"has_donated": True, "min_total_donated": 100}, sort_by="total_donated")


@query("audience_export", "K10 P9", "rank:i name:s address:s party:s turnout_pct:i elections_voted:s total_donated:d",
       """WITH a AS (SELECT s.*, h.score_total, h.address_num || ' ' || h.street AS address,
         coalesce(total_donated, 0) AS td FROM served s JOIN household h USING (household_id)
         LEFT JOIN summary d ON d.donor_key = s.donor_key WHERE s.party IN ('BLK')
         ORDER BY tier_rank, h.score_total DESC NULLS LAST, person_id LIMIT 100)
       SELECT row_number() OVER (ORDER BY tier_rank, score_total DESC, person_id) AS rank, name, address, party,
       floor(turnout_prob * 100 + 0.5) AS turnout_pct, array_to_string(years, '; ') AS elections_voted,
       td AS total_donated FROM a""")
def _(v):
    return audience.audience_export(_audience(v, {"party": ["BLK"]}, limit=100))


_VIEW_COLUMNS = "household_id:i lat:d lon:d score_total:i people_count:i"


@query("viewport", "P8", _VIEW_COLUMNS,
       """SELECT household_id, lat, lon, score_total, people_count FROM household
       WHERE lat BETWEEN 40.55 AND 40.95 AND lon BETWEEN -73.8 AND -73.1 AND assembly_district IN (1, 4, 7, 10)
       AND upper(city) IN ('NATION_3','NATION_4','NATION_5','NATION_6','NATION_7')
       ORDER BY score_total DESC, household_id LIMIT 2000""")
def _(v):
    return audience.viewport(v.households, 40.55, 40.95, -73.8, -73.1, districts=[1, 4, 7, 10],
                             cities=["nation_3", "nation_4", "nation_5", "nation_6", "nation_7"])


@query("viewport_everything", "P8", _VIEW_COLUMNS,
       """SELECT household_id, lat, lon, score_total, people_count FROM household
       WHERE lat BETWEEN 40.55 AND 40.95 AND lon BETWEEN -73.8 AND -73.1
       ORDER BY score_total DESC, household_id LIMIT 5000""")
def _(v):
    return audience.viewport(v.households, 40.55, 40.95, -73.8, -73.1, everything=True)


@query("viewport_empty_list", "P8", _VIEW_COLUMNS,
       "SELECT household_id, lat, lon, score_total, people_count FROM household WHERE false")
def _(v):
    return audience.viewport(v.households, 40.0, 41.0, -74.0, -73.0, districts=[])


@query("visible_top", "P12", "household_id:i score_total:i",
       """SELECT household_id, score_total FROM household WHERE lat BETWEEN 40.6 AND 40.9
       AND lon BETWEEN -73.8 AND -73.2 AND score_total <> 0 AND score_unaffiliated <> 0 AND people_count < 4
       ORDER BY score_total DESC, household_id LIMIT 10""")
def _(v):
    return audience.visible_top(v.households, 40.6, 40.9, -73.8, -73.2, cutoff=4, blk_only=True,
                                show_complex=False)


@query("address_search", "P10", "household_id:i score_total:i",
       """SELECT household_id, score_total FROM household WHERE address_num = '43'
       AND (contains(street, 'STREET2') OR contains(upper(city), 'STREET2'))
       ORDER BY score_total DESC, household_id LIMIT 60""")
def _(v):
    return audience.search_addresses(v.households, "43  Street2")


@query("text_search", "P10 U2", "household_id:i score_total:i",
       """SELECT * FROM ((SELECT household_id, score_total FROM household WHERE contains(street, 'NATION_1')
       ORDER BY score_total DESC, household_id LIMIT 50) UNION (SELECT household_id, score_total FROM household
       WHERE contains(upper(city), 'NATION_1') ORDER BY score_total DESC, household_id LIMIT 50))
       ORDER BY score_total DESC, household_id LIMIT 50""")
def _(v):
    return audience.search_addresses(v.households, "nation_1")


@query("household_search", "P10 O3 U2 W1 J14", "household_id:i score_total:i matched_idx:i members_shown:i",
       """WITH a AS (SELECT * FROM ((SELECT household_id, score_total FROM household WHERE contains(street, 'MACH')
         ORDER BY score_total DESC, household_id LIMIT 50) UNION (SELECT household_id, score_total FROM household
         WHERE contains(upper(city), 'MACH') ORDER BY score_total DESC, household_id LIMIT 50))
         ORDER BY score_total DESC, household_id LIMIT 50),
       n AS (SELECT DISTINCT household_id, h.score_total FROM person p JOIN household h USING (household_id)
         WHERE contains(upper(name), 'MACH') ORDER BY h.score_total DESC, household_id LIMIT 100),
       best AS (SELECT household_id, max(score_total) AS score_total FROM (SELECT * FROM a UNION ALL SELECT * FROM n)
         GROUP BY 1 ORDER BY score_total DESC, household_id LIMIT 60),
       m AS (SELECT household_id, name, row_number() OVER (PARTITION BY household_id
         ORDER BY tier_rank, tier_count DESC, name) - 1 AS i FROM person)
       SELECT household_id, score_total, coalesce(min(i) FILTER (contains(upper(name), 'MACH') AND i < 30), -1) AS matched_idx,
       count(*) FILTER (i < 30) AS members_shown FROM best JOIN m USING (household_id) GROUP BY 1, 2""")
def _(v):
    return audience.search(v.households, v.served_people, v.zip_scores, "mach")


@query("household_by_id", "P24 W1 J14", "household_id:i score_total:i ev_score:i name:s member_rank:i",
       f"""WITH {_ZIP_SQL} SELECT h.household_id, score_total, coalesce(score, 0) AS ev_score, p.name,
       row_number() OVER (ORDER BY tier_rank, tier_count DESC, p.name) AS member_rank
       FROM household h LEFT JOIN zs ON zs.zip = h.zip JOIN person p USING (household_id) WHERE h.household_id = 17""")
def _(v):
    return households.household_detail(v.households, v.people.select(
        "household_id", "name", "tier_letter", "tier_count", "city", "zip"), v.zip_scores, 17)


@query("filter_menus", "P22", "menu:s value:s",
       """SELECT DISTINCT 'assembly_district' AS menu, CAST(assembly_district AS VARCHAR) AS value FROM household
       WHERE score_total > 0 UNION SELECT DISTINCT 'city', city FROM household WHERE score_total > 0""")
def _(v):
    return households.filter_menus(v.households)
