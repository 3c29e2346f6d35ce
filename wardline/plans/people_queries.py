"""Queries over people, households, history, labels and context."""
from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import dates, ids, packed, scores, text
from ..operators import context, history, history_simple, households, people
from ..sources import sinks
from .registry import query
from .standin import REF_YEAR, TARGET, Views


def _parsed(v: Views):
    return people.with_people(v.packed)


@query("household_canvass_score", "F4 F5 A1",
       "household_row:i wake_ups:i unaffiliated:i dropoff:i total:i",
       """SELECT household_row, score_wake_ups AS wake_ups, score_unaffiliated AS unaffiliated,
       score_dropoff AS dropoff, score_total AS total FROM household""")
def _(v):
    return _parsed(v).select("household_row", households.canvass_score(F.col("people")).alias("s")) \
        .select("household_row", "s.*")


@query("top_canvass_households", "A1 O1", "household_row:i city:s total:i",
       """SELECT household_row, city, score_total AS total FROM household
       ORDER BY score_total DESC, household_row LIMIT 100""")
def _(v):
    s = _parsed(v).select("household_row", "city",
                          households.canvass_score(F.col("people"))["total"].alias("total"))
    return s.orderBy(F.desc("total"), "household_row").limit(100)


@query("parsed_people", "F4 F6 P2 D2 D3",
       "household_row:i member:i name:s age:i party:s tier_letter:s tier_count:i "
       "n_elections:i household_size:i",
       """SELECT p.household_row, member, name, age, party, tier_letter, tier_count,
       n_ballots AS n_elections, people_count AS household_size
       FROM person p JOIN hscore USING (household_row)""")
def _(v):
    return people.explode_people(_parsed(v)).withColumn("n_elections", F.size("elections"))


@query("parsed_without_history", "D2b F4", "household_row:i matched:i",
       """SELECT household_row, count(*) FILTER (n_ballots = 0) AS matched FROM person GROUP BY 1""")
def _(v):
    p = people.with_people(v.packed, with_history=False)
    return p.select("household_row", F.size("people").alias("matched"))


@query("unparseable_households", "P2", "households:i without_people:i",
       """SELECT count(*) AS households, count(*) FILTER (household_row % 5 = 0) AS without_people
       FROM hscore""")
def _(v):
    broken = v.packed.withColumn("household_detail", F.when(
        F.col("household_row") % 5 == 0, "not a person").otherwise(F.col("household_detail")))
    return people.unparseable_households(people.with_people(broken))


@query("numbered_ballots", "P3 W12 F5 D4", "person_row:i year:i etype:s method:s n:i",
       """SELECT person_row, year, etype, method, count(*) AS n FROM ballot
       WHERE person_row IN (SELECT person_row FROM person) GROUP BY 1, 2, 3, 4""")
def _(v):
    numbered = people.number_people(people.explode_people(_parsed(v)), block=500)
    return people.explode_ballots(numbered).groupBy("person_row", "year", "etype", "method").agg(
        F.count(F.lit(1)).alias("n"))


@query("ballots_before_target", "P7", "year:i etype:s n:i",
       """SELECT year, etype, count(*) AS n FROM ballot
       WHERE year < 2000 OR (year = 2000 AND etype = 'P') GROUP BY 1, 2""")
def _(v):
    return v.ballots.filter(history.before_target(TARGET)).groupBy("year", "etype").agg(
        F.count(F.lit(1)).alias("n"))


@query("participation_years", "A22", "person_row:i etype:s years:s",
       """SELECT person_row, etype, string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) AS years
       FROM (SELECT DISTINCT person_row, etype, year FROM ballot) GROUP BY 1, 2""")
def _(v):
    y = history.distinct_years(v.ballots)
    return y.withColumn("years", F.array_join(F.col("years").cast("array<string>"), ","))


_HISTORY_COLUMNS = (
    "person_row:i hist_n_generals:i hist_n_primaries:i hist_n_votes:i hist_general_rate_5:d "
    "hist_general_rate_8:d hist_general_rate_12:d hist_eligible_generals_8:i hist_pres_rate:d "
    "hist_midterm_rate:d hist_oddyear_rate:d hist_years_since_last_vote:i "
    "hist_years_since_last_general:i hist_years_since_first_seen:i hist_never_voted:i "
    "hist_voted_g1:i hist_voted_g2:i hist_voted_g3:i hist_voted_g4:i hist_voted_primary_cycle:i "
    "hist_streak_current:i hist_streak_longest:i hist_trend_3v5:d hist_share_early:d "
    "hist_share_absentee:d hist_share_pollsite:d hist_age_at_target:i "
    "hist_hh_general_rate_8_excl:d hist_ed_general_rate_8_excl:d y_voted_general_2000:i")

_HISTORY_SQL = """
SELECT a.*,
  CASE WHEN count(*) OVER hh > 1 THEN (sum(round(hist_general_rate_8 * 840)) OVER hh
    - round(hist_general_rate_8 * 840)) / ((count(*) OVER hh - 1) * 840) ELSE 0 END AS hist_hh_general_rate_8_excl,
  CASE WHEN count(*) OVER ed > 1 THEN (sum(round(hist_general_rate_8 * 840)) OVER ed
    - round(hist_general_rate_8 * 840)) / ((count(*) OVER ed - 1) * 840) ELSE 0 END AS hist_ed_general_rate_8_excl
FROM (
  SELECT p.person_row, p.household_row, p.ed_key,
    n_g AS hist_n_generals, n_p AS hist_n_primaries, n_g + n_p AS hist_n_votes,
    CASE WHEN e5 > 0 THEN v5 / e5 ELSE 0 END AS hist_general_rate_5,
    CASE WHEN e8 > 0 THEN v8 / e8 ELSE 0 END AS hist_general_rate_8,
    CASE WHEN e12 > 0 THEN v12 / e12 ELSE 0 END AS hist_general_rate_12,
    e8 AS hist_eligible_generals_8,
    CASE WHEN ep > 0 THEN vp / ep ELSE 0 END AS hist_pres_rate,
    CASE WHEN em > 0 THEN vm / em ELSE 0 END AS hist_midterm_rate,
    CASE WHEN eo > 0 THEN vo / eo ELSE 0 END AS hist_oddyear_rate,
    coalesce(2000 - last_any, 99) AS hist_years_since_last_vote,
    coalesce(2000 - last_g, 99) AS hist_years_since_last_general,
    coalesce(2000 - first_any, 99) AS hist_years_since_first_seen,
    CASE WHEN last_any IS NULL THEN 1 ELSE 0 END AS hist_never_voted,
    g1 AS hist_voted_g1, g2 AS hist_voted_g2, g3 AS hist_voted_g3, g4 AS hist_voted_g4,
    pc AS hist_voted_primary_cycle,
    coalesce(cur, 0) AS hist_streak_current, coalesce(best, 0) AS hist_streak_longest,
    CASE WHEN e3 > 0 THEN v3 / e3 ELSE 0 END - CASE WHEN e48 > 0 THEN v48 / e48 ELSE 0 END
      AS hist_trend_3v5,
    CASE WHEN n_pre > 0 THEN n_v / n_pre ELSE 0 END AS hist_share_early,
    CASE WHEN n_pre > 0 THEN n_a / n_pre ELSE 0 END AS hist_share_absentee,
    CASE WHEN n_pre > 0 THEN n_e / n_pre ELSE 0 END AS hist_share_pollsite,
    age - 2 AS hist_age_at_target, yv AS y_voted_general_2000
  FROM (
    SELECT q.person_row, any_value(q.household_row) AS household_row, any_value(q.ed_key) AS ed_key,
      any_value(q.age) AS age, any_value(y18) AS y18,
      count(DISTINCT year) FILTER (etype = 'G' AND year < 2000) AS n_g,
      count(DISTINCT year) FILTER (etype = 'P' AND year <= 2000) AS n_p,
      count(DISTINCT year) FILTER (etype = 'G' AND year BETWEEN 1995 AND 1999) AS v5,
      count(DISTINCT year) FILTER (etype = 'G' AND year BETWEEN 1992 AND 1999) AS v8,
      count(DISTINCT year) FILTER (etype = 'G' AND year BETWEEN 1988 AND 1999) AS v12,
      count(DISTINCT year) FILTER (etype = 'G' AND year BETWEEN 1997 AND 1999) AS v3,
      count(DISTINCT year) FILTER (etype = 'G' AND year BETWEEN 1992 AND 1996) AS v48,
      count(DISTINCT year) FILTER (etype = 'G' AND year BETWEEN 1984 AND 1999 AND year % 4 = 0) AS vp,
      count(DISTINCT year) FILTER (etype = 'G' AND year BETWEEN 1984 AND 1999 AND year % 4 = 2) AS vm,
      count(DISTINCT year) FILTER (etype = 'G' AND year BETWEEN 1992 AND 1999 AND year % 2 = 1) AS vo,
      greatest(0, least(5, 1999 - greatest(1995, any_value(y18)) + 1)) AS e5,
      greatest(0, least(8, 1999 - greatest(1992, any_value(y18)) + 1)) AS e8,
      greatest(0, least(12, 1999 - greatest(1988, any_value(y18)) + 1)) AS e12,
      greatest(0, least(3, 1999 - greatest(1997, any_value(y18)) + 1)) AS e3,
      greatest(0, least(5, 1996 - greatest(1992, any_value(y18)) + 1)) AS e48,
      greatest(0, 1999 // 4 - (greatest(1984, any_value(y0), any_value(y18)) - 1) // 4) AS ep,
      greatest(0, 1997 // 4 - (greatest(1984, any_value(y0), any_value(y18)) - 3) // 4) AS em,
      greatest(0, 1998 // 2 - (greatest(1992, any_value(y0), any_value(y18)) - 2) // 2) AS eo,
      max(year) FILTER (year < 2000 OR (year = 2000 AND etype = 'P')) AS last_any,
      min(year) FILTER (year < 2000 OR (year = 2000 AND etype = 'P')) AS first_any,
      max(year) FILTER (etype = 'G' AND year < 2000) AS last_g,
      max(CASE WHEN etype = 'G' AND year = 1999 THEN 1 ELSE 0 END) AS g1,
      max(CASE WHEN etype = 'G' AND year = 1998 THEN 1 ELSE 0 END) AS g2,
      max(CASE WHEN etype = 'G' AND year = 1997 THEN 1 ELSE 0 END) AS g3,
      max(CASE WHEN etype = 'G' AND year = 1996 THEN 1 ELSE 0 END) AS g4,
      max(CASE WHEN etype = 'P' AND year = 2000 THEN 1 ELSE 0 END) AS pc,
      max(CASE WHEN etype = 'G' AND year = 2000 THEN 1 ELSE 0 END) AS yv,
      count(*) FILTER (year < 2000 OR (year = 2000 AND etype = 'P')) AS n_pre,
      count(*) FILTER ((year < 2000 OR (year = 2000 AND etype = 'P')) AND method = 'V') AS n_v,
      count(*) FILTER ((year < 2000 OR (year = 2000 AND etype = 'P')) AND method IN ('A','M','F')) AS n_a,
      count(*) FILTER ((year < 2000 OR (year = 2000 AND etype = 'P')) AND method IN ('E','D')) AS n_e
    FROM (SELECT *, 2002 - age + 18 AS y18,
      (SELECT min(year) FROM ballot) AS y0 FROM person) q LEFT JOIN ballot b USING (person_row)
    GROUP BY 1) p
  LEFT JOIN (
    SELECT person_row, max(len) AS best, max(CASE WHEN hi = 1999 THEN len ELSE 0 END) AS cur
    FROM (SELECT person_row, count(*) AS len, max(year) AS hi
          FROM (SELECT person_row, year,
                  year - row_number() OVER (PARTITION BY person_row ORDER BY year) AS island
                FROM (SELECT DISTINCT person_row, year FROM ballot WHERE etype = 'G' AND year < 2000))
          GROUP BY person_row, island)
    GROUP BY 1) s USING (person_row)) a
WINDOW hh AS (PARTITION BY household_row), ed AS (PARTITION BY ed_key)"""


@query("history_features", "A22 A23 A24 A25 A26 A27 A28 A29 A30 W4 P7 J5",
       _HISTORY_COLUMNS, _HISTORY_SQL)
def _(v):
    return history.history_features(v.people, v.ballots, TARGET, REF_YEAR)


_S = "_simple"


@query("history_features_simple", "A31 F19",
       "person_row:i " + " ".join(f"hist_{c}_simple:{t}" for c, t in (
           ("n_votes", "i"), ("n_generals", "i"), ("general_rate_5", "d"), ("general_rate_8", "d"),
           ("general_rate_12", "d"), ("eligible_8", "i"), ("pres_rate", "d"), ("midterm_rate", "d"),
           ("oddyear_rate", "d"), ("years_since_last", "i"), ("years_since_first", "i"),
           ("never_voted", "i"), ("voted_g1", "i"), ("voted_g2", "i"), ("voted_g3", "i"),
           ("voted_g4", "i"), ("streak_current", "i"), ("streak_longest", "i"), ("trend_3v5", "d"),
           ("n_primaries", "i"), ("voted_primary_cycle", "i"))),
       """
SELECT person_row, n_g + n_p AS hist_n_votes_simple, d_all AS hist_n_generals_simple,
  d_even / 2 AS hist_general_rate_5_simple, d_even / 2 AS hist_general_rate_8_simple,
  d_even / 2 AS hist_general_rate_12_simple, 2 AS hist_eligible_8_simple,
  h96 AS hist_pres_rate_simple, h98 AS hist_midterm_rate_simple,
  (h95 + h97 + h99) / 3 AS hist_oddyear_rate_simple,
  coalesce(2000 - last_g, 99) AS hist_years_since_last_simple,
  coalesce(2002 - first_g, 99) AS hist_years_since_first_simple,
  CASE WHEN d_all = 0 THEN 1 ELSE 0 END AS hist_never_voted_simple,
  h99 AS hist_voted_g1_simple, h98 AS hist_voted_g2_simple, h97 AS hist_voted_g3_simple,
  h96 AS hist_voted_g4_simple,
  CASE WHEN h95 = 0 THEN 0 WHEN h96 = 0 THEN 1 WHEN h97 = 0 THEN 2 WHEN h98 = 0 THEN 3
    WHEN h99 = 0 THEN 4 ELSE 5 END AS hist_streak_current_simple,
  coalesce(best, 0) AS hist_streak_longest_simple,
  (h97 + h98 + h99) / 3 - (h95 + h96 + h97 + h98 + h99) / 5 AS hist_trend_3v5_simple,
  n_p AS hist_n_primaries_simple, pe AS hist_voted_primary_cycle_simple
FROM (SELECT p.person_row,
    count(*) FILTER (etype = 'G' AND year < 2000) AS n_g,
    count(*) FILTER (etype = 'P' AND year <= 2000) AS n_p,
    count(DISTINCT year) FILTER (etype = 'G' AND year < 2000) AS d_all,
    count(DISTINCT year) FILTER (etype = 'G' AND year < 2000 AND year % 2 = 0) AS d_even,
    max(CASE WHEN etype = 'G' AND year = 1995 THEN 1 ELSE 0 END) AS h95,
    max(CASE WHEN etype = 'G' AND year = 1996 THEN 1 ELSE 0 END) AS h96,
    max(CASE WHEN etype = 'G' AND year = 1997 THEN 1 ELSE 0 END) AS h97,
    max(CASE WHEN etype = 'G' AND year = 1998 THEN 1 ELSE 0 END) AS h98,
    max(CASE WHEN etype = 'G' AND year = 1999 THEN 1 ELSE 0 END) AS h99,
    max(CASE WHEN etype = 'P' AND year = 2000 THEN 1 ELSE 0 END) AS pe,
    max(year) FILTER (etype = 'G' AND year < 2000) AS last_g,
    min(year) FILTER (etype = 'G' AND year < 2000) AS first_g
  FROM person p LEFT JOIN ballot b USING (person_row) GROUP BY 1)
LEFT JOIN (SELECT person_row, max(len) AS best FROM (
    SELECT person_row, count(*) AS len FROM (
      SELECT person_row, year - row_number() OVER (PARTITION BY person_row ORDER BY year) AS island
      FROM (SELECT DISTINCT person_row, year FROM ballot WHERE etype = 'G' AND year < 2000))
    GROUP BY person_row, island) GROUP BY 1) USING (person_row)""")
def _(v):
    return history_simple.history_features_simple(v.people, v.ballots, TARGET, REF_YEAR)


def _others(cond: str, key: str) -> str:
    one = f"(CASE WHEN {cond} THEN 1 ELSE 0 END)"
    w = f"OVER (PARTITION BY {key})"
    return (f"CASE WHEN count(*) {w} > 1 THEN (sum({one}) {w} - {one}) / (count(*) {w} - 1) "
            f"ELSE 0 END")


@query("household_party_shares", "W2",
       "person_row:i household_size:i hh_dem_share_excl:d hh_rep_share_excl:d hh_blk_share_excl:d",
       f"""SELECT person_row, count(*) OVER (PARTITION BY household_row) AS household_size,
       {_others("party IN ('DEM','WOR')", "household_row")} AS hh_dem_share_excl,
       {_others("party IN ('REP','CON')", "household_row")} AS hh_rep_share_excl,
       {_others("party = 'BLK'", "household_row")} AS hh_blk_share_excl FROM person""")
def _(v):
    return context.household_shares(v.people)


@query("district_party_shares", "W3",
       "person_row:i ed_n_voters:i ed_mean_tier_count:d ed_dem_share_excl:d ed_rep_share_excl:d "
       "ed_blk_share_excl:d",
       f"""SELECT person_row, count(*) OVER (PARTITION BY ed_key) AS ed_n_voters,
       avg(tier_count) OVER (PARTITION BY ed_key) AS ed_mean_tier_count,
       {_others("y_party = 0", "ed_key")} AS ed_dem_share_excl,
       {_others("y_party = 1", "ed_key")} AS ed_rep_share_excl,
       {_others("party = 'BLK'", "ed_key")} AS ed_blk_share_excl FROM labelled""")
def _(v):
    return context.district_shares(context.with_labels(v.people, v.ballots, TARGET, REF_YEAR))


@query("party_shares_simple", "W2b W3b",
       "person_row:i hh_dem_share_excl_simple:d hh_rep_share_excl_simple:d "
       "hh_blk_share_excl_simple:d ed_n_voters_simple:i ed_dem_share_excl_simple:d "
       "ed_rep_share_excl_simple:d ed_blk_share_excl_simple:d",
       f"""SELECT person_row, {_others("party = 'DEM'", "household_row")} AS hh_dem_share_excl_simple,
       {_others("party = 'REP'", "household_row")} AS hh_rep_share_excl_simple,
       {_others("party = 'BLK'", "household_row")} AS hh_blk_share_excl_simple,
       count(*) OVER (PARTITION BY county, election_district) AS ed_n_voters_simple,
       {_others("party = 'DEM'", "county, election_district")} AS ed_dem_share_excl_simple,
       {_others("party = 'REP'", "county, election_district")} AS ed_rep_share_excl_simple,
       {_others("party = 'BLK'", "county, election_district")} AS ed_blk_share_excl_simple
       FROM person""")
def _(v):
    return context.district_shares_simple(context.household_shares_simple(v.people))


@query("labels", "A32", "person_row:i y_turnout:i y_turnout_tier:i y_party:i",
       "SELECT person_row, y_turnout, y_turnout_tier, y_party FROM labelled")
def _(v):
    return context.with_labels(v.people, v.ballots, TARGET, REF_YEAR)


@query("labels_simple", "A33", "person_row:i y_turnout_simple:i y_party_simple:i",
       """SELECT person_row, CASE WHEN coalesce(nullif(age, 33), 0) - 2 >= 18 THEN
         CASE WHEN EXISTS (SELECT 1 FROM ballot b WHERE b.person_row = p.person_row AND year = 2000
           AND etype = 'G') THEN 1 ELSE 0 END ELSE -1 END AS y_turnout_simple,
       CASE WHEN nullif(party, 'OTH') IS NULL OR party IN ('BLK','IND') THEN -1
         WHEN party IN ('DEM','WOR') THEN 0 WHEN party IN ('REP','CON') THEN 1 ELSE 2 END
         AS y_party_simple FROM person p""")
def _(v):
    p = v.people.withColumns({"age": F.nullif("age", F.lit(33)), "party": F.nullif("party", F.lit("OTH"))})
    return context.with_labels(p, v.ballots, TARGET, REF_YEAR, simple=True)


@query("household_stats", "A2",
       "household_row:i gap:i reliable:i low:i oldest:i youngest:i members:i dominant_tier:s",
       """SELECT household_row, max(tier_count) - min(tier_count) AS gap,
       count(*) FILTER (tier_letter = 'X' AND tier_count >= 4) AS reliable,
       count(*) FILTER (tier IN ('I0','F1','L1','F2','L2')) AS low, max(age) AS oldest,
       min(age) AS youngest, count(*) AS members,
       (['X','F','L','I'])[CAST(min(tier_rank) AS INT) + 1] AS dominant_tier
       FROM person GROUP BY 1""")
def _(v):
    return households.household_stats(v.people)


@query("dominant_component", "A3", "dominant:s households:i",
       """SELECT CASE WHEN score_wake_ups >= score_unaffiliated AND score_wake_ups >= score_dropoff
       THEN 'lev' WHEN score_unaffiliated >= score_dropoff THEN 'so' ELSE 're' END AS dominant,
       count(*) AS households FROM household GROUP BY 1""")
def _(v):
    d = scores.dominant_component(F.col("score_wake_ups"), F.col("score_unaffiliated"),
                                  F.col("score_dropoff"))
    return v.households.groupBy(d.alias("dominant")).agg(F.count(F.lit(1)).alias("households"))


@query("top_members", "W1", "ed_key:s person_row:i member_rank:i",
       """SELECT * FROM (SELECT ed_key, person_row, row_number() OVER (PARTITION BY ed_key
       ORDER BY tier_rank, tier_count DESC, person_row) AS member_rank FROM person)
       WHERE member_rank <= 5""")
def _(v):
    return households.top_members(v.people, "ed_key", 5, "person_row")


@query("people_count", "A17", "household_id:i people_count:i",
       "SELECT household_row AS household_id, people_count FROM hscore")
def _(v):
    return people.people_count(v.people)


@query("priority_people", "P4", "person_row:i with_rep:i",
       """SELECT person_row, CASE WHEN party = 'REP' THEN 1 ELSE 0 END AS with_rep FROM person
       WHERE party = 'BLK' OR (party = 'DEM' AND tier IN ('I0','F1','L1')) OR party = 'REP'""")
def _(v):
    wide = people.priority_people(v.people, include_rep=True)
    narrow = people.priority_people(v.people).select("person_row", F.lit(0).alias("with_rep"))
    extra = wide.join(narrow.select("person_row"), "person_row", "left_anti").select(
        "person_row", F.lit(1).alias("with_rep"))
    return narrow.unionByName(extra)


@query("first_per_key", "U3", "donor_key:s person_row:i age:i",
       """SELECT donor_key, min(person_row) AS person_row, arg_min(age, person_row) AS age
       FROM person GROUP BY 1""")
def _(v):
    return people.first_per_key(v.people.select("donor_key", "person_row", "age"), "donor_key",
                                "person_row")


@query("earliest_duplicates", "W8", "household_id:s name:s id:i",
       """SELECT ed_key AS household_id, name, arg_min(person_row, (age, person_row)) AS id
       FROM person GROUP BY 1, 2""")
def _(v):
    return people.drop_duplicate_people(v.people.select(
        F.col("ed_key").alias("household_id"), "name", F.col("person_row").alias("id"),
        F.col("age").alias("created_at")))


@query("served_households", "P20 F10 F11 K5 D10", "household_id:s county:s zip:s n:i",
       """SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-'
         || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS household_id, county, zip, n
       FROM (SELECT md5(county || '|' || address_num || '|' || street || '|' || zip) AS h, county,
         zip, count(*) AS n FROM household WHERE county IN ('ASIA', 'EUROPE')
         GROUP BY county, address_num, street, zip)""")
def _(v):
    h = people.served_households(_parsed(v), ["ASIA", "EUROPE"])
    return h.groupBy("household_id", "county", "zip").agg(F.count(F.lit(1)).alias("n"))


@query("served_people_rows", "P20 F20 K5", "donor_key:s party:s tier_letter:s tier_count:i n:i",
       """SELECT upper(p.name) || '|' || upper(h.city) || '|' || h.zip AS donor_key, p.party,
       p.tier_letter, p.tier_count, count(*) AS n FROM person p JOIN household h USING (household_row)
       WHERE h.county IN ('ASIA', 'EUROPE') GROUP BY 1, 2, 3, 4""")
def _(v):
    p = people.served_people(people.served_households(_parsed(v), ["ASIA", "EUROPE"]))
    return p.groupBy("donor_key", "party", "tier_letter", "tier_count").agg(
        F.count(F.lit(1)).alias("n"))


@query("insert_absent", "K5", "ed_key:s name:s person_row:i",
       """SELECT ed_key, name, min(person_row) AS person_row FROM person p
       WHERE NOT EXISTS (SELECT 1 FROM person q WHERE q.person_row % 4 = 0 AND q.ed_key = p.ed_key
         AND q.name = p.name) AND person_row % 4 <> 0 GROUP BY 1, 2""")
def _(v):
    p = v.people.select("ed_key", "name", "person_row")
    stored, batch = p.filter("person_row % 4 = 0"), p.filter("person_row % 4 <> 0")
    return sinks.insert_absent(stored, batch, ["ed_key", "name"], ["person_row"])


@query("load_quality", "A39",
       "persons:i eligible:i masked:i turnout_share:d tier_agreement:d party_share_dem:d "
       "party_share_masked:d n_dem:i n_blk:i duplicate_ids:i expected_persons:i ballots:i "
       "with_history:i first_year:i last_year:i",
       """SELECT count(*) AS persons, count(*) FILTER (y_turnout >= 0) AS eligible,
       count(*) FILTER (y_turnout < 0) AS masked, avg(y_turnout) FILTER (y_turnout >= 0) AS turnout_share,
       avg(CASE WHEN y_turnout = y_turnout_tier THEN 1 ELSE 0 END) FILTER (y_turnout >= 0)
         AS tier_agreement,
       avg(CASE WHEN y_party = 0 THEN 1 ELSE 0 END) AS party_share_dem,
       avg(CASE WHEN y_party = -1 THEN 1 ELSE 0 END) AS party_share_masked,
       count(*) FILTER (party = 'DEM') AS n_dem, count(*) FILTER (party = 'BLK') AS n_blk,
       count(*) - count(DISTINCT donor_key) AS duplicate_ids, count(*) AS expected_persons,
       (SELECT count(*) FROM ballot) AS ballots,
       (SELECT count(DISTINCT person_row) FROM ballot) AS with_history,
       (SELECT min(year) FROM ballot) AS first_year, (SELECT max(year) FROM ballot) AS last_year
       FROM labelled""")
def _(v):
    p = context.with_labels(v.people, v.ballots, TARGET, REF_YEAR)
    expected = v.packed.agg(F.sum("voters_at_address"))
    return people.load_quality(p.withColumn("person_id", F.col("donor_key")), v.ballots, expected)


@query("election_days", "F9 F23", "year:i day:s shifted_age:i",
       """SELECT year, strftime(make_date(year, 11, 1) + CAST((8 - isodow(make_date(year, 11, 1))) % 7
         + 1 AS INT), '%Y-%m-%d') AS day, max_age - (2002 - year) AS shifted_age
       FROM (SELECT year, max(age) AS max_age FROM ballot JOIN person USING (person_row) GROUP BY 1)""")
def _(v):
    y = v.ballots.join(v.people, "person_row").groupBy("year").agg(F.max("age").alias("a"))
    return y.select("year", dates.election_day_column(F.col("year")).alias("day"),
                    (F.col("a") - (F.lit(2002) - F.col("year"))).alias("shifted_age"))


@query("text_functions", "P1 F1 F2 F8 F11 F12 F16",
       "person_row:i clean:s street:s number:i iso:s zip5:s as_int:i as_text:s addr_no:s "
       "addr_street:s given:s family:s history:s",
       """SELECT person_row, CASE WHEN k % 6 = 0 THEN '' ELSE CAST(k AS VARCHAR) END AS clean,
       'STREET' || (k % 40) || ' AVE RDG' AS street, k AS number,
       CASE WHEN k % 5 = 0 THEN '' ELSE '2001-03-' || lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0') END AS iso,
       CASE WHEN k < 10000 THEN lpad(CAST(k AS VARCHAR), 5, '0') ELSE CAST(k AS VARCHAR) END AS zip5,
       CASE WHEN k % 4 <> 0 THEN k END AS as_int, CASE WHEN k % 3 <> 0 THEN 'x' END AS as_text,
       CASE WHEN k % 2 = 0 THEN '' ELSE k || 'A' END AS addr_no, 'MAIN ST' AS addr_street,
       'O''Brien' AS given, 'Mc-Kay Smith' AS family, '2000 GENERAL: Mail; x' AS history FROM person""")
def _(v):
    k = F.col("person_row").cast("string")
    n = F.col("person_row")
    num, street = text.split_street_address(
        F.when(n % 2 == 0, " Main St ").otherwise(F.concat(k, F.lit("A  Main St"))))
    given, family = text.split_given_family(F.lit("o'bRIEN mc-kay SMITH"))
    return v.people.select(
        "person_row",
        text.clean_text(F.when(n % 6 == 0, " NaN ").otherwise(F.concat(F.lit(" "), k, F.lit(".0")))).alias("clean"),
        text.normalize_street(F.concat(F.lit(" Street"), (n % 40).cast("string"),
                                       F.lit("  avenue ridge "))).alias("street"),
        text.house_number(F.concat(k, F.lit("B"))).alias("number"),
        text.compact_date_to_iso(F.when(n % 5 == 0, "0301201").otherwise(F.concat(
            F.lit("03"), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit("2001 ")))).alias("iso"),
        text.zip_padded(F.concat(k, F.lit(".0"))).alias("zip5"),
        text.safe_int(F.when(n % 4 != 0, F.concat(k, F.lit(".7"))).otherwise("n/a")).alias("as_int"),
        text.safe_text(F.when(n % 3 != 0, " x ").otherwise("  ")).alias("as_text"),
        num.alias("addr_no"), street.alias("addr_street"), given.alias("given"),
        family.alias("family"), text.history_text(F.lit("2000 GENERAL: Mail, , x")).alias("history"))


@query("keys_and_tokens", "F7 F10 F20", "person_row:i donor_key:s donor_city:s tokens:s norm:s last:s",
       """SELECT person_row, donor_key, upper(city) AS donor_city,
       array_to_string(list_sort(list_distinct(regexp_extract_all(upper(name), '[A-Z]+'))), '|') AS tokens,
       array_to_string(list_sort(regexp_extract_all(upper(name), '[A-Z]+')), '|') AS norm,
       split_part(name, ' ', -1) AS last FROM person""")
def _(v):
    key = ids.donor_key(F.col("name"), F.col("city"), F.col("zip"))
    return v.people.select(
        "person_row", key.alias("donor_key"), ids.donor_key_part(key, 1).alias("donor_city"),
        F.array_join(text.name_tokens(F.col("name")), "|").alias("tokens"),
        text.normalized_name(F.col("name")).alias("norm"),
        text.person_last_name(F.col("name")).alias("last"))


@query("person_ids", "F10 W12", "people:i ids:i smallest_ok:i",
       """SELECT count(*) AS people, count(DISTINCT (name, upper(city), zip, county, household_row)) AS ids,
       1 AS smallest_ok FROM person""")
def _(v):
    p = v.people.withColumnsRenamed({"zip": "zip_code"}).withColumns({
        "address_number": F.col("household_row").cast("string"), "street_name": F.lit("MAIN ST")})
    i = people.with_person_ids(p.drop("person_id"))
    return i.agg(F.count(F.lit(1)).alias("people"), F.count_distinct("person_id").alias("ids"),
                 (F.min("person_id") >= 0).cast("int").alias("smallest_ok"))


@query("elections_from_json", "F19 D5", "person_row:i n:i first_code:s years:s",
       """SELECT person_row, len(years) AS n,
       (SELECT etype || method FROM ballot b WHERE b.person_row = s.person_row
        ORDER BY year, etype || method LIMIT 1) AS first_code, array_to_string(years, ',') AS years
       FROM served s WHERE years IS NOT NULL""")
def _(v):
    j = F.to_json(F.transform("elections", lambda e: F.array(
        e["year"].cast("string"), F.lower(e["code"]))))
    # one malformed item and one without a code are skipped
    text_json = F.concat(F.expr("left(j, length(j) - 1)"), F.lit(',["x"],["2001",""]]'))
    p = v.served_people.filter(F.col("elections").isNotNull()).withColumn("j", j)
    e = p.select("person_row", packed.elections_from_json(text_json).alias("e"))
    return e.select("person_row", F.size("e").alias("n"), F.get("e", F.lit(0))["code"].alias("first_code"),
                    F.array_join(F.transform("e", lambda x: x["year"].cast("string")), ",").alias("years"))


@query("upsert_zip_scores", "K7", "zip:s score:i count:i",
       """WITH z AS (SELECT zip, count(*) AS n FROM person GROUP BY 1)
       SELECT zip, CASE WHEN CAST(zip AS INT) % 2 = 0 THEN n + 1 ELSE n END AS score,
       CASE WHEN CAST(zip AS INT) % 2 = 0 THEN 2 * n ELSE n END AS count FROM z""")
def _(v):
    z = v.people.groupBy("zip").agg(F.count(F.lit(1)).alias("score")).withColumn("count", F.col("score"))
    fresh = z.filter("int(zip) % 2 = 0").select("zip", (F.col("score") + 1).alias("score"),
                                                (F.col("count") * 2).alias("count"))
    stored = z.filter("int(zip) % 3 <> 0 or int(zip) % 2 <> 0")
    return sinks.upsert(stored, fresh, "zip")


@query("scores_written_back", "K8", "person_row:i turnout_prob:d rep_lean_prob:d",
       """SELECT person_row, CASE WHEN person_row % 2 = 0 THEN round(person_row / 7000.0, 4)
         ELSE turnout_prob END AS turnout_prob,
       CASE WHEN person_row % 2 = 0 THEN 0.25 ELSE rep_lean_prob END AS rep_lean_prob FROM served""")
def _(v):
    s = v.people.filter("person_row % 2 = 0").select(
        "person_id", (F.col("person_row") / 7000.0).alias("turnout_propensity"),
        F.lit(0.5).alias("p_dem_lean"), F.lit(0.25).alias("p_rep_lean"))
    return sinks.write_scores_back(v.served_people, s)


