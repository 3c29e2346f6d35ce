"""Registered queries: a Spark plan over the stand-in views, its column types,
and, where SQL can say it, an independent statement of the same result."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .standin import Views

_SPARK = {"i": lambda c: c.cast("bigint"),
          "d": lambda c: F.round(c.cast("double"), 6) + F.lit(0.0),
          "s": lambda c: c.cast("string")}
_DUCK = {"i": "CAST({0} AS BIGINT)", "d": "ROUND(CAST({0} AS DOUBLE), 6) + 0.0",
         "s": "CAST({0} AS VARCHAR)"}


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    columns: list[tuple[str, str]]
    plan: Callable[[Views], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.plan(Views(spark, folder))
        return df.select(*[_SPARK[t](F.col(c)).alias(c) for c, t in self.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cols = ", ".join(f"{_DUCK[t].format(c)} AS {c}" for c, t in self.columns)
        return f"{PRELUDE}, answer AS ({self.sql}) SELECT {cols} FROM answer"


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, columns: str, sql: str | None = None):
    """``columns``: ``name:i`` integer, ``:d`` number rounded to 6 digits, ``:s`` text."""
    spec = [tuple(c.rsplit(":", 1)) for c in columns.split()]

    def deco(fn: Callable[[Views], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, covers, spec, fn, sql)
        return fn

    return deco


def half_even(x: str, digits: int) -> str:
    """SQL for half-even rounding of the binary value: only an exact tie is a tie."""
    x = f"CAST({x} AS DOUBLE)"
    s, k = f"1e{digits}", "134217729.0::DOUBLE"
    p, high = f"({x} * {s})", f"({x} * {k} - ({x} * {k} - {x}))"
    err = f"(({high} * {s} - {p}) + ({x} - {high}) * {s})"
    return (f"(CASE WHEN {p} - floor({p}) <> 0.5 THEN round_even({p}, 0) WHEN {err} > 0 THEN floor({p}) + 1 "
            f"WHEN {err} < 0 THEN floor({p}) ELSE round_even({p}, 0) END / {s})")


# The stand-in views in the oracle's dialect.
PRELUDE = """
WITH ballot AS (
  SELECT o_custkey AS person_row, CAST(year(o_orderdate) AS INT) AS year,
    CASE WHEN o_orderstatus = 'P' THEN 'P' ELSE 'G' END AS etype,
    substr('EVAFDMO', CAST(o_orderkey % 7 AS INT) + 1, 1) AS method, o_orderkey AS ballot_id
  FROM orders),
ballot_n AS (SELECT person_row, count(*) AS nb FROM ballot GROUP BY 1),
person0 AS (
  SELECT c_custkey AS k, c.c_custkey AS person_row, c_custkey AS person_id,
    c_custkey // 3 AS household_row, c_custkey % 3 AS member,
    chr(CAST(65 + c_custkey % 26 AS INT)) || chr(CAST(65 + c_custkey // 26 % 26 AS INT))
      || CASE WHEN c_custkey % 41 = 0 THEN ' (X) ' ELSE ' ' END || c_mktsegment AS name,
    16 + (c_custkey * 7) % 70 AS age,
    (['DEM','REP','BLK','WOR','CON','IND','OTH'])[CAST(c_custkey % 7 AS INT) + 1] AS party,
    (['X','F','L','I'])[CAST(coalesce(nb, 0) % 4 AS INT) + 1] AS tier_letter,
    coalesce(nb, 0) % 5 AS tier_count, coalesce(nb, 0) AS n_ballots,
    r_name AS county, n_name AS city, lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS zip,
    r_name || '|' || n_name || '|' || c_mktsegment AS ed_key,
    c_custkey % 22 + 1 AS assembly_district, c_custkey % 9 + 1 AS senate_district,
    c_custkey % 4 + 1 AS congressional_district, c_custkey % 11 AS election_district, c_acctbal
  FROM customer c JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey LEFT JOIN ballot_n b ON b.person_row = c_custkey),
person AS (
  SELECT *, tier_letter || CAST(tier_count AS VARCHAR) AS tier,
    upper(name) || '|' || upper(city) || '|' || zip AS donor_key, household_row AS household_id,
    CASE tier_letter WHEN 'X' THEN 0 WHEN 'F' THEN 1 WHEN 'L' THEN 2 ELSE 3 END AS tier_rank
  FROM person0),
donation AS (
  SELECT CASE WHEN event_id % 2 = 0 THEN 'fec' ELSE 'nyboe' END AS source,
    CASE WHEN event_id % 17 <> 0 THEN DATE '1998-01-01' + CAST((event_id * 37) % 1400 AS INT) END
      AS donation_date,
    CASE WHEN event_id % 19 <> 0 THEN value END AS amount,
    CASE WHEN event_id % 23 <> 0 THEN CASE event_type WHEN 'click' THEN 'ACTBLUE'
      WHEN 'view' THEN 'WinRed' WHEN 'signup' THEN 'Friends of Democrat'
      WHEN 'error' THEN 'Town Committee' ELSE '' END END AS committee,
    event_id % 5 <> 0 AS confirmed, event_id AS ordinal, p.donor_key
  FROM events JOIN person p ON p.person_row = user_id),
hscore AS (
  SELECT household_row, max(tier_count) - min(tier_count) AS gap,
    (max(tier_count) - min(tier_count)) * count(*) FILTER (tier IN ('I0','F1','L1','F2','L2'))
      AS score_wake_ups,
    2 * count(*) FILTER (party = 'BLK') AS score_unaffiliated,
    count(*) FILTER (party = 'DEM' AND tier IN ('I0','F1','L1')) AS score_dropoff,
    count(*) AS people_count
  FROM person GROUP BY 1),
household AS (
  SELECT s.*, score_wake_ups + score_unaffiliated + score_dropoff AS score_total,
    s.household_row AS household_id, h.county, h.city, h.zip, h.assembly_district,
    h.senate_district, h.congressional_district,
    CAST(s.household_row % 400 + 1 AS VARCHAR) AS address_num,
    'STREET' || CAST(s.household_row % 40 AS VARCHAR) || ' AVENUE' AS street,
    CASE WHEN s.household_row % 29 <> 0 THEN 40.5 + ((s.household_row * 131) % 5000) / 10000.0 END
      ::DOUBLE AS lat,
    CASE WHEN s.household_row % 29 <> 0 THEN -73.9 + ((s.household_row * 257) % 9000) / 10000.0 END
      ::DOUBLE AS lon
  FROM hscore s JOIN person h ON h.household_row = s.household_row AND h.member = 0),
served AS (
  SELECT p.*, CASE WHEN k % 13 <> 0 THEN e.years END AS years,
    ((k * 37) % 1000) / 1000.0::DOUBLE AS turnout_prob,
    ((k * 53) % 1000) / 1000.0::DOUBLE AS dem_lean_prob,
    CASE WHEN k % 11 <> 0 THEN ((k * 71) % 1000) / 1000.0::DOUBLE END AS rep_lean_prob
  FROM person p LEFT JOIN (SELECT person_row, list(year ORDER BY year, etype || method) AS years
                           FROM ballot GROUP BY 1) e USING (person_row)),
summary AS (
  SELECT donor_key, sum(coalesce(amount, 0)) AS total_donated, count(*) AS donation_count
  FROM donation WHERE confirmed GROUP BY 1),
labelled AS (
  SELECT p.*, CASE WHEN age - 2 >= 18 THEN CASE WHEN v.person_row IS NULL THEN 0 ELSE 1 END
      ELSE -1 END AS y_turnout,
    CASE WHEN tier_count >= 3 THEN 1 ELSE 0 END AS y_turnout_tier,
    CASE WHEN party = 'BLK' THEN -1 WHEN party IN ('DEM','WOR') THEN 0
      WHEN party IN ('REP','CON') THEN 1 ELSE 2 END AS y_party
  FROM person p LEFT JOIN (SELECT DISTINCT person_row FROM ballot WHERE year = 2000 AND etype = 'G')
    v USING (person_row)),
pt AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS lon, CAST(embedding[2] AS DOUBLE) AS lat
       FROM embeddings)
"""
