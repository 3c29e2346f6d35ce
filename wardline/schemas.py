"""Explicit schemas of the inputs and stored tables."""
from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, B = (T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType())


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


POINT = struct(x=D, y=D)
POLYLINE = T.ArrayType(POINT)
RINGS = T.ArrayType(POLYLINE)
ELECTION = struct(year=I, code=S)
PERSON_PARSED = struct(name=S, age=I, party=S, tier=S, history=S, elections=T.ArrayType(ELECTION))
RECORD = struct(date=S, amount=D, committee=S)

HOUSEHOLD_FILE = struct(
    county=S, town=S, city=S, zip_code=S, address_number=S, street_name=S,
    election_district=I, legislative_district=I, congressional_district=I, senate_district=I,
    assembly_district=I, voters_at_address=I, max_vote_count=I, min_vote_count=I,
    engagement_gap=I, oldest_age=I, youngest_age=I, num_reliable=I, num_low_engagement=I,
    household_detail=S)
BALLOT = struct(person_row=L, year=I, etype=S, method=S)
DONATION = T.StructType([
    T.StructField("donor_key", S, False), T.StructField("source", S, False),
    T.StructField("donation_date", T.DateType()), T.StructField("amount", T.DecimalType(10, 2)),
    T.StructField("committee", S), T.StructField("confirmed", B, False)])
CACHE_ENTRY = struct(confirmed=T.ArrayType(RECORD), possible=T.ArrayType(RECORD), checked_at=S,
                     source=S, timeout=B)
DONOR_COMMITTEE = struct(person_row=L, committee=S, source=S, amount=D)
HOUSEHOLD_TABLE = struct(
    household_id=S, county=S, address_num=S, street=S, city=S, zip=S, town=S,
    election_district=I, assembly_district=I, senate_district=I, congressional_district=I,
    lon=D, lat=D, score_total=I, score_wake_ups=I, score_unaffiliated=I, score_dropoff=I, ev_score=I)
PEOPLE_TABLE = struct(
    household_id=S, name=S, age=I, party=S, tier_letter=S, tier_count=I,
    elections=T.ArrayType(ELECTION), city=S, zip=S, turnout_prob=D, dem_lean_prob=D,
    rep_lean_prob=D, donor_key=S)
SEGMENT = struct(county=S, fullname=S, lfrom=S, lto=S, rfrom=S, rto=S, zipl=S, zipr=S,
                 road_class=S, ordinal=L, pts=POLYLINE)
POLYGON = struct(geoid=S, county_code=S, aland=L, rings=RINGS)
PRECINCT_FILE = struct(office=S, district=S, candidate=S, party=S, votes=S)
REGISTRATION = struct(zip=S, county=S)
ZIP_SCORE = struct(zip=S, score=I, count=L)
EDGE = struct(u=L, v=L, etype=S)
SCORE = struct(person_id=L, turnout_propensity=D, p_dem_lean=D, p_rep_lean=D, p_other=D,
               registered_party=S, split=S)
CONTEST = struct(dem_votes=L, rep_votes=L, other_votes=L, total_votes=L, dem_candidate=S,
                 rep_candidate=S, dem_pct=D, margin_pct=D, winner=S)
RESULTS_JSON = T.MapType(S, T.MapType(S, T.MapType(S, CONTEST)))
STATE_CONTRIBUTION = struct(
    filing_sched_abbrev=S, flng_ent_last_name=S, flng_ent_first_name=S, flng_ent_city=S,
    flng_ent_zip=S, sched_date=S, org_amt=S, cand_comm_name=S)
