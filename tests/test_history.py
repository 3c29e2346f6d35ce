import datetime as dt

import pytest
from pyspark.sql import functions as F

from wardline.functions import dates
from wardline.operators import history, history_simple

E = 2024


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(0, 64, 0, "A"), (1, 20, 0, "A"), (2, 40, 1, "A"), (3, 50, 1, "A")],
                                 "person_row long, age int, household_row long, ed_key string")


@pytest.fixture(scope="module")
def ballots(spark):
    rows = [(0, y, "G", "E") for y in range(2016, 2024)]
    rows += [(0, 2024, "P", "E"), (0, 2024, "G", "V"), (0, 2025, "G", "E"), (1, 2024, "G", "E"),
             (2, 2018, "G", "A"), (2, 2020, "G", "M"), (2, 2022, "P", "E")]
    return spark.createDataFrame(rows, "person_row long, year int, etype string, method string")


@pytest.fixture(scope="module")
def feats(people, ballots):
    f = history.history_features(people, ballots, E, 2026)
    return {r["person_row"]: r.asDict() for r in f.collect()}


EXPECTED = {
    0: {"hist_n_generals": 8, "hist_n_primaries": 1, "hist_general_rate_5": 1.0,
        "hist_general_rate_8": 1.0, "hist_general_rate_12": 8 / 12, "hist_pres_rate": 1.0,
        "hist_midterm_rate": 1.0, "hist_oddyear_rate": 1.0, "hist_years_since_last_vote": 0,
        "hist_years_since_last_general": 1, "hist_years_since_first_seen": 8,
        "hist_streak_current": 8, "hist_streak_longest": 8, "hist_trend_3v5": 0.0,
        "hist_voted_primary_cycle": 1, "hist_share_pollsite": 1.0, "hist_share_early": 0.0,
        "y_voted_general_2024": 1, "hist_age_at_target": 62,
        "hist_hh_general_rate_8_excl": 0.0, "hist_ed_general_rate_8_excl": 0.25 / 3},
    1: {"hist_eligible_generals_8": 0, "hist_general_rate_8": 0.0, "hist_never_voted": 1,
        "hist_years_since_last_vote": 99, "y_voted_general_2024": 1,
        "hist_hh_general_rate_8_excl": 1.0},
    2: {"hist_n_generals": 2, "hist_general_rate_5": 0.2, "hist_general_rate_8": 0.25,
        "hist_years_since_last_vote": 2, "hist_years_since_last_general": 4, "hist_voted_g4": 1,
        "hist_voted_g1": 0, "hist_streak_current": 0, "hist_streak_longest": 1,
        "hist_trend_3v5": -0.4, "hist_pres_rate": 0.5, "hist_share_absentee": 2 / 3,
        "y_voted_general_2024": 0},
    3: {"hist_never_voted": 1, "hist_years_since_first_seen": 99, "hist_n_votes": 0,
        "y_voted_general_2024": 0, "hist_hh_general_rate_8_excl": 0.25,
        "hist_ed_general_rate_8_excl": 1.25 / 3},
}


@pytest.mark.parametrize("person", EXPECTED)
def test_hand_computed_features(feats, person):
    for name, value in EXPECTED[person].items():
        assert feats[person][name] == pytest.approx(value, abs=1e-5), name


@pytest.mark.parametrize("year,day", [(2020, dt.date(2020, 11, 3)), (2022, dt.date(2022, 11, 8)),
                                      (2024, dt.date(2024, 11, 5)), (2026, dt.date(2026, 11, 3))])
def test_election_day(spark, year, day):
    assert dates.election_day(year) == day
    got = spark.range(1).select(dates.election_day_column(F.lit(year)).alias("d")).first()["d"]
    assert got == day


def test_old_years_beyond_one_mask_word(spark):
    people = spark.createDataFrame([(0, 110, 0, "A")], "person_row long, age int, household_row long, ed_key string")
    years = list(range(1935, 2024))
    b = spark.createDataFrame([(0, y, "G", "E") for y in years] + [(0, 1920, "P", "E")],
                              "person_row long, year int, etype string, method string")
    r = history.history_features(people, b, E, 2026).first()
    assert r["hist_n_generals"] == len(years)
    assert r["hist_streak_current"] == r["hist_streak_longest"] == len(years)
    assert r["hist_years_since_first_seen"] == E - 1920


def test_duplicate_ballots_count_once_in_rates_and_twice_in_shares(spark, people):
    b = spark.createDataFrame([(2, 2020, "G", "A"), (2, 2020, "G", "V"), (2, 2022, "G", "E")],
                              "person_row long, year int, etype string, method string")
    r = history.history_features(people, b, E, 2026).filter("person_row = 2").first()
    assert r["hist_n_generals"] == 2
    assert r["hist_share_absentee"] == pytest.approx(1 / 3)


def test_simple_variant_without_earlier_years(spark, people):
    b = spark.createDataFrame([(1, 2024, "G", "E")], "person_row long, year int, etype string, method string")
    r = history_simple.history_features_simple(people, b, E, 2026).filter("person_row = 1").first()
    assert r["hist_never_voted_simple"] == 1
    assert r["hist_eligible_8_simple"] == 8     # 2008..2022, even years
    assert r["hist_general_rate_8_simple"] == 0.0
