from pyspark.sql import functions as F

from wardline.operators import audience, context, districts, donations
import datetime as dt


def _contest(spark, rows):
    df = spark.createDataFrame([(c, p, v, i) for i, (c, p, v) in enumerate(rows)],
                               "candidate string, party string, votes string, ordinal long").withColumn("race", F.lit("x"))
    out = districts.contest_results(df, ["race"]).collect()
    return out[0].asDict() if out else None


def test_fusion_lines_are_added(spark):
    r = _contest(spark, [("Ann", "DEM", "10"), ("Bob", "REP", "12"), ("Ann", " wor ", "5"), ("Cy", "IND", "bad"), ("", "DEM", "99")])
    assert (r["dem_votes"], r["rep_votes"], r["other_votes"], r["winner"], r["dem_pct"]) == (15, 12, 0, "DEM", 55.6)


def test_tie_goes_to_the_best_line_of_the_first_seen(spark):
    r = _contest(spark, [("Bob", "REP", "4"), ("Bob", "CON", "6"), ("Ann", "DEM", "10")])
    assert r["winner"] == "CON" and r["margin_pct"] == 0.0


def test_uncontested_and_zero_votes(spark):
    r = _contest(spark, [("Bob", "REP", "7")])
    assert (r["winner"], r["dem_candidate"], r["dem_votes"]) == ("REP", "", 0)
    assert _contest(spark, [("Bob", "REP", "0")]) is None


def test_zip_score_golden_rules(spark):
    counts = spark.createDataFrame([("00501", 1), ("11701", 10), ("11702", 100)], "zip string, count long")
    got = {r["zip"]: r["score"] for r in districts.zip_scores(counts).collect()}
    assert got == {"00501": 0, "11701": 43, "11702": 100}
    flat = districts.zip_scores(counts.withColumn("count", F.lit(5).cast("bigint")))
    assert {r["score"] for r in flat.collect()} == {50}


def _people(spark):
    rows = [(1, 1, "K1", "A", 30, "DEM", "X", [(2020, "GE")], .5), (2, 1, "K1", "B", 40, "BLK", "F", None, None),
            (3, 2, "K2", "C", 50, "REP", "Q", [], .9)]
    return spark.createDataFrame(rows, "person_id long, household_id long, donor_key string, name string, age int, "
                                 "party string, tier_letter string, elections array<struct<year:int,code:string>>, "
                                 "turnout_prob double").withColumns(
        {"dem_lean_prob": F.lit(.5), "rep_lean_prob": F.lit(.5), "city": F.lit("x"), "zip": F.lit("1")})


def _households(spark):
    return spark.createDataFrame([(1, "Town", "11111", "NASSAU", 5, 2, 40.0, -73.0), (2, "City", "22222", "SUFFOLK", 9, 3, 41.0, -72.0)],
                                 "household_id long, city string, zip string, county string, score_total int, "
                                 "assembly_district int, lat double, lon double").withColumn("senate_district", F.lit(1))


def _ids(spark, spec, **kw):
    s = spark.createDataFrame([("K1", 10.0, 2)], "donor_key string, total_donated double, donation_count long")
    return [r["person_id"] for r in audience.select_audience(_people(spark), _households(spark), s, spec, **kw).collect()]


def test_audience_null_and_empty_rules(spark):
    assert _ids(spark, {"skipped_years": [2020]}) == [2, 3]
    assert _ids(spark, {"voted_in_years": [2020]}) == [1]
    assert _ids(spark, {"party": [], "cities": None}) == [1, 2, 3]
    assert _ids(spark, {"cities": ["town"]}) == [1, 2]
    assert _ids(spark, {"has_donated": True}) == [1, 2]
    assert _ids(spark, {"min_turnout_prob": 0.6}) == [3]
    assert _ids(spark, {}, sort_by="x; drop", limit=2) == [1, 2]


def test_viewport_empty_list_is_not_no_list(spark):
    h = _households(spark).withColumn("people_count", F.lit(None).cast("int"))
    assert audience.viewport(h, 39, 42, -74, -71).count() == 2
    assert audience.viewport(h, 39, 42, -74, -71, cities=[]).count() == 0
    assert audience.viewport(h, 39, 42, -74, -71, cities=["city"]).first()["people_count"] == 0


def test_labels(spark):
    p = spark.createDataFrame([(0, 19, "BLK", 3), (1, 20, "WOR", 2), (2, 30, "XYZ", 0), (3, None, None, 0)],
                              "person_row long, age int, party string, tier_count int")
    b = spark.createDataFrame([(0, 2024, "G"), (1, 2024, "G"), (2, 2024, "P")], "person_row long, year int, etype string")
    full = {r["person_row"]: (r["y_turnout"], r["y_party"]) for r in
            context.with_labels(p.filter("age is not null"), b, 2024, 2026).collect()}
    assert full == {0: (-1, -1), 1: (1, 0), 2: (0, 2)}
    simple = {r["person_row"]: (r["y_turnout_simple"], r["y_party_simple"]) for r in
              context.with_labels(p, b, 2024, 2026, simple=True).collect()}
    assert simple == {0: (-1, -1), 1: (1, 0), 2: (0, 2), 3: (-1, -1)}


def test_asof_rules_differ_on_dateless(spark):
    d = spark.createDataFrame([("K", "fec", "2024-11-04", 5.0, "A", True), ("K", "fec", "2024-11-05", 7.0, "A", True),
                               ("K", "fec", None, 1.0, "ActBlue", True), ("K", "fec", "soon", 1.0, "A", True),
                               ("K", "nyboe", "2024-1-5", None, "ACTBLUE", True)],
                              "donor_key string, source string, donation_date string, amount double, committee string, confirmed boolean")
    f = donations.donation_features(d, dt.date(2024, 11, 5)).first()
    assert (f["fec_n"], f["fec_total"], f["fec_recency_days"], f["nyboe_n"], f["nyboe_total"], f["n_committees"]) == (1, 5.0, 1, 1, 0.0, 2)
    r = {x["source"]: x for x in donations.as_of_report(d, dt.date(2024, 11, 5)).collect()}
    assert (r["fec"]["dropped_post_cutoff"], r["fec"]["dropped_dateless"]) == (1, 2)
    typed = d.withColumn("donation_date", F.expr("try_cast(donation_date as date)"))
    assert donations.as_of_donations_simple(typed, dt.date(2024, 11, 5)).count() == 4


def test_shared_key_multiplies_gifts(spark):
    d = spark.createDataFrame([("K1", 10.0, True), ("K1", None, True), ("K2", 4.0, True)], "donor_key string, amount double, confirmed boolean")
    r = {x["party"]: x for x in donations.party_giving(d, spark.createDataFrame(
        [("K1", "DEM"), ("K1", "DEM"), ("K2", "REP")], "donor_key string, party string")).collect()}
    assert (r["DEM"]["total"], r["DEM"]["avg"], r["DEM"]["donors"]) == (20.0, 10.0, 1)
    assert r["REP"]["share_of_largest"] == 0.2


def test_palindromic_name_counts_twice_without_dedupe(spark):
    p = spark.createDataFrame([(1, "Lee", "Lee", "X", "1.0")], "person_row long, first_name string, last_name string, city string, zip string")
    d = spark.createDataFrame([("LEE LEE|X|1", "fec", "2020-01-01", 5.0, "C", True, 0)],
                              "donor_key string, source string, donation_date string, amount double, committee string, confirmed boolean, ordinal long")
    assert donations.lookup_by_both_names(p, d).count() == 1
    assert donations.lookup_by_both_names(p, d, dedupe=False).count() == 2
