import random

import pytest
from pyspark.sql import functions as F

from wardline.functions import packed, text
from wardline.functions.geometry import interpolate_along, strictly_inside
from wardline.functions.rounding import round_half_even


def test_round_half_even_agrees_with_python(spark):
    rnd = random.Random(7)
    values = [0.15, 0.25, 0.35, 2.675, 1.005, -0.15, -2.5, 12.25, 12.75, 0.05, 1e-9, 33.35, 66.65]
    values += [rnd.randrange(0, 20001) / 200 for _ in range(400)]
    values += [rnd.uniform(-1000, 1000) for _ in range(400)]
    values += [a / b * 100 for a in range(1, 60) for b in (80, 160, 400, 2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 5):
        got = [r[0] for r in df.select(round_half_even(F.col("v"), digits)).collect()]
        assert got == [float(round(v, digits)) for v in values]


CASES = [
    ("ANN (LEE) ROE (41, DEM, X4): 2024 GENERAL: Early Voting, 2022 PRIMARY: Absentee",
     [("ANN (LEE) ROE", 41, "DEM", "X4", [(2024, "GV"), (2022, "PA")])]),
    ("BO DOE (20, BLK, I)", [("BO DOE", 20, "BLK", "I", [])]),
    ("A B (30, REP, F1): 2021 RUNOFF: Pigeon, XX GENERAL: Mail, 2020 GENERAL, 1999 GENERAL: Federal",
     [("A B", 30, "REP", "F1", [(2021, "GO"), (1999, "GF")])]),
    ("nobody | also nobody", []),
    ("", []), (None, []),
    ("A B (30, REP, F1) |  C D (31, WOR, L2): 2000 GENERAL: Election Day / Poll Site ",
     [("A B", 30, "REP", "F1", []), ("C D", 31, "WOR", "L2", [(2000, "GE")])]),
]


@pytest.mark.parametrize("detail,expected", CASES)
def test_parse_household(spark, detail, expected):
    df = spark.createDataFrame([(detail,)], "d string")
    people = df.select(packed.parse_household(F.col("d")).alias("p")).first()["p"]
    got = [(p["name"], p["age"], p["party"], p["tier"], [(e["year"], e["code"]) for e in p["elections"]])
           for p in people]
    assert got == expected


def test_plain_form_does_not_match_history(spark):
    df = spark.createDataFrame([("A B (30, REP, F1): 2020 GENERAL: Mail | C D (31, WOR, L2)",)], "d string")
    p = df.select(packed.parse_household(F.col("d"), with_history=False).alias("p")).first()["p"]
    assert [x["name"] for x in p] == ["C D"]


def test_tier_split(spark):
    df = spark.createDataFrame([("X4",), ("I",), ("FX",), ("L12",)], "t string")
    got = df.select(text.tier_letter(F.col("t")), text.tier_count(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("X", 4), ("I", 0), ("F", 0), ("L", 12)]


def test_street_suffixes_on_word_boundaries(spark):
    df = spark.createDataFrame([(" Streeter  avenue",), ("Court Street",), (None,)], "s string")
    got = [r[0] for r in df.select(text.normalize_street(F.col("s"))).collect()]
    assert got == ["STREETER AVE", "CT ST", ""]


def test_title_case(spark):
    got = spark.range(1).select(text.title_case(F.lit("O'BRIEN-smith jr"))).first()[0]
    assert got == "O'BRIEN-smith jr".title()


def _points(pairs):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pairs])


@pytest.mark.parametrize("pairs,frac,expected", [
    ([(0, 0), (10, 0), (10, 10)], 0.25, (5, 0)), ([(0, 0), (10, 0), (10, 10)], 0.75, (10, 5)),
    ([(0, 0), (10, 0)], 1.7, (10, 0)), ([(0, 0), (10, 0)], -1, (0, 0)), ([(3, 4), (3, 4)], 0.5, (3, 4)),
    ([(0, 0), (0, 0), (4, 0)], 0.5, (2, 0)), ([(1, 2)], 0.5, (1, 2))])
def test_interpolate(spark, pairs, frac, expected):
    p = spark.range(1).select(interpolate_along(_points(pairs), F.lit(float(frac))).alias("p")).first()["p"]
    assert (p["x"], p["y"]) == expected


@pytest.mark.parametrize("x,y,inside", [(5, 5, True), (0, 5, False), (10, 10, False), (5, 0, False),
                                        (11, 5, False), (4.5, 4.5, True), (3, 3, False), (2.5, 2.5, False),
                                        (2, 2.5, False)])
def test_inside_is_strict_and_knows_holes(spark, x, y, inside):
    ring = _points([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)])
    hole = _points([(2, 2), (3, 2), (3, 3), (2, 3), (2, 2)])
    got = spark.range(1).select(strictly_inside(F.lit(float(x)), F.lit(float(y)), F.array(ring, hole))).first()[0]
    assert got is inside
