import pytest

from wardline import schemas
from wardline.operators import geocode


def _seg(ordinal, name, lo, hi, zl, zr="", y=0.0, ro=None, rt=None):
    return ("N", name, lo, hi, ro, rt, zl, zr, "S1400", ordinal, [(0.0, y), (1.0, y)])


SEGMENTS = [
    _seg(0, "Main Street", "1", "99", "11111", y=0.0), _seg(1, "Main St", "1", "99", "22222", y=1.0),
    _seg(2, "Oak Ave", "99", "1", "", y=2.0), _seg(3, "Elm Rd", "10", "10", "33333", y=3.0),
    _seg(4, "Big Blvd", "1", "99999", "44444", y=4.0), _seg(5, "Mix Rd", "1", "9", "", y=5.0),
    _seg(6, "Mix Rd", "1", "9", "55555", y=6.0), _seg(7, "Old", "1", "9", "66666", y=7.0),
    _seg(8, "", "1", "9", "66666"), _seg(9, "Nope", None, "9", "66666"),
    _seg(10, "Oak Ave", "1", "99", "77777", y=8.0, ro="2", rt="98"),
]


@pytest.mark.parametrize("number,street,zip5,expected", [
    ("50", "main street", "22222", (0.5, 1.0)), ("50", "Main St", "", (0.5, 0.0)),
    ("500", "Main St", "11111", None), ("25B", "Oak Avenue", "88888", None),
    ("25", "Oak Avenue", "77777", (round(24 / 98, 5), 8.0)), ("10", "Elm Road", "33333", (0.5, 3.0)),
    ("50000", "Big Boulevard", "44444", (round(49999 / 99998, 5), 4.0)), ("5", "Mix Rd", "99999", None),
    ("5", "Old North Way", "66666", (0.5, 7.0)), ("500", "Old North Way", "66666", None),
    ("", "Old", "66666", None), ("B5", "Old", "66666", None), ("5", "Nope", "66666", None)])
def test_geocode_cases(spark, number, street, zip5, expected):
    seg = spark.createDataFrame(SEGMENTS, schemas.SEGMENT)
    a = spark.createDataFrame([("N", number, street, zip5)],
                              "county string, address_number string, street_name string, zip_code string")
    r = geocode.geocode(a, seg).first()
    assert (None if r["lon"] is None else (r["lon"], r["lat"])) == expected


def test_fallback_only_when_no_conflict(spark):
    seg = spark.createDataFrame([_seg(0, "Oak", "99", "1", "", y=2.0)], schemas.SEGMENT)
    a = spark.createDataFrame([("N", "25", "Oak", "88888")],
                              "county string, address_number string, street_name string, zip_code string")
    assert geocode.geocode(a, seg).first()["lon"] == round(74 / 98, 5)
