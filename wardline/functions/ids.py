"""Keys: donor key, person id, household UUID."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

_MASK63 = 0x7FFFFFFFFFFFFFFF


def donor_key(name: Column, city: Column, zip_code: Column, upper_name: bool = True) -> Column:
    """``NAME|CITY|ZIP``. The ingest form keeps the name's case, the served form does not."""
    n = F.upper(name) if upper_name else name
    return F.concat_ws("|", n, strip(F.upper(city)), strip(zip_code))


def donor_key_part(key: Column, i: int) -> Column:
    """0 name, 1 city, 2 zip; empty when the part is missing."""
    return F.coalesce(F.get(F.split(key, r"\|"), F.lit(i)), F.lit(""))


def person_id(key: Column, county: Column, number: Column, street: Column) -> Column:
    """Stable 63-bit id of a person at an address."""
    text = F.concat_ws("|", key, county, F.concat_ws(" ", number, street))
    return F.xxhash64(text).bitwiseAND(F.lit(_MASK63))


def household_uuid(county: Column, number: Column, street: Column, zip5: Column) -> Column:
    """MD5 of ``county|number|street|zip`` in UUID notation."""
    h = F.md5(F.concat_ws("|", county, number, street, zip5))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def draw(*parts: Column) -> Column:
    """A number below 2 ** DRAW_BITS from the MD5 of the parts' text, joined by colons. Any engine
    with MD5 draws the same, so samples and splits can be checked row by row."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, DRAW_BITS // 4), 16, 10).cast("bigint")


DRAW_BITS = 60
