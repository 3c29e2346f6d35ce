"""Text, number and address columns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

_WS = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_WS))


def clean_text(c: Column) -> Column:
    """Trim, drop one trailing ``.0``; null-like words become the empty string."""
    t = F.regexp_replace(strip(F.coalesce(c.cast("string"), F.lit(""))), r"\.0$", "")
    return F.when(F.lower(t).isin(C.NULL_TEXT), F.lit("")).otherwise(t)


def normalize_street(c: Column) -> Column:
    """Upper-case street with suffixes shortened on word boundaries."""
    s = strip(F.upper(F.coalesce(c, F.lit(""))))
    for long, short in C.STREET_SUFFIXES:
        s = F.regexp_replace(s, rf"\b{long}\b", short)
    return F.regexp_replace(s, r"\s+", " ")


def house_number(c: Column) -> Column:
    """Leading digits as a number, else null."""
    return F.regexp_extract(c.cast("string"), r"^(\d+)", 1).try_cast("bigint")


def tier_letter(tier: Column) -> Column:
    return F.substring(tier, 1, 1)


def tier_count(tier: Column) -> Column:
    """Digits after the tier letter; 0 when they are missing or not a number."""
    digits = F.regexp_extract(tier, r"^.([0-9]+)$", 1)
    return F.coalesce(digits.try_cast("int"), F.lit(0))


def name_tokens(name: Column) -> Column:
    """Sorted distinct A-Z runs of an upper-cased name."""
    return F.array_sort(F.array_distinct(
        F.regexp_extract_all(F.upper(name), F.lit("([A-Z]+)"), 1)))


def normalized_name(name: Column) -> Column:
    """Sorted A-Z runs (duplicates kept) joined by a pipe."""
    return F.array_join(F.array_sort(
        F.regexp_extract_all(F.upper(name), F.lit("([A-Z]+)"), 1)), "|")


def donor_last_name(name: Column) -> Column:
    """Text before the first comma."""
    return F.upper(strip(F.substring_index(name, ",", 1)))


def person_last_name(name: Column) -> Column:
    """Last word of the name. A suffix such as JR is taken as the last name."""
    return F.element_at(F.split(strip(F.upper(name)), r"\s+"), -1)


def compact_date_to_iso(c: Column) -> Column:
    """``MMDDYYYY`` to ``YYYY-MM-DD``; anything else to the empty string."""
    t = strip(F.coalesce(c, F.lit("")))
    return F.when(t.rlike(r"^\d{8}$"),
                  F.regexp_replace(t, r"^(\d{2})(\d{2})(\d{4})$", "$3-$1-$2")).otherwise("")


def zip_plain(c: Column) -> Column:
    """Text before the first dot, trimmed."""
    return F.substring_index(strip(c.cast("string")), ".", 1)


def zip_first5(c: Column) -> Column:
    return F.substring(strip(c.cast("string")), 1, 5)


def zero_pad(c: Column, width: int = 5) -> Column:
    """Left-pad with zeros; longer text is kept whole, unlike ``lpad``."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def zip_padded(c: Column) -> Column:
    return zero_pad(F.replace(strip(c.cast("string")), F.lit(".0"), F.lit("")))


def safe_int(c: Column) -> Column:
    return c.try_cast("double").try_cast("int")


def safe_double(c: Column) -> Column:
    return c.try_cast("double")


def safe_text(c: Column) -> Column:
    return F.nullif(strip(c.cast("string")), F.lit(""))


def fold_party(c: Column) -> Column:
    """Parties outside the served domain become OTH."""
    return F.when(c.isin(C.PARTIES), c).otherwise(F.lit("OTH"))


def fold_tier_letter(c: Column) -> Column:
    return F.when(c.isin(C.TIER_LETTERS), c).otherwise(F.lit("I"))


def tier_rank(letter: Column) -> Column:
    """X, F, L, everything else."""
    return (F.when(letter == "X", 0).when(letter == "F", 1)
            .when(letter == "L", 2).otherwise(3))


def split_street_address(address: Column) -> tuple[Column, Column]:
    """``36 Blanche St`` to (``36``, ``BLANCHE ST``); no number gives ``''``."""
    a = strip(F.coalesce(address, F.lit("")))
    pattern = r"^(\d+[A-Za-z]?)\s+(.+)$"
    hit = a.rlike(pattern)
    number = F.when(hit, F.regexp_extract(a, pattern, 1)).otherwise("")
    street = F.when(hit, strip(F.upper(F.regexp_extract(a, pattern, 2)))).otherwise(F.upper(a))
    return number, street


def title_case(c: Column) -> Column:
    """Upper-case every letter that follows a non-letter (``O'Brien``, not ``O'brien``)."""
    return F.array_join(F.transform(F.split(c, r"(?<=[^A-Za-z])"), F.initcap), "")


def split_given_family(name: Column) -> tuple[Column, Column]:
    """First word and the rest, title-cased."""
    parts = F.split(strip(name), " ", 2)
    return (title_case(F.get(parts, F.lit(0))),
            title_case(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))))


def _history_entries(history: Column) -> Column:
    entries = F.transform(F.split(F.coalesce(history, F.lit("")), ", "), strip)
    return F.filter(entries, lambda e: e != "")


def history_text(history: Column) -> Column:
    """Comma-separated entries re-joined with semicolons, text kept as is."""
    return F.array_join(_history_entries(history), "; ")


def history_count(history: Column) -> Column:
    return F.size(_history_entries(history))


def contains_any(c: Column, words: list[str]) -> Column:
    """Whether the upper-cased text holds any of the words."""
    upper = F.upper(F.coalesce(c, F.lit("")))
    hit = F.lit(False)
    for w in words:
        hit = hit | upper.contains(w)
    return hit


def postal_address(number: Column, street: Column) -> Column:
    """Number and street, or the street alone when the number is missing."""
    n = strip(F.coalesce(number.cast("string"), F.lit("")))
    s = strip(F.coalesce(street, F.lit("")))
    return F.when((n != "") & (n != "null"), strip(F.concat_ws(" ", n, s))).otherwise(s)
