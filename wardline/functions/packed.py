"""Packed person strings and election lists."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .text import strip

# --- fixed patterns of the packed text ---------------------------------------
PERSON_PATTERN = r"^(.*) \((\d+), ([A-Z]+), ([A-Z0-9]+)\)(?:: (.*))?$"
PERSON_PATTERN_PLAIN = r"^(.*) \((\d+), ([A-Z]+), ([A-Z0-9]+)\)$"
BALLOT_PATTERN = r"^(\d+) (.*\S.*): (.*)$"

_SEP = "\u0001"


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _fields(text: Column, pattern: str, n: int) -> Column:
    """All capture groups with one regex pass; text that does not match stays one field."""
    template = _SEP.join(f"${i}" for i in range(1, n + 1))
    return F.split(F.regexp_replace(text, pattern, template), _SEP)


def parse_history(history: Column) -> Column:
    """``2024 GENERAL: Early Voting, ...`` to array<struct<year, code>>.

    Entries without a numeric year, a type and a method are skipped. Unknown
    types count as general elections, unknown methods as other.
    """
    segments = F.transform(F.split(history, ", "),
                           lambda s: _fields(strip(s), BALLOT_PATTERN, 3))
    kept = F.filter(segments, lambda f: F.size(f) == 3)
    types, methods = _literal_map(C.BALLOT_TYPES), _literal_map(C.BALLOT_METHODS)
    return F.transform(kept, lambda f: F.struct(
        F.get(f, F.lit(0)).try_cast("int").alias("year"),
        F.concat(F.coalesce(F.try_element_at(types, strip(F.get(f, F.lit(1)))), F.lit("G")),
                 F.coalesce(F.try_element_at(methods, strip(F.get(f, F.lit(2)))), F.lit("O")))
        .alias("code")))


def parse_household(detail: Column, with_history: bool = True) -> Column:
    """Packed text to array<struct<name, age, party, tier, history, elections>>.

    ``with_history=False`` takes the older form only: entries that carry a
    history tail do not match it.
    """
    pattern, n = (PERSON_PATTERN, 5) if with_history else (PERSON_PATTERN_PLAIN, 4)
    entries = F.transform(F.split(F.coalesce(detail, F.lit("")), r" \| "),
                          lambda e: _fields(strip(e), pattern, n))
    people = F.filter(entries, lambda f: F.size(f) == n)

    def person(f: Column) -> Column:
        history = F.get(f, F.lit(4)) if with_history else F.lit("")
        return F.struct(
            F.get(f, F.lit(0)).alias("name"),
            F.get(f, F.lit(1)).try_cast("int").alias("age"),
            F.get(f, F.lit(2)).alias("party"),
            F.get(f, F.lit(3)).alias("tier"),
            history.alias("history"),
            parse_history(history).alias("elections"),
        )

    return F.transform(people, person)


def elections_from_json(c: Column) -> Column:
    """``[[year, code], ...]`` to array<struct<year, code>>; bad items are skipped."""
    items = F.from_json(c, "array<array<string>>")
    ok = F.filter(F.coalesce(items, F.array().cast("array<array<string>>")),
                  lambda i: (F.size(i) == 2) & (F.length(F.get(i, F.lit(1))) >= 1)
                  & F.get(i, F.lit(0)).try_cast("int").isNotNull())
    return F.transform(ok, lambda i: F.struct(
        F.get(i, F.lit(0)).try_cast("int").alias("year"),
        F.upper(F.get(i, F.lit(1))).alias("code")))
