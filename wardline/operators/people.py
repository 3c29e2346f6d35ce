"""Households to people to ballots, and checks on the load."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import ids, packed, text
from .groups import ordered_rank


def with_people(households: DataFrame, detail: str = "household_detail",
                with_history: bool = True) -> DataFrame:
    """Replace the packed text by a parsed ``people`` array."""
    return (households.withColumn("people", packed.parse_household(F.col(detail), with_history))
            .drop(detail))


def explode_people(parsed: DataFrame, household_key: str = "household_row") -> DataFrame:
    """One row per person with household columns repeated and derived columns added."""
    return (parsed.withColumn("household_size", F.size("people"))
            .select(*[c for c in parsed.columns if c != "people"], "household_size",
                    F.posexplode("people").alias("member", "p"))
            .select("*", "p.name", "p.age", "p.party", "p.tier", "p.history", "p.elections")
            .drop("p")
            .withColumn("tier_letter", text.tier_letter(F.col("tier")))
            .withColumn("tier_count", text.tier_count(F.col("tier"))))


def unparseable_households(parsed: DataFrame) -> DataFrame:
    """Households read, and those with no parseable person."""
    return parsed.agg(F.count(F.lit(1)).alias("households"),
                      F.count_if(F.size("people") == 0).alias("without_people"))


def number_people(people: DataFrame, household: str = "household_row", member: str = "member",
                  block: int = 10_000, name: str = "person_row") -> DataFrame:
    """0-based sequential person key in file order, counted in blocks of blocks."""
    h = F.col(household)
    blocked = people.withColumns({"__b1": F.floor(h / F.lit(block * block)),
                                  "__b2": F.floor(h / F.lit(block))})
    out = ordered_rank(blocked, [], ["__b1", "__b2"], [household, member], name)
    return out.withColumn(name, F.col(name) - 1).drop("__b1", "__b2")


def with_person_ids(people: DataFrame) -> DataFrame:
    key = ids.donor_key(F.col("name"), F.col("city"), F.col("zip_code"), upper_name=False)
    return (people.withColumn("donor_key", key)
            .withColumn("person_id", ids.person_id(
                F.col("donor_key"), F.col("county"), F.col("address_number"),
                F.col("street_name"))))


def explode_ballots(people: DataFrame, key: str = "person_row") -> DataFrame:
    """One row per ballot; years outside 1900-2100 are dropped."""
    return (people.select(key, F.explode("elections").alias("e"))
            .filter(F.col("e.year").between(1900, 2100))
            .select(key, F.col("e.year").alias("year"),
                    F.substring("e.code", 1, 1).alias("etype"),
                    F.substring("e.code", 2, 1).alias("method")))


def priority_people(people: DataFrame, include_rep: bool = False,
                    all_parties: bool = False) -> DataFrame:
    """Unaffiliated people and drop-off Democrats; others only when asked for."""
    if all_parties:
        return people
    wanted = (F.col("party") == C.UNAFFILIATED) | (
        (F.col("party") == "DEM") & F.col("tier").isin(C.DROPOFF_TIERS))
    if include_rep:
        wanted = wanted | (F.col("party") == "REP")
    return people.filter(wanted)


def first_per_key(people: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Keep the first row in file order of every key."""
    cols = [c for c in people.columns if c != key]
    return (people.groupBy(key)
            .agg(F.min_by(F.struct(*cols), F.col(ordinal)).alias("r")).select(key, "r.*"))


def drop_duplicate_people(people: DataFrame, created: str = "created_at",
                          tie: str = "id") -> DataFrame:
    """Earliest row per (household, name)."""
    cols = [c for c in people.columns if c not in ("household_id", "name")]
    return (people.groupBy("household_id", "name")
            .agg(F.min_by(F.struct(*cols), F.struct(created, tie)).alias("r"))
            .select("household_id", "name", "r.*"))


def people_count(people: DataFrame, household: str = "household_id") -> DataFrame:
    return people.groupBy(household).agg(F.count(F.lit(1)).alias("people_count"))


def served_households(parsed: DataFrame, counties: list[str]) -> DataFrame:
    """Normalised household rows with a deterministic id; other counties are skipped."""
    county = text.strip(F.upper("county"))
    zip5 = text.zip_padded(F.col("zip_code"))
    number = text.strip(F.col("address_number"))
    street = text.strip(F.upper("street_name"))
    return (parsed.filter(county.isin(counties) & (F.size("people") > 0))
            .withColumn("county", county).withColumn("address_num", number)
            .withColumn("street", street).withColumn("city", text.strip(F.upper("city")))
            .withColumn("zip", zip5)
            .withColumn("household_id", ids.household_uuid(county, number, street, zip5)))


def served_people(households: DataFrame) -> DataFrame:
    """Member rows of ``served_households`` with parties and tiers folded to the domain."""
    e = households.select("household_id", "city", "zip", F.posexplode("people").alias("member", "p"))
    return e.select(
        "household_id", "member", F.col("p.name").alias("name"), F.col("p.age").alias("age"),
        text.fold_party(F.col("p.party")).alias("party"),
        text.fold_tier_letter(text.tier_letter(F.col("p.tier"))).alias("tier_letter"),
        text.tier_count(F.col("p.tier")).alias("tier_count"),
        F.col("p.elections").alias("elections"), "city", "zip",
        ids.donor_key(F.col("p.name"), F.col("city"), F.col("zip")).alias("donor_key"))


def load_quality(people: DataFrame, ballots: DataFrame, expected: DataFrame) -> DataFrame:
    """One row of load checks.

    ``people`` needs person_id, party, y_turnout, y_turnout_tier, y_party;
    ``expected`` is a one-column, one-row frame with the stated person total.
    """
    elig = F.col("y_turnout") >= 0
    ids_seen = people.groupBy("person_id").agg(F.count(F.lit(1)).alias("n"))
    history = ballots.groupBy("person_row").agg(
        F.count(F.lit(1)).alias("n"), F.min("year").alias("lo"), F.max("year").alias("hi"))
    spans = history.agg(F.sum("n").alias("ballots"), F.count(F.lit(1)).alias("with_history"),
                        F.min("lo").alias("first_year"), F.max("hi").alias("last_year"))
    base = people.agg(
        F.count(F.lit(1)).alias("persons"),
        F.count_if(elig).alias("eligible"), F.count_if(~elig).alias("masked"),
        F.avg(F.when(elig, F.col("y_turnout").cast("double"))).alias("turnout_share"),
        F.avg(F.when(elig, (F.col("y_turnout") == F.col("y_turnout_tier")).cast("double")))
        .alias("tier_agreement"),
        *[F.avg((F.col("y_party") == k).cast("double")).alias(f"party_share_{n}")
          for k, n in ((0, "dem"), (1, "rep"), (2, "other"), (-1, "masked"))],
        *[F.count_if(F.col("party") == p).alias(f"n_{p.lower()}") for p in C.PARTIES])
    packed_spans = spans.select(F.struct("*"))
    h = packed_spans.scalar()
    return base.select(
        "*", ids_seen.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).scalar()
        .alias("duplicate_ids"),
        expected.scalar().alias("expected_persons"),
        *[h[c].alias(c) for c in ("ballots", "with_history", "first_year", "last_year")])
