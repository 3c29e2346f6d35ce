"""Labels, and shares over the other members of a household or district."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.rounding import safe_ratio


def party_label(party: Column) -> Column:
    """0 dem-lean, 1 rep-lean, 2 other or unknown, -1 unaffiliated (masked)."""
    return (F.when(party == C.UNAFFILIATED, C.MASKED)
            .when(party.isin(C.DEM_LEAN_PARTIES), 0)
            .when(party.isin(C.REP_LEAN_PARTIES), 1).otherwise(C.PARTY_OTHER_CLASS))


def party_label_simple(party: Column) -> Column:
    """Variant: IND, empty and missing parties are masked too."""
    return (F.when(party.isNull() | party.isin(C.UNAFFILIATED, "IND", ""), C.MASKED)
            .when(party.isin(C.DEM_LEAN_PARTIES), 0)
            .when(party.isin(C.REP_LEAN_PARTIES), 1).otherwise(C.PARTY_OTHER_CLASS))


def with_labels(people: DataFrame, ballots: DataFrame, target: int, ref_year: int,
                key: str = "person_row", simple: bool = False) -> DataFrame:
    """y_turnout (-1 under 18 at the election), y_turnout_tier and y_party."""
    voted = (ballots.filter((F.col("year") == target) & (F.col("etype") == "G"))
             .select(key).distinct().withColumn("__voted", F.lit(1)))
    age = F.coalesce("age", F.lit(0)) if simple else F.col("age")
    eligible = age - (ref_year - target) >= 18
    suffix = "_simple" if simple else ""
    label = party_label_simple if simple else party_label
    out = people.join(voted, key, "left").withColumn(
        f"y_turnout{suffix}",
        F.when(eligible, F.coalesce("__voted", F.lit(0))).otherwise(C.MASKED))
    out = out.withColumn(f"y_party{suffix}", label(F.col("party"))).drop("__voted")
    if not simple:
        out = out.withColumn("y_turnout_tier",
                             (F.col("tier_count") >= C.TURNOUT_TIER_THRESHOLD).cast("int"))
    return out


def shares_of_others(df: DataFrame, group: str, indicators: dict[str, Column],
                     floor_one: bool = False, size: str | None = None,
                     means: dict[str, Column] | None = None) -> DataFrame:
    """For each indicator, its share among the other rows of the group.

    Groups of one give 0. ``floor_one`` divides by max(n-1, 1) instead, which is
    the same value for them. ``means`` are plain group means, self included.
    """
    means = means or {}
    sums = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.sum(c.cast("bigint")).alias(f"__s_{n}") for n, c in indicators.items()],
        *[F.avg(c).alias(n) for n, c in means.items()])
    out = df.join(sums, group, "left")
    den = F.greatest(F.col("__n") - 1, F.lit(1)) if floor_one else F.col("__n") - 1
    for n, c in indicators.items():
        out = out.withColumn(n, safe_ratio(F.col(f"__s_{n}") - c.cast("bigint"), den, F.lit(0.0)))
    if size:
        out = out.withColumn(size, F.col("__n"))
    return out.drop("__n", *[f"__s_{n}" for n in indicators])


def _is(parties: list[str]) -> Column:
    return F.coalesce(F.col("party").isin(parties), F.lit(False))


def household_shares(people: DataFrame, household: str = "household_row") -> DataFrame:
    return shares_of_others(people, household, {
        "hh_dem_share_excl": _is(C.DEM_LEAN_PARTIES),
        "hh_rep_share_excl": _is(C.REP_LEAN_PARTIES),
        "hh_blk_share_excl": _is([C.UNAFFILIATED])}, size="household_size")


def district_shares(people: DataFrame, ed: str = "ed_key") -> DataFrame:
    """Needs y_party; adds size and mean tier count of the election district."""
    return shares_of_others(people, ed, {
        "ed_dem_share_excl": F.col("y_party") == 0,
        "ed_rep_share_excl": F.col("y_party") == 1,
        "ed_blk_share_excl": _is([C.UNAFFILIATED])},
        size="ed_n_voters", means={"ed_mean_tier_count": F.col("tier_count")})


def household_shares_simple(people: DataFrame, household: str = "household_id") -> DataFrame:
    return shares_of_others(people, household, {
        "hh_dem_share_excl_simple": _is(["DEM"]), "hh_rep_share_excl_simple": _is(["REP"]),
        "hh_blk_share_excl_simple": _is([C.UNAFFILIATED])}, floor_one=True)


def district_shares_simple(people: DataFrame, county: str = "county",
                           ed: str = "election_district") -> DataFrame:
    """The district key here is county and number only, without the assembly district."""
    keyed = people.withColumn("ed_key_simple", F.concat_ws(
        "_", F.coalesce(F.col(county), F.lit("")),
        F.coalesce(F.col(ed).cast("string"), F.lit(""))))
    return shares_of_others(keyed, "ed_key_simple", {
        "ed_dem_share_excl_simple": _is(["DEM"]), "ed_rep_share_excl_simple": _is(["REP"]),
        "ed_blk_share_excl_simple": _is([C.UNAFFILIATED])}, floor_one=True,
        size="ed_n_voters_simple")
