"""Household scores, stats and member lists."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text
from .groups import first_n


def canvass_score(people: Column) -> Column:
    """Score of one parsed household, without exploding it.

    struct<wake_ups, unaffiliated, dropoff, total>: vote gap x low-tier members,
    2 x unaffiliated members, drop-off Democrats.
    """
    votes = F.transform(people, lambda p: text.tier_count(p["tier"]))
    gap = F.coalesce(F.array_max(votes) - F.array_min(votes), F.lit(0))
    low = F.size(F.filter(people, lambda p: p["tier"].isin(C.LOW_TIERS)))
    unaffiliated = F.size(F.filter(people, lambda p: p["party"] == C.UNAFFILIATED)) * 2
    drop = F.size(F.filter(people, lambda p: (p["party"] == "DEM")
                           & p["tier"].isin(C.DROPOFF_TIERS)))
    return F.struct((gap * low).alias("wake_ups"), unaffiliated.alias("unaffiliated"),
                    drop.alias("dropoff"), (gap * low + unaffiliated + drop).alias("total"))


def score_people(people: DataFrame, key: str = "household_row") -> DataFrame:
    """The same score from person rows (one aggregate, combined before the shuffle)."""
    tier = F.concat(F.col("tier_letter"), F.col("tier_count").cast("string"))
    parts = people.groupBy(key).agg(
        (F.max("tier_count") - F.min("tier_count")).alias("gap"),
        F.count_if(tier.isin(C.LOW_TIERS)).alias("low"),
        (F.count_if(F.col("party") == C.UNAFFILIATED) * 2).alias("score_unaffiliated"),
        F.count_if((F.col("party") == "DEM") & tier.isin(C.DROPOFF_TIERS)).alias("score_dropoff"))
    wake = F.col("gap") * F.col("low")
    return parts.select(key, wake.alias("score_wake_ups"), "score_unaffiliated", "score_dropoff",
                        (wake + F.col("score_unaffiliated") + F.col("score_dropoff"))
                        .alias("score_total"))


def household_stats(people: DataFrame, key: str = "household_row") -> DataFrame:
    """Gap, reliable, low, oldest, youngest, count and dominant tier per household."""
    tier = F.concat(F.col("tier_letter"), F.col("tier_count").cast("string"))
    age = F.when(F.col("age") > 0, F.col("age"))
    known = F.col("tier_letter").isin(C.TIER_LETTERS)
    stats = people.groupBy(key).agg(
        (F.max("tier_count") - F.least(F.min("tier_count"), F.lit(99))).alias("gap"),
        F.count_if((F.col("tier_letter") == "X") & (F.col("tier_count") >= 4)).alias("reliable"),
        F.count_if(tier.isin(C.LOW_TIERS)).alias("low"),
        F.coalesce(F.max(age), F.lit(-1)).alias("oldest"),
        F.coalesce(F.min(age), F.lit(999)).alias("youngest"),
        F.count(F.lit(1)).alias("members"),
        F.min(F.when(known, text.tier_rank(F.col("tier_letter")))).alias("__rank"))
    letters = F.array(*[F.lit(x) for x in C.TIER_LETTERS])
    return (stats.withColumn("dominant_tier",
                             F.coalesce(F.get(letters, F.col("__rank")), F.lit("I")))
            .drop("__rank"))


def top_members(people: DataFrame, key: str = "household_id", n: int = 30,
                tie: str = "name") -> DataFrame:
    """First n members per household by tier, then count."""
    order = [text.tier_rank(F.col("tier_letter")), F.col("tier_count").desc(), F.col(tie)]
    return first_n(people, [key], order, n, "member_rank")


def household_detail(households: DataFrame, people: DataFrame, zip_scores: DataFrame,
                     household_id, n: int = 30) -> DataFrame:
    """One household with its ranked members and its ZIP score (0 when unknown)."""
    h = with_zip_score(households.filter(F.col("household_id") == F.lit(household_id)), zip_scores)
    m = top_members(people.filter(F.col("household_id") == F.lit(household_id)), n=n)
    return h.join(m.drop("city", "zip"), "household_id", "left")


def with_zip_score(households: DataFrame, zip_scores: DataFrame) -> DataFrame:
    z = zip_scores.select("zip", F.col("score").alias("ev_score"), F.col("count").alias("ev_count"))
    return (households.join(z, "zip", "left")
            .withColumn("ev_score", F.coalesce("ev_score", F.lit(0)))
            .withColumn("ev_count", F.coalesce("ev_count", F.lit(0))))


def filter_menus(households: DataFrame) -> DataFrame:
    """Sorted distinct districts and cities that hold a scored household."""
    scored = households.filter(F.col("score_total") > 0)
    ads = scored.filter(F.col("assembly_district").isNotNull()).select(
        F.lit("assembly_district").alias("menu"),
        F.col("assembly_district").cast("string").alias("value"),
        F.col("assembly_district").cast("bigint").alias("sort_number")).distinct()
    cities = scored.filter(F.col("city").isNotNull()).select(
        F.lit("city").alias("menu"), F.col("city").alias("value"),
        F.lit(None).cast("bigint").alias("sort_number")).distinct()
    return ads.unionByName(cities).orderBy("menu", "sort_number", "value")
