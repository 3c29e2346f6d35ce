"""Point scores built from columns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .rounding import safe_ratio


def _flag(c: Column, points: int) -> Column:
    return F.when(c, F.lit(points)).otherwise(F.lit(0))


def _log_points(amount: Column, per_decade: float, cap: int) -> Column:
    pts = F.floor(F.log10(F.greatest(amount, F.lit(0.0)) + 1) * F.lit(per_decade))
    return F.when(amount > 0, F.least(F.lit(cap), pts.cast("int"))).otherwise(F.lit(0))


def prospect_score(has_donation: Column, partisan: Column, total: Column, n: Column,
                   recent: Column, tier_count: Column) -> Column:
    """0-100 score of the unaffiliated list."""
    donor = (F.lit(40) + _flag(partisan, 15) + _log_points(total, 6.0, 15)
             + F.least(F.lit(10), n * 2) + _flag(recent, 10))
    base = F.when(has_donation, donor).otherwise(F.lit(0))
    return F.least(F.lit(100), base + _flag(tier_count >= 3, 5) + _flag(tier_count >= 5, 5))


def contact_score(has_donation: Column, total: Column, n: Column, recent: Column,
                  has_contact: Column, party: Column) -> Column:
    """0-100 score of the contact list."""
    donor = (F.lit(40) + _log_points(total, 7.0, 20) + F.least(F.lit(10), n * 2)
             + _flag(recent, 10))
    base = F.when(has_donation, donor).otherwise(F.lit(0))
    return F.least(F.lit(100), base + _flag(has_contact, 10) + _flag(F.upper(party) == "D", 5))


def donor_likelihood(hits: Column, total: Column, tier: Column, age: Column) -> Column:
    """Chance-ordered priority: ZIP hit rate x100 plus tier and age bonus."""
    h, n = F.coalesce(hits, F.lit(0)), F.coalesce(total, F.lit(0))
    rate = (F.when(n >= 10, safe_ratio(h, n))
            .when(n > 0, (h + 2).cast("double") / (n + 10).cast("double"))
            .otherwise(F.lit(0.05)))
    tier_pts = F.when(tier.startswith("X"), 4).when(tier.startswith("F"), 1).otherwise(0)
    age_pts = F.when(age >= 65, 3).when(age >= 50, 2).when(age >= 40, 1).otherwise(0)
    return rate * 100 + tier_pts + age_pts


def dominant_component(wake: Column, unaffiliated: Column, dropoff: Column) -> Column:
    return (F.when((wake >= unaffiliated) & (wake >= dropoff), "lev")
            .when(unaffiliated >= dropoff, "so").otherwise("re"))


def score_band(score: Column) -> Column:
    return (F.when(score.between(80, 100), "80-100").when(score.between(60, 79), "60-79")
            .when(score.between(40, 59), "40-59").when(score.between(20, 39), "20-39")
            .when(score.between(0, 19), "0-19"))


def unit_clamp(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def is_partisan_committee(committee: Column) -> Column:
    upper = F.upper(F.coalesce(committee, F.lit("")))
    hit = F.lit(False)
    for word in C.PARTISAN_KEYWORDS:
        hit = hit | upper.contains(word)
    return hit
