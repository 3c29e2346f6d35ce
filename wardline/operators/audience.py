"""Audience selection, map viewport and household search."""
from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .groups import first_n
from .households import with_zip_score

SORTABLE = ("score_total", "total_donated", "age", "turnout_prob", "dem_lean_prob",
            "rep_lean_prob")


def _voted_in(year: int) -> Column:
    """Whether any election is in the year; a null list is a plain no."""
    return F.coalesce(F.exists("elections", lambda e: e["year"] == year), F.lit(False))


def audience_predicates(spec: dict) -> list[Column]:
    """Column predicates of an 18-field filter spec; empty and missing fields do not filter."""
    p: list[Column] = []

    def members(field: str, column: Column, upper: bool = False) -> None:
        values = spec.get(field)
        if values:
            p.append(column.isin([v.upper() if upper else v for v in values]))

    def bound(field: str, make) -> None:
        if spec.get(field) is not None:
            p.append(make(spec[field]))

    members("party", F.col("party"))
    bound("age_min", lambda v: F.col("age") >= v)
    bound("age_max", lambda v: F.col("age") <= v)
    members("cities", F.upper("city"), upper=True)
    if spec.get("county"):
        p.append(F.col("county") == spec["county"].upper())
    bound("assembly_district", lambda v: F.col("assembly_district") == v)
    bound("senate_district", lambda v: F.col("senate_district") == v)
    members("tier_letters", F.col("tier_letter"))
    for model in ("turnout", "dem_lean", "rep_lean"):
        bound(f"min_{model}_prob", lambda v, m=model: F.col(f"{m}_prob") >= v)
        bound(f"max_{model}_prob", lambda v, m=model: F.col(f"{m}_prob") <= v)
    if spec.get("has_donated"):
        p.append(F.col("donation_count") > 0)
    bound("min_total_donated", lambda v: F.col("total_donated") >= v)
    p += [_voted_in(y) for y in spec.get("voted_in_years") or []]
    p += [~_voted_in(y) for y in spec.get("skipped_years") or []]
    return p


def select_audience(people: DataFrame, households: DataFrame, summaries: DataFrame, spec: dict,
                    sort_by: str = "score_total", descending: bool = True,
                    limit: int = 500) -> DataFrame:
    """People with household and donor columns that meet the spec, tier first.

    An unknown sort column falls back to the household score. Ties are broken by id.
    """
    own = [c for c in households.columns if c not in people.columns or c == "household_id"]
    joined = (people.drop("city", "zip").join(
        households.select(*own, *[c for c in ("city", "zip") if c not in own]), "household_id")
        .join(summaries, "donor_key", "left")
        .withColumn("total_donated", F.coalesce("total_donated", F.lit(0.0)))
        .withColumn("donation_count", F.coalesce("donation_count", F.lit(0))))
    hits = joined.filter(reduce(lambda a, b: a & b, audience_predicates(spec), F.lit(True)))
    col = F.col(sort_by if sort_by in SORTABLE else "score_total")
    order = col.desc_nulls_last() if descending else col.asc_nulls_last()
    return hits.orderBy(text.tier_rank(F.col("tier_letter")), order, "person_id").limit(limit)


def viewport(households: DataFrame, south: float, north: float, west: float, east: float,
             districts: list[int] | None = None, cities: list[str] | None = None,
             everything: bool = False) -> DataFrame:
    """Best-scored households in a box. An empty list selects nothing; None does not filter."""
    hit = F.col("lat").between(south, north) & F.col("lon").between(west, east)
    if districts is not None:
        hit = hit & (F.col("assembly_district").isin(districts) if districts else F.lit(False))
    if cities is not None:
        names = [c.upper() for c in cities if c]
        hit = hit & (F.upper("city").isin(names) if names else F.lit(False))
    return (households.filter(hit).withColumn("people_count", F.coalesce("people_count", F.lit(0)))
            .orderBy(F.desc("score_total"), "household_id").limit(5000 if everything else 2000))


def visible_top(households: DataFrame, south: float, north: float, west: float, east: float,
                cutoff: int, blk_only: bool = False, show_single: bool = True,
                show_complex: bool = True, n: int = 10) -> DataFrame:
    geo = (F.coalesce("lat", F.lit(0.0)) != 0) & (F.coalesce("lon", F.lit(0.0)) != 0)
    shown = F.when(F.col("people_count") >= cutoff, F.lit(show_complex)).otherwise(show_single)
    hit = (geo & (F.col("score_total") != 0) & F.col("lat").between(south, north)
           & F.col("lon").between(west, east) & shown)
    if blk_only:
        hit = hit & (F.col("score_unaffiliated") != 0)
    return households.filter(hit).orderBy(F.desc("score_total"), "household_id").limit(n)


def _top(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.desc("score_total"), "household_id").limit(n)


def search_addresses(households: DataFrame, query: str) -> DataFrame:
    """Ids and scores of address hits: number plus text, or text in street or city."""
    q = query.strip().upper()
    h = households.select("household_id", "score_total", "address_num", "street", "city")

    def has(column: str, needle: str) -> Column:
        return F.upper(column).contains(needle)

    m = re.match(r"^(\d+[A-Z]?)\s+(.+)$", q)
    if m:
        number, rest = m.groups()
        return _top(h.filter((F.col("address_num") == number)
                             & (has("street", rest) | has("city", rest)))
                    .select("household_id", "score_total"), 60)
    ids = ["household_id", "score_total"]
    both = _top(h.filter(has("street", q)).select(*ids), 50).union(
        _top(h.filter(has("city", q)).select(*ids), 50)).distinct()
    return _top(both, 50)


def search_names(people: DataFrame, households: DataFrame, query: str) -> DataFrame:
    q = query.strip().upper()
    hit = people.filter(F.upper("name").contains(q)).select("household_id").distinct()
    return _top(hit.join(households.select("household_id", "score_total"), "household_id"), 100)


def search(households: DataFrame, people: DataFrame, zip_scores: DataFrame, query: str,
           n: int = 60, members: int = 30) -> DataFrame:
    """Address and name hits merged, the first n by score, with their members.

    ``matched_idx`` is the 0-based rank of the first member whose name holds the
    query, or -1.
    """
    q = query.strip().upper()
    merged = search_addresses(households, query).union(search_names(people, households, query))
    best = _top(merged.groupBy("household_id").agg(F.max("score_total").alias("score_total")), n)
    shown = households.drop("score_total").join(best, "household_id")
    near = people.join(best.select("household_id"), "household_id", "left_semi")
    order = [text.tier_rank(F.col("tier_letter")), F.desc("tier_count"), F.col("name")]
    ranked = first_n(near, ["household_id"], order, members, "member_rank")
    per = ranked.groupBy("household_id").agg(
        F.count(F.lit(1)).alias("members_shown"),
        F.coalesce(F.min(F.when(F.upper("name").contains(q), F.col("member_rank") - 1)),
                   F.lit(-1)).alias("matched_idx"),
        F.array_sort(F.collect_list(F.struct("member_rank", "name", "age", "party", "tier_letter",
                                             "tier_count", "elections"))).alias("people"))
    out = with_zip_score(shown, zip_scores).join(per, "household_id", "left")
    return (out.withColumn("matched_idx", F.coalesce("matched_idx", F.lit(-1)))
            .withColumn("members_shown", F.coalesce("members_shown", F.lit(0)))
            .orderBy(F.desc("score_total"), "household_id"))


def audience_export(audience: DataFrame) -> DataFrame:
    """List columns with rank, whole-percent scores and joined years (a page of rows)."""
    from pyspark.sql import Window
    order = Window.orderBy(text.tier_rank(F.col("tier_letter")),
                           F.col("score_total").desc_nulls_last(), "person_id")
    pct = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("int")
    return audience.select(
        F.row_number().over(order).alias("rank"), "name",
        F.concat_ws(" ", "address_num", "street").alias("address"), "city", "zip", "county",
        F.coalesce("party", F.lit("")).alias("party"), "age",
        F.coalesce("tier_letter", F.lit("")).alias("tier"), pct("turnout_prob").alias("turnout_pct"),
        pct("dem_lean_prob").alias("dem_lean_pct"),
        F.array_join(F.transform("elections", lambda e: e["year"].cast("string")), "; ")
        .alias("elections_voted"), "total_donated")
