"""Feature manifest, leakage guard, census features and encodings."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.rounding import safe_ratio
from .metrics import exact_percentiles

# --- fixed values: which feature may inform which task ------------------------
# encoder: both tasks; turnout_head / party_head: one task only.
# as_of: computed before the cutoff; spans_cutoff: contains the outcome.
ENCODER_CATEGORICAL = ["county", "town", "city", "zip_code", "congressional_district",
                       "senate_district", "assembly_district", "legislative_district"]
ENCODER_NUMERIC = ["age", "household_size", "oldest_age", "youngest_age", "lat", "lon", "has_geo",
                   "ed_n_voters"]
ENCODER_AS_OF = [
    "has_donation", "fec_n", "fec_total", "fec_recency_days", "nyboe_n", "nyboe_total",
    "nyboe_recency_days", "n_committees", "dem_conduit_total", "rep_conduit_total",
    "hist_n_votes", "hist_n_generals", "hist_general_rate_5", "hist_general_rate_8",
    "hist_general_rate_12", "hist_eligible_generals_8", "hist_pres_rate", "hist_midterm_rate",
    "hist_oddyear_rate", "hist_years_since_last_vote", "hist_years_since_last_general",
    "hist_years_since_first_seen", "hist_never_voted", "hist_voted_g1", "hist_voted_g2",
    "hist_voted_g3", "hist_voted_g4", "hist_streak_current", "hist_streak_longest",
    "hist_trend_3v5", "hist_share_early", "hist_share_absentee", "hist_share_pollsite"]
ENCODER_CENSUS = ["acs_median_hh_income", "acs_pct_bachelors", "acs_pct_white", "acs_pct_black",
                  "acs_pct_hispanic", "acs_pct_asian", "acs_median_age", "acs_pct_owner_occ",
                  "acs_pop_density"]
BOTH_HEADS = ["hh_dem_share_excl", "hh_rep_share_excl", "hh_blk_share_excl", "ed_dem_share_excl",
              "ed_rep_share_excl", "ed_blk_share_excl"]
BOTH_HEADS_AS_OF = ["hist_hh_general_rate_8_excl", "hist_ed_general_rate_8_excl"]
TURNOUT_CATEGORICAL = ["party"]
TURNOUT_AS_OF = ["hist_n_primaries", "hist_voted_primary_cycle"]
PARTY_CATEGORICAL = ["tier_letter"]
PARTY_NUMERIC = ["tier_count", "max_vote_count", "min_vote_count", "engagement_gap",
                 "num_reliable", "num_low_engagement", "ed_mean_tier_count"]
UNUSED_AS_OF = ["hist_age_at_target"]
DONATION_FEATURES = ENCODER_AS_OF[:10]
DE_AGED = ["oldest_age", "youngest_age"]


def manifest() -> dict[str, dict]:
    """name -> {type, usage, as_of, spans_cutoff}."""
    out: dict[str, dict] = {}

    def add(names: list[str], kind: str, usage: list[str], as_of: bool = False,
            spans: bool = False) -> None:
        for n in names:
            out[n] = {"type": kind, "usage": usage, "as_of": as_of, "spans_cutoff": spans}

    heads = ["turnout_head", "party_head"]
    add(ENCODER_NUMERIC + ENCODER_CENSUS, "numeric", ["encoder"])
    add(ENCODER_CATEGORICAL, "categorical", ["encoder"])
    add(ENCODER_AS_OF, "numeric", ["encoder"], as_of=True)
    add(BOTH_HEADS, "numeric", heads)
    add(BOTH_HEADS_AS_OF, "numeric", heads, as_of=True)
    add(TURNOUT_CATEGORICAL, "categorical", ["turnout_head"])
    add(TURNOUT_AS_OF, "numeric", ["turnout_head"], as_of=True)
    add(PARTY_CATEGORICAL, "categorical", ["party_head"], spans=True)
    add(PARTY_NUMERIC, "numeric", ["party_head"], spans=True)
    add(UNUSED_AS_OF, "numeric", [], as_of=True)
    return out


def task_features(task: str, available: list[str]) -> tuple[list[str], list[str], list[str]]:
    """(numeric, categorical, missing) for ``turnout`` or ``party``. Checks the guard."""
    wanted = {n: m for n, m in manifest().items()
              if "encoder" in m["usage"] or f"{task}_head" in m["usage"]}
    have = set(available)
    numeric = [n for n, m in wanted.items() if n in have and m["type"] == "numeric"]
    categorical = [n for n, m in wanted.items() if n in have and m["type"] == "categorical"]
    check_leakage(task, numeric + categorical)
    return numeric, categorical, [n for n in wanted if n not in have]


def check_leakage(task: str, features: list[str]) -> None:
    spec = manifest()
    if task == "turnout":
        leaked = [f for f in features if spec.get(f, {}).get("spans_cutoff")]
        if leaked:
            raise ValueError(f"features that span the cutoff in the turnout set: {leaked}")
    if task == "party" and "party" in features:
        raise ValueError("own registration in the party set")


def any_cutoff_features(available: list[str]) -> tuple[list[str], list[str]]:
    """Person features usable at every cutoff: no donations, no raw age, no history."""
    numeric, categorical, _ = task_features("turnout", available)
    ok = lambda n: n not in DONATION_FEATURES and n != "age" and not n.startswith("hist_")
    return [n for n in numeric if ok(n)], [n for n in categorical if ok(n)]


def feature_blocks(available: list[str]) -> dict[str, dict[str, list[str]]]:
    blocks = {b: {"num": [], "cat": []} for b in ("encoder", "turnout", "party")}
    for n, m in manifest().items():
        if n not in available:
            continue
        kind = "cat" if m["type"] == "categorical" else "num"
        for block, tag in (("encoder", "encoder"), ("turnout", "turnout_head"),
                           ("party", "party_head")):
            if tag in m["usage"]:
                blocks[block][kind].append(n)
    return blocks


# --------------------------------------------------------------------- census

def merge_census(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, "bg_geoid", "full"), tables)


def census_features(census: DataFrame, area: DataFrame) -> DataFrame:
    """Shares are null on a zero denominator; a missing degree count adds nothing."""
    pop, edu, ten = F.col("pop_total"), F.col("edu_total_25plus"), F.col("tenure_total")
    degrees = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in (
        "edu_bachelors", "edu_masters", "edu_professional", "edu_doctorate")), F.lit(0.0))
    j = census.join(area.select("bg_geoid", "area_km2"), "bg_geoid", "left")
    return j.select(
        "bg_geoid", F.col("median_hh_income").alias("acs_median_hh_income"),
        F.col("median_age").alias("acs_median_age"),
        safe_ratio(F.col("white_nh"), pop).alias("acs_pct_white"),
        safe_ratio(F.col("black_nh"), pop).alias("acs_pct_black"),
        safe_ratio(F.col("asian_nh"), pop).alias("acs_pct_asian"),
        safe_ratio(F.col("hispanic"), pop).alias("acs_pct_hispanic"),
        safe_ratio(degrees, edu).alias("acs_pct_bachelors"),
        safe_ratio(F.col("tenure_owner"), ten).alias("acs_pct_owner_occ"),
        safe_ratio(pop, F.col("area_km2")).alias("acs_pop_density"))


def attach_census(people: DataFrame, features: DataFrame) -> DataFrame:
    """Drop earlier census columns, then join the new ones on the block group."""
    old = [c for c in people.columns if c.startswith("acs_")]
    return people.drop(*old).join(features, "bg_geoid", "left")


# -------------------------------------------------------------------- encoding

def fill_recency(df: DataFrame, columns: list[str], days: int = C.NEVER_DONATED_DAYS) -> DataFrame:
    return df.fillna(days, [c for c in columns if c.endswith("_recency_days")])


def train_statistics(df: DataFrame, columns: list[str], split: str = "split") -> DataFrame:
    """Exact median of the train rows, then mean and sample deviation after median
    fill; a zero deviation counts as 1. One row per column."""
    train = df.filter(F.col(split) == "train")
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"))
                      for c in columns])
    long = train.select(F.explode(pairs).alias("p")).select("p.*")
    med = exact_percentiles(long, ["feature"], "x", {"median": 0.5})
    filled = long.join(med, "feature", "left").withColumn("x", F.coalesce("x", "median"))
    sd = F.coalesce(F.stddev_samp("x"), F.lit(0.0))
    return filled.groupBy("feature").agg(
        F.max("median").alias("median"), F.avg("x").alias("mean"),
        F.when(sd == 0, 1.0).otherwise(sd).alias("std"))


def standardize(df: DataFrame, columns: list[str], stats: DataFrame, key: str) -> DataFrame:
    """z-scores with the train statistics (a handful of numbers, read as one map)."""
    table = stats.agg(F.map_from_entries(F.collect_list(F.struct(
        "feature", F.struct("median", "mean", "std"))))).scalar()

    def z(c: str) -> Column:
        s = F.element_at(F.col("__stats"), F.lit(c))
        return ((F.coalesce(F.col(c).cast("double"), s["median"]) - s["mean"]) / s["std"]).alias(c)

    return df.withColumn("__stats", table).select(key, *[z(c) for c in columns])


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): text categories in alphabetical order from 1. A null is the
    category ``nan``; code 0 stays free."""
    text = F.coalesce(F.col(column).cast("string"), F.lit("nan"))
    values = df.select(text.alias(column)).distinct()
    from .groups import ordered_rank
    return ordered_rank(values.withColumn("__h", F.substring(column, 1, 2)), [], ["__h"],
                        [column], f"{column}_code").drop("__h")


def encode_category(df: DataFrame, column: str) -> DataFrame:
    codes = category_codes(df, column)
    text = F.coalesce(F.col(column).cast("string"), F.lit("nan"))
    return df.withColumn(column, text).join(codes, column, "left")
