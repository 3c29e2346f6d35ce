"""District metrics, ZIP scores, contests and map measures."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scores, text
from ..functions.rounding import round_half_even, safe_ratio
from ..session import literal_table

CHAMBERS = {"assembly": "assembly_district", "senate": "senate_district",
            "congressional": "congressional_district"}


def by_chamber(df: DataFrame) -> DataFrame:
    """One row per chamber in which a row has a district."""
    pairs = F.array(*[F.struct(F.lit(k).alias("chamber"),
                               F.col(c).try_cast("int").cast("string").alias("district"))
                      for k, c in CHAMBERS.items() if c in df.columns])
    return (df.withColumn("__c", F.explode(pairs)).select("*", "__c.chamber", "__c.district")
            .drop("__c").filter(F.col("district").isNotNull()))


def district_metrics(households: DataFrame) -> DataFrame:
    """File variant: party counts by text, shares of DEM+REP+CON+BLK, half-even rounding."""
    d = F.coalesce("household_detail", F.lit(""))

    def hits(pattern: str) -> Column:
        return F.regexp_count(d, F.lit(pattern))

    counted = households.select(
        *[c for c in CHAMBERS.values() if c in households.columns],
        "voters_at_address", "engagement_gap", "num_reliable", "num_low_engagement",
        *[hits(f", {p}, ").alias(p) for p in ("DEM", "REP", "CON", "BLK")],
        sum((hits(rf", DEM, {t}\)") for t in C.DROPOFF_TIERS), F.lit(0)).alias("dropoff"))
    agg = by_chamber(counted).groupBy("chamber", "district").agg(
        F.count("voters_at_address").alias("total_households"),
        F.coalesce(F.sum("voters_at_address"), F.lit(0)).alias("total_voters"),
        *[F.sum(p).alias(p) for p in ("DEM", "REP", "CON", "BLK")],
        F.sum("dropoff").alias("dropoff_dem_count"),
        F.avg("engagement_gap").alias("gap"), F.sum("num_reliable").alias("rel"),
        F.sum("num_low_engagement").alias("low"))
    reg = F.greatest(F.col("DEM") + F.col("REP") + F.col("CON") + F.col("BLK"), F.lit(1))

    def pct(c: Column, den: Column) -> Column:
        return round_half_even(c.cast("double") / den * 100, 1)

    voters = F.greatest(F.col("total_voters"), F.lit(1))
    out = agg.select(
        "chamber", "district", "total_households", "total_voters",
        pct(F.col("DEM"), reg).alias("dem_pct"), pct(F.col("REP"), reg).alias("rep_pct"),
        pct(F.col("BLK"), reg).alias("blk_pct"), "dropoff_dem_count",
        round_half_even(F.col("gap"), 2).alias("avg_engagement_gap"),
        pct(F.col("rel"), voters).alias("reliable_pct"),
        pct(F.col("low"), voters).alias("low_engage_pct"))
    return out.withColumn("registration_gap",
                          round_half_even(F.col("dem_pct") - F.col("rep_pct"), 1))


def district_metrics_served(people: DataFrame, households: DataFrame) -> DataFrame:
    """Table variant: denominators are all people, half-up rounding."""
    j = people.join(households.select("household_id", *CHAMBERS.values()), "household_id")
    n = F.count(F.lit(1))

    def pct(c: Column) -> Column:
        return F.round(c.cast("double") / n * 100, 1)

    dem, rep = F.count_if(F.col("party") == "DEM"), F.count_if(F.col("party") == "REP")
    return by_chamber(j).groupBy("chamber", "district").agg(
        n.alias("total_voters"), pct(dem).alias("dem_pct"), pct(rep).alias("rep_pct"),
        pct(F.count_if(~F.col("party").isin("DEM", "REP"))).alias("blk_pct"),
        pct(dem - rep).alias("registration_gap"),
        pct(F.count_if(F.col("tier_letter") == "X")).alias("reliable_pct"),
        F.count_if((F.col("party") == "DEM") & F.col("tier_letter").isin("F", "L"))
        .alias("dropoff_dem_count"),
        F.round(F.avg(1.0 - F.col("turnout_prob").cast("double")), 3).alias("avg_engagement_gap"))


def zip_counts(registrations: DataFrame) -> DataFrame:
    z = text.zero_pad(text.strip(F.coalesce(F.col("zip").cast("string"), F.lit(""))))
    return (registrations.select(z.alias("zip")).filter(F.col("zip") != "00000")
            .groupBy("zip").agg(F.count(F.lit(1)).alias("count")))


def zip_scores(counts: DataFrame) -> DataFrame:
    """0-100 on a log scale between the smallest and the largest count; 50 when all agree."""
    lc = counts.withColumn("lc", F.log1p("count"))
    span = lc.agg(F.struct(F.min("lc").alias("lo"), F.max("lc").alias("hi")).alias("s")).scalar()
    lc = lc.withColumn("s", span).withColumn("share", safe_ratio(
        F.col("lc") - F.col("s.lo"), F.col("s.hi") - F.col("s.lo"), F.lit(0.5)))
    return lc.select("zip", round_half_even(F.col("share") * 100, 0).cast("int").alias("score"),
                     "count")


def district_counts(households: DataFrame) -> DataFrame:
    """Households per assembly district and county; a district may span counties."""
    return (households.groupBy(F.col("assembly_district").cast("string").alias("district"),
                               "county").agg(F.count(F.lit(1)).alias("households")))


def town_centroids(households: DataFrame, minimum: int = 200) -> DataFrame:
    """Mean place of each city with enough households. Coordinates are stored with few
    digits, so the mean is taken on decimals and does not depend on the row order."""
    geo = households.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    exact = lambda c: F.avg(F.col(c).cast("decimal(12,7)")).cast("double").alias(c)
    return (geo.groupBy("city").agg(exact("lat"), exact("lon"), F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= minimum)
            .select("city", round_half_even(F.col("lat"), 5).alias("lat"),
                    round_half_even(F.col("lon"), 5).alias("lon"), "n"))


def data_bounds(households: DataFrame, margin: float = 0.01) -> DataFrame:
    geo = households.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return geo.agg((F.min("lon") - margin).alias("lon_min"), (F.max("lon") + margin).alias("lon_max"),
                   (F.min("lat") - margin).alias("lat_min"), (F.max("lat") + margin).alias("lat_max"))


# --------------------------------------------------------------------- contests

def precinct_rows(raw: DataFrame) -> DataFrame:
    """Keep the wanted offices and allow-listed numeric districts."""
    allow = literal_table(raw.sparkSession, ["office", "race", "district_no"], [
        (office, race, d) for office, race in C.OFFICE_RACES.items() for d in C.RACE_DISTRICTS[race]])
    trimmed = (raw.withColumn("office", text.strip(F.col("office")))
               .withColumn("district", text.strip(F.col("district"))))
    numeric = trimmed.withColumn("district_no", F.when(
        F.col("district").rlike("^[0-9]+$"), F.col("district").try_cast("int")))
    # the allow list is 35 literal rows; the planner broadcasts it on its size
    return numeric.join(allow, ["office", "district_no"]).drop("district_no")


def contest_results(rows: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """One record per contest; a candidate's party lines are added up.

    Ties go to what was seen first. A contest without votes gives no row.
    """
    c = (rows.withColumn("candidate", text.strip(F.coalesce("candidate", F.lit(""))))
         .withColumn("party", F.upper(text.strip(F.coalesce("party", F.lit("")))))
         .withColumn("votes", F.coalesce(text.strip(F.col("votes").cast("string"))
                                         .try_cast("bigint"), F.lit(0)))
         .filter(F.col("candidate") != ""))
    lines = c.groupBy(*keys, "candidate", "party").agg(
        F.sum("votes").alias("line_votes"), F.min(ordinal).alias("seen"))
    cands = lines.groupBy(*keys, "candidate").agg(
        F.sum("line_votes").alias("votes"), F.min("seen").alias("seen"),
        F.max(F.struct(F.col("line_votes").alias("v"), (-F.col("seen")).alias("o"),
                       F.col("party").alias("p"))).alias("best"),
        *[F.max(F.when(F.col("party") == p, F.struct(
            F.col("line_votes").alias("v"), (-F.col("seen")).alias("o")))).alias(p)
          for p in ("DEM", "REP")])

    def leader(p: str) -> Column:
        return F.max(F.when(F.col(p).isNotNull(), F.struct(
            F.col(f"{p}.v").alias("v"), F.col(f"{p}.o").alias("o"),
            F.col("candidate").alias("c"), F.col("votes").alias("t"))))

    agg = cands.groupBy(*keys).agg(
        F.sum("votes").alias("total_votes"), leader("DEM").alias("d"), leader("REP").alias("r"),
        F.max(F.struct(F.col("votes").alias("v"), (-F.col("seen")).alias("o"),
                       F.col("best.p").alias("p"))).alias("top"))
    dem, rep = F.coalesce("d.t", F.lit(0)), F.coalesce("r.t", F.lit(0))
    total = F.col("total_votes")
    out = agg.filter(total != 0).withColumn("dem_votes", dem).withColumn("rep_votes", rep)
    d, r = F.col("dem_votes"), F.col("rep_votes")
    winner = (F.when(F.col("d").isNotNull() & (d > r), "DEM")
              .when(F.col("r").isNotNull() & (r > d), "REP").otherwise(F.col("top.p")))
    return out.select(
        *keys, "dem_votes", "rep_votes", F.greatest(F.lit(0), total - d - r).alias("other_votes"),
        "total_votes", F.coalesce("d.c", F.lit("")).alias("dem_candidate"),
        F.coalesce("r.c", F.lit("")).alias("rep_candidate"),
        round_half_even(d.cast("double") / total * 100, 1).alias("dem_pct"),
        round_half_even((d - r).cast("double") / total * 100, 1).alias("margin_pct"),
        winner.alias("winner"))


def served_winner(results: DataFrame) -> DataFrame:
    """Party lines outside DEM and REP are served as OTHER."""
    w = F.col("winner")
    return results.withColumn("winner", F.when(w.isin("DEM", "REP", ""), w).otherwise("OTHER"))


def expected_contests(spark, years: list[int],
                      races: dict[str, list[int]] | None = None) -> DataFrame:
    races = races or C.RACE_DISTRICTS
    return literal_table(spark, ["race", "year", "district"], [
        (race, y, str(d)) for race, ds in races.items() for y in years for d in ds])


def results_template(expected: DataFrame, results: DataFrame,
                     kept: DataFrame | None = None) -> DataFrame:
    """Every expected contest, filled where a record exists. Non-empty records in
    ``kept`` (an earlier output for the manual year) win over new ones."""
    keys = ["race", "year", "district"]
    numbers = ["dem_votes", "rep_votes", "other_votes", "total_votes", "dem_pct", "margin_pct"]
    words = ["dem_candidate", "rep_candidate", "winner"]
    out = expected.join(results, keys, "left")
    if kept is not None:
        k = kept.filter(F.col("total_votes") > 0).select(
            *keys, F.struct(*numbers, *words).alias("kept"))
        out = out.join(k, keys, "left")
        for c in numbers + words:
            out = out.withColumn(c, F.when(F.col("kept").isNotNull(), F.col(f"kept.{c}"))
                                 .otherwise(F.col(c)))
        out = out.drop("kept")
    return out.fillna(0, numbers).fillna("", words)


def missing_contests(expected: DataFrame, results: DataFrame) -> DataFrame:
    """Expected contests without a record that has votes."""
    keys = ["race", "year", "district"]
    return expected.join(results.filter(F.col("total_votes") > 0), keys, "left_anti")


def with_swing(results: DataFrame, step: int = 2) -> DataFrame:
    """Change of the Democratic share against the contest ``step`` years before;
    null when either had no votes."""
    prior = results.select("race", "district", (F.col("year") + step).alias("year"),
                           F.col("dem_pct").alias("__p"), F.col("total_votes").alias("__t"))
    swing = F.when((F.col("total_votes") > 0) & (F.col("__t") > 0), F.col("dem_pct") - F.col("__p"))
    return (results.join(prior, ["race", "district", "year"], "left")
            .withColumn("swing", swing).drop("__p", "__t"))


def is_tossup() -> Column:
    return (F.col("total_votes") > 0) & (F.abs("margin_pct") <= 5)


def tossup_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("race", "year").agg(F.count_if(is_tossup()).alias("tossups"))


def map_measures(results: DataFrame, metrics: DataFrame) -> DataFrame:
    """Map positions in 0-1. Needs the swing; metrics are keyed (race, district)."""
    m = metrics.select(F.col("chamber").alias("race"), "district", "registration_gap",
                       "dropoff_dem_count")
    j = results.join(m, ["race", "district"], "left")
    voted, gap = F.col("total_votes") > 0, F.col("registration_gap")
    return j.select(
        "race", "district", "year",
        scores.unit_clamp(F.when(voted, (F.col("dem_pct") - 30) / 40)
                          .otherwise((50 + gap / 2 - 30) / 40)).alias("m_dem_pct"),
        scores.unit_clamp(F.when(voted, (F.col("margin_pct") + 20) / 40)).alias("m_margin"),
        scores.unit_clamp((F.col("swing") + 10) / 20).alias("m_swing"),
        scores.unit_clamp((gap + 20) / 40).alias("m_reg_gap"),
        scores.unit_clamp(F.col("dropoff_dem_count") / 2000.0).alias("m_dropoff"))


# ------------------------------------------------------------------------- heat

def heat_buckets(households: DataFrame, cutoff: int, blk_only: bool = False) -> DataFrame:
    """Mapped households with bucket (complex, or dominant component) and weight."""
    w = F.col("score_unaffiliated") if blk_only else F.col("score_total")
    geo = (F.coalesce("lat", F.lit(0.0)) != 0) & (F.coalesce("lon", F.lit(0.0)) != 0)
    bucket = F.when(F.col("people_count") >= cutoff, "cx").otherwise(scores.dominant_component(
        F.col("score_wake_ups"), F.col("score_unaffiliated"), F.col("score_dropoff")))
    return (households.filter(geo & (F.col("score_total") != 0) & (w > 0))
            .withColumn("bucket", bucket).withColumn("weight", w)
            .withColumn("heat", F.sqrt(w.cast("double"))))


def heat_caps(points: DataFrame, share: float = 0.95, blk_only: bool = False) -> DataFrame:
    """Root of the weight at index floor(n x share), at most the bucket's ceiling.

    Weights are counted per value first; the running count is over distinct
    weights, which are small integers, never over the points.
    """
    per = points.groupBy("bucket", "weight").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("bucket").orderBy("weight")
    run = per.withColumn("upto", F.sum("n").over(w)).withColumn(
        "size", F.sum("n").over(Window.partitionBy("bucket")))
    at = run.filter(F.col("upto") > F.floor(F.col("size") * F.lit(share)))
    cx, other = (10, 6) if blk_only else (400, 60)
    ceiling = F.when(F.col("bucket") == "cx", cx).otherwise(other)
    return (at.groupBy("bucket").agg(F.min("weight").alias("cap"), F.max("size").alias("points"))
            .withColumn("cap", F.least("cap", ceiling))
            .withColumn("max_heat", F.sqrt(F.col("cap").cast("double"))))


def heat_grid(points: DataFrame, cell: float, weight: str = "heat") -> DataFrame:
    """Summed weight and weighted centre per grid cell."""
    return (points.groupBy(F.floor(F.col("lon") / cell).alias("cx"),
                           F.floor(F.col("lat") / cell).alias("cy"))
            .agg(F.sum(weight).alias("weight"),
                 safe_ratio(F.sum(F.col("lon") * F.col(weight)), F.sum(weight)).alias("lon"),
                 safe_ratio(F.sum(F.col("lat") * F.col(weight)), F.sum(weight)).alias("lat")))


def minimum_score(zips: DataFrame, minimum: int) -> DataFrame:
    return zips.filter(F.col("score") >= minimum)


def regional_zips(zips: DataFrame) -> DataFrame:
    return zips.filter(F.col("zip").startswith("11") | (F.col("zip") == "06390"))


def zip_aliases(zips: DataFrame) -> DataFrame:
    """Padded and unpadded forms of each ZIP."""
    plain = F.regexp_replace("zip", "^0+", "")
    return zips.unionByName(zips.filter(plain != F.col("zip")).withColumn("zip", plain))
