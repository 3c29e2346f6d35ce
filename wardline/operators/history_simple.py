"""The quicker history variant. Same feature names in the source, other formulas:
every column here ends in ``_simple`` so that the two are never mixed."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C


def history_features_simple(people: DataFrame, ballots: DataFrame, target: int, ref_year: int,
                            key: str = "person_row") -> DataFrame:
    """Rates over calendar years seen in the data, without eligibility.

    ``ballots`` holds (key, year, etype); any year seen in any ballot before the
    target counts as a general-election year. The current streak is the run that
    starts at the earliest such year, as in the source.
    """
    before = F.col("year") < target
    seen = (ballots.filter(before).agg(F.array_sort(F.collect_set("year")).alias("y"))
            .select(F.when(F.size("y") == 0, F.sequence(F.lit(2002), F.lit(target - 1), F.lit(2)))
                    .otherwise(F.col("y")).alias("y")))
    cast = seen.select(F.col("y").cast("array<int>").alias("y"))

    def tail(c: Column, n: int) -> Column:
        return F.slice(c, F.greatest(F.size(c) - n + 1, F.lit(1)), F.lit(n))

    def even_since(span: int, n: int) -> Column:
        return tail(F.filter("y", lambda y: (y >= target - span) & (y % 2 == 0)), n)

    windows = cast.select(F.struct(
        F.col("y").alias("years"),
        even_since(10, 5).alias("w5"), even_since(16, 8).alias("w8"),
        even_since(24, 12).alias("w12"),
        F.filter(even_since(16, 8), lambda y: y % 4 == 0).alias("pres"),
        F.filter(even_since(16, 8), lambda y: y % 4 == 2).alias("midterm"),
        F.filter("y", lambda y: (y % 2 == 1) & (y >= target - 16)).alias("odd"),
        tail(F.col("y"), 3).alias("r3"), tail(F.col("y"), 5).alias("r5"),
        F.reverse(tail(F.col("y"), 4)).alias("last4"))).scalar()

    general, primary = F.col("etype") == "G", F.col("etype") == "P"
    per = ballots.groupBy(key).agg(
        F.collect_set(F.when(general & before, F.col("year").cast("int"))).alias("voted"),
        F.count_if(general & before).alias("n_g"),
        F.count_if(primary & (F.col("year") <= target)).alias("n_p"),
        F.max(F.when(general & before, F.col("year"))).alias("last"),
        F.min(F.when(general & before, F.col("year"))).alias("first"),
        F.count_if(primary & (F.col("year") == target)).alias("n_pe"))
    df = people.select(key).join(per, key, "left").withColumn("w", windows)
    voted = F.coalesce(F.col("voted"), F.array().cast("array<int>"))
    df = df.withColumn("voted", voted)
    zero = F.lit(0)

    def rate(name: str) -> Column:
        years = F.col(f"w.{name}")
        return F.when(F.size(years) > 0,
                      F.size(F.array_intersect(years, F.col("voted"))) / F.size(years)) \
            .otherwise(F.lit(0.0))

    def flag(k: int) -> Column:
        return F.coalesce(F.array_contains("voted", F.get("w.last4", F.lit(k - 1))).cast("int"),
                          zero)

    bits = F.transform("w.years", lambda y: F.array_contains(F.col("voted"), y))
    start = F.struct(zero.alias("run"), zero.alias("best"), zero.alias("lead"),
                     F.lit(True).alias("open"))

    def step(acc: Column, b: Column) -> Column:
        run = F.when(b, acc["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"),
                        F.when(acc["open"] & b, acc["lead"] + 1).otherwise(acc["lead"])
                        .alias("lead"), (acc["open"] & b).alias("open"))

    runs = F.aggregate(bits, start, step)
    n_g, n_p = F.coalesce("n_g", zero), F.coalesce("n_p", zero)
    sentinel = F.lit(C.NEVER_VOTED_YEARS)
    out = {
        "n_votes": n_g + n_p,
        "n_generals": F.size("voted"),
        "general_rate_5": rate("w5"), "general_rate_8": rate("w8"),
        "general_rate_12": rate("w12"),
        "eligible_8": F.size("w.w8"),
        "pres_rate": rate("pres"), "midterm_rate": rate("midterm"), "oddyear_rate": rate("odd"),
        "years_since_last": F.coalesce(F.lit(target) - F.col("last"), sentinel),
        "years_since_first": F.coalesce(F.lit(ref_year) - F.col("first"), sentinel),
        "never_voted": (F.size("voted") == 0).cast("int"),
        **{f"voted_g{k}": flag(k) for k in (1, 2, 3, 4)},
        "streak_current": runs["lead"], "streak_longest": runs["best"],
        "trend_3v5": rate("r3") - rate("r5"),
        "n_primaries": n_p,
        "voted_primary_cycle": (F.coalesce("n_pe", zero) > 0).cast("int"),
    }
    return df.select(key, *[c.alias(f"hist_{n}_simple") for n, c in out.items()])
