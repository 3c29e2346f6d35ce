"""Participation features as of a target general election.

Ballots are folded into bit masks per person: bit i of the mask is the year
``target - i``. The aggregate state is a few longs, so the fold combines before
the shuffle and no person's ballots are ever gathered into a list.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.rounding import safe_ratio
from ..session import cut

FIRST_YEAR = 1900
BITS = 60
# a rate over at most 8 years is a multiple of 1/lcm(1..8)
RATE_UNIT = 840


def before_target(target: int, year: str = "year", etype: str = "etype") -> Column:
    """Ballots cast before the target general: earlier years, and its own primary."""
    return (F.col(year) < target) | ((F.col(year) == target) & (F.col(etype) == "P"))


def _shift(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.cast("int"))


def _low_mask(n: Column) -> Column:
    """Mask of bits 0..n; empty for negative n."""
    full = F.lit((1 << BITS) - 1)
    return (F.when(n < 0, F.lit(0).cast("bigint"))
            .when(n >= BITS - 1, full)
            .otherwise(_shift(n + 1) - 1))


def _bits(m: Column) -> Column:
    return F.bit_count(m)


def _lowest(m: Column) -> Column:
    return F.when(m != 0, _bits(m.bitwiseAND(-m) - 1))


def _highest(m: Column) -> Column:
    return F.when(m != 0, F.length(F.bin(m)) - 1)


def participation(ballots: DataFrame, target: int, key: str = "person_row") -> DataFrame:
    """Per person: year masks of generals (g*) and primaries (p*), method counts."""
    i = F.lit(target) - F.col("year")
    usable = (F.col("year") <= target) & (F.col("year") >= FIRST_YEAR)
    words = (target - FIRST_YEAR) // BITS + 1
    pre = before_target(target)

    def mask(etype: str, w: int) -> Column:
        here = usable & (F.col("etype") == etype) & (F.floor(i / BITS) == w)
        return F.coalesce(F.bit_or(F.when(here, _shift(F.pmod(i, F.lit(BITS))))),
                          F.lit(0).cast("bigint"))

    def n_methods(methods: list[str]) -> Column:
        return F.count_if(pre & F.col("method").isin(methods))

    return ballots.groupBy(key).agg(
        *[mask("G", w).alias(f"g{w}") for w in range(words)],
        *[mask("P", w).alias(f"p{w}") for w in range(words)],
        F.count_if(pre).alias("n_pre"), n_methods(["V"]).alias("n_early"),
        n_methods(["A", "M", "F"]).alias("n_absentee"), n_methods(["E", "D"]).alias("n_poll"))


def history_features(people: DataFrame, ballots: DataFrame, target: int, ref_year: int,
                     key: str = "person_row", age: str = "age", household: str = "household_row",
                     ed: str = "ed_key", first_year: Column | None = None) -> DataFrame:
    """All ``hist_*`` features, the leave-self-out rates and the label.

    Ages are current in ``ref_year``. ``first_year`` is the earliest year in the
    ballot table (a scalar subquery over it when not given).
    """
    words = (target - FIRST_YEAR) // BITS + 1
    y0 = first_year if first_year is not None else ballots.agg(F.min("year")).scalar()
    grid = participation(ballots, target, key)
    df = people.select(key, age, household, ed).join(grid, key, "left")
    names = [f"{t}{w}" for t in "gp" for w in range(words)]
    df = df.fillna(0, names + ["n_pre", "n_early", "n_absentee", "n_poll"])
    df = df.withColumn("y0", y0).withColumn("y18", F.lit(ref_year) - F.col(age) + 18)

    one = F.lit(1).cast("bigint")
    voted_target = F.col("g0").bitwiseAND(one)
    # earlier generals: drop bit 0 (the target itself)
    df = df.withColumn("label", voted_target.cast("int"))
    df = df.withColumn("g0", F.col("g0") - voted_target)
    g, p = [F.col(f"g{w}") for w in range(words)], [F.col(f"p{w}") for w in range(words)]
    anyw = [g[w].bitwiseOR(p[w]) for w in range(words)]

    def total(masks: list[Column]) -> Column:
        out = F.lit(0)
        for m in masks:
            out = out + _bits(m)
        return out

    def window_mask(near: int, far: int) -> int:
        """Bits near..far, near >= 1."""
        return sum(1 << b for b in range(near, far + 1))

    def window_rate(near: int, far: int) -> Column:
        votes = _bits(g[0].bitwiseAND(F.lit(window_mask(near, far))))
        return safe_ratio(votes, eligible(near, far), F.lit(0.0))

    def eligible(near: int, far: int) -> Column:
        """Years target-far..target-near since the 18th birthday; not cut to the data."""
        a, b = target - far, target - near
        return F.greatest(F.lit(0), F.least(F.lit(b - a + 1),
                                            F.lit(b) - F.greatest(F.lit(a), F.col("y18")) + 1))

    def cycle_rate(keep, span: int) -> Column:
        mask = F.lit(sum(1 << (target - y) for y in range(target - span, target) if keep(y)))
        votes = _bits(g[0].bitwiseAND(mask))
        since = F.lit(target) - F.greatest(F.col("y0"), F.col("y18"))
        return safe_ratio(votes, _bits(mask.bitwiseAND(_low_mask(since))), F.lit(0.0))

    def nearest(masks: list[Column]) -> Column:
        return F.coalesce(*[_lowest(m) + w * BITS for w, m in enumerate(masks)],
                          F.lit(C.NEVER_VOTED_YEARS))

    def farthest(masks: list[Column]) -> Column:
        return F.coalesce(*[_highest(m) + w * BITS for w, m in reversed(list(enumerate(masks)))],
                          F.lit(C.NEVER_VOTED_YEARS))

    def flag(i: int) -> Column:
        return _bits(g[0].bitwiseAND(F.lit(1 << i)))

    never = total(anyw) == 0
    runs = _runs(g, F.lit(target) - F.col("y0"))
    share = lambda c: safe_ratio(F.col(c), F.col("n_pre"), F.lit(0.0))
    feats = df.select(
        key, household, ed,
        total(g).alias("hist_n_generals"), total(p).alias("hist_n_primaries"),
        (total(g) + total(p)).alias("hist_n_votes"),
        *[window_rate(1, w).alias(f"hist_general_rate_{w}") for w in (5, 8, 12)],
        eligible(1, 8).alias("hist_eligible_generals_8"),
        cycle_rate(lambda y: y % 4 == 0, 16).alias("hist_pres_rate"),
        cycle_rate(lambda y: y % 4 == 2, 16).alias("hist_midterm_rate"),
        cycle_rate(lambda y: y % 2 == 1, 8).alias("hist_oddyear_rate"),
        nearest(anyw).alias("hist_years_since_last_vote"),
        nearest(g).alias("hist_years_since_last_general"),
        farthest(anyw).alias("hist_years_since_first_seen"),
        never.cast("int").alias("hist_never_voted"),
        *[flag(k).alias(f"hist_voted_g{k}") for k in (1, 2, 3, 4)],
        p[0].bitwiseAND(one).cast("int").alias("hist_voted_primary_cycle"),
        runs["current"].alias("hist_streak_current"), runs["best"].alias("hist_streak_longest"),
        (window_rate(1, 3) - window_rate(4, 8)).alias("hist_trend_3v5"),
        share("n_early").alias("hist_share_early"),
        share("n_absentee").alias("hist_share_absentee"),
        share("n_poll").alias("hist_share_pollsite"),
        (F.col(age) - (ref_year - target)).alias("hist_age_at_target"),
        F.col("label").alias(f"y_voted_general_{target}"))
    # one row per person from one pass over the ballots; the group means read it again
    feats = cut(feats)
    for group, name in ((household, "hist_hh_general_rate_8_excl"),
                        (ed, "hist_ed_general_rate_8_excl")):
        feats = mean_of_others(feats, group, "hist_general_rate_8", name)
    return feats.drop(household, ed)


def _runs(g: list[Column], span: Column) -> Column:
    """Current run (ending the year before the target) and longest run of generals."""
    words = F.array(*g)

    def bit(i: Column) -> Column:
        word = F.get(words, F.floor(i / BITS).cast("int"))
        return F.call_function("shiftright", word, F.pmod(i, F.lit(BITS)).cast("int")) \
            .bitwiseAND(F.lit(1).cast("bigint")) == 1

    def step(acc: Column, i: Column) -> Column:
        run = F.when(bit(i), acc["run"] + 1).otherwise(0)
        return F.struct(
            run.alias("run"), F.greatest(acc["best"], run).alias("best"),
            F.when(acc["open"] & bit(i), acc["current"] + 1).otherwise(acc["current"])
            .alias("current"),
            (acc["open"] & bit(i)).alias("open"))

    zero = F.lit(0)
    start = F.struct(zero.alias("run"), zero.alias("best"), zero.alias("current"),
                     F.lit(True).alias("open"))
    steps = F.when(span >= 1, F.sequence(F.lit(1), span.cast("int"))) \
        .otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, step)


def mean_of_others(df: DataFrame, group: str, value: str, name: str,
                   unit: int = RATE_UNIT) -> DataFrame:
    """Group mean without the row itself; 0 for a group of one.

    Values are multiples of 1/unit, so they are summed as whole numbers and the
    result does not depend on the row order. Sums are joined back instead of
    windowed: the aggregate combines before the shuffle, and the join lets AQE
    split a group that holds much of the data.
    """
    whole = F.round(F.col(value) * unit).cast("bigint")
    sums = df.groupBy(group).agg(F.sum(whole).alias("__s"), F.count(F.lit(1)).alias("__n"))
    return (df.join(sums, group, "left")
            .withColumn(name, safe_ratio(F.col("__s") - whole, (F.col("__n") - 1) * unit,
                                         F.lit(0.0)))
            .drop("__s", "__n"))


def distinct_years(ballots: DataFrame, key: str = "person_row") -> DataFrame:
    """Participation grid: the sorted distinct years per person and ballot type."""
    return ballots.groupBy(key, "etype").agg(
        F.array_sort(F.collect_set("year")).alias("years"))
