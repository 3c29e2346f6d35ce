"""Model quality measures on (y, p) columns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import safe_ratio
from ..functions.scores import score_band
from .groups import running_sums

EPS = 1e-7


def clip_probability(p: Column, eps: float = EPS) -> Column:
    return F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), p))


def _with_levels(df: DataFrame, p: str) -> DataFrame:
    """Two nested bins in the order of a number: its sign and power of two, then 4,096
    steps between two powers. They don't depend on the range, so one far value
    doesn't push all others into one bin."""
    size = F.abs(p)
    power = F.floor(F.log2(F.when(size > 0, size)))
    step = F.floor(size / F.pow(F.lit(2.0), power) * 4096)
    return df.withColumns({
        "__b1": F.coalesce(F.signum(p).cast("bigint") * (power + 2000), F.lit(0).cast("bigint")),
        "__b2": F.coalesce(F.signum(p).cast("bigint") * step, F.lit(0).cast("bigint"))})


def ranking_metrics(df: DataFrame, y: str = "y", p: str = "p",
                    keys: list[str] | None = None) -> DataFrame:
    """Exact ROC-AUC and average precision, with n and positives, per key.

    Rows are first counted per distinct score. The running counts over scores
    are taken bin by bin, never in one task.
    """
    keys = keys or []
    per = df.groupBy(*keys, F.col(p).cast("double").alias("p")).agg(
        F.sum(F.col(y).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n"))
    per = _with_levels(per.withColumn("neg", F.col("n") - F.col("pos")), "p")
    run = running_sums(per, keys, ["__b1", "__b2"], ["p"],
                       {"neg_to": F.col("neg"), "pos_to": F.col("pos")})
    totals = per.groupBy(*keys).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    if keys:
        run = run.join(totals, keys)
    else:
        t = totals.select(F.struct("all_pos", "all_neg").alias("t")).scalar()
        run = run.withColumn("__t", t).select("*", "__t.all_pos", "__t.all_neg")
    all_pos, all_neg = F.col("all_pos"), F.col("all_neg")
    below = F.col("neg_to") - F.col("neg") / 2.0
    tp = all_pos - F.col("pos_to") + F.col("pos")
    fp = all_neg - F.col("neg_to") + F.col("neg")
    return run.groupBy(*keys).agg(
        safe_ratio(F.sum(F.col("pos") * below),
                   F.max(all_pos.cast("double") * all_neg)).alias("auc"),
        F.sum(safe_ratio(F.col("pos"), all_pos) * safe_ratio(tp, tp + fp)).alias("pr_auc"),
        F.max("all_pos").alias("positives"), F.sum("n").alias("n"))


def binary_metrics(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """AUC, PR-AUC, log-loss, Brier score, base rate and n as one row."""
    c = clip_probability(F.col(p), 1e-15)
    yy = F.col(y).cast("double")
    point = df.agg(F.struct(
        F.avg(-(yy * F.log(c) + (1 - yy) * F.log(1 - c))).alias("log_loss"),
        F.avg((yy - F.col(p)) * (yy - F.col(p))).alias("brier"),
        F.avg(yy).alias("base_rate")).alias("m")).scalar()
    r = ranking_metrics(df, y, p).withColumn("m", point)
    return r.select("auc", "pr_auc", "m.log_loss", "m.brier", "m.base_rate", "n")


def multiclass_metrics(df: DataFrame, y: str = "y", probs: str = "probs", k: int = 3) -> DataFrame:
    """Accuracy, log-loss, macro-F1 and n; the class is the first with the largest probability."""
    pred = F.array_position(probs, F.array_max(probs)).cast("int") - 1
    py = clip_probability(F.get(F.col(probs), F.col(y).cast("int")), 1e-15)
    confusion = df.groupBy(F.col(y).cast("int").alias("y"), pred.alias("q")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(-F.log(py)).alias("nll"))

    def f1(c: int) -> Column:
        tp = F.sum(F.when((F.col("y") == c) & (F.col("q") == c), F.col("n")).otherwise(0))
        both = F.sum(F.when(F.col("y") == c, F.col("n")).otherwise(0)) + F.sum(
            F.when(F.col("q") == c, F.col("n")).otherwise(0))
        return safe_ratio(2 * tp, both)

    seen = [f1(c) for c in range(k)]
    present = sum((F.when(f.isNotNull(), 1).otherwise(0) for f in seen), F.lit(0))
    return confusion.agg(
        safe_ratio(F.sum(F.when(F.col("y") == F.col("q"), F.col("n")).otherwise(0)), F.sum("n"))
        .alias("accuracy"), safe_ratio(F.sum("nll"), F.sum("n")).alias("log_loss"),
        safe_ratio(sum((F.coalesce(f, F.lit(0.0)) for f in seen), F.lit(0.0)), present)
        .alias("macro_f1"), F.sum("n").alias("n"))


def probability_bin(p: Column, bins: int = 15) -> Column:
    """Equal-width bin 0..bins-1; an edge belongs to the bin above it."""
    return sum((F.when(p >= i / bins, 1).otherwise(0) for i in range(1, bins)), F.lit(0))


def reliability(df: DataFrame, y: str = "y", p: str = "p", bins: int = 15) -> DataFrame:
    return df.groupBy(probability_bin(F.col(p), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"),
        F.avg(F.col(y).cast("double")).alias("mean_y"))


def calibration_error(df: DataFrame, y: str = "y", p: str = "p", bins: int = 15) -> DataFrame:
    r = reliability(df, y, p, bins)
    return r.agg(safe_ratio(F.sum(F.col("n") * F.abs(F.col("mean_y") - F.col("mean_p"))),
                            F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def district_validation(df: DataFrame, ed: str = "ed_key", y: str = "y", p: str = "p",
                        min_n: int = 1) -> DataFrame:
    """Mean absolute error and bias of district means, over districts with min_n rows."""
    per = df.groupBy(ed).agg(F.avg(p).alias("pred"), F.avg(F.col(y).cast("double")).alias("actual"),
                             F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_n)
    gap = F.col("pred") - F.col("actual")
    return per.agg(F.avg(F.abs(gap)).alias("mae"), F.avg(gap).alias("bias"),
                   F.count(F.lit(1)).alias("districts"))


def band_counts(df: DataFrame, score: str = "donor_score") -> DataFrame:
    return df.groupBy(score_band(F.col(score)).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def exact_percentiles(long: DataFrame, keys: list[str], value: str,
                      shares: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated percentiles per key; nulls are left out.

    The built-in exact percentile gathers all distinct values of a key in one
    task. Here values are counted, ranked bin by bin, and only the values at the
    wanted positions are picked.
    """
    v = F.col(value).cast("double")
    counts = long.filter(v.isNotNull()).groupBy(*keys, v.alias("__v")).agg(
        F.count(F.lit(1)).alias("__k"))
    total = counts.groupBy(*keys).agg(F.sum("__k").alias("__n"))
    ranked = running_sums(_with_levels(counts.join(total, keys), "__v"), keys, ["__b1", "__b2"], ["__v"],
                          {"__upto": F.col("__k")})

    def at(pos: Column) -> Column:
        here = (F.col("__upto") - F.col("__k") <= pos) & (pos < F.col("__upto"))
        return F.max(F.when(here, F.col("__v")))

    def percentile(q: float) -> Column:
        pos = F.lit(q) * (F.col("__n") - 1)
        low = at(F.floor(pos))
        return low + (at(F.ceil(pos)) - low) * F.max(pos - F.floor(pos))

    return ranked.groupBy(*keys).agg(*[percentile(q).alias(name) for name, q in shares.items()])


def score_summary(df: DataFrame, score: str) -> DataFrame:
    one = df.select(F.lit("all").alias("__all"), F.col(score).alias("__score"))
    pct = exact_percentiles(one, ["__all"], "__score", {"p10": 0.1, "p90": 0.9})
    mean = df.agg(F.avg(score)).scalar()
    return pct.select(mean.alias("mean"), "p10", "p90")


def feature_aucs(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """AUC of each raw feature against the label, all features in one pass. A null
    counts as the feature's least value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"))
                      for c in features])
    long = df.select(F.col(y).alias("y"), F.explode(pairs).alias("p")).select("y", "p.*")
    least = long.groupBy("feature").agg(F.min("x").alias("lo"))
    filled = long.join(least, "feature").withColumn("p", F.coalesce("x", "lo", F.lit(0.0)))
    return ranking_metrics(filled, "y", "p", ["feature"]).select("feature", "auc", "n")


def compare_models(a: DataFrame, b: DataFrame, names: tuple[str, str]) -> DataFrame:
    """(metric, value) frames side by side."""
    return a.withColumnRenamed("value", names[0]).join(
        b.withColumnRenamed("value", names[1]), "metric")


def as_long(metrics: DataFrame, prefix: str = "") -> DataFrame:
    """One row of numbers to (metric, value) rows."""
    pairs = F.array(*[F.struct(F.lit(prefix + c).alias("metric"), F.col(c).cast("double")
                               .alias("value")) for c in metrics.columns])
    return metrics.select(F.explode(pairs).alias("p")).select("p.*")
