import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.operators import features, metrics, models


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(0)
    p = np.round(rng.beta(.3, .3, 600), 3)
    y = (rng.uniform(size=600) < .2 + .6 * p).astype(int)
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double"), y, p


def test_ranking_against_pairs(scored):
    df, y, p = scored
    r = metrics.binary_metrics(df).first()
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean([(a > neg).mean() + .5 * (a == neg).mean() for a in pos])
    ap, prev = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        tp = (y[p >= t]).sum()
        rec = tp / y.sum()
        ap += (rec - prev) * tp / (p >= t).sum()
        prev = rec
    assert r["auc"] == pytest.approx(auc) and r["pr_auc"] == pytest.approx(ap) and r["n"] == 600


def test_ranking_of_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(1, .2), (1, 1.0), (1, 0.0)], "y int, p double")
    assert metrics.binary_metrics(df).first()["auc"] is None


def test_exact_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    a, b = np.round(rng.normal(0, 5, 400), 1), np.array([7.0])
    df = spark.createDataFrame([("a", float(x)) for x in a] + [("b", 7.0), ("b", None)], "k string, x double")
    got = {r["k"]: r for r in metrics.exact_percentiles(df, ["k"], "x", {"q1": .1, "q5": .5, "q9": .93}).collect()}
    for k, v in (("a", a), ("b", b)):
        assert [got[k][n] for n in ("q1", "q5", "q9")] == pytest.approx(list(np.percentile(v, [10, 50, 93])))


def test_bins_include_both_ends(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 1.0), (0, 1 / 15), (0, 0.5)], "y int, p double")
    got = {r["bin"]: r["n"] for r in metrics.reliability(df).collect()}
    assert got == {0: 1, 14: 1, 1: 1, 7: 1}


def test_leakage_guard():
    have = list(features.manifest())
    num, cat, missing = features.task_features("turnout", have)
    spans = {n for n, m in features.manifest().items() if m["spans_cutoff"]}
    assert not spans & set(num + cat) and not missing and "party" in cat
    num, cat, _ = features.task_features("party", have)
    assert "party" not in cat and "tier_letter" in cat and "hist_n_primaries" not in num
    with pytest.raises(ValueError):
        features.check_leakage("turnout", ["tier_count"])
    num, _ = features.any_cutoff_features(have)
    assert "age" not in num and not any(n.startswith(("hist_", "fec_")) for n in num)
    blocks = features.feature_blocks(have)
    assert "hh_dem_share_excl" in blocks["turnout"]["num"] and "hh_dem_share_excl" not in blocks["encoder"]["num"]


def test_temperature_does_not_lose_to_one(scored):
    df, _, _ = scored
    over = df.withColumn("logit", models.logit(F.col("p")) * 4)
    t = models.fit_temperature(over)
    nll = lambda x: over.agg(models._scaled_nll(F.col("logit"), F.col("y").cast("double"), x)).first()[0]
    assert nll(t) <= nll(1.0) and t > 1
    assert all(nll(t) <= nll(t * f) + 1e-12 for f in (.97, 1.03))


def test_class_temperature(spark):
    df = spark.createDataFrame([(0, [4.0, 0.0, 0.0]), (1, [4.0, 0.0, 0.0]), (2, [0.0, 0.0, 3.0])], "y int, logit array<double>")
    assert models.fit_temperature(df, classes=True) > 1
    p = spark.range(1).select(models.apply_temperature_classes(F.array(F.lit(.7), F.lit(.2), F.lit(.1)), 2.0)).first()[0]
    assert sum(p) == pytest.approx(1) and p[0] < .7


@pytest.fixture(scope="module")
def planted(spark):
    n, k = F.col("id"), F.col("person_id")
    df = spark.range(1200).select(
        n.alias("person_id"), (20 + n % 60).cast("int").alias("age"), (n * 17 % 5).cast("int").alias("hist_n_generals"),
        F.when(n % 7 == 0, None).otherwise((n * 13 % 400).cast("double")).alias("fec_recency_days"),
        F.when(n % 11 == 0, None).otherwise(F.concat(F.lit("T"), (n % 4).cast("string"))).alias("town"),
        F.element_at(F.array(*map(F.lit, ["DEM", "REP", "BLK", "OTH"])), (n % 4 + 1).cast("int")).alias("party"),
        F.when(F.floor(n / 7) % 10 < 8, "train").when(F.floor(n / 7) % 10 == 8, "val").otherwise("test").alias("split"))
    return df.withColumns({
        "y_turnout": F.when(k % 23 == 0, -1).otherwise((F.col("hist_n_generals") + k % 2 >= 3).cast("int")),
        "y_party": F.when(F.col("party") == "BLK", -1).when(F.col("town") == "T0", 0).when(F.col("age") > 50, 1).otherwise(2)
    })


def test_one_far_value_does_not_crowd_the_bins(spark):
    x = [1e12, -1e9, 0.0] + [1 + i / 1000 for i in range(2000)] + [-i / 7 for i in range(1, 500)]
    df = spark.createDataFrame([("a", v) for v in x], "k string, x double")
    bins = metrics._with_levels(df.withColumn("x", F.col("x")), "x")
    assert bins.groupBy("__b1", "__b2").count().agg(F.max("count")).first()[0] < 20
    order = [r["x"] for r in bins.orderBy("__b1", "__b2", "x").collect()]
    assert order == sorted(x)
    got = metrics.exact_percentiles(df, ["k"], "x", {"q": .5, "r": .99}).first()
    assert [got["q"], got["r"]] == pytest.approx(list(np.percentile(x, [50, 99])))


def test_boosting_goes_on_past_small_gains():
    slow = [1 - 0.001 * i for i in range(80)]  # every round gains far less than 1 %
    assert models.best_round(slow, 50) == 80
    assert models.best_round([3.0, 1.0, 2.0] + [1.5] * 60 + [0.5], 50) == 2
    assert models.best_round([3.0, 1.0, 2.0] + [1.5] * 30 + [0.5], 50) == 34


def test_models_beat_the_floor_and_score_everyone(planted):
    num, cat, _ = features.task_features("turnout", planted.columns)
    t = models.fit_turnout(planted, num, cat, iterations=5, depth=3)
    held = planted.filter("split = 'test' and y_turnout >= 0").withColumnRenamed("y_turnout", "y")

    def auc(model, n, c):
        return metrics.binary_metrics(models.predict(model, held, n, c).withColumn("p", F.get("probs", F.lit(1)))).first()["auc"]

    assert auc(t, num, cat) > auc(models.fit_age_floor(planted), ["age"], []) + .2
    assert models.feature_importances(t, 1)[0][0] == "hist_n_generals"
    pn, pc, _ = features.task_features("party", planted.columns)
    s = models.score_people(planted, t, models.fit_party(planted, pn, pc, trees=5, depth=4))
    assert s.count() == 1200 and s.filter("turnout_propensity is null or p_dem_lean is null").count() == 0


def test_codes_and_statistics(spark):
    df = spark.createDataFrame([(1, 1.0, "b", "train"), (2, None, None, "train"), (3, 5.0, "a", "train"), (4, 9.0, "c", "test")],
                               "id long, x double, c string, split string")
    codes = {r["c"]: r["c_code"] for r in features.encode_category(df, "c").collect()}
    assert codes == {"a": 1, "b": 2, "c": 3, "nan": 4}
    s = features.train_statistics(df, ["x"]).first()
    assert (s["median"], s["mean"], s["std"]) == (3.0, 3.0, 2.0)
    z = {r["id"]: r["x"] for r in features.standardize(df, ["x"], features.train_statistics(df, ["x"]), "id").collect()}
    assert z == {1: -1.0, 2: 0.0, 3: 1.0, 4: 3.0}
