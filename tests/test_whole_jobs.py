"""Queries are registered over the whole job of their operators."""
import inspect

import duckdb
import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from wardline.operators import models
from wardline.plans import graph_queries, standin
from wardline.plans.catalog import REGISTRY
from wardline.plans.standin import Views

FOLDER = "/root/testdata/sf0.001"


def test_walks_take_all_steps(spark):
    v = Views(spark, FOLDER)
    cluster = {r["person_row"]: r["cluster"] for r in v.clusters.select("person_row", "cluster").collect()}
    at = {n: i for i, n in enumerate(cluster)}
    walk = np.zeros((len(at), len(at)))
    for u, w in v.directed_edges.select("u", "v").distinct().collect():
        if u in at and w in at and cluster[u] == cluster[w]:
            walk[at[u], at[w]] = 1
    walk /= np.maximum(walk.sum(1, keepdims=True), 1)
    power, want = np.eye(len(at)), []
    for _ in range(16):
        power = power @ walk
        want.append(np.diag(power))
    want = np.array(want).T
    assert want[:, 15].max() > 0
    for name in ("random_walk_encoding_all_steps", "random_walk_by_join_all_steps"):
        rows = REGISTRY[name].run(spark, FOLDER).collect()
        assert len(rows) == len(at)
        for r in rows:
            assert [r[f"rw{k}"] for k in range(1, 17)] == pytest.approx(want[at[r["person_row"]]], abs=2e-6)


def test_turnout_metrics_equal_those_of_the_written_predictions(spark, monkeypatch, tmp_path):
    """The whole query with 800 rounds allowed; its numbers recomputed by SQL from the predictions."""
    kept, build, fit = str(tmp_path / "predictions"), graph_queries.held_out_predictions, models.fit_turnout
    fits = []

    def written(v):
        build(v).write.parquet(kept)
        return spark.read.parquet(kept)

    def recorded(*args, **kw):
        bound = inspect.signature(fit).bind(*args, **kw)
        bound.apply_defaults()
        fits.append([bound.arguments[k] for k in ("iterations", "depth", "patience")])
        return fit(*args, **kw)
    monkeypatch.setattr(graph_queries, "held_out_predictions", written)
    monkeypatch.setattr(models, "fit_turnout", recorded)
    got = {(r["model"], r["metric"]): r["value"] for r in REGISTRY["turnout_model"].run(spark, FOLDER).collect()}
    want = duckdb.sql(f"""
        WITH p AS (SELECT *, greatest(1e-15, least(1 - 1e-15, p)) AS c FROM '{kept}/*.parquet'),
        auc AS (SELECT a.model, avg(CASE WHEN a.p > b.p THEN 1 WHEN a.p = b.p THEN 0.5 ELSE 0 END) AS auc
          FROM p a JOIN p b ON a.model = b.model AND a.y = 1 AND b.y = 0 GROUP BY 1)
        SELECT model, auc, avg(-(y * ln(c) + (1 - y) * ln(1 - c))), avg((y - p) * (y - p)), avg(y), count(*) FROM p JOIN auc USING (model) GROUP BY 1, 2""").fetchall()
    assert fits == [[800, 6, 50]] and {m for m, *_ in want} == {"boosted", "age_floor"}
    for model, *values in want:
        assert [got[model, k] for k in ("auc", "log_loss", "brier", "base_rate", "n")] == pytest.approx(values, abs=2e-6)


def test_first_rounds_are_the_model_of_fewer_rounds(spark, tmp_path):
    n = F.col("id")
    df = spark.range(400).select(array_to_vector(F.array((n * 7 % 13).cast("double"), (n % 5).cast("double"))).alias("features"),
                                 ((n * 7 % 13 + n % 3) > 6).cast("double").alias("label"))
    boosted = GBTClassifier(maxIter=6, maxDepth=2, seed=1)
    long, short = boosted.fit(df), boosted.setMaxIter(3).fit(df)
    cut = models.first_rounds(long, 3)
    assert cut.getNumTrees == 3 and cut.evaluateEachIteration(df) == pytest.approx(long.evaluateEachIteration(df)[:3])
    PipelineModel([cut]).write().save(str(tmp_path / "m"))
    cut = PipelineModel.load(str(tmp_path / "m"))

    def scores(m):
        return [r[0][1] for r in m.transform(df).select("probability").collect()]
    assert scores(cut) == pytest.approx(scores(short), abs=1e-12)


def test_rounds_are_fitted_until_the_patience_is_used_up(spark, monkeypatch):
    """Whatever was fitted on the way, the model is the one of all rounds looked through with patience."""
    fitted = []

    class Fake:
        def __init__(self, **kw):
            fitted.append(kw["maxIter"])

        def fit(self, train):
            return self

        def evaluateEachIteration(self, val):
            return ([1 / (i + 1) for i in range(90)] + [1.0] * 710)[:fitted[-1]]
    monkeypatch.setattr(models, "GBTClassifier", Fake)
    monkeypatch.setattr(models, "PipelineModel", lambda stages: stages[-1])
    monkeypatch.setattr(models, "first_rounds", lambda model, n: n)
    df = spark.createDataFrame([(k, 20 + k, k % 2, s) for k, s in enumerate(["train"] * 6 + ["val"] * 3)], "person_row int, age int, y_turnout int, split string")
    assert models.fit_turnout(df, ["age"], []) == 90 and fitted == [63, 126, 252]
    fitted.clear()
    assert models.fit_turnout(df.filter("split = 'train'"), ["age"], []) == 800 and fitted == [800]


def test_training_rows_are_bounded_and_wide_categories_are_means(spark):
    n = F.col("id")
    df = spark.range(3000).select(n.alias("person_row"), (n % 90).cast("string").alias("zip_code"), (n % 3).cast("string").alias("party"),
                                  (n % 90 > 60).cast("int").alias("y_turnout"), F.when(n % 10 == 9, "val").otherwise("train").alias("split"))
    some = models.bounded(df, 600)
    assert 450 < some.count() < 750 and some.collect() == models.bounded(df, 600).collect()
    assert models.bounded(df, 3000).count() == 3000
    model = models.fit_turnout(df, [], ["zip_code", "party"], iterations=2, depth=2)
    assert models.feature_importances(model, 1)[0][0] == "zip_code"
    new = df.limit(1).withColumn("zip_code", F.lit("never seen"))
    assert 0 <= models.predict(model, new, [], ["zip_code", "party"]).first()["probs"][1] <= 1


def test_backtest_returns_importances(spark):
    n = F.col("person_row")
    people = spark.range(300).select(F.col("id").alias("person_row"), (F.col("id") % 7).cast("string").alias("ed_key"),
                                     F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("split"), F.lit("DEM").alias("party"))

    def history(year):
        more = [(n * (k + 3) % 11).alias(f"hist_x{k}") for k in range(12)]
        return people.select(n, (n % 5).alias("hist_n_generals"), F.lit(40).alias("hist_age_at_target"), *more,
                             (n % 5 > 2).cast("int").alias(f"y_voted_general_{year}"))
    got = {r["metric"]: r for r in models.backtest(people, history(1998), history(2000), 1998, 2000, 2002, iterations=2).collect()}
    top = {m: r["forward"] for m, r in got.items() if m.startswith("importance_")}
    assert len(top) == 10 and max(top, key=top.get) == "importance_hist_n_generals"
    assert "auc" in got


def test_feature_queries_take_all_numeric_features(spark):
    v = Views(spark, FOLDER)
    t = graph_queries.model_table(v).toPandas()
    got = {q: REGISTRY[q + "_all_features"].run(spark, FOLDER).toPandas() for q in ("feature_aucs", "train_statistics", "standardized_features")}
    names = set(graph_queries._numeric_features(graph_queries.model_table(v)))
    assert len(names) > 40 and {"hist_n_votes", "hist_trend_3v5", "fec_total", "ed_dem_share_excl"} <= names
    for rows in got.values():
        assert set(rows.feature) == names
    assert len(got["standardized_features"]) == len(names) * len(t)
    for r in got["train_statistics"].itertuples():
        x = t[r.feature].astype(float)
        train = x[t.split == "train"]
        if train.notna().any():
            train = train.fillna(train.median())
            std = train.std() or 1.0
            assert (r.mean, r.std) == pytest.approx((train.mean(), std), abs=2e-6)
            z = got["standardized_features"].query("feature == @r.feature").set_index("person_row").z
            want = ((x.fillna(x[t.split == "train"].median()) - train.mean()) / std).set_axis(t.person_row)
            assert z.sort_index().tolist() == pytest.approx(want.sort_index().tolist(), abs=2e-5)
    own = t[t.y_turnout >= 0]
    for r in got["feature_aucs"].itertuples():
        x = own[r.feature].astype(float)
        x = x.fillna(x.min()).fillna(0.0).to_numpy()
        a, b = x[own.y_turnout == 1], x[own.y_turnout == 0]
        less = (a[:, None] > b).mean() + (a[:, None] == b).mean() / 2
        assert r.auc == pytest.approx(less, abs=2e-6) and r.n == len(own)


def test_place_classification_takes_all_parties(spark):
    keys = {r["key"] for r in REGISTRY["place_classification_all_parties"].run(spark, FOLDER).select("key").collect()}
    parties = {r["party"] for r in Views(spark, FOLDER).people.collect() if r["person_row"] in keys}
    assert len(parties) > 1


def test_model_table_is_made_in_steps(spark, monkeypatch):
    """No plan of the model table reads customers again and again, or holds most stages at once."""
    plans, keep = [], graph_queries.cut

    def seen(df):
        plans.append((df._jdf.queryExecution().optimizedPlan().toString().count("Relation [c_custkey"),
                      df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")))
        return keep(df)
    monkeypatch.setattr(graph_queries, "cut", seen)
    monkeypatch.setattr(standin, "cut", seen)
    assert graph_queries.model_table(Views(spark, FOLDER)).count() == 150
    assert sum(n for n, _ in plans) == 1 and max(n for _, n in plans) < 16
