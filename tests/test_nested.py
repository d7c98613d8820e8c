"""Nested cross-validation scores the whole matrix."""

from __future__ import annotations

import os

import numpy as np
import pytest

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tidemark import plans
from tidemark.operators import models
from tidemark.plans import evaluation

DATA = "/root/testdata/sf0.001"


def matrix(spark, n_folds=5):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        x = rng.normal()
        rows.append((f"e{i}", f"c{i % 30}", i % 30 % n_folds + 1, int(rng.uniform() < 1 / (1 + np.exp(-2 * x))), float(x)))
    return spark.createDataFrame(rows, "entity_key string, cluster_key string, outer_fold int, outcome int, x double")


def test_all_outer_folds_are_scored(spark):
    df, grid = matrix(spark, 3), models.elastic_net_grid([0.5], [1.0])
    found = models.nested_cv(df, ["entity_key"], "cluster_key", ["x"], [], grid, models.fit_elastic_net)
    scored = found.predictions.toPandas()
    assert sorted(scored.entity_key) == sorted(f"e{i}" for i in range(300)) and set(scored.outer_fold) == {1, 2, 3}
    assert {r.inner_folds for r in found.tuning.collect()} == {3}
    with pytest.raises(ValueError, match="outer folds"):
        models.nested_cv(df, ["entity_key"], "cluster_key", ["x"], [], grid, models.fit_elastic_net, [1, 2])


def test_lost_and_repeated_predictions_are_errors(spark):
    df = matrix(spark)
    assert models.reconcile(df, df, ["entity_key"]) is df
    for wrong in (df.where("entity_key != 'e3'"), df.union(df.where("entity_key = 'e3'"))):
        with pytest.raises(ValueError, match="exactly once"):
            models.reconcile(wrong, df, ["entity_key"])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_registered_queries_score_the_matrix(spark, monkeypatch):
    assert len(evaluation.ELASTIC_NET_GRID) == 25
    assert len(evaluation.BOOSTING_GRID) == 6
    monkeypatch.setattr(evaluation, "ELASTIC_NET_GRID", evaluation.ELASTIC_NET_GRID[:1])
    monkeypatch.setattr(evaluation, "BOOSTING_GRID", evaluation.BOOSTING_GRID[:1])
    want = evaluation._model_matrix(spark, DATA).count()
    for name in ("l07_elastic_net_nested_cv", "l11_ablation_refit", "l05_l06_boosting_nested_cv"):
        found = plans.queries()[name](spark, DATA).persist()
        assert found.count() == want and {r.outer_fold for r in found.select("outer_fold").distinct().collect()} == {1, 2, 3, 4, 5}
    assert plans.queries()["l08_l13_selected_configs"](spark, DATA).where("consistent").count() == 5
    best = plans.queries()["l09_refit_selection"](spark, DATA).first()
    assert evaluation.BOOSTING_ROUNDS[0] <= best.refit_iterations <= evaluation.BOOSTING_ROUNDS[1]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_registered_boosting_has_all_rounds(spark, monkeypatch):
    """The registered queries give the learner the reference's rounds and patience, and refits their clamp."""
    given = []

    def nested(rows, keys, cluster, features, categorical, grid, max_iter=700, least=50, patience=75, **_):
        given.append((len(grid), max_iter, least, patience))
        scored = rows.select(*keys, "outer_fold", "outcome", F.lit(0.5).alias("probability"))
        tuned = spark.createDataFrame([(f, c.config_id, 0.5, 0.3, 9.0, 1) for f in (1, 2, 3, 4, 5) for c in grid], "outer_fold int, config_id int, mean_auprc double, mean_logloss double, median_iterations double, selected int")
        return models.NestedResult(scored, tuned, None)

    monkeypatch.setattr(evaluation, "_RESULTS", {})
    monkeypatch.setattr(models, "nested_boosting", nested)
    rounds = []
    monkeypatch.setattr(models, "fit_boosting", lambda rows, config, max_iter, **_: rounds.append(max_iter) or models.GBTClassifier(labelCol="label", maxDepth=1, maxIter=1).fit(rows))
    assert plans.queries()["l05_l06_boosting_nested_cv"](spark, DATA).count() > 0
    assert plans.queries()["l09_refit_selection"](spark, DATA).first().refit_iterations == 50
    assert plans.queries()["l06_boosting_transport"](spark, DATA).count() > 0
    assert plans.queries()["l14_saved_model"](spark, DATA).count() > 0
    assert given == [(6, 700, 50, 75)] and rounds == [50, 50]


def test_early_stopping_and_refit(spark):
    """Boosted trees stop on the inner held-out rows, and the refit takes their clamped median iterations."""
    assert models.clamped_median([3, 900, 901], 50, 700) == 700 and models.clamped_median([3, 4], 1, 9) == 3 and models.clamped_median([1], 5, 9) == 5
    df, given = matrix(spark, 2), []

    def learner(rows, config, n, validation=None, iterations=None):
        given.append((validation, iterations, rows.count(), n))
        return models.fit_boosting(rows, config, iterations or 4, validation)

    grid = models.boosting_grid([2], [0.3])
    found = models.nested_cv(df, ["entity_key"], "cluster_key", ["x"], [], grid, learner, n_inner=2, early_stop=(1, 4))
    tuned = {r.outer_fold: r.median_iterations for r in found.tuning.collect()}
    assert found.predictions.count() == 300 and len(given) == 6
    assert all(n < total for v, _, total, n in given if v) and sorted(i for v, i, _, _ in given if not v) == sorted(int(x) for x in tuned.values())


def test_stopping_reads_the_curve_like_a_loop():
    def loop(curve, patience):
        best, since = 0, 0
        for i in range(1, len(curve)):
            if curve[i] < curve[best]:
                best, since = i, 0
            else:
                since += 1
                if since == patience:
                    break
        return best + 1

    rng = np.random.default_rng(4)
    for _ in range(300):
        curve = list(np.round(rng.normal(size=rng.integers(1, 30)).cumsum(), 1))
        for patience in (1, 2, 5, 75):
            assert models.stop_at(curve, patience) == loop(curve, patience)


def test_rounds_come_from_the_validation_curve(spark):
    """The curve is that of the models of 1, 2, … rounds; the model kept is that of its best round, whatever the first budget was."""
    df = matrix(spark).withColumnRenamed("outcome", "label").withColumn("label", F.col("label").cast("double"))
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    train, held = rows.where("outer_fold > 2"), rows.where("outer_fold <= 2")
    config = models.boosting_grid([2], [0.6])[0]
    model, curve = models.fit_boosting_until(train, held, config, max_iter=12, patience=2)
    assert model.getNumTrees == models.stop_at(curve, 2)

    def loss(n):
        p = models.scores(models.fit_boosting(train, config, n), held, ["label"]).toPandas()
        margin = np.log(p.probability / (1 - p.probability)) / 2
        return float(np.mean(2 * np.log1p(np.exp(-2 * margin * (2 * p.label - 1)))))

    plain = [loss(n) for n in range(1, model.getNumTrees + 1)]
    assert np.allclose(curve[: len(plain)], plain, rtol=1e-6)
    a = models.scores(model, held, ["entity_key"]).toPandas().sort_values("entity_key").probability
    b = models.scores(models.fit_boosting(train, config, model.getNumTrees), held, ["entity_key"]).toPandas().sort_values("entity_key").probability
    assert np.allclose(a.to_numpy(), b.to_numpy())
    again, longer = models.fit_boosting_until(train, held, config, max_iter=12, patience=3)
    assert again.getNumTrees == models.stop_at(longer, 3)


def test_ties_prefer_sparse_strong_and_shallow():
    nets, trees = models.elastic_net_grid([0.0, 1.0], [0.1, 1.0]), models.boosting_grid([4, 6], [0.03, 0.07])
    tied = lambda grid: [(1, 0, c.config_id, 0.5, 0.3, 1, 1, 0.5) for c in grid]
    best = models._best(tied(nets), nets)
    assert (best["l1_ratio"], best["C"]) == (1.0, 0.1) and models._best(tied(trees), trees).config_id == 1
