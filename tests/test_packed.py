"""Metrics of packed scores, quantiles of counts, and preprocessing of all splits without copies of rows."""

from __future__ import annotations

import os

import numpy as np
import pytest

from pyspark.ml.feature import VectorAssembler

from tests.test_elastic_net import fits
from tests.test_nested import DATA, matrix
from tidemark import plans
from tidemark.operators import elastic_net, metrics, models, ranks
from tidemark.plans import evaluation


def test_packed_metrics_equal_those_of_rows(spark, monkeypatch):
    monkeypatch.setattr(metrics.ScorePacks, "LIMIT", 50)
    grid = models.elastic_net_grid([0.0, 1.0], [0.001, 1.0])  # the sparsest net scores all rows alike
    _, rows, pres, nets = fits(spark, grid)
    key = lambda r: (r["split"], r["config_id"])
    want = sorted(metrics.ranking_metrics(elastic_net.score_nets(rows, pres, nets, ["outcome"]), by=["split", "config_id"]).collect(), key=key)
    got = sorted(elastic_net.net_metrics(rows, pres, nets).collect(), key=key)
    assert len(got) == len(nets) and [key(r) for r in got] == [key(r) for r in want]
    for a, b in zip(got, want):
        assert a.asDict() == pytest.approx(b.asDict(), rel=1e-9)


def test_quantiles_of_counts(spark):
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=400), 4)
    n = rng.integers(0, 4, (400, 2))
    rows = [(int(i % 3), float(x), int(a), 0 if i % 3 == 1 else int(b)) for i, (x, (a, b)) in enumerate(zip(v, n))]
    qs = [0.0, 0.005, 0.5, 0.9, 1.0]
    got = ranks.quantiles_of_counts(spark.createDataFrame([*rows, (0, None, 5, 5)], "c int, v double, n0 long, n1 long"), "c", "v", ["n0", "n1"], qs)
    assert (1, 1) not in got and len(got) == 5
    for (c, i), found in got.items():
        own = [r for r in rows if r[0] == c]
        assert found == pytest.approx(np.quantile(np.repeat([r[1] for r in own], [r[2 + i] for r in own]), qs))


def test_buckets_are_the_same_in_every_evaluation(spark):
    """Sketches that are merged in another order have other quantiles; the rows here are dealt anew each time."""
    values = spark.range(600_000).selectExpr("0 AS c", "id * 0.001D AS v", "1L AS n0", "id % 2 AS n1", "reflect('java.lang.Math', 'random') AS r")
    rows = ranks.with_bucket(values.repartition(16, "r").drop("r"), ["c"], "v")
    found = [sorted(map(tuple, rows.groupBy("__bucket").count().collect())) for _ in range(2)]
    assert len(found[0]) == ranks.BUCKETS and found[0] == found[1]
    qs = [0.005, 0.5, 0.995]
    got = ranks.quantiles_of_counts(values.repartition(16, "r").drop("r"), "c", "v", ["n0", "n1"], qs)
    every = np.arange(600_000) * 0.001
    assert got[0, 0] == pytest.approx(np.quantile(every, qs)) and got[0, 1] == pytest.approx(np.quantile(every[1::2], qs))


def test_all_splits_learn_what_each_learns_alone(spark):
    df, _, pres, _ = fits(spark, models.elastic_net_grid([1.0], [0.1]))
    df = df.selectExpr("*", "3.5D AS same", "CASE WHEN outer_fold = 1 THEN x END AS rare", "CAST(NULL AS DOUBLE) AS none")
    rows = elastic_net.with_splits(df, [elastic_net.Split(f) for f in (1, 2)], {})
    columns = ["x", "z", "same", "rare", "none"]
    for fold, got in zip((1, 2), elastic_net.fit_preprocessors(rows, 2, columns, ["s"], True)):
        want = models.fit_preprocessor(df.where(f"outer_fold != {fold}"), columns, ["s"], True)
        assert got.names == want.names and got.categories == want.categories
        for c in columns:
            assert got.continuous[c] == pytest.approx(want.continuous[c], rel=1e-9, abs=1e-12)
        batch = df.toArrow().combine_chunks().to_batches()[0]
        x = elastic_net.design(batch, got)
        plain = np.array([r["features"].toArray() for r in want.transform(df, []).collect()])
        assert np.allclose(x[:, 1:], plain)


def test_few_rounds_are_trained_once(spark, monkeypatch):
    df = matrix(spark).selectExpr("double(outcome) AS label", "outer_fold", "x")
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    given, fit = [], models.fit_boosting
    monkeypatch.setattr(models, "fit_boosting", lambda r, c, n, seed: given.append(n) or fit(r, c, n, seed=seed))
    _, curve = models.fit_boosting_until(rows.where("outer_fold > 2"), rows.where("outer_fold <= 2"), models.boosting_grid([2], [0.03])[0], max_iter=6, patience=2)
    assert given == [6] and len(curve) == 6


def test_noise_does_not_select_the_refit(spark):
    """Configurations that rank alike go by their log loss, whatever the last bits of their means are."""
    rows = [(f, c, 0.5 + (1e-11 if c == 1 else 0.0), 0.3 + (0.1 if c == 1 else 0.0), 60.0) for f in (1, 2) for c in (1, 2)]
    tuning = spark.createDataFrame(rows, "outer_fold int, config_id int, mean_auprc double, mean_logloss double, median_iterations double")
    assert models.refit_selection(tuning).first()["config_id"] == 2


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_parts_share_one_computation_of_the_predictions(spark, monkeypatch):
    made = []
    monkeypatch.setattr(evaluation, "resume_parts", lambda s, path, parts, make, keys: made.append(make("m1", 1)) or s.createDataFrame([("m1", 1, 1)], "model_id string, outer_fold int, outcome int"))
    plans.queries()["a08_resumable_parts"](spark, DATA)
    assert "Exchange" not in made[-1]._jdf.queryExecution().executedPlan().toString()
