"""The registered bootstraps draw 1,000 replicates, each equal to weighted metrics."""

from __future__ import annotations

import inspect
import os

import pytest
from pyspark.sql import functions as F

from tests.test_evaluation import preds
from tidemark import plans
from tidemark.operators import bootstrap, metrics
from tidemark.plans import evaluation

DATA = "/root/testdata/sf0.001"


def test_replicates_equal_weighted_metrics(spark):
    """Every replicate's metrics are those of the rows weighted by its draws."""
    df, _, _ = preds(spark)
    df = df.withColumn("part", F.col("landmark_h") % 8)
    got = {(r.replicate, r.part, r.metric): (r.reference, r.candidate) for r in bootstrap.bootstrap(df, [("m1", "m2")], replicates=3, seed=3, by=["part"]).collect()}
    weights = bootstrap.cluster_weights(df, "cluster_key", range(3), 3)
    want = metrics.ranking_metrics(df.join(weights, "cluster_key"), weight="weight", by=["model_id", "part", "replicate"]).collect()
    assert len(got) == 4 * len(want) // 2
    for r in want:
        for m in metrics.METRICS:
            assert got[r.replicate, r.part, m][r.model_id == "m2"] == pytest.approx(r[m], rel=1e-9)


def test_replicates_are_the_default():
    assert evaluation.REPLICATES == inspect.signature(bootstrap.bootstrap).parameters["replicates"].default == 1000


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_all_replicates_and_scenario_results(spark):
    assert plans.queries()["n01_cluster_weights"](spark, DATA).select("replicate").distinct().count() == 1000
    assert {r.scenario for r in plans.queries()["p06_scenario_utility"](spark, DATA).collect()} == {"all", "late"}
    assert {"scenario", "model_id", "calibration_slope"} <= set(plans.queries()["p06_scenario_calibration"](spark, DATA).columns)
