"""Nets with a level table: equal to the dense ones, and fitted to 100,000 levels."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import elastic_net as en
from tidemark.operators import models, wide_nets
from tidemark.operators.models import MISSING


def _rows(spark, n=400):
    rng = np.random.default_rng(8)
    levels = [*"abcdef", None]
    effect = dict(zip(levels, rng.normal(0, 1.5, len(levels))))
    rows = []
    for i in range(n):
        level = levels[min(int(rng.exponential(1.6)), 6)]
        x, z = rng.normal(), rng.normal()
        p = 1 / (1 + np.exp(-(0.8 * x - 0.4 * z + effect[level])))
        rows.append((i, float(x), float(z), level, "uv"[i % 2], int(rng.uniform() < p)))
    return spark.createDataFrame(rows, "id long, x double, z double, level_ string, small string, outcome int").withColumn("outer_fold", F.lit(0))


@pytest.mark.parametrize(("l1_ratio", "c"), [(0.0, 0.3), (0.5, 0.05)])
def test_weights_equal_the_dense_ones(spark, l1_ratio, c):
    df, config = _rows(spark), models.elastic_net_grid([l1_ratio], [c])[0]
    rows = en.with_splits(df, [en.Split(-1)], {})
    pres = en.fit_preprocessors(rows, 1, ["x", "z"], ["small", "level_"])
    dense = en.fit_paths(rows, pres, {0: [config]}, max_iter=100, tolerance=1e-8)[0]
    want = dict(zip(["", *pres[0].names], dense.weights))
    pre = models.Preprocessor(pres[0].continuous, {"small": pres[0].categories["small"]})
    net = wide_nets.fit_wide_net(df, pre, "level_", config, tolerance=1e-7)
    got = dict(zip(["", *pre.names], net.dense)) | {f"level_={r.level}": r.w for r in net.levels.collect()}
    assert set(want) - set(got) == {"level_=__OTHER__"} and f"level_={MISSING}" in got
    for name, w in got.items():
        assert w == pytest.approx(want[name], abs=2e-5), name
    scored = {r.id: r.probability for r in wide_nets.score_wide_net(df, net, ["id"]).collect()}
    for r in en.score_nets(rows.withColumn("__held", F.array(F.lit(0))), pres, [dense], ["id"]).collect():
        assert scored[r.id] == pytest.approx(r.probability, abs=1e-5)


def test_unknown_levels_add_no_weight(spark):
    df, config = _rows(spark, 200), models.elastic_net_grid([0.0], [0.3])[0]
    pre = models.fit_preprocessor(df, ["x"])
    net = wide_nets.fit_wide_net(df, pre, "level_", config)
    new = spark.createDataFrame([(1, 0.5, "unseen"), (2, None, "unseen")], "id long, x double, level_ string")
    for r in wide_nets.score_wide_net(new, net, ["id", "x"]).collect():
        median, _, _, mean, scale = pre.continuous["x"]
        z = net.dense[0] + net.dense[1] * ((median if r.x is None else r.x) - mean) / scale
        assert r.probability == pytest.approx(1 / (1 + np.exp(-z)))


def test_a_hundred_thousand_levels(spark):
    rows = spark.range(250_000).select(
        "id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 500.0 - 1).alias("x"),
        # A third of the rows have one level.
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 100_003)).alias("level_"),
    )
    good = F.pmod(F.xxhash64(F.lit(7), "level_"), F.lit(10)) < 5
    rows = rows.withColumn("outcome", (F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(100)) < F.when(good, 70).otherwise(20) + 20 * F.col("x")).cast("int"))
    pre = models.fit_preprocessor(rows, ["x"])
    net = wide_nets.fit_wide_net(rows, pre, "level_", models.elastic_net_grid([0.0], [1.0])[0], tolerance=1e-4)
    assert net.levels.count() > 90_000 and net.dense[1] > 0.2
    apart = net.levels.withColumn("good", F.pmod(F.xxhash64(F.lit(7), "level"), F.lit(10)) < 5).groupBy("good").agg(F.avg("w").alias("w")).collect()
    means = {r.good: r.w for r in apart}
    assert means[True] > means[False] + 0.3
