"""Outcomes, folds, metrics, calibration, bootstrap, models: brute force and edge cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bootstrap, calibration, folds, joins, metrics, models, outcome, quality, scenarios, spine
from tidemark.spec import WindowSpec


def preds(spark, n=400, seed=1, groups=8):
    rng = np.random.default_rng(seed)
    p = np.round(rng.uniform(0.02, 0.98, n), 2)
    y = (rng.uniform(size=n) < p**1.5).astype(int)
    rows = [(f"e{i % 40}", int(24 + 4 * (i // 40)), f"c{i % groups}", i % groups % 4 + 1, int(y[i]), m, float(q)) for i in range(n) for m, q in (("m1", p[i]), ("m2", round(float(p[i]) ** 2, 3)))]
    return spark.createDataFrame(rows, "entity_key string, landmark_h long, cluster_key string, outer_fold int, outcome int, model_id string, probability double"), p, y


def auroc(y, p, w=None):
    w = np.ones(len(y)) if w is None else w
    pos, neg = y == 1, y == 0
    wins = (p[pos][:, None] > p[neg][None]) + 0.5 * (p[pos][:, None] == p[neg][None])
    return (wins * w[pos][:, None] * w[neg][None]).sum() / (w[pos].sum() * w[neg].sum())


def average_precision(y, p):
    out, tp, n = 0.0, 0, 0
    for s in sorted(set(p), reverse=True):
        at = p == s
        tp, n = tp + y[at].sum(), n + at.sum()
        out += y[at].sum() * tp / n
    return out / y.sum()


def test_metrics_equal_brute_force(spark):
    df, p, y = preds(spark)
    m = metrics.ranking_metrics(df.where("model_id = 'm1'")).first()
    assert m.auroc == pytest.approx(auroc(y, p), abs=1e-12)
    assert m.auprc == pytest.approx(average_precision(y, p), abs=1e-12)
    assert m.brier == pytest.approx(np.mean((y - p) ** 2))
    assert m.logloss == pytest.approx(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


def test_weighted_metrics_equal_repeated_rows(spark):
    df, _, _ = preds(spark)
    one = df.where("model_id = 'm1'").withColumn("w", F.when(F.col("landmark_h") == 24, 3.0).otherwise(1.0))
    more = one.withColumn("w", F.explode(F.array_repeat(F.lit(1.0), F.col("w").cast("int"))))
    a, b = metrics.ranking_metrics(one, weight="w").first(), metrics.ranking_metrics(more, weight="w").first()
    assert a.asDict() == pytest.approx(b.asDict())


def test_one_class_and_equal_scores(spark):
    df = spark.createDataFrame([("a", 1, 0.3), ("a", 1, 0.4), ("b", 1, 0.5), ("b", 0, 0.5)], "g string, outcome int, probability double")
    got = {r.g: r for r in metrics.ranking_metrics(df, by=["g"]).collect()}
    assert got["a"].auroc is None and got["a"].events == 2
    assert got["b"].auroc == 0.5 and got["b"].auprc == 0.5


def test_rank_bins_follow_quantile_edges(spark):
    df = spark.range(208).select(F.col("id").alias("k"), F.col("id").alias("v"))
    sizes = {r["bin"]: r["count"] for r in metrics.rank_bins(df, "k", "v", 3).groupBy("bin").count().collect()}
    assert sizes == {1: 69, 2: 69, 3: 70}


def test_calibration_solves_its_equations(spark):
    df, p, y = preds(spark)
    got = {r.model_id: r for r in calibration.calibration(df).collect()}["m1"]
    lp = np.log(p / (1 - p))
    assert np.sum(y - 1 / (1 + np.exp(-(lp + got.calibration_in_the_large)))) == pytest.approx(0, abs=1e-6)
    r = y - 1 / (1 + np.exp(-(got.calibration_intercept + got.calibration_slope * lp)))
    assert (np.sum(r), np.sum(r * lp)) == pytest.approx((0, 0), abs=1e-6)
    assert got.status == "converged" and got.oe_ratio == pytest.approx(y.mean() / p.mean())


def test_calibration_of_degenerate_groups(spark):
    df = spark.createDataFrame([("one", 1, 0.2), ("one", 1, 0.3), ("flat", 1, 0.5), ("flat", 0, 0.5)], "model_id string, outcome int, probability double")
    got = {r.model_id: r for r in calibration.calibration(df).collect()}
    assert got["one"].status == "one_class" and got["one"].calibration_slope is None
    assert got["flat"].status == "not_estimable" and got["flat"].calibration_in_the_large == pytest.approx(0)


def test_crossfit_leaves_the_fold_out(spark):
    df, p, y = preds(spark)
    rows = df.where("model_id = 'm1'")
    params = {(r.outer_fold, r.update_type): r for r in calibration.calibrators(rows, ["model_id"], "outer_fold").collect()}
    fold = np.array([i % 8 % 4 + 1 for i in range(400)])
    for f in (1, 4):
        lp = np.log(p / (1 - p))[fold != f]
        c = params[(f, "intercept")]
        assert np.sum(y[fold != f] - 1 / (1 + np.exp(-(lp + c.a)))) == pytest.approx(0, abs=1e-6)
    out = calibration.crossfit_recalibrate(rows)
    assert {r["update_type"]: r["count"] for r in out.groupBy("update_type").count().collect()} == {"raw": 400, "intercept": 400, "intercept_slope": 400}


def test_calibration_bins_drop_equal_edges(spark):
    df = spark.createDataFrame([("m", 0, 0.1)] * 8 + [("m", 1, 0.9), ("m", 0, 0.95)], "model_id string, outcome int, probability double")
    got = sorted((r.risk_bin, r.n) for r in calibration.calibration_bins(df).collect())
    assert sum(n for _, n in got) == 10 and got[0] == (1, 8)


def test_alert_episodes(spark):
    rows = [("a", 24), ("a", 28), ("a", 36), ("a", 48), ("b", 24)]
    df = spark.createDataFrame([("m", e, h, 1, 0.9) for e, h in rows] + [("m", "c", 24, 0, 0.1)], "model_id string, entity_key string, landmark_h long, outcome int, probability double")
    got = calibration.decision_curve(df, [0.5]).first()
    assert (got.tp, got.fp, got.fn, got.tn, got.episodes, got.alerted_entities) == (5, 0, 0, 1, 3, 2)


def test_greedy_folds(spark):
    rows = [("9", 5, 2, 50), ("10", 5, 2, 50), ("2", 1, 1, 10), ("3", 0, 0, 40), ("4", 0, 0, 5)]
    df = spark.createDataFrame(rows, "cluster_key string, n_events long, n_event_entities long, n_rows long")
    got = {r.cluster_key: r.outer_fold for r in folds.greedy_folds(df, 2).collect()}
    assert got == {"10": 1, "9": 2, "2": 1, "3": 2, "4": 1}


def test_graded_outcomes_and_boundaries(spark):
    s = spark.createDataFrame([("a", 24, 90.0, None), ("b", 24, 90.0, None), ("c", 24, 90.0, None), ("d", 24, 90.0, None)], "entity_key string, landmark_h long, exit_h double, death_h double")
    strict = spark.createDataFrame([("a", 24.0), ("b", 48.0)], "entity_key string, event_h double")
    broad = spark.createDataFrame([("b", 30.0), ("c", 30.0), ("c", 30.0)], "entity_key string, event_h double")
    w = outcome.window_evidence(outcome.window_evidence(outcome.horizons(s, [24], {24: [72]}), strict, "strict"), broad, "broad")
    g = outcome.grade_outcome(w, [("strict_first_h", "A", 1), ("broad_first_h", "Unknown", 9)])
    got = {(r.entity_key, r.horizon_h): (r.outcome, r.broad_rows, r.broad_times) for r in g.collect()}
    assert got[("a", 24)][0] == 0 and got[("b", 24)][0] == 1 and got[("c", 24)] == (9, 2, 1) and got[("d", 72)][0] == 0


def test_competing_events(spark):
    rows = [(30.0, 30.0, None), (30.0, 30.5, None), (40.0, 30.0, None), (30.0, 90.0, 29.0), (24.0, 90.0, None), (48.0, 90.0, None)]
    df = spark.createDataFrame([(24, 48, *r) for r in rows], "landmark_h long, end_h long, death_h double, exit_h double, event_h double")
    kinds = lambda tolerance: [r.competing_event_type for r in outcome.competing_event(df, "event_h", tolerance_h=tolerance).collect()]
    assert kinds(0) == ["both_same_time", "death", "death", "none", "none", "death"]
    assert kinds(1)[1] == "both_same_time"
    # A death goes before an earlier discharge; a discharge counts where the death is after the horizon or the event.
    rows = [(20.0, 15.0, None), (70.0, 15.0, None), (20.0, 15.0, 18.0), (20.0, 19.0, 18.0), (20.0, 20.0 + 1 / 120, None)]
    df = spark.createDataFrame([(10, 34, *r) for r in rows], "landmark_h long, end_h long, death_h double, exit_h double, event_h double")
    assert kinds(1 / 60) == ["death", "discharge", "discharge", "none", "both_same_time"]


def test_corroborated_starts_match_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = sorted({("a", float(round(t * 4) / 4), d, lab) for t, d, lab in zip(rng.uniform(0, 60, 40), rng.choice(["x", "y"], 40), rng.choice(["p", "q"], 40))})
    df = spark.createDataFrame(rows, "entity_key string, event_h double, domain string, label string")
    want = {}
    for _, t, d, lab in rows:
        near = [r for r in rows if abs(r[1] - t) <= 6]
        others = {r[2] for r in near} - {d}
        if others:
            want[t] = max(want.get(t, 0), len(others))
        for r in near:
            if r[2] == d and r[3] != lab:
                want[max(t, r[1])] = max(want.get(max(t, r[1]), 0), 1)
    assert {r.event_h: r.n_domains for r in outcome.corroborated_starts(df, df, 6.0).collect()} == want


def test_validated_merges(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    with pytest.raises(ValueError):
        joins.merge_one_to_one(a, a.union(a).withColumnRenamed("a", "b"), ["k"])
    with pytest.raises(ValueError):
        joins.merge_one_to_one(a, a.where("k = 1").withColumnRenamed("a", "b"), ["k"])


def test_failed_assertion_stops_the_job(spark):
    found = quality.check(spark.range(3), {"few rows": (F.count(F.lit(1)) < 2, F.count(F.lit(1)))})
    assert [tuple(r) for r in found.collect()] == [("few rows", False, "3")]
    with pytest.raises(Exception, match="few rows"):
        quality.enforce(found).collect()


def test_schema_guard_fires(spark):
    df = spark.createDataFrame([(1, 2)], "hr_latest int, outcome_24h int")
    assert [r.name for r in quality.schema_guard(df, "(outcome|label)").collect()] == ["outcome_24h"]


def test_bootstrap_weights_and_intervals(spark):
    df, p, y = preds(spark)
    weights = bootstrap.cluster_weights(df, "cluster_key", range(5), 3)
    assert {r["sum"] for r in weights.groupBy("replicate").agg(F.sum("weight").alias("sum")).collect()} == {8}
    ci = {r.metric: r for r in bootstrap.percentile_ci(bootstrap.bootstrap(df, [("m1", "m2")], replicates=40, seed=3)).collect()}
    point = metrics.ranking_metrics(df.where("model_id = 'm1'")).first()
    assert ci["auroc"].replicates == 40 and ci["auroc"].reference_low <= point.auroc <= ci["auroc"].reference_high
    assert ci["auroc"].difference_low == pytest.approx(0, abs=0.02)


def test_preprocessor(spark):
    rows = [(float(i), None if i % 5 == 0 else float(i % 7), None, "x" if i % 2 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "a double, b double, c double, s string")
    pre = models.fit_preprocessor(df, ["a", "b", "c"], ["s"])
    out = df.select(*(c.alias(n) for n, c in pre.columns().items())).toPandas()
    assert list(out.columns) == ["a", "b", "c", "s=__MISSING__", "s=x", "s=__OTHER__"]
    a = np.clip(np.arange(100.0), *np.quantile(np.arange(100.0), [0.005, 0.995]))
    assert out["a"].to_numpy() == pytest.approx((a - a.mean()) / a.std())
    assert (out["c"] == 0).all() and out["b"].mean() == pytest.approx(0)
    other = spark.createDataFrame([(1.0, 1.0, 1.0, "new")], "a double, b double, c double, s string")
    assert other.select(pre.columns()["s=__OTHER__"]).first()[0] == 1.0


def test_nested_cv_scores_every_row_once(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(240):
        x = rng.normal()
        rows.append((f"e{i}", f"c{i % 24}", i % 24 % 2 + 1, int(rng.uniform() < 1 / (1 + np.exp(-2 * x))), float(x), float(rng.normal())))
    df = spark.createDataFrame(rows, "entity_key string, cluster_key string, outer_fold int, outcome int, x double, z double")
    found = models.nested_cv(df, ["entity_key"], "cluster_key", ["x", "z"], [], models.elastic_net_grid([0.5], [0.1, 1.0]), models.fit_elastic_net, [1, 2], n_inner=2)
    scored = found.predictions.toPandas()
    assert sorted(scored.entity_key) == sorted(f"e{i}" for i in range(240)) and scored.probability.between(0, 1).all()
    assert auroc(scored.outcome.to_numpy(), scored.probability.to_numpy()) > 0.7
    assert models.config_audit(found.tuning, found.predictions).where("NOT consistent").isEmpty()
    stable = {r.feature: r for r in models.coefficient_stability(found.coefficients).collect()}
    assert stable["x"].median_coefficient > 0 and stable["x"].sign_consistency_nonzero == 1


def test_model_round_trip(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegressionModel

    rng = np.random.default_rng(1)
    rows = [(f"e{i}", int(rng.uniform() < 1 / (1 + np.exp(-3 * x))), float(x)) for i, x in enumerate(rng.normal(size=60))]
    df = spark.createDataFrame(rows, "entity_key string, outcome int, x double")
    config = models.elastic_net_grid([0.0], [1.0])[0]
    scored, model = models.transport(df, df, ["x"], [], config, models.fit_elastic_net, ["entity_key"])
    models.save_model(model, f"{tmp_path}/model")
    again = models.load_model(LogisticRegressionModel, f"{tmp_path}/model")
    assert again.coefficients.toArray().tolist() == model.coefficients.toArray().tolist() and scored.count() == 60


def test_refit_selection(spark):
    rows = [(1, 1, 0.5, 0.3, 40.0), (2, 1, 0.6, 0.3, 44.0), (1, 2, 0.7, 0.2, 900.0), (2, 2, 0.8, 0.2, 901.0), (1, 3, 0.99, 0.1, 10.0)]
    df = spark.createDataFrame(rows, "outer_fold int, config_id int, mean_auprc double, mean_logloss double, median_iterations double")
    best = models.refit_selection(df).first()
    assert (best.config_id, best.refit_iterations) == (2, 700)


def test_scenarios_copy_rows(spark):
    df = spark.createDataFrame([(1,), (0,), (9,)], "outcome int")
    got = scenarios.apply_scenarios(df, [scenarios.Scenario("s", F.col("outcome") != 9, F.col("outcome") == 1), scenarios.Scenario("p", F.lit(True), F.col("outcome") != 0)])
    assert sorted((r.scenario, r.outcome) for r in got.collect()) == [("p", 0), ("p", 1), ("p", 1), ("s", 0), ("s", 1)]


def test_assertions_observed_while_writing(spark):
    df = spark.createDataFrame([("v", 1.0), ("v", None), ("w", None)], "variable string, x double")
    rules = quality.gate_rules([("v", 0.5), ("w", 0.1), ("absent", 0.0)], "x") | {"three rows": (F.count(F.lit(1)) == 3, F.count(F.lit(1)))}
    written, found = quality.checked_write(df, "t", rules)
    want = [("coverage of v", True, "0.5"), ("coverage of w", False, "0.0"), ("coverage of absent", True, "0.0"), ("three rows", True, "3")]
    assert sorted(map(tuple, found.collect())) == sorted(want) and written.count() == 3
    assert sorted(map(tuple, quality.check(df, rules).collect())) == sorted(want)
    with pytest.raises(Exception, match="assertion failed"):
        quality.enforce(found).collect()


def test_calibration_of_many_groups(spark):
    """More groups than a driver should hold: parameters stay in tables, groups close one by one."""
    rows = spark.range(100_000).select(F.col("id").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    rows = rows.select((F.col("g") % 20_000).alias("g"), ((F.pmod(F.xxhash64("g", "i"), F.lit(1000)) + 0.5) / 1000).alias("probability"), (F.pmod(F.xxhash64(F.lit(1), "g", "i"), F.lit(2))).cast("int").alias("outcome"))
    found = calibration.calibration(rows.withColumn("outcome", F.when(F.col("g") == 5, 0).otherwise(F.col("outcome"))), ["g"])
    status = {r.status: r.n for r in found.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(status.values()) == 20_000 and status["one_class"] >= 1 and status["converged"] > 19_000


def test_landmarks_travel_with_the_entity(spark):
    """Expansion equals the range join, from one exchange of the observations."""
    spec = WindowSpec(24, 96, 24, 48, 24)
    rng = np.random.default_rng(3)
    obs = [(f"e{a}", float(t), "v", 1.0) for a, t in zip(rng.integers(0, 6, 300), np.round(rng.uniform(-40, 110, 300) * 2) / 2)]
    marks = [(f"e{a}", t) for a in range(5) for t in (24, 48, 72, 96) if (a + t // 24) % 3]
    got = spine.expand_to_landmarks(spark.createDataFrame(obs, "entity_key string, offset_h double, variable string, value double"), spark.createDataFrame(marks, "entity_key string, landmark_h long"), spec)
    assert got._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_COL") == 1
    want = sorted((e, x, t) for e, x, _, _ in obs for m, t in marks if m == e and t - 48 < x <= t)
    assert sorted((r.entity_key, r.offset_h, r.landmark_h) for r in got.collect()) == want


def test_numeric_profile_has_exact_quantiles_of_null_groups_too(spark):
    rows = [("a", str(i)) for i in range(201)] + [(None, f" {i}.5 ") for i in range(10)] + [(None, "x"), ("b", None), ("b", "1f")]
    df = spark.createDataFrame(rows, "k string, text string")
    got = {r.k: r[1:] for r in quality.numeric_profile(df, "text", ["k"]).collect()}
    assert got["a"] == (201, 1.0, 0.0, 100.0, 198.0, 200.0) and got["b"] == (2, 0.0, None, None, None, None)
    assert got[None] == (11, pytest.approx(10 / 11), 0.5, 5.0, pytest.approx(9.41), 9.5)
    assert quality.numeric_profile(df.drop("k"), "text", []).first().n_rows == 214
