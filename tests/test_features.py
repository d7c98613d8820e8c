"""Hand-computed cases of spines, windows, bins and features."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import earliest, hash_fold, latest, seconds_between, strict_double
from tidemark.operators import features, joins, spine
from tidemark.spec import WindowSpec

SPEC = WindowSpec(24, 32, 4, 12, 2)


def obs(spark, rows):
    return spark.createDataFrame(rows, "entity_key string, offset_h double, variable string, value double, source_priority int")


def spine_of(spark, hours=(24, 28, 32), entity="a"):
    return spark.createDataFrame([(entity, h) for h in hours], "entity_key string, landmark_h long")


def by_key(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_window_is_right_closed(spark):
    rows = obs(spark, [("a", 24.0, "hr", 1.0, 1), ("a", 12.0, "hr", 2.0, 1), ("a", 12.5, "hr", 3.0, 1), ("a", 24.5, "hr", 4.0, 1), ("a", 99.0, "hr", 5.0, 1)])
    got = spine.expand_to_landmarks(rows, spine_of(spark), SPEC).collect()
    assert sorted((r.landmark_h, r.offset_h) for r in got) == [(24, 12.5), (24, 24.0), (28, 24.0), (28, 24.5), (32, 24.0), (32, 24.5)]


def test_expansion_matches_range_join(spark):
    rng = np.random.default_rng(3)
    times = np.round(rng.uniform(0, 60, 200) * 4) / 4
    rows = obs(spark, [("a", float(t), "x", 1.0, 1) for t in times])
    spec = WindowSpec(20, 55, 5, 7, 1)
    got = sorted((r.landmark_h, r.offset_h) for r in joins.expand(rows, spec).collect())
    assert got == sorted((t, float(x)) for x in times for t in range(20, 56, 5) if t - 7 < x <= t)


def test_bins_and_their_edges(spark):
    rows = spine.expand_to_landmarks(obs(spark, [("a", 14.0, "hr", 1.0, 1), ("a", 14.01, "hr", 2.0, 1), ("a", 24.0, "hr", 9.0, 1)]), spine_of(spark, [24]), SPEC)
    right = by_key(features.window_bins(rows, SPEC), "bin_index")
    left = by_key(features.window_bins(rows, SPEC, "left"), "bin_index")
    assert sorted(right) == [(0,), (1,), (5,)] and right[(0,)].bin_midpoint_relative_h == -11
    assert sorted(left) == [(1,), (5,)] and left[(1,)].bin_median == 1.5


def test_source_priority_and_ties(spark):
    rows = spine.expand_to_landmarks(obs(spark, [("a", 20.0, "bp", 50.0, 2), ("a", 20.0, "bp", 70.0, 1), ("a", 20.0, "bp", 80.0, 1), ("a", 19.5, "bp", 10.0, 2)]), spine_of(spark, [24]), SPEC)
    points = by_key(features.select_source(rows, SPEC), "offset_h")
    assert points[(20.0,)].value == 75.0 and points[(19.5,)].value == 10.0
    assert [r.value for r in features.select_source(rows, SPEC, "bin").collect()] == [75.0]


def test_slope_needs_four_bins_and_equals_brute_force(spark):
    for n, expected in ((3, None), (4, 4)):
        ys = [1.0, 5.0, 2.0, 9.0][:n]
        rows = spine.expand_to_landmarks(obs(spark, [("a", 13.0 + 2 * i, "hr", y, 1) for i, y in enumerate(ys)]), spine_of(spark, [24]), SPEC)
        slope = features.theil_sen(features.window_bins(rows, SPEC)).first().theilsen_slope
        pairs = [(ys[j] - ys[i]) / (2 * (j - i)) for i in range(n) for j in range(i + 1, n)]
        assert slope == (pytest.approx(np.median(pairs)) if expected else None)


def test_missing_bin_breaks_run(spark):
    limits = spark.createDataFrame([("hr", None, 100.0)], "variable string, below double, above double")
    rows = spine.expand_to_landmarks(obs(spark, [("a", 13.0 + 2 * i, "hr", v, 1) for i, v in ((0, 120.0), (1, 130.0), (3, 140.0), (4, 90.0))]), spine_of(spark, [24]), SPEC)
    bins = features.window_bins(rows, SPEC)
    assert features.longest_run(bins, limits).first().longest_abnormal_run == 2
    assert features.abnormal_burden(bins, limits).first().abnormal_prop == 0.75
    bundle = features.trajectory_features(obs(spark, [("a", 13.0 + 2 * i, "hr", v, 1) for i, v in ((0, 120.0), (1, 130.0), (3, 140.0), (4, 90.0))]), spine_of(spark, [24]), SPEC, limits).first()
    assert (bundle.longest_abnormal_run, bundle.abnormal_prop, bundle.nonempty_bin_count, bundle.latest_value) == (2, 0.75, 4, 90.0)


def test_thresholds_leave_rows_in_their_tasks(spark):
    """Rows of a few variables are not dealt by variable, which would put them all into as many tasks."""
    limits = spark.createDataFrame([("hr", None, 100.0)], "variable string, below double, above double")
    entities = [f"e{i}" for i in range(40)]
    rows = obs(spark, [(e, 13.0 + 2 * i, "hr", 90.0 + 20 * i, 1) for e in entities for i in range(3)])
    present = spark.createDataFrame([(e, 24) for e in entities], "entity_key string, landmark_h long")
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        bins = features.window_bins(spine.expand_to_landmarks(rows, present, SPEC, resolve=features.resolve_points), SPEC)
        for df in (features.longest_run(bins, limits), features.abnormal_burden(bins, limits), features.trajectory_features(rows, present, SPEC, limits)):
            assert df.count() == 40 and df.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)


def test_longest_runs_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    limits = spark.createDataFrame([("hr", 40.0, 60.0), ("bp", None, 50.0)], "variable string, below double, above double")
    rows, expected = [], {}
    for n in range(60):
        for variable in ("hr", "bp", "no"):
            best = now = 0
            for i in range(12):
                v = float(rng.uniform(20, 80)) if rng.random() < 0.9 else None
                if rng.random() < 0.2:
                    now = 0
                    continue
                rows.append((f"e{n}", 24, variable, i, v))
                bad = v is not None and (v > 50 if variable == "bp" else not 40 <= v <= 60)
                now = now + 1 if bad else 0
                best = max(best, now)
            if variable != "no":
                expected[(f"e{n}", variable)] = best
    bins = spark.createDataFrame(rows, "entity_key string, landmark_h long, variable string, bin_index int, bin_median double").repartition(3)
    got = features.longest_run(bins, limits)
    assert dict(got.dtypes)["longest_abnormal_run"] == "bigint"
    assert {k: r.longest_abnormal_run for k, r in by_key(got, "entity_key", "variable").items()} == expected


def test_global_bins_equal_window_bins_on_the_grid(spark):
    rng = np.random.default_rng(5)
    rows = obs(spark, [("a", float(t), "hr", float(v), 1) for t, v in zip(rng.uniform(10, 32, 60), rng.normal(80, 9, 60))])
    s = spine_of(spark)
    mapped = by_key(features.map_bins(features.source_bins(rows, SPEC), s, SPEC), "landmark_h", "bin_index")
    direct = by_key(features.window_bins(spine.expand_to_landmarks(rows, s, SPEC), SPEC), "landmark_h", "bin_index")
    assert {k: r.bin_median for k, r in mapped.items()} == pytest.approx({k: r.bin_median for k, r in direct.items()})


def test_delta_needs_two_times(spark):
    s = spine_of(spark, [24])
    one = features.delta_features(spine.expand_to_landmarks(obs(spark, [("a", 20.0, "k", 1.0, 1), ("a", 20.0, "k", 3.0, 1)]), s, SPEC)).first()
    two = features.delta_features(spine.expand_to_landmarks(obs(spark, [("a", 20.0, "k", 1.0, 1), ("a", 22.0, "k", 3.0, 1)]), s, SPEC)).first()
    assert (one.delta_value, one.slope_value, one.latest_value) == (None, None, 2.0)
    assert (two.delta_value, two.slope_value) == (2.0, 1.0)


def test_ordinal_sentinel_and_escalations(spark):
    rows = spark.createDataFrame([("a", 14.0, "mask"), ("a", 14.0, "cpap"), ("a", 16.0, "room air"), ("a", 18.0, "cpap"), ("a", 20.0, "ventilator"), ("a", 20.0, "cpap"), ("a", 21.0, "tent")], "entity_key string, offset_h double, device string")
    rules = [("vent", -2), ("cpap", 3), ("mask", 2), ("room", 0)]
    ev = features.ordinal_events(rows, rules, "device")
    assert sorted((r.offset_h, r.level) for r in ev.collect()) == [(14.0, 3), (16.0, 0), (18.0, 3)]
    got = features.ordinal_features(ev, spine_of(spark, [24]), SPEC).first()
    assert (got.latest_level, got.max_level, got.escalation_count, got.documentation_count, got.time_since_latest_h) == (3, 3, 1, 3, 6.0)


def test_interval_edges(spark):
    iv = spark.createDataFrame([("a", 0.0, 12.0, 1), ("b", 24.0, 30.0, 2), ("c", 1.0, 24.0, 3), ("d", 24.5, 30.0, 1), ("e", 1.0, 23.5, 1)], "entity_key string, start_h double, end_h double, agents int")
    s = spark.createDataFrame([(e, 24) for e in "abcde"], "entity_key string, landmark_h long")
    got = by_key(features.interval_exposure(iv, s, SPEC), "entity_key")
    assert sorted(got) == [("b",), ("c",), ("e",)]
    # An interval that ends at the landmark is still active there.
    assert [got[(e,)].current_exposure for e in "bce"] == [1, 1, 0]


def test_unsupported_is_null_and_supported_is_zero(spark):
    df = spark.createDataFrame([(True, None), (False, None), (False, 3), (True, 2)], "ok boolean, n int")
    got = [r.n for r in features.mask_unsupported(df, "ok", ["n"]).collect()]
    assert got == [0, None, None, 2]


def test_spine_and_risk(spark):
    cohort = spark.createDataFrame([("a", 40.0, None), ("b", 28.0, None), ("c", 40.0, 27.0), ("d", 20.0, None)], "entity_key string, exit_h double, death_h double")
    s = spine.landmark_spine(cohort, SPEC)
    assert sorted((r.entity_key, r.landmark_h) for r in s.collect()) == [("a", 24), ("a", 28), ("a", 32), ("b", 24), ("c", 24)]
    bad = spark.createDataFrame([("a", 28.0), ("b", 5.0)], "entity_key string, event_h double")
    seen = spark.createDataFrame([("a", 13.0), ("b", 13.0)], "entity_key string, event_h double")
    assert [(r.entity_key, r.landmark_h) for r in spine.at_risk(s, [bad], [seen], SPEC).collect()] == [("a", 24)]
    assert sorted((r.entity_key, r.landmark_h) for r in spine.at_risk(s, [bad], [seen], SPEC, since=6).collect()) == [("a", 24), ("b", 24)]


def test_strict_numbers(spark):
    texts = [" 36.5 ", "36.5f", "1d", "1_000", "", "nan", ".5", "1e3", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(strict_double("t")).collect()] == [36.5, None, None, None, None, None, 0.5, 1000.0, None]


def test_latest_skips_null_values(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, None), (1.0, 7.0)], "t double, v double")
    r = df.agg(latest("v", "t").alias("l"), earliest("v", "t").alias("e")).first()
    assert (r.l, r.e) == (7.0, 5.0)


def test_second_boundaries_and_hash_folds(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00.9' AS a, timestamp'2024-01-01 00:00:01.1' AS b")
    assert df.select(seconds_between("a", "b")).first()[0] == 1
    import hashlib

    folds = [r[0] for r in spark.range(50).select(hash_fold(F.col("id"), 9, 3)).collect()]
    assert folds == [int(hashlib.sha256(f"9|{i}".encode()).hexdigest()[:16], 16) % 3 for i in range(50)]


def test_bad_grid_is_refused(spark):
    with pytest.raises(ValueError):
        WindowSpec(lookback=5, bin=2)
    with pytest.raises(ValueError):
        features.map_bins(spine_of(spark), spine_of(spark), WindowSpec(24, 32, 5, 12, 2))
