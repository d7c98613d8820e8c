"""Evidence windows and threshold sweeps over blocks of time, against plain loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import calibration, outcome, timeline

W = "entity_key string, landmark_h long, horizon_h long, end_h long, note string"
E = "entity_key string, event_h double, value int"


def _tables(seed):
    rng = np.random.default_rng(seed)
    hours = [24, 48, 72]
    # One entity has a third of all rows and lies in many blocks.
    who = lambda n: ["hot" if rng.random() < 0.34 else f"e{rng.integers(12)}" for _ in range(n)]
    windows = [(w, int(t), h, int(t) + h, f"{w}{t}") for w, t in zip(who(150), rng.integers(0, 200, 150) * 24) for h in hours]
    windows += [windows[0], (None, 24, 24, 48, "none"), ("absent", 24, 24, 48, None), ("e1", 48, 0, 48, "empty")]
    events = lambda n: [(w, float(round(t * 4) / 4), int(v)) for w, t, v in zip(who(n), rng.uniform(-50, 4900, n), rng.integers(0, 3, n))]
    strict, broad = events(900), events(500)
    # Evidence on the borders, repeated, and without a key or time.
    strict += [(w, float(x), 1) for w, t, h, e, _ in windows[:60] if w for x in (t, e)] + [strict[0]] * 3 + [(None, 30.0, 1), ("e1", None, 1)]
    return windows, strict, broad


def _loop(window, events):
    w, t, _, end, _ = window
    inside = [(x, v) for k, x, v in events if k is not None and k == w and x is not None and t < x <= end]
    return min((x for x, _ in inside), default=None), len(inside), len({x for x, _ in inside}), len(set(inside))


@pytest.mark.parametrize("reach", [None, 72, 500])
def test_evidence_windows_equal_a_loop(spark, reach):
    windows, strict, broad = _tables(1)
    found = outcome.window_evidences(spark.createDataFrame(windows, W), {"strict": spark.createDataFrame(strict, E), "broad": spark.createDataFrame(broad, E)}, {"strict": [F.col("value")]}, reach)
    assert found.columns == [*[c.split()[0] for c in W.split(", ")], "strict_first_h", "strict_rows", "strict_times", "strict_distinct", "broad_first_h", "broad_rows", "broad_times"]
    want = sorted((str(w), *map(str, _loop(w, strict)), *map(str, _loop(w, broad)[:3])) for w in windows)
    assert sorted((str(tuple(r[:5])), *map(str, r[5:])) for r in found.collect()) == want


def test_evidence_windows_shuffle_once(spark):
    windows, strict, broad = _tables(2)
    found = outcome.window_evidences(spark.createDataFrame(windows, W), {"strict": spark.createDataFrame(strict, E), "broad": spark.createDataFrame(broad, E)}, reach=72)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_evidence_windows_without_rows(spark):
    windows, strict, _ = _tables(3)
    none = spark.createDataFrame([], E)
    assert outcome.window_evidence(spark.createDataFrame([], W), spark.createDataFrame(strict, E), "x").collect() == []
    got = outcome.window_evidence(spark.createDataFrame(windows, W), none, "x").select("x_first_h", "x_rows").distinct().collect()
    assert [tuple(r) for r in got] == [(None, 0)]


def _curve(rows, thresholds, gap):
    """{(model, threshold): counts} by loops over rows (model, entity, time, outcome, probability)."""
    out = {}
    for model in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == model]
        for t in thresholds:
            alert = [r for r in own if r[4] is not None and r[4] >= t]
            quiet = [r for r in own if r[4] is not None and r[4] < t]
            episodes = 0
            for who in {r[1] for r in alert}:
                times = sorted(r[2] for r in alert if r[1] == who)
                episodes += sum(1 for i, x in enumerate(times) if i == 0 or x - times[i - 1] > gap)
            count = lambda part, y: sum(r[3] == y for r in part)
            out[model, t] = (len(own), count(alert, 1), count(alert, 0), count(quiet, 1), count(quiet, 0), len({r[1] for r in own} - {None}), len({r[1] for r in alert} - {None}), episodes)
    return out


@pytest.mark.parametrize(("gap", "step"), [(8, 1), (24, 8), (0, 1)])
def test_decision_curve_equals_loops(spark, gap, step):
    rng = np.random.default_rng(gap)
    n = 1500
    rows = [
        (f"m{m}", "hot" if a < 0.34 else None if a > 0.98 else f"e{e}", float(t * step), int(y), None if p > 0.97 else float(round(p, 1)))
        for m, a, e, t, y, p in zip(rng.integers(0, 2, n), rng.random(n), rng.integers(0, 20, n), rng.integers(0, 300, n), rng.integers(0, 2, n), rng.random(n))
    ]
    thresholds = [0.5, 0.1, 0.3, 0.9, 0.95, 0.3]
    df = spark.createDataFrame(rows, "model_id string, entity_key string, landmark_h double, outcome int, probability double")
    got = {(r.model_id, r.threshold): (r.n, r.tp, r.fp, r.fn, r.tn, r.n_entities, r.alerted_entities, r.episodes) for r in calibration.decision_curve(df, thresholds, gap_h=gap).collect()}
    assert got == _curve(rows, set(thresholds), gap)


def test_curve_makes_no_copies_by_threshold(spark):
    """The rows that are shuffled do not depend on the number of thresholds."""
    df = spark.createDataFrame([("m", "a", 24, 1, 0.5), ("m", "a", 48, 0, 0.2)], "model_id string, entity_key string, landmark_h long, outcome int, probability double")
    plans = [calibration.threshold_cells(df, [i / n for i in range(1, n)], ["model_id"], 8)._jdf.queryExecution().executedPlan().toString() for n in (3, 50)]
    assert plans[0].count("Exchange") == plans[1].count("Exchange") and plans[0].count("Generate") == plans[1].count("Generate")


def test_prior_levels(spark):
    rows = [("a", 0.0, 1), ("a", 5.0, 3), ("a", 5.0, 3), ("a", 13.0, 2), ("a", 21.5, 1), ("a", 100.0, 1), ("b", 5.0, 1)]
    got = timeline.with_prior(spark.createDataFrame(rows, "who string, at double, level int"), [], "who", "at", "level", 8)
    assert sorted((r.who, r.at, r["__prior"] or 0) for r in got.collect()) == [("a", 0.0, 0), ("a", 5.0, 1), ("a", 5.0, 3), ("a", 13.0, 3), ("a", 21.5, 0), ("a", 100.0, 0), ("b", 5.0, 0)]
