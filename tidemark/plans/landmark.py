"""Spines, look-back features, matrices and outcome labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import features, joins, matrix, outcome, quality, reshape, spine
from tidemark.plans.base import (
    ALIGNED, COHORT, HASH_FOLD, OBS, ORACLES, OUTCOME, SPEC, SPINE, THRESHOLDS, WOBS, cohort, evidence, expanded, landmarks, observations, outcomes, query, rounded, table,
)
from tidemark.spec import KEYS, WindowSpec
from tidemark.functions import hash_fold

DAY = WindowSpec(168, 648, 24, 24, 24)


def thresholds(spark):
    return spark.createDataFrame(THRESHOLDS, "variable string, below double, above double")


TH = "th AS (SELECT * FROM (VALUES ('view', 20.0::DOUBLE, 80.0::DOUBLE), ('click', NULL, 60.0), ('error', NULL, 40.0), ('purchase', 30.0, NULL)) t(variable, below, above))"


@query("h01_landmark_spine", f"WITH {SPINE} SELECT entity_key, cluster_key, landmark_h, round(exit_h, 6) AS exit_h, round(death_h, 6) AS death_h FROM spine")
def _(spark, d):
    return rounded(landmarks(spark, d).select("entity_key", "cluster_key", "landmark_h", "exit_h", "death_h"))


@query("h02_at_risk", f"""WITH {SPINE} SELECT entity_key, landmark_h FROM spine s
WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.entity_key = s.entity_key AND variable = 'purchase' AND value > 120 AND offset_h >= 24 AND offset_h <= landmark_h)
AND EXISTS (SELECT 1 FROM obs o WHERE o.entity_key = s.entity_key AND variable IN ('view', 'click') AND offset_h > landmark_h - 168 AND offset_h <= landmark_h)""")
def _(spark, d):
    bad = evidence(spark, d, "purchase").where("value > 120")
    return spine.at_risk(landmarks(spark, d), [bad], [evidence(spark, d, "view"), evidence(spark, d, "click")], SPEC, since=24).select(*KEYS)


@query("h03_observation_normaliser", f"""WITH {OBS}, l AS (SELECT entity_key, offset_h, source_priority, unnest([{{'variable': variable, 'value': value}}, {{'variable': variable || '_half', 'value': CASE WHEN value < 100 THEN value / 2 END}}], recursive := true) FROM obs)
SELECT entity_key, round(offset_h, 6) AS offset_h, variable, round(value, 6) AS value, source_priority FROM l WHERE value IS NOT NULL AND offset_h > 0 AND offset_h <= 648""")
def _(spark, d):
    obs = observations(spark, d)
    half = obs.withColumns({"variable": F.concat("variable", F.lit("_half")), "value": F.when(F.col("value") < 100, F.col("value") / 2)})
    return rounded(spine.observations([obs, half], SPEC))


@query("h04_event_expansion", f"WITH {WOBS} SELECT entity_key, landmark_h, variable, count(*) AS n, round(sum(value), 4) AS total, round(min(offset_h), 6) AS first_h FROM wobs GROUP BY ALL")
def _(spark, d):
    return rounded(expanded(spark, d).groupBy(*features.GROUP).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("offset_h").alias("first_h")))


def _points(spark, d):
    return spine.expand_to_landmarks(observations(spark, d), landmarks(spark, d), SPEC, resolve=features.resolve_points)


_BEST = WOBS + """, best AS (SELECT entity_key, landmark_h, variable, offset_h, median(value) AS value FROM
  (SELECT *, min(source_priority) OVER (PARTITION BY entity_key, landmark_h, variable, offset_h) AS b FROM wobs) WHERE source_priority = b GROUP BY ALL)"""
_BINS = _BEST + """, bins AS (SELECT entity_key, landmark_h, variable, CAST(greatest(0, least(5, ceil((offset_h - (landmark_h - 168)) / 28) - 1)) AS INTEGER) AS bin_index, median(value) AS bin_median
  FROM best GROUP BY ALL)"""


@query("h05_source_priority_timepoint", f"WITH {_BEST} SELECT entity_key, landmark_h, variable, round(offset_h, 6) AS offset_h, round(value, 6) AS value FROM best")
def _(spark, d):
    return rounded(_points(spark, d))


@query("h06_source_priority_bin", f"""WITH {WOBS}, b AS (SELECT *, CAST(greatest(0, least(5, ceil((offset_h - (landmark_h - 168)) / 28) - 1)) AS INTEGER) AS bin_index FROM wobs)
SELECT entity_key, landmark_h, variable, bin_index, round(median(value), 6) AS value FROM
(SELECT *, min(source_priority) OVER (PARTITION BY entity_key, landmark_h, variable, bin_index) AS best FROM b) WHERE source_priority = best GROUP BY ALL""")
def _(spark, d):
    return rounded(features.select_source(expanded(spark, d), SPEC, level="bin"))


@query("h07_window_bins", f"WITH {_BINS} SELECT entity_key, landmark_h, variable, bin_index, round(bin_median, 6) AS bin_median, CAST(-154 + 28 * bin_index AS DOUBLE) AS bin_midpoint_relative_h FROM bins")
def _(spark, d):
    return rounded(features.window_bins(_points(spark, d), SPEC))


@query("h08_global_bins", f"""WITH {SPINE}, g AS (SELECT entity_key, variable, CAST(ceil(offset_h / 24) * 24 AS BIGINT) AS bin_end_h, median(value) AS bin_median, count(value) AS measurement_count,
  arg_max(value, offset_h) AS bin_latest_value, max(offset_h) AS bin_latest_offset_h FROM obs GROUP BY ALL)
SELECT s.entity_key, s.landmark_h, variable, bin_end_h, CAST((bin_end_h - s.landmark_h + 144) // 24 - 1 AS INTEGER) AS bin_index, round(bin_median, 6) AS bin_median, measurement_count,
  round(bin_latest_value, 6) AS bin_latest_value, round(bin_latest_offset_h, 6) AS bin_latest_offset_h
FROM g JOIN spine s ON s.entity_key = g.entity_key AND bin_end_h > s.landmark_h - 144 AND bin_end_h <= s.landmark_h""")
def _(spark, d):
    mapped = features.map_bins(features.source_bins(observations(spark, d), ALIGNED), landmarks(spark, d, ALIGNED), ALIGNED)
    return rounded(mapped.select(*features.GROUP, "bin_end_h", "bin_index", "bin_median", "measurement_count", "bin_latest_value", "bin_latest_offset_h"))


_LEVELS = "lv AS (SELECT entity_key, landmark_h, variable, count(*) AS nonempty_bin_count, median(bin_median) AS median, min(bin_median) AS min, max(bin_median) AS max, CASE WHEN count(*) >= 2 THEN stddev_samp(bin_median) END AS sd, CASE WHEN count(*) >= 2 THEN quantile_cont(bin_median, 0.75) - quantile_cont(bin_median, 0.25) END AS iqr FROM bins GROUP BY ALL)"
_SLOPES = "sl AS (SELECT a.entity_key, a.landmark_h, a.variable, median((b.bin_median - a.bin_median) / (28.0 * (b.bin_index - a.bin_index))) AS slope FROM bins a JOIN bins b USING (entity_key, landmark_h, variable) WHERE b.bin_index > a.bin_index GROUP BY ALL)"
_FLAGS = "fl AS (SELECT bins.*, coalesce(bin_median < below, false) OR coalesce(bin_median > above, false) AS abnormal FROM bins JOIN th USING (variable))"
_RUNS = """rn AS (SELECT entity_key, landmark_h, variable, coalesce(max(n) FILTER (abnormal), 0) AS longest_abnormal_run FROM (
  SELECT entity_key, landmark_h, variable, abnormal, island, count(*) AS n FROM (SELECT *, bin_index - row_number() OVER (PARTITION BY entity_key, landmark_h, variable, abnormal ORDER BY bin_index) AS island FROM fl) GROUP BY ALL) GROUP BY ALL)"""


@query("h09_level_stats", f"WITH {_BINS}, {_LEVELS} SELECT entity_key, landmark_h, variable, nonempty_bin_count, round(median, 6) AS median, round(min, 6) AS min, round(max, 6) AS max, round(sd, 6) AS sd, round(iqr, 6) AS iqr FROM lv")
def _(spark, d):
    return rounded(features.level_stats(features.window_bins(_points(spark, d), SPEC)))


@query("h10_theil_sen", f"WITH {_BINS}, {_LEVELS}, {_SLOPES} SELECT entity_key, landmark_h, variable, round(CASE WHEN nonempty_bin_count >= 4 THEN slope END, 9) AS theilsen_slope FROM lv LEFT JOIN sl USING (entity_key, landmark_h, variable)")
def _(spark, d):
    return rounded(features.theil_sen(features.window_bins(_points(spark, d), SPEC)), 9)


@query("h11_point_stats", f"WITH {_BEST} SELECT entity_key, landmark_h, variable, count(value) AS measurement_count, round(arg_max(value, offset_h), 6) AS latest_value, round(max(offset_h), 6) AS latest_offset_h FROM best GROUP BY ALL")
def _(spark, d):
    return rounded(features.point_stats(_points(spark, d)))


@query("h12_abnormal_burden", f"WITH {_BINS}, {TH}, {_FLAGS} SELECT entity_key, landmark_h, variable, round(avg(CAST(abnormal AS INTEGER)), 6) AS abnormal_prop FROM fl GROUP BY ALL")
def _(spark, d):
    return rounded(features.abnormal_burden(features.window_bins(_points(spark, d), SPEC), thresholds(spark)))


@query("h13_longest_run", f"WITH {_BINS}, {TH}, {_FLAGS}, {_RUNS} SELECT * FROM rn")
def _(spark, d):
    return features.longest_run(features.window_bins(_points(spark, d), SPEC), thresholds(spark))


_TRAJECTORY = f"""{_BINS}, {TH}, {_LEVELS}, {_SLOPES}, {_FLAGS}, {_RUNS},
pt AS (SELECT entity_key, landmark_h, variable, count(value) AS measurement_count, arg_max(value, offset_h) AS latest_value, max(offset_h) AS latest_offset_h FROM best GROUP BY ALL),
ab AS (SELECT entity_key, landmark_h, variable, avg(CAST(abnormal AS INTEGER)) AS abnormal_prop FROM fl GROUP BY ALL),
tr AS (SELECT entity_key, landmark_h, variable, measurement_count, round(latest_value, 9) AS latest_value, round(latest_offset_h, 9) AS latest_offset_h, nonempty_bin_count, round(median, 9) AS median, round(min, 9) AS min, round(max, 9) AS max,
  round(sd, 9) AS sd, round(iqr, 9) AS iqr, round(CASE WHEN nonempty_bin_count >= 4 THEN slope END, 9) AS theilsen_slope, round(abnormal_prop, 9) AS abnormal_prop, longest_abnormal_run
FROM pt JOIN lv USING (entity_key, landmark_h, variable) LEFT JOIN sl USING (entity_key, landmark_h, variable) LEFT JOIN ab USING (entity_key, landmark_h, variable) LEFT JOIN rn USING (entity_key, landmark_h, variable))"""


def trajectory(spark, d):
    return features.trajectory_features(observations(spark, d), landmarks(spark, d), SPEC, thresholds(spark))


@query("h_trajectory_features", f"WITH {_TRAJECTORY} SELECT * FROM tr")
def _(spark, d):
    return rounded(trajectory(spark, d), 9)


_DELTA = WOBS + """, tp AS (SELECT entity_key, landmark_h, variable, offset_h, median(value) AS value FROM wobs GROUP BY ALL),
dl AS (SELECT entity_key, landmark_h, variable, arg_max(value, offset_h) AS latest_value, max(offset_h) AS latest_offset_h, median(value) AS median, min(value) AS min, max(value) AS max,
  CASE WHEN count(*) >= 2 THEN arg_max(value, offset_h) - arg_min(value, offset_h) END AS delta_value,
  CASE WHEN count(*) >= 2 THEN (arg_max(value, offset_h) - arg_min(value, offset_h)) / (max(offset_h) - min(offset_h)) END AS slope_value, count(*) AS measurement_count FROM tp GROUP BY ALL)"""


@query("h14_delta_features", f"WITH {_DELTA} SELECT entity_key, landmark_h, variable, round(latest_value, 6) AS latest_value, round(latest_offset_h, 6) AS latest_offset_h, round(median, 6) AS median, round(min, 6) AS min, round(max, 6) AS max, round(delta_value, 6) AS delta_value, round(slope_value, 5) AS slope_value, measurement_count FROM dl")
def _(spark, d):
    return rounded(features.delta_features(expanded(spark, d)).withColumn("slope_value", F.round("slope_value", 5)))


@query("h15_latest_in_long_window", f"""WITH {SPINE}, f AS (SELECT s.entity_key, s.landmark_h, arg_max(value, offset_h) AS view_24h, max(offset_h) AS view_24h_offset_h
FROM spine s JOIN obs o ON o.entity_key = s.entity_key AND variable = 'view' AND offset_h > landmark_h - 336 AND offset_h <= landmark_h GROUP BY ALL)
SELECT s.entity_key, s.landmark_h, round(view_24h, 6) AS view_24h, round(view_24h_offset_h, 6) AS view_24h_offset_h FROM spine s LEFT JOIN f USING (entity_key, landmark_h)""")
def _(spark, d):
    views = observations(spark, d).where("variable = 'view'")
    return rounded(features.latest_in_window(views, landmarks(spark, d).select(*KEYS), SPEC, 336, "view_24h"))


RULES = [("error", 3), ("purch", 2), ("^(click|view)$", 1), ("signup", -2)]
_ORD = SPINE + """, ev AS (SELECT entity_key, floor(offset_h / 6) * 6 AS offset_h, variable FROM obs),
lvl AS (SELECT *, CASE WHEN variable = 'error' THEN 3 WHEN variable = 'purchase' THEN 2 WHEN variable IN ('click', 'view') THEN 1 WHEN variable = 'signup' THEN -2 END AS level FROM ev),
oe AS (SELECT entity_key, offset_h, max(level) AS level FROM lvl GROUP BY ALL HAVING NOT bool_or(level = -2))"""


def _ordinal(spark, d):
    rows = observations(spark, d).withColumn("offset_h", F.floor(F.col("offset_h") / 6).cast("double") * 6)
    return features.ordinal_events(rows, RULES, "variable")


@query("h16_ordinal_levels", f"WITH {_ORD} SELECT entity_key, offset_h, level FROM oe")
def _(spark, d):
    return _ordinal(spark, d)


@query("h17_ordinal_trajectory", f"""WITH {_ORD}, r AS (SELECT s.entity_key, s.landmark_h, offset_h, level, lag(level) OVER (PARTITION BY s.entity_key, s.landmark_h ORDER BY offset_h) AS before
FROM spine s JOIN oe ON oe.entity_key = s.entity_key AND offset_h > landmark_h - 168 AND offset_h <= landmark_h)
SELECT entity_key, landmark_h, arg_max(level, offset_h) AS latest_level, max(level) AS max_level, count(*) FILTER (level > before) AS escalation_count, count(*) AS documentation_count, max(offset_h) AS latest_offset_h, max(landmark_h) - max(offset_h) AS time_since_latest_h FROM r GROUP BY entity_key, landmark_h""")
def _(spark, d):
    return rounded(features.ordinal_features(_ordinal(spark, d), landmarks(spark, d), SPEC))


@query("h18_nested_window_sums", f"""WITH {SPINE}, r AS (SELECT s.entity_key, s.landmark_h, offset_h, value FROM spine s JOIN obs o ON o.entity_key = s.entity_key AND variable = 'purchase' AND value BETWEEN 1 AND 300 AND offset_h > landmark_h - 144 AND offset_h <= landmark_h)
SELECT entity_key, landmark_h, round(sum(value) FILTER (offset_h > landmark_h - 72), 6) AS sum_72h, round(sum(value), 6) AS sum_144h, count(*) FILTER (offset_h > landmark_h - 72) AS count_72h, count(*) AS count_144h, round(max(offset_h), 6) AS latest_offset_h FROM r GROUP BY ALL""")
def _(spark, d):
    amounts = observations(spark, d).where("variable = 'purchase'").withColumnRenamed("value", "amount")
    return rounded(features.nested_sums(amounts, landmarks(spark, d), SPEC, [72, 144], 1, 300))


_ISPEC = WindowSpec(8760, 43800, 2190, 720, 720)
_IV = """iv AS (SELECT CAST(o_custkey AS VARCHAR) AS entity_key, date_diff('second', TIMESTAMP '1995-01-01', CAST(o_orderdate AS TIMESTAMP)) / 3600.0 AS start_h,
  date_diff('second', TIMESTAMP '1995-01-01', CAST(max(l_shipdate) AS TIMESTAMP)) / 3600.0 AS end_h, count(*) AS agents FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate),
isp AS (SELECT entity_key, CAST(t AS BIGINT) AS landmark_h FROM (SELECT DISTINCT entity_key FROM iv), (SELECT unnest(generate_series(8760, 43800, 2190)) AS t))"""


def _intervals(spark, d):
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    origin = F.unix_timestamp(F.lit("1995-01-01 00:00:00").cast("timestamp"))
    hours = lambda c: (F.unix_timestamp(c.cast("timestamp")) - origin) / 3600.0
    per_order = l.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"), F.count(F.lit(1)).alias("agents"))
    return o.join(per_order, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").cast("string").alias("entity_key"), hours(F.col("o_orderdate")).alias("start_h"), hours(F.col("shipped")).alias("end_h"), "agents")


def _ispine(iv):
    return iv.select("entity_key").distinct().withColumn("landmark_h", F.explode(F.sequence(F.lit(8760).cast("long"), F.lit(43800).cast("long"), F.lit(2190).cast("long"))))


@query("h19_interval_exposure", f"""WITH {_IV} SELECT s.entity_key, s.landmark_h, 1 AS any_exposure, max(CAST(start_h <= landmark_h AND end_h >= landmark_h AS INTEGER)) AS current_exposure, max(agents) AS max_agents, round(max(start_h), 6) AS latest_start_h
FROM isp s JOIN iv ON iv.entity_key = s.entity_key AND start_h <= landmark_h AND end_h > landmark_h - 720 GROUP BY ALL""")
def _(spark, d):
    iv = _intervals(spark, d)
    return rounded(features.interval_exposure(iv, _ispine(iv), _ISPEC))


@query("h20_point_exposure", f"""WITH {WOBS}, a AS (SELECT entity_key, landmark_h, variable AS agent, max(CAST(value > 40 AS INTEGER)) AS ever, arg_max(CAST(value > 40 AS INTEGER), offset_h) AS last, max(offset_h) AS at_h FROM wobs GROUP BY ALL)
SELECT entity_key, landmark_h, max(ever) AS any_exposure, max(CAST(last = 1 AND at_h >= landmark_h - 24 AS INTEGER)) AS current_exposure, CAST(sum(ever) AS BIGINT) AS agents, round(max(at_h), 6) AS latest_offset_h FROM a GROUP BY ALL""")
def _(spark, d):
    rows = observations(spark, d).withColumn("agent", F.col("variable")).withColumn("active", F.col("value") > 40)
    return rounded(features.point_exposure(rows, landmarks(spark, d), SPEC, 24))


_CAP = COHORT + """, cap AS (SELECT c.cluster_key, bool_or(coalesce(variable = 'purchase' AND value > 250, false)) AS supported FROM cohort c LEFT JOIN obs o USING (entity_key) GROUP BY ALL)"""


@query("h21_site_capability", f"""WITH {_CAP}, n AS (SELECT entity_key, count(*) AS n_large FROM obs WHERE variable = 'purchase' AND value > 100 GROUP BY ALL)
SELECT entity_key, c.cluster_key, supported, CASE WHEN supported THEN coalesce(n_large, 0) END AS n_large FROM cohort c JOIN cap USING (cluster_key) LEFT JOIN n USING (entity_key)""")
def _(spark, d):
    obs, people = observations(spark, d), cohort(spark, d)
    flags = features.site_capability(obs.where("variable = 'purchase' AND value > 250"), people)
    n = obs.where("variable = 'purchase' AND value > 100").groupBy("entity_key").agg(F.count(F.lit(1)).alias("n_large"))
    rows = people.select("entity_key", "cluster_key").join(flags, "cluster_key").join(n, "entity_key", "left")
    return features.mask_unsupported(rows, "supported", ["n_large"]).select("entity_key", "cluster_key", "supported", "n_large")


_STATIC = SPINE + """, st AS (SELECT CAST(c_custkey AS VARCHAR) AS entity_key, c_mktsegment AS segment, c_custkey % 90 + 110.0::DOUBLE AS height_cm, CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 60 + 40.0::DOUBLE END AS weight_kg FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT CAST(c_custkey AS VARCHAR), lower(c_mktsegment), c_custkey % 80 + 120.0::DOUBLE, c_custkey % 50 + 50.0::DOUBLE FROM customer WHERE c_custkey % 2 = 1)"""


def _static(spark, d):
    c = table(spark, d, "customer")
    key, n = F.col("c_custkey").cast("string").alias("entity_key"), F.col("c_custkey")
    a = c.where(n % 2 == 0).select(key, F.col("c_mktsegment").alias("segment"), (n % 90 + 110.0).alias("height_cm"), F.when(n % 7 > 0, n % 60 + 40.0).alias("weight_kg"))
    b = c.where(n % 2 == 1).select(key, F.lower("c_mktsegment").alias("segment"), (n % 80 + 120.0).alias("height_cm"), (n % 50 + 50.0).alias("weight_kg"))
    return features.static_context([a, b], landmarks(spark, d))


@query("h22_static_context", f"""WITH {_STATIC} SELECT s.entity_key, landmark_h, segment, height_cm, weight_kg, round(CASE WHEN height_cm > 0 AND weight_kg > 0 THEN weight_kg / ((height_cm / 100) * (height_cm / 100)) END, 6) AS bmi FROM spine s LEFT JOIN st USING (entity_key)""")
def _(spark, d):
    return rounded(_static(spark, d))


VARIABLES = ["view", "signup", "click", "error", "purchase"]


def predictor_matrix(spark, d):
    folds = cohort(spark, d).select(F.col("cluster_key").alias("cluster")).distinct().withColumn("outer_fold", hash_fold("cluster", 7, 5) + 1)
    exposure = features.point_exposure(observations(spark, d).withColumn("agent", F.col("variable")).withColumn("active", F.col("value") > 40), landmarks(spark, d), SPEC, 24).select(*KEYS, "agents")
    static = _static(spark, d).join(landmarks(spark, d).select(*KEYS, "cluster_key"), KEYS)
    long = [
        (trajectory(spark, d), VARIABLES, {"latest": "latest_value", "median": "median", "slope": "theilsen_slope", "run": "longest_abnormal_run"}),
        (features.delta_features(expanded(spark, d)), VARIABLES, {"delta": "delta_value"}),
    ]
    return matrix.predictor_matrix(static, long, [exposure], {"view_click_ratio": ("view_latest", "click_latest")}, folds, ["entity_key", "cluster_key"])


def _pivot(cell, alias):
    return ", ".join(f"max({cell}) FILTER (variable = '{v}') AS {v}_{alias}" for v in VARIABLES)


@query("h23_predictor_matrix", f"""WITH {_STATIC.replace('WITH ', '')}, {_TRAJECTORY.replace(SPINE + ', ', '')}, {_DELTA.replace(WOBS + ', ', '')},
p1 AS (SELECT entity_key, landmark_h, {_pivot('latest_value', 'latest')}, {_pivot('median', 'median')}, {_pivot('theilsen_slope', 'slope')}, {_pivot('longest_abnormal_run', 'run')} FROM tr GROUP BY ALL),
p2 AS (SELECT entity_key, landmark_h, {_pivot('round(delta_value, 9)', 'delta')} FROM dl GROUP BY ALL),
ex AS (SELECT entity_key, landmark_h, CAST(sum(ever) AS BIGINT) AS agents FROM (SELECT entity_key, landmark_h, variable, max(CAST(value > 40 AS INTEGER)) AS ever FROM wobs GROUP BY ALL) GROUP BY ALL)
SELECT s.entity_key, s.landmark_h, segment, height_cm, weight_kg, round(CASE WHEN height_cm > 0 AND weight_kg > 0 THEN weight_kg / ((height_cm / 100) * (height_cm / 100)) END, 6) AS bmi, s.cluster_key,
  p1.* EXCLUDE (entity_key, landmark_h), p2.* EXCLUDE (entity_key, landmark_h), agents, round(CASE WHEN click_latest > 0 THEN view_latest / click_latest END, 4) AS view_click_ratio, {HASH_FOLD.format(seed=7, value='s.cluster_key', n=5)} + 1 AS outer_fold
FROM spine s LEFT JOIN st USING (entity_key) LEFT JOIN p1 USING (entity_key, landmark_h) LEFT JOIN p2 USING (entity_key, landmark_h) LEFT JOIN ex USING (entity_key, landmark_h)""")
def _(spark, d):
    return rounded(predictor_matrix(spark, d).withColumns({"view_click_ratio": F.round("view_click_ratio", 4), "bmi": F.round("bmi", 6)}), 9)


REGISTRY_KINDS = [("^(entity_key|landmark_h|cluster_key|outer_fold)$", "key"), ("_(latest|median|slope|run|delta)$", "longitudinal"), ("_ratio$", "derived")]


def registry(spark, d, filled=False):
    name = F.col("name")
    rules = {"m0": name.isin("landmark_h", "segment", "bmi"), "m1": name.rlike("_(latest|median)$") | name.isin("landmark_h", "bmi"), "m2": (F.col("kind") != "key") & ~name.rlike("^(height|weight)")}
    return matrix.feature_registry(predictor_matrix(spark, d), rules, REGISTRY_KINDS, filled)


@query("h24_feature_registry", f"""WITH matrix AS ({ORACLES["h23_predictor_matrix"]}),
c AS (UNPIVOT (SELECT count(COLUMNS(*)) AS '\\0' FROM matrix) ON COLUMNS(*) INTO NAME name VALUE n_values),
k AS (SELECT *, CASE WHEN name IN ('entity_key', 'landmark_h', 'cluster_key', 'outer_fold') THEN 'key' WHEN regexp_matches(name, '_(latest|median|slope|run|delta)$') THEN 'longitudinal' WHEN name LIKE '%\\_ratio' ESCAPE '\\' THEN 'derived' ELSE 'other' END AS kind FROM c)
SELECT kind, count(*) AS n, CAST(sum(CAST(name IN ('landmark_h', 'segment', 'bmi') AS INTEGER)) AS BIGINT) AS m0,
  CAST(sum(CAST(regexp_matches(name, '_(latest|median)$') OR name IN ('landmark_h', 'bmi') AS INTEGER)) AS BIGINT) AS m1,
  CAST(sum(CAST(kind <> 'key' AND NOT regexp_matches(name, '^(height|weight)') AS INTEGER)) AS BIGINT) AS m2, CAST(sum(n_values) AS BIGINT) AS n_values FROM k GROUP BY kind""")
def _(spark, d):
    """Columns of the matrix by kind: how many, in which models, and how many values they hold."""
    return registry(spark, d, filled=True).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), *(F.sum(m).alias(m) for m in ("m0", "m1", "m2", "n_values")))


@query("h25_left_closed_bins", f"WITH {_BEST} SELECT entity_key, landmark_h, variable, CAST(greatest(0, least(5, floor((offset_h - (landmark_h - 168)) / 28))) AS INTEGER) AS bin_index, round(median(value), 6) AS bin_median FROM best GROUP BY ALL")
def _(spark, d):
    return rounded(features.window_bins(features.select_source(expanded(spark, d), SPEC), SPEC, closed="left").drop("bin_midpoint_relative_h"))


@query("i01_horizons", f"WITH {OUTCOME} SELECT entity_key, landmark_h, horizon_h, end_h FROM win")
def _(spark, d):
    return outcome.horizons(landmarks(spark, d), [24, 48], {168: [72]}).select(*KEYS, "horizon_h", "end_h")


_OUT = "entity_key, landmark_h, horizon_h, round(strict_first_h, 6) AS strict_first_h, round(broad_first_h, 6) AS broad_first_h, strict_rows, strict_times, broad_rows, broad_times, evidence_grade, outcome"


@query("i02_i03_i07_outcomes", f"WITH {OUTCOME} SELECT {_OUT} FROM outcomes")
def _(spark, d):
    return rounded(outcomes(spark, d).select(*KEYS, "horizon_h", "strict_first_h", "broad_first_h", "strict_rows", "strict_times", "broad_rows", "broad_times", "evidence_grade", "outcome"))


_EV = OBS + """, ee AS (SELECT DISTINCT entity_key, offset_h AS event_h, 'device' AS domain, variable AS label FROM obs WHERE variable IN ('view', 'click') AND value > 30
UNION SELECT DISTINCT entity_key, offset_h, 'status', variable FROM obs WHERE variable IN ('error', 'signup') AND value > 60)"""


def _evidence_events(spark, d):
    obs = observations(spark, d).select("entity_key", F.col("offset_h").alias("event_h"), F.col("variable").alias("label"), "value")
    return outcome.evidence_events({"device": (obs, F.col("label").isin("view", "click") & (F.col("value") > 30)), "status": (obs, F.col("label").isin("error", "signup") & (F.col("value") > 60))})


@query("i04_evidence_domains", f"WITH {_EV} SELECT entity_key, round(event_h, 6) AS event_h, domain, label FROM ee")
def _(spark, d):
    return rounded(_evidence_events(spark, d))


@query("i05_corroborated_starts", f"""WITH {_EV}, pr AS (SELECT a.*, s.event_h AS s_h, s.domain AS s_domain, s.label AS s_label FROM ee a JOIN ee s ON a.entity_key = s.entity_key AND abs(a.event_h - s.event_h) <= 6),
u AS (SELECT entity_key, event_h, count(DISTINCT s_domain) AS n_domains FROM pr WHERE s_domain <> domain GROUP BY ALL
UNION ALL SELECT DISTINCT entity_key, greatest(event_h, s_h), 1 FROM pr WHERE s_domain = domain AND s_label <> label)
SELECT entity_key, round(event_h, 6) AS event_h, max(n_domains) AS n_domains FROM u GROUP BY entity_key, event_h""")
def _(spark, d):
    ev = _evidence_events(spark, d)
    return rounded(outcome.corroborated_starts(ev, ev, 6.0))


@query("i06_evidence_union", f"WITH {OBS} SELECT DISTINCT entity_key, round(offset_h, 6) AS event_h FROM obs WHERE variable IN ('purchase', 'signup')")
def _(spark, d):
    return rounded(outcome.evidence_union(evidence(spark, d, "purchase"), evidence(spark, d, "signup")))


#: Discharges of the adapted tables are no earlier than deaths; here a third of the entities leave 6 hours before they die, a third half a minute after.
_LEFT = "CASE CAST(entity_key AS BIGINT) % 3 WHEN 0 THEN coalesce(death_h - 6, exit_h) WHEN 1 THEN coalesce(death_h + 1.0 / 120, exit_h) ELSE exit_h END"
_MINUTE = 1 / 60


def _with_exits(spark, d):
    third = F.col("entity_key").cast("long") % 3
    left = F.when(third == 0, F.coalesce(F.col("death_h") - 6, "exit_h")).when(third == 1, F.coalesce(F.col("death_h") + F.lit(1.0) / 120, "exit_h")).otherwise(F.col("exit_h"))
    return outcomes(spark, d).withColumn("left_h", left)


def _competing_sql(event):
    dead = f"coalesce(death_h > landmark_h AND death_h <= end_h AND ({event} IS NULL OR death_h < {event}), false)"
    left = f"coalesce(left_h > landmark_h AND left_h <= end_h AND ({event} IS NULL OR left_h < {event}), false)"
    return f"CASE WHEN {dead} AND {left} AND coalesce(abs(death_h - left_h) < {_MINUTE}, false) THEN 'both_same_time' WHEN {dead} THEN 'death' WHEN {left} THEN 'discharge' ELSE 'none' END"


_EXITS = OUTCOME + f", ends AS (SELECT *, {_LEFT} AS left_h FROM outcomes)"


@query("i08_competing_events", f"WITH {_EXITS} SELECT entity_key, landmark_h, horizon_h, {_competing_sql('strict_first_h')} AS competing_event_type FROM ends")
def _(spark, d):
    return outcome.competing_event(_with_exits(spark, d), "strict_first_h", exit_="left_h", tolerance_h=_MINUTE).select(*KEYS, "horizon_h", "competing_event_type")


_PHENO = "CASE evidence_grade WHEN 'A' THEN strict_first_h WHEN 'Unknown' THEN broad_first_h END"


@query("i09_phenotype_competing_events", f"WITH {_EXITS} SELECT entity_key, landmark_h, horizon_h, {_competing_sql('(' + _PHENO + ')')} AS competing_event_type FROM ends")
def _(spark, d):
    rows = _with_exits(spark, d)
    return outcome.competing_event(rows, outcome.phenotype_event(rows, {"A": "strict_first_h", "Unknown": "broad_first_h"}), exit_="left_h", tolerance_h=_MINUTE).select(*KEYS, "horizon_h", "competing_event_type")


@query("i10_outcome_counts", f"WITH {OUTCOME} SELECT landmark_h, horizon_h, evidence_grade, count(*) AS n_rows, count(DISTINCT entity_key) AS n_entities FROM outcomes GROUP BY ALL")
def _(spark, d):
    return outcome.outcome_counts(outcomes(spark, d))


@query("i11_evaluable_rows", f"WITH {_TRAJECTORY.replace(SPINE, OUTCOME)} SELECT entity_key, landmark_h, o.outcome, variable, round(median, 6) AS median FROM tr JOIN outcomes o USING (entity_key, landmark_h) WHERE horizon_h = 48 AND o.outcome IN (0, 1)")
def _(spark, d):
    return rounded(outcome.evaluable(trajectory(spark, d), outcomes(spark, d), 48).select(*KEYS, "outcome", "variable", "median"))


@query("i12_fixed_window", f"WITH {OUTCOME} SELECT entity_key, landmark_h, cluster_key, outcome FROM outcomes WHERE horizon_h = 72 AND landmark_h = 168 AND outcome IN (0, 1)")
def _(spark, d):
    return outcome.evaluable(landmarks(spark, d).select(*KEYS, "cluster_key"), outcomes(spark, d), 72, 168).select(*KEYS, "cluster_key", "outcome")


@query("p07_reclassification_audit", f"""WITH {_EXITS}, c AS (SELECT {_competing_sql('strict_first_h')} AS stored, {_competing_sql('(' + _PHENO + ')')} AS corrected FROM ends)
SELECT a.stored, b.corrected, coalesce(n, 0) AS n FROM (SELECT DISTINCT stored FROM c) a CROSS JOIN (SELECT DISTINCT corrected FROM c) b LEFT JOIN (SELECT stored, corrected, count(*) AS n FROM c GROUP BY ALL) x ON x.stored = a.stored AND x.corrected = b.corrected""")
def _(spark, d):
    from tidemark.operators import scenarios

    rows = _with_exits(spark, d)
    event = outcome.phenotype_event(rows, {"A": "strict_first_h", "Unknown": "broad_first_h"})
    stored, corrected = (outcome.competing_event(rows, e, exit_="left_h", tolerance_h=_MINUTE) for e in ("strict_first_h", event))
    return scenarios.reclassification_audit(stored, corrected, "competing_event_type")


__all__ = ["predictor_matrix", "registry", "trajectory", "joins", "quality", "reshape"]
