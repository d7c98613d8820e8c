"""Registration of queries, and the tables that they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import expit, hash_fold, hours_since
from tidemark.operators import joins, outcome, spine
from tidemark.sources import work_path
from tidemark.spec import KEYS, WindowSpec

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

ORIGIN = "2024-01-01 00:00:00"
SPEC = WindowSpec(168, 648, 24, 168, 28)
#: A grid whose landmarks lie on bin edges.
ALIGNED = WindowSpec(168, 648, 24, 144, 24)
THRESHOLDS = [("view", 20.0, 80.0), ("click", None, 60.0), ("error", None, 40.0), ("purchase", 30.0, None)]


def query(name: str, sql: str | None = None):
    """Registers a (spark, sf_dir) query, with the SQL of its rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal; negative zero becomes zero."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else c for c, t in df.dtypes))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("entity_key"),
        (F.col("user_id") % 20).cast("string").alias("cluster_key"),
        hours_since(ORIGIN, "ts").alias("offset_h"),
        F.col("event_type").alias("variable"),
        "value",
        (F.col("event_id") % 2).cast("int").alias("source_priority"),
    )


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy("entity_key", "cluster_key").agg(
        F.max("offset_h").alias("exit_h"), F.min(F.when((F.col("variable") == "error") & (F.col("value") > 150), F.col("offset_h"))).alias("death_h")
    )


def landmarks(spark: SparkSession, sf_dir: str, spec: WindowSpec = SPEC) -> DataFrame:
    return spine.landmark_spine(cohort(spark, sf_dir), spec)


def expanded(spark: SparkSession, sf_dir: str, spec: WindowSpec = SPEC) -> DataFrame:
    return spine.expand_to_landmarks(observations(spark, sf_dir), landmarks(spark, sf_dir, spec), spec)


def evidence(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return observations(spark, sf_dir).where(F.col("variable") == kind).select("entity_key", F.col("offset_h").alias("event_h"), F.col("value"))


def outcomes(spark: SparkSession, sf_dir: str, hours: tuple[int, ...] = (24, 48)) -> DataFrame:
    windows = outcome.horizons(landmarks(spark, sf_dir), list(hours), {168: [72]})
    windows = outcome.window_evidences(windows, {"strict": evidence(spark, sf_dir, "purchase"), "broad": evidence(spark, sf_dir, "signup")}, reach=72)
    return outcome.grade_outcome(windows, [("strict_first_h", "A", 1), ("broad_first_h", "Unknown", 9)])


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landmark rows with a known 24-hour outcome under two models, with scores that have ties."""
    y = outcomes(spark, sf_dir).where("horizon_h = 24 AND outcome IN (0, 1)").select(*KEYS, "cluster_key", "outcome")
    x = joins.expand(observations(spark, sf_dir), SPEC).groupBy(*KEYS).agg(F.count("value").cast("double").alias("n_seen"), F.sum("value").alias("total"))
    rows = y.join(x, KEYS, "left").withColumns({"n_seen": F.coalesce("n_seen", F.lit(0.0)), "total": F.coalesce("total", F.lit(0.0))})
    rows = rows.withColumn("outer_fold", hash_fold("cluster_key", 7, 5) + 1)
    m1 = F.round(expit(-1 + 0.03 * F.col("n_seen")), 3)
    m2 = F.round(expit(-1.5 + 0.02 * F.col("n_seen") + 0.001 * F.col("total")), 3)
    cells = F.array(F.struct(F.lit("m1").alias("model_id"), m1.alias("probability")), F.struct(F.lit("m2").alias("model_id"), m2.alias("probability")))
    return rows.withColumn("cell", F.explode(cells)).select(*KEYS, "cluster_key", "outer_fold", "outcome", "n_seen", "cell.model_id", "cell.probability")


OBS = """obs AS (SELECT CAST(user_id AS VARCHAR) AS entity_key, CAST(user_id % 20 AS VARCHAR) AS cluster_key,
  (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9 AS offset_h, event_type AS variable, value,
  CAST(event_id % 2 AS INTEGER) AS source_priority FROM events)"""
COHORT = OBS + """, cohort AS (SELECT entity_key, cluster_key, max(offset_h) AS exit_h,
  min(offset_h) FILTER (variable = 'error' AND value > 150) AS death_h FROM obs GROUP BY ALL)"""
SPINE = COHORT + """, spine AS (SELECT c.*, CAST(t AS BIGINT) AS landmark_h FROM cohort c, (SELECT unnest(generate_series(168, 648, 24)) AS t)
  WHERE exit_h > t AND (death_h IS NULL OR death_h > t))"""
WOBS = SPINE + """, wobs AS (SELECT k.entity_key, k.landmark_h, o.variable, o.offset_h, o.value, o.source_priority
  FROM spine k JOIN obs o ON o.entity_key = k.entity_key AND o.offset_h > k.landmark_h - 168 AND o.offset_h <= k.landmark_h)"""
OUTCOME = SPINE + """, win AS (SELECT *, landmark_h + horizon_h AS end_h FROM (
    SELECT *, unnest(CASE WHEN landmark_h = 168 THEN [24, 48, 72] ELSE [24, 48] END)::BIGINT AS horizon_h FROM spine)),
  strict AS (SELECT w.entity_key, w.landmark_h, w.horizon_h, min(offset_h) AS strict_first_h, count(*) AS strict_rows, count(DISTINCT offset_h) AS strict_times
    FROM win w JOIN obs o ON o.entity_key = w.entity_key AND variable = 'purchase' AND offset_h > landmark_h AND offset_h <= end_h GROUP BY ALL),
  broad AS (SELECT w.entity_key, w.landmark_h, w.horizon_h, min(offset_h) AS broad_first_h, count(*) AS broad_rows, count(DISTINCT offset_h) AS broad_times
    FROM win w JOIN obs o ON o.entity_key = w.entity_key AND variable = 'signup' AND offset_h > landmark_h AND offset_h <= end_h GROUP BY ALL),
  outcomes AS (SELECT w.*, strict_first_h, broad_first_h, coalesce(strict_rows, 0) AS strict_rows, coalesce(strict_times, 0) AS strict_times,
      coalesce(broad_rows, 0) AS broad_rows, coalesce(broad_times, 0) AS broad_times,
      CASE WHEN strict_first_h IS NOT NULL THEN 'A' WHEN broad_first_h IS NOT NULL THEN 'Unknown' ELSE 'None' END AS evidence_grade,
      CASE WHEN strict_first_h IS NOT NULL THEN 1 WHEN broad_first_h IS NOT NULL THEN 9 ELSE 0 END AS outcome
    FROM win w LEFT JOIN strict USING (entity_key, landmark_h, horizon_h) LEFT JOIN broad USING (entity_key, landmark_h, horizon_h))"""
HASH_FOLD = "CAST(CAST(('0x' || substr(sha256('{seed}|' || {value}), 1, 16)) AS UBIGINT) % {n} AS INTEGER)"
PREDICTIONS = OUTCOME + f""", seen AS (SELECT k.entity_key, k.landmark_h, count(value) AS n_seen, sum(value) AS total
    FROM spine k JOIN obs o ON o.entity_key = k.entity_key AND offset_h > landmark_h - 168 AND offset_h <= landmark_h GROUP BY ALL),
  base AS (SELECT o.entity_key, o.landmark_h, o.cluster_key, o.outcome, coalesce(CAST(n_seen AS DOUBLE), 0) AS n_seen, coalesce(total, 0) AS total,
      {HASH_FOLD.format(seed=7, value='o.cluster_key', n=5)} + 1 AS outer_fold
    FROM outcomes o LEFT JOIN seen USING (entity_key, landmark_h) WHERE horizon_h = 24 AND outcome IN (0, 1)),
  preds AS (SELECT entity_key, landmark_h, cluster_key, outer_fold, outcome, n_seen, 'm1' AS model_id, round(1 / (1 + exp(-(-1 + 0.03 * n_seen))), 3) AS probability FROM base
    UNION ALL SELECT entity_key, landmark_h, cluster_key, outer_fold, outcome, n_seen, 'm2', round(1 / (1 + exp(-(-1.5 + 0.02 * n_seen + 0.001 * total))), 3) FROM base)"""
#: Metrics of rows (by…, y, p), as a CTE chain that ends in ``met``; {src}, {by} are filled in.
METRICS = """, sc AS (SELECT {by}, probability AS s, sum(CAST(outcome = 1 AS INTEGER)) AS tp, sum(CAST(outcome = 0 AS INTEGER)) AS fp FROM {src} GROUP BY ALL),
  cu AS (SELECT *, sum(tp) OVER w AS ct, sum(fp) OVER w AS cf FROM sc WINDOW w AS (PARTITION BY {by} ORDER BY s DESC)),
  met AS (SELECT {by}, CAST(sum(tp + fp) AS DOUBLE) AS n, CAST(sum(tp) AS DOUBLE) AS events, sum(tp) / sum(tp + fp) AS prevalence,
      CASE WHEN sum(tp) > 0 AND sum(fp) > 0 THEN sum(fp * (ct - tp / 2)) / (sum(tp) * sum(fp)) END AS auroc,
      CASE WHEN sum(tp) > 0 AND sum(fp) > 0 THEN sum(tp * ct / (ct + cf)) / sum(tp) END AS auprc,
      CASE WHEN sum(tp) > 0 AND sum(fp) > 0 THEN sum(tp * (1 - s) * (1 - s) + fp * s * s) / sum(tp + fp) END AS brier,
      CASE WHEN sum(tp) > 0 AND sum(fp) > 0 THEN sum(-tp * ln(greatest(2.220446049250313e-16, s)) - fp * ln(greatest(2.220446049250313e-16, 1 - s))) / sum(tp + fp) END AS logloss
    FROM cu GROUP BY ALL)"""
