"""Sensitivity scenarios: relabelled and filtered rows, evaluated alike."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import bootstrap, calibration, joins, metrics, quality
from tidemark.spec import KEYS


@dataclass(frozen=True)
class Scenario:
    name: str
    include: Column
    positive: Column


def apply_scenarios(df: DataFrame, scenarios: list[Scenario]) -> DataFrame:
    """A copy of each row per scenario that includes it, with the scenario's 0/1 outcome."""
    cells = F.array_compact(F.array(*(F.when(s.include, F.struct(F.lit(s.name).alias("scenario"), F.coalesce(s.positive, F.lit(False)).cast("int").alias("outcome"))) for s in scenarios)))
    rest = [c for c in df.columns if c != "outcome"]
    return df.select(*rest, F.explode(cells).alias("__s")).select("__s.scenario", "__s.outcome", *rest)


def first_landmark_only(df: DataFrame, first: int) -> DataFrame:
    return df.where(F.col("landmark_h") == first)


def complete_sites(df: DataFrame, flags: DataFrame, site: str, columns: list[str]) -> DataFrame:
    """Rows of the sites whose flags are all 1 on all their rows."""
    full = quality.constant_groups(flags, site, columns)
    for c in columns:
        full = full.where(F.col(c) == 1)
    return df.join(full.select(site), site, "left_semi")


def calibration_of(df: DataFrame) -> DataFrame:
    return calibration.calibration(df, ["scenario", "model_id"])


def utility_of(df: DataFrame, thresholds: list[float]) -> DataFrame:
    return calibration.decision_curve(df, thresholds, ["scenario", "model_id"])


def evaluate_scenarios(df: DataFrame, pairs: list[tuple[str, str]], thresholds: list[float], replicates: int, seeds: dict[str, int]) -> dict[str, DataFrame]:
    """Points with confidence intervals, calibration and decision curves, per scenario; each scenario has its own seed and clusters."""
    points = metrics.paired(df, pairs, by=["scenario"])
    intervals = bootstrap.percentile_ci(bootstrap.bootstrap(df, pairs, replicates=replicates, by=["scenario"], seeds=seeds), ["scenario"])
    return {
        "comparison": points.join(intervals, ["scenario", "comparison", "metric"]),
        "calibration": calibration_of(df),
        "utility": utility_of(df, thresholds),
    }


def reclassification_audit(stored: DataFrame, corrected: DataFrame, column: str) -> DataFrame:
    """Counts of all pairs of a row's stored and corrected class."""
    keys = [*KEYS, "horizon_h"]
    both = joins.merge_one_to_one(stored.select(*keys, F.col(column).alias("stored")), corrected.select(*keys, F.col(column).alias("corrected")), keys)
    return quality.crosstab(both, "stored", "corrected")
