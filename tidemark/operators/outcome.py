"""Outcome labels: evidence after each landmark, its grade, and competing events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import joins, timeline
from tidemark.spec import KEYS

#: Label of rows whose outcome can't be known.
UNKNOWN = 9


def horizons(spine: DataFrame, hours: list[int], extra: dict[int, list[int]] | None = None) -> DataFrame:
    """Every landmark with every horizon; extra adds horizons to single landmarks."""
    cells = F.array(*(F.lit(h).cast("long") for h in hours))
    for landmark, more in (extra or {}).items():
        cells = F.when(F.col("landmark_h") == landmark, F.concat(cells, F.array(*(F.lit(h).cast("long") for h in more)))).otherwise(cells)
    return spine.withColumn("horizon_h", F.explode(cells)).withColumn("end_h", F.col("landmark_h") + F.col("horizon_h"))


def window_evidence(windows: DataFrame, evidence: DataFrame, name: str, by: list[Column] = (), reach: float | None = None) -> DataFrame:
    """First evidence in (t, t + h], and how much there is: rows, distinct times, and distinct combinations of ``by``."""
    return window_evidences(windows, {name: evidence}, {name: list(by)}, reach)


def window_evidences(windows: DataFrame, evidence: dict[str, DataFrame], by: dict[str, list[Column]] | None = None, reach: float | None = None) -> DataFrame:
    """window_evidence() of several evidence tables, from one shuffle; reach is the longest horizon, if known."""
    return timeline.evidence_in_windows(windows, evidence, by, reach=reach)


def evidence_events(sources: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Distinct (entity_key, event_h, domain, label) rows that meet their domain's rule."""
    parts = [df.where(rule).select("entity_key", "event_h", F.lit(d).alias("domain"), "label") for d, (df, rule) in sources.items()]
    return reduce(DataFrame.unionByName, parts).distinct()


def corroborated_starts(anchors: DataFrame, support: DataFrame, tolerance_h: float) -> DataFrame:
    """Anchors with support from another domain within the tolerance, or a differing label of their own domain.

    anchors, support: (entity_key, event_h, domain, label). A pair within one
    domain starts at the later of its two times. Returns distinct (entity_key,
    event_h, n_domains).
    """
    s = support.select("entity_key", F.col("event_h").alias("s_h"), F.col("domain").alias("s_domain"), F.col("label").alias("s_label"))
    pairs = joins.near(anchors, s, "entity_key", "event_h", "s_h", tolerance_h)
    cross = pairs.where("s_domain != domain").groupBy("entity_key", "event_h").agg(F.count_distinct("s_domain").alias("n_domains"))
    within = pairs.where("s_domain = domain AND s_label != label").select("entity_key", F.greatest("event_h", "s_h").alias("event_h")).distinct().withColumn("n_domains", F.lit(1).cast("long"))
    return cross.unionByName(within).groupBy("entity_key", "event_h").agg(F.max("n_domains").alias("n_domains"))


def evidence_union(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, [t.select("entity_key", "event_h") for t in tables]).distinct()


def grade_outcome(df: DataFrame, ladder: list[tuple[str, str, int]], otherwise: tuple[str, int] = ("None", 0)) -> DataFrame:
    """evidence_grade and outcome by the first column of the ladder (column, grade, label) that isn't null."""
    grade, label = F.lit(otherwise[0]), F.lit(otherwise[1])
    for column, g, y in reversed(ladder):
        grade, label = F.when(F.col(column).isNotNull(), F.lit(g)).otherwise(grade), F.when(F.col(column).isNotNull(), F.lit(y)).otherwise(label)
    return df.withColumns({"evidence_grade": grade, "outcome": label})


def competing_event(df: DataFrame, event: str | Column, death: str = "death_h", exit_: str = "exit_h", tolerance_h: float = 0.0) -> DataFrame:
    """competing_event_type: both_same_time, death, discharge or none, inside the horizon and before the event.

    A death that counts goes before a discharge, whichever came first. Death
    and discharge are at the same time if they differ by less than the
    tolerance, or are equal for a tolerance of 0.
    """
    event = F.col(event) if isinstance(event, str) else event
    counts = lambda c: F.coalesce((F.col(c) > F.col("landmark_h")) & (F.col(c) <= F.col("end_h")) & (event.isNull() | (F.col(c) < event)), F.lit(False))
    dead, left = counts(death), counts(exit_)
    gap = F.abs(F.col(death) - F.col(exit_))
    same = F.coalesce(gap < tolerance_h if tolerance_h else gap == 0, F.lit(False))
    kind = F.when(dead & left & same, "both_same_time").when(dead, "death").when(left, "discharge").otherwise("none")
    return df.withColumn("competing_event_type", kind)


def phenotype_event(df: DataFrame, times: dict[str, str]) -> Column:
    """The event time that goes with the row's grade; null for other grades."""
    found = F.lit(None).cast("double")
    for grade, column in times.items():
        found = F.when(F.col("evidence_grade") == grade, F.col(column)).otherwise(found)
    return found


def outcome_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("landmark_h", "horizon_h", "evidence_grade").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("entity_key").alias("n_entities"))


def evaluable(features: DataFrame, outcomes: DataFrame, horizon_h: int, landmark_h: int | None = None) -> DataFrame:
    """Feature rows with a known 0/1 outcome at one horizon (and landmark); keys stay unique."""
    labels = outcomes.where((F.col("horizon_h") == horizon_h) & F.col("outcome").isin(0, 1))
    if landmark_h is not None:
        labels = labels.where(F.col("landmark_h") == landmark_h)
    return features.join(labels.select(*KEYS, "outcome"), KEYS)
