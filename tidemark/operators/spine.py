"""Landmark spines: who is at risk at which time points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import joins
from tidemark.spec import KEYS, WindowSpec


def landmark_spine(cohort: DataFrame, spec: WindowSpec) -> DataFrame:
    """A row per entity and grid point at which it is present.

    cohort: entity_key, exit_h, death_h (may be null) and further columns,
    which are kept. A point t counts while exit_h > t and death_h is null or > t.
    """
    grid = F.sequence(F.lit(spec.start).cast("long"), F.lit(spec.stop).cast("long"), F.lit(spec.step).cast("long"))
    rows = cohort.where(F.lit(spec.start <= spec.stop)).withColumn("landmark_h", F.explode(grid))
    return rows.where((F.col("exit_h") > F.col("landmark_h")) & (F.col("death_h").isNull() | (F.col("death_h") > F.col("landmark_h"))))


def at_risk(spine: DataFrame, exclude: list[DataFrame], require: list[DataFrame], spec: WindowSpec, since: float | None = None) -> DataFrame:
    """Spine rows without earlier evidence and with at least one measurement in the look-back window.

    exclude, require: tables of (entity_key, event_h). Evidence counts from
    the hour ``since`` (any time, if None) up to and including the landmark.
    The earliest evidence of an entity decides, so each table is aggregated
    to a row per entity first.
    """
    rows = spine
    for evidence in exclude:
        known = evidence if since is None else evidence.where(F.col("event_h") >= since)
        first = known.groupBy(F.col("entity_key").alias("__entity")).agg(F.min("event_h").alias("__first"))
        rows = rows.join(first, (rows["entity_key"] == first["__entity"]) & (first["__first"] <= rows["landmark_h"]), "left_anti")
    if require:
        seen = [joins.expand(m.select("entity_key", "event_h"), spec, offset="event_h").select(*KEYS) for m in require]
        every = seen[0]
        for more in seen[1:]:
            every = every.union(more)
        rows = rows.join(every.distinct(), KEYS, "left_semi")
    return rows


def observations(sources: list[DataFrame], spec: WindowSpec) -> DataFrame:
    """Union of (entity_key, offset_h, variable, value, source_priority) tables, without nulls and what no window reaches."""
    columns = ["entity_key", "offset_h", "variable", "value", "source_priority"]
    every = sources[0].select(*columns)
    for more in sources[1:]:
        every = every.unionByName(more.select(*columns))
    return every.where(F.col("value").isNotNull() & (F.col("offset_h") > spec.start - spec.lookback) & (F.col("offset_h") <= spec.stop))


def expand_to_landmarks(obs: DataFrame, spine: DataFrame, spec: WindowSpec, lookback: float | None = None, resolve: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Observations under the landmarks of the spine whose look-back window holds them, from one exchange of the observations, by entity.

    An entity's landmarks travel as one array, no longer than the grid. What
    follows by entity and further keys needs no other exchange; so does
    resolve, which is applied before observations are copied.
    """
    present = spine.groupBy(F.col("entity_key").alias("__entity")).agg(F.collect_set(F.col("landmark_h").cast("long")).alias("__present"))
    rows = obs.repartition("entity_key")
    rows = rows if resolve is None else resolve(rows)
    held = F.array_intersect(joins.grid_of(F.col("offset_h"), spec, lookback), F.col("__present"))
    return rows.join(present, rows["entity_key"] == present["__entity"]).withColumn("landmark_h", F.explode(held)).drop("__present", "__entity")
