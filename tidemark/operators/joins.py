"""Joins on ranges, and joins that check their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.spec import WindowSpec


def grid_of(offset, spec: WindowSpec, lookback: float | None = None, delay: float = 0):
    """The landmarks t with t - lookback < offset <= t - delay, as an array; null where there is none."""
    w = spec.lookback if lookback is None else lookback
    first = F.greatest(F.lit(spec.start), (F.ceil((offset + delay - spec.start) / spec.step) * spec.step + spec.start).cast("long"))
    last = F.least(F.lit(spec.start + (spec.stop - spec.start) // spec.step * spec.step), ((F.ceil((offset + w - spec.start) / spec.step) - 1) * spec.step + spec.start).cast("long"))
    return F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"), F.lit(spec.step).cast("long")))


def expand(events: DataFrame, spec: WindowSpec, lookback: float | None = None, offset: str = "offset_h") -> DataFrame:
    """A row per event and landmark whose look-back window (t - lookback, t] holds it.

    Turns the range join of landmarks and events into arithmetic: an event can
    serve a few grid points only, so it is copied to these and joined by keys.
    """
    return events.withColumn("landmark_h", F.explode(grid_of(F.col(offset), spec, lookback)))


def overlapping(intervals: DataFrame, spec: WindowSpec, start: str = "start_h", end: str = "end_h", closed: bool = False) -> DataFrame:
    """A row per interval and landmark with start <= t and end > t - lookback (or >=, if closed)."""
    first = F.greatest(F.lit(spec.start), (F.ceil((F.col(start) - spec.start) / spec.step) * spec.step + spec.start).cast("long"))
    reach = (F.col(end) + spec.lookback - spec.start) / spec.step
    last = (F.floor(reach) if closed else F.ceil(reach) - 1) * spec.step + spec.start
    last = F.least(F.lit(spec.start + (spec.stop - spec.start) // spec.step * spec.step), last.cast("long"))
    grid = F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"), F.lit(spec.step).cast("long")))
    return intervals.withColumn("landmark_h", F.explode(grid))


def near(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, tolerance: float) -> DataFrame:
    """Pairs with equal keys whose times differ by tolerance at most.

    Times are cut into buckets of the tolerance; a right row goes to its own
    bucket and both neighbours, so the join is by equality and a busy key is
    spread over its buckets. Columns of both sides must have different names,
    but for the key.
    """
    a = left.withColumn("__bucket", F.floor(F.col(left_time) / tolerance))
    b = right.withColumn("__bucket", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: F.floor(F.col(right_time) / tolerance) + d)))
    return a.join(b, [key, "__bucket"]).where(F.abs(F.col(left_time) - F.col(right_time)) <= tolerance).drop("__bucket")


def in_range(df: DataFrame, events: DataFrame, key: str, low: str, high: str, event_time: str = "event_h", how: str = "left", low_closed: bool = False, bucket: float = 24) -> DataFrame:
    """df joined with the events of its key in (low, high] (or [low, high]); how: inner, left, left_semi or left_anti.

    Time is cut into buckets: a row goes to the few that its range touches, an
    event to its own, and they meet by key and bucket, so a key with many rows
    and events is spread over its buckets and makes no pairs that are far
    apart. left, left_semi and left_anti join rows back by all their columns.
    """
    at = lambda c: F.floor(F.col(c) / bucket)
    spread = df.withColumn("__bucket", F.explode(F.when(at(low) <= at(high), F.sequence(at(low), at(high)))))
    e = events.withColumnRenamed(key, "__key").withColumn("__at", at(event_time))
    after = e[event_time] >= spread[low] if low_closed else e[event_time] > spread[low]
    met = (spread[key] == e["__key"]) & (spread["__bucket"] == e["__at"]) & after & (e[event_time] <= spread[high])
    extra = [c for c in events.columns if c != key]
    if how == "inner":
        return spread.join(e, met).select(*df.columns, *extra)
    hits = spread.join(e, met, "left_semi").select(*(F.col(c).alias(f"__h_{c}") for c in df.columns)).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"__h_{c}")) for c in df.columns]
    if how in ("left_semi", "left_anti"):
        return df.join(hits, same, how)
    alone = df.join(hits, same, "left_anti").select(*df.columns, *(F.lit(None).cast(events.schema[c].dataType).alias(c) for c in extra))
    return spread.join(e, met).select(*df.columns, *extra).unionByName(alone)


def complete(spine: DataFrame, levels: DataFrame, counts: DataFrame, on: list[str], value: str) -> DataFrame:
    """Every spine row with every level, with its count or 0.

    The levels' names travel as one array on the spine's rows, so their number
    is that of a list of categories.
    """
    every = levels.distinct().agg(F.collect_list(F.struct(*levels.columns)).alias("__levels"), F.lit(1).alias("__one"))
    every = spine.withColumn("__one", F.lit(1)).join(every, "__one").withColumn("__level", F.explode("__levels")).select(*spine.columns, *(F.col("__level")[c].alias(c) for c in levels.columns))
    return every.join(counts, on, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def require_unique(df: DataFrame, keys: list[str]) -> None:
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"keys repeat: {', '.join(keys)}")


def merge_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], complete_rows: bool = True) -> DataFrame:
    """Inner join on keys that must be unique on both sides; with complete_rows, no row may be lost."""
    require_unique(left, keys)
    require_unique(right, keys)
    joined = left.join(right, keys)
    if complete_rows and joined.count() != left.count():
        raise ValueError("rows have no partner")
    return joined


def merge_many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    require_unique(right, keys)
    return left.join(right, keys)


def align_models(predictions: DataFrame, keys: list[str], models: list[str], value: str = "probability") -> DataFrame:
    """Wide predictions of several models; every key must have all of them."""
    require_unique(predictions.where(F.col("model_id").isin(models)), [*keys, "model_id"])
    wide = predictions.groupBy(*keys).pivot("model_id", models).agg(F.first(value, ignorenulls=True))
    missing = F.lit(False)
    for m in models:
        missing = missing | F.col(m).isNull()
    if not wide.where(missing).isEmpty():
        raise ValueError("a key lacks a model's prediction")
    return wide


def first_match(df: DataFrame, lookup: DataFrame, keys: list[str], code: str, name: str) -> DataFrame:
    """The lookup's name under the first of the keys that has one. lookup: (code, name), unique codes."""
    out, found = df, []
    for i, k in enumerate(keys):
        side = lookup.select(F.col(code).alias(f"__code{i}"), F.col(name).alias(f"__name{i}"))
        out = out.join(side, out[k] == side[f"__code{i}"], "left").drop(f"__code{i}")
        found.append(f"__name{i}")
    return out.withColumn(name, F.coalesce(*found)).drop(*found)
