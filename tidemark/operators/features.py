"""Look-back features per (entity, landmark, variable)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import earliest, latest, ordinal_level
from tidemark.operators import joins
from tidemark.operators.spine import expand_to_landmarks
from tidemark.spec import KEYS, WindowSpec

GROUP = [*KEYS, "variable"]


def _position(spec: WindowSpec) -> Column:
    return F.col("offset_h") - (F.col("landmark_h") - spec.lookback)


def bin_index(spec: WindowSpec, closed: str = "right") -> Column:
    """Bin 0 .. bins - 1 of an offset in its window; bins are (a, b], or [a, b) if closed is left."""
    x = _position(spec) / spec.bin
    raw = F.ceil(x) - 1 if closed == "right" else F.floor(x)
    return F.greatest(F.lit(0), F.least(F.lit(spec.bins - 1), raw)).cast("int")


def resolve_points(obs: DataFrame) -> DataFrame:
    """(entity_key, variable, offset_h, value): of every time point the best source's value, the median where several remain.

    Neither depends on a landmark, so points are resolved once, before they
    are copied to the landmarks whose windows hold them.
    """
    point = ["entity_key", "variable", "offset_h"]
    best = F.min("source_priority").over(Window.partitionBy(*point))
    return obs.withColumn("best", best).where("source_priority = best").groupBy(*point).agg(F.median("value").alias("value"))


def select_source(expanded: DataFrame, spec: WindowSpec, level: str = "timepoint") -> DataFrame:
    """The values of the best source (least source_priority) per time point or per bin; their median where several remain.

    level "timepoint" returns a row per (keys, variable, offset_h), "bin" one
    per (keys, variable, bin_index).
    """
    part = [*GROUP, "offset_h"] if level == "timepoint" else [*GROUP, "bin_index"]
    rows = expanded if level == "timepoint" else expanded.withColumn("bin_index", bin_index(spec))
    best = F.min("source_priority").over(Window.partitionBy(*part))
    return rows.withColumn("best", best).where("source_priority = best").groupBy(*part).agg(F.median("value").alias("value"))


def window_bins(rows: DataFrame, spec: WindowSpec, closed: str = "right") -> DataFrame:
    """Median per bin of the window, with the bin's midpoint relative to the landmark."""
    bins = rows.withColumn("bin_index", bin_index(spec, closed)).groupBy(*GROUP, "bin_index").agg(F.median("value").alias("bin_median"))
    return bins.withColumn("bin_midpoint_relative_h", (F.lit(-spec.lookback + spec.bin / 2) + spec.bin * F.col("bin_index")).cast("double"))


def source_bins(obs: DataFrame, spec: WindowSpec) -> DataFrame:
    """Absolute right-closed bins (end - bin, end] per entity and variable, each aggregated once."""
    end = (F.ceil(F.col("offset_h") / spec.bin) * spec.bin).cast("long")
    return (
        obs.withColumn("bin_end_h", end)
        .groupBy("entity_key", "variable", "bin_end_h")
        .agg(
            F.median("value").alias("bin_median"),
            F.count("value").alias("measurement_count"),
            latest("value", "offset_h").alias("bin_latest_value"),
            F.max("offset_h").alias("bin_latest_offset_h"),
        )
    )


def map_bins(bins: DataFrame, spine: DataFrame, spec: WindowSpec) -> DataFrame:
    """Absolute bins under the landmarks whose windows they are part of. Landmarks must lie on bin edges."""
    if spec.start % spec.bin or spec.step % spec.bin:
        raise ValueError("the grid does not lie on bin edges")
    rows = bins.withColumn("landmark_h", F.explode(joins.grid_of(F.col("bin_end_h"), spec))).join(spine.select(*KEYS), KEYS)
    index = ((F.col("bin_end_h") - F.col("landmark_h") + spec.lookback) / spec.bin - 1).cast("int")
    rows = rows.withColumn("bin_index", index)
    return rows.withColumn("bin_midpoint_relative_h", (F.lit(-spec.lookback + spec.bin / 2) + spec.bin * F.col("bin_index")).cast("double"))


def _theil_sen(points: Column) -> Column:
    """Median of the slopes of all pairs of (x, y) points; points are as few as a window has bins."""
    n = F.size(points)
    slopes = F.flatten(
        F.transform(
            points,
            lambda a, i: F.transform(F.slice(points, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda b: (b["y"] - a["y"]) / (b["x"] - a["x"])),
        )
    )
    ordered = F.array_sort(slopes)
    m = F.size(ordered)
    low = F.get(ordered, F.floor((m - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(m / 2).cast("int"))
    return F.when(m > 0, (low + high) / 2)


def level_stats(bins: DataFrame) -> DataFrame:
    """Count, median, min, max, sample SD and IQR (from two bins on) of the bin medians."""
    q = F.percentile("bin_median", F.array(F.lit(0.25), F.lit(0.75)))
    two = F.count("bin_median") >= 2
    return bins.groupBy(*GROUP).agg(
        F.count("bin_median").alias("nonempty_bin_count"),
        F.median("bin_median").alias("median"),
        F.min("bin_median").alias("min"),
        F.max("bin_median").alias("max"),
        F.when(two, F.stddev_samp("bin_median")).alias("sd"),
        F.when(two, q[1] - q[0]).alias("iqr"),
    )


def theil_sen(bins: DataFrame, least_bins: int = 4) -> DataFrame:
    """Robust slope per hour over the bin medians; null under least_bins bins."""
    points = F.array_sort(F.collect_list(F.struct(F.col("bin_midpoint_relative_h").alias("x"), F.col("bin_median").alias("y"))))
    grouped = bins.groupBy(*GROUP).agg(points.alias("points"))
    return grouped.select(*GROUP, F.when(F.size("points") >= least_bins, _theil_sen(F.col("points"))).alias("theilsen_slope"))


def point_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*GROUP).agg(F.count("value").alias("measurement_count"), latest("value", "offset_h").alias("latest_value"), F.max("offset_h").alias("latest_offset_h"))


def _limits(thresholds: DataFrame) -> DataFrame:
    """Thresholds (variable, below, above) for a join that leaves the rows where they are; dealt by variable, they would go to as many tasks as there are variables."""
    return F.broadcast(thresholds.select(F.col("variable").alias("__variable"), "below", "above"))  # a row per variable


def _flag(bins: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Bins of the variables with thresholds (variable, below, above), flagged if under or over them."""
    t = _limits(thresholds)
    abnormal = F.coalesce(F.col("bin_median") < F.col("below"), F.lit(False)) | F.coalesce(F.col("bin_median") > F.col("above"), F.lit(False))
    return bins.join(t, bins["variable"] == t["__variable"]).select(*bins.columns, abnormal.alias("abnormal"))


def abnormal_burden(bins: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Share of the non-empty bins that are abnormal."""
    return _flag(bins, thresholds).groupBy(*GROUP).agg(F.avg(F.col("abnormal").cast("int")).alias("abnormal_prop"))


def longest_run(bins: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Most abnormal bins in a row; a missing bin ends a run; 0 if none is abnormal."""
    order = Window.partitionBy(*GROUP).orderBy("bin_index")
    # An abnormal bin's run began after the last bin that is missing or not abnormal; one sort by group, and no groups by run.
    gap = F.coalesce(F.lag("bin_index").over(order) < F.col("bin_index") - 1, F.lit(True))
    broken = F.when(~F.col("abnormal"), F.col("bin_index")).when(F.col("gap"), F.col("bin_index") - 1)
    runs = _flag(bins, thresholds).withColumn("gap", gap).withColumn("broken", F.max(broken).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    length = F.when(F.col("abnormal"), F.col("bin_index") - F.col("broken"))
    return runs.groupBy(*GROUP).agg(F.coalesce(F.max(length), F.lit(0)).cast("long").alias("longest_abnormal_run"))


def trajectory_features(obs: DataFrame, spine: DataFrame, spec: WindowSpec, thresholds: DataFrame) -> DataFrame:
    """All statistics of a window per (keys, variable), in one pass over the resolved and expanded time points.

    Bins, slopes and runs follow from arrays that are as short as a window.
    """
    seen = F.when(F.col("value").isNotNull(), F.struct("offset_h", "value"))
    binned = expand_to_landmarks(obs, spine, spec, resolve=resolve_points).withColumn("bin_index", bin_index(spec)).groupBy(*GROUP, "bin_index").agg(
        F.median("value").alias("bin_median"), F.count("value").alias("n_points"), F.max(seen).alias("last_point"), F.max("offset_h").alias("last_h")
    )
    binned = binned.withColumn("bin_midpoint_relative_h", (F.lit(-spec.lookback + spec.bin / 2) + spec.bin * F.col("bin_index")).cast("double"))
    per_bin = F.array_sort(F.collect_list(F.struct(F.col("bin_midpoint_relative_h").alias("x"), F.col("bin_median").alias("y"), "bin_index")))
    q = F.percentile("bin_median", F.array(F.lit(0.25), F.lit(0.75)))
    two = F.count("bin_median") >= 2
    bins = binned.groupBy(*GROUP).agg(
        F.count("bin_median").alias("nonempty_bin_count"),
        F.median("bin_median").alias("median"),
        F.min("bin_median").alias("min"),
        F.max("bin_median").alias("max"),
        F.when(two, F.stddev_samp("bin_median")).alias("sd"),
        F.when(two, q[1] - q[0]).alias("iqr"),
        per_bin.alias("bins"),
        F.sum("n_points").alias("measurement_count"),
        F.max("last_point").alias("last_point"),
        F.max("last_h").alias("latest_offset_h"),
    )
    bins = bins.withColumn("latest_value", F.col("last_point")["value"])
    t = _limits(thresholds)
    bins = bins.join(t, bins["variable"] == t["__variable"], "left").drop("__variable")
    bad = lambda b: F.coalesce(b["y"] < F.col("below"), F.lit(False)) | F.coalesce(b["y"] > F.col("above"), F.lit(False))
    known = F.col("below").isNotNull() | F.col("above").isNotNull()
    run = F.aggregate(
        "bins",
        F.struct(F.lit(0).alias("best"), F.lit(0).alias("now"), F.lit(-2).alias("at")),
        lambda s, b: F.struct(
            F.greatest(s["best"], F.when(bad(b), F.when(b["bin_index"] == s["at"] + 1, s["now"] + 1).otherwise(1)).otherwise(0)).alias("best"),
            F.when(bad(b), F.when(b["bin_index"] == s["at"] + 1, s["now"] + 1).otherwise(1)).otherwise(0).alias("now"),
            F.when(bad(b), b["bin_index"]).otherwise(F.lit(-2)).alias("at"),
        ),
    )["best"]
    bins = bins.withColumns(
        {
            "theilsen_slope": F.when(F.size("bins") >= 4, _theil_sen(F.col("bins"))),
            "abnormal_prop": F.when(known, F.size(F.filter("bins", bad)) / F.size("bins")),
            "longest_abnormal_run": F.when(known, run.cast("long")),
        }
    )
    measured = ["measurement_count", "latest_value", "latest_offset_h"]
    levels = ["nonempty_bin_count", "median", "min", "max", "sd", "iqr", "theilsen_slope", "abnormal_prop", "longest_abnormal_run"]
    return bins.select(*GROUP, *measured, *levels)


def delta_features(expanded: DataFrame) -> DataFrame:
    """Level and change over the time points of a window; delta and slope need two times."""
    points = expanded.groupBy(*GROUP, "offset_h").agg(F.median("value").alias("value"))
    first, last = earliest("value", "offset_h"), latest("value", "offset_h")
    span = F.max("offset_h") - F.min("offset_h")
    two = F.count("value") >= 2
    return points.groupBy(*GROUP).agg(
        last.alias("latest_value"),
        F.max("offset_h").alias("latest_offset_h"),
        F.median("value").alias("median"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.when(two, last - first).alias("delta_value"),
        F.when(two, (last - first) / span).alias("slope_value"),
        F.count("value").alias("measurement_count"),
    )


def latest_in_window(obs: DataFrame, spine: DataFrame, spec: WindowSpec, hours: float, name: str) -> DataFrame:
    """The latest value of one variable in the last hours before each landmark; every spine row stays."""
    found = joins.expand(obs, spec, hours).groupBy(*KEYS).agg(latest("value", "offset_h").alias(name), F.max(F.when(F.col("value").isNotNull(), F.col("offset_h"))).alias(f"{name}_offset_h"))
    return spine.join(found, KEYS, "left")


def ordinal_events(df: DataFrame, rules: list[tuple[str, int]], text: str, sentinel: int = -2) -> DataFrame:
    """(entity_key, offset_h, level): the greatest level per time; times with the sentinel level are dropped."""
    levels = df.withColumn("level", ordinal_level(text, rules)).where(F.col("level").isNotNull())
    grouped = levels.groupBy("entity_key", "offset_h").agg(F.max(F.when(F.col("level") >= 0, F.col("level"))).alias("level"), F.bool_or(F.col("level") == sentinel).alias("odd"))
    return grouped.where(~F.col("odd") & F.col("level").isNotNull()).drop("odd")


def ordinal_features(events: DataFrame, spine: DataFrame, spec: WindowSpec) -> DataFrame:
    """Latest and greatest level, rises over the level before, number of levels and age of the latest."""
    rows = expand_to_landmarks(events, spine, spec)
    before = F.lag("level").over(Window.partitionBy(*KEYS).orderBy("offset_h"))
    return (
        rows.withColumn("rise", (F.col("level") > before).cast("int"))
        .groupBy(*KEYS)
        .agg(
            latest("level", "offset_h").alias("latest_level"),
            F.max("level").alias("max_level"),
            F.coalesce(F.sum("rise"), F.lit(0)).alias("escalation_count"),
            F.count("level").alias("documentation_count"),
            F.max("offset_h").alias("latest_offset_h"),
            (F.max("landmark_h") - F.max("offset_h")).alias("time_since_latest_h"),
        )
    )


def nested_sums(events: DataFrame, spine: DataFrame, spec: WindowSpec, hours: list[int], low: float, high: float) -> DataFrame:
    """Sum and count of plausible amounts in several windows that end at the landmark, in one pass."""
    rows = expand_to_landmarks(events.where((F.col("amount") >= low) & (F.col("amount") <= high)), spine, spec, max(hours))
    inside = {h: F.col("offset_h") > F.col("landmark_h") - h for h in hours}
    return rows.groupBy(*KEYS).agg(
        *(F.sum(F.when(c, F.col("amount"))).alias(f"sum_{h}h") for h, c in inside.items()),
        *(F.count(F.when(c, F.col("amount"))).alias(f"count_{h}h") for h, c in inside.items()),
        F.max("offset_h").alias("latest_offset_h"),
    )


def interval_exposure(intervals: DataFrame, spine: DataFrame, spec: WindowSpec) -> DataFrame:
    """Intervals (entity_key, start_h, end_h, agents) that overlap the window: any, active at the landmark, most agents in one."""
    rows = joins.overlapping(intervals, spec).join(spine.select(*KEYS), KEYS)
    now = (F.col("start_h") <= F.col("landmark_h")) & (F.col("end_h") >= F.col("landmark_h"))
    return rows.groupBy(*KEYS).agg(F.lit(1).alias("any_exposure"), F.max(now.cast("int")).alias("current_exposure"), F.max("agents").alias("max_agents"), F.max("start_h").alias("latest_start_h"))


def point_exposure(events: DataFrame, spine: DataFrame, spec: WindowSpec, fresh_h: float = 2) -> DataFrame:
    """Point records (entity_key, offset_h, agent, active): an agent is current if its last record is active and fresh.

    agents counts the agents that were active anywhere in the window.
    """
    rows = expand_to_landmarks(events, spine, spec)
    per_agent = rows.groupBy(*KEYS, "agent").agg(F.max(F.col("active").cast("int")).alias("ever"), latest(F.col("active").cast("int"), "offset_h").alias("last"), F.max("offset_h").alias("at"))
    fresh = (F.col("last") == 1) & (F.col("at") >= F.col("landmark_h") - fresh_h)
    return per_agent.groupBy(*KEYS).agg(F.max("ever").alias("any_exposure"), F.max(fresh.cast("int")).alias("current_exposure"), F.sum("ever").alias("agents"), F.max("at").alias("latest_offset_h"))


def site_capability(records: DataFrame, sites: DataFrame, site: str = "cluster_key") -> DataFrame:
    """(site, supported): whether a site ever has a record."""
    return sites.select(site).distinct().join(records.select(site).distinct().withColumn("supported", F.lit(True)), site, "left").withColumn("supported", F.coalesce("supported", F.lit(False)))


def mask_unsupported(df: DataFrame, flag: str, columns: list[str]) -> DataFrame:
    """Unsupported sites get null; supported ones without a record get 0."""
    return df.withColumns({c: F.when(F.col(flag), F.coalesce(c, F.lit(0))) for c in columns})


def static_context(parts: list[DataFrame], spine: DataFrame) -> DataFrame:
    """Static columns under every landmark: several sources united by name, with the body-mass index."""
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    metres = F.col("height_cm") / 100
    every = every.withColumn("bmi", F.when((F.col("height_cm") > 0) & (F.col("weight_kg") > 0), F.col("weight_kg") / (metres * metres)))
    return spine.select(*KEYS).join(every, "entity_key", "left")
