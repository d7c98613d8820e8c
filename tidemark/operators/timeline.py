"""Rows of several tables on one timeline per key, cut into blocks with a halo."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A block is this many times as long as the halo.
BLOCK = 8
#: Hours below a microsecond: times that are nearer are the same.
MOMENT = 1e-10


def block_of(time: Column, width: float) -> Column:
    return F.floor(time / F.lit(float(width)))


def blocks_of(time: Column, width: float, back: float = 0.0, ahead: float = 0.0) -> Column:
    """All blocks that hold a moment of [time - back, time + ahead]: two at most where the width is no less than back + ahead."""
    return F.sequence(block_of(time - F.lit(float(back)), width), block_of(time + F.lit(float(ahead)), width))


def evidence_in_windows(windows: DataFrame, evidence: dict[str, DataFrame], by: dict[str, list[Column]] | None = None, key: str = "entity_key", start: str = "landmark_h", end: str = "end_h", time: str = "event_h", reach: float | None = None) -> DataFrame:
    """windows with the first evidence in (start, end], and how much there is, of every evidence table.

    Windows and all evidence tables are laid on one timeline and shuffled
    once, by key and block of time; evidence that a window of an earlier block
    can reach goes there, too, so a busy key is spread over its blocks and no
    pairs of windows and events are made. A window is two rows, its start and
    its end: what lies between is the difference of running counts, and the
    first evidence is the next one after the start. reach is the length of the
    longest window; without it, one aggregation finds it.

    For each name: <name>_first_h, <name>_rows, <name>_times (distinct times)
    and, with by, <name>_distinct (distinct combinations of time and by).
    Evidence without a key or time counts nowhere; windows without a key have
    none. Repeated windows stay repeated.
    """
    by = by or {}
    if reach is None:
        reach = windows.agg(F.max(F.col(end) - F.col(start))).first()[0]
    reach = max(float(reach or 0), 1e-9)
    width = BLOCK * reach
    own = F.struct(*windows.columns)
    tail = [F.lit(None).cast("string").alias("__name"), F.lit(None).cast("string").alias("__what")]
    points = F.array(F.struct(F.col(start).cast("double").alias("x"), F.lit(1).alias("kind")), F.struct(F.col(end).cast("double").alias("x"), F.lit(2).alias("kind")))
    window_rows = windows.select(F.col(key).alias("__key"), block_of(F.col(start), width).alias("__block"), own.alias("__own"), F.explode(points).alias("__p"))
    window_rows = window_rows.select("__key", "__block", "__p.x", "__p.kind", *tail, "__own")
    rows = [window_rows]
    for name, df in evidence.items():
        what = F.to_json(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(by[name]))), {"ignoreNullFields": "false"}) if by.get(name) else F.lit(None).cast("string")
        at = F.col(time).cast("double")
        df = df.where(F.col(key).isNotNull() & F.col(time).isNotNull())
        rows.append(df.select(F.col(key).alias("__key"), F.explode(blocks_of(at, width, back=reach)).alias("__block"), at.alias("x"), F.lit(0).alias("kind"), F.lit(name).alias("__name"), what.alias("__what"), F.lit(None).cast(window_rows.schema["__own"].dataType).alias("__own")))
    line = reduce(DataFrame.unionByName, rows)
    # Evidence comes before a start or an end at the same time: it is not after that start, and it is inside that end.
    order = Window.partitionBy("__key", "__block").orderBy("x", "kind", "__name", "__what")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same_time, same_what = F.struct("x", "__name"), F.struct("x", "__name", "__what")
    line = line.withColumns({"__new_time": ~F.coalesce(F.lag(same_time).over(order) == same_time, F.lit(False)), "__new_what": ~F.coalesce(F.lag(same_what).over(order).eqNullSafe(same_what), F.lit(False))})
    found = {}
    for name in evidence:
        is_name = F.coalesce(F.col("__name") == name, F.lit(False))
        found[f"__first_{name}"] = F.expr(f"lead(CASE WHEN __name = '{name}' THEN x END) IGNORE NULLS OVER (PARTITION BY __key, __block ORDER BY x, kind, __name, __what)")
        found[f"__rows_{name}"] = F.sum(is_name.cast("long")).over(upto)
        found[f"__times_{name}"] = F.sum((is_name & F.col("__new_time")).cast("long")).over(upto)
        if by.get(name):
            found[f"__distinct_{name}"] = F.sum((is_name & F.col("__new_what")).cast("long")).over(upto)
    line = line.withColumns(found).where("kind > 0")
    # Start and end of a window meet in its partition.
    both = Window.partitionBy("__key", "__block", F.col("__own")[start], F.col("__own")[end])
    counts = [c for c in found if not c.startswith("__first_")]
    line = line.withColumns({c: F.max(F.when(F.col("kind") == 2, F.col(c))).over(both) - F.col(c) for c in counts}).where("kind = 1")
    out = []
    for name in evidence:
        first = F.col(f"__first_{name}")
        out.append(F.when(first <= F.col("__own")[end], first).alias(f"{name}_first_h"))
        out += [F.greatest(F.coalesce(F.col(f"__{c}_{name}"), F.lit(0)), F.lit(0)).cast("long").alias(f"{name}_{c}") for c in ("rows", "times", *(["distinct"] if by.get(name) else []))]
    return line.select("__own.*", *out)


def with_prior(rows: DataFrame, by: list[str], entity: str, time: str, level: str, gap: float, prior: str = "__prior") -> DataFrame:
    """rows with the greatest level that their entity has had in the gap before: [time - gap, time).

    Of rows at the same time, only the first of the greatest level has a
    prior of its own; for the others it is their own level. Frames run by
    entity and block of time; rows within the gap before a block are copied to
    it, so an entity with many rows is spread over its blocks.
    """
    gap = max(float(gap), MOMENT)
    width = BLOCK * gap
    keys = [*by, entity, "__block"]
    rows = rows.withColumn("__at", F.col(time).cast("double"))
    spread = rows.withColumn("__block", F.explode_outer(blocks_of(F.col("__at"), width, ahead=gap)))
    parts = ", ".join(f"`{k}`" for k in keys)
    before = F.expr(f"max(`{level}`) OVER (PARTITION BY {parts} ORDER BY __at RANGE BETWEEN {gap!r}D PRECEDING AND {MOMENT!r}D PRECEDING)")
    place = F.row_number().over(Window.partitionBy(*keys, "__at").orderBy(F.desc(level)))
    spread = spread.withColumns({"__place": place, "__before": before}).where(F.col("__block").eqNullSafe(block_of(F.col("__at"), width)))
    return spread.withColumn(prior, F.when(F.col("__place") == 1, F.col("__before")).otherwise(F.col(level))).drop("__at", "__block", "__place", "__before")
