"""Mixing sources to target weights by weighted sampling with exponential keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import NOT_SPACE, Scratch

#: Rows of one slice of the key order.
SLICE_ROWS = 50_000


def text_quality(text: Column) -> Column:
    """A weight in [0.1, 1]: the share of characters that are neither ASCII symbols, digits nor capitals."""
    text = F.coalesce(text, F.lit(""))
    odd = F.length(text) - F.length(F.translate(text, "!#$%&*|<>{}=+~^_@0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return F.when(F.length(text) > 0, F.greatest(F.lit(0.1), 1.0 - odd / F.length(text))).otherwise(F.lit(0.1))


def source_targets(sized: DataFrame, weights: tuple[float, ...], budget: float, max_epochs: float) -> DataFrame:
    """Word targets per source from the (source, size) rows.

    Sources in code point order, null last, take the weights in rotation and
    share budget times the whole size; no target exceeds max_epochs times its
    source's size, and the excess goes to the others by weight until none is
    above. That end state gives each source min(cap, level * weight) for one
    level, which prefix sums over the sources in order of cap / weight find.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    totals = totals.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (order % len(weights) + 1).cast("int")))
    totals = totals.withColumn("cap", max_epochs * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everywhere = Window.partitionBy()
    totals = totals.withColumns(
        {
            "goal": budget * F.sum("source_size").over(everywhere),
            "capped": F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)),
            "open_weight": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
            "place": F.row_number().over(by_ratio),
        }
    )
    # The level if this and all later sources stay below their caps; it is right from the first source that does.
    level = (F.col("goal") - F.coalesce("capped", F.lit(0.0))) / F.col("open_weight")
    totals = totals.withColumn("level", level)
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    found = F.min(F.when(fits, F.struct("place", "level"))).over(everywhere)
    totals = totals.withColumn("found", found["level"])
    return totals.select("source", "source_size", F.when(F.col("found").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("found") * F.col("weight"))).alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: Column | None = None,
    weights: tuple[float, ...] = (3, 1, 2),
    budget: float = 1.5,
    max_epochs: int = 2,
    seed: int = 20260101,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """How many words of each document a weighted mix of the sources takes.

    Every document draws an exponential key -ln(u) / quality from a hash of
    its identifier. A source takes all of its documents once per complete
    epoch of its target; the rest of the target goes to the documents of
    least key, by a prefix sum over the key order. A document that crosses the
    target is taken if more than half of it fits, so that a source misses its
    target by half a document at most.

    The order of (source, key) is cut into slices of equal numbers of rows by
    sampled splitters, whatever the weights are; a slice is the unit of
    sorting, so no source has to fit one task.

    Returns one row per input row: identifier, source, size, source_size,
    target, taken, and the columns named in keep. Null text has size 0; null is a source of its own, the
    last. Repeated rows are separate documents with one key.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    text = F.coalesce(F.col(text_col), F.lit(""))
    quality = text_quality(F.col(text_col)) if quality is None else F.greatest(F.coalesce(quality.cast("double"), F.lit(0.0)), F.lit(1e-6))
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    unit = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    sized = scratch.save(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            F.regexp_count(text, F.lit(NOT_SPACE)).cast("long").alias("size"),
            (-F.log(unit) / quality).alias("key"),
            *keep,
        ),
        "sized",
    )
    targets = source_targets(sized, weights, budget, max_epochs)
    n_slices = max(1, -(-sized.count() // SLICE_ROWS))
    order = [F.col(c).asc_nulls_last() for c in ("key", "id", "size", *keep)]
    sliced = sized.repartitionByRange(n_slices, F.col("source").asc_nulls_last(), *order)
    rows = scratch.save(sliced.withColumn("slice", F.spark_partition_id()), "sliced")
    targets = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    # A row per source and slice.
    heights = rows.groupBy("source", "slice").agg(F.sum("size").alias("height"))
    below = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    heights = heights.select(F.col("source").alias("h_source"), F.col("slice").alias("h_slice"), F.coalesce(F.sum("height").over(below), F.lit(0)).alias("base"))
    heights = heights.join(targets, F.col("h_source").eqNullSafe(F.col("t_source"))).drop("t_source")
    within = Window.partitionBy("slice", "source").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum("size").over(within))
    rows = rows.join(heights, (F.col("slice") == F.col("h_slice")) & F.col("source").eqNullSafe(F.col("h_source")))
    before = F.col("base") + F.col("upto") - F.col("size")
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(F.lit(0))
    rows = rows.withColumns({"before": before, "epochs": epochs})
    extra = (F.col("epochs") < max_epochs) & (F.col("before") + F.col("size") / 2 < F.col("target") - F.col("epochs") * F.col("source_size"))
    return rows.select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        (F.col("size") * (F.col("epochs") + extra.cast("int"))).cast("long").alias("taken"),
        *keep,
    )
