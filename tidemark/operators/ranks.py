"""Running sums and exact quantiles of few, large groups, without a group in one task."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources import written

#: Parts of a group's order, between sketched quantiles of its distinct values.
BUCKETS = 64


#: Of so many distinct values, one goes into the sketch of a group's order.
SAMPLED = 16


def with_bucket(rows: DataFrame, by: list[str], value: str, buckets: int = BUCKETS) -> DataFrame:
    """rows with __bucket, the place of a value among splitters of its group's rows: sketched quantiles of a hashed sample of them.

    The sketches are merged partition by partition, and a group has a few
    edges; clumped values get buckets as full as spread ones. Splitters say
    only where the buckets meet, so results do not depend on the sample; a
    group of few values, which may have none, is one bucket. Sketches depend on
    the order in which they are merged, so the splitters are written once: all
    that is made of the returned rows sees the same buckets.
    """
    qs = F.array(*(F.lit(i / buckets) for i in range(1, buckets)))
    seen = rows.where(F.pmod(F.xxhash64(value), F.lit(SAMPLED)) == 0)
    edges = seen.groupBy(*(F.col(c).alias(f"__e_{c}") for c in by)).agg(F.array_distinct(F.percentile_approx(value, qs, F.lit(1000))).alias("__edges"))
    edges = written(edges, "splitters")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__e_{c}")) for c in by], F.lit(True))
    place = F.when(F.col("__edges").isNull(), 0).otherwise(F.size(F.filter("__edges", lambda e: e < F.col(value))))
    return rows.join(edges, same, "left").withColumn("__bucket", place).drop("__edges", *(f"__e_{c}" for c in by))


def running(counts: DataFrame, by: list[str], value: str, sums: list[str], descending: bool = False) -> DataFrame:
    """counts (a row per by and value) with upto_<s>, the sum of s up to this value, and total_<s>.

    Sums of buckets take one window over a few rows a group; a second window
    runs within each bucket.
    """
    keys = [*by, "__all"]
    order = -F.col(value) if descending else F.col(value)
    rows = with_bucket(counts.withColumns({"__all": F.lit(0), "__x": order.cast("double")}), keys, "__x")
    totals = rows.groupBy(*keys, "__bucket").agg(*(F.sum(s).alias(f"__b_{s}") for s in sums))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    totals = totals.select(*keys, "__bucket", *(F.coalesce(F.sum(f"__b_{s}").over(before), F.lit(0)).alias(f"__base_{s}") for s in sums), *(F.sum(f"__b_{s}").over(every).alias(f"total_{s}") for s in sums))
    inside = Window.partitionBy(*keys, "__bucket").orderBy("__x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(totals, [*keys, "__bucket"])
    rows = rows.withColumns({f"upto_{s}": F.col(f"__base_{s}") + F.sum(s).over(inside) for s in sums})
    return rows.drop("__all", "__x", "__bucket", *(f"__base_{s}" for s in sums))


def row_numbers(rows: DataFrame, order: list[str], name: str, within: list[str] = ()) -> DataFrame:
    """rows (with a total order) numbered from 0 in it, or from 0 within each value of the columns that lead the order.

    Sampled splitters range-partition the rows; a partition numbers its own,
    and the sizes of the partitions, one number each, give its offset. No
    window runs over all rows. The numbered rows are written once, as the
    splitters of another evaluation may differ.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumns({"__pid": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    sizes = {r["__pid"]: r["count"] for r in dealt.groupBy("__pid").count().collect()}  # a row per partition
    offsets, total = [], 0
    for pid in sorted(sizes):
        offsets.append((pid, total))
        total += sizes[pid]
    offsets = rows.sparkSession.createDataFrame(offsets, "__pid int, __offset long")
    numbered = dealt.join(F.broadcast(offsets), "__pid").withColumn(name, F.col("__offset") + F.col("__at")).drop("__pid", "__at", "__offset")
    if within:
        first = numbered.groupBy(*within).agg(F.min(name).alias("__first"))
        numbered = numbered.join(first, list(within)).withColumn(name, F.col(name) - F.col("__first")).drop("__first")
    return numbered


def exact_quantiles(df: DataFrame, by: list[str], value: str, qs: list[float]) -> DataFrame:
    """(by, quantiles): exact quantiles, interpolated between neighbours, of the values that aren't null.

    Values are counted first; the sums of sketched buckets tell which few
    buckets hold the wanted ranks, and only these are sorted.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("n"))
    keys = [*by, "__all"]
    rows = with_bucket(counts.withColumn("__all", F.lit(0)), keys, "__v")
    heights = rows.groupBy(*keys, "__bucket").agg(F.sum("n").alias("__height"))
    group = Window.partitionBy(*keys)
    upto = F.sum("__height").over(group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    heights = heights.withColumns({"__below": upto - F.col("__height"), "__total": F.sum("__height").over(group)})
    ranks = [f((F.col("__total") - 1) * q) for q in qs for f in (F.floor, F.ceil)]
    wanted = F.lit(False)
    for rank in ranks:
        wanted = wanted | ((F.col("__below") <= rank) & (rank < F.col("__below") + F.col("__height")))
    few = rows.join(heights.where(wanted), [*keys, "__bucket"])
    inside = Window.partitionBy(*keys, "__bucket").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    few = few.withColumn("__upto", F.col("__below") + F.sum("n").over(inside))
    found = []
    for q in qs:
        at = (F.col("__total") - 1) * q
        pick = lambda rank: F.max(F.when((F.col("__upto") - F.col("n") <= rank) & (rank < F.col("__upto")), F.col("__v")))
        found.append((pick(F.floor(at)), pick(F.ceil(at)), F.max(at - F.floor(at))))
    return few.groupBy(*keys).agg(F.array(*(low + part * (high - low) for low, high, part in found)).alias("quantiles")).drop("__all")


def quantiles_of_counts(counts: DataFrame, by: str, value: str, ns: list[str], qs: list[float]) -> dict[tuple, list[float]]:
    """Exact quantiles of distinct values (by, value, counts ns) under each column of counts, by (by, place in ns); none where all counts are 0.

    The driver gets the counts of sketched buckets, which say in which bucket
    a wanted rank is and which it is there; these buckets are sorted in tasks.
    """
    rows = with_bucket(counts.where(F.col(value).isNotNull()), [by], value)
    heights: dict = {}
    for r in rows.groupBy(by, "__bucket").agg(*(F.sum(n).alias(n) for n in ns)).collect():  # a row per bucket
        heights.setdefault(r[by], {})[r["__bucket"]] = [r[n] for n in ns]
    wanted: dict[tuple, list[tuple[int, int]]] = {}  # (place in ns, rank in the bucket) by group and bucket
    places: dict[tuple, list] = {}
    for g, found in heights.items():
        buckets = sorted(found)
        upto = np.cumsum([found[b] for b in buckets], axis=0)
        for i in range(len(ns)):
            total = int(upto[-1, i])
            for q in qs if total else ():
                at, pair = (total - 1) * q, []
                for rank in (int(np.floor(at)), int(np.ceil(at))):
                    k = int(np.searchsorted(upto[:, i], rank, "right"))
                    pair.append((buckets[k], i, rank - (int(upto[k - 1, i]) if k else 0)))
                    wanted.setdefault((g, buckets[k]), []).append(pair[-1][1:])
                places.setdefault((g, i), []).append((pair, float(at - np.floor(at))))

    def pick(table: pa.Table) -> pa.Table:
        asked = sorted(set(wanted[table.column("g")[0].as_py(), table.column("b")[0].as_py()]))
        v = table.column("v").to_numpy()
        order, out = np.argsort(v), []
        for i, rank in asked:
            out.append(float(v[order][np.searchsorted(np.cumsum(table.column(ns[i]).to_numpy()[order]), rank, "right")]))
        n = len(asked)
        return pa.table({"g": pa.array([table.column("g")[0].as_py()] * n, table.schema.field("g").type), "b": pa.array([table.column("b")[0].as_py()] * n, pa.int32()), "i": pa.array([a[0] for a in asked], pa.int32()), "rank": pa.array([a[1] for a in asked], pa.int64()), "x": pa.array(out)})

    if not wanted:
        return {}
    kind = counts.schema[by].dataType.simpleString()
    few = rows.sparkSession.createDataFrame(list(wanted), f"g {kind}, b int")
    few = rows.select(F.col(by).alias("g"), F.col("__bucket").alias("b"), F.col(value).cast("double").alias("v"), *ns).join(F.broadcast(few), ["g", "b"])
    x = {(r["g"], r["b"], r["i"], r["rank"]): r["x"] for r in few.groupBy("g", "b").applyInArrow(pick, f"g {kind}, b int, i int, rank long, x double").collect()}  # a row per wanted rank
    return {(g, i): [x[(g, *a)] + part * (x[(g, *b)] - x[(g, *a)]) for (a, b), part in each] for (g, i), each in places.items()}


def distinct_counts(rows: DataFrame, by: list[str], columns: dict[str, Column]) -> DataFrame:
    """(by, a count per name): exact distinct counts of several columns, nulls left out.

    Each is an aggregation of its own over its own column, so no row is
    multiplied: integers are bits of bitmaps, which merge before they are
    shuffled; other values are reduced to distinct ones first.
    """
    out = None
    for name, column in columns.items():
        one = rows.select(*by, column.alias("__x")).where("__x IS NOT NULL")
        if one.schema["__x"].dataType.typeName() in ("byte", "short", "integer", "long"):
            x = F.col("__x").cast("long")
            bits = one.groupBy(*by, F.bitmap_bucket_number(x).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("__bits"))
            found = bits.groupBy(*by).agg(F.sum(F.bitmap_count("__bits")).alias(name))
        else:
            found = one.distinct().groupBy(*by).agg(F.count(F.lit(1)).alias(name))
        groups = rows.select(*by).distinct() if out is None else out
        out = _left_by(groups, found, by, name)
    return out


def _left_by(left: DataFrame, right: DataFrame, by: list[str], name: str) -> DataFrame:
    """left with a count of right, 0 where it has none; null keys are equal."""
    right = right.select(*(F.col(c).alias(f"__r_{c}") for c in by), name)
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in by], F.lit(True))
    return left.join(right, same, "left").drop(*(f"__r_{c}" for c in by)).withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
