"""Cluster bootstrap of paired metrics, with draws from hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.metrics import EPS, METRICS, score_counts
from tidemark.operators.ranks import row_numbers, with_bucket
from tidemark.sources import written

#: Rows of a slice that are weighted at a time.
CHUNK = 1024
#: What a slice of scores adds to the metrics of a replicate.
PARTS = ["events", "others", "area", "steps", "squares", "losses"]


def _drawn(clusters: DataFrame, cluster: str, replicates: range, seed: Column) -> DataFrame:
    """(draw, replicate, no, weight, cluster) of the distinct (draw, cluster) rows: every draw has clusters and a seed of its own."""
    numbered = row_numbers(clusters, ["__draw", cluster], "no", ["__draw"])
    sizes = numbered.groupBy("__draw").agg(F.count(F.lit(1)).alias("n"))
    draws = numbered.select("__draw", "no", F.explode(F.sequence(F.lit(replicates.start), F.lit(replicates.stop - 1))).alias("replicate")).join(sizes, "__draw")
    number = F.conv(F.substring(F.md5(F.concat_ws("|", seed.cast("string"), "replicate", "no")), 1, 13), 16, 10).cast("long")
    weights = draws.select("__draw", "replicate", (number % F.col("n")).alias("no")).groupBy("__draw", "replicate", "no").agg(F.count(F.lit(1)).alias("weight"))
    return weights.join(numbered, ["__draw", "no"])


def cluster_weights(clusters: DataFrame, cluster: str, replicates: range, seed: int) -> DataFrame:
    """(replicate, cluster, weight > 0): how often each replicate draws a cluster, n draws from n with replacement.

    A draw is the MD5 of seed, replicate and its number, so any executor makes
    the same draws, and models and comparisons share them. Clusters are
    numbered in their order.
    """
    rows = clusters.select(F.lit(0).alias("__draw"), cluster).distinct()
    return _drawn(rows, cluster, replicates, F.lit(seed)).select("replicate", cluster, "weight")


def _packed_draws(drawn: DataFrame, cluster: str, replicates: int) -> DataFrame:
    """(draw, cluster, weights): a cluster's row of the draw matrix, two bytes a replicate, compressed."""
    types = {f.name: f.dataType.simpleString() for f in drawn.schema.fields}

    def pack(table: pa.Table) -> pa.Table:
        row = np.zeros(replicates, "<u2")
        row[table.column("replicate").to_numpy()] = table.column("weight").to_numpy()
        return table.select(["__draw", cluster]).slice(0, 1).append_column("weights", pa.array([pa.compress(row.tobytes(), codec="zstd", asbytes=True)], pa.binary()))

    return drawn.groupBy("__draw", cluster).applyInArrow(pack, f"__draw {types['__draw']}, `{cluster}` {types[cluster]}, weights binary")


def _weighted(table: pa.Table, replicates: int):
    """Score, and weighted positives and negatives of every replicate, by falling score, in chunks of whole scores.

    table: the clusters of a slice, each with its counts by score and its row
    of the draw matrix; a chunk is the product of the two.
    """
    cells = table.column("cells").combine_chunks()
    owner = np.repeat(np.arange(table.num_rows), cells.value_lengths().to_numpy(zero_copy_only=False))
    flat = cells.flatten()
    score, tp, fp = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("score", "tp", "fp"))
    weights = np.stack([np.frombuffer(pa.decompress(x, decompressed_size=2 * replicates, codec="zstd", asbytes=True), "<u2") for x in table.column("weights").to_pylist()])
    order = np.argsort(-score, kind="stable")
    owner, score, tp, fp = owner[order], score[order], tp[order], fp[order]
    ends = np.append(np.flatnonzero(np.diff(score)) + 1, len(score))
    start = 0
    while start < len(score):
        stop = int(ends[min(np.searchsorted(ends, start + CHUNK), len(ends) - 1)])
        w = weights[owner[start:stop]].astype(np.float64)
        head = np.flatnonzero(np.diff(score[start:stop], prepend=np.inf))
        yield score[start:stop][head], np.add.reduceat(w * tp[start:stop, None], head), np.add.reduceat(w * fp[start:stop, None], head)
        start = stop


def bootstrap(
    predictions: DataFrame, pairs: list[tuple[str, str]], cluster: str = "cluster_key", replicates: int = 1000, seed: int = 20260101, by: list[str] = (), seeds: dict | None = None
) -> DataFrame:
    """(by, replicate, comparison, metric, reference, candidate, difference) for pairs of model_id.

    Without seeds, clusters are drawn once for all groups. seeds, {value of
    the first by column: seed}, gives each of its values draws of its own, from
    its own clusters; rows of other values are left out.

    Rows are counted by cluster, score and outcome once, scores are cut into
    slices, and a slice's counts are gathered by cluster. A cluster's row of
    the draw matrix goes to each slice that has the cluster, two compressed
    bytes a replicate, however many rows it has there. A slice multiplies its
    counts by these rows for all replicates at once: a first pass sums it, a
    second adds the metrics' terms of every score with the sums of the slices
    above it. Replicates with one class only give no row.
    """
    by, keys = list(by), ["model_id", *by]
    counts = score_counts(predictions, "outcome", "probability", None, [*keys, cluster]).where(F.col(cluster).isNotNull())
    if seeds is None:
        counts, seed_of = counts.withColumn("__draw", F.lit("all")), F.lit(seed)
    else:
        names = {str(k): v for k, v in seeds.items()}
        counts = counts.withColumn("__draw", F.col(by[0]).cast("string")).where(F.col("__draw").isin(list(names)))
        seed_of = F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.col("__draw"))
    drawn = _drawn(counts.select("__draw", cluster).distinct(), cluster, range(replicates), seed_of)
    sliced = with_bucket(counts, keys, "score").groupBy(*keys, "__draw", F.col("__bucket").alias("slice"), cluster).agg(F.collect_list(F.struct("score", "tp", "fp")).alias("cells"))
    packed = written(sliced.join(_packed_draws(drawn, cluster, replicates), ["__draw", cluster]).select(*keys, "slice", "cells", "weights"), "bootstrap-slices")
    types = {f.name: f.dataType.simpleString() for f in packed.schema.fields}
    group = ", ".join(f"`{c}` {types[c]}" for c in keys)

    def named(table: pa.Table, names: list[str], **columns) -> pa.Table:
        out = table.select(names).slice(0, 1)
        for name, value in columns.items():
            out = out.append_column(name, pa.array([value.tobytes()], pa.binary()))
        return out

    def heights(table: pa.Table) -> pa.Table:
        total = np.zeros((2, replicates))
        for _, tp, fp in _weighted(table, replicates):
            total += tp.sum(axis=0), fp.sum(axis=0)
        return named(table, [*keys, "slice"], height=total)

    def bases(table: pa.Table) -> pa.Table:
        """What lies above each slice of a group: a row per slice."""
        table = table.take(pa.array(np.argsort(-table.column("slice").to_numpy(), kind="stable")))
        own = np.stack([np.frombuffer(x).reshape(2, replicates) for x in table.column("height").to_pylist()])
        above = np.cumsum(own, axis=0) - own
        return table.select([*keys, "slice"]).append_column("base", pa.array([x.tobytes() for x in above], pa.binary()))

    def terms(table: pa.Table, below: pa.Table) -> pa.Table:
        cum_tp, cum_fp = np.frombuffer(below.column("base")[0].as_py()).reshape(2, replicates)
        out = np.zeros((len(PARTS), replicates))
        for score, tp, fp in _weighted(table, replicates):
            ctp, cfp = cum_tp + np.cumsum(tp, axis=0), cum_fp + np.cumsum(fp, axis=0)
            s, p = score[:, None], np.clip(score, EPS, 1 - EPS)[:, None]
            every = ctp + cfp
            out += (
                tp.sum(axis=0), fp.sum(axis=0), (fp * (ctp - tp / 2)).sum(axis=0), (tp * np.divide(ctp, every, out=np.zeros_like(ctp), where=every > 0)).sum(axis=0),
                (tp * (1 - s) ** 2 + fp * s**2).sum(axis=0), (-tp * np.log(p) - fp * np.log1p(-p)).sum(axis=0),
            )
            cum_tp, cum_fp = ctp[-1], cfp[-1]
        return named(table, keys, parts=out)

    def add(table: pa.Table) -> pa.Table:
        """The sums of a group's slices, a row per replicate."""
        total = sum(np.frombuffer(x).reshape(len(PARTS), replicates) for x in table.column("parts").to_pylist())
        same = {c: pa.array([table.column(c)[0].as_py()] * replicates, table.schema.field(c).type) for c in keys}
        return pa.table(same | {"replicate": np.arange(replicates, dtype=np.int32)} | dict(zip(PARTS, total)))

    height = packed.groupBy(*keys, "slice").applyInArrow(heights, f"{group}, slice {types['slice']}, height binary")
    base = height.groupBy(*keys).applyInArrow(bases, f"{group}, slice {types['slice']}, base binary")
    parts = packed.groupBy(*keys, "slice").cogroup(base.groupBy(*keys, "slice")).applyInArrow(terms, f"{group}, parts binary")
    found = parts.groupBy(*keys).applyInArrow(add, f"{group}, replicate int, " + ", ".join(f"{p} double" for p in PARTS)).where("events > 0 AND others > 0")
    c, n = F.col, F.col("events") + F.col("others")
    values = dict(zip(METRICS, (c("area") / (c("events") * c("others")), c("steps") / c("events"), c("squares") / n, c("losses") / n)))
    cells = F.array(*(F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in values.items()))
    # A row per group and replicate from here on; all pairs of models come from one pivot.
    wide = found.select(*by, "replicate", "model_id", F.explode(cells).alias("x")).groupBy(*by, "replicate", "x.metric").agg(F.map_from_entries(F.collect_list(F.struct("model_id", "x.value"))).alias("m"))
    sides = F.array(*(F.struct(F.lit(f"{b}_vs_{a}").alias("comparison"), F.element_at("m", F.lit(a)).alias("reference"), F.element_at("m", F.lit(b)).alias("candidate")) for a, b in pairs))
    rows = wide.select(*by, "replicate", "metric", F.explode(sides).alias("s")).select(*by, "replicate", "s.comparison", "metric", "s.reference", "s.candidate")
    return rows.where("reference IS NOT NULL AND candidate IS NOT NULL").withColumn("difference", F.col("candidate") - F.col("reference"))


def scenario_seed(seed: int, index: int) -> int:
    return seed + 10_000 * index


def scenario_seeds(names: list[str], seed: int) -> dict[str, int]:
    """A seed for each scenario, by its place in the list."""
    return {name: scenario_seed(seed, i) for i, name in enumerate(names)}


def percentile_ci(reps: DataFrame, by: list[str] = ()) -> DataFrame:
    """2.5 and 97.5 percentiles of reference, candidate and difference, and the number of replicates."""
    aggs = [F.count_distinct("replicate").alias("replicates")]
    for c in ("reference", "candidate", "difference"):
        aggs += [F.percentile(c, F.lit(0.025)).alias(f"{c}_low"), F.percentile(c, F.lit(0.975)).alias(f"{c}_high")]
    return reps.groupBy(*by, "comparison", "metric").agg(*aggs)
