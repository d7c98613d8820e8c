"""Exact ranking and probability metrics, by group, with weights."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import row_numbers, running
from tidemark.sources import written

#: Machine epsilon of double, the clip of the log loss.
EPS = 2.220446049250313e-16
#: Of a step of average precision, for sums that do not depend on their order.
UNITS = 1 << 40
METRICS = ["auroc", "auprc", "brier", "logloss"]


def score_counts(df: DataFrame, outcome: str, score: str, weight: str | None = None, by: list[str] = ()) -> DataFrame:
    """(by, score, tp, fp): the weight of positives and negatives at every distinct score."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return df.where(F.col(outcome).isin(0, 1) & F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(F.col(outcome) == 1, w).otherwise(0.0)).alias("tp"), F.sum(F.when(F.col(outcome) == 0, w).otherwise(0.0)).alias("fp")
    )


def ranked(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """counts with cum_tp and cum_fp, the weight at this score or above."""
    rows = running(counts, list(by), "score", ["tp", "fp"], descending=True)
    return rows.withColumnsRenamed({"upto_tp": "cum_tp", "upto_fp": "cum_fp"}).drop("total_tp", "total_fp")


def metrics_of(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """The metrics of score_counts(): n, events, prevalence, auroc, auprc, brier, logloss; null with one class only.

    AUROC gives ties half credit; AUPRC is the step sum of average precision.
    """
    rows = ranked(counts, by)
    p = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), F.col("score")))
    out = rows.groupBy(*by).agg(
        F.sum("tp").alias("events"),
        F.sum("fp").alias("others"),
        F.sum(F.col("fp") * (F.col("cum_tp") - F.col("tp") / 2)).alias("area"),
        F.sum(F.when(F.col("tp") > 0, F.col("tp") * F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))).otherwise(0.0)).alias("steps"),
        F.sum(F.col("tp") * (1 - F.col("score")) * (1 - F.col("score")) + F.col("fp") * F.col("score") * F.col("score")).alias("squares"),
        F.sum(-F.col("tp") * F.log(p) - F.col("fp") * F.log(1 - p)).alias("losses"),
    )
    return _finished(out, by)


def _finished(out: DataFrame, by: list[str]) -> DataFrame:
    """The metrics of the sums over a group's scores."""
    n = F.col("events") + F.col("others")
    both = (F.col("events") > 0) & (F.col("others") > 0)
    return out.select(
        *by,
        n.alias("n"),
        "events",
        (F.col("events") / n).alias("prevalence"),
        F.when(both, F.col("area") / (F.col("events") * F.col("others"))).alias("auroc"),
        F.when(both, F.col("steps") / F.col("events")).alias("auprc"),
        F.when(both, F.col("squares") / n).alias("brier"),
        F.when(both, F.col("losses") / n).alias("logloss"),
    )


def ranking_metrics(df: DataFrame, outcome: str = "outcome", score: str = "probability", weight: str | None = None, by: list[str] = ()) -> DataFrame:
    return metrics_of(score_counts(df, outcome, score, weight, by), by)


class ScorePacks:
    """Scores and outcomes of many fits on their way out of a task, packed by fit and range of scores.

    A range is of the scores with equal leading bits, a sixteenth of a power
    of two, so ranges are the same in every task. Equal scores are counted.
    """

    LIMIT = 2_000_000  #: scores that a task holds

    def __init__(self):
        self.held, self.size = {}, 0

    @staticmethod
    def schema(by: list[str]) -> str:
        return ", ".join([*(f"{c} int" for c in by), "bucket int, tp double, fp double, scores binary, tps binary, fps binary"])

    def add(self, key: tuple[int, ...], scores: np.ndarray, outcomes: np.ndarray) -> None:
        self.held.setdefault(key, []).append((scores, outcomes))
        self.size += len(scores)

    def full(self):
        if self.size >= self.LIMIT:
            yield from self.rest()

    def rest(self):
        rows = []
        for key, parts in self.held.items():
            y = np.concatenate([p[1] for p in parts])
            s, at = np.unique(np.concatenate([p[0] for p in parts]) + 0.0, return_inverse=True)
            tp, fp = np.bincount(at, y == 1, len(s)), np.bincount(at, y == 0, len(s))
            places = (s.view(np.int64) >> 48).astype(np.int32)
            cuts = [0, *(np.flatnonzero(np.diff(places)) + 1).tolist(), len(s)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    rows.append((*key, int(places[a]), float(tp[a:b].sum()), float(fp[a:b].sum()), s[a:b].tobytes(), tp[a:b].astype(np.uint32).tobytes(), fp[a:b].astype(np.uint32).tobytes()))
        self.held, self.size = {}, 0
        if rows:
            columns = list(zip(*rows))
            n = len(columns) - 6
            kinds = [*[pa.int32()] * (n + 1), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 10_000], t) for c, t in zip(columns, kinds)], names=[f"c{j}" for j in range(n + 6)])


def pack_scores(df: DataFrame, by: list[str], outcome: str = "outcome", score: str = "probability") -> DataFrame:
    """ScorePacks of (by, outcome, score) rows, by integers."""

    def pack(batches):
        packs = ScorePacks()
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in by], 1)
            y, s = (batch.column(c).to_numpy() for c in ("y", "s"))
            for key in np.unique(keys, axis=0):
                own = (keys == key).all(1)
                packs.add(tuple(key.tolist()), s[own], y[own])
            yield from packs.full()
        yield from packs.rest()

    rows = df.where(F.col(outcome).isin(0, 1) & F.col(score).isNotNull())
    return rows.select(*(F.col(c).cast("int").alias(c) for c in by), F.col(outcome).cast("double").alias("y"), F.col(score).cast("double").alias("s")).mapInArrow(pack, ScorePacks.schema(by))


def packed_metrics(packs: DataFrame, by: list[str]) -> DataFrame:
    """ranking_metrics() of ScorePacks: each range of scores is ranked in a task of its own, above it counts only.

    Steps are added as integers, so fits that rank the rows alike have one AUPRC, whatever their ranges.
    """
    packs = written(packs, "scores")
    ranges = packs.groupBy(*by, "bucket").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    above = Window.partitionBy(*by).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*by, "bucket", F.coalesce(F.sum("tp").over(above), F.lit(0.0)).alias("tp_above"), F.coalesce(F.sum("fp").over(above), F.lit(0.0)).alias("fp_above"))
    rows = packs.drop("tp", "fp").join(F.broadcast(ranges), [*by, "bucket"])  # a row per fit and range
    sums = ["events", "others", "area", "squares", "losses"]

    def rank(table: pa.Table) -> pa.Table:
        read = lambda c, kind: np.concatenate([np.frombuffer(b, kind) for b in table.column(c).to_pylist()])
        s, at = np.unique(read("scores", np.float64), return_inverse=True)
        tp, fp = (np.bincount(at, read(c, np.uint32), len(s))[::-1] for c in ("tps", "fps"))
        s = s[::-1]
        p = np.clip(s, EPS, 1 - EPS)
        ct, cf = table.column("tp_above")[0].as_py() + np.cumsum(tp), table.column("fp_above")[0].as_py() + np.cumsum(fp)
        steps = np.divide(tp * ct, ct + cf, out=np.zeros(len(s)), where=tp > 0)
        whole = np.floor(steps)
        steps = int(whole.sum()) * UNITS + int(np.rint((steps - whole) * UNITS).astype(np.int64).sum())
        values = [tp.sum(), fp.sum(), (fp * (ct - tp / 2)).sum(), (tp * (1 - s) ** 2 + fp * s * s).sum(), (-tp * np.log(p) - fp * np.log(1 - p)).sum()]
        return pa.table({**{c: table.column(c).slice(0, 1) for c in by}, **{c: pa.array([float(v)]) for c, v in zip(sums, values)}, "steps": pa.array([Decimal(steps)], pa.decimal128(38, 0))})

    parts = rows.groupBy(*by, "bucket").applyInArrow(rank, ", ".join([*(f"{c} int" for c in by), *(f"{c} double" for c in sums), "steps decimal(38, 0)"]))
    return _finished(parts.groupBy(*by).agg(*(F.sum(c).alias(c) for c in sums), (F.sum("steps").cast("double") / UNITS).alias("steps")), by)


def long_metrics(wide: DataFrame, by: list[str]) -> DataFrame:
    """(by, metric, value) rows of metrics_of()."""
    cells = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS))
    return wide.select(*by, "n", "events", "prevalence", F.explode(cells).alias("c")).select(*by, "n", "events", "prevalence", "c.metric", "c.value")


def paired(predictions: DataFrame, pairs: list[tuple[str, str]], by: list[str] = ()) -> DataFrame:
    """(comparison, by, metric, reference, candidate, difference) for pairs (reference, candidate) of model_id."""
    long = long_metrics(ranking_metrics(predictions, by=["model_id", *by]), ["model_id", *by])
    parts = []
    for reference, candidate in pairs:
        r = long.where(F.col("model_id") == reference).withColumnRenamed("value", "reference").drop("model_id")
        c = long.where(F.col("model_id") == candidate).select(*by, "metric", F.col("value").alias("candidate"))
        parts.append(r.join(c, [*by, "metric"]).select(F.lit(f"{candidate}_vs_{reference}").alias("comparison"), *by, "metric", "n", "events", "prevalence", "reference", "candidate", (F.col("candidate") - F.col("reference")).alias("difference")))
    return reduce(DataFrame.unionByName, parts)


def overall_and_by_fold(predictions: DataFrame, fold: str = "outer_fold") -> DataFrame:
    """Metrics per model over all rows (scope overall) and per fold, from one pass over the rows."""
    counts = score_counts(predictions, "outcome", "probability", None, ["model_id", fold])
    each = counts.withColumn("scope", F.col(fold).cast("string")).drop(fold)
    every = counts.groupBy("model_id", "score").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp")).withColumn("scope", F.lit("overall"))
    return metrics_of(each.unionByName(every), ["model_id", "scope"])


def stratified(predictions: DataFrame, strata: dict[str, Column], min_rows: int = 1000, min_events: int = 50) -> DataFrame:
    """Metrics per model and stratum level; strata that are too small or of one class get a status instead."""
    cells = F.array(*(F.struct(F.lit(s).alias("stratum"), c.cast("string").alias("level")) for s, c in strata.items()))
    rows = predictions.withColumn("cell", F.explode(cells)).withColumns({"stratum": F.col("cell")["stratum"], "level": F.col("cell")["level"]}).drop("cell")
    found = ranking_metrics(rows, by=["model_id", "stratum", "level"])
    enough = (F.col("n") >= min_rows) & (F.col("events") >= min_events) & (F.col("events") < F.col("n"))
    return found.withColumns({"status": F.when(enough, "estimated").otherwise("not_estimable"), **{m: F.when(enough, F.col(m)) for m in METRICS}})


def against(found: DataFrame, references: list[str], keys: list[str], metric: str = "auprc") -> DataFrame:
    """Differences of a metric to that of each reference model."""
    out = found
    for r in references:
        side = found.where(F.col("model_id") == r).select(*keys, F.col(metric).alias(f"__{r}"))
        out = out.join(side, keys, "left").withColumn(f"{metric}_minus_{r}", F.col(metric) - F.col(f"__{r}")).drop(f"__{r}")
    return out


def rank_edges(n: int) -> list[float]:
    """Inner edges of n rank bins as shares of the rank range, with the rounding of percentages in double."""
    return [(i / n * 100) / 100 for i in range(1, n)]


def rank_bins(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """(key, bin 1 .. n) by rank: edges are the interpolated quantiles of the ranks 1 .. m, each edge in the lower bin.

    Equal values go by key.
    """
    ranks = row_numbers(df.select(key, value), [value, key], "rank").withColumn("rank", F.col("rank") + 1)
    ranks = ranks.withColumn("m", F.lit(ranks.count()))
    bin_ = F.lit(1)
    for edge in rank_edges(n):
        bin_ = bin_ + (F.col("rank") > 1 + (F.col("m") - 1) * F.lit(edge)).cast("int")
    return ranks.select(key, value, bin_.cast("int").alias("bin"))
