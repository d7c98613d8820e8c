"""Calibration, cross-fitted recalibration, decision curves and alert burden."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import clip, expit, logit
from tidemark.operators import timeline
from tidemark.operators.metrics import score_counts
from tidemark.operators.ranks import exact_quantiles
from tidemark.operators.reshape import widen_models
from tidemark.sources import written

CLIP = 1e-6
#: Fits of a + b * lp with b fixed at 1, and with both free.
LARGE, JOINT = "intercept", "intercept_slope"


def _newton(counts: DataFrame, by: list[str], kinds: tuple[str, ...] = (LARGE, JOINT), steps: int = 60, tolerance: float = 1e-10) -> DataFrame:
    """(by, kind, a, b, status): unpenalised logistic fits of the outcome on a + b * lp, b fixed at 1 for LARGE.

    counts: (by, lp, tp, fp), written. The fits that are open are a table that
    each step replaces: one aggregation over the counts advances all of them
    and closes those that have converged, so their number is not bounded and
    no parameter goes through the driver. A step reads only groups that are
    still open; where one has made the loss greater, half of it is taken back.
    """
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by]
    carried = ["kind", "a", "b", "was_a", "was_b", "was_loss"]
    held = [F.col(f"s.{c}").alias(c) for c in [*by, *carried]]
    both = (F.sum("tp") > 0) & (F.sum("fp") > 0)
    begun = counts.groupBy(*by).agg(F.when(both, "open").otherwise("one_class").alias("status"))
    state = begun.select(*by, F.explode(F.array(*(F.lit(k) for k in kinds))).alias("kind"), F.lit(0.0).alias("a"), F.lit(1.0).alias("b"), *(F.lit(None).cast("double").alias(c) for c in carried[3:]), "status")
    state = written(state, "newton")
    closed = [state.where("status != 'open'")]
    for _ in range(steps):
        open_ = state.where("status = 'open'").drop("status")
        if open_.isEmpty():
            break
        rows = counts.alias("c").join(open_.alias("s"), reduce(Column.__and__, same, F.lit(True))).select(*held, "c.lp", "c.tp", "c.fp")
        z = F.col("a") + F.col("b") * F.col("lp")
        p, n = expit(z), F.col("tp") + F.col("fp")
        loss = n * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))) - F.col("tp") * z
        v, r = n * p * (1 - p), F.col("tp") - n * p
        sums = rows.groupBy(*by, *carried).agg(
            F.sum(loss).alias("loss"), F.sum(r).alias("r0"), F.sum(r * F.col("lp")).alias("r1"), F.sum(v).alias("v00"), F.sum(v * F.col("lp")).alias("v01"), F.sum(v * F.col("lp") * F.col("lp")).alias("v11")
        )
        c = F.col
        slope, det = c("kind") == JOINT, c("v00") * c("v11") - c("v01") * c("v01")
        stuck = (c("v00") <= 0) | (slope & (det <= 1e-12 * c("v00") * c("v11")))
        sums = sums.withColumns(
            {
                "stuck": stuck,
                "da": F.when(stuck, 0.0).when(slope, (c("v11") * c("r0") - c("v01") * c("r1")) / det).otherwise(c("r0") / c("v00")),
                "db": F.when(stuck | ~slope, 0.0).otherwise((c("v00") * c("r1") - c("v01") * c("r0")) / det),
            }
        )
        most = F.greatest(F.abs("da"), F.abs("db"))
        damp = F.least(F.lit(1.0), 5.0 / F.greatest(most, F.lit(1e-300)))
        far = F.coalesce(c("loss") > c("was_loss") + 1e-12 * F.abs(c("was_loss")), F.lit(False))
        status = F.when(far, "open").when(c("stuck"), "not_estimable").when(most < tolerance, "converged").otherwise("open")
        moved = [F.when(far, (c(x) + c(f"was_{x}")) / 2).otherwise(c(x) + damp * c(f"d{x}")).alias(x) for x in ("a", "b")]
        kept = [F.when(far, c(f"was_{x}")).otherwise(c(x)).alias(f"was_{x}") for x in ("a", "b", "loss")]
        state = written(sums.select(*by, "kind", *moved, *kept, status.alias("status")), "newton")
        closed.append(state.where("status != 'open'"))
    closed.append(state.where("status = 'open'").withColumn("status", F.lit("not_converged")))
    done = reduce(DataFrame.unionByName, closed)
    return done.select(*by, "kind", *(F.when(F.col("status") == "converged", F.col(x)).alias(x) for x in ("a", "b")), "status")


def calibration(df: DataFrame, by: list[str] = ("model_id",), outcome: str = "outcome", score: str = "probability") -> DataFrame:
    """Observed over expected, calibration in the large, and joint intercept and slope, per group."""
    by = list(by)
    counts = score_counts(df, outcome, score, None, by)
    counts = written(counts.groupBy(*by, clip("score", CLIP, 1 - CLIP).alias("p")).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp")).withColumn("lp", logit("p")), "calibration-counts")
    n = F.sum(F.col("tp") + F.col("fp"))
    base = counts.groupBy(*by).agg(n.alias("n"), F.sum("tp").alias("events"), (F.sum("tp") / n).alias("prevalence"), (F.sum((F.col("tp") + F.col("fp")) * F.col("p")) / n).alias("mean_predicted_risk"))
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    fits = _newton(counts, by).groupBy(*by).agg(of(LARGE, "a").alias("calibration_in_the_large"), of(JOINT, "a").alias("calibration_intercept"), of(JOINT, "b").alias("calibration_slope"), of(JOINT, "status").alias("status"))
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"f.{c}")) for c in by]
    out = base.withColumn("oe_ratio", F.col("prevalence") / F.col("mean_predicted_risk")).alias("b").join(fits.alias("f"), reduce(Column.__and__, same, F.lit(True)))
    return out.select("b.*", *(f"f.{c}" for c in fits.columns if c not in by))


def calibration_bins(df: DataFrame, by: list[str] = ("model_id",), bins: int = 10, outcome: str = "outcome", score: str = "probability") -> DataFrame:
    """Observed and predicted risk in bins between the distinct quantiles of the scores; an edge belongs to the lower bin."""
    by = list(by)
    edges = exact_quantiles(df, by, score, [i / bins for i in range(bins + 1)])
    edges = edges.select(*by, F.array_sort(F.array_distinct("quantiles")).alias("__edges"))
    inner = F.slice("__edges", 2, F.greatest(F.size("__edges") - 2, F.lit(0)))
    rows = df.join(edges, by).withColumn("risk_bin", F.size(F.filter(inner, lambda e: e < F.col(score))) + 1)
    return rows.groupBy(*by, "risk_bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum(outcome).alias("events"), F.avg(outcome).alias("observed_risk"), F.avg(score).alias("mean_predicted_risk"), F.min(score).alias("min_predicted_risk"), F.max(score).alias("max_predicted_risk")
    )


def calibrators(df: DataFrame, by: list[str], fold: str) -> DataFrame:
    """(by, fold, update_type, a, b, status): the two recalibrations of each fold, fitted to all other folds.

    Scores are counted per fold first; a count then goes to every other fold's
    fit, and all fits of all groups run as one job per Newton step.
    """
    counts = score_counts(df, "outcome", "probability", None, [*by, fold])
    counts = counts.withColumn("lp", logit("score", CLIP))
    folds = counts.groupBy(*by).agg(F.collect_set(fold).alias("__folds"))
    others = counts.join(folds, by).withColumn("__fold", F.explode(F.filter("__folds", lambda f: f != F.col(fold))))
    # groupBy drops the own fold here: the key is the fold that is left out.
    others = others.groupBy(*by, F.col("__fold").alias(fold), "lp").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    return _newton(written(others, "calibrator-counts"), [*by, fold]).withColumnRenamed("kind", "update_type")


def crossfit_recalibrate(df: DataFrame, by: list[str] = ("model_id",), fold: str = "outer_fold") -> DataFrame:
    """df in three copies: raw probabilities, and those updated by intercept and by intercept and slope from the other folds."""
    by = list(by)
    params = calibrators(df, by, fold)
    updated = df.join(params.select(*by, fold, "update_type", "a", "b"), [*by, fold])
    updated = updated.withColumn("probability", expit(F.col("a") + F.col("b") * logit("probability", CLIP))).drop("a", "b")
    return df.withColumn("update_type", F.lit("raw")).unionByName(updated)


def threshold_cells(df: DataFrame, thresholds: list[float], by: list[str], gap_h: float) -> DataFrame:
    """(by, cells): per level, which is the number of increasing thresholds that a score reaches, what enters the curve there.

    A cell has the rows and events of its level, the entities whose greatest
    level it is, and the change of the number of open episodes: a row opens an
    episode exactly for the thresholds above the greatest level that its
    entity had in the gap before, up to its own level. Every row is read and
    shuffled once, whatever the number of thresholds; rows without a score
    have level -1.
    """
    score = F.col("probability").cast("double")
    level = F.when(score.isNull(), -1).otherwise(F.size(F.filter(F.array(*(F.lit(float(t)) for t in thresholds)), lambda t: t <= score)))
    rows = df.select(*by, "entity_key", "landmark_h", level.alias("__level"), F.col("outcome").alias("__y"))
    rows = timeline.with_prior(rows, by, "entity_key", "landmark_h", "__level", gap_h)
    prior, y = F.greatest(F.coalesce("__prior", F.lit(0)), F.lit(0)), F.col("__y")
    none = F.lit(None).cast("int")
    # A row's part of the counts, and of its entity's greatest level.
    cells = F.array(
        F.struct(F.lit(None).cast(df.schema["entity_key"].dataType).alias("who"), F.col("__level").alias("level"), F.least(prior, "__level").alias("prior"), F.lit(1).alias("n"), (y == 1).cast("int").alias("pos"), (y == 0).cast("int").alias("neg")),
        F.struct(F.col("entity_key").alias("who"), F.col("__level").alias("level"), none.alias("prior"), none.alias("n"), none.alias("pos"), none.alias("neg")),
    )
    parts = rows.select(*by, F.explode(cells).alias("c")).where("c.who IS NOT NULL OR c.n IS NOT NULL").select(*by, "c.*")
    # Cells keep their level as a key; an entity's greatest one is found.
    parts = parts.groupBy(*by, "who", F.when(F.col("who").isNull(), F.col("level")).alias("at"), "prior").agg(F.max("level").alias("level"), *(F.sum(c).alias(c) for c in ("n", "pos", "neg")))
    cell, zero = F.col("who").isNull(), F.lit(0).cast("long")
    at = lambda level, **has: F.struct(level.alias("level"), *(has.get(c, zero).cast("long").alias(c) for c in ("n", "pos", "neg", "entities", "opened")))
    steps = F.when(~cell, F.array(at(F.col("level"), entities=F.lit(1)))).otherwise(
        F.array(
            at(F.col("level"), n=F.col("n"), pos=F.coalesce("pos", zero), neg=F.coalesce("neg", zero)),
            at(F.col("prior") + 1, opened=F.when(F.col("level") > F.col("prior"), F.col("n")).otherwise(zero)),
            at(F.col("level") + 1, opened=F.when(F.col("level") > F.col("prior"), -F.col("n")).otherwise(zero)),
        )
    )
    summed = parts.select(*by, F.explode(steps).alias("s")).select(*by, "s.*").groupBy(*by, "level").agg(*(F.sum(c).alias(c) for c in ("n", "pos", "neg", "entities", "opened")))
    return summed.groupBy(*by).agg(F.collect_list(F.struct("level", "n", "pos", "neg", "entities", "opened")).alias("cells"))


def decision_curve(df: DataFrame, thresholds: list[float], by: list[str] = ("model_id",), gap_h: float = 8) -> DataFrame:
    """Confusion counts, rates, alert burden and net benefit at every threshold; a row alerts from the threshold on.

    Alerts of an entity start a new episode after a gap of more than gap_h
    hours since the alert before. All thresholds come from one sweep over the
    levels of a group (threshold_cells), a few cells per group.
    """
    by = list(by)
    thresholds = sorted({float(t) for t in thresholds})
    cells = threshold_cells(df, thresholds, by, gap_h)
    cuts = F.array(*(F.struct(F.lit(i + 1).alias("j"), F.lit(t).alias("threshold")) for i, t in enumerate(thresholds)))
    rows = cells.withColumn("__cut", F.explode(cuts))
    j = F.col("__cut")["j"]
    total = lambda what, where: F.aggregate(F.filter("cells", where), F.lit(0).cast("long"), lambda a, c: a + c[what])
    above, below, upto, every = (lambda c: c["level"] >= j), (lambda c: (c["level"] >= 0) & (c["level"] < j)), (lambda c: c["level"] <= j), (lambda c: F.lit(True))
    counts = rows.select(
        *by,
        F.col("__cut")["threshold"].alias("threshold"),
        total("n", every).alias("n"),
        total("pos", above).alias("tp"),
        total("neg", above).alias("fp"),
        total("pos", below).alias("fn"),
        total("neg", below).alias("tn"),
        total("entities", every).alias("n_entities"),
        total("entities", above).alias("alerted_entities"),
        total("opened", upto).alias("episodes"),
    )
    rate = lambda a, b: F.when(b > 0, a / b)
    c, t = F.col, F.col("threshold")
    share = (c("tp") + c("fn")) / c("n")
    return counts.withColumns(
        {
            "sensitivity": rate(c("tp"), c("tp") + c("fn")),
            "specificity": rate(c("tn"), c("tn") + c("fp")),
            "ppv": rate(c("tp"), c("tp") + c("fp")),
            "npv": rate(c("tn"), c("tn") + c("fn")),
            "alerts_per_100_landmarks": 100 * (c("tp") + c("fp")) / c("n"),
            "alerted_per_100_entities": 100 * c("alerted_entities") / c("n_entities"),
            "episodes_per_100_entities": 100 * c("episodes") / c("n_entities"),
            "alerts_per_detected_event": rate(c("tp") + c("fp"), c("tp")),
            "net_benefit": c("tp") / c("n") - c("fp") / c("n") * t / (1 - t),
            "treat_all_net_benefit": share - (1 - share) * t / (1 - t),
        }
    )


def net_benefit_comparison(curve: DataFrame, models: list[str], pairs: list[tuple[str, str]], by: list[str] = ()) -> DataFrame:
    """Net benefit of the models side by side at every threshold, with the differences of the pairs."""
    return widen_models(curve, [*by, "threshold"], models, "net_benefit", pairs)
