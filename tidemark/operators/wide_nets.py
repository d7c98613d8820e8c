"""Elastic-net logistic regression with one categorical column of any number of levels."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.elastic_net import _step, design
from tidemark.operators.models import MISSING, Config, Preprocessor
from tidemark.sources import written


@dataclass(frozen=True)
class WideNet:
    pre: Preprocessor
    key: str
    dense: np.ndarray  #: intercept first, then the columns of the preprocessor
    levels: DataFrame  #: (level, w) of the levels of the training rows, written
    iterations: int


def level_of(key: str) -> Column:
    """A row's level: the value as text, one for missing values."""
    return F.coalesce(F.col(key).cast("string"), F.lit(MISSING))


def _soft(x: np.ndarray, limit: float) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - limit, 0.0)


def _sums(rows: DataFrame, net_w: np.ndarray, pre: Preprocessor) -> DataFrame:
    """Of the rows with their level's weight w: gradient g, curvature h and its part b shared with the dense columns, by level; and, without a level, the dense sums of each task."""
    size = len(net_w)

    def sums(batches):
        dense, loss = np.zeros((size, size + 1)), 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, w = design(batch, pre), batch.column("outcome").to_numpy(), batch.column("w").to_numpy()
            z = x @ net_w + w
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            v = p * (1 - p)
            dense[:, 0] += x.T @ (p - y)
            dense[:, 1:] += (x * v[:, None]).T @ x
            loss += float(np.sum(np.logaddexp(0, z) - y * z))
            encoded = batch.column("level").dictionary_encode()
            at, k = encoded.indices.to_numpy(), len(encoded.dictionary)
            by = lambda values: np.bincount(at, values, k)  # noqa: E731, B023
            first = np.zeros(k)
            first[at] = w
            yield pa.RecordBatch.from_arrays(
                [encoded.dictionary, pa.array(first), pa.array(by(p - y)), pa.array(by(v)), *(pa.array(by(v * x[:, j])) for j in range(size)), pa.nulls(k, pa.binary())], names=["level", "w", "g", "h", *(f"b{j}" for j in range(size)), "dense"]
            )
        blob = np.append(dense.ravel(), loss).tobytes()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), *(pa.nulls(1, pa.float64()) for _ in range(3 + size)), pa.array([blob], pa.binary())], names=["level", "w", "g", "h", *(f"b{j}" for j in range(size)), "dense"])

    columns = ", ".join(f"b{j} double" for j in range(size))
    return rows.mapInArrow(sums, f"level string, w double, g double, h double, {columns}, dense binary")


def _levels_part(levels: DataFrame, size: int, n: int, move: np.ndarray, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """What the levels, at their best for a move of the dense weights, take from the dense curvature and add to the dense gradient."""

    def part(batches):
        out = np.zeros((size, size + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            w, g, h = (batch.column(c).to_numpy() / d for c, d in (("w", 1), ("g", n), ("h", n)))
            b = np.stack([batch.column(f"b{j}").to_numpy() for j in range(size)], 1) / n
            best = _soft(h * w - g - b @ move, l1)
            d = h + l2 + 1e-9
            active = best != 0
            fixed = np.where(active, (-l2 * w - g - np.sign(best) * l1) / d, -w)
            out[:, 0] += b.T @ fixed
            out[:, 1:] += (b[active] / d[active, None]).T @ b[active]
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["part"])

    total = sum(np.frombuffer(r["part"]).reshape(size, size + 1) for r in levels.mapInArrow(part, "part binary").collect())  # a row per task
    return total[:, 0], total[:, 1:]


def fit_wide_net(train: DataFrame, pre: Preprocessor, key: str, config: Config, max_iter: int = 40, tolerance: float = 1e-6) -> WideNet:
    """Elastic net over the preprocessor's columns and a weight for every level of one more column.

    Levels are rows of a table that is joined by key: none is collected, and
    no list of them is part of an expression. A row has one level, so the
    curvature among levels is a diagonal; what they share with the few dense
    columns is a vector per level. A Newton step therefore needs sums by level
    and one small matrix: for a move of the dense weights every level's best
    weight is a soft threshold of its own sums, and the levels leave a reduced
    quadratic over the dense columns, which coordinate descent solves. The
    driver holds the dense part alone; a level of many rows is summed within
    tasks first.

    The penalty is 1 / (C n), as in fit_paths, on all but the intercept. Rows
    whose level was not trained add no weight.
    """
    columns = [*pre.continuous, *pre.categories]
    rows = written(train.select(*columns, F.col("outcome").cast("double").alias("outcome"), level_of(key).alias("level")), "wide-rows")
    n = rows.count()
    size = 1 + len(pre.names)
    penalty = 1 / (config["C"] * n)
    l1, l2 = penalty * config["l1_ratio"], penalty * (1 - config["l1_ratio"])
    dense, last, objective = np.zeros(size), None, np.inf
    weights = written(rows.select("level").distinct().withColumn("w", F.lit(0.0)), "wide-levels")
    before, step = weights, 0
    while step < max_iter:
        step += 1
        found = written(_sums(rows.join(weights, "level"), dense, pre), "wide-sums")
        blobs = [np.frombuffer(r["dense"]) for r in found.where("level IS NULL").select("dense").collect()]  # a row per task
        total = sum(blobs)
        loss, gradient, curvature = total[-1] / n, total[:-1].reshape(size, size + 1)[:, 0] / n, total[:-1].reshape(size, size + 1)[:, 1:] / n
        levels = written(found.where("level IS NOT NULL").groupBy("level").agg(F.max("w").alias("w"), *(F.sum(c).alias(c) for c in ("g", "h", *(f"b{j}" for j in range(size))))), "wide-grouped")
        own = levels.agg(F.sum(F.abs("w")).alias("a"), F.sum(F.col("w") * F.col("w")).alias("q")).first()
        now = loss + l1 * (np.abs(dense[1:]).sum() + own["a"]) + l2 / 2 * ((dense[1:] ** 2).sum() + own["q"])
        if last is not None and now > objective + 1e-12:
            # A step too far: half of it.
            dense = (dense + last) / 2
            back = before.withColumnRenamed("w", "was")
            weights = written(weights.join(back, "level").select("level", ((F.col("w") + F.col("was")) / 2).alias("w")), "wide-levels")
            continue
        move = np.zeros(size)
        for _ in range(50):
            add, take = _levels_part(levels, size, n, move, l1, l2)
            new = _step(dense, gradient + add, curvature - take, l1, l2)
            same = np.abs(new - dense - move).max() < tolerance / 10
            move = new - dense
            if same or (l1 == 0 and _ > 0):
                break
        shared = sum((F.col(f"b{j}") / n * F.lit(float(move[j])) for j in range(size)), F.lit(0.0))
        pull = F.col("h") / n * F.col("w") - F.col("g") / n - shared
        best = F.signum(pull) * F.greatest(F.abs(pull) - l1, F.lit(0.0)) / (F.col("h") / n + l2 + 1e-9)
        after = written(levels.select("level", best.alias("w"), F.abs(best - F.col("w")).alias("moved")), "wide-levels")
        most = max(float(np.abs(move).max()), after.agg(F.max("moved")).first()[0] or 0.0)
        last, before, objective = dense, weights, now
        dense, weights = dense + move, after.drop("moved")
        if most < tolerance:
            break
    return WideNet(pre, key, dense, weights, step)


def score_wide_net(rows: DataFrame, net: WideNet, keep: list[str]) -> DataFrame:
    """(keep, probability): rows join their level's weight by key; an unknown level adds none."""
    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    columns = list(dict.fromkeys([*keep, *net.pre.continuous, *net.pre.categories]))
    weights = net.levels.select(F.col("level").alias("__level"), F.col("w").alias("__w"))
    joined = rows.select(*columns, level_of(net.key).alias("__own")).join(weights, F.col("__own") == F.col("__level"), "left").select(*columns, F.coalesce("__w", F.lit(0.0)).alias("__w"))
    pre, dense = net.pre, net.dense

    def score(batches):
        for batch in batches:
            z = design(batch, pre) @ dense + batch.column("__w").to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))], names=[*keep, "probability"])

    return joined.mapInArrow(score, f"{types}, probability double")
