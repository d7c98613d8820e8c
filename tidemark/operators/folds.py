"""Grouped folds: balanced assignment of clusters, and hash folds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import hash_fold
from tidemark.operators.joins import first_match


def fold_inputs(rows: DataFrame, cluster: str = "cluster_key") -> DataFrame:
    """Counts per cluster: entities, rows, event rows, rows of unknown outcome, entities with events."""
    return rows.groupBy(cluster).agg(
        F.count_distinct("entity_key").alias("n_entities"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("outcome") == 1).alias("n_events"),
        F.count_if(F.col("outcome") == 9).alias("n_unknown"),
        F.count_distinct(F.when(F.col("outcome") == 1, F.col("entity_key"))).alias("n_event_entities"),
    )


def greedy_folds(clusters: DataFrame, n_folds: int, cluster: str = "cluster_key", by: list[str] = ()) -> DataFrame:
    """Folds 1 .. n of equal event counts: clusters in falling order go to the fold that has least.

    Order: events, event entities, rows, all falling, then the identifier as
    text. A cluster with events goes to the fold with the fewest (events,
    event entities, rows, clusters), one without to that with the fewest
    (rows, clusters, events, event entities); the lower fold wins ties. The
    scan is sequential, over the few numbers of each cluster alone, within
    each group of ``by`` columns.
    """
    kept = [*by, cluster]

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(__id=pdf[cluster].astype(str)).sort_values(["n_events", "n_event_entities", "n_rows", "__id"], ascending=[False, False, False, True], kind="stable")
        load = [[0, 0, 0, 0] for _ in range(n_folds)]  # events, event entities, rows, clusters
        chosen = []
        for events, entities, rows in zip(pdf["n_events"], pdf["n_event_entities"], pdf["n_rows"]):
            order = (0, 1, 2, 3) if events > 0 else (2, 3, 0, 1)
            best = min(range(n_folds), key=lambda i: (*(load[i][j] for j in order), i))
            for j, x in enumerate((events, entities, rows, 1)):
                load[best][j] += x
            chosen.append(best + 1)
        return pdf.assign(outer_fold=chosen)[[*kept, "outer_fold"]]

    types = ", ".join(f"`{c}` {clusters.schema[c].dataType.simpleString()}" for c in kept)
    counts = clusters.select(*kept, "n_events", "n_event_entities", "n_rows", F.lit(0).alias("__all"))
    return counts.groupBy(*(by or ["__all"])).applyInPandas(assign, f"{types}, outer_fold int")


def fold_summary(clusters: DataFrame, folds: DataFrame, cluster: str = "cluster_key") -> DataFrame:
    return clusters.join(folds, cluster).groupBy("outer_fold").agg(
        F.count(F.lit(1)).alias("n_clusters"), F.sum("n_entities").alias("n_entities"), F.sum("n_rows").alias("n_rows"), F.sum("n_events").alias("n_events"), F.sum("n_event_entities").alias("n_event_entities")
    )


def temporal_role(period: str, development: list[str], validation: list[str]) -> Column:
    return F.when(F.col(period).isin(development), "development").when(F.col(period).isin(validation), "temporal_validation").otherwise("unassigned")


def inner_fold(cluster: str, seed: int, n: int = 3) -> Column:
    return hash_fold(cluster, seed, n)


def estimable(rows: DataFrame, outer: str, inner: str, n_inner: int, outcome: str = "outcome") -> DataFrame:
    """Per outer fold: whether all inner folds are there with both classes."""
    each = rows.groupBy(outer, inner).agg(F.count_distinct(outcome).alias("n_classes"))
    return each.groupBy(outer).agg(F.count(F.lit(1)).alias("n_inner"), (F.count_if(F.col("n_classes") == 2) == n_inner).alias("estimable"))


def attach_folds(rows: DataFrame, folds: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the outer_fold of the first of the keys that folds (cluster, outer_fold) has."""
    return first_match(rows, folds, keys, "cluster", "outer_fold")
