"""Connected components of a link table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) for every node of the (a, b) links; label is the least node of its component.
    A node's links to itself count for nothing.

    Each step gives a node the least label among its own and its neighbours',
    then that label's own label. Every step is a written table. The links of
    a node with very many meet its label in one join key, which adaptive skew
    joins split; the least label is then taken per task before the shuffle.
    """
    links = links.where("a != b")
    both = scratch.save(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("heard"))
        better = labels.join(heard, F.col("node") == F.col("a")).select("node", F.least("label", "heard").alias("new"), F.col("label").alias("old"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        jumped = better.join(up, F.col("new") == F.col("up"), "left").select("node", F.least("new", F.coalesce("up_label", "new")).alias("label"), "old")
        jumped = scratch.save(jumped, f"{name}-{step}")
        moved = jumped.where("label != old").limit(1).count()
        scratch.drop(f"{name}-{step - 1}")
        labels = jumped.select("node", "label")
        if not moved:
            scratch.drop(f"{name}-edges")
            return labels
