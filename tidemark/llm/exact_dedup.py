"""Exact dedup by content sort."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import ROW, SPACE, Scratch, keyed

#: Bytes of the normalised text that the splitters hold.
HEAD = 64


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of texts that are equal after white space is normalised.

    Sampled splitters range-partition the rows by the first 64 bytes of the
    normalised text, its digest and the identifier, so that splitters stay
    small however long the texts are and a group of copies may span
    partitions. Each partition is sorted externally, which makes equal texts
    neighbours; neighbours are compared in full. Runs that touch the edge of a
    partition are joined to the next one's by comparing the two edge texts.

    Returns one row per input row: identifier, keep_id, group_size, kept,
    text_sha256. Null text counts as empty. Of repeated rows one is kept. A
    null identifier sorts after all others. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")
    id_type = docs.schema[id_col].dataType
    ordered = (
        docs.select(F.col(id_col).alias("id"), norm.alias("norm"))
        .withColumns({"head": F.substring(F.encode("norm", "utf-8"), 1, HEAD), "sha": F.unhex(F.sha2("norm", 256))})
        .repartitionByRange("head", "sha", F.col("id").asc_nulls_last())
        .sortWithinPartitions("head", "sha", "norm", F.col("id").asc_nulls_last())
    )
    schema = T.StructType(
        [
            T.StructField("id", id_type),
            T.StructField("sha", T.BinaryType()),
            T.StructField("pid", T.IntegerType()),
            T.StructField("run", T.LongType()),
            T.StructField("head", T.BooleanType()),
            T.StructField("edge", T.StringType()),
        ]
    )
    rows = scratch.save(ordered.select("id", "sha", "norm").mapInArrow(_runs, schema), "rows")

    # A partition's first and last run, in order; adjacent edges with equal text are one group.
    edges = rows.where("edge IS NOT NULL").select("pid", "run", "edge", F.col("head").alias("last"))
    along = Window.orderBy("pid", "last")
    same = F.coalesce(F.lag("edge").over(along) == F.col("edge"), F.lit(False))
    same_run = F.coalesce((F.lag("pid").over(along) == F.col("pid")) & (F.lag("run").over(along) == F.col("run")), F.lit(False))
    edges = (
        edges.select("pid", "run", "last", same.alias("same"), same_run.alias("same_run"))
        .withColumn("joined", F.col("same") | F.col("same_run"))
        .withColumn("grp", F.sum((~F.col("joined")).cast("long")).over(Window.orderBy("pid", "last")))
        .groupBy("pid", "run")
        .agg(F.min("grp").alias("grp"), F.min_by(F.col("same") & ~F.col("same_run"), "last").alias("continues"))
    )
    per_run = Window.partitionBy("pid", "run")
    local = rows.where("edge IS NULL").select(
        "id", "sha", "pid", "run", "head", F.min("id").over(per_run).alias("least"), F.count(F.lit(1)).over(per_run).alias("n")
    )
    spans = (
        local.where("head").join(edges, ["pid", "run"])
        .groupBy("grp").agg(F.min("least").alias("least_all"), F.sum("n").alias("n_all"))
    )
    edges = edges.join(spans, "grp").select("pid", "run", "least_all", "n_all", "continues")
    return local.join(edges, ["pid", "run"], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("n_all").isNull(), F.col("least")).otherwise(F.col("least_all")).alias("keep_id"),
        F.coalesce("n_all", "n").alias("group_size"),
        (F.col("head") & ~F.coalesce("continues", F.lit(False))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _runs(batches):
    """Numbers the runs of equal texts in a sorted partition; two rows at the end hold its edge texts."""
    pid, run, before, first, last_type = TaskContext.get().partitionId(), -1, None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        norm, n = batch.column("norm"), batch.num_rows
        last_type = batch.column("id").type
        new = [True] * n
        if n > 1:
            new[1:] = pc.not_equal(norm.slice(1), norm.slice(0, n - 1)).to_pylist()
        head = norm[0].as_py()
        new[0] = before is None or before != head
        if first is None:
            first = head
        runs = []
        for x in new:
            run += x
            runs.append(run)
        before = norm[n - 1].as_py()
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("sha"), pa.array([pid] * n, pa.int32()), pa.array(runs, pa.int64()), pa.array(new, pa.bool_()), pa.nulls(n, pa.string())],
            names=["id", "sha", "pid", "run", "head", "edge"],
        )
    if first is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(2, last_type), pa.nulls(2, pa.binary()), pa.array([pid] * 2, pa.int32()), pa.array([0, run], pa.int64()), pa.array([False, True], pa.bool_()), pa.array([first, before], pa.string())],
            names=["id", "sha", "pid", "run", "head", "edge"],
        )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each text, with all its columns: that with the least identifier, null last.

    Rows are judged by numbers of their own, so of equal rows with one
    identifier, or with none, one stays, and so do rows of one identifier that
    have different texts.
    """
    rows = keyed(docs, id_col, Scratch(docs.sparkSession, "exact-dedup-rows"))
    return rows.join(exact_dedup(rows, ROW, text_col).where("kept").select(ROW), ROW, "left_semi").drop(ROW).select(docs.columns)
