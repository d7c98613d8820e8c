"""Tables in and out: Parquet, CSV, catalog, schemas as tables, resumable output."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidemark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset: one of our own in local mode, and the warehouse on a cluster, whose executors share no local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = _own_dir() if spark.sparkContext.master.split("[")[0] == "local" else spark.conf.get("spark.sql.warehouse.dir")
    return named.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of the cluster."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read from there: what was sampled or numbered stays as it is, and a lost executor costs a re-read."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | str | None = None) -> DataFrame:
    """A Parquet table; the filter and the column list reach the scan."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df if columns is None else df.select(*dict.fromkeys(columns))


def scan_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A CSV table with a header and a given schema; a row that does not fit it fails the job."""
    return spark.read.option("header", True).option("mode", "FAILFAST").schema(schema).csv(path)


#: Types that a column of text may have, narrowest first, by the type that a sample shows.
LADDERS = {
    "int": ("int", "bigint", "double", "string"), "bigint": ("bigint", "double", "string"), "double": ("double", "string"), "boolean": ("boolean", "string"),
    "date": ("date", "timestamp", "string"), "timestamp": ("timestamp", "string"), "string": ("string",), "void": ("int", "bigint", "double", "boolean", "date", "timestamp", "string"),
}


def _ladder(kind: str) -> tuple[str, ...]:
    return LADDERS.get("double" if kind.startswith("decimal") else kind.removesuffix("_ntz"), ("string",))


def _fits(text: Column, kind: str) -> Column:
    """Whether the type holds the whole text; a date with a time is not a date."""
    fits = text.try_cast(kind).isNotNull()
    return fits & text.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}\s*$") if kind == "date" else fits


def scan_csv_inferred(spark: SparkSession, path: str, sampling: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """A CSV table with a header whose types are inferred, and the quarantined lines (line) that do not have its columns.

    A sampled part suggests each column's type. Then all rows are parsed once,
    as text, and one aggregation counts the values that each wider type does
    not hold; a column gets the narrowest type that holds all of its values,
    so no value becomes null because the sample had not shown its kind. A quote
    inside quotes is doubled; empty fields are null.
    """
    read = spark.read.option("header", True).option("escape", '"')
    seen = read.option("inferSchema", True).option("samplingRatio", sampling).csv(path).schema
    bad = "_line"
    while bad in seen.names:
        bad = f"_{bad}"
    as_text = T.StructType([*(T.StructField(f.name, T.StringType()) for f in seen.fields), T.StructField(bad, T.StringType())])
    parsed = written(read.schema(as_text).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).csv(path), "csv")
    good = parsed.where(F.col(bad).isNull()).drop(bad)
    tries = {(i, kind): F.count_if(F.col(f"`{f.name}`").isNotNull() & ~_fits(F.col(f"`{f.name}`"), kind)) for i, f in enumerate(seen.fields) for kind in _ladder(f.dataType.simpleString()) if kind != "string"}
    misfits = good.agg(F.lit(0), *(c.alias(f"{i}_{kind}") for (i, kind), c in tries.items())).first()
    kinds = [next(k for k in _ladder(f.dataType.simpleString()) if k == "string" or not misfits[f"{i}_{k}"]) for i, f in enumerate(seen.fields)]
    rows = good.select(*(F.col(f"`{f.name}`").cast(k).alias(f.name) for f, k in zip(seen.fields, kinds)))
    return rows, parsed.where(F.col(bad).isNotNull()).select(F.col(bad).alias("line"))


def catalog_table(spark: SparkSession, name: str) -> DataFrame:
    """A table of the catalog, by its (qualified) name."""
    return spark.table(name)


def create_database(spark: SparkSession, name: str, path: str | None = None) -> None:
    """A database of the catalog, in a folder of its own."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}` LOCATION '{path or work_path(spark, name)}'")


def save_table(df: DataFrame, name: str, bucket_by: str | None = None, buckets: int = 0) -> DataFrame:
    """df as a managed Parquet table db.name, bucketed and sorted by a column if one is named; a join or grouping by it then needs no exchange."""
    writer = df.write.mode("overwrite").format("parquet").option("compression", "zstd")
    if bucket_by:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the given rows."""
    return spark.createDataFrame(rows, schema)


def schema_table(df: DataFrame) -> DataFrame:
    """(column_id, name, type) of a table's columns, as a table."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "column_id int, name string, type string")


def filled_schema(df: DataFrame) -> DataFrame:
    """schema_table with n_values, the rows in which a column is not null; one aggregation counts all columns."""
    counts = [F.count(F.col("`" + c.replace("`", "``") + "`")) for c in df.columns]
    counted = df.agg(F.array(*counts).alias("n")).select(F.posexplode("n").alias("column_id", "n_values"))
    return schema_table(df).join(counted, "column_id")


def write_sorted(df: DataFrame, path: str, *keys: str) -> None:
    """Parquet with Zstandard, range-partitioned and sorted by the keys."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("compression", "zstd").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _digests(found: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and a digest of the keys of every part."""
    key = F.xxhash64(*keys)
    return found.groupBy("model_id", "outer_fold").agg(F.count(F.lit(1)).alias("n"), F.sum(key.cast("decimal(38, 0)")).alias("digest"), F.count_distinct(*(F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys)).alias("distinct"))


def resume_parts(spark: SparkSession, path: str, parts: Iterable[tuple[str, int]], make: Callable[[str, int], DataFrame], keys: list[str]) -> DataFrame:
    """Output with a part per (model_id, outer_fold), where finished parts are kept.

    A part is finished when its line is in the manifest beside the output, with
    its number of rows and a digest of its keys; both are checked against the
    files that are there. Parts without a line, or whose files no longer agree
    with it, are made again, each replacing only itself. Repeated keys in a
    finished part are an error.
    """
    manifest, done = f"{path.rstrip('/')}-manifest", set()
    if _exists(spark, path) and _exists(spark, manifest):
        there = _digests(spark.read.option("ignoreCorruptFiles", True).parquet(path), keys)
        lines = spark.read.parquet(manifest).select("model_id", "outer_fold", F.col("n").alias("told"), F.col("digest").alias("sealed"))
        for r in there.join(lines, ["model_id", "outer_fold"]).where("n = told AND digest <=> sealed").collect():  # a row per part
            if r["distinct"] != r["n"]:
                raise ValueError("a finished part has repeated keys")
            done.add((r["model_id"], r["outer_fold"]))
    for model_id, fold in parts:
        if (model_id, fold) in done:
            continue
        part = make(model_id, fold).withColumns({"model_id": F.lit(model_id), "outer_fold": F.lit(fold)})
        put = lambda df, to: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_id", "outer_fold").parquet(to)
        put(part, path)
        own = spark.read.schema(part.schema).parquet(path).where((F.col("model_id") == model_id) & (F.col("outer_fold") == fold))
        put(_digests(own, keys), manifest)
    return spark.read.parquet(path)
