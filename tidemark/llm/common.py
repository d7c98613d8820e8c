"""What the corpus operators share: intermediate tables and Arrow helpers."""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import shared_dir

#: ASCII white space, as a character class for regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"


class Scratch:
    """Intermediate tables of one operator run, written to the shared folder.

    A written table cuts the lineage: a lost executor costs a re-read, not a
    recomputation. ``drop`` removes tables that no later plan reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        path = f"{self.root}/{table}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, table: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the identifier's text, modulo n; a null identifier counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(n))


#: The column by which a pipeline stage joins an operator's decisions back to its rows.
ROW = "__row"


def _distinct_integers(docs: DataFrame, id_col: str) -> bool:
    """Whether the identifiers are integers, neither null nor repeated."""
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return False
    return docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("__n")).where(F.col(id_col).isNull() | (F.col("__n") > 1)).isEmpty()


def keyed(docs: DataFrame, id_col: str, scratch: Scratch) -> DataFrame:
    """docs with ROW, a number of their own for all rows, in identifier order (nulls last).

    Identifiers that are distinct integers are the numbers; otherwise the
    numbered rows are written with all their columns, so that every later
    plan reads the same numbers.
    """
    if _distinct_integers(docs, id_col):
        return docs.withColumn(ROW, F.col(id_col).cast("long"))
    return scratch.save(docs.orderBy(F.col(id_col).asc_nulls_last()).withColumn(ROW, F.monotonically_increasing_id()), "keyed")


def unused(name: str, df: DataFrame) -> str:
    """The name, with further underscores if df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(own_id, id, text): id orders the rows by own_id and names each of them; null text is empty.

    Integer identifiers that are neither null nor repeated name themselves;
    otherwise rows are numbered in identifier order, nulls last. Rows that
    keyed() numbered keep their numbers.
    """
    rows = docs.select(F.col(id_col).alias("own_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if id_col == ROW or _distinct_integers(docs, id_col):
        return rows.withColumn("id", F.col("own_id").cast("long"))
    return scratch.save(rows.orderBy(F.col("own_id").asc_nulls_last()).withColumn("id", F.monotonically_increasing_id()), "numbered")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets into them; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text_col: str, max_bytes: int):
    """Consecutive slices of a batch with about max_bytes of text each (one row at least)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text_col).cast(pa.large_binary())), 0)
    ends = np.cumsum(lengths.to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space) in concatenated texts, and each word's text."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~space
    starts = np.flatnonzero(np.diff(inside) == 1)
    ends = np.flatnonzero(np.diff(inside) == -1)
    # A word that runs over the border between two texts is two words.
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    cuts = cuts[~space[cuts] & ~space[cuts - 1]]
    if len(cuts):
        starts = np.sort(np.concatenate([starts, cuts]))
        ends = np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_MULTIPLIER = 0x9E3779B97F4A7C15
_LETTERS = mix64(np.array([x + 33 if 65 <= x <= 90 else x + 1 for x in range(256)], np.uint64))


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier modulo 2^64, and of its inverse."""
    return tuple(np.cumprod(np.full(size, np.uint64(m))) for m in (_MULTIPLIER, pow(_MULTIPLIER, -1, 2**64)))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words' bytes; A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers, inverse = _powers(1 << int(len(data)).bit_length())
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * powers[: len(data)], out=prefix[1:])
    return mix64((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
