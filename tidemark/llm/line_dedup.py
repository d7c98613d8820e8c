"""Line dedup: repeated runs of lines, found by distributed prefix doubling over line identifiers."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, Scratch, keyed, numbered, slices, unused, utf8

#: Words of a run of lines, at least, for its later copies to go.
MIN_WORDS = 3
SLICE_BYTES = 4 << 20
#: Keys whose positions are dealt over several tasks, and over how many.
HOT, SALTS = 1000, 32


def shortest_runs(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines of the shortest run with so many words from every line on, and up to every line; 0 where there is none."""
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    at = np.arange(n)
    on = np.searchsorted(total, total[:-1] + least, "left")
    up = np.searchsorted(total, total[1:] - least, "right")
    return np.where(on <= n, on - at, 0), np.where(total[1:] >= least, at + 2 - up, 0)


def _lines(min_words: int):
    def lines(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                data, offsets = utf8(part.column("text"))
                raw = data.tobytes()
                ids, number, digests, on, up = [], [], [], [], []
                for id_, (a, b) in zip(part.column("id").to_pylist(), itertools.pairwise(offsets.tolist())):
                    own = raw[a:b].split(b"\n")
                    f, r = shortest_runs(np.fromiter((len(x.split()) for x in own), np.int64, len(own)), min_words)
                    ids.append(np.full(len(own), id_))
                    number.append(np.arange(len(own)))
                    digests += [hashlib.blake2b(x, digest_size=16).digest() for x in own]
                    on.append(f)
                    up.append(r)
                if ids:
                    columns = [pa.array(np.concatenate(x)) for x in (ids, number, on, up)]
                    yield pa.RecordBatch.from_arrays([*(c.cast(t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32()))), pa.array(digests, pa.binary())], names=["id", "line", "on", "up", "digest"])

    return lines


def _named(keyed: DataFrame, scratch: Scratch, table: str, *key: str) -> DataFrame:
    """(at, name): the earliest position with the same key, for keys that several positions have.

    The positions of the HOT commonest keys are dealt over SALTS copies of
    their name, so that a line in very many texts is no hot spot: any other
    key has less than one in HOT of all rows.
    """
    names = scratch.save(keyed.groupBy(*key).agg(F.min("at").alias("name"), F.count(F.lit(1)).alias("n")).where("n > 1"), f"{table}-names")
    hot = F.broadcast(names.orderBy(F.desc("n"), *key).limit(HOT).select(*key, F.lit(True).alias("hot")))  # HOT rows at most
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("at"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    copies = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = keyed.join(hot, [*key], "left").withColumn("salt", salt).drop("hot")
    right = names.join(hot, [*key], "left").select(*key, "name", F.explode(copies).alias("salt"))
    return left.join(right, [*key, "salt"]).select("at", "name")


def _shifted(names: DataFrame, by) -> DataFrame:
    """Names under the position that is so many lines earlier."""
    return names.select(F.struct(F.col("at")["id"].alias("id"), (F.col("at")["line"] - by).cast("int").alias("line")).alias("at"), F.col("name").alias("right"))


def repeated_runs(rows: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, line, length): runs of lines of the (id, text) rows that also start earlier; all others lie within unions of these.

    A position is (id, line), in that order. Level k of the prefix doubling
    names every position after the earliest one with the same 2^k lines, from
    the names of its two halves; positions with unique lines drop out. Equal
    names are an interval of the suffix array with a common prefix of 2^k
    lines. A run of any length m is named by the pair of names of its first and
    last 2^k lines, 2^k <= m < 2^(k+1); it repeats if its name is not its own.

    A maximal repeated run of min_words words or more is the union of the
    shortest such runs from each of its lines on and up to each of its lines,
    so these are the runs that are looked up.
    """
    lines = scratch.save(rows.select("id", "text").mapInArrow(_lines(min_words), "id long, line int, on int, up int, digest binary"), "lines")
    at = F.struct("id", "line").alias("at")
    names = scratch.save(_named(lines.select(at, "digest"), scratch, "level-0", "digest"), "level-0")
    runs = lines.where("on > 0").select(at, F.col("on").alias("m")).union(
        lines.where("up > 1").select(F.struct("id", (F.col("line") - F.col("up") + 1).cast("int").alias("line")).alias("at"), F.col("up").alias("m"))
    )
    # Only runs whose first line is in several places.
    runs = scratch.save(runs.distinct().join(names, "at"), "runs")
    found = runs.where((F.col("m") == 1) & (F.col("name") != F.col("at"))).select("at", "m")
    longest = runs.agg(F.max("m")).first()[0] or 1
    size = 1
    while True:
        # Runs of size + 1 .. 2 * size - 1 lines (of one more for the next power) by their two ends.
        ends = runs.where((F.col("m") > size) & (F.col("m") < 2 * size)).drop("name")
        ends = ends.join(names.withColumnRenamed("name", "left"), "at").withColumn("end", F.struct(F.col("at")["id"].alias("id"), (F.col("at")["line"] + F.col("m") - size).cast("int").alias("line")))
        ends = ends.join(names.select(F.col("at").alias("end"), F.col("name").alias("right")), "end")
        by_ends = ends.groupBy("m", "left", "right").agg(F.min("at").alias("first"))
        found = found.union(ends.join(by_ends, ["m", "left", "right"]).where(F.col("first") != F.col("at")).select("at", "m"))
        size *= 2
        if size > longest:
            break
        pairs = names.withColumnRenamed("name", "left").join(_shifted(names, size // 2), "at")
        names = scratch.save(_named(pairs, scratch, f"level-{size}", "left", "right"), f"level-{size}")
        found = found.union(runs.where(F.col("m") == size).select("at", "m").join(names, "at").where(F.col("name") != F.col("at")).select("at", "m"))
    return found.select(F.col("at")["id"].alias("id"), F.col("at")["line"].alias("line"), F.col("m").alias("length"))


def drop_lines(text: str, runs: list) -> tuple[str, int, int]:
    """The text without the lines of the runs, how many lines it had, and how many went."""
    own = text.split("\n")
    gone = np.zeros(len(own) + 1, np.int64)
    for r in runs or ():
        gone[r["line"]] += 1
        gone[r["line"] + r["length"]] -= 1
    keep = np.cumsum(gone)[:-1] == 0
    return "\n".join(itertools.compress(own, keep)), len(own), int(len(own) - keep.sum())


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Every text without its later copies of repeated line runs.

    A run of consecutive lines of one text with min_words words or more goes if
    the same lines also start earlier: in a text of smaller identifier, or
    earlier in the same text. Lines end at newlines and are compared whole;
    blank lines go only inside a run. Lines are judged on the input.

    Returns one row per input row: identifier, kept (the remaining lines),
    n_lines, n_removed. Null and empty texts are one empty line. Where
    identifiers are null or repeat, rows are numbered in identifier order
    (nulls last), which is their order here too.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    rows = numbered(docs, id_col, text_col, scratch)
    runs = repeated_runs(rows, scratch, min_words)
    runs = scratch.save(runs.groupBy("id").agg(F.collect_list(F.struct("line", "length")).alias("runs")), "found")

    def cut(batches):
        for batch in batches:
            found = [drop_lines(t, r) for t, r in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist())]
            kept, n, gone = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("own_id"), pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=[id_col, "kept", "n_lines", "n_removed"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return rows.join(runs.hint("merge"), "id", "left").select("own_id", "text", "runs").mapInArrow(cut, f"`{id_col}` {id_type}, kept string, n_lines long, n_removed long")


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with their remaining lines as text; rows of which nothing remains are dropped.

    Every row is judged by itself, also where identifiers are null or repeat.
    Rows whose text keeps all lines stay as they are; where lines went,
    chars_col is counted anew.
    """
    rows = keyed(docs, id_col, Scratch(docs.sparkSession, "line-dedup-rows"))
    kept = unused("__kept", docs)
    found = dedup_lines(rows, ROW, text_col, min_words).where("n_removed > 0").select(ROW, F.col("kept").alias(kept))
    joined = rows.join(found, ROW, "left")
    changed = {text_col: F.coalesce(kept, text_col)}
    if chars_col in docs.columns:
        changed[chars_col] = F.when(F.col(kept).isNotNull(), F.length(kept)).otherwise(F.col(chars_col)).cast(docs.schema[chars_col].dataType)
    return joined.where(F.col(kept).isNull() | (F.col(kept) != "")).withColumns(changed).select(*docs.columns)
