"""Near-duplicate detection: BagMinHash signatures, bands, and verified multiset overlap."""

from __future__ import annotations

import hashlib
import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, Scratch, keyed, mix64, numbered, slices, utf8, word_hashes, word_spans
from tidemark.llm.components import components

_U = np.uint64
_GOLDEN = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class NearConfig:
    words: int = 5  #: per shingle
    similarity: float = 0.8  #: weighted Jaccard of the shingle multisets that makes a link
    bands: int = 36
    band_rows: int = 5
    extra: int = 4  #: weight by which the prefixes of the last comparison are longer than they must be
    slice_bytes: int = 1 << 20

    @property
    def slots(self) -> int:
        return self.bands * self.band_rows


#: Odd factors of a shingle's words, by place.
_PLACES = [mix64(np.array([j + 1], np.uint64))[0] | _U(1) for j in range(64)]


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of so many words and each one's text; a shorter text is one shingle, one without words none."""
    starts, ends, doc = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends)
    n_docs = len(offsets) - 1
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    n = np.diff(first)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(n_docs), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - first[:-1], count)
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    total = np.zeros(len(at), np.uint64)
    for j in range(words):
        total += padded[at + j] * _PLACES[j]
    for d in np.flatnonzero((n > 0) & (n < words)):
        own = hashes[first[d] : first[d + 1]]
        total[np.searchsorted(owner, d)] = sum((own * np.array(_PLACES[: len(own)])).tolist()) & (2**64 - 1)
    return mix64(total + np.minimum(n, words)[owner].astype(np.uint64)), owner


def weighted(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (shingle, text) with how often the text has it."""
    key = hashes ^ mix64(owner.astype(np.uint64) + _U(1))
    order = np.argsort(key)
    new = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0])) if len(key) else np.zeros(0, np.int64)
    return hashes[order[new]], owner[order[new]], np.diff(np.append(new, len(key)))


def bag_minhash(hashes: np.ndarray, owner: np.ndarray, count: np.ndarray, n_docs: int, slots: int) -> np.ndarray:
    """Signatures (n_docs x slots) whose share of equal slots estimates the weighted Jaccard similarity.

    The weight axis is cut at 1, 2, 4, 8, ...; each interval of each shingle
    has its own Poisson process in time, with a rate equal to the interval's
    length. A point has a place on the weight axis and a slot; it counts if the
    shingle's weight reaches that place. A slot keeps its earliest point. A
    process stops once its time passes the latest slot of its text, so a
    frequent shingle costs a few intervals, not one process per copy. Texts
    without shingles get zeros.
    """
    levels = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1
    who = np.repeat(np.arange(len(hashes)), levels)
    level = np.arange(levels.sum()) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    length = np.maximum(low, 1)
    seed = mix64(hashes[who] + _U(_GOLDEN) * (level + 1).astype(np.uint64))
    doc, weight = owner[who], count[who]
    earliest = np.full(n_docs * slots, np.inf)
    found = np.zeros(n_docs * slots, np.uint64)
    time = np.zeros(len(seed))
    step = 0
    while len(seed):
        step += 1
        draw = mix64(seed + _U(step * 0xD1B54A32D192ED03 & (2**64 - 1)))
        time = time - np.log(((draw >> _U(24)).astype(np.float64) + 0.5) / 2.0**40) / length
        slot = doc * slots + (((draw & _U(0xFFFFFF)) * _U(slots)) >> _U(24)).astype(np.int64)
        valid = np.ones(len(seed), bool)
        wide = np.flatnonzero(length > 1)
        if len(wide):
            second = mix64(draw[wide] ^ _U(0xA0761D6478BD642F))
            valid[wide] = low[wide] + 1 + (second % length[wide].astype(np.uint64)).astype(np.int64) <= weight[wide]
        at, when = (slot, time) if not len(wide) else (slot[valid], time[valid])
        np.minimum.at(earliest, at, when)
        won = earliest[at] == when
        found[at[won]] = (draw if not len(wide) else draw[valid])[won]
        latest = earliest.reshape(n_docs, slots).max(axis=1)
        alive = np.flatnonzero(time < latest[doc])
        seed, time, low, length, doc, weight = seed[alive], time[alive], low[alive], length[alive], doc[alive], weight[alive]
    return found.reshape(n_docs, slots)


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, -1)
    keys = np.zeros(parts.shape[:2], np.uint64)
    for j in range(parts.shape[2]):
        keys = mix64(keys + parts[:, :, j] + _U((j + 1) * _GOLDEN & (2**64 - 1)))
    return mix64(keys + np.arange(bands, dtype=np.uint64) * _U(_GOLDEN)).view(np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted distinct shingles, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    return float(shared / max(1, a[1].sum() + b[1].sum() - shared))


def bag(text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode(), np.uint8)
    return np.unique(shingles(data, np.array([0, len(data)]), words)[0], return_counts=True)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: NearConfig = NearConfig()) -> DataFrame:
    """Classes of texts that are linked by a similarity of 0.8 or more.

    Two texts are linked if the multisets of their five-word shingles (A-Z as
    a-z) have that weighted Jaccard similarity, which is computed exactly;
    classes are the connected components. Texts with equal words are one text
    from the start.

    Bands of signatures (36 of 5 slots: a pair at 0.8 shares one with
    probability 1 - 6e-7) make candidates. A band value that several texts
    share is a bucket. Every bucket compares its first text with all others;
    buckets that then hold several classes compare the text with the fewest
    shingles of its own. What is left is joined by prefix filtering: a link
    needs a common shingle among the rarest of both texts. So every candidate
    pair is compared, or is within a class, or cannot have a link; a bucket of
    n copies costs n comparisons, not n^2.

    Returns one row per input row: identifier, class_id (least identifier of
    the class), class_size (rows), kept (the row that stays). Null text counts
    as empty; texts without words are equal to each other. A null identifier
    sorts last; of repeated rows one is kept.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    own_type = docs.schema[id_col].dataType.simpleString()
    texts = numbered(docs, id_col, text_col, scratch)

    def sketch(batches):
        for batch in batches:
            for part in slices(batch, "text", config.slice_bytes):
                data, offsets = utf8(part.column("text"))
                raw, n = data.tobytes(), part.num_rows
                digests = [hashlib.blake2b(b" ".join(raw[a:b].lower().split()), digest_size=16).digest() for a, b in itertools.pairwise(offsets.tolist())]
                every, owner = shingles(data, offsets, config.words)
                keys = band_keys(bag_minhash(*weighted(every, owner), n, config.slots), config.bands)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * config.bands, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("own_id"), part.column("id"), pa.array(digests, pa.binary()), pa.array(np.bincount(owner, minlength=n), pa.int64()), lists], names=["own_id", "id", "digest", "weight", "bands"]
                )

    schema = f"own_id {own_type}, id long, digest binary, weight long, bands array<bigint>"
    rows = scratch.save(texts.select("own_id", "id", "text").mapInArrow(sketch, schema), "rows")

    # Texts of equal words are one text, named after the first of their rows.
    unique = rows.groupBy("digest").agg(F.min("id").alias("tid"), F.first("bands").alias("bands"), F.first("weight").alias("weight"))
    unique = scratch.save(unique, "unique")
    banded = unique.where("weight > 0").select("tid", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = scratch.save(banded.join(shared, "bucket"), "members-0")
    candidates = members.select(F.col("tid").alias("id")).distinct()
    bodies = scratch.save(texts.join(candidates, "id").select(F.col("id").alias("tid"), "text"), "bodies")

    labels = scratch.save(members.select(F.col("tid").alias("node"), F.col("tid").alias("label")).distinct(), "labels-0")
    weights = unique.select("tid", "weight")
    for step in ("first", "hub", "rest"):
        placed = members.join(labels, F.col("tid") == F.col("node")).drop("node")
        if step == "first":
            centres = placed.groupBy("bucket").agg(F.min("tid").alias("centre")).withColumn("centre_label", F.col("centre"))
        elif step == "hub":
            centres = placed.groupBy("bucket").agg(F.min(F.struct("own_share", "tid", "label")).alias("c")).select("bucket", F.col("c")["tid"].alias("centre"), F.col("c")["label"].alias("centre_label"))
        if step == "rest":
            pairs = _prefix_pairs(placed, scratch, weights, config)
        else:
            pairs = placed.join(centres, "bucket").where("label != centre_label").select(F.least("centre", "tid").alias("a"), F.greatest("centre", "tid").alias("b")).distinct()
        links = scratch.save(_verify(pairs, bodies, config).where(F.col("similarity") >= config.similarity), f"links-{step}")
        if not links.isEmpty():
            of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
            merged = components(links.join(of("a"), "a").join(of("b"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b")), scratch, f"merge-{step}")
            merged = merged.select(F.col("node").alias("label"), F.col("label").alias("new"))
            labels = scratch.save(labels.join(merged, "label", "left").select("node", F.coalesce("new", "label").alias("label")), f"labels-{step}")
        if step == "rest":
            break
        # Buckets that still hold several classes go on, with the texts that can still have a link.
        named = members.select("bucket", "tid").join(labels, F.col("tid") == F.col("node"))
        several = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("bucket")
        members = scratch.save(members.select("bucket", "tid").join(several, "bucket"), f"members-{step}")
        if step == "first":
            held = scratch.save(_shingle_rows(members, bodies, config), "held")
        members = scratch.save(_hopeful(members, held, labels, weights, config), f"hopeful-{step}")

    classes = unique.select("digest", "tid").join(labels.withColumnRenamed("node", "tid"), "tid", "left").select("digest", F.coalesce("label", "tid").alias("label"))
    # A label is the number of the class's first row.
    rows = scratch.save(rows.select("own_id", "id", "digest").join(classes, "digest").select("own_id", "id", "label"), "classed")
    totals = rows.groupBy("label").agg(F.count(F.lit(1)).alias("class_size"))
    totals = totals.join(rows.where("id = label").select(F.col("own_id").alias("class_id"), "label"), "label")
    return rows.join(totals, "label").select(F.col("own_id").alias(id_col), "class_id", "class_size", (F.col("id") == F.col("label")).alias("kept"))


def _shingle_rows(members: DataFrame, bodies: DataFrame, config: NearConfig) -> DataFrame:
    """(tid, shingle, n): the shingles of the members' texts."""

    def bags(batches):
        for batch in batches:
            for part in slices(batch, "text", config.slice_bytes):
                every, owner, count = weighted(*shingles(*utf8(part.column("text")), config.words))
                yield pa.RecordBatch.from_arrays([part.column("tid").take(pa.array(owner)), pa.array(every.view(np.int64)), pa.array(count, pa.int64())], names=["tid", "shingle", "n"])

    return members.select("tid").distinct().join(bodies, "tid").mapInArrow(bags, "tid long, shingle long, n long")


def _spread(held: DataFrame, texts: DataFrame) -> DataFrame:
    """(tid, shingle, n, texts, alone): of the given (tid, label) texts, how many have the shingle, and whether all of them are of one class."""
    own = held.join(texts.select("tid", "label"), "tid")
    by = own.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    return own.join(by, "shingle").select("tid", "shingle", "n", "texts", (F.col("lo") == F.col("hi")).alias("alone"))


def _hopeful(members: DataFrame, held: DataFrame, labels: DataFrame, weights: DataFrame, config: NearConfig) -> DataFrame:
    """(bucket, tid, needed, own_share) of texts that can still have a link in one of their buckets.

    A link of similarity t between weights a and b needs an overlap of
    t / (1 + t) * (a + b), and b is at least t * a and the least weight in a's
    buckets: no link needs less than ``needed``. A text overlaps those of
    other classes by no more than the weight of those of its shingles that
    some other class here has too; texts for which that is too little drop
    out, which changes no class.
    """
    classed = members.select("tid").distinct().join(labels, F.col("tid") == F.col("node"))
    own = _spread(held, classed).where("alone").groupBy("tid").agg(F.sum("n").alias("own"))
    sized = members.join(weights, "tid")
    least = sized.groupBy("bucket").agg(F.min("weight").alias("least"))
    texts = sized.join(least, "bucket").groupBy("tid").agg(F.min("weight").alias("weight"), F.min("least").alias("least")).join(own, "tid", "left")
    t = config.similarity
    needed = t / (1 + t) * (F.col("weight") + F.greatest(t * F.col("weight"), F.col("least"))) - 1e-6
    texts = texts.select("tid", "weight", F.coalesce("own", F.lit(0)).alias("own"), needed.alias("needed"))
    kept = texts.where(F.col("weight") - F.col("own") >= F.col("needed")).select("tid", "needed", (F.col("own") / F.col("weight")).alias("own_share"))
    return members.join(kept, "tid").select("bucket", "tid", "needed", "own_share")


def _prefix_pairs(placed: DataFrame, scratch: Scratch, weights: DataFrame, config: NearConfig) -> DataFrame:
    """(a, b) pairs of different classes that can have a link.

    Shingles have one order: those of one class, which no link has in common,
    then rare ones first. If a link needs an overlap of
    ``needed``, no more than weight - needed of either text is outside it, so
    the first shingles of both, up to a weight of weight - needed + extra, have
    a weight of more than extra in common: these prefixes are joined. One side
    takes the texts that are not of the largest class of some bucket of theirs.
    The join has both weights, so it takes the overlap that this pair needs
    (``needed`` is for the lightest partner), cuts both prefixes to that, and
    passes over shingles at which the texts no longer can reach it: what comes
    before a common shingle (without the shingles of one class), and what
    follows, overlaps by the lesser of both.
    """
    held = scratch.spark.read.parquet(f"{scratch.root}/held")
    texts = placed.groupBy("tid").agg(F.min("needed").alias("needed"), F.min("label").alias("label")).join(weights, "tid")
    before = F.sum("n").over(Window.partitionBy("tid").orderBy(F.desc("alone"), "texts", "shingle").rowsBetween(Window.unboundedPreceding, -1))
    spread = _spread(held, texts)
    own = spread.groupBy("tid").agg(F.coalesce(F.sum(F.when(F.col("alone"), F.col("n"))), F.lit(0)).alias("own"))
    prefix = spread.join(texts.join(own, "tid"), "tid").withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") <= F.col("weight") - F.col("needed") + config.extra)
    prefix = scratch.save(prefix.where("NOT alone").select("tid", "shingle", "n", "label", "weight", "before", "own"), "prefix")
    sizes = placed.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("top")).select("bucket", F.col("top")["label"].alias("top"))
    small = placed.join(largest, "bucket").where("label != top").select("tid").distinct()
    left = prefix.join(small, "tid").select("shingle", *(F.col(c).alias(f"x_{c}") for c in ("tid", "n", "label", "weight", "before", "own")))
    pair_needs = config.similarity / (1 + config.similarity) * (F.col("weight") + F.col("x_weight")) - 1e-6
    reach = F.least(F.col("before") - F.col("own"), F.col("x_before") - F.col("x_own")) + F.least(F.col("weight") - F.col("before"), F.col("x_weight") - F.col("x_before"))
    short = (F.col("before") <= F.col("weight") - pair_needs + config.extra) & (F.col("x_before") <= F.col("x_weight") - pair_needs + config.extra)
    both = left.join(prefix, "shingle").where("label != x_label").where(short & (reach >= pair_needs)).withColumnRenamed("x_tid", "x")
    common = both.groupBy("x", "tid").agg(F.sum(F.least("n", "x_n")).alias("common")).where(F.col("common") > config.extra)
    return common.select(F.least("x", "tid").alias("a"), F.greatest("x", "tid").alias("b")).distinct()


def _verify(pairs: DataFrame, bodies: DataFrame, config: NearConfig) -> DataFrame:
    """(a, b, similarity) of the pairs' texts."""

    def compare(batches):
        last, mine = None, None
        for batch in batches:
            found = []
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("x"), batch.column("y")):
                if a != last:
                    last, mine = a, bag(x.as_py(), config.words)
                found.append(overlap(mine, bag(y.as_py(), config.words)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], names=["a", "b", "similarity"])

    with_y = pairs.join(bodies.select(F.col("tid").alias("b"), F.col("text").alias("y")), "b")
    with_x = with_y.join(bodies.select(F.col("tid").alias("a"), F.col("text").alias("x")), "a")
    return with_x.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, similarity double")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: NearConfig = NearConfig()) -> DataFrame:
    """One row of docs, with all its columns, of each class of near duplicates; ids may be null or repeat."""
    rows = keyed(docs, id_col, Scratch(docs.sparkSession, "near-dedup-rows"))
    gone = near_duplicates(rows, ROW, text_col, config).where("NOT kept").select(ROW)
    return rows.join(gone, ROW, "left_anti").select(*docs.columns)
