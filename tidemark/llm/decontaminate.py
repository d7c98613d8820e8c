"""Benchmark decontamination: backward search in an FM-index of every training shard."""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import ROW, Scratch, keyed, slices, utf8

#: Consecutive words of a test phrase.
WINDOW = 13
#: Bytes of benchmark text that one pass over the corpus searches for, and so the bound on what is sent to tasks.
BLOCK_BYTES = 16 << 20
#: Bytes of corpus text per shard and so per index.
SHARD_BYTES = 8 << 20
#: Every SAMPLE-th suffix position is kept for locating.
SAMPLE = 8

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Lower-cases A-Z and turns every byte outside words into a space.
_FOLD = bytes(x if 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A or x >= 0x80 else x + 32 if 0x41 <= x <= 0x5A else 0x20 for x in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix positions in order, by prefix doubling; seq must end in a unique least symbol."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.zeros(n, np.int64)
        new[1:] = np.cumsum(sorted_key[1:] != sorted_key[:-1])
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class WaveletTree:
    """Rank and access over integer symbols: one bit vector with prefix counts per bit level."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in reversed(range(self.bits)):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int64))
            self.zeros.append(len(seq) - int(bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        start = np.zeros_like(at)
        for level, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros):
            one = (symbols >> level) & 1 == 1
            start = np.where(one, zeros + ones[start], start - ones[start])
            at = np.where(one, zeros + ones[at], at - ones[at])
        return at - start

    def access(self, at: np.ndarray) -> np.ndarray:
        found = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros):
            one = ones[at + 1] - ones[at]
            found = found * 2 + one
            at = np.where(one == 1, zeros + ones[at], at - ones[at])
        return found


class FmIndex:
    """FM-index of a symbol sequence that ends in the unique least symbol 0."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        order = suffix_array(seq)
        self.n = len(seq)
        self.tree = WaveletTree(seq[order - 1], n_symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=n_symbols))])
        self.sampled = order % SAMPLE == 0
        self.sample_no = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of equally long patterns (one per row), by backward search."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        for symbols in patterns.T[::-1]:
            low = self.first[symbols] + self.tree.rank(symbols, low)
            high = self.first[symbols] + self.tree.rank(symbols, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back to the next sampled position."""
        found = np.full(len(rows), -1, np.int64)
        open_, steps = np.arange(len(rows)), 0
        while len(open_):
            hit = self.sampled[rows]
            found[open_[hit]] = self.samples[self.sample_no[rows[hit]]] + steps
            open_, rows = open_[~hit], rows[~hit]
            symbols = self.tree.access(rows)
            rows = self.first[symbols] + self.tree.rank(symbols, rows)
            steps += 1
        return found


class Phrases:
    """The distinct windows of a block of benchmark items, as symbols of the items' own words."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.symbol: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str | None]] = {}
        for item, text in items:
            own = [self.symbol.setdefault(w, len(self.symbol) + 2) for w in words(text)]
            for i in range(max(1, len(own) - window + 1) if own else 0):
                owners.setdefault(tuple(own[i : i + window]), set()).add(item)
        self.shortest = min(map(len, owners), default=1)
        self.by_length = []
        for length, group in itertools.groupby(sorted(owners, key=len), len):
            group = list(group)
            self.by_length.append((length, np.array(group, np.int64), [list(owners[p]) for p in group]))

    def hits(self, texts: list[bytes]):
        """Per text: its number of words, merged spans of hit words, and the items with a window in it."""
        get, sizes, parts = self.symbol.get, [], []
        for text in texts:
            own = words(text)
            sizes.append(len(own))
            parts.append(np.fromiter(map(get, own, itertools.repeat(1)), np.int64, len(own)))
            parts.append(np.ones(1, np.int64))
        out = [(n, [], []) for n in sizes]
        seq = np.concatenate([*parts, np.ones(1, np.int64)])
        # Only runs of benchmark words as long as the shortest window can hold an occurrence.
        change = np.flatnonzero(np.diff(np.concatenate([[0], (seq > 1).astype(np.int8), [0]])))
        starts, ends = change[::2], change[1::2]
        long = ends - starts >= self.shortest
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return out
        lengths = ends - starts + 1
        offset = np.cumsum(lengths) - lengths
        place = np.arange(lengths.sum()) - np.repeat(offset - starts, lengths)
        index = FmIndex(np.append(seq[place], 0), len(self.symbol) + 2)
        doc_start = np.cumsum([0, *(n + 1 for n in sizes)])
        found: list[tuple[np.ndarray, np.ndarray, int]] = []
        items: dict[int, set[str | None]] = {}
        for length, patterns, owners in self.by_length:
            low, high = index.search(patterns)
            n = np.maximum(high - low, 0)
            if not n.sum():
                continue
            which = np.repeat(np.arange(len(n)), n)
            rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n)
            at = place[index.locate(rows)]
            doc = np.searchsorted(doc_start, at, "right") - 1
            found.append((doc, at - doc_start[doc], length))
            for d, p in np.unique(np.stack([doc, which], 1), axis=0).tolist():
                items.setdefault(d, set()).update(owners[p])
        if not found:
            return out
        doc = np.concatenate([d for d, _, _ in found])
        start = np.concatenate([s for _, s, _ in found])
        end = np.concatenate([s + n for _, s, n in found])
        order = np.lexsort((start, doc))
        for d, s, e in zip(doc[order].tolist(), start[order].tolist(), end[order].tolist()):
            spans = out[d][1]
            if spans and s <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], e)
            else:
                spans.append([s, e])
        for d, own in items.items():
            out[d][2].extend(own)
        return out


def _search(docs: DataFrame, items: list[tuple[str | None, bytes]], id_col: str, text_col: str, window: int) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
            T.StructField("items", T.ArrayType(T.StringType())),
        ]
    )

    def shards(batches):
        phrases = Phrases(items, window)
        for batch in batches:
            for part in slices(batch, text_col, SHARD_BYTES):
                data, at = utf8(part.column(text_col))
                raw = data.tobytes()
                hits = phrases.hits([raw[a:b] for a, b in itertools.pairwise(at.tolist())])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(id_col),
                        pa.array([n for n, _, _ in hits], pa.int64()),
                        pa.array([s for _, s, _ in hits], pa.list_(pa.list_(pa.int64()))),
                        pa.array([i for _, _, i in hits], pa.list_(pa.string())),
                    ],
                    names=schema.names,
                )

    return docs.select(id_col, text_col).mapInArrow(shards, schema)


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """The word spans of each document that lie inside a window of a benchmark item.

    Each task turns its documents into shards of about 8 MB, builds an
    FM-index over the words of a shard (runs of benchmark words; no occurrence
    can leave them), finds all test phrases by backward search and locates
    them by sampled suffix positions. The benchmark goes to the tasks in
    blocks of BLOCK_BYTES, one pass over the corpus each, so that what is sent
    is bounded; spans of several blocks are merged by document, whose rows are
    numbered and written once.

    Returns one row per input row: identifier, n_words, spans (merged [start,
    end) word indices), items (identifiers as text, in string order; items
    without an identifier are hit like others and are one null, the last,
    which verdicts() counts and leaves out of the digest). Null
    text has no words; a benchmark item without words, or with null text, has
    no window. An empty benchmark hits nothing. Repeated identifiers stay
    separate rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.struct(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row")).alias("key"), F.col(text_col).alias("text"))
    sized = benchmark.select(F.col(item_col).cast("string").alias("item"), F.encode(F.col(item_text_col), "utf-8").alias("raw")).where("raw IS NOT NULL")
    total = sized.agg(F.sum(F.length("raw"))).first()[0] or 0
    n_blocks = -(-total // BLOCK_BYTES) or 1
    if n_blocks > 1:  # numbers that another scan gives may differ
        docs = Scratch(spark, "decontamination").save(docs, "rows")
    blocks = sized.withColumn("block", F.pmod(F.xxhash64("item", "raw"), F.lit(n_blocks)))
    found = [
        _search(docs, [(r["item"], bytes(r["raw"])) for r in blocks.where(F.col("block") == b).select("item", "raw").collect()], "key", "text", window)
        for b in range(n_blocks)
    ]
    if n_blocks > 1:
        every = found[0]
        for more in found[1:]:
            every = every.union(more)
        spans = F.aggregate(
            F.array_sort("spans"),
            F.array().cast("array<array<bigint>>"),
            lambda done, x: F.when((F.size(done) > 0) & (F.element_at(F.element_at(done, -1), 2) >= x[0]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array(F.element_at(done, -1)[0], F.greatest(F.element_at(F.element_at(done, -1), 2), x[1]))))).otherwise(F.concat(done, F.array(x))),
        )
        every = every.groupBy("key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items")).withColumn("spans", spans)
    else:
        every = found[0]
    return every.select(F.col("key")["id"].alias(id_col), "n_words", "spans", F.array_sort(F.array_distinct("items")).alias("items"))


def verdicts(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digest of contamination(): a document is contaminated if a twentieth of its words or more are hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select(
        id_col,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated, unchanged; each row is judged by itself, also where identifiers are null or repeat."""
    rows = keyed(docs, id_col, Scratch(docs.sparkSession, "decontamination-rows"))
    bad = verdicts(contamination(rows, benchmark, ROW, text_col), ROW).where("contaminated").select(ROW)
    return rows.join(bad, ROW, "left_anti").select(*docs.columns)


def cut_spans(text: str | None, spans: list[list[int]]) -> str | None:
    """The text without the words of the given spans and what stands between them."""
    if text is None or not spans:
        return text
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    out, last = [], 0
    for start, end in spans:
        out.append(raw[last : at[start][0]])
        last = at[end - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
