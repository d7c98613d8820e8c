"""Removal of repeated word windows, with a count-min prefilter."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import Scratch, mix64, numbered, slices, utf8, word_hashes, word_spans

_U = np.uint64
#: Bytes of a window's digest.
DIGEST = 16
_MULTIPLIER = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class WindowConfig:
    words: int = 35  #: of a window
    depth: int = 2  #: rows of the sketch
    spread: int = 4  #: cells of a row for each window, at least
    range_bits: int = 22  #: log2 of the cells that one task merges
    part_windows: int = 1 << 18  #: windows of the corpus for each part of the exact grouping
    unit_bytes: int = 8 << 20  #: text of a unit


def _pack(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def _unpack(blob: bytes, size: int) -> bytes:
    return pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True)


def _units(config: WindowConfig, id_type: pa.DataType):
    """Gathers rows into units of about unit_bytes of text (one row at least)."""

    def unit(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        data, offsets = utf8(rows.column("text"))
        _, _, owner = word_spans(data, offsets)
        n = np.bincount(owner, minlength=rows.num_rows)
        own, row = rows.column("own_id"), rows.column("id").to_numpy()
        return pa.RecordBatch.from_arrays(
            # The least row number names the unit.
            [pa.array([row.min()], pa.int64()), pa.array([int(np.maximum(n - config.words + 1, 0).sum())], pa.int64()), pa.array([own.to_pylist()], pa.list_(id_type)), pa.array([np.diff(offsets)], pa.list_(pa.int64())), pa.array([_pack(data.tobytes())], pa.binary())],
            names=["unit", "windows", "ids", "sizes", "blob"],
        )

    def gather(batches):
        parts, size = [], 0
        for batch in batches:
            for part in slices(batch, "text", config.unit_bytes // 8):
                here = len(utf8(part.column("text"))[0])
                if parts and size + here > config.unit_bytes:
                    yield unit(parts)
                    parts, size = [], 0
                parts.append(part)
                size += here
        if parts:
            yield unit(parts)

    return gather


class _Text:
    """A unit's texts: bytes, borders of the texts, and of the words; the windows that lie in one text."""

    def __init__(self, sizes: list, blob: bytes, words: int):
        self.offsets = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))]).astype(np.int64)
        self.data = np.frombuffer(_unpack(blob, int(self.offsets[-1])), np.uint8)
        self.starts, self.ends, owner = word_spans(self.data, self.offsets)
        # The first words of the windows.
        self.at = np.flatnonzero(owner[: max(0, len(owner) - words + 1)] == owner[words - 1 :]) if len(owner) >= words else np.zeros(0, np.int64)
        self.owner, self.words = owner, words

    def window_hashes(self) -> np.ndarray:
        """64-bit hashes of the windows, alike for equal ones (A-Z count as a-z here); a window's is a difference of prefix sums over its words."""
        each, first = np.zeros(len(self.starts), _U), 0
        while first < len(self.starts):
            base = self.starts[first]
            last = max(first + 1, int(np.searchsorted(self.ends, base + (1 << 19), "right")))
            each[first:last] = word_hashes(self.data[base : self.ends[last - 1]], self.starts[first:last] - base, self.ends[first:last] - base)
            first = last
        # A multiplier per place, so that the order of the words counts.
        power = np.cumprod(np.full(len(each), _U(_MULTIPLIER)))
        prefix = np.concatenate([np.zeros(1, _U), np.cumsum(each * power)])
        inverse = np.cumprod(np.full(len(each), _U(pow(_MULTIPLIER, -1, 2**64))))
        return mix64((prefix[self.at + self.words] - prefix[self.at]) * inverse[self.at])

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """All words, each with one space after it, and where they start (and the end)."""
        place = np.concatenate([[0], np.cumsum(self.ends - self.starts + 1)]).astype(np.int64)
        text = np.full(int(place[-1]), 32, np.uint8)
        letters = np.ones(len(text), bool)
        letters[place[1:] - 1] = False
        text[letters] = self.data[(self.data != 32) & ((self.data < 9) | (self.data > 13))]
        return text, place

    def digests(self, which: np.ndarray) -> np.ndarray:
        """128-bit digests of the word sequences of the windows with these numbers, as rows of two integers."""
        text, place = self.joined()
        text = memoryview(text.tobytes())
        spans = zip(place[self.at[which]].tolist(), (place[self.at[which] + self.words] - 1).tolist())
        made = b"".join([hashlib.blake2b(text[a:b], digest_size=DIGEST).digest() for a, b in spans])
        return np.frombuffer(made, _U).reshape(-1, 2)


def pack_cells(cells: np.ndarray, bits: int) -> bytes:
    """Increasing cells below 2^bits as their low bytes and a bitmap of the steps of what is above them."""
    low = 8 if len(cells) > (1 << (bits - 8)) // 8 else 16
    high = np.zeros((1 << (bits - low)) + len(cells), bool)
    high[(cells >> low) + np.arange(len(cells))] = True
    return (cells & ((1 << low) - 1)).astype(np.uint8 if low == 8 else "<u2").tobytes() + np.packbits(high).tobytes()


def unpack_cells(blob: bytes, n: int, bits: int) -> np.ndarray:
    low = 8 if n > (1 << (bits - 8)) // 8 else 16
    size = n * low // 8
    lows = np.frombuffer(blob, np.uint8 if low == 8 else "<u2", n).astype(np.int64)
    high = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, offset=size), count=(1 << (bits - low)) + n)) - np.arange(n)
    return (high << low) + lows


def _flags(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _read_flags(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


_MESSAGE = "unit long, part long, n long, blob binary"


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["unit", "part", "n", "blob"])


def _cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    """The windows' cells in a row of the sketch; rows lie behind one another."""
    with np.errstate(over="ignore"):
        return (mix64(hashes + _U(row) * _U(0xD1342543DE82EF95)) & _U(width - 1)).astype(np.int64) + row * width


def _sketch(config: WindowConfig, width: int):
    """The sketches of the units, cut at the borders of the ranges that are merged apart."""

    def sketch(batches):
        for unit, sizes, blob in _rows(batches, "unit", "sizes", "blob"):
            hashes = _Text(sizes, blob, config.words).window_hashes()
            for row in range(config.depth):
                cells, counts = np.unique(_cells(hashes, row, width), return_counts=True)
                parts, firsts = np.unique(cells >> config.range_bits, return_index=True)
                found = []
                for part, lo, hi in zip(parts.tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(cells)]):
                    own = pack_cells(cells[lo:hi] & ((1 << config.range_bits) - 1), config.range_bits)
                    found.append((unit, part, hi - lo, _flags(counts[lo:hi] > 1) + own))
                if found:
                    yield _messages(found)

    return sketch


def _rows(batches, *names):
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(c)[i].as_py() for c in names)


def _merge(config: WindowConfig):
    """Adds up a range of the sketches of all units; replies which cells of each unit count two windows or more."""

    def merge(table: pa.Table) -> pa.Table:
        asked = list(_rows(table.to_batches(), "unit", "part", "n", "blob"))
        counters = np.zeros(1 << config.range_bits, np.uint8)
        for _, _, n, blob in asked:
            cells = unpack_cells(blob[(n + 7) // 8 :], n, config.range_bits)
            counters[cells] = np.minimum(counters[cells] + 1 + _read_flags(blob, n), 2)
        replies = [(unit, part, n, _flags(counters[unpack_cells(blob[(n + 7) // 8 :], n, config.range_bits)] > 1)) for unit, part, n, blob in asked]
        return pa.Table.from_batches([_messages(replies)])

    return merge


def _candidates(config: WindowConfig, width: int, parts: int):
    """Digests of the windows that every row of the sketch counts twice or more, and which windows these are."""

    def candidates(batches):
        for unit, sizes, blob, replies in _rows(batches, "unit", "sizes", "blob", "replies"):
            text = _Text(sizes, blob, config.words)
            hashes = text.window_hashes()
            bits = [(r["part"], _read_flags(r["blob"], r["n"])) for r in replies or []]
            which = np.arange(len(hashes))
            for row in range(config.depth):
                own = [b for p, b in bits if p // (width >> config.range_bits) == row]
                cells, inverse = np.unique(_cells(hashes, row, width), return_inverse=True)
                counted = np.concatenate(own) if own else np.zeros(0, bool)
                if len(counted) != len(cells):
                    raise ValueError(f"unit {unit}: {len(counted)} replies for {len(cells)} cells")
                which = which[counted[inverse[which]]]
            digests = text.digests(which)
            order = np.lexsort((digests[:, 1], digests[:, 0]))
            digests = digests[order]
            new = np.ones(len(order), bool)
            new[1:] = (digests[1:] != digests[:-1]).any(axis=1)
            rank = np.empty(len(order), np.int32)
            rank[order] = np.cumsum(new) - 1
            mask = np.zeros(len(hashes), bool)
            mask[which] = True
            firsts = np.flatnonzero(new)
            many = np.diff(np.append(firsts, len(order))) > 1
            digests = digests[firsts]
            yield _messages([(unit, -1, len(which), _pack(_flags(mask) + rank.tobytes()))])
            part = ((digests[:, 0] >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
            names, firsts = np.unique(part, return_index=True)
            found = [(unit, p, hi - lo, _flags(many[lo:hi]) + digests[lo:hi].tobytes()) for p, lo, hi in zip(names.tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(part)])]
            if found:
                yield _messages(found)

    return candidates


def _group(table: pa.Table) -> pa.Table:
    """Groups the digests of a part; replies which digests of each unit occur twice or more."""
    asked = list(_rows(table.to_batches(), "unit", "part", "n", "blob"))
    digests = np.concatenate([np.frombuffer(blob, _U, offset=(n + 7) // 8).reshape(-1, 2) for _, _, n, blob in asked])
    counts = np.concatenate([1 + _read_flags(blob, n) for _, _, n, blob in asked])
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (digests[order[1:]] != digests[order[:-1]]).any(axis=1)
    group = np.cumsum(new) - 1
    repeated = np.empty(len(order), bool)
    repeated[order] = (np.bincount(group, counts[order]) > 1)[group]
    ends = np.cumsum([n for _, _, n, _ in asked])
    return pa.Table.from_batches([_messages([(unit, part, n, _flags(repeated[end - n : end])) for (unit, part, n, _), end in zip(asked, ends.tolist())])])


def _cut(config: WindowConfig, id_col: str, id_type: pa.DataType):
    def cut(batches):
        for ids, sizes, blob, replies in _rows(batches, "ids", "sizes", "blob", "replies"):
            text = _Text(sizes, blob, config.words)
            n_windows, n_words = len(text.at), len(text.starts)
            state, *confirmed = replies
            raw = _unpack(state["blob"], (n_windows + 7) // 8 + 4 * state["n"])
            which = np.flatnonzero(_read_flags(raw, n_windows)) if n_windows else np.zeros(0, np.int64)
            rank = np.frombuffer(raw, np.int32, offset=(n_windows + 7) // 8)
            repeated = np.concatenate([_read_flags(r["blob"], r["n"]) for r in confirmed]) if confirmed else np.zeros(0, bool)
            first = text.at[which[repeated[rank]]]
            steps = np.bincount(first, minlength=n_words + 1) - np.bincount(first + config.words, minlength=n_words + 1)
            kept = np.cumsum(steps)[:n_words] == 0
            joined, place = text.joined()
            stay = np.repeat(kept, np.diff(place))
            # The last kept word of a text has no space after it.
            kept_words = np.flatnonzero(kept)
            owner = text.owner[kept_words]
            final = kept_words[np.flatnonzero(np.append(owner[1:] != owner[:-1], True))] if len(owner) else kept_words
            stay[place[final + 1] - 1] = False
            n = len(sizes)
            lengths = np.bincount(text.owner[kept_words], (np.diff(place))[kept_words], n).astype(np.int64) - (np.bincount(owner, minlength=n) > 0)
            words = np.bincount(text.owner, minlength=n)
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            out = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(joined[stay].tobytes())])
            removed = words - np.bincount(owner, minlength=n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), out.cast(pa.large_string()).cast(pa.string()), pa.array(words, pa.int64()), pa.array(removed, pa.int64())], names=[id_col, "kept", "n_words", "n_removed"])

    return cut


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: WindowConfig = WindowConfig()) -> DataFrame:
    """Removes every word that a window of 35 words covers whose word sequence starts anywhere else, too.

    Rows are gathered into units of 8 MB of text. Each unit sends a count-min
    sketch of its windows: two rows of at least four cells for each window of
    the corpus, so that the sketch grows with it. Ranges of cells are merged
    apart, each in a task of its own, and the merged counts, which are never
    too low, go back as one bit for each cell that a unit has sent. A second
    pass groups only the windows that both rows count twice or more, by a
    128-bit cryptographic digest of their words (digests, not texts, are
    compared). A unit sends a window once however often it has it, so the
    commonest passage costs a task no more than one entry per unit. Whole
    units, not windows, meet the replies again; nothing is broadcast.

    Returns one row per input row: identifier, kept (the remaining words
    joined by one space), n_words, n_removed. Windows are judged on the input
    and never cross texts. Null text has no words. Repeated rows are texts of
    their own, so they repeat each other. Other columns are ignored. A text
    is handled in one task, with about 25 times its size of memory.
    """
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    rows = numbered(docs, id_col, text_col, scratch)
    id_type = rows.schema["own_id"].dataType
    arrow_type = to_arrow_type(id_type)
    schema = f"unit long, windows long, ids array<{id_type.simpleString()}>, sizes array<long>, blob binary"
    units = scratch.save(rows.select("own_id", "id", "text").mapInArrow(_units(config, arrow_type), schema), "units")
    n_windows = units.agg(F.sum("windows")).first()[0] or 0
    width = 1 << max(config.range_bits, int(max(1, n_windows) * config.spread - 1).bit_length())
    parts = n_windows // config.part_windows + 1

    def with_replies(replies: DataFrame) -> DataFrame:
        gathered = replies.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("part", "n", "blob"))).alias("replies"))
        return units.join(gathered, "unit", "left")

    asked = units.select("unit", "sizes", "blob").mapInArrow(_sketch(config, width), _MESSAGE)
    replies = asked.groupBy("part").applyInArrow(_merge(config), _MESSAGE)
    found = scratch.save(with_replies(replies).select("unit", "sizes", "blob", "replies").mapInArrow(_candidates(config, width, parts), _MESSAGE), "candidates")
    confirmed = found.where("part >= 0").groupBy("part").applyInArrow(_group, _MESSAGE)
    cut = with_replies(found.where("part < 0").unionByName(confirmed)).select("ids", "sizes", "blob", "replies")
    return cut.mapInArrow(_cut(config, id_col, arrow_type), f"`{id_col}` {id_type.simpleString()}, kept string, n_words long, n_removed long")
