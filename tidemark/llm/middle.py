"""Fill-in-middle transformation by secondary sort."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import Scratch, numbered, slices, utf8

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Order of the parts in the output, and the place of each in the text.
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
PLACE = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
#: Units of one piece, and bytes of one Arrow batch.
PIECE_UNITS, BATCH_BYTES = 4096, 1 << 20
#: Pieces of one part that a place leaves room for.
_ROOM = 1 << 40


def _schema(id_type: str) -> str:
    return f"id long, at long, own_id {id_type}, form string, n long, prefix_chars long, middle_chars long, output_sha256 string, chunk binary"


class _Rows:
    """Rows of pieces, gathered into Arrow batches."""

    def __init__(self, id_type: pa.DataType):
        self.schema = pa.schema([("id", pa.int64()), ("at", pa.int64()), ("own_id", id_type), ("form", pa.string()), ("n", pa.int64()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("chunk", pa.binary())])
        self.rows, self.size = [], 0

    def head(self, row: int, meta: tuple, output_sha256: str | None = None) -> None:
        self.rows.append((row, -1, *meta, output_sha256, None))
        self.size += 100

    def piece(self, row: int, at: int, chunk: bytes) -> None:
        self.rows.append((row, at, None, None, None, None, None, None, chunk))
        self.size += 100 + len(chunk)

    def full(self) -> bool:
        return self.size >= BATCH_BYTES

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [()] * len(self.schema)
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the units of concatenated UTF-8 texts start: runs of ASCII letters, and every other code point."""
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    starts = (data & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    starts[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(starts)


def choose(own_id, n: int, text: bytes, seed: int, plain_percent: int, spm_percent: int) -> tuple[str, int, int]:
    """The form of a text of n units, and the units before the middle and before the suffix."""
    digest = hashlib.sha256(f"{seed}:{'' if own_id is None else own_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not n or any(x in text for x in PLACE) or h3 % 100 >= 100 - plain_percent:
        return "plain", 0, n
    return "spm" if h4 % 100 < spm_percent else "psm", min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))


def _cut(seed: int, plain_percent: int, spm_percent: int, id_type: pa.DataType):
    def cut(batches):
        out = _Rows(id_type)
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                data, offsets = utf8(part.column("text"))
                starts = unit_starts(data, offsets)
                firsts = np.searchsorted(starts, offsets)
                whole, points = data.tobytes(), (data & 0xC0) != 0x80
                for j, (own_id, row) in enumerate(zip(part.column("own_id").to_pylist(), part.column("id").to_pylist())):
                    # Byte positions of the units' borders.
                    borders = np.append(starts[firsts[j] : firsts[j + 1]], offsets[j + 1])
                    n = len(borders) - 1
                    form, a, b = choose(own_id, n, whole[offsets[j] : offsets[j + 1]], seed, plain_percent, spm_percent)
                    at = 0
                    if form == "plain":
                        out.head(row, (own_id, form, n, None, None))
                        parts = [(b"", 0, n)]
                    else:
                        chars = [int(np.count_nonzero(points[borders[lo] : borders[hi]])) for lo, hi in ((0, a), (a, b))]
                        out.head(row, (own_id, form, n, *chars))
                        spans = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, n)}
                        parts = [(mark, *spans[mark]) for mark in ORDERS[form]]
                    for mark, lo, hi in parts:
                        for k in range(lo, max(hi, lo + 1), PIECE_UNITS):
                            out.piece(row, at, (mark if k == lo else b"") + whole[borders[k] : borders[min(k + PIECE_UNITS, hi)]])
                            at += 1
                    if out.full():
                        yield out.batch()
        yield out.batch()

    return cut


def fim_pieces(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """Pieces of the outputs: a head per document (at = -1) and chunks of up to 4,096 units by output position."""
    rows = numbered(docs, id_col, text_col, scratch)
    id_type = rows.schema["own_id"].dataType
    return rows.mapInArrow(_cut(seed, plain_percent, spm_percent, to_arrow_type(id_type)), _schema(id_type.simpleString()))


def _documents(batches):
    """(row, fields of its head, chunks in order) of sorted pieces; the chunks are read as they are asked for."""

    def flat():
        for batch in batches:
            for part in slices(batch, "chunk", BATCH_BYTES):
                yield from zip(*(part.column(c).to_pylist() for c in ("id", "at", "own_id", "form", "n", "prefix_chars", "middle_chars", "output_sha256", "chunk")))

    pieces = flat()
    head = next(pieces, None)

    def chunks():
        nonlocal head
        for piece in pieces:
            if piece[1] < 0:
                head = piece
                return
            yield piece[-1]
        head = None

    while head is not None:
        yield head[0], head[2:8], chunks()


def _parts(form: str, chunks):
    """(place of its part, bytes) of the output's stream, cut at the marks that its form has."""
    if form == "plain":
        yield from ((0, x) for x in chunks)
        return
    marks, place, rest = list(ORDERS[form]), None, b""
    for chunk in chunks:
        rest += chunk
        while marks and (found := rest.find(marks[0])) >= 0:
            if place is not None:
                yield place, rest[:found]
            place, rest = PLACE[marks.pop(0)], rest[found + 3 :]
        # The last two bytes may belong to a mark that goes on in the next chunk.
        sure = len(rest) - 2 if marks else len(rest)
        if place is not None and sure > 0:
            yield place, rest[:sure]
            rest = rest[sure:]
    if place is not None:
        yield place, rest


def _assemble(id_type: pa.DataType):
    def assemble(batches):
        """Digests of the outputs, and their pieces cut anew at the marks, by position in the restored text."""
        out = _Rows(id_type)
        for row, (own_id, form, n, prefix_chars, middle_chars, _), chunks in _documents(batches):
            digest = hashlib.sha256()

            def hashed(chunks=chunks, digest=digest):
                for chunk in chunks:
                    digest.update(chunk)
                    yield chunk

            for k, (place, chunk) in enumerate(_parts(form, hashed())):
                out.piece(row, place * _ROOM + k, chunk)
                if out.full():
                    yield out.batch()
            out.head(row, (own_id, form, n, prefix_chars, middle_chars), digest.hexdigest())
        yield out.batch()

    return assemble


def _restore(id_col: str, id_type: pa.DataType):
    def restore(batches):
        names = [id_col, "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
        types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        found = []
        for _, (own_id, form, n, prefix_chars, middle_chars, output_sha256), chunks in _documents(batches):
            digest = hashlib.sha256()
            for chunk in chunks:
                digest.update(chunk)
            found.append((own_id, n, form, prefix_chars, middle_chars, output_sha256, digest.hexdigest()))
            if len(found) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)

    return restore


def fim_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """Digests of the fill-in-middle outputs and of the texts that are rebuilt from them.

    Pieces keyed by document and output position are dealt out by document and
    sorted within partitions; a task streams them into one digest at a time, so
    that no document is held whole. The same pass parses the output as it goes
    by, cutting it at its marks; the pieces found are sorted again within the
    partition, by their place in the restored text, and streamed into the
    second digest. Nothing but the output and its form reaches the restoration.

    Returns one row per input row: identifier, n, form, prefix_chars,
    middle_chars, output_sha256, restored_sha256. Null text counts as empty and
    is plain. A null identifier draws as empty text. Repeated rows are rows of
    their own; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "middle")
    pieces = fim_pieces(docs, id_col, text_col, scratch, seed, plain_percent, spm_percent)
    id_type = pieces.schema["own_id"].dataType
    dealt = pieces.repartition("id").sortWithinPartitions("id", "at")
    parsed = dealt.mapInArrow(_assemble(to_arrow_type(id_type)), _schema(id_type.simpleString())).sortWithinPartitions("id", "at")
    out = f"`{id_col}` {id_type.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return parsed.mapInArrow(_restore(id_col, to_arrow_type(id_type)), out)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """The outputs themselves: identifier, n, form, prefix_chars, middle_chars, output; rows as fim_digests has them."""
    pieces = fim_pieces(docs, id_col, text_col, Scratch(docs.sparkSession, "middle"), seed, plain_percent, spm_percent)
    id_type = pieces.schema["own_id"].dataType

    def join(batches):
        names = [id_col, "n", "form", "prefix_chars", "middle_chars", "output"]
        types = [to_arrow_type(id_type), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        found, size = [], 0
        for _, (own_id, form, n, prefix_chars, middle_chars, _), chunks in _documents(batches):
            output = b"".join(chunks)
            found.append((own_id, n, form, prefix_chars, middle_chars, output.decode()))
            size += len(output)
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)
                found, size = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)

    out = f"`{id_col}` {id_type.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"
    return pieces.repartition("id").sortWithinPartitions("id", "at").mapInArrow(join, out)


def restored(output, form):
    """The text of an output column, as an expression over it and its form."""
    text = F.when(form == "psm", F.regexp_replace(output, "(?s)^<P>(.*)<S>(.*)<M>(.*)$", "$1$3$2"))
    return text.when(form == "spm", F.regexp_replace(output, "(?s)^<S>(.*)<P>(.*)<M>(.*)$", "$2$3$1")).otherwise(output)
