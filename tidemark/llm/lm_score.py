"""Language model scores: a hashed maximum-entropy model with a class-factored softmax."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import Scratch, crc_mod, mix64, slices, utf8, word_hashes, word_spans

_U = np.uint64
#: Keys of the end token and of what is before a text; the low bits of a word's key are its class.
END, START = _U(0), _U(1 << 7)
_CLASS_BITS = _U((1 << 7) - 1)
_LOWER = np.array([x + 32 if 65 <= x <= 90 else x for x in range(256)], np.uint32)
_WORDS, _PAIRS, _TRIPLES, _STREAM, _CELLS = range(5)


@dataclass(frozen=True)
class LmConfig:
    """Sizes of the class softmax, which is bounded; the word n-grams' table grows with the corpus."""

    classes: int = 96  #: classes of tokens: the end, and words by a hash of their last two bytes; 127 at most
    rows: int = 1 << 14  #: hashed feature rows of the class softmax
    spare_bits: int = 3  #: hashed rows of word n-grams: two to this power per byte of text, at least
    rounds: int = 6  #: gradient updates of the class softmax
    rate: float = 0.5  #: of the first update
    shrink: float = 20.0  #: prior tokens per context of its starting weights
    steps: int = 4  #: gradient updates of the n-grams' prior weights in each unit
    unit_bytes: int = 8 << 20  #: text per unit
    part_bytes: int = 32 << 20  #: text whose n-grams one group of counts gets on average
    slice_bytes: int = 1 << 20


def tokens(data: np.ndarray, offsets: np.ndarray, config: LmConfig) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the tokens of concatenated texts, each text's end included, and the tokens of each text."""
    starts, ends, doc = word_spans(data, offsets)
    first = np.searchsorted(doc, np.arange(len(offsets)))
    if not len(starts):
        return np.full(len(offsets) - 1, END), np.ones(len(offsets) - 1, np.int64)
    tail = _LOWER[data[ends - 1]] * np.uint32(257) + np.where(ends - starts > 1, _LOWER[data[ends - 2]], np.uint32(0))
    own_class = (tail * np.uint32(2654435761) >> np.uint32(7)) % np.uint32(config.classes - 1) + 1
    keys = (word_hashes(data, starts, ends) & ~_CLASS_BITS) | own_class.astype(np.uint64)
    return np.insert(keys, first[1:], END), np.diff(first) + 1


def before(keys: np.ndarray, first: np.ndarray, steps: int = 1, start: np.uint64 = START) -> np.ndarray:
    """What is so many steps before each item; start where the text, whose first items are given, has no such item."""
    for _ in range(steps):
        keys = np.concatenate([np.full(1, start, keys.dtype), keys[:-1]])
        keys[first] = start
    return keys


def ngram_keys(keys: np.ndarray, first: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed rows of each token with the one before, and with the two before."""
    last, skip = before(keys, first), before(keys, first, 2)
    pair = mix64(last * _U(0x9E3779B97F4A7C15) + mix64(keys))
    triple = mix64(skip * _U(0xC2B2AE3D27D4EB4F) + pair)
    return pair >> _U(64 - bits), triple >> _U(64 - bits)


def grouped(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and each item's place among them; keys and places are sorted as one number each."""
    n = len(keys)
    if not n:
        return keys, np.zeros(0, np.int64)
    low = n.bit_length()
    cut = max(0, bits - (64 - low))
    packed = np.sort(((keys >> _U(cut)) << _U(low)) | np.arange(n, dtype=np.uint64))
    at = (packed & _U((1 << low) - 1)).astype(np.int64)
    packed >>= _U(low)
    new = np.concatenate([[True], packed[1:] != packed[:-1]])
    place = np.empty(n, np.int64)
    place[at] = np.cumsum(new) - 1
    distinct = keys[at[new]]
    if cut and (distinct[place] != keys).any():  # keys that differ in their last bits alone
        return np.unique(keys, return_inverse=True)
    return distinct, place


def _planes(x: np.ndarray) -> bytes:
    """The bytes of unsigned numbers, all lowest bytes first."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(x.astype(np.uint64)).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def pack(*columns: np.ndarray) -> bytes:
    raw = b"".join(map(_planes, columns))
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(blob: bytes, n: int) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    out, at = [], 0
    while at < len(raw):
        width = raw[at]
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(raw, np.uint8, width * n, at + 1).reshape(width, n).T
        out.append(wide.view(np.uint64)[:, 0])
        at += 1 + width * n
    return out


def pack_counts(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Keys in rising order, as differences, and their counts."""
    return pack(np.diff(keys, prepend=_U(0)) if len(keys) else keys, counts)


def unpack_counts(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    gaps, counts = unpack(blob, n)
    return np.cumsum(gaps, dtype=np.uint64), counts.astype(np.int64)


def by_count(n: np.ndarray) -> np.ndarray:
    """Places in order of falling counts. Tokens are written as ranks in it: most ranks are small and compress well."""
    return np.argsort(-n, kind="stable")


def chain(p: np.ndarray, pair: np.ndarray, last: np.ndarray, triple: np.ndarray, both: np.ndarray, strength: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities after the pair feature, and after the triple feature: (count + k * lower) / (context + k)."""
    q = (pair + strength[0] * p) / (last + strength[0])
    return q, (triple + strength[1] * q) / (both + strength[1])


def _fit_strengths(p, pair, last, triple, both, steps: int) -> np.ndarray:
    """Logs of the two prior weights that predict a unit's training tokens best, each left out of its own counts."""
    log_k = np.log(np.array([50.0, 2.0]))
    for step in range(steps):
        kb, kt = strength = np.exp(log_k).astype(np.float32)
        q, full = chain(p, pair, last, triple, both, strength)
        of_pair = kt / (both + kt) * kb * (p * last - pair) / (last + kb) ** 2 / full
        of_triple = kt * (q * both - triple) / (both + kt) ** 2 / full
        gradient = np.array([of_pair.mean(dtype=np.float64), of_triple.mean(dtype=np.float64)])
        log_k += gradient / (np.abs(gradient) + 0.01) / (1 + step)
    return log_k


def _gather(config: LmConfig, bits: int, id_type: pa.DataType):
    """Per unit of text: its tokens as numbers of its words, the words, and the strengths that suit its own counts."""
    schema = pa.schema(
        [("unit", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("blob", pa.binary()), ("n_words", pa.int64()), ("words", pa.binary()), ("log_k", pa.list_(pa.float64())),
         ("ids", pa.list_(id_type)), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64()))]
    )

    def row_of(unit: int, keys, sizes, held, ids, cells):
        first = np.cumsum(sizes) - sizes
        train = np.repeat(~held, sizes)
        k = config.classes
        own = (keys & _CLASS_BITS).astype(np.int64)
        context = before(own, first, 2, 0) * k + before(own, first, 1, 0)
        cells += np.bincount((context * k + own)[train], minlength=k**3)
        words, place = grouped(keys, 64)
        n = np.bincount(place, train, len(words)).astype(np.int64)
        rank = np.empty(len(words), np.int64)
        rank[by_count(n)] = np.arange(len(words))
        row = {"unit": unit, "kind": _STREAM, "n": len(keys), "blob": pack(rank[place]), "n_words": len(words), "words": pack_counts(words, n), "ids": ids, "held": held, "sizes": sizes}
        total = int(train.sum())
        if total:
            docs = np.float32((~held).sum())
            counts = [n[place].astype(np.int32)]
            for own_keys in ngram_keys(keys, first, bits):
                distinct, at = grouped(own_keys, bits)
                counts.append(np.bincount(at, train, len(distinct)).astype(np.int32)[at])
            one, two, three = ((c[train] - 1).astype(np.float32) for c in counts)
            last, both = (before(c.astype(np.float32), first, 1, docs)[train] - 1 for c in counts[:2])
            del counts
            log_k = _fit_strengths((one + 1) / np.float32(total + len(words)), two, last, three, both, config.steps)
            row["log_k"] = [float(total), *(log_k * total).tolist()]
        return row

    def gather(batches):
        cells = np.zeros(config.classes**3, np.int64)
        unit, parts, size = TaskContext.get().partitionId() << 32, [], 0

        def flush():
            keys, sizes, held = (np.concatenate([p[i] for p in parts]) for i in range(3))
            ids = [x for p in parts for x in p[3]]
            return pa.RecordBatch.from_pylist([row_of(unit, keys, sizes, held, ids, cells)], schema)

        for batch in batches:
            for part in slices(batch, "text", config.slice_bytes):
                data, offsets = utf8(part.column("text"))
                parts.append((*tokens(data, offsets, config), part.column("held_out").to_numpy(zero_copy_only=False), part.column("id").to_pylist()))
                size += len(data)
                if size >= config.unit_bytes:
                    yield flush()
                    unit, parts, size = unit + 1, [], 0
        if parts:
            yield flush()
        found = np.flatnonzero(cells)
        if len(found):
            yield pa.RecordBatch.from_pylist([{"unit": unit, "kind": _CELLS, "n": len(found), "blob": pack(found, cells[found])}], schema)

    return gather


class Unit:
    """A written unit: its texts, its tokens' keys, and its own words and counts."""

    def __init__(self, row: dict):
        self.number, self.ids, self.held, self.sizes = row["unit"], row["ids"], np.array(row["held"], bool), np.array(row["sizes"], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.train = np.repeat(~self.held, self.sizes)
        self.words, self.words_n = unpack_counts(row["words"], row["n_words"])
        self.place = by_count(self.words_n)[unpack(row["blob"], row["n"])[0].astype(np.int64)]
        self.keys = self.words[self.place]

    def ngrams(self, bits: int):
        """(kind, distinct keys, each token's place, own training counts) of the pairs and the triples."""
        for kind, keys in zip((_PAIRS, _TRIPLES), ngram_keys(self.keys, self.first, bits)):
            distinct, place = grouped(keys, bits)
            yield kind, distinct, place, np.bincount(place, self.train, len(distinct)).astype(np.int64)


_UNIT = ["unit", "n", "blob", "n_words", "words", "ids", "held", "sizes"]


def _requests(units: DataFrame, bits: int, n_parts: int, ngrams: bool) -> DataFrame:
    """(unit, kind, part, n, blob): the words of every unit, or its pairs and triples, by range of keys."""

    def requests(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                unit = Unit(batch.slice(row, 1).to_pylist()[0])
                rows = []
                for kind, distinct, n, own_bits in ((k, d, n, bits) for k, d, _, n in unit.ngrams(bits)) if ngrams else [(_WORDS, unit.words, unit.words_n, 64)]:
                    part = ((distinct >> _U(max(own_bits - 32, 0))) * _U(n_parts)) >> _U(min(own_bits, 32))
                    edge = np.flatnonzero(np.diff(part, prepend=_U(n_parts)))
                    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(part)]):
                        rows.append((unit.number, kind, int(part[a]) * 3 + kind, b - a, pack_counts(distinct[a:b], n[a:b])))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["unit", "kind", "part", "n", "blob"])

    return units.where(F.col("kind") == _STREAM).select(*_UNIT).mapInArrow(requests, "unit long, kind int, part long, n long, blob binary")


_REPLY = "unit long, kind int, part long, n long, blob binary, sizes array<long>, distinct array<long>"


def _elsewhere(classes: int):
    schema = pa.schema([("unit", pa.int64()), ("kind", pa.int32()), ("part", pa.int64()), ("n", pa.int64()), ("blob", pa.binary()), ("sizes", pa.list_(pa.int64())), ("distinct", pa.list_(pa.int64()))])

    def elsewhere(table: pa.Table) -> pa.Table:
        """For every request, the counts that other units have of its keys, in its order; of words, also the sizes of the classes.

        The keys need not travel back: a unit has them.
        """
        asked = [unpack_counts(b, n) for b, n in zip(table.column("blob").to_pylist(), table.column("n").to_pylist())]
        keys, own = [k for k, _ in asked], [n.astype(np.int32) for _, n in asked]
        del asked
        distinct = np.concatenate(keys)
        distinct.sort()
        distinct = distinct[np.concatenate([[True], distinct[1:] != distinct[:-1]])]
        places = []
        while keys:  # each request's keys go as its places come
            places.append(np.searchsorted(distinct, keys.pop(0)).astype(np.int32))
        total = np.zeros(len(distinct), np.int64)
        for n, at in zip(own, places):
            total[at] += n
        units, kinds, parts = (table.column(c).to_pylist() for c in ("unit", "kind", "part"))
        rows = [{"unit": u, "kind": k, "part": p, "n": len(n), "blob": pack(total[at] - n)} for u, k, p, n, at in zip(units, kinds, parts, own, places)]
        if kinds[0] == _WORDS:
            of = (distinct & _CLASS_BITS).astype(np.int64)
            rows.append({"kind": _CELLS, "sizes": np.bincount(of, total, classes).astype(np.int64).tolist(), "distinct": np.bincount(of[total > 0], minlength=classes).tolist()})
        return pa.Table.from_pylist(rows, schema)

    return elsewhere


def features(contexts: np.ndarray, config: LmConfig) -> np.ndarray:
    """Hashed rows of a context (class before last, last class): bias, bigram, skip and trigram."""
    c = _U(config.classes)
    skip, last = contexts.astype(np.uint64) // c, contexts.astype(np.uint64) % c
    keys = np.stack([np.zeros_like(last), last + _U(1 << 20), skip + _U(2 << 20), contexts.astype(np.uint64) + _U(3 << 20)], 1)
    return (mix64(keys + _U(0x9E3779B97F4A7C15)) % _U(config.rows)).astype(np.int64)


def log_softmax(logits: np.ndarray) -> np.ndarray:
    logits = logits - logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def train_classes(units: DataFrame, config: LmConfig, scratch: Scratch) -> np.ndarray:
    """log p(class | two classes before), fitted to all training tokens.

    Features depend on the context alone, so counts of the classes after each
    context carry the whole gradient. The weights start from shrunk log ratios
    and take gradient updates, each summed by feature row in Spark; the driver
    gets one sum a row.
    """
    k = config.classes

    def explode(batches):
        for batch in batches:
            for n, blob in zip(batch.column("n").to_pylist(), batch.column("blob").to_pylist()):
                cell, count = unpack(blob, n)
                yield pa.RecordBatch.from_arrays([pa.array((cell // _U(k)).astype(np.int32)), pa.array((cell % _U(k)).astype(np.int32)), pa.array(count.astype(np.int64))], names=["context", "class", "n"])

    cells = units.where(F.col("kind") == _CELLS).select("n", "blob").mapInArrow(explode, "context int, class int, n long")
    cells = cells.groupBy("context", "class").agg(F.sum("n").alias("n"))
    contexts = scratch.save(cells.groupBy("context").agg(F.collect_list(F.struct("class", "n")).alias("next")), "contexts")

    def dense(batch):
        counts = np.zeros((batch.num_rows, k))
        nexts = batch.column("next")
        who = np.repeat(np.arange(batch.num_rows), nexts.value_lengths().to_numpy(zero_copy_only=False))
        flat = nexts.flatten()
        counts[who, flat.field("class").to_numpy(zero_copy_only=False)] = flat.field("n").to_numpy(zero_copy_only=False)
        return batch.column("context").to_numpy(zero_copy_only=False), counts

    share = contexts.select(F.explode("next").alias("x")).groupBy("x.class").agg(F.sum("x.n").alias("n")).collect()  # a row per class
    prior = np.ones(k)
    for r in share:
        prior[r["class"]] += r["n"]
    prior /= prior.sum()

    def gradient(weights: np.ndarray | None):
        def sums(batches):
            total, size = np.zeros((config.rows, k)), np.zeros(config.rows)
            for batch in batches:
                context, counts = dense(batch)
                rows = features(context, config)
                n = counts.sum(axis=1, keepdims=True)
                if weights is None:
                    np.add.at(total, rows[:, 3], np.log((counts + config.shrink * prior) / (n + config.shrink)) - np.log(prior))
                    np.add.at(size, rows[:, 3], 1.0)
                    continue
                each = counts - n * np.exp(log_softmax(weights[rows].sum(axis=1)))
                for j in range(rows.shape[1]):
                    np.add.at(total, rows[:, j], each)
                    np.add.at(size, rows[:, j], n[:, 0])
            touched = np.flatnonzero(size)
            if len(touched):
                yield pa.RecordBatch.from_arrays([pa.array(touched, pa.int32()), pa.array(size[touched]), pa.array([total[i].tobytes() for i in touched], pa.binary())], names=["row", "size", "total"])

        def by_row(table: pa.Table) -> pa.Table:
            """Sums of the rows of one part of the table."""
            row = table.column("row").to_numpy()
            kept, place = np.unique(row, return_inverse=True)
            total = np.zeros((len(kept), k))
            np.add.at(total, place, np.stack([np.frombuffer(x, np.float64) for x in table.column("total").to_pylist()]))
            return pa.table({"row": kept, "size": np.bincount(place, table.column("size").to_numpy()), "total": pa.array([t.tobytes() for t in total], pa.binary())})

        total, size = np.zeros((config.rows, k)), np.zeros(config.rows)
        summed = contexts.mapInArrow(sums, "row int, size double, total binary").groupBy((F.col("row") % 64).alias("g")).applyInArrow(by_row, "row int, size double, total binary")
        for r in summed.toLocalIterator():  # config.rows rows at most
            total[r["row"]], size[r["row"]] = np.frombuffer(r["total"]), r["size"]
        return total, size

    weights = np.zeros((config.rows, k))
    total, size = gradient(None)
    weights += total / np.maximum(size, 1.0)[:, None]
    weights[features(np.zeros(1, np.int64), config)[0, 0]] += np.log(prior)
    for step in range(config.rounds):
        total, size = gradient(weights)
        weights += config.rate / (1 + step) / 4 * total / (np.maximum(size, 1.0)[:, None] * prior + config.shrink)
    every = np.arange(k * k)
    return np.concatenate([log_softmax(weights[features(part, config)].sum(axis=1)) for part in np.array_split(every, 16)])


@dataclass(frozen=True)
class LmModel:
    """What scoring needs beside the counts of words, pairs and triples."""

    total: int  #: training tokens
    distinct: int  #: distinct ones
    texts: int  #: training texts
    log_sizes: np.ndarray  #: of a class: log of its tokens, words and one for unknown ones
    log_class: np.ndarray  #: log probability of a class, by context
    strength: np.ndarray  #: prior weights of the pair and the triple feature


def fit_lm(units: DataFrame, n_parts: int, config: LmConfig, scratch: Scratch) -> tuple[LmModel, DataFrame]:
    """The model, and the written counts that other units have of every unit's words."""
    replies = scratch.save(_requests(units, 64, n_parts, False).groupBy("part").applyInArrow(_elsewhere(config.classes), _REPLY), "words")
    sizes = replies.where(F.col("kind") == _CELLS).select(F.posexplode(F.arrays_zip("sizes", "distinct")).alias("class", "x"))
    words = np.zeros((2, config.classes))
    for r in sizes.groupBy("class").agg(F.sum("x.sizes"), F.sum("x.distinct")).collect():  # a row per class
        words[:, r[0]] = r[1], r[2]
    total, distinct = (int(x) for x in words.sum(axis=1))
    w, kb, kt = (x or 0.0 for x in units.where("log_k IS NOT NULL").agg(*(F.sum(F.get("log_k", F.lit(i))) for i in range(3))).first())
    strength = np.exp(np.array([kb, kt]) / w) if w else np.array([50.0, 2.0])
    # Class 0 is the end token, once a text.
    return LmModel(total, distinct, int(words[0, 0]), np.log(words.sum(axis=0) + 1), train_classes(units, config, scratch), strength), replies.where(F.col("kind") == _WORDS)


def tokenised(docs: DataFrame, id_col: str, text_col: str, config: LmConfig, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """The written units of the rows, the bits of an n-gram's row, and the number of parts of the counts."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (crc_mod(id_col, 7) == 2).alias("held_out"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(44, max(30, int(n_bytes).bit_length() + config.spare_bits))
    n_parts = max(1, -(-n_bytes // config.part_bytes))
    id_type = rows.schema["id"].dataType
    schema = f"unit long, kind int, n long, blob binary, n_words long, words binary, log_k array<double>, ids array<{id_type.simpleString()}>, held array<boolean>, sizes array<long>"
    return scratch.save(rows.mapInArrow(_gather(config, bits, to_arrow_type(id_type)), schema), "units"), bits, n_parts


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: LmConfig = LmConfig()) -> DataFrame:
    """Scores of whole texts under a unigram base and a maximum-entropy model, both learnt from the training rows.

    The model is log-linear in hashed features. A softmax over classes of
    tokens has n-gram and skip features of the two classes before and is
    trained by gradient updates; a word within its class has its count plus
    one, and one unit is for unknown words. Features of the actual words, the
    pair with the word before and the triple with the two before, are hashed
    into rows whose number grows with the corpus; the weights of a feature and
    of its context are those that turn a lower probability p into
    (count + k p) / (context count + k), so that the model stays normalised
    without a sum over words. k is trained by gradient updates in every unit,
    over all training tokens, and averaged.

    Training rows have crc32(identifier as text) mod 7 other than 2. Texts are
    tokenised once, in units of about 8 MB, and written as numbers; a unit then
    asks for the counts that other units have of its words, pairs and triples,
    and is scored with numpy.

    Returns one row per input row: identifier, held_out, n_tokens, n_known,
    train_tokens, base_score, score. Null and empty texts have the end token
    only. A null identifier's text counts as empty for crc32. Without training
    rows all words are unknown. Repeated rows are scored (and learnt) each.
    Words are known by 64-bit keys (57 bits of a hash, and the class).
    """
    scratch = Scratch(docs.sparkSession, "lm")
    units, bits, n_parts = tokenised(docs, id_col, text_col, config, scratch)
    model, of_words = fit_lm(units, n_parts, config, scratch)
    id_type = docs.schema[id_col].dataType
    k, log_base = config.classes, np.log10(model.total + model.distinct + 1)

    def score(stream: pa.Table, found: pa.Table) -> pa.Table:
        unit = Unit(stream.to_pylist()[0])
        first = unit.first
        replies = {kind: [] for kind in (_WORDS, _PAIRS, _TRIPLES)}
        for kind, part, n, blob in zip(*(found.column(c).to_pylist() for c in ("kind", "part", "n", "blob"))):
            replies[kind].append((part, n, blob))

        def counts(kind, place, n):
            more = np.concatenate([unpack(blob, size)[0] for _, size, blob in sorted(replies.pop(kind))])
            return (n + more.astype(np.int64))[place]

        n = counts(_WORDS, unit.place, unit.words_n)
        pair, triple = (counts(kind, place, own) for kind, _, place, own in unit.ngrams(bits))
        own = (unit.keys & _CLASS_BITS).astype(np.int64)
        context = before(own, first, 2, 0) * k + before(own, first, 1, 0)
        p = np.exp(model.log_class[context, own] + np.log(n + 1) - model.log_sizes[own])
        _, p = chain(p, pair, before(n, first, 1, model.texts), triple, before(pair, first, 1, model.texts), model.strength)
        return pa.table(
            {
                id_col: pa.array(unit.ids, to_arrow_type(id_type)),
                "held_out": pa.array(unit.held),
                "n_tokens": pa.array(unit.sizes),
                "n_known": pa.array(np.add.reduceat(n > 0, first, dtype=np.int64)),
                "train_tokens": pa.array(np.full(len(first), model.total, np.int64)),
                "base_score": pa.array(np.add.reduceat(np.log10(n + 1) - log_base, first)),
                "score": pa.array(np.add.reduceat(np.log10(p), first)),
            }
        )

    asked = _requests(units, bits, n_parts, True).repartition(2 * n_parts, "part")
    elsewhere = asked.groupBy("part").applyInArrow(_elsewhere(config.classes), _REPLY).union(of_words).select("unit", "kind", "part", "n", "blob")
    streams = units.where(F.col("kind") == _STREAM).select(*_UNIT)
    out = f"`{id_col}` {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return streams.groupBy("unit").cogroup(elsewhere.groupBy("unit")).applyInArrow(score, out)
