"""Quality classifier: attention-based multiple-instance learning over passages."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, mix64, slices, utf8, word_hashes, word_spans

#: Classes of bytes whose shares describe a passage.
_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\t\n\r\v\f", ".,;:", "!", "?", "|", "#$%&*", "\"'()-/"]
_BYTE_CLASS = np.full(256, len(_CLASSES), np.int64)
for _i, _chars in enumerate(_CLASSES):
    _BYTE_CLASS[list(_chars.encode())] = _i
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_BYTE_CLASS[128:192] = len(_CLASSES) + 1
_BYTE_CLASS[192:] = len(_CLASSES) + 2
_N_BYTES = len(_CLASSES) + 3
#: Further features: word length, share of words equal to the one before, share of distinct words, words, capitalised shares.
_N_SHAPE = _N_BYTES + 5
#: Hashed features of a passage's words and word pairs.
_N_HASHED = 256
N_FEATURES = _N_SHAPE + _N_HASHED


@dataclass(frozen=True)
class QualityConfig:
    passage_words: int = 64
    sample_docs: int = 6000  #: labelled documents to learn from, at most
    sample_passages: int = 16  #: passages of each of them, at most, evenly spaced over the whole text
    hidden: int = 16
    epochs: int = 150
    rate: float = 0.02
    decay: float = 1e-3
    hashed_scale: float = 10.0
    threshold: float = 0.3
    seed: int = 11
    slice_bytes: int = 1 << 20


def encode_passages(data: np.ndarray, offsets: np.ndarray, passage_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of the texts, and the first passage of each text (with the total at the end).

    Words and pairs of neighbouring words of a passage are hashed with a sign
    into 256 sums, scaled by the root of their number; further features are
    shares of byte classes and word statistics. A passage is passage_words consecutive words with the white space that
    follows them; a text without words is one passage.
    """
    n_docs = len(offsets) - 1
    starts, ends, doc = word_spans(data, offsets)
    first_word = np.searchsorted(doc, np.arange(n_docs + 1))
    n_words = np.diff(first_word)
    n_passages = np.maximum(1, -(-n_words // passage_words))
    first = np.concatenate([[0], np.cumsum(n_passages)])
    total = int(first[-1])
    passage = first[doc] + (np.arange(len(starts)) - first_word[doc]) // passage_words
    begins = np.zeros(total, np.int64)
    begins[first[:-1]] = offsets[:-1]
    opening = np.flatnonzero(np.diff(passage, prepend=-1))
    inner = opening[~np.isin(passage[opening], first[:-1], assume_unique=True)] if len(opening) else opening
    begins[passage[inner]] = starts[inner]
    lengths = np.diff(np.append(begins, len(data)))
    of_byte = np.repeat(np.arange(total), lengths)
    x = np.zeros((total, N_FEATURES), np.float64)
    shares = np.bincount(of_byte * _N_BYTES + _BYTE_CLASS[data], minlength=total * _N_BYTES).reshape(total, _N_BYTES)
    x[:, :_N_BYTES] = shares / np.maximum(lengths, 1)[:, None]
    words = np.bincount(passage, minlength=total)
    per_word = np.maximum(words, 1)
    hashes = word_hashes(data, starts, ends)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
    order = np.lexsort((hashes, passage))
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    capital = (data[starts] >= 65) & (data[starts] <= 90) if len(starts) else np.zeros(0, bool)
    x[:, _N_BYTES] = np.bincount(passage, ends - starts, total) / per_word / 10
    x[:, _N_BYTES + 1] = np.bincount(passage, again, total) / per_word
    x[:, _N_BYTES + 2] = np.bincount(passage[order], new, total) / per_word
    x[:, _N_BYTES + 3] = np.log1p(words) / 4
    x[:, _N_BYTES + 4] = np.bincount(passage, capital, total) / per_word
    pairs = mix64(hashes[:-1] * _PAIR + hashes[1:])[passage[1:] == passage[:-1]] if len(hashes) else hashes
    inside = passage[1:][passage[1:] == passage[:-1]] if len(hashes) else passage
    every = np.concatenate([hashes, pairs])
    cell = np.concatenate([passage, inside]) * _N_HASHED + (every >> np.uint64(56)).astype(np.int64)
    sign = 1.0 - 2.0 * (every & np.uint64(1)).astype(np.float64)
    x[:, _N_SHAPE:] = np.bincount(cell, sign, total * _N_HASHED).reshape(total, _N_HASHED) / np.sqrt(per_word)[:, None]
    return x.astype(np.float32), first


class GatedAttention:
    """Passage encoder, gated attention over a text's passages, and a logistic score of the weighted passage."""

    def __init__(self, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {"W": draw(N_FEATURES, hidden), "b": np.zeros(hidden), "V": draw(hidden, hidden), "U": draw(hidden, hidden), "a": draw(hidden, 1), "w": draw(hidden, 1), "c": np.zeros(1)}

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        return self._attend((x - self.mean.astype(np.float32)) / self.scale.astype(np.float32), first)

    def _attend(self, z: np.ndarray, first: np.ndarray) -> dict:
        p, begin, n = self.p, first[:-1], np.diff(first)
        h = np.tanh(z @ p["W"].astype(np.float32) + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, begin), n, axis=0))
        share = e / np.repeat(np.add.reduceat(e, begin), n, axis=0)
        bag = np.add.reduceat(share * h, begin)
        return {"z": z, "h": h, "t": t, "g": g, "share": share, "bag": bag, "score": 1 / (1 + np.exp(-np.clip(bag @ p["w"] + p["c"], -30, 30)))[:, 0]}

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, config: QualityConfig) -> None:
        """Full-batch Adam on the log loss; x is normalised in place."""
        self.mean = x.mean(0, dtype=np.float64)
        x -= self.mean.astype(np.float32)
        self.scale = np.sqrt(np.einsum("ij,ij->j", x, x) / len(x)).astype(np.float64) + 1e-3
        n, p = np.diff(first), self.p
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
        # A single hashed sum is to count less than a statistic of the whole passage.
        self.scale[_N_SHAPE:] *= config.hashed_scale
        x /= self.scale.astype(np.float32)
        for step in range(1, config.epochs + 1):
            f = self._attend(x, first)
            d = ((f["score"] - y) / len(y))[:, None]
            grad = {"w": f["bag"].T @ d, "c": d.sum(0)}
            d_bag = np.repeat(d @ p["w"].T, n, axis=0)
            d_share = (d_bag * f["h"]).sum(1, keepdims=True)
            centre = np.repeat(np.add.reduceat(d_share * f["share"], first[:-1]), n, axis=0)
            d_e = f["share"] * (d_share - centre)
            grad["a"] = (f["t"] * f["g"]).T @ d_e
            d_tg = d_e @ p["a"].T
            d_t, d_g = d_tg * f["g"] * (1 - f["t"] ** 2), d_tg * f["t"] * f["g"] * (1 - f["g"])
            grad["V"], grad["U"] = f["h"].T @ d_t, f["h"].T @ d_g
            d_h = (d_bag * f["share"] + d_t @ p["V"].T + d_g @ p["U"].T) * (1 - f["h"] ** 2)
            grad["W"], grad["b"] = f["z"].T @ d_h.astype(np.float32), d_h.sum(0)
            for k, g in grad.items():
                m, v = moments[k]
                g = g + config.decay * p[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p[k] -= config.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, config: QualityConfig) -> GatedAttention:
    """A model of label_col, learnt from at most config.sample_docs labelled rows outside the held-out fold.

    The sample is the identifiers of least hash, so reruns agree; of several
    rows of one, the least text counts, with the greatest label. Passages are
    encoded in the tasks, and the driver gets the features of
    config.sample_passages of each text at most.
    """
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(id_col, 5) != 0))
    chosen = chosen.groupBy(F.col(id_col).alias("chosen")).agg(F.max(label_col).alias("label")).orderBy(F.xxhash64("chosen"), "chosen").limit(config.sample_docs)
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), F.col(id_col) == F.col("chosen"))
    rows = rows.groupBy("chosen").agg(F.min(F.coalesce(text_col, F.lit(""))).alias(text_col), F.max("label").alias("label"))
    rows = rows.select(F.col("chosen").cast("string").alias("id"), text_col, F.col("label").cast("double").alias("label"))

    def encode(batches):
        for batch in batches:
            for part in slices(batch, text_col, config.slice_bytes):
                x, first = encode_passages(*utf8(part.column(text_col)), config.passage_words)
                bags = [x[a + np.arange(min(b - a, config.sample_passages)) * (b - a) // min(b - a, config.sample_passages)].tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array(bags, pa.binary())], names=["id", "label", "x"])

    found = sorted(rows.mapInArrow(encode, "id string, label double, x binary").collect(), key=lambda r: r["id"])  # config.sample_docs at most
    model = GatedAttention(config.hidden, config.seed)
    if found:
        first = np.cumsum([0, *(len(r["x"]) // (4 * N_FEATURES) for r in found)])
        labels = np.array([r["label"] for r in found])
        x = np.empty((first[-1], N_FEATURES), np.float32)
        for i in range(len(found)):
            x[first[i] : first[i + 1]] = np.frombuffer(found[i]["x"], np.float32).reshape(-1, N_FEATURES)
            found[i] = None  # each bag is freed as it is copied
        model.fit(x, first, labels, config)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", config: QualityConfig = QualityConfig()) -> DataFrame:
    """Probability that a document is of good quality, from its whole text alone.

    Every passage of 64 words is encoded; gated attention, learnt from
    document labels, weighs the passages; the weighted passage is scored.
    Labels are learnt from a sample of config.sample_docs rows at most, none
    of them with crc32(identifier as text) mod 5 equal to 0.

    Returns one row per input row: identifier, held_out, score, predicted
    (1 if score >= config.threshold). Null and empty texts are one passage
    without words. Without labels the score is that of an unfitted model.
    """
    model = fit_quality(docs, labels, id_col, text_col, label_col, config)
    id_type = docs.schema[id_col].dataType.simpleString()

    def score(batches):
        for batch in batches:
            for part in slices(batch, text_col, config.slice_bytes):
                found = model.forward(*encode_passages(*utf8(part.column(text_col)), config.passage_words))["score"]
                yield pa.RecordBatch.from_arrays([part.column(id_col), part.column("held_out"), pa.array(found, pa.float64()), pa.array(found >= config.threshold).cast(pa.int32())], names=[id_col, "held_out", "score", "predicted"])

    return docs.select(id_col, text_col, (crc_mod(id_col, 5) == 0).alias("held_out")).mapInArrow(score, f"`{id_col}` {id_type}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: QualityConfig = QualityConfig()) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier does not reject."""
    model = fit_quality(docs, labels, id_col, text_col, "quality", config)

    def keep(batches):
        for batch in batches:
            for part in slices(batch, text_col, config.slice_bytes):
                found = model.forward(*encode_passages(*utf8(part.column(text_col)), config.passage_words))["score"]
                yield part.filter(pa.array(found >= config.threshold))

    return docs.mapInArrow(keep, docs.schema)
