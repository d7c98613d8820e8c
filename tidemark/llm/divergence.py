"""Source divergence audit: which terms set a source apart, and how far sources are from one another."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch


@dataclass(frozen=True)
class DivergenceConfig:
    min_docs: int = 10  #: documents of a language that have a kept term, at least
    top: int = 10  #: ranks of a group's terms
    flush: int = 250_000  #: counters that a task holds before it sends them
    part_terms: int = 1 << 14  #: kept terms for each part of the audit
    fan_in: int = 16  #: skybands merged at a time
    chunk: int = 1 << 20  #: bytes of a text that are cut into terms at a time


#: Lower-cases A-Z and makes every other ASCII byte but a-z a space.
_TERMS = bytes(c if c > 127 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"
_FOUND = "lang string, source string, item string, n long, total long, value long, part int"


def _terms(text: str, chunk: int):
    """Lists of the terms of a text."""
    data, start = text.encode().translate(_TERMS), 0
    while start < len(data):
        stop = data.find(b" ", start + chunk)
        stop = len(data) if stop < 0 else stop
        yield data[start:stop].split()
        start = stop


def _count(config: DivergenceConfig):
    """Counts of terms, and of the texts that have them, by language and source; a row without a term names each group."""

    def batch(lang, source, terms, n, docs):
        k = len(terms)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
            names=["lang", "source", "term", "n", "docs"],
        )

    def count(batches):
        groups: dict[tuple, tuple[Counter, Counter]] = {}
        held = 0

        def flush():
            for (lang, source), (n, docs) in groups.items():
                yield batch(lang, source, [None], [0], [0])
                if n:
                    yield batch(lang, source, list(n), list(n.values()), [docs[x] for x in n])

        for rows in batches:
            for lang, source, text in zip(*(rows.column(c).to_pylist() for c in ("lang", "source", "text"))):
                n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(n), set()
                for terms in _terms(text, config.chunk):
                    n.update(terms)
                    own.update(terms)
                docs.update(own)
                held += len(n) - before
                if held > config.flush:
                    yield from flush()
                    groups, held = {}, 0
        yield from flush()

    return count


def share(n: str, size: str, terms: str) -> Column:
    """1 + floor(10^9 (n + 2) / (size + 2 terms)) of columns, by long division, three digits at a time: exact below 9 * 10^15."""
    over = f"({size} + 2 * {terms})"
    digits, rest = f"(({n} + 2) div {over})", f"(({n} + 2) % {over})"
    for _ in range(3):
        digits, rest = f"({digits} * 1000 + {rest} * 1000 div {over})", f"({rest} * 1000 % {over})"
    return F.expr(f"1 + {digits}")


def shares(n: np.ndarray, size: np.ndarray, terms: int) -> np.ndarray:
    """share() over arrays."""
    over = size + 2 * terms
    digits, rest = np.divmod(n + 2, over)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, over)
        digits = digits * 1000 + step
    return 1 + digits


def skyband(n: np.ndarray, total: np.ndarray, k: int, block: int = 256) -> np.ndarray:
    """Numbers of the points, given in the order of their items, that fewer than k others dominate.

    An earlier point with no smaller n and no larger total dominates. A point
    that k dominate has k dominators in the skyband itself, so those found so
    far and the rest of the block are enough to compare with.
    """
    # Of points with one n and total, only the first k can stay.
    order = np.lexsort((total, n))
    new = np.ones(len(order), bool)
    new[1:] = (n[order[1:]] != n[order[:-1]]) | (total[order[1:]] != total[order[:-1]])
    firsts = np.flatnonzero(new)
    within = np.arange(len(order)) - np.repeat(firsts, np.diff(np.append(firsts, len(order))))
    points = np.sort(order[within < k])
    band = np.zeros(0, np.int64)
    for start in range(0, len(points), block):
        own = points[start : start + block]
        above = ((n[band] >= n[own, None]) & (total[band] <= total[own, None])).sum(axis=1)
        above += np.tril((n[own] >= n[own, None]) & (total[own] <= total[own, None]), -1).sum(axis=1)
        band = np.concatenate([band, own[above < k]])
    return band


def _found(lang: str, **columns) -> pa.Table:
    size = len(columns["source"])
    columns = {"n": pa.nulls(size, pa.int64()), "total": pa.nulls(size, pa.int64()), "value": pa.nulls(size, pa.int64())} | columns
    types = {"source": pa.string(), "item": pa.string(), "n": pa.int64(), "total": pa.int64(), "value": pa.int64(), "part": pa.int32()}
    return pa.table({"lang": pa.array([lang] * size, pa.string())} | {c: pa.array(columns[c], t) if not isinstance(columns[c], pa.Array | pa.ChunkedArray) else columns[c].cast(t) for c, t in types.items()})


def _audit(config: DivergenceConfig):
    """Of one part of a language's kept terms: each source's skyband, and the pairs' sums."""

    def audit(kept: pa.Table, groups: pa.Table) -> pa.Table:
        empty = _found("", source=[], item=[], part=[])
        if not kept.num_rows or not groups.num_rows:
            return empty
        kept = kept.take(pc.sort_indices(kept.column("term").cast(pa.binary()))).combine_chunks()
        groups = groups.take(pc.sort_indices(groups.column("source").cast(pa.binary()))).combine_chunks()
        lang, part = kept.column("lang")[0].as_py(), kept.column("part")[0].as_py()
        names, sizes = groups.column("source").combine_chunks(), groups.column("size").to_numpy()
        terms, lang_size = groups.column("terms")[0].as_py(), groups.column("lang_size")[0].as_py()
        # Terms in order, each with one row per source that has it.
        encoded = kept.column("term").combine_chunks().dictionary_encode()
        row, items = encoded.indices.to_numpy(), encoded.dictionary
        total = np.zeros(len(items), np.int64)
        total[row] = kept.column("total").to_numpy()
        source, n = pc.index_in(kept.column("source"), names).to_numpy(), kept.column("n").to_numpy()
        pairs = _pairs(lang, names, sizes, terms, len(items), row, source, n)
        out = []
        q = shares(total, np.int64(lang_size), terms)
        ahead = shares(n, sizes[source], terms) > q[row]
        row, source, n = row[ahead], source[ahead], n[ahead]
        order = np.lexsort((row, source))
        row, source, n = row[order], source[order], n[order]
        for s in np.unique(source).tolist():
            lo, hi = np.searchsorted(source, [s, s + 1])
            band = skyband(n[lo:hi], total[row[lo:hi]], config.top) + lo
            out.append(_found(lang, source=[names[s].as_py()] * len(band), item=items.take(pa.array(row[band])), n=n[band], total=total[row[band]], part=np.full(len(band), part)))
        return pa.concat_tables([*out, *pairs, empty])

    def _pairs(lang, names, sizes, terms, n_terms, rows, sources, n):
        k = len(sizes)
        sums = np.zeros((k, k), np.int64)
        step = max(1, (1 << 21) // k)
        for lo in range(0, n_terms, step):
            first, last = np.searchsorted(rows, [lo, lo + step])
            counts = np.zeros((min(step, n_terms - lo), k), np.int64)
            counts[rows[first:last] - lo, sources[first:last]] = n[first:last]
            p = np.ascontiguousarray(shares(counts, sizes, terms).T)
            for s in range(k - 1):
                apart = p[s + 1 :] - p[s]
                sums[s, s + 1 :] += (apart * apart // (p[s + 1 :] + p[s])).sum(axis=1)
        a, b = np.triu_indices(k, 1)
        if len(a):
            return [_found(lang, source=names.take(pa.array(a)), item=names.take(pa.array(b)), value=sums[a, b], part=np.full(len(a), -1))]
        return []

    return audit


def _merged(config: DivergenceConfig):
    """The skyband of the union of a source's skybands."""

    def merged(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table.column("item").cast(pa.binary())))
        band = skyband(table.column("n").to_numpy(), table.column("total").to_numpy(), config.top)
        return table.take(pa.array(band)).select(["lang", "source", "item", "n", "total", "part"])

    return merged


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str, config: DivergenceConfig) -> DataFrame:
    """(lang, source, term, n, docs), with a row without a term for every (lang, source)."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    return rows.mapInArrow(_count(config), _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def audit_sources(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", config: DivergenceConfig = DivergenceConfig()) -> DataFrame:
    """Divergence of every (lang, source) group from the other sources of its language, and the terms that it overuses.

    Terms are counted in tasks before they are shuffled. The kept terms of a
    language are cut into parts of about 16,384. In each part, a source keeps
    the skyband of its terms: those that fewer than ten others dominate by a
    group count no lower, a language count no higher and an earlier place in
    UTF-8. The value of a term rises with the group's count and falls with the
    language's, so no other term can be in the top ten, ties included.
    Skybands are merged 16 at a time, and what is left is ranked exactly. The
    same parts add up the pairs of sources; a pair is a row of the result.

    Returns lang, source, part (pair or term), item, value, rank. Null text,
    language and source count as empty. Repeated rows are documents of their
    own. A language without kept terms has pairs of value 0. Other columns are
    ignored. All arithmetic is exact up to 9 * 10^15 terms.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    counts = scratch.save(term_counts(docs, text_col, lang_col, source_col, config), "counts")
    found = counts.where("term IS NOT NULL")
    totals = found.groupBy("lang", "term").agg(F.sum("docs").alias("all_docs"), F.sum("n").alias("total")).where(F.col("all_docs") >= config.min_docs)
    totals = scratch.save(totals.select("lang", "term", "total"), "terms")
    kept = scratch.save(found.select("lang", "source", "term", "n").join(totals, ["lang", "term"]), "kept")
    # A row per language, and one per language and source.
    langs = totals.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_size"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = counts.where("term IS NULL").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = scratch.save(groups, "groups")

    parts = totals.count() // config.part_terms + 1
    dealt = kept.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))
    met = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = scratch.save(dealt.groupBy("lang", "part").cogroup(met.groupBy("lang", "part")).applyInArrow(_audit(config), _FOUND), "found")

    band = found.where("part >= 0").select("lang", "source", "item", "n", "total", "part")
    left = parts
    while left > 1:
        left = -(-left // config.fan_in)
        band = band.withColumn("part", F.floor(F.col("part") / config.fan_in).cast("int"))
        band = band.groupBy("lang", "source", "part").applyInArrow(_merged(config), "lang string, source string, item string, n long, total long, part int")
    apart = F.expr("(p - q) * (p - q) div (p + q)")
    terms = band.join(groups, ["lang", "source"]).select("lang", "source", "item", share("n", "size", "terms").alias("p"), share("total", "lang_size", "terms").alias("q"))
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", apart.alias("value"))

    sums = found.where("part < 0").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sums = sums.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "value").select("lang", "x.source", "x.item", "value")
    others = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source != item")
    pairs = others.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return terms.withColumn("rank", rank).where(F.col("rank") <= config.top).unionByName(pairs.withColumn("rank", rank))
