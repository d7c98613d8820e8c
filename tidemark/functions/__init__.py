"""Column functions whose null, tie and boundary rules differ from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def latest(value, order, *ties) -> Column:
    """Value at the greatest order among rows whose value isn't null; equal orders go by ties, then by value."""
    value = _col(value)
    key = F.struct(_col(order), *map(_col, ties), value)
    return F.max_by(value, F.when(value.isNotNull() & _col(order).isNotNull(), key))


def earliest(value, order, *ties) -> Column:
    """Value at the least order among rows whose value isn't null; equal orders go by ties, then by value."""
    value = _col(value)
    key = F.struct(_col(order), *map(_col, ties), value)
    return F.min_by(value, F.when(value.isNotNull() & _col(order).isNotNull(), key))


def some(value) -> Column:
    """Any value that isn't null; the least, so that reruns agree."""
    return F.min(_col(value))


def seconds_between(start, end) -> Column:
    """Second boundaries crossed from start to end."""
    return F.unix_timestamp(_col(end).cast("timestamp")) - F.unix_timestamp(_col(start).cast("timestamp"))


def hours_since(origin: str, at) -> Column:
    """Hours from a fixed time to a timestamp, with microseconds; the session time zone must be UTC."""
    return (F.unix_micros(_col(at).cast("timestamp")) - F.unix_micros(F.lit(origin).cast("timestamp"))) / F.lit(3.6e9)


def strict_double(text) -> Column:
    """The number that a text is, else null: no type suffix, no digit separator, no infinity or NaN."""
    text = F.trim(_col(text))
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))


def ratio(num, den) -> Column:
    """num / den for a positive den, else null."""
    return F.when(_col(den) > 0, _col(num) / _col(den))


def clip(x, low: float, high: float) -> Column:
    return F.when(_col(x).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), _col(x))))


def logit(p, eps: float = 1e-6) -> Column:
    p = clip(p, eps, 1 - eps)
    return F.log(p / (1 - p))


def expit(x) -> Column:
    return 1 / (1 + F.exp(-_col(x)))


def finite(x) -> Column:
    """Null for NaN and infinities."""
    x = _col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def hash_fold(value, seed: int, n: int) -> Column:
    """The first 16 hex digits of SHA-256 of ``seed|value``, as an unsigned number modulo n."""
    digest = F.sha2(F.concat(F.lit(f"{seed}|"), _col(value).cast("string")), 256)
    number = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    return (number % F.lit(n)).cast("int")


def ordinal_level(text, rules: list[tuple[str, int]], default: int | None = None) -> Column:
    """Level of the first pattern that a text (lower case, trimmed) matches, in the order of the rules."""
    text = F.lower(F.trim(_col(text)))
    found = F.lit(default).cast("int")
    for pattern, level in reversed(rules):
        found = F.when(text.rlike(pattern), F.lit(level)).otherwise(found)
    return found


def pattern_of(text) -> Column:
    """A text with every run of digits as ``#``, to count the shapes of a free-text field."""
    return F.regexp_replace(F.lower(F.trim(_col(text))), r"[0-9]+", "#")


def distinct_list(value, separator: str = ",") -> Column:
    """The distinct values that aren't null, sorted, as one text."""
    return F.array_join(F.array_sort(F.collect_set(_col(value).cast("string"))), separator)


def quantiles(x, *qs: float) -> Column:
    """Exact quantiles, interpolated between neighbours."""
    return F.percentile(_col(x), F.array(*(F.lit(q) for q in qs)))
