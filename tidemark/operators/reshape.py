"""Filters, dictionaries and reshapes between long and wide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within_bounds(df: DataFrame, bounds: DataFrame, variable: str = "variable", value: str = "value") -> DataFrame:
    """Rows whose value lies in its variable's range.

    bounds: (variable, lo, hi, lo_closed, hi_closed), a dictionary of one row
    per variable; a null end is open. Variables without a row are dropped.
    """
    b = bounds.select(F.col("variable").alias("__variable"), "lo", "hi", "lo_closed", "hi_closed")
    v = F.col(value)
    low = F.col("lo").isNull() | (v > F.col("lo")) | (F.col("lo_closed") & (v == F.col("lo")))
    high = F.col("hi").isNull() | (v < F.col("hi")) | (F.col("hi_closed") & (v == F.col("hi")))
    return df.join(b, df[variable] == b["__variable"]).where(low & high).select(*df.columns)


def renamed(df: DataFrame, dictionary: DataFrame, code: str, to: str) -> DataFrame:
    """Rows whose code is in the dictionary (code, name), with its name as column ``to``."""
    d = dictionary.select(F.col("code").alias("__code"), F.col("name").alias(to))
    return df.join(d, df[code] == d["__code"]).drop("__code")


def unpivot(df: DataFrame, keys: list[str], values: dict[str, str | Column], variable: str = "variable", value: str = "value", keep_null: bool = False) -> DataFrame:
    """A row per key and named value; values are columns or expressions of one type."""
    cells = [F.struct(F.lit(n).alias(variable), (F.col(c) if isinstance(c, str) else c).alias(value)) for n, c in values.items()]
    long = df.select(*keys, F.explode(F.array(*cells)).alias("cell")).select(*keys, f"cell.{variable}", f"cell.{value}")
    return long if keep_null else long.where(F.col(value).isNotNull())


def stacked(df: DataFrame, keys: list[str], columns: list[str], value: str = "value") -> DataFrame:
    """A row per key and column, without the column's name; nulls are dropped."""
    return df.select(*keys, F.explode(F.array(*columns)).alias(value)).where(F.col(value).isNotNull())


def domains(df: DataFrame, keys: list[str], rules: dict[str, Column], domain: str = "domain") -> DataFrame:
    """A row per key and domain whose condition holds."""
    hits = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))
    return df.select(*keys, F.explode(hits).alias(domain))


def widen(df: DataFrame, keys: list[str], variable: str, names: list[str], stats: dict[str, str]) -> DataFrame:
    """Columns ``{name}_{stat}`` for every named variable; stats maps the suffix to its column.

    The names are given, so no job has to find them. Keys must be unique with
    the variable; the first value that isn't null is taken.
    """
    wide = df.groupBy(*keys).pivot(variable, names).agg(*(F.first(c, ignorenulls=True).alias(s) for s, c in stats.items()))
    if len(stats) > 1:
        return wide
    suffix = next(iter(stats))
    return wide.withColumnsRenamed({n: f"{n}_{suffix}" for n in names})


def widen_models(df: DataFrame, keys: list[str], models: list[str], value: str, differences: list[tuple[str, str]] = ()) -> DataFrame:
    """A column of value per model, and a column ``{a}_minus_{b}`` per pair."""
    wide = df.groupBy(*keys).pivot("model_id", models).agg(F.first(value, ignorenulls=True))
    return wide.withColumns({f"{a}_minus_{b}": F.col(a) - F.col(b) for a, b in differences}) if differences else wide


def fahrenheit_to_celsius(value: str, unit: str) -> Column:
    """Celsius where the unit says Fahrenheit, or where it says nothing and the number can't be Celsius."""
    u = F.lower(F.trim(F.coalesce(F.col(unit), F.lit(""))))
    is_f = u.rlike(r"^(f|fahrenheit|°f|deg f)$") | ((u == "") & (F.col(value) > 60))
    return F.when(is_f, (F.col(value) - 32) * 5 / 9).otherwise(F.col(value))
