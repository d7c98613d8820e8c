"""Coverage reports, assertions and audits."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.functions import strict_double
from tidemark.operators import joins
from tidemark.operators.ranks import exact_quantiles
from tidemark.sources import filled_schema, work_path
from tidemark.spec import KEYS, WindowSpec


def domain_hits(sources: dict[str, DataFrame], spine: DataFrame, spec: WindowSpec) -> DataFrame:
    """Distinct (keys, domain) with at least one record (entity_key, offset_h) in the window."""
    parts = [joins.expand(df.select("entity_key", "offset_h"), spec).select(*KEYS, F.lit(d).alias("domain")) for d, df in sources.items()]
    return reduce(DataFrame.unionByName, parts).distinct().join(spine.select(*KEYS), KEYS, "left_semi")


def coverage(hits: DataFrame, spine: DataFrame, domains: DataFrame, by: list[str] = ()) -> DataFrame:
    """Share of candidates with a hit per landmark (and site) and domain; pairs without a hit count as 0."""
    groups = ["landmark_h", *by]
    base = spine.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    counted = hits.join(spine.select(*KEYS, *by), KEYS).groupBy(*groups, "domain").agg(F.count(F.lit(1)).alias("hits"))
    return joins.complete(base, domains, counted, [*groups, "domain"], "hits").withColumn("coverage", F.col("hits") / F.col("n"))


def coverage_by_site(covered: DataFrame) -> DataFrame:
    """Distribution of the sites' coverage per landmark and domain."""
    q = F.percentile("coverage", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return covered.groupBy("landmark_h", "domain").agg(
        q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"), F.count_if(F.col("coverage") >= 0.5).alias("sites_at_half"), F.count_if(F.col("coverage") == 0).alias("sites_at_zero")
    )


def check(df: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(assertion, passed, detail) of aggregate rules {name: (condition, detail)}, in one pass over df."""
    cells = []
    aggs = []
    for i, (name, (condition, detail)) in enumerate(rules.items()):
        aggs += [condition.alias(f"c{i}"), detail.cast("string").alias(f"d{i}")]
        cells.append(F.struct(F.lit(name).alias("assertion"), F.coalesce(F.col(f"c{i}"), F.lit(False)).alias("passed"), F.col(f"d{i}").alias("detail")))
    return df.agg(*aggs).select(F.explode(F.array(*cells)).alias("a")).select("a.*")


def checked_write(df: DataFrame, name: str, rules: dict[str, tuple[Column, Column]]) -> tuple[DataFrame, DataFrame]:
    """df, written to the shared folder, and the assertions of check(), observed in the pass that writes it.

    No rule costs a scan of its own; the assertions are a row per rule.
    """
    spark, seen, path = df.sparkSession, Observation(f"{name}-{uuid.uuid4().hex}"), work_path(df.sparkSession, name)
    aggs = [c.alias(f"{kind}{i}") for i, (condition, detail) in enumerate(rules.values()) for kind, c in (("c", condition), ("d", detail.cast("string")))]
    df.observe(seen, *aggs).write.option("compression", "zstd").parquet(path)
    found = [(rule, bool(seen.get[f"c{i}"]), seen.get[f"d{i}"]) for i, rule in enumerate(rules)]
    return spark.read.schema(df.schema).parquet(path), spark.createDataFrame(found, "assertion string, passed boolean, detail string")


def gate_rules(floors: list[tuple[str, float]], value: str) -> dict[str, tuple[Column, Column]]:
    """Rules for check() and checked_write(): a variable's share of rows with a value reaches its floor."""
    rules = {}
    for variable, floor in floors:
        share = F.coalesce(F.avg(F.when(F.col("variable") == variable, F.col(value).isNotNull().cast("int"))), F.lit(0.0))
        rules[f"coverage of {variable}"] = (share >= floor, F.round(share, 6))
    return rules


def unique_keys(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """An assertion that no key is repeated; keys with null parts count."""
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return check(grouped, {name: (F.coalesce(F.max("n"), F.lit(1)) == 1, F.concat(F.coalesce(F.sum("n"), F.lit(0)).cast("string"), F.lit(" rows"))),})


def no_orphans(df: DataFrame, parent: DataFrame, keys: list[str], name: str) -> DataFrame:
    lost = df.join(parent.select(*keys).distinct(), keys, "left_anti")
    return check(lost, {name: (F.count(F.lit(1)) == 0, F.concat(F.count(F.lit(1)).cast("string"), F.lit(" orphans")))})


def reconcile(counts: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """An assertion per expected (keys, n): the count is as locked."""
    e = expected.withColumnRenamed("n", "expected")
    return e.join(counts, keys, "left").select(
        F.concat_ws("/", *keys).alias("assertion"), F.coalesce(F.col("n") == F.col("expected"), F.lit(False)).alias("passed"), F.concat(F.coalesce(F.col("n"), F.lit(0)).cast("string"), F.lit(" of "), F.col("expected").cast("string")).alias("detail")
    )


def enforce(assertions: DataFrame) -> DataFrame:
    """The assertions; reading a failed one stops the job."""
    said = F.concat(F.lit("assertion failed: "), F.col("assertion"), F.lit(" ("), F.coalesce("detail", F.lit("")), F.lit(")"))
    return assertions.withColumn("passed", F.when(F.col("passed"), F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))


def value_catalog(df: DataFrame, value: str, entity: str, site: str, top: int = 500) -> DataFrame:
    """The commonest values, with rows, entities and sites."""
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(entity).alias("n_entities"), F.count_distinct(site).alias("n_sites")).orderBy(F.desc("n_rows"), value).limit(top)


def numeric_profile(df: DataFrame, text: str, by: list[str]) -> DataFrame:
    """Shape of a numeric field that is stored as text, per group (a null is a group); quantiles are exact, and no group is sorted in one task."""
    # A struct with null fields equals its like, so null groups keep their quantiles through joins.
    parsed = df.withColumns({"__x": strict_double(text), "__key": F.struct(F.lit(0), *by)})
    shape = parsed.groupBy(*by, "__key").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.col("__x").isNotNull().cast("int")).alias("parsed_share"),
        F.min("__x").alias("min"),
        F.max("__x").alias("max"),
    )
    levels = exact_quantiles(parsed.select("__key", "__x"), ["__key"], "__x", [0.5, 0.99])
    at = lambda i: F.get("quantiles", F.lit(i))
    return shape.join(levels, "__key", "left").select(*by, "n_rows", "parsed_share", "min", at(0).alias("median"), at(1).alias("p99"), "max")


def feature_summary(features: DataFrame) -> DataFrame:
    return features.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("entity_key").alias("n_entities"),
        F.median("measurement_count").alias("median_measurements"),
        F.median("nonempty_bin_count").alias("median_bins"),
        F.avg(F.col("theilsen_slope").isNotNull().cast("int")).alias("slope_share"),
    )


def period_counts(df: DataFrame, period: str) -> DataFrame:
    return df.groupBy(period).agg(F.count_distinct("cluster_key").alias("n_clusters"), F.count_distinct("entity_key").alias("n_entities"), F.count(F.lit(1)).alias("n_rows"))


def schema_guard(df: DataFrame, prohibited: str, allowed: list[str] = ()) -> DataFrame:
    """Columns whose names say that they hold what a model must not see, with the rows in which they do (n_values); empty if the table is clean."""
    return filled_schema(df).where(F.col("name").rlike(prohibited) & ~F.col("name").isin(*allowed))


def group_leakage(df: DataFrame, group: str, fold: str) -> DataFrame:
    """Groups that are in several folds; empty if there is no leak."""
    return df.groupBy(group).agg(F.count_distinct(fold).alias("n_folds")).where("n_folds > 1")


def max_abs_diff(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Largest difference of a value between two keyed tables, and the rows that only one has."""
    x, y = a.select(*keys, F.col(value).alias("__a")), b.select(*keys, F.col(value).alias("__b"))
    both = x.withColumn("__in_a", F.lit(1)).join(y.withColumn("__in_b", F.lit(1)), keys, "full")
    return both.agg(F.max(F.abs(F.col("__a") - F.col("__b"))).alias("max_abs_diff"), F.count_if(F.col("__in_a").isNull() | F.col("__in_b").isNull()).alias("unmatched"))


def prediction_rules(score: str = "probability") -> dict[str, tuple[Column, Column]]:
    p = F.col(score)
    return {
        "no missing score": (F.count_if(p.isNull()) == 0, F.count_if(p.isNull())),
        "scores lie in [0, 1]": (F.count_if((p < 0) | (p > 1)) == 0, F.count_if((p < 0) | (p > 1))),
    }


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing rows and their percentage per column, in one pass."""
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("n_missing"), (100.0 * F.col(f"m{i}") / F.col("n")).alias("pct_missing")) for i, c in enumerate(columns)))
    counted = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(columns)))
    return counted.select(F.explode(cells).alias("c")).select("c.*")


def constant_groups(df: DataFrame, group: str, flags: list[str]) -> DataFrame:
    """Groups in which every flag is the same on all rows, with its value."""
    stats = df.groupBy(group).agg(*(f(F.col(c).cast("int")).alias(f"{c}_{n}") for c in flags for n, f in (("min", F.min), ("max", F.max))))
    same = reduce(lambda a, b: a & b, [F.col(f"{c}_min") == F.col(f"{c}_max") for c in flags])
    return stats.where(same).select(group, *(F.col(f"{c}_min").alias(c) for c in flags))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of all pairs of levels, zeros too."""
    counts = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return joins.complete(df.select(a).distinct(), df.select(b).distinct(), counts, [a, b], "n")
