"""Scans and sinks, projections and reshapes, joins, aggregates, windows, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import sources
from tidemark.functions import clip, distinct_list, earliest, expit, finite, hash_fold, latest, logit, ordinal_level, pattern_of, ratio, seconds_between, some, strict_double
from tidemark.operators import joins, matrix, metrics, quality, reshape
from tidemark.operators.ranks import distinct_counts, exact_quantiles
from tidemark.plans.base import COHORT, HASH_FOLD, OBS, SPEC, SPINE, WOBS, cohort, landmarks, observations, query, rounded, table, work_path
from tidemark.spec import KEYS, WindowSpec


@query("a01_a02_pruned_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_returnflag = 'R'")
def _(spark, d):
    where = (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("l_returnflag") == "R")
    return sources.scan(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"], where)


@query("a03_a06_csv_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, d):
    path = work_path(spark, "csv")
    sources.write_csv(table(spark, d, "customer"), path)
    return sources.scan_csv(spark, path, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


@query("a03_csv_inferred", """SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CASE WHEN o_orderkey % 500 = 7 THEN 'n/a' ELSE CAST(CAST(o_custkey AS BIGINT) AS VARCHAR) END AS customer, CAST(o_totalprice AS DOUBLE) AS price, strftime(o_orderdate, '%d.%m.%Y') AS ordered,
  'said "' || o_orderpriority || '", twice' AS note, CAST(0 AS BIGINT) AS broken FROM orders WHERE o_orderkey % 1000 <> 11 UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, count(*) FROM orders WHERE o_orderkey % 1000 = 11 HAVING count(*) > 0""")
def _(spark, d):
    """Orders as CSV lines, some without all fields, some customers not a number; read with inferred types, the broken lines counted at the end."""
    o, path = table(spark, d, "orders"), work_path(spark, "lines")
    quoted = F.concat(F.lit('"said ""'), "o_orderpriority", F.lit('"", twice"'))
    customer = F.when(F.col("o_orderkey") % 500 == 7, "n/a").otherwise(F.col("o_custkey").cast("string"))
    whole = F.concat_ws(",", "o_orderkey", customer, F.col("o_totalprice").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"), quoted)
    line = F.when(F.col("o_orderkey") % 1000 == 11, F.concat_ws(",", "o_orderkey", F.lit("cut"))).otherwise(whole)
    head = spark.createDataFrame([("o_orderkey,customer,price,ordered,note",)], "value string")
    head.unionByName(o.select(line.alias("value"))).coalesce(1).write.text(path)
    rows, broken = sources.scan_csv_inferred(spark, path)
    rows = rows.withColumns({"o_orderkey": F.col("o_orderkey").cast("long"), "ordered": F.date_format("ordered", "dd.MM.yyyy"), "broken": F.lit(0).cast("long")})
    none = [F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c != "broken"]
    return rows.unionByName(broken.agg(F.count(F.lit(1)).alias("broken")).where("broken > 0").select(*none, "broken"))


@query("a04_catalog_table", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def _(spark, d):
    """A join of tables of two databases, by their qualified names."""
    a, b = (work_path(spark, name).rpartition("/")[2].replace("-", "_") for name in ("places", "areas"))
    for database, name in ((a, "nation"), (b, "region")):
        sources.create_database(spark, database)
        sources.save_table(table(spark, d, name), f"{database}.{name}")
    nation, region = sources.catalog_table(spark, f"{a}.nation"), sources.catalog_table(spark, f"{b}.region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))


@query("a05_sorted_parquet", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark, d):
    path = work_path(spark, "sorted")
    sources.write_sorted(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), path, "o_custkey", "o_orderkey")
    return spark.read.parquet(path)


@query("a07_schema_table", """SELECT CAST(ordinal_position - 1 AS INTEGER) AS column_id, name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS type, n_values
FROM (SELECT *, column_name AS name FROM information_schema.columns WHERE table_name = 'lineitem') JOIN (UNPIVOT (SELECT count(COLUMNS(*)) AS '\\0' FROM lineitem) ON COLUMNS(*) INTO NAME name VALUE n_values) USING (name)""")
def _(spark, d):
    """The columns of a table as rows, with the values that each has."""
    return sources.filled_schema(table(spark, d, "lineitem"))


@query("a09_literal_table", "SELECT event_type, w, count(*) AS n FROM events JOIN (VALUES ('view', 1), ('click', 2)) t(event_type, w) USING (event_type) GROUP BY ALL")
def _(spark, d):
    weights = sources.literal(spark, [("view", 1), ("click", 2)], "event_type string, w int")
    return table(spark, d, "events").join(weights, "event_type").groupBy("event_type", "w").agg(F.count(F.lit(1)).alias("n"))


@query("a10_append", "SELECT n_nationkey, n_name FROM nation")
def _(spark, d):
    """All regions, one append each; nations without a region are appended last."""
    path, nation = work_path(spark, "append"), table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    regions = nation.select("n_regionkey").distinct().orderBy(F.col("n_regionkey").asc_nulls_last())
    for r in [x[0] for x in regions.collect()]:
        sources.append(nation.where(F.col("n_regionkey").eqNullSafe(F.lit(r))).drop("n_regionkey"), path)
    return spark.read.parquet(path)


@query("b01_b03_projection_filter", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, CASE WHEN l_quantity > 25 THEN 'bulk' ELSE 'small' END AS size FROM lineitem WHERE (l_returnflag = 'A' OR l_tax > 0.05) AND l_linestatus <> 'O'")
def _(spark, d):
    rows = table(spark, d, "lineitem").where(((F.col("l_returnflag") == "A") | (F.col("l_tax") > 0.05)) & (F.col("l_linestatus") != "O"))
    return rows.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"), F.when(F.col("l_quantity") > 25, "bulk").otherwise("small").alias("size"))


@query("b02_star_minus", "SELECT * EXCLUDE (p_name, p_retailprice) FROM part")
def _(spark, d):
    return table(spark, d, "part").drop("p_name", "p_retailprice")


@query("b04_plausible_values", "SELECT event_id, event_type, value FROM events WHERE (event_type = 'view' AND value >= 1 AND value < 200) OR (event_type = 'click' AND value > 0.5 AND value <= 150) OR (event_type = 'error' AND value > 10)")
def _(spark, d):
    bounds = sources.literal(spark, [("view", 1.0, 200.0, True, False), ("click", 0.5, 150.0, False, True), ("error", 10.0, None, False, False)], "variable string, lo double, hi double, lo_closed boolean, hi_closed boolean")
    return reshape.within_bounds(table(spark, d, "events").select("event_id", "event_type", "value"), bounds, "event_type")


@query("b05_b06_unpivot_distinct", "SELECT DISTINCT p_brand, variable, value FROM (SELECT p_brand, unnest(['size', 'price_band']) AS variable, unnest([CAST(p_size AS DOUBLE), floor(p_retailprice / 100)]) AS value FROM part)")
def _(spark, d):
    return reshape.unpivot(table(spark, d, "part"), ["p_brand"], {"size": F.col("p_size").cast("double"), "price_band": F.floor(F.col("p_retailprice") / 100).cast("double")}).distinct()


@query("b07_stacked_columns", "SELECT o_orderkey, unnest([o_orderstatus, o_orderpriority]) AS value FROM orders")
def _(spark, d):
    return reshape.stacked(table(spark, d, "orders"), ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@query("b08_widened", "SELECT user_id, " + ", ".join(f"round(sum(value) FILTER (event_type = '{v}'), 4) AS {v}_total, CAST(count(*) FILTER (event_type = '{v}') AS BIGINT) AS {v}_n" for v in ("view", "click")) + " FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL")
def _(spark, d):
    long = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("total"), F.count(F.lit(1)).alias("n"))
    wide = reshape.widen(long, ["user_id"], "event_type", ["view", "click"], {"total": "total", "n": "n"})
    wide = wide.where("view_n IS NOT NULL OR click_n IS NOT NULL")
    return wide.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("view_n", "click_n")})


@query("b09_models_wide", "SELECT l_linenumber, round(avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS A, round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS R, round(avg(l_quantity) FILTER (l_returnflag = 'A') - avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS A_minus_R FROM lineitem GROUP BY ALL")
def _(spark, d):
    long = table(spark, d, "lineitem").groupBy("l_linenumber", F.col("l_returnflag").alias("model_id")).agg(F.avg("l_quantity").alias("v"))
    return rounded(reshape.widen_models(long, ["l_linenumber"], ["A", "R"], "v", [("A", "R")]))


@query("b10_domain_rows", "SELECT p_partkey, unnest(list_filter([CASE WHEN p_size > 40 THEN 'large' END, CASE WHEN p_retailprice > 1500 THEN 'dear' END, CASE WHEN p_type = 'PROMO' THEN 'promo' END], lambda x: x IS NOT NULL)) AS domain FROM part")
def _(spark, d):
    return reshape.domains(table(spark, d, "part"), ["p_partkey"], {"large": F.col("p_size") > 40, "dear": F.col("p_retailprice") > 1500, "promo": F.col("p_type") == "PROMO"})


@query("b11_code_dictionary", "SELECT event_id, CASE event_type WHEN 'view' THEN 'seen' WHEN 'click' THEN 'touched' END AS canonical FROM events WHERE event_type IN ('view', 'click')")
def _(spark, d):
    names = sources.literal(spark, [("view", "seen"), ("click", "touched")], "code string, name string")
    return reshape.renamed(table(spark, d, "events"), names, "event_type", "canonical").select("event_id", "canonical")


@query("b12_unit_conversion", "SELECT event_id, round(CASE WHEN event_type = 'view' OR (event_type = 'click' AND value > 60) THEN (value - 32) * 5 / 9 ELSE value END, 6) AS celsius FROM events")
def _(spark, d):
    rows = table(spark, d, "events").withColumn("unit", F.when(F.col("event_type") == "view", " F ").when(F.col("event_type") != "click", "C"))
    return rounded(rows.select("event_id", reshape.fahrenheit_to_celsius("value", "unit").alias("celsius")))


@query("b13_b14_text_rules", "SELECT p_partkey, CASE WHEN regexp_matches(lower(trim(p_type)), 'promo|economy') THEN 1 WHEN regexp_matches(lower(trim(p_type)), 'econ|large') THEN 2 WHEN regexp_matches(lower(trim(p_type)), '^s') THEN -2 END AS level, CASE WHEN lower(p_name) LIKE '%part 1%' THEN 'one' WHEN lower(p_name) LIKE '%part%' THEN 'part' END AS agent FROM part")
def _(spark, d):
    name = F.lower("p_name")
    agent = F.when(name.like("%part 1%"), "one").when(name.like("%part%"), "part")
    return table(spark, d, "part").select("p_partkey", ordinal_level("p_type", [("promo|economy", 1), ("econ|large", 2), ("^s", -2)]).alias("level"), agent.alias("agent"))


@query("b15_b17_feature_selection", "SELECT c_custkey, c_acctbal, c_nationkey FROM customer")
def _(spark, d):
    return matrix.select_features(table(spark, d, "customer"), ["c_custkey"], ["c_acctbal", "c_custkey", "c_mktsegment", "c_nationkey"], without=["c_mktsegment"])


@query("c01_c02_join_chain", "SELECT c_custkey, n_name, r_name, count(o_orderkey) AS n_orders FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY ALL")
def _(spark, d):
    c, n, r, o = (table(spark, d, t) for t in ("customer", "nation", "region", "orders"))
    rows = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.join(o.where("o_orderstatus = 'F'"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey", "n_name", "r_name").agg(F.count("o_orderkey").alias("n_orders"))


@query("c03_c04_completed_grid", "WITH l AS (SELECT DISTINCT o_orderpriority FROM orders), s AS (SELECT DISTINCT o_orderstatus FROM orders), n AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 400000 GROUP BY ALL) SELECT s.o_orderstatus, l.o_orderpriority, coalesce(n, 0) AS n FROM s CROSS JOIN l LEFT JOIN n ON n.o_orderstatus = s.o_orderstatus AND n.o_orderpriority = l.o_orderpriority")
def _(spark, d):
    o = table(spark, d, "orders")
    counts = o.where("o_totalprice > 400000").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return joins.complete(o.select("o_orderstatus").distinct(), o.select("o_orderpriority").distinct(), counts, ["o_orderstatus", "o_orderpriority"], "n")


@query("c05_c06_range_join", f"WITH {WOBS} SELECT landmark_h, variable, count(*) AS n FROM wobs GROUP BY ALL")
def _(spark, d):
    return joins.expand(observations(spark, d), SPEC).join(landmarks(spark, d).select(*KEYS), KEYS).groupBy("landmark_h", "variable").agg(F.count(F.lit(1)).alias("n"))


@query("c07_interval_overlap", "WITH iv AS (SELECT user_id, min((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9) AS a, max((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9) AS b FROM events WHERE event_type = 'purchase' GROUP BY ALL) SELECT landmark_h, count(*) AS n FROM iv, (SELECT unnest(generate_series(24, 720, 48)) AS landmark_h) WHERE a <= landmark_h AND b >= landmark_h - 72 GROUP BY ALL")
def _(spark, d):
    p = observations(spark, d).where("variable = 'purchase'")
    iv = p.groupBy("entity_key").agg(F.min("offset_h").alias("start_h"), F.max("offset_h").alias("end_h"))
    return joins.overlapping(iv, WindowSpec(24, 720, 48, 72, 72), closed=True).groupBy("landmark_h").agg(F.count(F.lit(1)).alias("n"))


@query("c08_proximity_join", f"WITH {OBS} SELECT a.entity_key, round(a.offset_h, 6) AS view_h, round(b.offset_h, 6) AS click_h FROM obs a JOIN obs b ON a.entity_key = b.entity_key AND a.variable = 'view' AND b.variable = 'click' AND abs(a.offset_h - b.offset_h) <= 6")
def _(spark, d):
    obs = observations(spark, d)
    a = obs.where("variable = 'view'").select("entity_key", F.col("offset_h").alias("view_h"))
    b = obs.where("variable = 'click'").select("entity_key", F.col("offset_h").alias("click_h"))
    return rounded(joins.near(a, b, "entity_key", "view_h", "click_h", 6.0).select("entity_key", "view_h", "click_h"))


@query("c09_c10_c11_semi_anti", f"WITH {SPINE} SELECT entity_key, landmark_h, EXISTS (SELECT 1 FROM obs o WHERE o.entity_key = s.entity_key AND variable = 'click' AND offset_h > landmark_h - 24 AND offset_h <= landmark_h) AS clicked FROM spine s WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.entity_key = s.entity_key AND variable = 'signup' AND offset_h > landmark_h - 24 AND offset_h <= landmark_h)")
def _(spark, d):
    obs = observations(spark, d).withColumnRenamed("offset_h", "event_h")
    s = landmarks(spark, d).select(*KEYS).withColumn("since_h", F.col("landmark_h") - 24)
    kept = joins.in_range(s, obs.where("variable = 'signup'"), "entity_key", "since_h", "landmark_h", how="left_anti")
    clicked = joins.in_range(kept, obs.where("variable = 'click'"), "entity_key", "since_h", "landmark_h", how="left_semi")
    return clicked.withColumn("clicked", F.lit(True)).unionByName(kept.join(clicked, KEYS, "left_anti").withColumn("clicked", F.lit(False))).drop("since_h")


@query("c12_c13_windowed_subqueries", f"WITH {SPINE} SELECT entity_key, landmark_h, (SELECT round(min(offset_h), 6) FROM obs o WHERE o.entity_key = s.entity_key AND offset_h > landmark_h AND offset_h <= landmark_h + 48) AS first_h, (SELECT count(*) FROM obs o WHERE o.entity_key = s.entity_key AND offset_h > landmark_h AND offset_h <= landmark_h + 48) AS n, (SELECT count(DISTINCT variable) FROM obs o WHERE o.entity_key = s.entity_key AND offset_h > landmark_h AND offset_h <= landmark_h + 48) AS kinds FROM spine s")
def _(spark, d):
    s = landmarks(spark, d).select(*KEYS).withColumn("end_h", F.col("landmark_h") + 48)
    hits = joins.in_range(s, observations(spark, d).select("entity_key", F.col("offset_h").alias("event_h"), "variable"), "entity_key", "landmark_h", "end_h")
    return rounded(hits.groupBy(*KEYS).agg(F.min("event_h").alias("first_h"), F.count("event_h").alias("n"), F.count_distinct("variable").alias("kinds")))


@query("c14_pair_slopes", "SELECT a.l_orderkey, count(*) AS n_pairs, round(median((b.l_quantity - a.l_quantity) / (b.l_linenumber - a.l_linenumber)), 6) AS slope FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber > a.l_linenumber GROUP BY ALL")
def _(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    r = l.select("l_orderkey", F.col("l_linenumber").alias("n2"), F.col("l_quantity").alias("q2"))
    pairs = l.join(r, "l_orderkey").where("n2 > l_linenumber")
    return rounded(pairs.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_pairs"), F.median((F.col("q2") - F.col("l_quantity")) / (F.col("n2") - F.col("l_linenumber"))).alias("slope")))


@query("c15_coalesced_lookup", "SELECT o_orderkey, coalesce(a.v, b.v) AS v FROM orders LEFT JOIN (SELECT CAST(c_custkey AS VARCHAR) AS k, c_mktsegment AS v FROM customer WHERE c_acctbal > 5000) a ON a.k = CAST(o_custkey AS VARCHAR) LEFT JOIN (SELECT 'F' AS k, 'closed' AS v) b ON b.k = o_orderstatus")
def _(spark, d):
    rich = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").cast("string").alias("k"), F.col("c_mktsegment").alias("v"))
    lookup = rich.union(sources.literal(spark, [("F", "closed")], "k string, v string"))
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("customer"), "o_orderstatus")
    return joins.first_match(rows, lookup, ["customer", "o_orderstatus"], "k", "v").select("o_orderkey", "v")


@query("c16_validated_merge", "SELECT s_suppkey, s_name, n, round(qty, 4) AS qty FROM supplier JOIN (SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL) ON l_suppkey = s_suppkey")
def _(spark, d):
    per = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("qty"))
    return joins.merge_one_to_one(table(spark, d, "supplier").select("s_suppkey", "s_name"), per, ["s_suppkey"])


def _aligned(o):
    long = o.select("o_orderkey", F.lit("a").alias("model_id"), (F.col("o_totalprice") / 1e6).alias("probability")).union(o.select("o_orderkey", F.lit("b"), F.col("o_totalprice") / 2e6))
    return rounded(joins.align_models(long, ["o_orderkey"], ["a", "b"]), 9)


@query("c17_aligned_models", "SELECT o_orderkey, round(o_totalprice / 1e6, 9) AS a, round(o_totalprice / 2e6, 9) AS b FROM orders")
def _(spark, d):
    return _aligned(table(spark, d, "orders"))


@query("c18_share_of_total", "SELECT o_orderstatus, round(count(*)::DOUBLE / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY ALL")
def _(spark, d):
    n = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return rounded(n.select("o_orderstatus", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share")))


@query("d01_d12_aggregates", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS qty, round(avg(l_extendedprice), 4) AS price, min(l_shipdate) AS first, max(l_shipdate) AS last, count(DISTINCT l_suppkey) AS suppliers,
  count(DISTINCT (l_suppkey, l_linenumber)) AS pairs, count(DISTINCT CASE WHEN l_tax > 0.04 THEN l_partkey END) AS taxed_parts, round(median(l_quantity), 6) AS mid, round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 4) AS iqr,
  round(CASE WHEN count(*) >= 2 THEN stddev_samp(l_discount) END, 6) AS sd, round(sum(l_quantity) FILTER (l_discount > 0.05), 4) AS promo_qty, count(*) FILTER (l_tax = 0) AS untaxed, bool_or(l_quantity > 49) AS any_large, bool_and(l_quantity > 0) AS all_positive,
  round(avg(CAST(l_discount > 0.02 AS INTEGER)), 6) AS discounted, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS lines, count(*) || ' rows' AS detail, round(sum(l_quantity * l_tax) / sum(l_quantity), 6) AS weighted_tax
FROM lineitem GROUP BY ALL""")
def _(spark, d):
    rows, by = table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"]
    both = F.array(F.struct(F.lit("mid").alias("c"), F.col("l_quantity").cast("double").alias("v")), F.struct(F.lit("iqr").alias("c"), F.col("l_extendedprice").cast("double").alias("v")))
    quantiles = exact_quantiles(rows.select(*by, F.explode(both).alias("x")).select(*by, "x.c", "x.v"), [*by, "c"], "v", [0.25, 0.5, 0.75])
    of = lambda c, i: F.max(F.when(F.col("c") == c, F.get("quantiles", F.lit(i))))
    shape = quantiles.groupBy(*by).agg(of("mid", 1).alias("mid"), F.round(of("iqr", 2) - of("iqr", 0), 4).alias("iqr"))
    distinct = distinct_counts(rows, by, {"suppliers": F.col("l_suppkey"), "pairs": F.struct("l_suppkey", "l_linenumber"), "taxed_parts": F.when(F.col("l_tax") > 0.04, F.col("l_partkey"))})
    return rounded(
        rows.groupBy(*by).agg(
            F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("qty"), F.round(F.avg("l_extendedprice"), 4).alias("price"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"),
            F.when(F.count(F.lit(1)) >= 2, F.stddev_samp("l_discount")).alias("sd"), F.round(F.sum(F.when(F.col("l_discount") > 0.05, F.col("l_quantity"))), 4).alias("promo_qty"),
            F.count_if(F.col("l_tax") == 0).alias("untaxed"), F.bool_or(F.col("l_quantity") > 49).alias("any_large"), F.bool_and(F.col("l_quantity") > 0).alias("all_positive"), F.avg((F.col("l_discount") > 0.02).cast("int")).alias("discounted"),
            distinct_list("l_linenumber").alias("lines"), F.concat(F.count(F.lit(1)).cast("string"), F.lit(" rows")).alias("detail"), (F.sum(F.col("l_quantity") * F.col("l_tax")) / F.sum("l_quantity")).alias("weighted_tax"),
        ).join(shape, by).join(distinct, by)
    )


@query("d06_d07_latest_earliest", "SELECT user_id, arg_max(value, (ts, event_id)) AS latest_value, arg_min(value, (ts, event_id)) AS earliest_value, min(event_type) AS some_type FROM events GROUP BY ALL")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(latest("value", "ts", "event_id").alias("latest_value"), earliest("value", "ts", "event_id").alias("earliest_value"), some("event_type").alias("some_type"))


@query("d13_two_level", "SELECT event_type, round(median(m), 6) AS median_of_medians FROM (SELECT event_type, user_id, median(value) AS m FROM events GROUP BY ALL) GROUP BY ALL")
def _(spark, d):
    per_user = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.median("value").alias("m"))
    return rounded(exact_quantiles(per_user, ["event_type"], "m", [0.5]).select("event_type", F.get("quantiles", F.lit(0)).alias("median_of_medians")))


@query("d14_named_quantiles", "SELECT l_returnflag, round(quantile_cont(l_quantity, 0.025), 6) AS low, round(quantile_cont(l_quantity, 0.975), 6) AS high, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY ALL")
def _(spark, d):
    rows = table(spark, d, "lineitem")
    q = exact_quantiles(rows, ["l_returnflag"], "l_quantity", [0.025, 0.975]).select("l_returnflag", F.get("quantiles", F.lit(0)).alias("low"), F.get("quantiles", F.lit(1)).alias("high"))
    return rounded(q.join(rows.groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("n_orders")), "l_returnflag"))


@query("d16_d17_crosstab", "WITH c AS (SELECT o_orderstatus, o_orderpriority FROM orders WHERE o_totalprice > 450000) SELECT a.o_orderstatus, b.o_orderpriority, count(c.o_orderstatus) AS n FROM (SELECT DISTINCT o_orderstatus FROM c) a CROSS JOIN (SELECT DISTINCT o_orderpriority FROM c) b LEFT JOIN c ON c.o_orderstatus = a.o_orderstatus AND c.o_orderpriority = b.o_orderpriority GROUP BY ALL")
def _(spark, d):
    return quality.crosstab(table(spark, d, "orders").where("o_totalprice > 450000"), "o_orderstatus", "o_orderpriority")


@query("d18_constant_groups", "SELECT o_custkey, min(CAST(o_totalprice > 100000 AS INTEGER)) AS dear FROM orders GROUP BY ALL HAVING min(CAST(o_totalprice > 100000 AS INTEGER)) = max(CAST(o_totalprice > 100000 AS INTEGER))")
def _(spark, d):
    return quality.constant_groups(table(spark, d, "orders").withColumn("dear", F.col("o_totalprice") > 100000), "o_custkey", ["dear"])


@query("d20_overall_and_groups", "SELECT coalesce(l_returnflag, 'overall') AS scope, count(*) AS n, round(avg(l_quantity), 6) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def _(spark, d):
    return rounded(table(spark, d, "lineitem").rollup("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("quantity")).select(F.coalesce("l_returnflag", F.lit("overall")).alias("scope"), "n", "quantity"))


@query("e01_e02_best_per_partition", "SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY o_orderpriority = min(o_orderpriority) OVER (PARTITION BY o_custkey)")
def _(spark, d):
    best = F.min("o_orderpriority").over(Window.partitionBy("o_custkey"))
    return table(spark, d, "orders").withColumn("best", best).where("o_orderpriority = best").select("o_custkey", "o_orderkey", "o_orderpriority")


@query("e03_islands", "WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity > 25 AS big FROM lineitem), i AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey, big ORDER BY l_linenumber) AS island FROM x) SELECT l_orderkey, max(n) AS longest FROM (SELECT l_orderkey, island, count(*) AS n FROM i WHERE big GROUP BY ALL) GROUP BY ALL")
def _(spark, d):
    x = table(spark, d, "lineitem").withColumn("big", F.col("l_quantity") > 25)
    island = F.col("l_linenumber") - F.row_number().over(Window.partitionBy("l_orderkey", "big").orderBy("l_linenumber"))
    runs = x.withColumn("island", island).where("big").groupBy("l_orderkey", "island").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("l_orderkey").agg(F.max("n").alias("longest"))


@query("e04_e05_lag_diff", "SELECT event_id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 3.6e9, 6) AS gap_h, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return rounded(e.select("event_id", ((F.col("us") - F.lag("us").over(w)) / F.lit(3.6e9)).alias("gap_h"), F.lag("event_type").over(w).alias("before")))


@query("e06_e08_rank_bins", "WITH n AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY size, o_custkey) AS k, count(*) OVER () AS m FROM n) SELECT o_custkey, size, 1 + CAST(k > 1 + (m - 1) * 0.33333333333333326e0 AS INTEGER) + CAST(k > 1 + (m - 1) * 0.6666666666666665e0 AS INTEGER) AS bin FROM r")
def _(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("size"))
    return metrics.rank_bins(n, "o_custkey", "size", 3)


@query("e07_running_totals", "SELECT y, s, tp, fp, sum(tp) OVER w AS cum_tp, sum(fp) OVER w AS cum_fp FROM (SELECT l_linestatus AS y, l_discount AS s, CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS tp, CAST(count(*) FILTER (l_returnflag <> 'R') AS DOUBLE) AS fp FROM lineitem GROUP BY ALL) WINDOW w AS (PARTITION BY y ORDER BY s DESC)")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("y"), (F.col("l_returnflag") == "R").cast("int").alias("outcome"), "l_discount")
    return metrics.ranked(metrics.score_counts(rows, "outcome", "l_discount", None, ["y"]), ["y"]).withColumnRenamed("score", "s")


@query("f01_f02_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(500)


@query("f03_first_by_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate, o_orderkey) = 1")
def _(spark, d):
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey"))
    return table(spark, d, "orders").withColumn("rank", rank).where("rank = 1").select("o_custkey", "o_orderkey", "o_totalprice")


@query("f04_f07_unions", "SELECT nation, n FROM (SELECT c_nationkey AS nation, 1 AS n FROM customer UNION SELECT s_nationkey, 1 FROM supplier) UNION ALL SELECT n_nationkey, 2 FROM nation UNION ALL SELECT n_regionkey, 3 FROM nation")
def _(spark, d):
    c, s, n = table(spark, d, "customer"), table(spark, d, "supplier"), table(spark, d, "nation")
    both = c.select(F.col("c_nationkey").alias("nation"), F.lit(1).alias("n")).union(s.select("s_nationkey", F.lit(1))).distinct()
    return both.union(n.select("n_nationkey", F.lit(2))).unionByName(n.select(F.lit(3).alias("n"), F.col("n_regionkey").alias("nation")))


@query("f08_set_comparison", "SELECT (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS unknown, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS without_orders, (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)) AS shared")
def _(spark, d):
    a, b = table(spark, d, "orders").select("o_custkey").distinct(), table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    sides = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "o_custkey", "full")
    return sides.agg(F.count_if(F.col("b").isNull()).alias("unknown"), F.count_if(F.col("a").isNull()).alias("without_orders"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"))


@query("g01_g06_scalars", """SELECT p_partkey, coalesce(nullif(p_size, 10), -1) AS a, greatest(p_size, 25) AS b, least(p_size, NULL, 25) AS c, CASE p_type WHEN 'PROMO' THEN 1 ELSE 0 END AS d, ceil(p_retailprice / 7)::BIGINT AS e, floor(p_retailprice / 7)::BIGINT AS f, abs(p_size - 25) AS g, round(power(p_size, 1.5), 6) AS h,
  round(p_retailprice, 1) AS i, lower(trim('  ' || p_brand || ' ')) AS j, p_brand LIKE 'Brand#1%' AS k, p_type IN ('PROMO', 'LARGE') AS l, regexp_matches(p_brand, '#[12]+$') AS m FROM part""")
def _(spark, d):
    c = F.col
    return rounded(
        table(spark, d, "part").select(
            "p_partkey", F.coalesce(F.nullif(c("p_size"), F.lit(10)), F.lit(-1)).alias("a"), F.greatest("p_size", F.lit(25)).alias("b"), F.least(c("p_size"), F.lit(None).cast("int"), F.lit(25)).alias("c"), F.when(c("p_type") == "PROMO", 1).otherwise(0).alias("d"),
            F.ceil(c("p_retailprice") / 7).alias("e"), F.floor(c("p_retailprice") / 7).alias("f"), F.abs(c("p_size") - 25).alias("g"), F.pow(c("p_size"), F.lit(1.5)).alias("h"), F.round("p_retailprice", 1).alias("i"), F.lower(F.trim(F.concat(F.lit("  "), "p_brand", F.lit(" ")))).alias("j"),
            c("p_brand").like("Brand#1%").alias("k"), c("p_type").isin("PROMO", "LARGE").alias("l"), c("p_brand").rlike("#[12]+$").alias("m"),
        )
    )


@query("g08_text_shapes", "SELECT regexp_replace(lower(trim(p_name)), '[0-9]+', '#', 'g') AS shape, count(*) AS n FROM part GROUP BY ALL")
def _(spark, d):
    return table(spark, d, "part").groupBy(pattern_of("p_name").alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def _times(e):
    e = e.withColumn("origin", F.lit("2024-01-01").cast("timestamp_ntz"))
    inside = F.col("ts").between(F.expr("timestamp_ntz'2024-01-05 00:00:00'"), F.expr("timestamp_ntz'2024-01-05 00:00:00' + interval 36 hours"))
    return e.select("event_id", (seconds_between("origin", "ts") / 3600.0).alias("hours"), inside.alias("inside"), F.explode(F.sequence(F.lit(0), F.lit(24), F.lit(12))).alias("step"))


@query("g10_g12_time", "SELECT event_id, date_diff('second', TIMESTAMP '2024-01-01', ts) / 3600.0 AS hours, ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-05' + INTERVAL 36 HOUR AS inside, CAST(unnest(generate_series(0, 24, 12)) AS INTEGER) AS step FROM events")
def _(spark, d):
    return _times(table(spark, d, "events"))


@query("g15_hash_bucket", f"SELECT c_custkey, {HASH_FOLD.format(seed=42, value='CAST(c_custkey AS VARCHAR)', n=7)} AS bucket FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", hash_fold("c_custkey", 42, 7).alias("bucket"))


@query("g16_g18_numeric", "SELECT event_id, round(ln(greatest(1e-6, least(1 - 1e-6, value / 500)) / (1 - greatest(1e-6, least(1 - 1e-6, value / 500)))), 6) AS lp, round(1 / (1 + exp(-value / 50)), 6) AS p, round(least(60, greatest(10, value)), 6) AS clipped, CASE WHEN event_id % 5 > 0 THEN round(value / (event_id % 5), 6) END AS r, CASE WHEN event_id % 3 > 0 THEN value END AS kept FROM events")
def _(spark, d):
    e = table(spark, d, "events")
    odd = F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.col("value"))
    return rounded(e.select("event_id", logit(F.col("value") / 500).alias("lp"), expit(F.col("value") / 50).alias("p"), clip("value", 10, 60).alias("clipped"), ratio("value", F.col("event_id") % 5).alias("r"), finite(odd).alias("kept")))


@query("g20_mapped_membership", f"WITH {COHORT} SELECT entity_key, CASE WHEN cluster_key IN ('1', '2', '3') THEN 'north' WHEN cluster_key IN ('4', '5') THEN 'south' ELSE 'other' END AS area FROM cohort")
def _(spark, d):
    area = F.when(F.col("cluster_key").isin("1", "2", "3"), "north").when(F.col("cluster_key").isin("4", "5"), "south").otherwise("other")
    return cohort(spark, d).select("entity_key", area.alias("area"))


__all__ = ["strict_double"]
