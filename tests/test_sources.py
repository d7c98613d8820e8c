"""CSV with inferred types, databases of the catalog, bucketed tables, resumed parts, distinct counts and quantiles."""

from __future__ import annotations

import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import sources
from tidemark.operators import ranks


def _csv(tmp_path, lines):
    path = tmp_path / "in.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_types_hold_all_rows_not_only_the_sample(spark, tmp_path):
    """The sample shows integers and dates; late rows have other values."""
    lines = ["id,n,big,x,day,word,flag,none"] + [f"{i},{i},{i},{i},2024-01-0{1 + i % 9},a,true," for i in range(2000)]
    lines += ["2000,n/a,3000000000,0.5,2024-01-01 10:00:00,b,false,"]
    rows, broken = sources.scan_csv_inferred(spark, _csv(tmp_path, lines), 0.05)
    assert dict(rows.dtypes) == {"id": "int", "n": "string", "big": "bigint", "x": "double", "day": "timestamp", "word": "string", "flag": "boolean", "none": rows.schema["none"].dataType.simpleString()}
    last = rows.where("id = 2000").first()
    assert (last.n, last.big, last.x, last.word, last.flag, last.none) == ("n/a", 3_000_000_000, 0.5, "b", False, None)
    assert rows.count() == 2001 and broken.count() == 0 and rows.where("n IS NULL OR big IS NULL OR x IS NULL OR day IS NULL").isEmpty()


def test_broken_and_quoted_lines(spark, tmp_path):
    lines = ["a,b,_line", '1,"x, ""y""",p', "2,short", "3,too,many,fields", "4,,q"]
    rows, broken = sources.scan_csv_inferred(spark, _csv(tmp_path, lines), 1.0)
    assert sorted(map(tuple, rows.collect())) == [(1, 'x, "y"', "p"), (4, None, "q")]
    assert sorted(r.line for r in broken.collect()) == ["2,short", "3,too,many,fields"]


def test_no_rows(spark, tmp_path):
    rows, broken = sources.scan_csv_inferred(spark, _csv(tmp_path, ["a,b"]))
    assert rows.columns == ["a", "b"] and rows.collect() == [] and broken.collect() == []


def test_two_databases_and_buckets(spark, tmp_path):
    for name in ("left_db", "right_db"):
        sources.create_database(spark, name, f"file://{tmp_path}/{name}")
    rows = spark.range(1000).withColumn("v", F.col("id") * 2)
    sources.save_table(rows, "left_db.t", "id", 4)
    sources.save_table(rows.withColumnRenamed("v", "w"), "right_db.t", "id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        both = sources.catalog_table(spark, "left_db.t").join(sources.catalog_table(spark, "right_db.t"), "id")
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
        assert both.where("v = w").count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_parts_that_are_cut_short_are_made_again(spark, tmp_path):
    path, made = f"{tmp_path}/parts", []

    def make(model, fold):
        made.append((model, fold))
        return spark.range(40).select(F.col("id").alias("k"), (F.col("id") * fold).alias("v")).repartition(4)

    parts = [("a", 1), ("a", 2), ("b", 1)]
    assert sources.resume_parts(spark, path, parts[:2], make, ["k"]).count() == 80 and made == parts[:2]
    assert sources.resume_parts(spark, path, parts, make, ["k"]).count() == 120 and made == parts
    # A file is lost, another part has no line in the manifest, as if its job had ended early.
    own = f"{path}/model_id=a/outer_fold=2"
    os.remove(f"{own}/{next(f for f in sorted(os.listdir(own)) if f.endswith('.parquet'))}")
    shutil.rmtree(f"{path}-manifest/model_id=b")
    spark.catalog.clearCache()
    found = sources.resume_parts(spark, path, parts, make, ["k"])
    assert made == [*parts, ("a", 2), ("b", 1)] and found.count() == 120 and found.groupBy("model_id", "outer_fold", "k").count().where("count > 1").isEmpty()
    assert sources.resume_parts(spark, path, parts, make, ["k"]).count() == 120 and len(made) == 5


def test_repeated_keys_in_a_part_are_an_error(spark, tmp_path):
    make = lambda m, f: spark.createDataFrame([(1,), (1,)], "k int")
    sources.resume_parts(spark, f"{tmp_path}/p", [("a", 1)], make, ["k"])
    with pytest.raises(ValueError, match="repeated"):
        sources.resume_parts(spark, f"{tmp_path}/p", [("a", 1)], make, ["k"])


def test_distinct_counts_and_quantiles(spark):
    rng = np.random.default_rng(6)
    rows = [(None if g == 3 else int(g), None if x < -2 else int(x * 1e5), f"s{abs(int(x * 7))}", float(round(x, 1))) for g, x in zip(rng.integers(0, 4, 3000), rng.normal(size=3000))]
    df = spark.createDataFrame(rows, "g int, n long, s string, v double")
    got = {r.g: (r.n, r.s, r.pair) for r in ranks.distinct_counts(df, ["g"], {"n": F.col("n"), "s": F.col("s"), "pair": F.when(F.col("n") > 0, F.struct("n", "s"))}).collect()}
    for g in (0, 1, 2, None):
        own = [r for r in rows if r[0] == g]
        assert got[g] == (len({r[1] for r in own} - {None}), len({r[2] for r in own}), len({r[1:3] for r in own if r[1] is not None and r[1] > 0}))
    plan = ranks.distinct_counts(df, ["g"], {"n": F.col("n"), "s": F.col("s")})._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    qs = [0.0, 0.005, 0.25, 0.5, 0.9, 1.0]
    for g, found in ranks.exact_quantiles(df.where("g IS NOT NULL"), ["g"], "v", qs).collect():
        assert np.allclose(found, np.quantile([r[3] for r in rows if r[0] == g], qs))


def test_row_numbers(spark):
    rng = np.random.default_rng(7)
    rows = [(f"g{a}", int(b)) for a, b in zip(rng.integers(0, 3, 500), rng.permutation(500))]
    df = spark.createDataFrame(rows, "g string, x int").repartition(6)
    got = {(r.g, r.x): r.no for r in ranks.row_numbers(df, ["g", "x"], "no").collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda i: i[1])] == sorted(rows) and sorted(got.values()) == list(range(500))
    within = {(r.g, r.x): r.no for r in ranks.row_numbers(df, ["g", "x"], "no", ["g"]).collect()}
    for g in ("g0", "g1", "g2"):
        own = sorted(x for k, x in rows if k == g)
        assert [within[g, x] for x in own] == list(range(len(own)))


def test_filled_schema_counts_values(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, None), (None, None, "")], "a long, `b.c` double, `d``e` string")
    assert [tuple(r) for r in sources.filled_schema(df).orderBy("column_id").collect()] == [(0, "a", "bigint", 2), (1, "b.c", "double", 0), (2, "d`e", "string", 2)]
    assert [r.n_values for r in sources.filled_schema(df.limit(0)).collect()] == [0, 0, 0]
