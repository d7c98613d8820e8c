"""Queries over whole tables, against brute force on a small fixture."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from tidemark import plans


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("small"))
    start = datetime(2024, 1, 4)
    spark.createDataFrame([(i, start + timedelta(hours=i % 90)) for i in (0, 1, 1999, 2000, 2001, 90_000)], "event_id long, ts timestamp_ntz").write.parquet(f"{d}/events.parquet")
    spark.createDataFrame([(i, "FOP"[i % 3], 1000.0 * i) for i in range(12)], "o_orderkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(i, f"n{i}", None if i == 11 else i % 5) for i in range(12)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{d}/nation.parquet")
    return d


def test_times_of_all_events(spark, small):
    got = {(r.event_id, r.step): (r.hours, r.inside) for r in plans.queries()["g10_g12_time"](spark, small).collect()}
    ids = (0, 1, 1999, 2000, 2001, 90_000)
    assert got == {(i, s): (72.0 + i % 90, 24 <= i % 90 <= 60) for i in ids for s in (0, 12, 24)}


def test_models_of_all_orders(spark, small):
    got = sorted((r.o_orderkey, r.a, r.b) for r in plans.queries()["c17_aligned_models"](spark, small).collect())
    assert got == [(i, i / 1000, i / 2000) for i in range(12)]


def test_appends_of_all_regions(spark, small):
    got = sorted(r.n_nationkey for r in plans.queries()["a10_append"](spark, small).collect())
    assert got == list(range(12))
