"""The pipeline's stages on a small corpus with planted cases."""

from __future__ import annotations

import corpus_pipeline
from tests.llm.conftest import edited, prose


def test_pipeline(spark, tmp_path):
    rows, labels = [], []
    for i in range(120):
        bad = i % 4 == 0
        text = prose(i, 150)
        rows.append((i, text.upper() if bad else text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(not bad), 0))
    passage = prose(5000, 60)
    rows += [(1000, edited(prose(1, 150), 3, 30), "en", "s0", 1), (1001, prose(2, 150), "en", "s1", 1), (1002, prose(900, 40) + "\n" + passage, "en", "s2", 1), (1003, None, "en", None, 0), (1004, "", None, "s1", 0)]
    table = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, table).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = {r.doc_id for r in docs.collect()}
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good = {i for i in range(120) if i % 4}
    assert good <= kept["quality"] and len(kept["quality"] & set(range(120))) < 100
    assert good <= kept["line_dedup"] and 1001 not in kept["line_dedup"]
    assert good <= kept["near_dedup"] | {1}
    assert 1002 not in kept["decontamination"] and good - {1} <= kept["decontamination"]
    assert kept["mixing"] and all(r.taken > 0 for r in docs.collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["mixing"])


TABLE = "doc_id long, text string, lang string, source string, n_chars long, __kept int, taken string"


def staged(spark, tmp_path, rows):
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(5000, 60)), (None, prose(5001, 60))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, out = spark.createDataFrame(rows, TABLE), {}
    for name, stage in corpus_pipeline.STAGES[1:]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = docs
    return out


def test_stages_keep_rows_of_repeated_and_null_ids(spark, tmp_path):
    """Equal rows, several null ids, an id with two texts, columns whose names clash: one survivor a group, no text under a foreign row."""
    a, b, c, d = (prose(i, 120) for i in range(700, 704))
    rows = [(7, a), (7, a), (8, b), (8, c), (None, d), (None, prose(705, 120)), (None, prose(705, 120)), (9, a + "\n" + prose(706, 60)), (None, prose(5001, 60)), (None, ""), (None, None)]
    out = staged(spark, tmp_path, [(i, t, "en", "s", len(t or ""), k, "x") for k, (i, t) in enumerate(rows)])
    texts = {k: t for k, (_, t) in enumerate(rows)}
    near = out["near_dedup"].collect()
    # Rows 0 and 1 are one text, of which row 9 keeps its own lines; the null ids' texts stay with their rows.
    assert sorted(r["__kept"] for r in near) == sorted({r["__kept"] for r in near})
    assert sum(r.text == a for r in near) == 1 and sum(r.text == texts[5] for r in near) == 1
    assert {r["__kept"] for r in near} >= {2, 3, 4, 7, 8} and all(r.text in (texts[r["__kept"]], prose(706, 60)) for r in near)
    clean = {r["__kept"] for r in out["decontamination"].collect()}
    assert 8 not in clean and clean >= {2, 3, 4, 7}
    mixed = out["mixing"].collect()
    assert len({r["__kept"] for r in mixed}) == len(mixed) and {"size", "target", "taken"} <= set(out["mixing"].columns)


def test_stages_on_an_empty_table(spark, tmp_path):
    out = staged(spark, tmp_path, [])
    assert all(df.count() == 0 for df in out.values())
