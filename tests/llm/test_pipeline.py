import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_rows(spark, docs_of, prose, tmp_path):
    rows = [(i, prose(40, i), "en", "ab"[i % 2]) for i in range(60)] + [(100 + i, prose(40, i), "en", "a") for i in range(10)]
    item = prose(25, 999)
    rows += [(200, prose(10, 300) + " " + item, "en", "a"), (201, "123 456", "en", "b"), (202, None, "en", "b")]
    docs_of(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], str(tmp_path)))
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in seen[:-1]]
    assert ids[1] == ids[0] - {201, 202}
    assert ids[2] == ids[1] - set(range(100, 110)) and ids[3] == ids[2] - {200}
    assert ids[4] <= ids[3] and all(d.columns == docs.columns for d in seen[1:-1])
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert last.columns == [*docs.columns, "shard", "slot"] and last.count() == seen[4].count()
    assert last.select("shard", "slot").distinct().count() == last.count()


def test_odd_rows_in_every_stage(spark, docs_of, prose, tmp_path):
    """Nulls in every column, repeated rows and ids, ties, a very long text, extra columns with the stages' own names."""
    rows = [(i, prose(30, i), "en", "ab"[i % 2]) for i in range(30)] + [(i, prose(30, i), None, None) for i in range(30, 34)]
    rows += [(5, prose(30, 5), "en", "b")] * 2 + [(40, prose(30, 40), "en", "a"), (40, prose(30, 41), "en", "a"), (None, prose(30, 42), "en", "a"), (None, prose(30, 42), "en", "b")]
    rows += [(None, None, None, None), (50, None, "en", "a"), (51, "", "en", "a"), (52, (prose(200, 7) + " ") * 300, "en", "a"), (53, prose(12, 60) + " " + prose(25, 999), "en", None)]
    rows += [(None, prose(25, 999), "en", "b")]
    names = [c for c in docs_of([]).columns if c not in ("shard", "slot")]
    docs_of(rows).select("shard", "slot", *names).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, prose(25, 999)), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        before = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
        after = stage(spark, docs, str(tmp_path))
        held = sorted(((r["doc_id"], r["text"]) for r in after.collect()), key=str)
        if name == "language":
            assert held == [x for x in before if x[1]]
        elif name == "dedup":
            assert held == sorted(set(before) - {(x, y) for x, y in before if x is None and y == prose(30, 42)} | {(None, prose(30, 42))}, key=str)
        elif name == "decontamination":
            assert held == [x for x in before if prose(25, 999) not in x[1]] and len(held) == len(before) - 2
        elif name == "mixing":
            assert set(held) <= set(before) and all(held.count(x) <= 3 for x in set(held))
        else:
            assert held == before and len({(r["shard"], r["slot"]) for r in after.collect()}) == len(before)
        assert after.columns == (docs.columns if name != "sharding" else [*(c for c in docs.columns if c not in ("shard", "slot")), "shard", "slot"])
        docs = spark.createDataFrame(after.collect(), after.schema)


def test_empty_tables_in_every_stage(spark, docs_of, tmp_path):
    docs = docs_of([])
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, str(tmp_path))
        assert after.count() == 0 and set(docs.columns) <= set(after.columns)
