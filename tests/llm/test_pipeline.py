import corpus_pipeline
from blockprep.llm import queries
from tests.llm.odd import empty, odd_documents

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(queries.QUERIES) <= set(names) and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_stages_take_effect(spark, tmp_path):
    docs = odd_documents(spark, "score string, n_hit string, lang string")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, before, FOLDER).write.parquet(path)
        after = spark.read.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        before = after
    ids = sorted(r["doc_id"] for r in before.select("doc_id").collect() if r["doc_id"] is not None)
    # 2 copies 1 and goes with its lines, 3 is near to 1, the second row 6 repeats the first.
    assert ids == [1, 4, 5, 6, 7, 8, 9, 10, 12, 13, 14]


def test_column_names_are_in_no_stages_way(spark, tmp_path):
    names = "_doc _runs _text_hash text_hash n_lines n_removed score predicted n_hit x0 id hash n_chars a.b kept".split()
    docs = odd_documents(spark, ", ".join(f"`{n}` string" for n in names).replace("`", "").replace("a.b", "a_b"))
    docs = docs.toDF("doc_id", "text", *names)
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, before, FOLDER).write.parquet(path)
        before = spark.read.parquet(path)
        assert before.columns == docs.columns
    rows = before.collect()
    assert rows and all(r[i] == "x" for r in rows for i, n in enumerate(docs.columns) if n not in ("doc_id", "text", "n_chars"))


def test_stages_on_an_empty_table(spark):
    docs = empty(odd_documents(spark))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert rows and len({r["doc_id"] for r in rows}) == len(rows)
