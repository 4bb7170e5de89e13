import corpus_pipeline

from .conftest import SCHEMA, odd_rows


def test_stages_take_effect(spark, samples, save):
    rows = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in samples("documents")]
    where = save(documents=[*rows, (-5, "12 345", "en", "src1", 6), (-4, None, "en", "src1", 0), (9000, rows[0][1], "en", "src1", 1)])
    out = corpus_pipeline.run(spark, where).collect()
    ids = {r["doc_id"] for r in out}
    assert not ids & {-5, -4, 9000} and len(ids) > 100
    assert all(r["n_tokens"] == len(r["ids"]) for r in out)


def test_all_but_the_last_stage_return_the_columns_of_documents(spark, save):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.dtypes == spark.createDataFrame([], SCHEMA).dtypes
    assert docs.count() > 0


def test_a_task_has_one_worker_for_texts_that_lose_passages(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    plan = corpus_pipeline.repeated_passages(spark, docs, "")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ArrowEvalPython [shortened(") == 1


def test_the_plan_of_the_mix_takes_no_python_worker(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA).coalesce(1)
    docs = spark.createDataFrame(docs.toArrow())
    plan = corpus_pipeline.mixed_sources(spark, docs, "")._jdf.queryExecution().sparkPlan().toString()
    assert "ExistingRDD" not in plan
