import corpus_pipeline
import __spark_entry__

FOLDER = "/root/testdata/sf0.001"


def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.common.kept(stage(spark, docs, FOLDER), "stage")
        assert docs.columns == columns, name
        assert docs.count() <= before
        before = docs.count()
    want = {r.doc_id for r in docs.select("doc_id").collect()}
    got = corpus_pipeline.run(spark, FOLDER).select("doc_id").distinct().collect()
    assert {r.doc_id for r in got} == want


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and sum(n.startswith("op") for n in names if n[2:3].isdigit()) == 13


def test_stages_keep_what_they_should(spark):
    """Nulls, empty texts, repeated rows, shared ids, a very long text and clashing columns, through all stages; and an empty table."""
    folder = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{folder}/benchmark.parquet").orderBy("item_id").first().text
    clean = [f"{a} walked to the {b} by the {c} and said nothing of it to anyone at all on day {k}" for k, (a, b, c) in enumerate([("Anna", "river", "mill"), ("Boris", "harbour", "old gate"), ("Clara", "hill", "white house"), ("Dan", "field", "stone bridge")])]
    rows = [(90_001, clean[0]), (90_002, clean[1]), (90_002, clean[2]), (90_003, None), (90_004, ""), (None, clean[3]), (90_005, clean[0]), (90_006, "Before it. " + item + " After it."), (90_007, " ".join(f"w{k}" for k in range(60_000)))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, component long, own long, u long")
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert stage(spark, empty, folder).count() == 0, name
        if name != "packing":
            assert out.columns == docs.columns, name
            docs = spark.createDataFrame(out.collect(), out.schema)
    left = {(r.doc_id, r.text or "") for r in docs.collect()}
    assert {(90_001, clean[0]), (90_002, clean[1]), (90_002, clean[2]), (None, clean[3]), (90_004, "")} <= left
    ids = [i for i, _ in left]
    assert 90_006 not in ids and 90_003 in ids and 90_007 in ids
    assert (90_005, clean[0]) not in left
    assert {r.doc_id for r in out.select("doc_id").collect()} == set(ids)
