import corpus_pipeline
from scriptorium.llm import bagminhash, langid, sp_dropout
from scriptorium.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF), name)
        kept[name] = (before, docs)
        if name != "sentencepiece":
            assert docs.columns == before.columns
            assert docs.dtypes == before.dtypes
    before, after = kept["language"]
    rejected = {r.doc_id for r in langid.identify(before, langid.learn(before)).where("rejected").collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - rejected
    before, after = kept["near_duplicates"]
    assert {r.doc_id for r in after.collect()} == {r.class_id for r in bagminhash.near_duplicates(before).collect()}
    before, after = kept["decontamination"]
    assert after.count() <= before.count()
    before, after = kept["pii"]
    assert before.count() == after.count()
    assert all(r.n_chars == len(r.text) for r in after.collect())
    before, after = kept["sentencepiece"]
    texts = {r.doc_id: r.text for r in before.collect()}
    assert {r.doc_id: r.text for r in sp_dropout.decode(after).collect()} == texts


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len({r.doc_id for r in rows}) == len(rows) > 100
    assert all(r.lossless for r in rows)


def test_an_empty_table(spark):
    docs = table(spark, SF, "documents").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
    assert docs.collect() == []


def test_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows and further columns with the operators' own names."""
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no id"), (None, "another without id"), (5, "ñandú ☃ é́ ▁ x"), (6, "word " * 40_000), (7, "x" * 300_000), (8, "call +49 30 1234567 or mail a@b.example.org now")]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or ""), 1, 2, "k") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, id int, _k int, key string")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF), name)
        if name != "sentencepiece":
            assert docs.dtypes == before.dtypes
    got = [r.doc_id for r in docs.collect()]
    assert sorted(x for x in got if x is not None) == [4, 5, 6, 7, 8] and got.count(None) == 2
    assert all(r.lossless for r in docs.collect())
