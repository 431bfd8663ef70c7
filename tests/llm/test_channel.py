"""The noisy channel: signs inside words, and scores against their definition."""

import math
import random

import pytest

from scriptorium.llm import hnsw, toxicity
from scriptorium.llm.common import table

SF = "/root/testdata/sf0.001"
TEXT = "you are an idiot and a stupid moron said the well known man who would not read or write and they were not amused by it "


@pytest.fixture(scope="module")
def small():
    return toxicity.CharModel(toxicity.trigrams([TEXT * 40]))


@pytest.mark.parametrize("said,meant", [("id.iot", "idiot"), ("id-iot", "idiot"), ("st-upid", "stupid"), ("id_iot", "idiot"), ("mo.ron", "moron"), ("st*pid", "stupid"), ("m#ron", "moron"), ("i.d.i.o.t", "idiot"), ("s~t~u~p~i~d", "stupid"), ("id1ot", "idiot")])
def test_signs_inside_words_are_undone(small, said, meant):
    assert toxicity.restore(f"You are {said} !", small).split()[2] == meant


def test_words_parted_by_signs_stay_apart(small):
    assert toxicity.restore("well-known", small) == "well known"
    assert toxicity.restore("plain words stay", small) == "plain words stay"


def test_counting_by_tokens_is_counting_by_words():
    g = random.Random(1)
    texts = ["".join(g.choice("abÉß1_-. \n\t '日") for _ in range(60)) for _ in range(200)]
    tokens = {}
    for t in texts:
        for x in t.lower().split():
            tokens[x] = tokens.get(x, 0) + 1
    assert toxicity.spelled(toxicity.words_of(tokens)) == toxicity.trigrams(texts)


def test_scores_against_their_definition(spark):
    """Every document again: each token restored, its words' features added up; nothing is skipped or kept."""
    docs = table(spark, SF, "documents")
    lm, model = toxicity.learn(docs, table(spark, SF, "labels"))
    got = {r.doc_id: r for r in toxicity.scored(docs, lm, model).collect()}
    kept = toxicity.Reader(lm, model.names)
    assert model.names
    for d in docs.collect():
        names = set()
        for t in toxicity.tokens(d.text or ""):
            for w in toxicity._SPLIT.split(toxicity.restore_token(t, lm)):
                names |= {f for f in toxicity.features(w) if f in model.names}
        assert kept.of(d.text) == {model.names[f] for f in names}
        x = model.constant + sum(float(model.weights[model.names[f]]) for f in names)
        r = got[d.doc_id]
        assert r.score == pytest.approx(1 / (1 + math.exp(-x)), abs=1e-9)
        assert r.predicted == int(r.score >= 0.3)


def test_a_reader_forgets_and_reads_on(small, monkeypatch):
    names = {f: i for i, f in enumerate(toxicity.Reader(small).of(TEXT))}
    want = toxicity.Reader(small, names).of(TEXT)
    reader = toxicity.Reader(small, names)
    monkeypatch.setattr(toxicity.Reader, "HELD", 3)
    assert [reader.of(TEXT) for _ in range(3)] == [want] * 3


def test_queries_in_many_partitions_make_full_blocks(spark):
    """The blocks that meet the graphs depend on the number of queries, not on how they lie."""
    g = random.Random(2)
    rows = spark.createDataFrame([(i, [g.gauss(0, 1) for _ in range(8)]) for i in range(300)], "vec_id long, embedding array<double>")
    one, many = (sorted(map(tuple, hnsw.nearest(df, df.where("vec_id % 3 = 0"), 5).collect())) for df in (rows.coalesce(1), rows.repartition(40)))
    assert one == many and len(one) == 500
    assert hnsw.nearest(rows, rows.where("false"), 5).collect() == []
