"""Batches of queries against whole lists."""

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import batched, index, search, vectors
from scriptorium.plans import catalogue
from scriptorium.sources import adapters
from scriptorium.sources.adapters import CHUNK_SCHEMA


def corpus(spark, texts):
    return spark.createDataFrame([(f"f{i // 50:02}.md#{i:03}", f"f{i // 50:02}.md", "H", 2, t, t, "f > H", i % 50, {"language": "en" if i % 2 else "de"}) for i, t in enumerate(texts)], CHUNK_SCHEMA)


def by_query(rows):
    got = {}
    for r in rows.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    return got


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """420 chunks with a phrase, the later the shorter: the first of the match list are the last of the phrase list."""
    return index.build(corpus(spark, [" ".join(["alpha beta alpha beta", *(f"w{k % 9}" for k in range(420 - i))]) for i in range(420)]), str(tmp_path_factory.mktemp("index")))


def whole(made, query, slop, limit, *more):
    lists = [search.ranked(search.match_index(made, query, None), "match"), search.ranked(search.phrase_index(made, query, slop, None), "phrase"), *more]
    return [(r.chunk_id, r.score) for r in search.fused(lists).orderBy(F.desc("score"), "chunk_id").limit(limit).collect()]


def test_the_phrase_list_takes_part_however_far_down_a_row_is(spark, made, monkeypatch):
    queries = {1: "alpha beta", 2: "beta alpha w0", 3: "w1 w2 w3"}
    asked = spark.createDataFrame(list(queries.items()), "query_id int, query string")
    assert search.depths(50, search.WEIGHTS)[1] < 420
    for slop in (0, 2):
        got = by_query(search.search_many(made, asked, 50, slop))
        assert got == {i: whole(made, q, slop, 50) for i, q in queries.items()}
        assert any(int(c.split("#")[1]) > 400 for c, _ in got[1])
    for name, value in (("SCAN_QUERIES", 1), ("HELD_ROWS", 20), ("SLICE", 30), ("BUCKET_CHUNKS", 60)):
        monkeypatch.setattr(batched, name, value)
    assert by_query(search.search_many(made, asked, 50, 2)) == got


def test_an_exact_batch_takes_the_whole_vector_list(spark, tmp_path):
    class Lengths:
        name, dimensions = "lengths", 2

        def embed(self, texts):
            return [[float(len(t)), float(t.count("a"))] for t in texts]

    provider = Lengths()
    rows = corpus(spark, [("needle " if i > 290 else "") + "a b " * (i + 1) for i in range(300)])
    made = index.build(rows, str(tmp_path), vectors=vectors.embedded(rows, "content_text", provider).select("chunk_id", "vector"))
    near = search.ranked(made.table("chunks").select("chunk_id", vectors.distance(F.col("vector"), provider.embed(["needle b"])[0]).alias("score")), "vector", best=F.asc("score"))
    want = whole(made, "needle b", 0, 10, near)
    asked = spark.createDataFrame([(1, "needle b")], "query_id int, query string")
    assert by_query(search.search_many(made, asked, 10, provider=provider, exact=True)) == {1: want}
    far = {r.chunk_id for r in near.where(F.col("rank") > search.NEAREST_OF_MANY).collect()}
    assert far & {c for c, _ in want}


def test_batches_need_no_postings_and_an_index_without_them_answers_alike(spark, made, tmp_path):
    lean = index.build(made.table("chunks"), str(tmp_path), for_batches=True)
    assert not (tmp_path / lean.version / "postings").exists() and not (tmp_path / lean.version / "impacts").exists()
    for name in ("terms", "fields", "postings", "impacts"):
        rows = lean.table(name).select(sorted(lean.table(name).columns))
        assert sorted(map(str, rows.collect())) == sorted(map(str, made.table(name).select(rows.columns).collect()))
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "w1 w2 zzz")], "query_id int, query string")
    for filters in (None, {"language": "en"}):
        assert by_query(search.search_many(lean, asked, 10, filters=filters)) == by_query(search.search_many(made, asked, 10, filters=filters))
    assert search.match_best(lean, "alpha w3", 5).rows.collect() == search.match_best(made, "alpha w3", 5).rows.collect()


@pytest.mark.parametrize("name", ["batched_search", "batched_filtered"])
def test_the_queries_of_batches_make_no_postings(spark, monkeypatch, name):
    def fail(chunks):
        raise AssertionError("postings of all chunks")

    monkeypatch.setattr(index, "postings", fail)
    assert catalogue.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_places_in_files_are_made_as_chunks_are_dealt_out(spark, tmp_path):
    docs = adapters.read(spark, "/root/testdata/sf0.001", "documents")
    rows = [adapters.documents_as_chunks(docs, indexed) for indexed in (True, False)]
    whole, dealt = index.build(rows[0], str(tmp_path / "a")), index.build(rows[1], str(tmp_path / "b"), for_batches=True, order="doc_id")
    assert dealt.table("chunks").schema.names == whole.table("chunks").schema.names
    for name in ("chunks", "heads", "terms"):
        assert sorted(map(str, dealt.table(name).collect())) == sorted(map(str, whole.table(name).collect()))
