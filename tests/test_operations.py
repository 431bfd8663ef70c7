"""Ranking whole lists, batches of queries, remote providers, inverted files and the evaluation's odds and ends."""

import json
import os
from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import agent_eval, batched, evaluate, index, metadata, search, segments, vectors
from scriptorium.plans import build
from scriptorium.sources import adapters

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def chunks(spark):
    return adapters.documents_as_chunks(adapters.read(spark, SF, "documents"), indexed=True)


@pytest.fixture(scope="module")
def made(chunks, tmp_path_factory):
    return index.build(chunks, str(tmp_path_factory.mktemp("index")))


# ------------------------------------------------------------------ ranking and batches
@pytest.mark.parametrize("by", [[], ["lang"]])
def test_ranks_in_ranges_are_those_of_one_task(spark, monkeypatch, by):
    rows = spark.range(500).select(F.col("id").cast("string").alias("chunk_id"), (F.col("id") % 7).cast("double").alias("score"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("lang"))
    one = {tuple(r) for r in search.ranked(rows, "match", by=by).collect()}
    monkeypatch.setattr(search, "ONE_TASK", 40)
    assert {tuple(r) for r in search.ranked(rows, "match", by=by).collect()} == one
    assert len(one) == 500


def test_candidate_cap():
    assert [search.candidate_cap(0, 10), search.candidate_cap(990, 10), search.candidate_cap(0, 50), search.candidate_cap(9000, 50)] == [210, 1200, 250, 5000]


def test_a_batch_gives_what_single_queries_give(spark, made):
    texts = ["of the", "idiot of the est", "zzz", "", "The  WAS the"]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
    got = {}
    for r in search.search_many(made, asked, 7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    for i, t in enumerate(texts):
        if not t.strip():
            assert i not in got
            continue
        lists = [search.ranked(search.match_index(made, t, None), "match"), search.ranked(search.phrase_index(made, t, 0, None), "phrase")]
        want = search.fused(lists).orderBy(F.desc("score"), "chunk_id").limit(7).collect()
        assert got.get(i, []) == [(r.chunk_id, r.score) for r in want]


@pytest.mark.parametrize("filters", [None, {"language": "en"}])
def test_a_batch_keeps_few_rows_and_ranks_as_whole_lists_do(spark, made, monkeypatch, filters):
    """Lists of common words have about as many rows as there are queries times chunks: none of them is written, and the hits are those of whole lists."""
    texts = ["the was of", "idiot of the est", "est la de the", "of was the", "la of est", "of the", "zzz", "was la the", "the de of"]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
    rows = lambda: [tuple(r) for r in search.search_many(made, asked, 3, filters=filters).orderBy("query_id", "rank").collect()]
    sizes = []
    put = batched.written
    monkeypatch.setattr(batched, "written", lambda df, label: (sizes.append((out := put(df, label)).count()), out)[1])
    bounded = rows()
    hits = search.match_many(made, asked.select("query_id", F.explode(F.split("query", " ")).alias("term"))).count()
    assert bounded and max(sizes) * 2 < hits
    for name, value in (("BUCKET_CHUNKS", 60), ("QUERY_BLOCK", 3), ("SLICE", 16)):
        monkeypatch.setattr(batched, name, value)
    assert rows() == bounded
    monkeypatch.setattr(search, "depths", lambda limit, weights: None)
    assert rows() == bounded


def test_how_deep_lists_matter():
    w = search.WEIGHTS
    match, phrase = search.depths(10, w)
    assert 1.0 / (61 + match) + 1.25 / (61 + phrase) < 1.0 / 70 - 1e-6
    assert search.depths(10, {**w, "match": 0.0}) is None and search.depths(50, {**w, "phrase": 0.0})[1] == 1


def test_pages_follow_each_other_whether_capped_or_not(spark, made):
    for capped in (False, True):
        engine = search.Engine(made, capped=capped)
        first = engine.search(search.Request("of the", limit=5))
        second = engine.search(search.Request("of the", limit=5, cursor=first.next_cursor))
        ids = [h["chunk_id"] for h in first.hits + second.hits]
        assert len(set(ids)) == 10 and all(h["snippet"] for h in first.hits)


def test_tasks_sort_as_many_chunks_however_large_the_corpus(spark, tmp_path, monkeypatch):
    rows = spark.range(120).selectExpr("concat('f', id % 30, '.md#', id) AS chunk_id", "concat('f', id % 30, '.md') AS filepath", "'H' AS heading", "2 AS heading_level", "concat('a b a n', id) AS content", "concat('a b a n', id) AS content_text", "'f' AS breadcrumb", "cast(id / 30 AS int) AS chunk_index", "map('language', 'en') AS metadata")
    monkeypatch.setattr(index, "SORTED_CHUNKS", 20)
    monkeypatch.setattr(index, "GROUPED_TERMS", 50)
    made = index.build(rows, str(tmp_path), partitions=2)
    got = made.table("postings")
    assert len(got.inputFiles()) > 2 and got.count() == 120 * 4
    assert got.groupBy("term").count().where("count = 120").count() == 3
    assert segments._parts(50_000) > 8


def test_postings_by_brute_force(spark):
    rows = [("a#1", "One two, one", "b a b"), ("a#2", None, ""), ("a#3", "", "x " * 50)]
    got = {(r.term, r.field, r.chunk_id): (r.dl, r.tf, list(r.positions)) for r in index.postings(spark.createDataFrame(rows, "chunk_id string, heading string, content_text string")).collect()}
    want = {}
    for i, *texts in rows:
        for field, text in zip(index.FIELDS, texts, strict=True):
            words = [w.strip(",") for w in (text or "").lower().split()]
            for w in set(words):
                at = [k for k, x in enumerate(words) if x == w]
                want[w, field, i] = (len(words), len(at), at)
    assert got == want


# ------------------------------------------------------------------ providers and the inverted file
def test_remote_provider():
    waits, calls = [], []

    def serve(texts):
        calls.append(list(texts))
        if len(calls) == 1:
            raise vectors.RemoteError(429, "7")
        if len(calls) == 2:
            raise vectors.RemoteError(503)
        return [(i, [float(len(t))]) for i, t in reversed(list(enumerate(texts)))]

    p = vectors.CallableProvider(serve, 1, most_chars=4, sleep=waits.append)
    assert p.embed(["a", "bbbbbbbb", "cc"]) == [[1.0], [4.0], [2.0]]
    assert waits == [7.0, 2 * vectors.FIRST_WAIT] and len(calls) == 3

    def refuse(texts):
        calls.append(texts)
        raise vectors.RemoteError(401)

    calls.clear()
    with pytest.raises(vectors.RemoteError):
        vectors.CallableProvider(refuse, 1, sleep=waits.append).embed(["a"])
    assert len(calls) == 1
    with pytest.raises(ValueError, match="dimensions"):
        vectors.CallableProvider(lambda ts: [[1.0, 2.0] for _ in ts], 1).embed(["a"])
    with pytest.raises(ValueError, match="each text"):
        vectors.CallableProvider(lambda ts: [(5, [1.0]) for _ in ts], 1).embed(["a"])


def test_backoff():
    assert [vectors.backoff(k) for k in range(3)] == [vectors.FIRST_WAIT * x for x in (1, 2, 4)]
    now = datetime(2026, 1, 1, tzinfo=UTC)
    assert vectors.backoff(0, "Thu, 01 Jan 2026 00:00:30 GMT", now) == 30.0
    assert vectors.backoff(1, "soon") == 2 * vectors.FIRST_WAIT
    assert [vectors.retryable(s) for s in (200, 400, 429, 500, 599, 600)] == [False, False, True, True, True, False]


def test_batches_keep_their_order():
    p = vectors.CallableProvider(lambda ts: [[float(t)] for t in ts], 1, batch=3)
    assert p.embed([str(i) for i in range(50)]) == [[float(i)] for i in range(50)]


def test_cells_find_near_rows(spark):
    rows = adapters.read(spark, "/root/testdata/sf0.01", "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("vector"))
    centres = vectors.fit_cells(rows)
    indexed = vectors.with_cells(rows, centres).persist()
    assert indexed.where("cell < 0").count() == rows.where("vector is null or size(vector) = 0").count()
    queries = [r.vector for r in rows.where("vector is not null").orderBy("chunk_id").limit(8).collect()]
    found = []
    for q in queries:
        exact = {r.chunk_id for r in vectors.nearest(rows, q, 10).collect()}
        found.append(len(exact & {r.chunk_id for r in vectors.nearest_in_cells(indexed, centres, q, 10).collect()}) / 10)
    assert np.mean(found) >= 0.9
    assert vectors.fit_cells(rows.limit(50)) is None


# ------------------------------------------------------------------ evaluation
def test_tool_calls_meet_their_answers(spark):
    calls = spark.createDataFrame([("s", 1, "a", "mcp__x__f"), ("s", 2, "b", "Bash"), ("s", 3, "c", "mcp__x__f")], "scenario string, seq int, call_id string, name string")
    answers = spark.createDataFrame([("s", 5, "a", "late"), ("s", 4, "a", "first"), ("s", 4, "b", "out"), ("t", 4, "c", "other")], "scenario string, seq int, call_id string, result string")
    pairs = agent_eval.paired(calls, answers)
    assert {r.call_id: r.result for r in pairs.collect()} == {"a": "first", "b": "out", "c": None}
    assert [tuple(r) for r in agent_eval.volumes(pairs).collect()] == [("s", 2, 5)]


def test_scenarios_included(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "id string")
    assert agent_eval.included(rows, None).count() == 2 and agent_eval.included(rows, " b ,").count() == 1
    with pytest.raises(ValueError):
        agent_eval.included(rows, "c")


def test_scripts_and_files(tmp_path, monkeypatch):
    assert agent_eval.script_assertion("test -d .", str(tmp_path)) is True
    assert agent_eval.script_assertion("exit 3", str(tmp_path)) is False
    assert agent_eval.script_assertion("sleep 5", str(tmp_path), timeout=0.1) is False
    monkeypatch.delenv("NOT_SET_HERE", raising=False)
    assert agent_eval.script_assertion("exit 3", str(tmp_path), "NOT_SET_HERE") is None
    (tmp_path / "a.py").write_text("x" * 6000)
    (tmp_path / "b.txt").write_text("short")
    got = agent_eval.file_contents(str(tmp_path), ["a.py", "b.txt", "none.md", "../../etc/passwd"])
    assert [(f["path"], len(f["content"]), f["language"], f["cut"]) for f in got] == [("a.py", 5000, "python", True), ("b.txt", 5, "txt", False)]


def test_report_text(spark):
    usage = spark.createDataFrame([("Bash", 2), ("search", 4), ("get", 0)], "tool string, calls long")
    assert agent_eval.usage_chart(usage, 4) == ["search  ████ 4", "Bash    ██ 2"]
    assert agent_eval.wrapped("one two three fourteen", 8) == ["one two", "three", "fourteen"]
    assert agent_eval.wrapped("abcdefghij k", 4) == ["abcd", "efgh", "ij k"]
    assert agent_eval.plain("\x1b[31mred\x1b[0m") == "red" and len(agent_eval.padded("\x1b[31mred\x1b[0m", 5)) == 14
    assert [agent_eval.spoken(x) for x in (5, 1500, 61_000, 999.6, 59_960, 119_600, 3_599_700)] == ["5ms", "1.5s", "1m 1s", "1.0s", "1m 0s", "2m 0s", "60m 0s"]


def test_baseline_and_memory(spark, tmp_path):
    cases = spark.createDataFrame([("a", ["a", "b"], 1, "one", None), ("c", ["a", "b"], 4, "two", "x")], "expected string, ranked array<string>, rounds int, name string, category string")
    one = evaluate.summary(cases)
    path = str(tmp_path / "base.json")
    evaluate.save_summary(one, path)
    assert all(r.delta == 0 for r in evaluate.delta(one, evaluate.read_summary(spark, path)).collect())
    with evaluate.PeakMemory() as memory:
        np.ones(20_000_000).sum()
    assert memory.mb and memory.mb > 100


def test_the_last_of_equal_names_counts(spark):
    schema = "expected string, ranked array<string>, rounds int, name string, category string"
    before = spark.createDataFrame([("a", ["b"], 4, "n", None), ("a", ["a"], 1, "n", None)], schema).coalesce(1)
    now = spark.createDataFrame([("a", ["b"], 4, "n", None)], schema)
    assert [(r.name, r.kind) for r in evaluate.flips(now, before).collect()] == [("n", "regression")]


# ------------------------------------------------------------------ metadata and whole runs
def test_taxonomy_values(spark):
    rows = spark.createDataFrame([({"k": v},) for v in ("b", "A", "a", "é", "Z", "e", "")], "metadata map<string,string>")
    assert list(metadata.taxonomy(rows).first()["values"]) == ["a", "A", "b", "e", "é", "Z"] == sorted(["b", "A", "a", "é", "Z", "e"], key=metadata.collation_key)
    many = spark.range(2000).select(F.create_map(F.lit("k"), F.col("id").cast("string")).alias("metadata"))
    assert len(metadata.taxonomy(many).first()["values"]) == metadata.MOST_VALUES + 1


def test_other_manifest_names_and_the_cache(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.md").write_text("# A\n\none\n\n# B\n\ntwo\n")
    (docs / "own.json").write_text(json.dumps({"version": "1", "strategy": {"chunk_by": "h1"}}))
    assert build.validate(spark, str(docs), "own.json").warnings == []
    assert build.validate(spark, str(docs)).warnings
    made, there = build.cached_index(spark, str(docs), str(tmp_path / "cache"), "x", manifest_name="own.json")
    assert not there and made.table("heads").count() == made.table("chunks").count() == 2
    again, there = build.cached_index(spark, str(docs), str(tmp_path / "cache"), "x", manifest_name="own.json")
    assert there and again.path == made.path
    (docs / "a.md").write_text("# A\n\nother\n")
    assert not build.cached_index(spark, str(docs), str(tmp_path / "cache"), "x", manifest_name="own.json")[1]
    path = str(tmp_path / "chunks.json")
    assert index.export_json_array(made.table("chunks"), path) == 2
    with open(path, encoding="utf-8") as f:
        assert {c["heading"] for c in json.load(f)} == {"A", "B"}
    asked = []

    class Listening(search.Engine):
        def search(self, request):
            asked.append((request.query, request.limit))
            return super().search(request)

    assert build.warm_up(Listening(made), [{"query": "one"}, {"query": "", "limit": 3}, {"query": "two", "limit": 9}], 5) == 5
    assert asked == [("one", 5), ("", 3), ("two", 5), ("one", 5), ("", 3)]  # in turn; one that fails doesn't stop the rest
    assert build.warm_up(Listening(made), [], 5) == 0
    assert os.path.exists(path) and not os.path.exists(f"{path}.tmp")
