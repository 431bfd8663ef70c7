"""The index of vectors: recall, exactness where all cells are looked into, skew, and its use in search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import index, quantised, search, vectors
from scriptorium.sources.adapters import CHUNK_SCHEMA


def brute(ids, x, q, k):
    d = np.sqrt(((x.astype(np.float32).astype(float) - np.asarray(q, float)) ** 2).sum(1))
    return sorted(zip(d, ids, strict=True))[:k]


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")


@pytest.fixture(scope="module")
def near(spark, embeddings, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("near"))
    model = quantised.save(embeddings, path, "embedding", "vec_id", 4)
    return spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/sizes"), model, path


def test_every_row_is_indexed(embeddings, near):
    cells, sizes, model, _ = near
    assert cells.count() == embeddings.count() == sizes.agg(F.sum("n")).first()[0]
    assert cells.select("vec_id").distinct().count() == cells.count()
    assert model.codebooks.shape == (16, 256, 4)


def test_the_model_is_read_as_it_was_written(spark, near):
    again = quantised.load(spark, near[3])
    assert again.dimensions == near[2].dimensions
    assert np.array_equal(again.centres, near[2].centres) and np.array_equal(again.codebooks, near[2].codebooks)


def test_recall_of_ten(embeddings, near):
    cells, sizes, model, _ = near
    rows = embeddings.select("vec_id", "embedding").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows])
    asked = embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = quantised.nearest_many(cells, sizes, model, asked, 10, key="vec_id").collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.distance))
    hit = []
    for q, found in by.items():
        want = brute(ids, x, x[ids.index(q)], 10)
        assert [f[0] for f in sorted(found)] == list(range(1, 11))
        hit.append(len({v for _, v, _ in found} & {i for _, i in want}) / 10)
        for _, v, d in found:  # distances are those of the vectors
            assert d == pytest.approx(float(np.linalg.norm(x[ids.index(v)] - x[ids.index(q)])), abs=1e-9)
    assert len(hit) == 100
    assert np.mean(hit) >= 0.9


def test_one_query_and_many_agree(spark, embeddings, near):
    cells, sizes, model, _ = near
    for q in (0, 7):
        v = [float(x) for x in embeddings.where(f"vec_id = {q}").first().embedding]
        one = [(r.vec_id, round(r.distance, 9)) for r in quantised.nearest(cells, model, v, 10, key="vec_id").collect()]
        asked = spark.createDataFrame([(q, v)], "query_id long, vector array<double>")
        many = quantised.nearest_many(cells, sizes, model, asked, 10, key="vec_id").orderBy("rank").collect()
        assert one == [(r.vec_id, round(r.distance, 9)) for r in many]
    assert quantised.nearest(cells, model, [0.0] * 3, 10, key="vec_id").count() == 0


def test_all_cells_give_the_exact_answer(embeddings, near):
    cells, _, model, _ = near
    rows = embeddings.select("vec_id", "embedding").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows])
    got = quantised.nearest(cells, model, x[5].tolist(), 20, len(model.centres), 2000, key="vec_id").collect()
    assert [(r.vec_id, round(r.distance, 9)) for r in got] == [(i, round(d, 9)) for d, i in brute(ids, x, x[5], 20)]


def test_only_allowed_rows(embeddings, near):
    cells, sizes, model, _ = near
    allowed = embeddings.where("label = 1").select("vec_id")
    mine = {r.vec_id for r in allowed.collect()}
    v = [float(x) for x in embeddings.where("vec_id = 3").first().embedding]
    assert {r.vec_id for r in quantised.nearest(cells, model, v, 15, len(model.centres), allowed=allowed, key="vec_id").collect()} <= mine
    asked = embeddings.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    assert {r.vec_id for r in quantised.nearest_many(cells, sizes, model, asked, 15, allowed=allowed, key="vec_id").collect()} <= mine


def test_many_equal_vectors_and_odd_rows(spark, tmp_path, monkeypatch):
    """A third of all vectors is one and the same: its cell is cut into parts; what is no vector takes no part."""
    monkeypatch.setattr(quantised, "PART_ROWS", 40)
    monkeypatch.setattr(quantised, "QUERY_BLOCK", 7)
    g = np.random.default_rng(1)
    data = [(f"v{i:04}", [1.0] * 6 if i % 3 == 0 else g.normal(size=6).tolist()) for i in range(600)]
    odd = [("n1", None), ("n2", []), ("n3", [1.0, 2.0]), ("n4", [float("nan")] * 6), ("n5", [float("inf")] * 6), ("n6", [None] * 6)]
    rows = spark.createDataFrame(data + odd, "chunk_id string, vector array<double>")
    model = quantised.save(rows, str(tmp_path / "x"))
    cells, sizes = spark.read.parquet(f"{tmp_path}/x/cells"), spark.read.parquet(f"{tmp_path}/x/sizes")
    assert cells.count() == 600
    assert sizes.agg(F.max("part")).first()[0] >= 4 and sizes.agg(F.max("n")).first()[0] < 120
    asked = spark.createDataFrame([(i, data[i][1]) for i in range(0, 60)] + [(99, None)], "query_id int, vector array<double>")
    got = quantised.nearest_many(cells, sizes, model, asked, 5).collect()
    assert len(got) == 60 * 5
    ids, x = [d[0] for d in data], np.array([d[1] for d in data])
    same = sorted((r["rank"], r.chunk_id) for r in got if r.query_id == 0)
    assert [c for _, c in same] == [i for _, i in brute(ids, x, x[0], 5)]  # ties go to the smaller key
    assert quantised.save(rows.limit(100), str(tmp_path / "few")) is None
    assert quantised.save(rows.where("false"), str(tmp_path / "none")) is None


@pytest.mark.parametrize("group", [37, 20_000])
def test_exact_search_misses_none(spark, tmp_path, monkeypatch, group):
    """Many clusters of vectors that their codes don't tell apart: the best by codes aren't the nearest."""
    monkeypatch.setattr(quantised, "GROUP_ROWS", group)
    monkeypatch.setattr(quantised, "QUERY_BLOCK", 9)
    g = np.random.default_rng(2)
    x = np.repeat(g.normal(size=(3, 8)), 400, 0) + 1e-4 * g.normal(size=(1200, 8))
    x[::50] = g.normal(size=(24, 8)) * 100  # spreads the codebooks' entries
    x[7] = x[8]
    x = x.astype(np.float32).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<double>")
    monkeypatch.setattr(quantised, "ENTRIES", 4)
    model = quantised.save(rows, str(tmp_path / "x"), key="vec_id")
    cells, sizes = spark.read.parquet(f"{tmp_path}/x/cells"), spark.read.parquet(f"{tmp_path}/x/sizes")
    asked = rows.where("vec_id % 61 = 7").select(F.col("vec_id").alias("query_id"), "vector")
    got = {}
    for r in quantised.nearest_many(cells, sizes, model, asked, 10, key="vec_id", exact=True).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert len(got) == asked.count()
    for q, found in got.items():
        assert [i for _, i in sorted(found)] == [i for _, i in brute(range(len(x)), x, x[q], 10)]
    some = rows.where("vec_id % 3 = 0").select("vec_id")
    assert {r.vec_id % 3 for r in quantised.nearest_many(cells, sizes, model, asked, 10, allowed=some, key="vec_id", exact=True).collect()} == {0}


def numbers():
    class Numbers:  # within a function, so that workers get it by value
        name, dimensions = "numbers", 8

        def embed(self, texts):
            return [[float(len(t) % 7), *(float(t.count(c)) for c in "abcdefg")] for t in texts]

    return Numbers()


def test_search_uses_it(spark, tmp_path):
    words = ["abba", "cafe", "deed", "gaga", "bead", "fade"]
    rows = [(f"f{i % 9}.md#{i}", f"f{i % 9}.md", "H", 2, t, t, "f > H", i // 9, {"language": "en" if i % 2 else "de"}) for i in range(400) for t in [" ".join(words[(i * k) % 6] for k in range(1, 2 + i % 5)) + f" n{i}"]]
    chunks = spark.createDataFrame(rows, CHUNK_SCHEMA)
    vecs = vectors.embedded(chunks, "content_text", numbers()).select("chunk_id", "vector")
    made = index.build(chunks, str(tmp_path), vectors=vecs)
    assert made.near() is not None
    fast, exact = search.Engine(made, provider=numbers()), search.Engine(made, provider=numbers(), exact=True)
    for q, filters in (("abba cafe", {}), ("gaga bead fade", {"language": "en"})):
        a, b = ([h["chunk_id"] for h in e.search(search.Request(q, filters, 10)).hits] for e in (fast, exact))
        assert len(set(a) & set(b)) >= 9
    asked = spark.createDataFrame([(1, "abba cafe"), (2, "gaga bead fade"), (3, "")], "query_id int, query string")
    many = search.search_many(made, asked, 10, provider=numbers(), exact=True).collect()
    for i, q in ((1, "abba cafe"), (2, "gaga bead fade")):
        want = [h["chunk_id"] for h in exact.search(search.Request(q, {}, 10)).hits]
        assert len({r.chunk_id for r in many if r.query_id == i} & set(want)) >= 9
    english = search.search_many(made, asked, 10, provider=numbers(), filters={"language": "en"}).collect()
    assert english and all(int(r.chunk_id.split("#")[1]) % 2 == 1 for r in english)
    few = index.build(chunks.limit(50), str(tmp_path / "few"), vectors=vecs)
    assert few.near() is None
    assert search.search_many(few, asked, 3, provider=numbers()).count() == 6
