"""Reading little: one file for a lookup by id, few blocks for the best hits."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import documents, index, search, segments
from scriptorium.sources.adapters import CHUNK_SCHEMA

WORDS = "alpha beta gamma delta retry backoff limit page token".split()


def corpus(spark, files=60, chunks=20, seed=3):
    g = random.Random(seed)
    rows = []
    for f in range(files):
        rare = g.random() < 0.15
        for i in range(chunks):
            text = " ".join(g.choice(WORDS) for _ in range(g.randrange(3, 25))) + (" needle" * g.randrange(0, 4) if rare else "") + (" needle" if g.random() < 0.02 else "")
            rows.append((f"d{f % 7}/f{f}.md#s{i}", f"d{f % 7}/f{f}.md", g.choice(WORDS), 2, text, text, "x", i, {"language": g.choice(["en", "de"])}))
    return spark.createDataFrame(rows, CHUNK_SCHEMA)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    return index.build(corpus(spark), str(tmp_path_factory.mktemp("index")), partitions=8)


def files_read(df):
    """Files that the scans of a plan read, by their metrics."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def test_a_lookup_reads_one_file(spark, made):
    assert files_read(made.table("chunks").select("chunk_id")) == 8
    for path in ("d1/f1.md", "d3/f45.md"):
        rows = made.chunks_of([path])
        assert files_read(rows.where(F.col("chunk_id") == f"{path}#s7").select("content")) == 1
        assert files_read(rows.where("chunk_index between 3 and 5").select("content")) == 1
        assert rows.count() == 20 and set(rows.columns) == set(made.table("chunks").columns)
    assert files_read(made.chunks_of(["no/such.md"]).select("content")) <= 1
    assert made.chunks_of(["d1/f1.md", "d2/f2.md"]).select("filepath").distinct().count() == 2


def test_lookups_give_what_scans_give(spark, made, tmp_path):
    chunk_id = "d3/f45.md#s7"
    for context in (0, 2, -1):
        assert documents.get_doc_of(made, chunk_id, context) == documents.get_doc(made.table("chunks"), chunk_id, context)
    with pytest.raises(documents.NotFound):
        documents.get_doc_of(made, "d3/f45.md#none")
    with pytest.raises(ValueError, match="invalid format"):
        documents.get_doc_of(made, "a b")
    rows = made.table("chunks")
    for part in ("chunk_index % 2 = 0", "chunk_index % 2 = 1"):
        some = rows.where("filepath <> 'd3/f45.md'").where(part) if "1" in part.split("= ")[1] else rows.where(part)
        segments.update(spark, str(tmp_path), some.where(F.crc32("filepath") % 2 == int(part[-1])), rows.where(F.crc32("filepath") % 2 == int(part[-1])).select("filepath"))
    view = segments.SegmentedIndex(spark, str(tmp_path))
    path = view.table("heads").first()["filepath"]
    assert view.chunks_of([path]).count() == view.table("chunks").where(F.col("filepath") == path).count() > 0


@pytest.mark.parametrize("query", ["needle", "alpha beta", "retry needle limit", "nothing", "", "needle nothing alpha"])
@pytest.mark.parametrize("k", [1, 10, 300])
def test_the_best_are_those_of_the_whole_list(made, query, k):
    got = search.match_best(made, query, k)
    want = search.match_index(made, query, None).orderBy(F.desc("score"), "chunk_id").limit(k)
    assert [tuple(r) for r in got.rows.orderBy(F.desc("score"), "chunk_id").collect()] == [tuple(r) for r in want.collect()]
    assert got.read <= got.blocks


def test_blocks_are_left_out(spark, tmp_path):
    made = index.build(corpus(spark, 150, 40, 5), str(tmp_path), partitions=4)
    got = search.match_best(made, "needle", 5)
    assert got.blocks >= 30 and got.read < got.blocks / 2
    allowed = made.table("heads").where(F.col("metadata")["language"] == "en").select("chunk_id")
    some = search.match_best(made, "needle alpha", 10, allowed)
    want = search.match_index(made, "needle alpha", allowed).orderBy(F.desc("score"), "chunk_id").limit(10)
    assert sorted(map(tuple, some.rows.collect())) == sorted(map(tuple, want.collect()))
    capped, whole = search.Engine(made, capped=True), search.Engine(made)
    ids = [[h["chunk_id"] for h in e.search(search.Request("needle retry", {"language": "en"}, 10)).hits] for e in (capped, whole)]
    assert ids[0] == ids[1]
