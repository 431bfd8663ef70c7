"""Segments: after any updates and merges the index is what a full build of the same files gives."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import chunking, documents, incremental, index, search, segments
from scriptorium.sources.storage import Store
from scriptorium.streaming import indexer

FILES = "path string, markdown string, strategy struct<chunk_by:string,max_chunk_size:int,min_chunk_size:int>, metadata map<string,string>"
WORDS = "alpha beta gamma delta retry backoff the of and token page limit".split()


def text(g, n=4):
    return "\n\n".join(f"## {g.choice(WORDS)} {i}\n\n" + " ".join(g.choice(WORDS) for _ in range(g.randrange(3, 30))) for i in range(g.randrange(1, n + 1)))


def frame(spark, files):
    return spark.createDataFrame([(p, t, ("h2", None, None), {"language": "en" if len(t) % 2 else "de"}) for p, t in sorted(files.items())], FILES)


def rows(df):
    return sorted(map(str, df.collect()))


def same_as_full(spark, base, files, tmp, manifest=None):
    view = segments.SegmentedIndex(spark, base, manifest)
    full = index.build(incremental.rechunk(frame(spark, files)), str(tmp))
    for name, columns in (("chunks", ["chunk_id", "content", "chunk_index", "file_fingerprint"]), ("heads", ["chunk_id", "heading", "breadcrumb"]), ("postings", ["term", "field", "chunk_id", "dl", "tf", "positions"]), ("terms", ["term", "field", "df"]), ("fields", ["field", "n", "avgdl"])):
        assert rows(view.table(name).select(*columns)) == rows(full.table(name).select(*columns)), name
    for q in ("retry backoff", "the of"):
        assert rows(search.match_index(view, q, None)) == rows(search.match_index(full, q, None))
        assert rows(search.phrase_index(view, q, 1, None)) == rows(search.phrase_index(full, q, 1, None))
    return view, full


def test_updates_and_merges_equal_a_full_build(spark, tmp_path):
    g, base = random.Random(4), str(tmp_path / "index")
    files = {f"d/f{i}.md": text(g) for i in range(30)}
    segments.sync(spark, base, frame(spark, files))
    kept = {}
    for step in range(7):
        for p in g.sample(sorted(files), 3):
            if g.random() < 0.3:
                del files[p]
            else:
                files[p] = text(g)
        files[f"d/new{step}.md"] = text(g)
        got = segments.sync(spark, base, frame(spark, files))
        kept[got.index.manifest.version] = dict(files)
        assert got.changed >= 1
    m = segments.latest(spark, base)
    assert 1 <= len(m.segments) <= 5
    same_as_full(spark, base, files, tmp_path / "full")
    # An older version is still what it was.
    v = sorted(kept)[2]
    same_as_full(spark, base, kept[v], tmp_path / "old", segments.latest(spark, base, v))
    assert segments.sync(spark, base, frame(spark, files)).changed == 0
    assert segments.latest(spark, base).version == m.version


def test_a_small_change_writes_little(spark, tmp_path):
    g, base = random.Random(8), str(tmp_path / "index")
    files = {f"d/f{i}.md": "\n\n".join(text(g, 12) for _ in range(25)) for i in range(200)}
    segments.sync(spark, base, frame(spark, files))
    before = Store(spark, base).size("")
    for p in ("d/f7.md", "d/f99.md"):
        files[p] = files[p] + "\n\n## more\n\nretry backoff"
    segments.sync(spark, base, frame(spark, files))
    assert Store(spark, base).size("") - before < 0.05 * before
    same_as_full(spark, base, files, tmp_path / "full")


def test_search_and_retrieval_over_segments(spark, tmp_path):
    base = str(tmp_path / "index")
    files = {"a.md": "# A\n\n## Retry\n\nretry with backoff", "b.md": "# B\n\n## Limits\n\npage limit"}
    segments.sync(spark, base, frame(spark, files))
    files["b.md"] = "# B\n\n## Limits\n\nretry backoff retry backoff"
    view = segments.sync(spark, base, frame(spark, files)).index
    hits = search.Engine(view).search(search.Request("retry backoff")).hits
    assert [h["filepath"] for h in hits] == ["b.md", "a.md"]
    assert search.Engine(view).search(search.Request("page limit", {})).hits == [] or all(h["filepath"] == "b.md" for h in search.Engine(view).search(search.Request("limit")).hits)
    assert "retry backoff retry" in documents.get_doc(view.table("chunks"), hits[0]["chunk_id"])


def test_an_empty_index_and_files_without_text(spark, tmp_path):
    base = str(tmp_path / "index")
    view = segments.SegmentedIndex(spark, base)
    assert view.table("chunks").count() == view.table("terms").count() == view.table("fields").count() == 0
    files = {"a.md": "## A\n\nalpha", "b.md": ""}
    segments.sync(spark, base, frame(spark, files))
    segments.sync(spark, base, frame(spark, {}))
    assert segments.latest(spark, base).segments == ()
    assert segments.SegmentedIndex(spark, base).table("heads").count() == 0
    segments.sync(spark, base, frame(spark, files))
    same_as_full(spark, base, files, tmp_path / "full")


def test_two_writers_and_failed_updates(spark, tmp_path):
    base = str(tmp_path / "index")
    segments.sync(spark, base, frame(spark, {"a.md": "## A\n\nalpha"}))
    m = segments.latest(spark, base)
    segments.publish(spark, base, m)
    with pytest.raises(segments.Conflict):
        segments.publish(spark, base, m)
    chunks = incremental.rechunk(frame(spark, {"b.md": "## B\n\nbeta"}))
    with pytest.raises(ValueError, match="doesn't touch"):
        segments.update(spark, base, chunks, spark.createDataFrame([("c.md",)], "filepath string"))
    assert len(segments.latest(spark, base).segments) == 1
    gone = segments.clean(spark, base)
    assert any(x.startswith("segments/") for x in gone)
    same_as_full(spark, base, {"a.md": "## A\n\nalpha"}, tmp_path / "full")


def test_tiers():
    s = lambda i, n, dead=0: segments.Segment(f"s{i}", i, n, dead)
    assert segments.due(segments.Manifest(segments=(s(1, 100_000), s(2, 10), s(3, 10), s(4, 10)))) == []
    assert [x.seq for x in segments.due(segments.Manifest(segments=(s(1, 100_000), s(2, 10), s(3, 10), s(4, 10), s(5, 900))))] == [2, 3, 4, 5]
    assert [x.seq for x in segments.due(segments.Manifest(segments=(s(1, 100, 50), s(2, 10_000))))] == [1]


def test_a_stream_into_the_index(spark, tmp_path):
    """Batches of files, versions and removals, with restarts and a replay: as if all had been there at once."""
    g = random.Random(6)
    base, inbox, checkpoint = (str(tmp_path / n) for n in ("index", "inbox", "checkpoint"))
    schema = "path string, markdown string, modified int, deleted boolean"
    files, clock = {}, 0

    def deliver(step):
        nonlocal clock
        out = []
        for p in [f"d/f{g.randrange(12)}.md" for _ in range(6)]:
            clock += 1
            off = g.random() < 0.2
            t = text(g)
            out.append((p, t, clock, off))
            files.pop(p, None)
            if not off:
                files[p] = t
        g.shuffle(out)
        spark.createDataFrame(out, schema).coalesce(1).write.mode("append").json(f"{inbox}/step={step}")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{inbox}/*")
        indexer.start_index(stream, base, checkpoint, "s", chunking.Strategy("h2")).awaitTermination()

    for step in range(5):
        deliver(step)
        run()
        if step == 2:
            applied = segments.latest(spark, base)
            again = spark.createDataFrame([("d/f0.md", "## replayed\n\nnot again", 0, False)], schema).select("path", "markdown", F.struct(F.lit("h2").alias("chunk_by"), F.lit(None).cast("int").alias("max_chunk_size"), F.lit(None).cast("int").alias("min_chunk_size")).alias("strategy"), F.create_map().cast("map<string,string>").alias("metadata"))
            segments.sync(spark, base, again, False, None, "s", applied.applied["s"])
            assert segments.latest(spark, base) == applied
    assert segments.latest(spark, base).applied["s"] == 4
    want = spark.createDataFrame([(p, t, ("h2", None, None), {}) for p, t in sorted(files.items())], FILES)
    full = index.build(incremental.rechunk(want), str(tmp_path / "full"))
    view = segments.SegmentedIndex(spark, base)
    for name in ("terms", "fields"):
        assert rows(view.table(name).select(*full.table(name).columns)) == rows(full.table(name))
    assert rows(search.match_index(view, "retry the page", None)) == rows(search.match_index(full, "retry the page", None))
