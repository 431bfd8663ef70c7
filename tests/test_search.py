import random

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import collapse, cursor, documents, facets, index, search, vectors
from scriptorium.sources.adapters import CHUNK_SCHEMA


def row(cid, heading="H", content="", index=0, **metadata):
    path = cid.split("#")[0]
    return (cid, path, heading, 2, content, content, f"{path} > {heading}", index, metadata)


@pytest.fixture(scope="module")
def chunks(spark):
    """Five pages on glazing: of two studios, for everyone, without any facet, and of a studio but without a scope."""
    return spark.createDataFrame(
        [
            row("studio/oslo.md#celadon", "Celadon", "celadon glaze needs a slow kiln and ash", language="oslo", scope="sdk-specific"),
            row("house/rules.md#glaze", "Glazing", "every glaze is mixed by weight", scope="global-guide"),
            row("studio/kyoto.md#tenmoku", "Tenmoku", "tenmoku glaze on dark clay", language="kyoto", scope="sdk-specific"),
            row("attic/notes.md#glaze", "Notes", "an old glaze recipe"),
            row("attic/kyoto.md#glaze", "Notes", "an old glaze recipe for dark clay", language="kyoto"),
        ],
        CHUNK_SCHEMA,
    )


@pytest.fixture(scope="module")
def engine(spark, chunks, tmp_path_factory):
    return search.Engine(index.build(chunks, str(tmp_path_factory.mktemp("index"))))


def ids(result):
    return sorted(h["chunk_id"] for h in result.hits)


@pytest.mark.parametrize("kind", ["scan", "index"])
@pytest.mark.parametrize(
    ("filters", "taxonomy", "wanted"),
    [
        ({}, None, 5),
        ({"language": "oslo"}, None, ["attic/notes.md#glaze", "house/rules.md#glaze", "studio/oslo.md#celadon"]),
        ({"language": "kyoto"}, None, ["attic/kyoto.md#glaze", "attic/notes.md#glaze", "house/rules.md#glaze", "studio/kyoto.md#tenmoku"]),
        ({"language": "oslo"}, ["language"], ["studio/oslo.md#celadon"]),
        ({"scope": "global-guide"}, None, ["house/rules.md#glaze"]),
        ({"language": "kyoto", "scope": "sdk-specific"}, None, ["studio/kyoto.md#tenmoku"]),
    ],
)
def test_filters_take_in_what_holds_for_all(chunks, engine, kind, filters, taxonomy, wanted):
    got = ids((engine if kind == "index" else search.ScanEngine(chunks)).search(search.Request("glaze", filters, taxonomy=taxonomy)))
    assert len(got) == wanted if isinstance(wanted, int) else got == wanted


@pytest.mark.parametrize("limit", [1, 2, 3, 4, 5, 6])
def test_pages_joined_are_the_list(chunks, limit):
    e = search.ScanEngine(chunks)
    whole = [h["chunk_id"] for h in e.search(search.Request("glaze", limit=20)).hits]
    got, after, pages = [], None, 0
    while pages == 0 or after:
        r = e.search(search.Request("glaze", limit=limit, cursor=after))
        got, after, pages = got + [h["chunk_id"] for h in r.hits], r.next_cursor, pages + 1
    assert got == whole and len(whole) == 5 and pages == -(-5 // limit)
    first = e.search(search.Request("glaze", limit=2)).next_cursor
    with pytest.raises(cursor.BadCursor):
        e.search(search.Request("clay", cursor=first))
    with pytest.raises(cursor.BadCursor):
        e.search(search.Request("glaze", {"language": "oslo"}, cursor=first))


def test_hints(chunks, engine):
    for e in (search.ScanEngine(chunks), engine):
        none = e.search(search.Request("ash", {"language": "kyoto", "scope": "sdk-specific"}))
        assert none.hits == []
        assert none.hint["suggested_filters"] == {"language": ["oslo"]}
        assert "with filters language='kyoto', scope='sdk-specific'" in none.hint["message"]
        assert "No matches" in e.search(search.Request("porcelain")).hint["message"]
    with pytest.raises(ValueError, match="query is required"):
        engine.search(search.Request(" \n"))


def test_words_in_a_row_count_more_than_words_apart(spark, tmp_path):
    apart = row("far.md#1", "Far", "ash of pine then much later some glaze")
    near = row("near.md#1", "Near", "pine ash glaze is fired twice in there")
    e = search.Engine(index.build(spark.createDataFrame([apart, near], CHUNK_SCHEMA), str(tmp_path)))
    assert [h["filepath"] for h in e.search(search.Request("ash glaze")).hits] == ["near.md", "far.md"]
    reached = {slop: {r.chunk_id for r in search.phrase_index(e.index, "ash glaze", slop, None).collect()} for slop in range(7)}
    assert [s for s, got in reached.items() if "far.md#1" in got] == []  # six words stand between, slop ends at five
    assert all("near.md#1" in got for got in reached.values())


def test_index_and_scan_agree(spark, chunks, engine):
    for q in ("glaze", "old glaze recipe", "dark clay", "kiln porcelain"):
        a = {(r.chunk_id, round(r.score, 8)) for r in search.match_index(engine.index, q, None).collect()}
        assert a == {(r.chunk_id, round(r.score, 8)) for r in search.match_scan(chunks, q).collect()}
        for slop in (0, 2):
            a = {(r.chunk_id, r.score) for r in search.phrase_index(engine.index, q, slop, None).collect()}
            assert a == {(r.chunk_id, r.score) for r in search.phrase_scan(chunks, q, slop).collect()}


def test_headings_match(spark, tmp_path):
    rows = [row("k.md#1", "RakuKilnMark4", "no word of it"), row("w.md#1", "Wheel", "nor here")]
    e = search.Engine(index.build(spark.createDataFrame(rows, CHUNK_SCHEMA), str(tmp_path)))
    assert [h["chunk_id"] for h in e.search(search.Request("rakukilnmark4")).hits] == ["k.md#1"]


def test_vectors_take_part_and_may_fail(spark, tmp_path):
    class Fixed:
        name, dimensions = "fixed", 3

        def embed(self, texts):
            return [[0.0, 1.0, 0.0] for _ in texts]

    class Broken(Fixed):
        def embed(self, texts):
            raise RuntimeError("down")

    rows = spark.createDataFrame([row("a.md#1", "A", "alpha words"), row("b.md#1", "B", "other words")], CHUNK_SCHEMA)
    vecs = spark.createDataFrame([("a.md#1", [1.0, 0.0, 0.0]), ("b.md#1", [0.0, 1.0, 0.0])], "chunk_id string, vector array<float>")
    idx = index.build(rows, str(tmp_path), vectors=vecs)
    assert search.Engine(idx).search(search.Request("words")).hits[0]["chunk_id"] == "a.md#1"
    assert search.Engine(idx, provider=Fixed(), weights={"vector": 50}).search(search.Request("words")).hits[0]["chunk_id"] == "b.md#1"
    broken = search.Engine(idx, provider=Broken())
    assert [h["chunk_id"] for h in broken.search(search.Request("alpha")).hits] == ["a.md#1"]
    assert len(broken.warnings) == 1


def test_fusion(spark):
    a = spark.createDataFrame([("x", 2.0), ("y", 1.0)], "chunk_id string, score double")
    b = spark.createDataFrame([("y", 9.0)], "chunk_id string, score double")
    got = {r.chunk_id: r.score for r in search.fused([search.ranked(a, "match", None), search.ranked(b, "phrase", 5)]).collect()}
    assert got == {"x": round(1 / 61, 6), "y": round(1 / 62 + 1.25 / 61, 6)}


def plain_key(path, heading, part, facets):
    """The collapse key by its definition: facets' values that are segments of the path become *, heading and part follow."""
    if not all(facets.values()):
        return None
    segments = path.split("/")
    hit = False
    for value in facets.values():
        if value in segments:
            segments[segments.index(value)] = "*"  # the first one
            hit = True
    return ":".join(["/".join(segments), heading, *([str(part)] if part else [])]) if hit else None


def test_variant_keys_against_their_definition(spark):
    g = random.Random(12)
    cases = []
    for i in range(150):
        path = "/".join(g.choice(["kyoto", "oslo", "ware", "v1", "v2"]) for _ in range(g.randrange(1, 5))) + f"/{g.choice(['cups', 'kyoto'])}.md"
        facets = {"language": g.choice(["kyoto", "oslo", "", "lima"]), "version": g.choice(["v1", "v2", ""])}
        part = g.choice([0, 0, 2, 13])
        cases.append((path, g.choice(["", "Firing", "A:B"]), part, facets, f"{path}#x{i}" + (f"-part-{part}" if part else "")))
    df = spark.createDataFrame([(c[4], c[0], c[1], 2, "", "", "", 0, c[3]) for c in cases], CHUNK_SCHEMA)
    for keys in (["language"], ["language", "version"]):
        got = {r[0]: r[1] for r in df.select("chunk_id", collapse.variant_key(keys)).collect()}
        assert got == {c[4]: plain_key(c[0], c[1], c[2], {k: c[3][k] for k in keys}) for c in cases}
    assert df.select(collapse.variant_key([])).distinct().collect()[0][0] is None


def test_one_hit_for_all_variants(spark):
    rows = [row(f"ware/{town}/mug.md#m", "Throwing", "throw a mug", language=town) for town in ("kyoto", "oslo", "lima")] + [row("ware/all.md#m", "Throwing", "throw a mug too")]
    e = search.ScanEngine(spark.createDataFrame(rows, CHUNK_SCHEMA), ["language"])
    assert ids(e.search(search.Request("mug")))[0] == "ware/all.md#m" and len(e.search(search.Request("mug")).hits) == 2
    assert ids(e.search(search.Request("mug", {"language": "oslo"}))) == ["ware/all.md#m", "ware/oslo/mug.md#m"]


def test_documents(spark):
    df = spark.createDataFrame([row(f"a.md#{i}", f"H{i}", f"text {i}", i, scope="g") for i in range(4)], CHUNK_SCHEMA)
    assert documents.get_doc(df, "a.md#1", 1) == "--- Chunk: a.md#0 (Chunk 1 of 4) (Context: -1) ---\ntext 0\n\n--- Chunk: a.md#1 (Chunk 2 of 4) (Target) ---\ntext 1\n\n--- Chunk: a.md#2 (Chunk 3 of 4) (Context: +1) ---\ntext 2"
    assert documents.get_doc(df, "a.md#0", -1) == "text 0\n\ntext 1\n\ntext 2\n\ntext 3"
    with pytest.raises(documents.NotFound, match="not found"):
        documents.get_doc(df, "b.md")
    with pytest.raises(ValueError, match="invalid format"):
        documents.get_doc(df, "bad id")
    assert documents.read_resource(df, "docs:///a.md", [("scope", "g")]).startswith("text 0")
    with pytest.raises(documents.NotFound):
        documents.read_resource(df, "docs:///a.md", [("scope", "x")])
    with pytest.raises(ValueError, match="scheme"):
        documents.read_resource(df, "http://a", [])


def test_cursors():
    assert cursor.decode(cursor.encode(20, 10)) == (20, 10)
    c = cursor.encode_search(5, 10, " q ", {"a": "1"})
    assert cursor.decode_search(c, "q", {"a": "1"}) == 5
    for bad in ("", "%%%", cursor._pack({"offset": -1, "limit": 1}), cursor._pack({"offset": 1.5, "limit": 1}), cursor._pack({"offset": 0, "limit": 0}), cursor._pack([])):
        with pytest.raises(cursor.BadCursor):
            cursor.decode_search(bad, "q", {})


def test_text_functions(spark):
    df = spark.createDataFrame([("  A B\n c ",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.normalized(F.col("t"))).collect()] == ["a b c", "", None]
    assert T.normalize("  A B\n c ") == "a b c"
    long = "word " * 100 + "needle " + "word " * 100
    s = spark.createDataFrame([(long,)], "t string").select(T.snippet(F.col("t"), "needle")).first()[0]
    assert s.startswith("...") and s.endswith("...") and "needle" in s
    assert T.slugify("Hello, World -- again") == "hello-world-again"
    assert (T.clamp_limit(None), T.clamp_limit(0), T.clamp_limit(99), T.clamp_limit(2.5)) == (10, 1, 50, 10)


def test_unknown_filter_values():
    with pytest.raises(facets.UnknownValue, match="Allowed: go, python"):
        facets.validate({"language": "rust"}, {"language": ["go", "python"]})


def test_hash_vectors():
    v = vectors.hash_vector("abc", 4)
    assert abs(float(v @ v) - 1) < 1e-12
    assert not vectors.hash_vector("", 4).any()
    with pytest.raises(ValueError, match="Unknown embedding provider"):
        vectors.provider("other")
