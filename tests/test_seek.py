"""Pages by cursors that name the last hit: joined they are the whole list, also while the index changes."""

import pytest

from scriptorium.operators import cursor, index, search, segments
from scriptorium.sources.adapters import CHUNK_SCHEMA

FILTERS = {"language": "en"}


def rows(n, word="retry"):
    """Many hits of equal scores, whose ids the collation orders otherwise than bytes do."""
    names = ["b", "B", "a", "A", "é", "z", "Z", "_x", "1"]
    return [(f"{names[i % 9]}{i // 9}.md#s", f"{names[i % 9]}{i // 9}.md", "H", 2, f"{word} " + "page " * (i % 3), f"{word} " + "page " * (i % 3), "x", 0, {"language": "en" if i % 4 else "de"}) for i in range(n)]


def pages(engine, query, filters, limit):
    out, after = [], None
    while True:
        r = engine.search(search.Request(query, filters, limit, after))
        out += [h["chunk_id"] for h in r.hits]
        after = r.next_cursor
        if after is None:
            return out
        yield out, after


def all_pages(engine, query, filters, limit):
    it = pages(engine, query, filters, limit)
    while True:
        try:
            next(it)
        except StopIteration as e:
            return e.value


@pytest.mark.parametrize("filters", [{}, FILTERS])
def test_pages_joined_are_the_whole_list(spark, tmp_path, filters):
    made = index.build(spark.createDataFrame(rows(40), CHUNK_SCHEMA), str(tmp_path))
    seek, plain = search.Engine(made, seek=True), search.Engine(made)
    got = all_pages(seek, "retry page", filters, 7)
    assert got == all_pages(plain, "retry page", filters, 7)
    assert got == [h["chunk_id"] for h in plain.search(search.Request("retry page", filters, 50)).hits]
    assert len(got) == len(set(got)) == (30 if filters else 40)
    assert all_pages(search.Engine(made, seek=True, capped=True), "retry page", filters, 7) == got


def test_a_new_version_doesn_t_change_the_pages(spark, tmp_path):
    made = index.build(spark.createDataFrame(rows(20), CHUNK_SCHEMA), str(tmp_path))
    want = all_pages(search.Engine(made), "retry", {}, 6)
    first = search.Engine(made, seek=True).search(search.Request("retry", {}, 6))
    newer = search.Engine(index.build(spark.createDataFrame(rows(30)[10:], CHUNK_SCHEMA), str(tmp_path)), seek=True)
    out, after = [h["chunk_id"] for h in first.hits], first.next_cursor
    while after:
        r = newer.search(search.Request("retry", {}, 6, after))
        out, after = out + [h["chunk_id"] for h in r.hits], r.next_cursor
    assert out == want
    assert all_pages(newer, "retry", {}, 6) != want
    index.build(spark.createDataFrame(rows(5), CHUNK_SCHEMA), str(tmp_path))
    third = search.Engine(index.Index.open(spark, str(tmp_path)), seek=True)
    with pytest.raises(cursor.BadCursor, match="gone"):
        third.search(search.Request("retry", {}, 6, first.next_cursor))


def test_over_segments(spark, tmp_path):
    base = str(tmp_path)
    df = spark.createDataFrame(rows(20), CHUNK_SCHEMA)
    segments.update(spark, base, df, df.select("filepath"))
    view = segments.SegmentedIndex(spark, base)
    first = search.Engine(view, seek=True).search(search.Request("retry", {}, 8))
    want = all_pages(search.Engine(view), "retry", {}, 8)
    more = spark.createDataFrame(rows(40)[20:], CHUNK_SCHEMA)
    segments.update(spark, base, more, more.select("filepath").union(df.limit(3).select("filepath")))
    newer = search.Engine(segments.SegmentedIndex(spark, base), seek=True)
    out, after = [h["chunk_id"] for h in first.hits], first.next_cursor
    while after:
        r = newer.search(search.Request("retry", {}, 8, after))
        out, after = out + [h["chunk_id"] for h in r.hits], r.next_cursor
    assert out == want and len(all_pages(newer, "retry", {}, 20)) == 37


def test_cursors_are_checked():
    c = cursor.encode_seek(0.123456, "a.md#é", "v-1", " q ", {"k": "v"})
    assert cursor.decode_seek(c, "q", {"k": "v"}) == (0.123456, "a.md#é", "v-1")
    for bad in ("", "%%", cursor.encode(0, 5), cursor.encode_search(0, 5, "q", {"k": "v"}), cursor._pack({"after": [True, "x"], "index": "v", "v": 1}), cursor._pack({"after": ["x"], "index": "v", "v": 1})):
        with pytest.raises(cursor.BadCursor):
            cursor.decode_seek(bad, "q", {"k": "v"})
    with pytest.raises(cursor.BadCursor, match="does not match"):
        cursor.decode_seek(c, "other", {"k": "v"})
    with pytest.raises(cursor.BadCursor):
        cursor.decode(c)
