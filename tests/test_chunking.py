import pytest

from scriptorium.operators.chunking import MOST_CHARS, Strategy, chunk, chunk_files
from scriptorium.operators.markdown import blocks, first_title


def ids(markdown, **how):
    return [c["chunk_id"].removeprefix("f.md#") for c in chunk("f.md", markdown, Strategy(**how))]


def x(n):
    return "x" * n


@pytest.mark.parametrize(
    ("markdown", "how", "expected"),
    [
        ("# Auth\n\n## Login\nfirst\n\n## Login\nsecond\n\n# Billing\n\n## Retry\nthird", {}, ["_preamble", "auth/login", "auth/login-2", "billing/retry"]),
        ("# Examples\n\n## Setup\na\n\n# Examples\n\n## Setup\nb", {}, ["_preamble", "examples/setup", "examples-2/setup"]),
        ("intro\n\n## First\nbody", {}, ["_preamble", "first"]),
        ("## One\nsmall\n\n## Two\ntiny", {"min_chunk_size": 100}, ["one", "two"]),
        ("## One\nThis paragraph is intentionally long enough to force a split.\n\ntiny", {"max_chunk_size": 70, "min_chunk_size": 20}, ["one"]),
        (f"## Config\n{x(50)}\n\n### Advanced\n{x(50)}\n\n#### Timeouts\n{x(50)}\n\n#### Retries\n{x(50)}", {"max_chunk_size": 100}, ["config", "config/advanced", "config/advanced/timeouts", "config/advanced/retries"]),
        (f"## Parent\n\n### Example\n{x(80)}\n\n### Example\n{x(80)}", {"max_chunk_size": 100}, ["parent", "parent/example", "parent/example-2"]),
        ("", {}, ["_preamble"]),
        ("no heading", {"chunk_by": "file"}, ["f.md"]),
        ("- # not a section\n\n> ## nor this", {}, ["_preamble"]),
        ("```\n## code\n```\n\n## Real", {}, ["_preamble", "real"]),
        ("Setext\n---\n\nbody", {}, ["setext"]),
        ("## !!!\na", {}, ["section"]),
    ],
)
def test_ids(markdown, how, expected):
    assert ids(markdown, **how) == expected


def test_parts_and_levels():
    found = chunk("f.md", f"## Huge Section\nParagraph one. {x(80)}\n\nParagraph two. {x(80)}", Strategy("h2", 100))
    assert [c["chunk_id"] for c in found][:2] == ["f.md#huge-section", "f.md#huge-section-part-2"]
    assert {c["heading_level"] for c in found} == {6}
    deep = chunk("f.md", f"## A\n{x(60)}\n\n### B\n{x(60)}", Strategy("h2", 80))
    assert deep[1]["breadcrumb"] == "f.md > A > B"
    assert deep[1]["heading_level"] == 3
    assert len(chunk("f.md", f"## Giant\n{x(MOST_CHARS + 10)}\n\n## Small\ntiny")) > 2


def test_refined_preamble_keeps_the_parent():
    found = {c["chunk_id"]: c for c in chunk("f.md", f"## Parent\nbefore any\n\n### One\n{x(80)}\n\n### Two\n{x(80)}", Strategy("h2", 100))}
    assert "before any" in found["f.md#parent"]["content"]
    assert {"f.md#parent/one", "f.md#parent/two"} <= set(found)


def test_refining_a_preamble_nests_below_it():
    found = chunk("f.md", f"{x(60)}\n\n# Top\n{x(60)}", Strategy("h2", 80))
    assert [c["chunk_id"] for c in found] == ["f.md#_preamble", "f.md#_preamble/top"]
    assert found[1]["breadcrumb"] == "f.md > Top"


def test_text_of_blocks():
    md = "---\na: 1\n---\n# T *x*\n\n- a\n- b **c**\n\n| p | q |\n|---|---|\n| 1 | 2 |\n\n> quote\n\n```js\ncode\n```\n\n[l](http://h) `c` &amp; \\* ![alt](i.png)"
    assert [(b.kind, b.text) for b in blocks(md)] == [("yaml", ""), ("heading", "T x"), ("list", "ab c"), ("table", "pq12"), ("quote", "quote"), ("code", "code"), ("paragraph", "l c & * alt")]
    assert first_title(md) == "T x"
    assert first_title("#\n\n# Later") is None


def test_blank_path():
    with pytest.raises(ValueError, match="filepath"):
        chunk(" ", "a")


def test_files_in_spark(spark):
    files = spark.createDataFrame([("a.md", "# A\n\n## B\nb"), ("b.md", None)], "path string, markdown string")
    got = {(r.chunk_id, r.chunk_index) for r in chunk_files(files).collect()}
    assert got == {("a.md#_preamble", 0), ("a.md#a/b", 1), ("b.md#_preamble", 0)}
