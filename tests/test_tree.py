"""Listing by the executors and the closest manifest, against the walk of the driver."""

import json
import random

import pytest

from scriptorium.operators import manifest
from scriptorium.sources import corpus


@pytest.fixture
def root(tmp_path):
    g = random.Random(3)
    dirs = ["", "a", "a/b", "a/b/c", "d", "d/_e", "d/_e/f", "a/.hidden", "empty"]
    for d in dirs:
        (tmp_path / d).mkdir(parents=True, exist_ok=True)
    for i in range(60):
        d = g.choice(dirs[:-1])
        name = g.choice([f"f{i}.md", f"_f{i}.md", f".f{i}.md", f"f{i}.txt", f"f{i}.template.md", f"ü {i}.md"])
        (tmp_path / d / name).write_text(f"# T{i}\n\n## A\n\ntext {i}\n", encoding="utf-8")
    for d, way in (("", "h1"), ("a/b", "h3"), ("d/_e", "file"), ("a/.hidden", "h1")):
        (tmp_path / d / ".docs-manifest.json").write_text(json.dumps({"version": "1", "strategy": {"chunk_by": way}, "metadata": {"from": d or "root"}}))
    return str(tmp_path)


def test_a_tree_is_what_a_walk_finds(spark, root):
    assert sorted(r.path for r in corpus.tree(spark, root, 2).collect()) == sorted(corpus._walk(root))


def test_files_and_their_settings(spark, root):
    want = sorted(map(str, corpus.read_corpus(spark, root).collect()))
    assert sorted(map(str, corpus.read_tree(spark, root, files_a_task=7).collect())) == want and len(want) > 15


def test_a_broken_manifest_is_told(spark, root):
    with open(f"{root}/d/.docs-manifest.json", "w") as f:
        f.write("{")
    with pytest.raises(Exception, match="not valid JSON"):
        corpus.read_tree(spark, root).collect()


def test_nearest_against_brute_force(spark, monkeypatch):
    g = random.Random(5)
    parts = ["a", "b", "ab", "a b"]
    paths = sorted({"/".join([*(g.choice(parts) for _ in range(g.randrange(5))), f"{g.randrange(9)}.md"]) for _ in range(200)})
    dirs = sorted({"/".join(g.choice(parts) for _ in range(g.randrange(4))) for _ in range(25)} - {""})
    for known in (dirs, [*dirs, ""], []):
        for most in (50_000, 0):
            monkeypatch.setattr(manifest, "BROADCAST_MANIFESTS", most)
            df = manifest.nearest_of(spark.createDataFrame([(p, 1) for p in paths], "path string, n int"), spark.createDataFrame([(d, d.upper()) for d in known], "dir string, said string"))
            of = {d: d.upper() for d in known}
            want = {p: manifest.nearest(p, of) for p in paths}
            assert {r.path: (r.dir, r.said) if r.dir is not None else None for r in df.collect()} == want
