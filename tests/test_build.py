import json

from scriptorium.operators import index, search, vectors
from scriptorium.plans import build
from scriptorium.sources.corpus import MANIFEST_NAME


def corpus(root):
    for name, lang in (("python", "python"), ("typescript", "typescript")):
        d = root / "sdks" / name
        d.mkdir(parents=True)
        (d / "auth.md").write_text(f"# {name} auth\n\n## Client initialization\nCreate the {name} client.\n\n## Retry configuration\nSet retries for {name}.")
        (d / MANIFEST_NAME).write_text(json.dumps({"version": "1", "metadata": {"language": lang, "scope": "sdk-specific"}, "taxonomy": {"language": {"vector_collapse": True}}}))
    (root / "guides").mkdir()
    (root / "guides/retries.md").write_text("---\nmetadata: {scope: global-guide}\n---\n# Retries\n\n## Backoff strategy\nWait longer after each failure; retries add up.")
    (root / "ask.template.md").write_text("Ask {{it}}")


def test_from_files_to_answers(spark, tmp_path):
    root, out = tmp_path / "docs", str(tmp_path / "index")
    corpus(root)
    report = build.validate(spark, str(root))
    assert (report.files, report.chunks, report.prompts) == (3, 8, 1)
    assert report.warnings == ["1 files have no manifest."]
    made, report = build.build(spark, str(root), out, "Docs", vectors.HashProvider(16))
    assert report.warnings == []
    assert made.metadata["taxonomy"]["language"]["vector_collapse"]
    engine = search.Engine(made, ["language"], provider=vectors.HashProvider(16))
    got = engine.search(search.Request("retry configuration", {"language": "python"}))
    assert got.hits[0]["chunk_id"] == "sdks/python/auth.md#python-auth/retry-configuration"
    assert all("typescript" not in h["filepath"] for h in got.hits)
    # A change, and everything else is reused.
    (root / "guides/retries.md").write_text("# Retries\n\n## Jitter\nRandom waits.")
    again, report = build.build(spark, str(root), out, "Docs", vectors.HashProvider(16))
    assert report.warnings == []
    ids = {r.chunk_id for r in again.table("chunks").collect()}
    assert "guides/retries.md#retries/jitter" in ids and "guides/retries.md#retries/backoff-strategy" not in ids
    assert index.Index.open(spark, out).path == again.path
    cases = [{"query": "jitter", "expectedChunkId": "guides/retries.md#retries/jitter"}, {"query": "jitter", "expectedChunkId": "none"}]
    found = build.evaluate_retrieval(spark, search.Engine(again), cases)
    assert (found["hit_at_5"], found["mrr_at_5"], found["avg_rounds"]) == (0.5, 0.5, 2.5)
    assert build.fix(spark, str(root))["strategy"]["chunk_by"] in ("h2", "file")


def test_an_empty_corpus(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    made, report = build.build(spark, str(tmp_path / "docs"), str(tmp_path / "out"), "Nothing")
    assert (report.files, report.chunks) == (0, 0)
    assert search.Engine(made).search(search.Request("x")).hits == []


def test_command_line(spark, tmp_path, capsys):
    from scriptorium.__main__ import main

    corpus(tmp_path / "docs")
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    assert main(["build", docs, out, "--embedding", "hash", "--json", str(tmp_path / "json")]) == 0
    assert json.loads(capsys.readouterr().out)["chunks"] == 8
    assert main(["search", out, "retry", "--filter", "language=python"]) == 0
    assert json.loads(capsys.readouterr().out)["hits"]
    assert main(["get", out, "guides/retries.md#retries/backoff-strategy"]) == 0
    assert "(Target)" in capsys.readouterr().out
