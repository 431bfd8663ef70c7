import json

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import incremental, manifest, metadata, prompts, vectors
from scriptorium.operators.chunking import chunk_files
from scriptorium.sources import corpus


@pytest.fixture
def docs(tmp_path):
    for path, text in {
        "guides/retry.md": "---\nmcp_metadata:\n  scope: global-guide\n---\n# Retries\n\n## Backoff\nwait",
        "sdk/python/auth.md": "# Auth\n\n## Login\ntext",
        "sdk/python/_partial.md": "# Part\n\n### Deep\nx",
        ".hidden/no.md": "no",
        "hello.template.md": "---\ntitle: Hi\narguments:\n  - name: who\n    required: true\n---\nHello {{who}} {{other}}!",
        "hello.template.yaml": "title: Hi\nmessages:\n  - role: user\n    content: {type: text, text: 'Yo {{who}}'}\n",
    }.items():
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (tmp_path / "sdk/python" / corpus.MANIFEST_NAME).write_text(
        json.dumps({"version": "1", "metadata": {"language": "python", "scope": "sdk-specific"}, "strategy": {"chunk_by": "h2"}, "taxonomy": {"language": {"vector_collapse": True}}, "overrides": [{"pattern": "_*.md", "strategy": {"chunk_by": "h3"}, "metadata": {"kind": "part"}}]})
    )
    return tmp_path


def test_discovery(docs):
    assert corpus.markdown_paths(str(docs)) == ["guides/retry.md", "sdk/python/_partial.md", "sdk/python/auth.md"]
    kept, warnings = corpus.preferred_prompts(corpus.prompt_paths(str(docs)))
    assert kept == ["hello.template.yaml"]
    assert len(warnings) == 1


def test_read_and_chunk(spark, docs):
    files = corpus.read_corpus(spark, str(docs))
    rows = {r.path: r for r in files.collect()}
    assert rows["sdk/python/_partial.md"].strategy.chunk_by == "h3"
    assert rows["sdk/python/_partial.md"].metadata == {"language": "python", "scope": "sdk-specific", "kind": "part"}
    assert rows["guides/retry.md"].metadata == {"scope": "global-guide"}
    assert (rows["guides/retry.md"].title, rows["guides/retry.md"].has_manifest) == ("Retries", False)
    chunks = chunk_files(files)
    assert {r.key: list(r["values"]) for r in metadata.taxonomy(chunks).collect()} == {"kind": ["part"], "language": ["python"], "scope": ["global-guide", "sdk-specific"]}
    doc = metadata.build_document(chunks, "Docs", manifest.merged_taxonomy(corpus.manifests(str(docs)).values()))
    assert doc["stats"]["total_files"] == 3
    assert metadata.collapse_keys(doc["taxonomy"]) == ["language"]
    schema = metadata.search_schema(doc["taxonomy"])
    assert schema["properties"]["filters"]["properties"]["language"]["enum"] == ["python"]
    with pytest.raises(ValueError, match="Allowed: python"):
        metadata.check_arguments({"query": "x", "filters": {"language": "go"}}, schema)
    with pytest.raises(ValueError, match="Unknown fields"):
        metadata.check_arguments({"query": "x", "more": 1}, schema)


def test_incremental(spark, docs):
    files = corpus.read_corpus(spark, str(docs))
    first = incremental.rechunk(files)
    first.write.parquet(str(docs / "out1"))
    first = spark.read.parquet(str(docs / "out1"))
    assert incremental.canary(files, first)
    (docs / "guides/retry.md").write_text("# Retries\n\n## Other\nnew")
    now = incremental.rechunk(corpus.read_corpus(spark, str(docs)), first)
    ids = {r.chunk_id for r in now.collect()}
    assert "guides/retry.md#retries/other" in ids and "guides/retry.md#retries/backoff" not in ids
    assert "sdk/python/auth.md#auth/login" in ids
    broken = first.withColumn("heading", F.lit("x"))
    assert not incremental.canary(corpus.read_corpus(spark, str(docs)), broken)


def test_embedding_cache(spark, docs):
    calls = []

    class Counting:
        name, dimensions = "count", 4

        def embed(self, texts):
            calls.extend(texts)
            return [[float(len(t)), 0.0, 0.0, 1.0] for t in texts]

    chunks = chunk_files(corpus.read_corpus(spark, str(docs)))
    provider = vectors.HashProvider(8)
    done = incremental.embed(chunks, provider)
    config = incremental.provider_fingerprint(provider)
    incremental.save_cache(done.cache, str(docs), config)
    cache, why = incremental.load_cache(spark, str(docs), config)
    assert why is None
    n = incremental.cache_counts(chunks.where("chunk_index = 0"), cache, config).first()
    assert (n["hits"], n["misses"], n["hit_percent"]) == (n["total"], 0, 100.0)
    assert incremental.embed(chunks, provider, cache).vectors.count() == chunks.count()
    other, why = incremental.load_cache(spark, str(docs), "other")
    assert other is None and "another provider" in why
    (docs / "cache/meta.json").write_text("{")
    assert incremental.load_cache(spark, str(docs), config)[0] is None


@pytest.mark.parametrize(
    ("value", "message"),
    [({}, "version"), ({"version": 1}, "version"), ({"version": "1", "strategy": {"chunk_by": "h9"}}, "chunk_by"), ({"version": "1", "strategy": {"chunk_by": "h2", "max_chunk_size": 0}}, "positive"), ({"version": "1", "metadata": {"a": ""}}, "non-empty"), ({"version": "1", "overrides": {}}, "array"), ({"version": "1", "taxonomy": {"a": {"vector_collapse": 1}}}, "taxonomy"), ({"version": "1", "mcpServerInstructions": " "}, "Instructions")],
)
def test_bad_manifests(value, message):
    with pytest.raises(manifest.ManifestError, match=message):
        manifest.manifest_of(value)


def test_precedence():
    m = manifest.manifest_of({"version": "1", "strategy": {"chunk_by": "h1", "max_chunk_size": 9}, "metadata": {"a": "1", "b": "1"}, "overrides": [{"pattern": "**/*.md", "metadata": {"b": "2"}}, {"pattern": "x/*.md", "strategy": {"chunk_by": "h3", "max_chunk_size": 5}}]})
    c = manifest.resolve("d/x/y.md", "text", m, "d")
    assert (c.strategy.chunk_by, c.strategy.max_chunk_size, c.metadata) == ("h3", 5, {"a": "1", "b": "2"})
    c = manifest.resolve("d/x/y.md", '<!-- mcp_chunking_hint: {"chunk_by": "file"} -->', m, "d")
    assert (c.strategy.chunk_by, c.strategy.max_chunk_size) == ("file", 5)
    c = manifest.resolve("d/x/y.md", "---\nmcp_chunking_hint: h2\nmetadata: {a: '5'}\ntitle: T\n---\n# U", m, "d")
    assert (c.strategy.chunk_by, c.strategy.max_chunk_size, c.metadata["a"], c.title) == ("h2", None, "5", "T")
    assert manifest.hinted_way('<!-- mcp_chunking_hint: {"chunk_by": "h7"} -->') is None


def test_nearest_wins_alone():
    a, b = manifest.Manifest(metadata={"x": "1"}), manifest.Manifest()
    assert manifest.nearest("p/q/r.md", {"": a, "p": b}) == ("p", b)
    assert manifest.nearest("z.md", {"p": b}) is None


def test_suggestions(spark):
    h = lambda k, n: "\n".join(f"{'#' * k} t{i}" for i in range(n))
    files = spark.createDataFrame([("a.md", h(2, 2)), ("b.md", h(2, 3)), ("c.md", h(3, 6)), ("d.md", "```\n# a\n# b\n```"), ("e.md", h(1, 2))], "path string, markdown string")
    assert manifest.suggest_manifest(files) == {"version": "1", "strategy": {"chunk_by": "h2"}, "overrides": [{"pattern": p, "strategy": {"chunk_by": w}} for p, w in (("c.md", "h3"), ("d.md", "file"), ("e.md", "h1"))]}


def test_prompts(docs):
    p = prompts.parse("hello.template.md", (docs / "hello.template.md").read_text())
    assert p["title"] == "Hi"
    assert prompts.render(p, {"who": "<b>"})[0]["content"]["text"] == "Hello <b> !"
    with pytest.raises(prompts.PromptError, match="who"):
        prompts.render(p)
    with pytest.raises(prompts.PromptError, match="body"):
        prompts.parse_markdown("---\ntitle: a\n---\n ")
    with pytest.raises(prompts.PromptError, match="message"):
        prompts.parse_yaml("title: a")


@pytest.mark.parametrize("bad", [{"metadata_version": "x"}, {"metadata_version": "2.0.0"}, {"corpus_description": " "}, {"stats": {}}, {"taxonomy": {"k": {"values": ["v" * 129]}}}, {"taxonomy": {f"k{i}": {"values": []} for i in range(65)}}, {"embedding": {"provider": "p"}}, {"prompts": [{"name": "a"}, {"name": "a"}]}])
def test_bad_documents(bad):
    good = {"metadata_version": "1.2.3", "corpus_description": "d", "taxonomy": {"a": {"values": [" y ", "x", "x"]}}, "stats": {"total_chunks": 1, "total_files": 1, "indexed_at": "now"}}
    assert metadata.normalized_document(good)["taxonomy"]["a"]["values"] == ["x", "y"]
    with pytest.raises(metadata.MetadataError):
        metadata.normalized_document(good | bad)


def test_tools():
    tools = metadata.Tools(None, {"taxonomy": {}}, "acme")
    assert [t["name"] for t in tools.list()] == ["acme_search_docs", "acme_get_doc"]
    tools.add("echo", {}, lambda a: a)
    assert tools.call("echo", 1) == {"content": 1, "is_error": False}
    assert tools.call("nope", 1)["is_error"]
    for bad in ("echo", "a b", "x" * 65):
        with pytest.raises(ValueError):
            tools.add(bad, {}, print)


def test_history(tmp_path):
    assert corpus.previous_result(str(tmp_path), "My Suite!") is None
    for stamp in ("2024-01-01T00:00:00", "2024-01-02T00:00:00"):
        corpus.save_result(str(tmp_path), "My Suite!", stamp, {"at": stamp})
    assert corpus.previous_result(str(tmp_path), "My Suite!")["at"] == "2024-01-02T00:00:00"


def test_corpus_fingerprint(spark, docs):
    a = incremental.corpus_fingerprint(corpus.read_corpus(spark, str(docs)))
    assert a == incremental.corpus_fingerprint(corpus.read_corpus(spark, str(docs)).orderBy(F.desc("path")))
    (docs / "guides/retry.md").write_text("changed")
    assert a != incremental.corpus_fingerprint(corpus.read_corpus(spark, str(docs)))
    assert corpus.corpus_label(str(docs)) == docs.name
    assert corpus.source_commit(str(docs)) is None
    assert corpus.directory_bytes(str(docs), ".yaml") > 0


def test_specs():
    assert vectors.parse_spec("hash/a/b") == ("hash", "a/b")
    assert vectors.parse_spec("none") == ("none", None)
    with pytest.raises(ValueError, match="Unknown"):
        vectors.parse_spec("x/y")


def test_failing_providers():
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise RuntimeError("busy")
        return [[1.0]] * len(texts)

    assert vectors.CallableProvider(flaky, 1, batch=2).embed(["a", "b", "c"]) == [[1.0]] * 3
    assert sorted(calls) in ([1, 1, 2], [1, 2, 2])  # two batches side by side, of which the first to come is tried again
    with pytest.raises(ValueError, match="vectors"):
        vectors.CallableProvider(lambda t: [], 1).embed(["a"])
