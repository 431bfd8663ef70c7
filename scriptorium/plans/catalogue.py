"""Queries over the driver's tables, each composed of the engine's operators, and the SQL that must agree.

Ties are broken in binary order here, as SQL engines do.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import agent_eval, chunking, collapse, documents, evaluate, facets, incremental, index, lexical, manifest, metadata, quantised, ranks, search, segments, traces, vectors
from scriptorium.session import shared_dir, written
from scriptorium.sources import adapters
from scriptorium.streaming import fold

Query = Callable[[SparkSession, str], DataFrame]

PHRASE = "of the"
WORDS = "idiot of the est"
FILTERS = {"language": "en"}
PAGE = 10
PRICES = [("en", 3.0, 0.3, 15.0), ("fr", 1.25, 0.125, 10.0)]


def chunks(spark: SparkSession, d: str, indexed: bool = False) -> DataFrame:
    return adapters.documents_as_chunks(adapters.read(spark, d, "documents"), indexed)


def cases(spark: SparkSession, d: str, shift: int = 0) -> DataFrame:
    """Evaluation cases of the benchmark's items: ranked lists that are a function of item_id."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.concat(F.lit("c"), ((F.col("item_id") * 7 + i * 3 + shift) % 11).cast("string")))
    return adapters.read(spark, d, "benchmark").select(
        F.concat(F.lit("c"), (F.col("item_id") % 11).cast("string")).alias("expected"),
        ids.alias("ranked"),
        (F.col("item_id") % 4 + 1).cast("int").alias("rounds"),
        F.concat(F.lit("case-"), F.col("item_id").cast("string")).alias("name"),
        F.when(F.col("item_id") % 4 > 0, F.concat(F.lit("cat"), (F.col("item_id") % 4).cast("string"))).alias("category"),
    )


def results(spark: SparkSession, d: str, run: int = 0) -> DataFrame:
    """Agent results of the events: another verdict for each run."""
    e = F.col("event_id")
    return adapters.read(spark, d, "events").select(
        e.cast("string").alias("id"),
        F.concat(F.lit("scenario-"), e.cast("string")).alias("name"),
        F.when(e % 9 > 0, F.col("event_type")).alias("category"),
        (e % 5 != 0).alias("activated"),
        ((e + run) % 3 == 0).alias("passed"),
        (e % 11 == 0).alias("skipped"),
        ((e + run) % 9).cast("int").alias("num_turns"),
        (F.col("value") / 1000).alias("total_cost_usd"),
        (F.col("value") * (10 + run)).alias("duration_ms"),
        (e % 1000).alias("input_tokens"),
        (e % 300).alias("output_tokens"),
        (e % 200).alias("cache_read_tokens"),
        F.when(e % 2 == 0, e % 50).alias("cache_creation_tokens"),
        (e % 4).alias("tool_calls"),
        F.map_filter(F.create_map(F.lit("mcp__docs__search"), (e % 4).cast("int"), F.lit("mcp__docs__get"), (e % 2).cast("int"), F.lit("Bash"), (e % 3).cast("int")), lambda k, v: v > 0).alias("tools_called"),
        F.map_filter(F.create_map(F.lit("clarity"), (e % 10).cast("double"), F.lit("use"), (e % 7).cast("double")), lambda k, v: v > run).alias("scores"),
    )


def _first(hits: DataFrame, n: int, offset: int = 0) -> DataFrame:
    return hits.orderBy(*lexical.order(collated=False)).offset(offset).limit(n)


def _lists(spark: SparkSession, d: str) -> list[DataFrame]:
    rows = chunks(spark, d)
    query = adapters.read(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()
    near = adapters.read(spark, d, "embeddings").join(rows.select("doc_id", "chunk_id"), F.col("vec_id") == F.col("doc_id")).select("chunk_id", F.round(vectors.distance(F.col("embedding"), [float(x) for x in query[0]]), 9).alias("score"))
    return [
        search.ranked(search.match_scan(rows, WORDS), "match"),
        search.ranked(search.phrase_scan(rows, PHRASE), "phrase"),
        search.ranked(near, "vector", best=F.asc("score")),
    ]


def hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: match, phrase and vector lists fused; the best 50 with snippets."""
    best = search.fused(_lists(spark, d)).orderBy(F.desc("score"), "chunk_id").limit(50)
    return chunks(spark, d).join(F.broadcast(best), "chunk_id").select("chunk_id", "score", T.snippet(F.col("content_text"), WORDS).alias("snippet"))


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    best = lexical.scored(chunks(spark, d), WORDS).select("chunk_id", "filepath", "heading", "metadata", "score")
    return collapse.collapsed(best, ["language"], {}, lexical.order(collated=False))


def _hinted(spark: SparkSession, d: str) -> DataFrame:
    rows = chunks(spark, d)
    return search.suggestions(rows, lexical.scored(rows, "idiot", 0.0).select("chunk_id"), {"language": "xx", "scope": "blog"}).select("key", F.array_join("values", ",").alias("values"))


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    return adapters.conversations_as_markdown(adapters.read(spark, d, "conversations"))


def _pages_by_context(spark: SparkSession, d: str) -> DataFrame:
    rows = chunks(spark, d, indexed=True)
    return documents.in_context(rows, rows.select("chunk_id"), 1).select("chunk_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def _cache(spark: SparkSession, d: str) -> DataFrame:
    rows = chunks(spark, d)
    cached = incremental.fingerprinted(rows.where("doc_id % 3 <> 0"), "cfg").select("fingerprint")
    return incremental.cache_counts(rows, cached, "cfg")


def _usage(spark: SparkSession, d: str) -> DataFrame:
    pricing = spark.createDataFrame(PRICES, "model string, input_price double, cached_price double, output_price double")
    used = adapters.read(spark, d, "documents").groupBy(F.col("lang").alias("model")).agg(F.sum("n_chars").alias("input_tokens"), F.count("*").alias("cached_tokens"), F.sum(F.col("doc_id") % 100).alias("output_tokens"))
    return agent_eval.token_cost(used, pricing).select("model", "cost_usd")


def _fixed_files(spark: SparkSession, d: str) -> DataFrame:
    """Markdown with headings: each conversation's turns as sections of its own depth."""
    level = F.when(F.col("conv_id") % 3 == 0, "# ").when(F.col("conv_id") % 3 == 1, "## ").otherwise("### ")
    body = F.array_join(F.array_sort(F.collect_list(F.concat(F.lpad(F.col("turn").cast("string"), 6, "0"), F.lit("\n"), level, F.col("role")))), "\n")
    return adapters.read(spark, d, "conversations").groupBy("conv_id").agg(body.alias("markdown")).select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), "markdown")


def _size_parts(spark: SparkSession, d: str) -> DataFrame:
    files = _markdown(spark, d)
    return chunking.chunk_files(files, chunking.Strategy("h2", 400, 80)).select("chunk_id", "heading_level", "chunk_index", F.length("content").alias("n_chars"))


def _packed_parts(spark: SparkSession, d: str) -> DataFrame:
    """A section for each conversation, its turns as paragraphs of their lengths; every other section has deeper headings. Split by headings, then between blocks, small parts joined."""
    deeper = F.col("conv_id") % 2 == 0
    n = (F.length("text") % 300 + 1).cast("int")
    turns = F.array_sort(F.collect_list(F.struct("turn", n.alias("n"))))
    para = lambda t, i: F.concat(F.when(F.col("deeper") & (i % 3 == 0), F.concat(F.lit("### Sub "), (F.floor(i / 3) + 1).cast("string"), F.lit("\n\n"))).otherwise(""), F.repeat(F.lit("x"), t["n"]))
    rows = adapters.read(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("turns")).withColumn("deeper", deeper)
    files = rows.select(F.concat(F.lit("c/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("## Sec\n\n"), F.array_join(F.transform("turns", para), "\n\n")).alias("markdown"))
    return chunking.chunk_files(files, chunking.Strategy("h2", 400, 80)).select("chunk_id", "chunk_index", F.length("content").alias("n_chars"))


def _slop(spark: SparkSession, d: str) -> DataFrame:
    return search.phrase_scan(chunks(spark, d), PHRASE, 2).select("chunk_id", F.col("score").cast("long").alias("n"))


def _latency(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.latency(adapters.read(spark, d, "events"), "value", ["event_type"])


def _hash_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = chunks(spark, d).select("chunk_id", "content_text")
    return vectors.embedded(rows, "content_text", vectors.HashProvider(64)).select("chunk_id", "vector")


def _rounds(spark: SparkSession, d: str) -> DataFrame:
    """Rounds until each benchmark item's expected id is found, by page of two."""
    rows = cases(spark, d).select("name", F.nullif(F.array_position("ranked", F.col("expected")), F.lit(0)).alias("rank"))
    return evaluate.paged_rounds(rows, 2, 3).select("name", F.col("rounds").cast("int").alias("rounds"))


def _titles(spark: SparkSession, d: str) -> DataFrame:
    return adapters.read(spark, d, "documents").select(F.concat(F.lit("api/"), F.col("lang"), F.lit("/json-"), F.col("source"), F.lit(".md")).alias("filepath")).distinct().select("filepath", documents.resource_title(F.col("filepath"), F.lit(None).cast("string")).alias("title"))


def _agent_fold(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    line = F.when(e % 4 == 0, F.to_json(F.struct(F.lit("item.completed").alias("type"), F.struct(F.lit("agent_message").alias("type"), F.concat(F.lit("t"), e.cast("string")).alias("text")).alias("item")))).when(e % 4 == 1, F.to_json(F.struct(F.lit("turn.completed").alias("type"), F.struct((e % 100).alias("input_tokens"), (e % 7).alias("output_tokens")).alias("usage")))).when(e % 4 == 2, F.to_json(F.struct(F.lit("item.completed").alias("type"), F.struct(F.lit("command_execution").alias("type")).alias("item")))).otherwise(F.lit("not json"))
    lines = adapters.read(spark, d, "events").select(F.col("user_id").cast("string").alias("scenario"), e.alias("seq"), line.alias("line"))
    out = agent_eval.folded(agent_eval.events(lines))
    return out.select("scenario", "num_turns", "final_answer", "input_tokens", "output_tokens", F.coalesce(F.col("tools_called")["Bash"], F.lit(0)).cast("long").alias("bash_calls"))


def _nearest_manifests(spark: SparkSession, d: str) -> DataFrame:
    """For a path of each document the closest directory above it with a manifest; languages, sources and some folders have one."""
    docs = adapters.read(spark, d, "documents")
    part = lambda *c: F.concat_ws("/", F.lit("sdk"), *c)
    folder = (F.col("doc_id") % 5).cast("string")
    paths = docs.select(part("lang", "source", folder, F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"))
    known = docs.where("lang <> 'es'").select(part("lang").alias("dir")).union(docs.where("doc_id % 7 = 0").select(part("lang", "source"))).union(docs.where("doc_id % 31 = 0").select(part("lang", "source", folder))).distinct()
    return manifest.nearest_of(paths, known).select("path", "dir")


def _settings(spark: SparkSession, d: str) -> DataFrame:
    """Settings of a file for each document: by the manifest of its language, the manifest's overrides, a hint comment, front matter."""
    docs = adapters.read(spark, d, "documents")
    i, base = F.col("doc_id"), F.concat(F.lit("sdk/"), F.col("lang"))
    own = F.when(F.col("lang") == "en", "h1").when(F.col("lang") == "fr", "h3").otherwise("h2")
    overrides = '[{"pattern": "src1/**", "strategy": {"chunk_by": "file"}, "metadata": {"scope": "one"}}, {"pattern": "**/*7.md", "metadata": {"seven": "yes"}}]'
    said = F.concat(F.lit('{"version": "1", "strategy": {"chunk_by": "'), own, F.lit('", "max_chunk_size": 900}, "metadata": {"language": "'), F.col("lang"), F.lit('", "kind": "base"}, "overrides": ' + overrides + "}"))
    known = docs.where("lang <> 'es'").select(base.alias("dir"), said.alias("manifest")).distinct()
    title = F.concat(F.lit("# Title "), i.cast("string"), F.lit("\n"))
    front = F.concat(F.lit("---\nmcp_chunking_hint: h3\nmetadata:\n  kind: front\ntitle: Front "), i.cast("string"), F.lit("\n---\n"), title)
    hint = F.concat(F.lit('<!-- mcp_chunking_hint: {"chunk_by": "file"} -->\n'), title)
    paths = docs.select(F.concat_ws("/", base, "source", F.concat(i.cast("string"), F.lit(".md"))).alias("path"), F.when(i % 4 == 0, front).when(i % 4 == 1, hint).otherwise(title).alias("markdown"))
    out = manifest.resolved(manifest.nearest_of(paths, known))
    pairs = F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return out.select("path", F.col("strategy.chunk_by").alias("chunk_by"), F.col("strategy.max_chunk_size").alias("max_size"), F.array_join(pairs, ",").alias("metadata"), "title", "has_manifest")


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    """Documents with metadata of their own: the language and a key for each source and remainder."""
    tag = F.concat_ws("-", "source", (F.col("doc_id") % 51).cast("string"))
    return adapters.read(spark, d, "documents").select("doc_id", tag.alias("tag"), F.create_map(F.lit("language"), F.col("lang"), tag, (F.col("doc_id") % 3).cast("string"), F.lit("empty"), F.lit("")).alias("metadata"))


def _unused(spark: SparkSession, d: str) -> DataFrame:
    """Of the keys that any document has those that no document divisible by three has."""
    rows = _tagged(spark, d)
    return metadata.unused_keys(rows.select(F.col("tag").alias("key")).distinct(), metadata.taxonomy(rows.where("doc_id % 3 = 0").select("metadata")))


def _configured(spark: SparkSession, d: str) -> DataFrame:
    rows = _tagged(spark, d)
    config = rows.where("doc_id % 5 = 0").select(F.col("tag").alias("key"), F.lit(True).alias("vector_collapse")).distinct()
    return metadata.configured(metadata.taxonomy(rows), config).select("key", "vector_collapse", F.array_join("values", ",").alias("values"))


def _looked_up(spark: SparkSession, d: str) -> DataFrame:
    """The first document's chunk with its neighbours, looked up by its id in a published index."""
    chunk_id = chunks(spark, d).agg(F.min_by("chunk_id", "doc_id")).first()[0]
    text = documents.get_doc_of(_index(spark, d), chunk_id, 1)
    return spark.createDataFrame([(chunk_id, text)], "chunk_id string, text string").select("chunk_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def _event_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles by ranges of ranks, whatever the number of rows."""
    wanted = {"value": {"p50": ("nearest", 0.5), "p95": ("nearest", 0.95), "median": ("between", 0.5)}, "event_id": {"third": ("nearest", 1 / 3)}}
    return ranks.quantiles(adapters.read(spark, d, "events"), wanted, ["event_type"], few=0).select("event_type", *(F.round(c, 9).alias(c) for c in ("p50", "p95", "median")), "third")


def _run_lines(events: DataFrame) -> DataFrame:
    """Recorded lines of agent runs of 64 events each: texts with usage, calls, their results, and at the end a report; what is left is no JSON."""
    e, run = F.col("event_id"), F.floor(F.col("event_id") / 64).cast("long")
    call = F.concat(F.lit("c"), F.floor(e / 4).cast("string"))
    usage = lambda a, b: F.struct(a.alias("input_tokens"), b.alias("output_tokens")).alias("usage")
    line = lambda kind, *more: F.to_json(F.struct(F.lit(kind).alias("type"), *more))
    blocks = lambda *fields, more=(): F.struct(F.array(F.struct(*fields)).alias("content"), *more).alias("message")
    text = line("assistant", blocks(F.lit("text").alias("type"), F.concat(F.lit("t"), e.cast("string")).alias("text"), more=(usage(e % 100, e % 7),)))
    use = line("assistant", blocks(F.lit("tool_use").alias("type"), call.alias("id"), F.when(e % 8 == 1, "mcp__docs__search").otherwise("Bash").alias("name")))
    result = line("user", blocks(F.lit("tool_result").alias("type"), call.alias("tool_use_id"), F.repeat(F.lit("x"), (e % 13).cast("int")).alias("content")))
    report = line("result", F.when(run % 2 == 0, "success").otherwise("error").alias("subtype"), F.concat(F.lit("end "), run.cast("string")).alias("result"), (run % 3).alias("num_turns"), (F.col("value") / 1000).alias("total_cost_usd"), usage(run % 5, F.lit(0)))
    said = F.when(e % 4 == 0, text).when(e % 4 == 1, use).when(e % 4 == 2, result).when(e % 64 == 63, report).otherwise("not json")
    return events.select(F.concat(F.lit("run-"), run.cast("string")).alias("scenario"), e.alias("seq"), said.alias("line"), (e * 10).alias("ms"))


def _fold_columns(rows: DataFrame) -> DataFrame:
    tools = [F.coalesce(F.col("tools_called")[t], F.lit(0)).cast("long").alias(c) for t, c in (("Bash", "bash_calls"), ("mcp__docs__search", "search_calls"))]
    return rows.select("scenario", "num_turns", "final_answer", "input_tokens", "output_tokens", F.round("cost_usd", 9).alias("cost_usd"), "errors", *tools, "calls", "answered", "pending", "result_chars", "call_ms")


def _streamed_fold(spark: SparkSession, d: str) -> DataFrame:
    """The fold of all lines as a stream with state."""
    own = os.path.join(shared_dir(spark), "scriptorium", f"fold-{uuid.uuid4().hex}")
    events = spark.readStream.schema(adapters.read(spark, d, "events").schema).parquet(f"{d}/events.parque?")  # a stream of a file, not of a folder, wants a pattern
    fold.start(_run_lines(events), f"{own}/rows", f"{own}/checkpoint").awaitTermination()
    return _fold_columns(fold.latest(spark, f"{own}/rows"))


def _index(spark: SparkSession, d: str, for_batches: bool = False) -> index.Index:
    """An index of the documents, written to the shared folder and published."""
    base = os.path.join(shared_dir(spark), "scriptorium", f"index-{uuid.uuid4().hex}")
    if for_batches:
        return index.build(chunks(spark, d), base, for_batches=True, order="doc_id")
    return index.build(chunks(spark, d, indexed=True), base)


def _batched(spark: SparkSession, d: str) -> DataFrame:
    """The ten best hits of every benchmark item's text, in one job over a published index."""
    asked = adapters.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return search.search_many(_index(spark, d, for_batches=True), asked, 10)


def _filtered(spark: SparkSession, d: str) -> DataFrame:
    """The same with a filter."""
    asked = adapters.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return search.search_many(_index(spark, d, for_batches=True), asked, 10, filters=FILTERS)


def _segmented(spark: SparkSession, d: str) -> segments.SegmentedIndex:
    """An index of the documents in segments: a third of the files comes late, some of the others with another text first, one that is no document goes again."""
    rows = chunks(spark, d, indexed=True)
    base = os.path.join(shared_dir(spark), "scriptorium", f"segments-{uuid.uuid4().hex}")
    late, other = F.crc32("filepath") % 3 == 0, F.crc32("filepath") % 5 == 1
    former = rows.withColumn("content_text", F.when(other, F.concat(F.lit("former of the "), "content_text")).otherwise(F.col("content_text")))
    extra = rows.orderBy("doc_id").limit(1).withColumn("filepath", F.lit("gone.md")).withColumn("chunk_id", F.lit("gone.md#1"))
    first = former.where(~late).unionByName(extra)
    second, third = rows.where(~late & other), rows.where(late)
    paths = lambda df: df.select("filepath").distinct()
    segments.update(spark, base, first, paths(first))
    segments.update(spark, base, second, paths(second).unionByName(paths(extra)))
    segments.update(spark, base, third, paths(third))
    return segments.SegmentedIndex(spark, base, segments.merge(spark, base))


def _near(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 50, itself among them, by the vector index, none missed."""
    rows = adapters.read(spark, d, "embeddings")
    path = os.path.join(shared_dir(spark), "scriptorium", f"near-{uuid.uuid4().hex}")
    model = quantised.save(rows, path, "embedding", "vec_id")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = quantised.nearest_many(spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/sizes"), model, asked, 10, key="vec_id", exact=True)
    return found.select("query_id", "rank", "vec_id", F.round("distance", 6).alias("distance"))


def _incremental(spark: SparkSession, d: str) -> DataFrame:
    """Chunks after two thirds of the files were there before, some of them with another text: those of unchanged files are taken over, the others made."""
    files = _markdown(spark, d).withColumn("strategy", F.struct(F.lit("h2").alias("chunk_by"), F.lit(None).cast("int").alias("max_chunk_size"), F.lit(None).cast("int").alias("min_chunk_size"))).withColumn("metadata", F.create_map().cast("map<string,string>")).withColumn("title", F.lit(None).cast("string"))
    id_ = F.regexp_extract("path", "([0-9]+)", 1).cast("long")
    edited = files.withColumn("markdown", F.when(id_ % 4 == 2, F.concat("markdown", F.lit("\n\nmore"))).otherwise(F.col("markdown")))
    # What is taken over bears a mark; a third of the files is new, and of the others some were different.
    before = written(incremental.rechunk(edited.where(id_ % 3 > 0)).withColumn("breadcrumb", F.concat(F.lit("before: "), "breadcrumb")), "previous")
    return incremental.rechunk(files, before).select("chunk_id", "heading", "chunk_index", F.startswith("breadcrumb", F.lit("before: ")).alias("taken_over"))


def _same_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Sections whose heading came before in their file, with the number that tells them apart."""
    rows = chunking.chunk_files(_markdown(spark, d)).select("chunk_id")
    return rows.select("chunk_id", F.regexp_extract("chunk_id", "-([0-9]+)$", 1).alias("nth")).where(F.col("chunk_id").rlike("#conversation-[0-9]+/[a-z]+-[0-9]+$"))


def _hash_codes(spark: SparkSession, d: str) -> DataFrame:
    return _hash_vectors(spark, d).select("chunk_id", F.array_join(F.transform("vector", lambda x: F.round(x.cast("double") * 1000).cast("long").cast("string")), ",").alias("codes"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    checks = F.array(F.struct(F.lit(False).alias("soft"), (e % 3 > 0).alias("passed")), F.struct(F.lit(True).alias("soft"), (e % 5 > 0).alias("passed")))
    errors = F.when(e % 17 == 0, F.array(F.lit("status 529: Overloaded"))).otherwise(F.array(F.concat(F.lit("error "), e.cast("string"))))
    passed, skipped = agent_eval.verdict(F.when(e % 7 == 0, F.array_compact(F.array(F.lit(None).cast("struct<soft:boolean,passed:boolean>")))).otherwise(checks), errors)
    return adapters.read(spark, d, "events").select("event_id", passed.alias("passed"), skipped.alias("skipped"))


def _trend(spark: SparkSession, d: str) -> DataFrame:
    names = ("pass_rate", "avg_turns", "avg_cost_usd", "avg_duration_ms")
    now, before = (evaluate.long_form(agent_eval.summary(results(spark, d, run)), names) for run in (0, 1))
    return agent_eval.trend(now, before, names[1:])


def _tool_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every event with an even id calls a tool; of each third call's id two answers come, of which the first counts."""
    e = F.col("event_id")
    rows = adapters.read(spark, d, "events").select(F.col("user_id").alias("scenario"), e.alias("seq"), F.floor(e / 2).alias("call_id"), F.when(e % 4 == 0, "mcp__docs__search").otherwise("Bash").alias("name"), F.repeat(F.lit("x"), (e % 13).cast("int")).alias("result"))
    calls = rows.where("seq % 2 = 0").select("scenario", "seq", "call_id", "name")
    answers = rows.where("call_id % 3 > 0").select("scenario", F.col("seq").alias("seq"), "call_id", "result")
    return agent_eval.volumes(agent_eval.paired(calls, answers))


def _assertions(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    files = F.create_map(F.lit("a.md"), text)
    return adapters.read(spark, d, "conversations").select(
        "conv_id", "turn",
        agent_eval.assertion("contains", "the", text).alias("has"),
        agent_eval.assertion("not_contains", "the", text).alias("has_not"),
        agent_eval.assertion("matches", "^[a-m]", text, "i").alias("starts"),
        agent_eval.file_assertion("file_contains", "a.md", "and", files).alias("file_has"),
        agent_eval.file_assertion("file_matches", "b.md", ".", files).alias("no_file"),
    )


def _feedback(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    raw = F.create_map(F.lit("clarity"), F.when(e % 4 == 0, "n/a").otherwise((e % 10).cast("string")), F.lit("other"), F.lit("5"))
    return adapters.read(spark, d, "events").select("event_id", agent_eval.scores_of(raw, ["clarity", "use"])["clarity"].alias("clarity"))


def _written(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    call = lambda name, path: F.struct(name.alias("name"), path.alias("path"))
    inside = F.concat(F.lit("/work/f"), (e % 5).cast("string"))
    trace = F.array(call(F.lit("Write"), inside), call(F.lit("Edit"), F.concat(F.lit("/work/f"), (e % 2).cast("string"))), call(F.lit("Write"), F.lit("/tmp/x")), call(F.lit("Bash"), inside))
    return adapters.read(spark, d, "events").select("event_id", F.array_join(agent_eval.written_files(trace, "/work/"), ",").alias("paths"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return agent_eval.latest_before(adapters.read(spark, d, "events").select(F.col("event_type").alias("suite"), F.concat(F.lit("run-"), F.col("event_id").cast("string")).alias("run")))


def _changed_checks(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    run = lambda k: adapters.read(spark, d, "events").select(e.alias("id"), (e % 3).alias("key"), ((e + k) % 4 < 2).alias("passed"))
    return agent_eval.changed_assertions(run(0), run(1))


def _report(spark: SparkSession, d: str) -> DataFrame:
    runs = adapters.read(spark, d, "documents").groupBy(F.col("lang").alias("label")).agg(F.sum("n_chars").alias("index_bytes"), F.count("*").alias("cases"))
    return evaluate.benchmark_report(runs, 1_000_000, {"en": 0.13, "fr": 0.02}).select("label", "cases", "index_by_corpus", "embedding_cost", "query_cost")


def _forms(spark: SparkSession, d: str) -> DataFrame:
    """Which benchmark texts and ids made of them have the form of a chunk id; paths with the separators of all systems."""
    rows = adapters.read(spark, d, "benchmark")
    return rows.select("item_id", T.is_chunk_id(F.col("text")).alias("text_is_id"), T.is_chunk_id(F.concat(F.lit("a/b.md#"), F.replace("text", F.lit(" "), F.lit("-")))).alias("made_is_id"), T.posix_path(F.concat(F.lit("./a\\"), F.col("item_id").cast("string"))).alias("path"))


def _metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of stored JSON; where it can't be read, of flat columns."""
    stored = F.when(F.col("doc_id") % 3 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("lang", F.lit("").alias("empty"))))
    found = metadata.extracted(stored, {"lang": F.col("lang"), "source": F.col("source")})
    return adapters.read(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(F.transform(F.map_entries(found), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("metadata"))


def queries() -> dict[str, Query]:
    return {
        "indexed_match": lambda s, d: search.match_index(_index(s, d), WORDS, None),
        "indexed_phrase": lambda s, d: search.phrase_index(_index(s, d), PHRASE, 0, None).select("chunk_id", F.col("score").cast("long").alias("n")),
        "block_max_top": lambda s, d: search.match_best(_index(s, d), WORDS, 20).rows,
        "get_doc_lookup": _looked_up,
        "exact_quantiles": _event_quantiles,
        "batched_search": _batched,
        "batched_filtered": _filtered,
        "ivf_pq_knn": _near,
        "segmented_match": lambda s, d: search.match_index(_segmented(s, d), WORDS, None),
        "segmented_terms": lambda s, d: _segmented(s, d).table("terms"),
        "incremental_chunks": _incremental,
        "duplicate_slugs": _same_slugs,
        "scenario_verdicts": _judged,
        "trend_rows": _trend,
        "tool_pairs": _tool_pairs,
        "text_and_file_assertions": _assertions,
        "feedback_scores": _feedback,
        "written_files": _written,
        "latest_runs": _runs,
        "changed_assertions": _changed_checks,
        "benchmark_report": _report,
        "chunk_id_forms": _forms,
        "metadata_keys": lambda s, d: metadata.metadata_keys(_tagged(s, d)),
        "configured_taxonomy": _configured,
        "unused_keys": _unused,
        "nearest_manifest": _nearest_manifests,
        "resolved_settings": _settings,
        "metadata_extraction": _metadata,
        "hybrid_rrf": hybrid,
        "normalize_tokenize": lambda s, d: chunks(s, d).select("chunk_id", F.size(ts := T.tokenized(T.normalized(F.col("content_text")))).alias("n_tokens"), F.array_join(F.slice(ts, 1, 8), " ").alias("head")),
        "slugify": lambda s, d: adapters.read(s, d, "documents").select("doc_id", T.slugified(F.col("text")).alias("slug")),
        "snippet": lambda s, d: chunks(s, d).select("chunk_id", T.snippet(F.col("content_text"), WORDS).alias("snippet")),
        "lexical_topk": lambda s, d: _first(lexical.scored(chunks(s, d), WORDS), PAGE).select("chunk_id", "score"),
        "page_two": lambda s, d: _first(lexical.scored(chunks(s, d), WORDS), PAGE, PAGE).select("chunk_id", "score"),
        "bm25_match": lambda s, d: search.match_scan(chunks(s, d), WORDS),
        "phrase_exact": lambda s, d: search.phrase_scan(chunks(s, d), PHRASE).select("chunk_id", F.col("score").cast("long").alias("n")),
        "phrase_slop2": _slop,
        "vector_knn_l2": lambda s, d: vectors.nearest(adapters.read(s, d, "embeddings"), [0.1] * 64, 20, "embedding", "vec_id").select("vec_id", F.round("distance", 6).alias("distance")),
        "facet_equality": lambda s, d: chunks(s, d).where(facets.equal({"language": "en", "scope": "blog"})).select("chunk_id"),
        "facet_auto_include": lambda s, d: chunks(s, d).where(facets.matching({"language": "fr"})).select("chunk_id"),
        "facet_scope": lambda s, d: chunks(s, d).where(facets.matching({"language": "fr", "scope": "sdk-specific"})).select("chunk_id"),
        "variant_collapse": lambda s, d: _ranks(s, d).select("chunk_id", "score"),
        "hint_suggestions": _hinted,
        "get_doc_context": _pages_by_context,
        "get_doc_full": lambda s, d: documents.whole_documents(chunks(s, d, indexed=True)).select("filepath", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")),
        "list_filepaths": lambda s, d: facets.file_list(chunks(s, d, indexed=True), {"language": "de"}),
        "resource_entries": lambda s, d: documents.resource_files(chunks(s, d, indexed=True), [("scope", "global-guide"), ("language", "es")]),
        "resource_titles": _titles,
        "taxonomy_build": lambda s, d: metadata.taxonomy(chunks(s, d)).select("key", F.array_join("values", ",").alias("values")),
        "corpus_stats": lambda s, d: metadata.corpus_statistics(chunks(s, d)),
        "chunk_conversations": lambda s, d: chunking.chunk_files(_markdown(s, d)).select("chunk_id", "heading", "chunk_index"),
        "size_split_parts": _size_parts,
        "packed_parts": _packed_parts,
        "suggest_chunk_by": lambda s, d: manifest.suggestions(_fixed_files(s, d)),
        "majority_default": lambda s, d: manifest.majority(manifest.suggestions(_fixed_files(s, d))),
        "chunk_fingerprint": lambda s, d: chunks(s, d).select("chunk_id", T.joined_hash(F.lit('{"chunk_by":"h2"}'), F.lit("{}"), F.col("content")).alias("fingerprint")),
        "cache_partition": _cache,
        "hash_embedding": _hash_codes,
        "eval_summary": lambda s, d: evaluate.summary(cases(s, d)),
        "eval_by_category": lambda s, d: evaluate.by_category(cases(s, d)),
        "eval_delta": lambda s, d: evaluate.delta(evaluate.summary(cases(s, d)), evaluate.summary(cases(s, d, 2))),
        "eval_flips": lambda s, d: evaluate.flips(cases(s, d), cases(s, d, 2)),
        "eval_rounds": _rounds,
        "latency_percentiles": _latency,
        "agent_summary": lambda s, d: agent_eval.summary(results(s, d)),
        "agent_by_category": lambda s, d: agent_eval.by_category(results(s, d)),
        "tool_usage": lambda s, d: agent_eval.tool_usage(results(s, d), "mcp__docs__"),
        "feedback_means": lambda s, d: agent_eval.score_means(results(s, d)),
        "comparison_outcomes": lambda s, d: agent_eval.outcomes(results(s, d), results(s, d, 1)).groupBy("outcome").agg(F.count("*").alias("n"), F.sum("num_turns_delta").alias("turns_delta")),
        "comparison_deltas": lambda s, d: agent_eval.comparison(results(s, d), results(s, d, 1)),
        "changed_scenarios": lambda s, d: agent_eval.changed_scenarios(results(s, d), results(s, d, 1)),
        "agent_event_fold": _agent_fold,
        "run_fold": lambda s, d: _fold_columns(traces.folded(traces.events(_run_lines(adapters.read(s, d, "events"))))),
        "run_fold_streamed": _streamed_fold,
        "run_pairs": lambda s, d: traces.pairs(traces.events(_run_lines(adapters.read(s, d, "events")))).select("scenario", "call_id", "tool", F.length("result").cast("long").alias("result_chars"), "ms"),
        "token_cost": _usage,
    }


_WORDS = WORDS.split()
_NORM = r"trim(regexp_replace(lower({x}), '[ \t\n\x0B\f\r\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}]+', ' ', 'g'))"
_TOK = "list_filter(string_split_regex({x}, '[^a-z0-9]+'), lambda z: z <> '')"


def _n(x: str) -> str:
    return _NORM.format(x=x)


def _t(x: str) -> str:
    return _TOK.format(x=_n(x))


def _count(x: str, w: str) -> str:
    return f"((length({x}) - length(replace({x}, '{w}', ''))) // {len(w)})"


_CHUNKS = """chunks AS (SELECT doc_id, 'sdk/' || lang || '/' || source || '-' || (doc_id // 256) || '.md#' || doc_id AS chunk_id, 'sdk/' || lang || '/' || source || '-' || (doc_id // 256) || '.md' AS filepath,
  'Section ' || (doc_id % 7) AS heading, text AS content, lang AS language,
  CASE source WHEN 'src0' THEN 'global-guide' WHEN 'src1' THEN '' WHEN 'src2' THEN 'blog' ELSE 'sdk-specific' END AS scope,
  row_number() OVER (PARTITION BY 'sdk/' || lang || '/' || source || '-' || (doc_id // 256) || '.md' ORDER BY doc_id) - 1 AS chunk_index FROM documents)"""
_FLAT = f"flat AS (SELECT *, {_n('content')} AS c, {_n('heading')} AS h FROM chunks)"
_SNIPPET = f"""snip AS (SELECT chunk_id, c, greatest(0, coalesce({', '.join(f"nullif(strpos(c, '{w}'), 0)" for w in _WORDS)}, 1) - 1 - 60) AS s FROM flat),
snippets AS (SELECT chunk_id, CASE WHEN length(c) <= 220 THEN c ELSE (CASE WHEN s > 0 THEN '...' ELSE '' END) || trim(substring(c, s + 1, least(length(c), s + 220) - s)) || (CASE WHEN least(length(c), s + 220) < length(c) THEN '...' ELSE '' END) END AS snippet FROM snip)"""
_LEX = f"""scored AS (SELECT *, {' + '.join(f"{_count('c', w)} + 3 * {_count('h', w)}" for w in _WORDS)} + CASE WHEN contains(c, '{WORDS}') OR contains(h, '{WORDS}') THEN 1.25::DOUBLE ELSE 0::DOUBLE END AS score FROM flat)"""
_TERMS = f"terms AS (SELECT chunk_id, doc_id, {_t('heading')} AS th, {_t('content')} AS tc FROM chunks)"
_TF = ", ".join(f"len(list_filter({c}, lambda z: z = '{w}'))::DOUBLE AS {c}_{i}" for c in ("th", "tc") for i, w in enumerate(_WORDS))
_BM = " + ".join(
    f"CASE WHEN {c}_{i} > 0 THEN {b}::DOUBLE * (ln(1.0::DOUBLE + (n - df_{c}_{i} + 0.5::DOUBLE) / (df_{c}_{i} + 0.5::DOUBLE)) * ({c}_{i} * 2.2::DOUBLE) / ({c}_{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l{c} / a{c}))) ELSE 0::DOUBLE END"
    for c, b in (("th", "3.0"), ("tc", "1.0"))
    for i in range(len(_WORDS))
)
_ANY = " OR ".join(f"{c}_{i} > 0" for c in ("th", "tc") for i in range(len(_WORDS)))
_DF = ", ".join(f"sum(({c}_{i} > 0)::INT)::DOUBLE AS df_{c}_{i}" for c in ("th", "tc") for i in range(len(_WORDS)))
_BM25 = f"""tf AS (SELECT chunk_id, len(th)::DOUBLE AS lth, len(tc)::DOUBLE AS ltc, {_TF} FROM terms),
st AS (SELECT count(*)::DOUBLE AS n, avg(lth) AS ath, avg(ltc) AS atc, {_DF} FROM tf),
bm AS (SELECT chunk_id, round({_BM}, 9) AS score FROM tf, st WHERE {_ANY})"""
_PAIRS = "pos AS (SELECT chunk_id, unnest(tc) AS w, generate_subscripts(tc, 1) AS p FROM terms)"
_CASES = "(SELECT 'c' || (item_id % 11) AS expected, list_transform(range(0, 8), lambda i: 'c' || ((item_id * 7 + i * 3 + {s}) % 11)) AS ranked, item_id % 4 + 1 AS rounds, 'case-' || item_id AS name, CASE WHEN item_id % 4 > 0 THEN 'cat' || (item_id % 4) END AS category FROM benchmark)"
_PLACE = "coalesce(list_position(ranked[1:5], expected), 0)"
_SUM = f"round(avg(CASE WHEN {_PLACE} > 0 THEN 1.0::DOUBLE / {_PLACE} ELSE 0 END), 6) AS mrr_at_5, round(avg(CASE WHEN {_PLACE} > 0 THEN 1.0::DOUBLE / log2({_PLACE} + 1) ELSE 0 END), 6) AS ndcg_at_5"
_HIT = f"round(avg(({_PLACE} > 0)::INT), 6) AS hit_at_5"
_RES = """(SELECT event_id AS e, event_id::VARCHAR AS id, CASE WHEN event_id % 9 > 0 THEN event_type END AS category, event_id % 5 <> 0 AS activated, (event_id + {r}) % 3 = 0 AS passed, event_id % 11 = 0 AS skipped,
 (event_id + {r}) % 9 AS num_turns, value / 1000 AS cost, value * (10 + {r}) AS dur FROM events)"""
_RATES = "round(avg(activated::INT), 6) AS activation_rate, round(coalesce(sum((passed AND NOT skipped)::INT)::DOUBLE / nullif(sum((NOT skipped)::INT), 0), 0), 6) AS pass_rate"
_SCORE = "SELECT 'clarity' AS metric, (event_id % 10)::DOUBLE AS v FROM events WHERE event_id % 10 > {r} UNION ALL SELECT 'use', (event_id % 7)::DOUBLE FROM events WHERE event_id % 7 > {r}"
_CONV = "conv AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations)"
_CONVERSATION_CHUNKS = f"""WITH {_CONV} SELECT 'conversations/' || conv_id || '.md#_preamble' AS chunk_id, '' AS heading, 0 AS chunk_index FROM conversations GROUP BY conv_id
UNION ALL SELECT 'conversations/' || conv_id || '.md#conversation-' || conv_id || '/' || role || CASE WHEN k > 1 THEN '-' || k ELSE '' END, role, i::INT FROM conv"""
_SLUG = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9 -]', '', 'g'), ' +', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"
_WAYS = "ways AS (SELECT 'c' || conv_id || '.md' AS path, CASE WHEN conv_id % 3 = 0 THEN CASE WHEN count(*) >= 2 THEN 'h1' ELSE 'file' END WHEN conv_id % 3 = 1 THEN CASE WHEN count(*) >= 2 THEN 'h2' ELSE 'file' END ELSE CASE WHEN count(*) >= 2 THEN 'h3' ELSE 'file' END END AS way FROM conversations GROUP BY conv_id)"

_CONTEXT = f"""WITH {_CHUNKS}, tot AS (SELECT *, count(*) OVER (PARTITION BY filepath) AS total FROM chunks)
SELECT t.chunk_id, sha256(string_agg('--- Chunk: ' || n.chunk_id || ' (Chunk ' || (n.chunk_index + 1) || ' of ' || n.total || ') (' || CASE WHEN n.chunk_index = t.chunk_index THEN 'Target' WHEN n.chunk_index > t.chunk_index THEN 'Context: +' || (n.chunk_index - t.chunk_index) ELSE 'Context: ' || (n.chunk_index - t.chunk_index) END || ') ---' || chr(10) || n.content, chr(10) || chr(10) ORDER BY n.chunk_index)) AS text_sha256
FROM tot t JOIN tot n ON n.filepath = t.filepath AND n.chunk_index BETWEEN t.chunk_index - 1 AND t.chunk_index + 1 WHERE true"""
_BATCH = f"""WITH {_CHUNKS}, {_TERMS},
qs AS (SELECT item_id AS query_id, {_t('text')} AS ph FROM benchmark),
q AS (SELECT query_id, ph, list_sort(list_distinct(ph)) AS ts FROM qs WHERE len(ph) > 0),
qt AS (SELECT query_id, unnest(ts) AS term FROM q),
occ AS (SELECT chunk_id, 'h' AS f, unnest(th) AS term FROM terms UNION ALL SELECT chunk_id, 'c', unnest(tc) FROM terms),
tf AS (SELECT chunk_id, f, term, count(*)::DOUBLE AS tf FROM occ GROUP BY ALL),
dl AS (SELECT chunk_id, 'h' AS f, len(th)::DOUBLE AS dl FROM terms UNION ALL SELECT chunk_id, 'c', len(tc)::DOUBLE FROM terms),
av AS (SELECT f, count(*)::DOUBLE AS n, avg(dl) AS a FROM dl GROUP BY f),
df AS (SELECT f, term, count(*)::DOUBLE AS df FROM tf GROUP BY f, term),
m AS (SELECT query_id, chunk_id, round(sum(CASE f WHEN 'h' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END * ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a)) ORDER BY term, f), 9) AS score
  FROM qt JOIN tf USING (term) JOIN dl USING (chunk_id, f) JOIN av USING (f) JOIN df USING (f, term){{allowed}} GROUP BY query_id, chunk_id),
cand AS (SELECT query_id, chunk_id FROM qt JOIN (SELECT DISTINCT chunk_id, term FROM tf WHERE f = 'c') USING (term) GROUP BY query_id, chunk_id HAVING count(*) = (SELECT len(ts) FROM q WHERE q.query_id = qt.query_id)),
pc AS (SELECT query_id, chunk_id, len(list_filter(range(1, len(tc) - len(ph) + 2), lambda i: tc[i:i + len(ph) - 1] = ph)) AS score FROM cand JOIN q USING (query_id) JOIN terms USING (chunk_id){{allowed}}),
l AS (SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)) AS s, 1 AS o FROM m
  UNION ALL SELECT query_id, chunk_id, 1.25::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)), 2 FROM pc WHERE score > 0),
fu AS (SELECT query_id, chunk_id, round(coalesce(max(s) FILTER (o = 1), 0) + coalesce(max(s) FILTER (o = 2), 0), 6) AS score FROM l GROUP BY ALL)
SELECT query_id, rank::INT AS rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fu) WHERE rank <= 10"""

_RUN_FOLD = """WITH e AS (SELECT *, event_id // 64 AS run FROM events),
x AS (SELECT run, count(*) FILTER (event_id % 4 = 0) AS t, 't' || max(event_id) FILTER (event_id % 4 = 0) AS said, coalesce(sum(event_id % 100) FILTER (event_id % 4 = 0), 0) AS i, coalesce(sum(event_id % 7) FILTER (event_id % 4 = 0), 0) AS o,
  count(*) FILTER (event_id % 8 = 5) AS bash, count(*) FILTER (event_id % 8 = 1) AS search, max(value) FILTER (event_id % 64 = 63) AS cost, count(*) FILTER (event_id % 64 = 63) AS done FROM e GROUP BY run),
p AS (SELECT c.run, count(*) AS n, count(r.event_id) AS answered, coalesce(sum(r.event_id % 13), 0) AS chars FROM e c LEFT JOIN events r ON r.event_id = c.event_id + 1 WHERE c.event_id % 4 = 1 GROUP BY c.run)
SELECT 'run-' || run AS scenario, CASE WHEN done > 0 AND run % 3 > 0 THEN run % 3 ELSE t END::BIGINT AS num_turns, CASE WHEN done > 0 AND run % 2 = 0 THEN 'end ' || run ELSE said END AS final_answer, CASE WHEN done > 0 AND run % 5 > 0 THEN run % 5 ELSE i END::BIGINT AS input_tokens, o::BIGINT AS output_tokens,
  round(coalesce(cost / 1000, 0), 9) AS cost_usd, CASE WHEN done > 0 AND run % 2 = 1 THEN 1 ELSE 0 END::BIGINT AS errors, bash AS bash_calls, search AS search_calls, bash + search AS calls, coalesce(answered, 0)::BIGINT AS answered, coalesce(n - answered, 0)::BIGINT AS pending, coalesce(chars, 0)::BIGINT AS result_chars, coalesce(10 * answered, 0)::BIGINT AS call_ms
FROM x LEFT JOIN p USING (run)"""


def oracle_sql() -> dict[str, str]:
    w = f"WITH {_CHUNKS}"
    bm25 = f"{w}, {_TERMS}, {_BM25} SELECT chunk_id, score FROM bm"
    phrase = f"{w}, {_TERMS}, {_PAIRS} SELECT a.chunk_id, count(*) AS n FROM pos a JOIN pos b ON a.chunk_id = b.chunk_id AND b.p = a.p + 1 WHERE a.w = 'of' AND b.w = 'the' GROUP BY 1"
    runs = "SELECT {rates}, round(avg(num_turns), 6) AS t, round(avg(cost), 6) AS c, round(avg(dur), 6) AS d FROM {res}"
    return {
        "indexed_match": bm25,
        "indexed_phrase": phrase,
        "batched_search": _BATCH.replace("{allowed}", ""),
        "batched_filtered": _BATCH.replace("{allowed}", " WHERE chunk_id IN (SELECT chunk_id FROM chunks WHERE (scope = 'sdk-specific' AND language = 'en') OR scope = 'global-guide' OR (scope NOT IN ('sdk-specific', 'global-guide') AND language IN ('', 'en')))"),
        "segmented_match": bm25,
        "block_max_top": f"{bm25} ORDER BY score DESC, chunk_id LIMIT 20",
        "get_doc_lookup": f"{_CONTEXT} AND t.doc_id = (SELECT min(doc_id) FROM documents) GROUP BY t.chunk_id",
        "exact_quantiles": "SELECT event_type, round(quantile_disc(value, 0.5), 9) AS p50, round(quantile_disc(value, 0.95), 9) AS p95, round(quantile_cont(value, 0.5), 9) AS median, quantile_disc(event_id, 1.0::DOUBLE / 3) AS third FROM events GROUP BY event_type",
        "segmented_terms": f"""{w}, {_TERMS} SELECT term, field, count(*) AS df FROM (SELECT DISTINCT chunk_id, 'heading' AS field, unnest(th) AS term FROM terms UNION ALL SELECT DISTINCT chunk_id, 'content_text', unnest(tc) FROM terms) GROUP BY ALL""",
        "ivf_pq_knn": """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0),
d AS (SELECT query_id, vec_id, list_distance(embedding::DOUBLE[], q) AS d FROM embeddings, q)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id)::INT AS rank, vec_id, round(d, 6) AS distance FROM d QUALIFY rank <= 10""",
        "incremental_chunks": f"SELECT *, regexp_extract(chunk_id, '([0-9]+)', 1)::BIGINT % 3 > 0 AND regexp_extract(chunk_id, '([0-9]+)', 1)::BIGINT % 4 <> 2 AS taken_over FROM ({_CONVERSATION_CHUNKS})",
        "duplicate_slugs": f"WITH {_CONV} SELECT 'conversations/' || conv_id || '.md#conversation-' || conv_id || '/' || role || '-' || k AS chunk_id, k::VARCHAR AS nth FROM conv WHERE k > 1",
        "hash_embedding": f"""{w}, b AS (SELECT chunk_id, hex(encode(content)) AS x, octet_length(encode(content)) AS n FROM chunks),
e AS (SELECT chunk_id, i % 64 AS k, sum((CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END) * ('0x' || substring(x, (2 * i + 1)::INT, 2))::INT)::DOUBLE AS y FROM (SELECT chunk_id, x, unnest(range(n)) AS i FROM b) GROUP BY ALL),
a AS (SELECT chunk_id, k, coalesce(y, 0) AS y FROM (SELECT chunk_id, unnest(range(64)) AS k FROM chunks) LEFT JOIN e USING (chunk_id, k)),
r AS (SELECT chunk_id, sqrt(sum(y * y)) AS r FROM a GROUP BY chunk_id)
SELECT chunk_id, string_agg(round((CASE WHEN r > 0 THEN y / r ELSE y END)::FLOAT::DOUBLE * 1000)::BIGINT::VARCHAR, ',' ORDER BY k) AS codes FROM a JOIN r USING (chunk_id) GROUP BY chunk_id""",
        "scenario_verdicts": "SELECT event_id, event_id % 7 <> 0 AND event_id % 3 > 0 AND NOT skipped AS passed, skipped FROM (SELECT event_id, event_id % 17 = 0 OR contains(event_id::VARCHAR, '529') AS skipped FROM events)",
        "trend_rows": f"""WITH a AS ({runs.format(rates=_RATES, res=_RES.format(r=0))}), b AS ({runs.format(rates=_RATES, res=_RES.format(r=1))}),
x AS (SELECT unnest(['pass_rate', 'avg_turns', 'avg_cost_usd', 'avg_duration_ms']) AS metric, unnest([b.pass_rate, b.t, b.c, b.d]) AS previous, unnest([a.pass_rate, a.t, a.c, a.d]) AS current FROM a, b)
SELECT metric, previous, current, round(current - previous, 6) AS change, CASE WHEN abs(current - previous) < 0.001 THEN 'same' WHEN (current > previous) = (metric = 'pass_rate') THEN 'better' ELSE 'worse' END AS verdict FROM x""",
        "tool_pairs": """WITH r AS (SELECT user_id AS scenario, event_id AS seq, event_id // 2 AS call_id, repeat('x', (event_id % 13)::INT) AS result FROM events),
f AS (SELECT scenario, call_id, arg_min(result, seq) AS result FROM r WHERE call_id % 3 > 0 GROUP BY ALL)
SELECT c.scenario, count(*) AS calls, coalesce(sum(length(f.result)), 0)::BIGINT AS result_chars FROM r c LEFT JOIN f USING (scenario, call_id) WHERE c.seq % 4 = 0 GROUP BY c.scenario""",
        "text_and_file_assertions": "SELECT conv_id, turn, contains(coalesce(text, ''), 'the') AS has, NOT contains(coalesce(text, ''), 'the') AS has_not, regexp_matches(coalesce(text, ''), '^[a-mA-M]') AS starts, contains(coalesce(text, ''), 'and') AS file_has, false AS no_file FROM conversations",
        "feedback_scores": "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN (event_id % 10)::DOUBLE END AS clarity FROM events",
        "written_files": "SELECT event_id, CASE WHEN event_id % 5 = event_id % 2 THEN '/work/f' || (event_id % 5) ELSE '/work/f' || (event_id % 5) || ',/work/f' || (event_id % 2) END AS paths FROM events",
        "latest_runs": "SELECT event_type AS suite, max('run-' || event_id) AS run FROM events GROUP BY event_type",
        "changed_assertions": "SELECT event_id AS id, event_id % 3 AS key, event_id % 4 < 2 AS passed_now FROM events WHERE (event_id % 4 < 2) <> ((event_id + 1) % 4 < 2)",
        "benchmark_report": "SELECT lang AS label, count(*) AS cases, round(sum(n_chars) / 1000000.0::DOUBLE, 6) AS index_by_corpus, round(0.25::DOUBLE * CASE lang WHEN 'en' THEN 0.13::DOUBLE WHEN 'fr' THEN 0.02::DOUBLE ELSE 0 END, 6) AS embedding_cost, round(0.00002::DOUBLE * CASE lang WHEN 'en' THEN 0.13::DOUBLE WHEN 'fr' THEN 0.02::DOUBLE ELSE 0 END, 9) AS query_cost FROM documents GROUP BY lang",
        "chunk_id_forms": r"SELECT item_id, regexp_matches(text, '^[^#\s]+(#[^#\s]+)?$') AS text_is_id, regexp_matches('a/b.md#' || replace(text, ' ', '-'), '^[^#\s]+(#[^#\s]+)?$') AS made_is_id, 'a/' || item_id AS path FROM benchmark",
        "metadata_keys": "SELECT 'language' AS key FROM documents UNION SELECT 'empty' FROM documents UNION SELECT source || '-' || (doc_id % 51) FROM documents",
        "configured_taxonomy": """WITH t AS (SELECT doc_id, source || '-' || (doc_id % 51) AS tag, lang FROM documents),
v AS (SELECT DISTINCT tag AS key, (doc_id % 3)::VARCHAR AS v FROM t UNION SELECT 'language', lang FROM t)
SELECT key, key IN (SELECT tag FROM t WHERE doc_id % 5 = 0) AS vector_collapse, string_agg(v, ',' ORDER BY v) AS values FROM v GROUP BY key""",
        "unused_keys": "SELECT source || '-' || (doc_id % 51) AS key FROM documents EXCEPT SELECT source || '-' || (doc_id % 51) FROM documents WHERE doc_id % 3 = 0",
        "resolved_settings": """WITH x AS (SELECT *, lang <> 'es' AS m, doc_id % 4 AS r, doc_id % 10 = 7 AS seven FROM documents)
SELECT 'sdk/' || lang || '/' || source || '/' || doc_id || '.md' AS path, CASE WHEN r = 0 THEN 'h3' WHEN r = 1 THEN 'file' WHEN m AND source = 'src1' THEN 'file' WHEN m AND lang = 'en' THEN 'h1' WHEN m AND lang = 'fr' THEN 'h3' ELSE 'h2' END AS chunk_by,
  CASE WHEN m AND r <> 0 AND source <> 'src1' THEN 900 END::INT AS max_size,
  array_to_string(list_filter([CASE WHEN r = 0 THEN 'kind=front' WHEN m THEN 'kind=base' END, CASE WHEN m THEN 'language=' || lang END, CASE WHEN m AND source = 'src1' THEN 'scope=one' END, CASE WHEN m AND seven THEN 'seven=yes' END], lambda z: z IS NOT NULL), ',') AS metadata,
  CASE WHEN r = 0 THEN 'Front ' ELSE 'Title ' END || doc_id AS title, m AS has_manifest FROM x""",
        "nearest_manifest": """WITH p AS (SELECT 'sdk/' || lang || '/' || source || '/' || (doc_id % 5) || '/' || doc_id || '.md' AS path FROM documents),
m AS (SELECT 'sdk/' || lang AS dir FROM documents WHERE lang <> 'es' UNION SELECT 'sdk/' || lang || '/' || source FROM documents WHERE doc_id % 7 = 0 UNION SELECT 'sdk/' || lang || '/' || source || '/' || (doc_id % 5) FROM documents WHERE doc_id % 31 = 0)
SELECT path, arg_max(dir, length(dir)) AS dir FROM p LEFT JOIN m ON starts_with(path, dir || '/') GROUP BY path""",
        "metadata_extraction": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'lang=' || lang || ',source=' || source ELSE 'lang=' || lang END AS metadata FROM documents",
        "hybrid_rrf": f"""{w}, {_FLAT}, {_SNIPPET}, {_TERMS}, {_BM25}, {_PAIRS},
ph AS (SELECT a.chunk_id, count(*) AS score FROM pos a JOIN pos b ON a.chunk_id = b.chunk_id AND b.p = a.p + 1 AND a.w = 'of' AND b.w = 'the' GROUP BY 1),
vq AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
ve AS (SELECT chunk_id, round(list_distance(embedding::DOUBLE[], q), 9) AS score FROM embeddings JOIN chunks ON vec_id = doc_id, vq),
l AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS r, 1.0::DOUBLE AS wt, 1 AS o FROM bm UNION ALL SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id), 1.25::DOUBLE, 2 FROM ph UNION ALL SELECT chunk_id, row_number() OVER (ORDER BY score, chunk_id), 1.0::DOUBLE, 3 FROM ve),
fu AS (SELECT chunk_id, round(coalesce(max(wt / (60 + r)) FILTER (o = 1), 0) + coalesce(max(wt / (60 + r)) FILTER (o = 2), 0) + coalesce(max(wt / (60 + r)) FILTER (o = 3), 0), 6) AS score FROM l GROUP BY chunk_id ORDER BY 2 DESC, 1 LIMIT 50)
SELECT chunk_id, score, snippet FROM fu JOIN snippets USING (chunk_id)""",
        "normalize_tokenize": f"{w}, {_TERMS} SELECT chunk_id, len(tc)::INT AS n_tokens, array_to_string(tc[1:8], ' ') AS head FROM terms",
        "slugify": f"SELECT doc_id, coalesce(nullif({_SLUG.format(x='text')}, ''), 'section') AS slug FROM documents",
        "snippet": f"{w}, {_FLAT}, {_SNIPPET} SELECT chunk_id, snippet FROM snippets",
        "lexical_topk": f"{w}, {_FLAT}, {_LEX} SELECT chunk_id, score FROM scored WHERE score > 0 ORDER BY score DESC, chunk_id LIMIT {PAGE}",
        "page_two": f"{w}, {_FLAT}, {_LEX} SELECT chunk_id, score FROM scored WHERE score > 0 ORDER BY score DESC, chunk_id LIMIT {PAGE} OFFSET {PAGE}",
        "bm25_match": bm25,
        "phrase_exact": phrase,
        "phrase_slop2": f"{w}, {_TERMS}, {_PAIRS} SELECT a.chunk_id, count(DISTINCT a.p) AS n FROM pos a JOIN pos b ON a.chunk_id = b.chunk_id AND b.p BETWEEN a.p + 1 AND a.p + 3 WHERE a.w = 'of' AND b.w = 'the' GROUP BY 1",
        "vector_knn_l2": "SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, list_distance(embedding::DOUBLE[], list_transform(range(64), lambda i: 0.1::DOUBLE)) AS d FROM embeddings) ORDER BY d, vec_id LIMIT 20",
        "facet_equality": f"{w} SELECT chunk_id FROM chunks WHERE language = 'en' AND scope = 'blog'",
        "facet_auto_include": f"{w} SELECT chunk_id FROM chunks WHERE (scope = 'sdk-specific' AND language = 'fr') OR scope = 'global-guide' OR (scope NOT IN ('sdk-specific', 'global-guide') AND language IN ('', 'fr'))",
        "facet_scope": f"{w} SELECT chunk_id FROM chunks WHERE language = 'fr' AND scope = 'sdk-specific'",
        "variant_collapse": f"{w}, {_FLAT}, {_LEX} SELECT chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY 'sdk/*/' || string_split(filepath, '/')[3] || ':' || heading ORDER BY score DESC, chunk_id) AS k FROM scored WHERE score > 0) WHERE k = 1",
        "hint_suggestions": f"{w}, {_FLAT}, m AS (SELECT * FROM flat WHERE contains(c, 'idiot') OR contains(h, 'idiot')) SELECT key, string_agg(DISTINCT v, ',' ORDER BY v) AS values FROM (SELECT 'language' AS key, language AS v FROM m WHERE language NOT IN ('', 'xx') UNION ALL SELECT 'scope', scope FROM m WHERE scope NOT IN ('', 'blog')) GROUP BY key",
        "get_doc_context": f"{_CONTEXT} GROUP BY t.chunk_id",
        "get_doc_full": f"{w} SELECT filepath, sha256(string_agg(content, chr(10) || chr(10) ORDER BY chunk_index)) AS text_sha256 FROM chunks GROUP BY filepath",
        "list_filepaths": f"{w} SELECT filepath, chunk_id FROM chunks WHERE language = 'de' AND chunk_index = 0",
        "resource_entries": f"{w} SELECT filepath, chunk_id FROM chunks WHERE (language = 'es' OR scope = 'global-guide') AND chunk_index = 0",
        "resource_titles": "SELECT DISTINCT 'api/' || lang || '/json-' || source || '.md' AS filepath, 'API / ' || upper(lang[1]) || lang[2:] || ' / JSON ' || source AS title FROM documents",
        "taxonomy_build": f"{w} SELECT 'language' AS key, string_agg(DISTINCT language, ',' ORDER BY language) AS values FROM chunks UNION ALL SELECT 'scope', string_agg(DISTINCT scope, ',' ORDER BY scope) FROM chunks WHERE scope <> ''",
        "corpus_stats": f"{w} SELECT count(*) AS total_chunks, count(DISTINCT filepath) AS total_files FROM chunks",
        "chunk_conversations": _CONVERSATION_CHUNKS,
        "suggest_chunk_by": f"WITH {_WAYS} SELECT path, way FROM ways",
        "majority_default": f"WITH {_WAYS} SELECT way, count(*) AS n FROM ways GROUP BY way ORDER BY n DESC, list_position(['h2', 'h1', 'h3', 'file'], way) LIMIT 1",
        "chunk_fingerprint": f"{w} SELECT chunk_id, sha256('{{\"chunk_by\":\"h2\"}}' || chr(0) || '{{}}' || chr(0) || content) AS fingerprint FROM chunks",
        "cache_partition": f"""{w}, inp AS (SELECT doc_id, sha256('1' || chr(0) || 'cfg' || chr(0) || 'Context: ' || filepath || ' > ' || heading || chr(10) || chr(10) || 'Content:' || chr(10) || content) AS f FROM chunks),
hit AS (SELECT DISTINCT f FROM inp WHERE doc_id % 3 <> 0) SELECT count(*) AS total, count(hit.f) AS hits, count(*) - count(hit.f) AS misses, round(100.0::DOUBLE * count(hit.f) / count(*), 6) AS hit_percent FROM inp LEFT JOIN hit ON inp.f = hit.f""",
        "eval_summary": f"SELECT {_SUM}, round(avg(rounds), 6) AS avg_rounds, {_HIT} FROM {_CASES.format(s=0)}",
        "eval_by_category": f"SELECT coalesce(category, 'uncategorized') AS category, count(*) AS case_count, {_HIT}, {_SUM} FROM {_CASES.format(s=0)} GROUP BY 1",
        "eval_delta": f"""WITH c AS (SELECT {_SUM}, round(avg(rounds), 6) AS avg_rounds, {_HIT} FROM {_CASES.format(s=0)}), b AS (SELECT {_SUM}, round(avg(rounds), 6) AS avg_rounds, {_HIT} FROM {_CASES.format(s=2)})
SELECT metric, b AS baseline, c AS current, round(c - b, 6) AS delta FROM (SELECT unnest(['mrr_at_5', 'ndcg_at_5', 'avg_rounds', 'hit_at_5']) AS metric, unnest([b.mrr_at_5, b.ndcg_at_5, b.avg_rounds, b.hit_at_5]) AS b, unnest([c.mrr_at_5, c.ndcg_at_5, c.avg_rounds, c.hit_at_5]) AS c FROM b, c)""",
        "eval_flips": f"""SELECT name, CASE WHEN bp > 0 THEN 'regression' ELSE 'improvement' END AS kind, br AS baseline_rank, cr AS current_rank FROM
(SELECT name, {_PLACE} AS cp, coalesce(list_position(ranked, expected)::VARCHAR, 'N/F') AS cr FROM {_CASES.format(s=0)}) JOIN (SELECT name, {_PLACE} AS bp, coalesce(list_position(ranked, expected)::VARCHAR, 'N/F') AS br FROM {_CASES.format(s=2)}) USING (name) WHERE (cp > 0) <> (bp > 0)""",
        "eval_rounds": f"SELECT name, (CASE WHEN r IS NOT NULL AND ceil(r / 2.0) <= 3 THEN ceil(r / 2.0) ELSE 4 END)::INT AS rounds FROM (SELECT name, list_position(ranked, expected) AS r FROM {_CASES.format(s=0)})",
        "latency_percentiles": "SELECT event_type, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95 FROM events GROUP BY event_type",
        "agent_summary": f"""SELECT count(*) AS total_scenarios, {_RATES}, round(avg(num_turns), 6) AS avg_turns, quantile_cont(num_turns, 0.5)::DOUBLE AS median_turns, round(avg(cost), 6) AS avg_cost_usd, round(sum(cost), 6) AS total_cost_usd, round(avg(dur), 6) AS avg_duration_ms,
round(quantile_cont(dur, 0.5), 6) AS median_duration_ms, round(avg(e % 1000), 6) AS avg_input_tokens, round(avg(e % 300), 6) AS avg_output_tokens, round(avg(e % 200), 6) AS avg_cache_read_tokens, round(avg(CASE WHEN e % 2 = 0 THEN e % 50 ELSE 0 END), 6) AS avg_cache_creation_tokens, round(avg(e % 4), 6) AS avg_tool_calls FROM {_RES.format(r=0)}""",
        "agent_by_category": f"SELECT coalesce(category, 'uncategorized') AS category, count(*) AS scenario_count, {_RATES}, round(avg(num_turns), 6) AS avg_turns, round(avg(cost), 6) AS avg_cost_usd FROM {_RES.format(r=0)} GROUP BY 1",
        "tool_usage": "SELECT 'mcp__docs__search' AS tool, sum(event_id % 4)::BIGINT AS calls FROM events UNION ALL SELECT 'mcp__docs__get', sum(event_id % 2)::BIGINT FROM events",
        "feedback_means": f"SELECT metric, round(avg(v), 6) AS mean FROM ({_SCORE.format(r=0)}) GROUP BY metric",
        "comparison_outcomes": f"SELECT CASE WHEN w.passed AND NOT o.passed THEN 'gained' WHEN NOT w.passed AND o.passed THEN 'lost' WHEN w.passed THEN 'both_pass' ELSE 'both_fail' END AS outcome, count(*) AS n, sum(w.num_turns - o.num_turns)::BIGINT AS turns_delta FROM {_RES.format(r=0)} w JOIN {_RES.format(r=1)} o USING (id) GROUP BY 1",
        "comparison_deltas": f"""WITH a AS (SELECT {_RATES}, round(avg(num_turns), 6) AS t, round(avg(cost), 6) AS c, round(sum(cost), 6) AS s, round(avg(dur), 6) AS d FROM {_RES.format(r=0)}), b AS (SELECT {_RATES}, round(avg(num_turns), 6) AS t, round(avg(cost), 6) AS c, round(sum(cost), 6) AS s, round(avg(dur), 6) AS d FROM {_RES.format(r=1)})
SELECT unnest(['pass_rate', 'avg_turns', 'avg_cost_usd', 'total_cost_usd', 'avg_duration_ms']) AS metric, round(unnest([a.pass_rate - b.pass_rate, a.t - b.t, a.c - b.c, a.s - b.s, a.d - b.d]), 6) AS delta FROM a, b
UNION ALL SELECT 'score:' || metric, round(x.m - y.m, 6) FROM (SELECT metric, round(avg(v), 6) AS m FROM ({_SCORE.format(r=0)}) GROUP BY 1) x JOIN (SELECT metric, round(avg(v), 6) AS m FROM ({_SCORE.format(r=1)}) GROUP BY 1) y USING (metric)""",
        "changed_scenarios": f"SELECT id AS key, CASE WHEN c.passed THEN 'fixed' ELSE 'broken' END AS change FROM {_RES.format(r=0)} c JOIN {_RES.format(r=1)} p USING (id) WHERE c.passed <> p.passed",
        "agent_event_fold": """SELECT user_id::VARCHAR AS scenario, count(*) FILTER (event_id % 4 = 0) AS num_turns, 't' || max(event_id) FILTER (event_id % 4 = 0) AS final_answer, coalesce(sum(event_id % 100) FILTER (event_id % 4 = 1), 0)::BIGINT AS input_tokens,
coalesce(sum(event_id % 7) FILTER (event_id % 4 = 1), 0)::BIGINT AS output_tokens, count(*) FILTER (event_id % 4 = 2) AS bash_calls FROM events WHERE event_id % 4 < 3 GROUP BY user_id""",
        "run_fold": _RUN_FOLD,
        "run_fold_streamed": _RUN_FOLD,
        "run_pairs": """SELECT 'run-' || (c.event_id // 64) AS scenario, 'c' || (c.event_id // 4) AS call_id, CASE WHEN c.event_id % 8 = 1 THEN 'mcp__docs__search' ELSE 'Bash' END AS tool, r.event_id % 13 AS result_chars, CASE WHEN r.event_id IS NOT NULL THEN 10::BIGINT END AS ms
FROM events c LEFT JOIN events r ON r.event_id = c.event_id + 1 WHERE c.event_id % 4 = 1""",
        "packed_parts": """WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, length(text) % 300 + 1 AS n FROM conversations),
a AS (SELECT conv_id, 0 AS k, 0 AS h, 6 AS n FROM t GROUP BY conv_id
  UNION ALL SELECT conv_id, k, 0, length('### Sub ' || ((k - 1) // 3 + 1)) FROM t WHERE conv_id % 2 = 0 AND (k - 1) % 3 = 0 UNION ALL SELECT conv_id, k, 1, n FROM t),
w AS (SELECT conv_id, sum(n) + 2 * (count(*) - 1) AS size FROM a GROUP BY conv_id),
u AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 AND size > 400 AND k > 0 THEN (k - 1) // 3 + 1 ELSE 0 END AS sub, k, h, n FROM a JOIN w USING (conv_id)),
b AS (SELECT conv_id, sub, row_number() OVER (PARTITION BY conv_id, sub ORDER BY k, h) AS i, n, sum(n) OVER (PARTITION BY conv_id, sub) + 2 * (count(*) OVER (PARTITION BY conv_id, sub) - 1) AS size FROM u),
g AS (SELECT conv_id, sub, i, n, 1 AS part, CASE WHEN size <= 400 THEN 1000000 ELSE 400 - n END AS room FROM b WHERE i = 1
  UNION ALL SELECT b.conv_id, b.sub, b.i, b.n, CASE WHEN b.n > g.room THEN g.part + 1 ELSE g.part END, CASE WHEN b.n > g.room THEN 400 - b.n ELSE g.room - b.n END FROM g JOIN b ON b.conv_id = g.conv_id AND b.sub = g.sub AND b.i = g.i + 1),
p AS (SELECT conv_id, sub, part, sum(n) AS n, count(*) AS c FROM g GROUP BY ALL),
o AS (SELECT *, max(CASE WHEN part = 1 OR n + 2 * (c - 1) >= 80 THEN part END) OVER (PARTITION BY conv_id, sub ORDER BY part) AS own FROM p)
SELECT 'c/' || conv_id || '.md#sec' || CASE WHEN sub > 0 THEN '/sub-' || sub ELSE '' END || CASE WHEN own > 1 THEN '-part-' || own ELSE '' END AS chunk_id, (row_number() OVER (PARTITION BY conv_id ORDER BY sub, own) - 1)::INT AS chunk_index, (sum(n) + 2 * (sum(c) - 1))::INT AS n_chars FROM o GROUP BY conv_id, sub, own""",
        "token_cost": "SELECT lang AS model, round((coalesce(CASE lang WHEN 'en' THEN 3.0::DOUBLE WHEN 'fr' THEN 1.25::DOUBLE END, 0) * (sum(n_chars) - count(*)) + count(*) * coalesce(CASE lang WHEN 'en' THEN 0.3::DOUBLE WHEN 'fr' THEN 0.125::DOUBLE END, 0) + sum(doc_id % 100) * coalesce(CASE lang WHEN 'en' THEN 15.0::DOUBLE WHEN 'fr' THEN 10.0::DOUBLE END, 0)) / 1e6::DOUBLE, 6) AS cost_usd FROM documents GROUP BY lang",
    }
