"""Whole runs: validate a corpus, build its index incrementally, suggest its manifest, evaluate retrieval."""

from __future__ import annotations

import contextlib
import itertools
import os
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import evaluate, incremental, index, manifest, metadata, prompts, search, vectors
from scriptorium.operators.chunking import chunk_files
from scriptorium.session import written
from scriptorium.sources import corpus


@dataclass
class Report:
    files: int = 0
    chunks: int = 0
    prompts: int = 0
    warnings: list[str] = field(default_factory=list)


def read_prompts(root: str) -> tuple[list[dict], list[str]]:
    """Prompt definitions of a corpus, and warnings."""
    paths, warnings = corpus.preferred_prompts(corpus.prompt_paths(root))
    out = []
    for p in paths:
        with open(os.path.join(root, p), encoding="utf-8") as f:
            out.append({"name": corpus.prompt_name(p), **prompts.parse(p, f.read())})
    return out, warnings


def validate(spark: SparkSession, root: str, manifest_name: str = corpus.MANIFEST_NAME) -> Report:
    """Parse and chunk everything, once; problems are raised or reported."""
    files = corpus.read_corpus(spark, root, manifest_name)
    found, warnings = read_prompts(root)
    n = files.agg(F.count("*").alias("n"), F.count_if(~F.col("has_manifest")).alias("bare")).first()
    ids = written(chunk_files(files).select("chunk_id"), "chunk-ids")
    twice = duplicate_ids(ids).orderBy("chunk_id").limit(20).collect()
    warnings += [f"{n['bare']} files have no manifest."] if n["bare"] else []
    warnings += [f"Chunk id {r['chunk_id']} is there {r['n']} times." for r in twice]
    return Report(n["n"], ids.count(), len(found), warnings)


def duplicate_ids(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1")


def build(spark: SparkSession, root: str, out: str, description: str, provider: vectors.Provider | None = None, cache_dir: str | None = None, rebuild: bool = False, manifest_name: str = corpus.MANIFEST_NAME) -> tuple[index.Index, Report]:
    """Build or bring up to date the index of a corpus: unchanged files and unchanged inputs of vectors are reused."""
    files = corpus.read_corpus(spark, root, manifest_name)
    found, warnings = read_prompts(root)
    previous = None
    if not rebuild and os.path.exists(os.path.join(out, index.POINTER)):
        previous = index.Index.open(spark, out).table("chunks").drop("vector")
        if "file_fingerprint" not in previous.columns or not incremental.canary(files, previous):
            warnings.append("The previous index isn't reused: its chunks aren't what files give now.")
            previous = None
    work = os.path.join(out, "work", f"{time.time_ns():x}")
    os.makedirs(work)
    incremental.rechunk(files, previous).write.parquet(f"{work}/chunks")
    chunks = spark.read.parquet(f"{work}/chunks")
    vecs, embedding = None, None
    if provider is not None and provider.dimensions:
        config, base = incremental.provider_fingerprint(provider), cache_dir or os.path.join(out, "embeddings")
        os.makedirs(base, exist_ok=True)
        cache, why = incremental.load_cache(spark, base, config)
        warnings += [why] if why else []
        incremental.embed(chunks, provider, cache).cache.write.parquet(f"{work}/vectors")
        vecs = spark.read.parquet(f"{work}/vectors")
        incremental.save_cache(vecs, base, config)
        embedding = {"provider": provider.name, "model": provider.name, "dimensions": provider.dimensions}
    known = corpus.manifests(root, manifest_name).values()
    config = manifest.merged_taxonomy(known)
    said = next((m.instructions for m in known if m.instructions), None)
    titles = {r["path"]: {"title": r["title"]} for r in files.where("title is not null").select("path", "title").collect()}  # a title for each file
    document = metadata.build_document(chunks, description, config, titles, found, embedding, corpus.source_commit(root), said)
    warnings += [f"No file has the taxonomy's key '{k}'." for k in sorted(set(config) - set(document["taxonomy"]))]
    made = index.build(chunks, out, document, vecs)
    return made, Report(document["stats"]["total_files"], document["stats"]["total_chunks"], len(found), warnings)


def fix(spark: SparkSession, root: str, manifest_name: str = corpus.MANIFEST_NAME) -> dict:
    """The manifest that the headings of a corpus suggest."""
    return manifest.suggest_manifest(corpus.read_corpus(spark, root, manifest_name))


def cached_index(spark: SparkSession, root: str, cache: str, description: str, provider: vectors.Provider | None = None, manifest_name: str = corpus.MANIFEST_NAME) -> tuple[index.Index, bool]:
    """The index of a corpus from a cache, and whether it was there; its key is a hash of the files, their settings and the provider."""
    key = incremental.corpus_fingerprint(corpus.read_corpus(spark, root, manifest_name))
    if provider is not None and provider.dimensions:
        key = f"{key}-{incremental.provider_fingerprint(provider)[:16]}"
    out = os.path.join(cache, key)
    if os.path.exists(os.path.join(out, index.POINTER)):
        return index.Index.open(spark, out), True
    return build(spark, root, out, description, provider, manifest_name=manifest_name)[0], False


def warm_up(engine: search.Engine | search.ScanEngine, cases: Sequence[dict], queries: int = 3, limit: int = 5) -> int:
    """Search for the cases' queries in turn, round and round, untimed, so that code is compiled and files are known; how many searches there were.

    A search that fails doesn't stop the others.
    """
    rounds = itertools.islice(itertools.cycle(cases), max(0, queries))
    done = 0
    for c in rounds:
        done += 1
        with contextlib.suppress(Exception):
            engine.search(search.Request(c["query"], c.get("filters") or {}, min(limit, c.get("limit") or limit)))
    return done


def rank_cases(engine: search.Engine | search.ScanEngine, cases: Sequence[dict], limit: int = 5, most_rounds: int = 3) -> tuple[list[dict], list[float]]:
    """Ranked cases of a retrieval evaluation, and milliseconds of each search: pages are asked for until the expected chunk is there."""
    out, times = [], []
    for c in cases:
        ids: list[str] = []
        after, rounds, most = None, 0, c.get("maxRounds") or most_rounds
        while rounds < most:
            began = time.perf_counter()
            page = engine.search(search.Request(c["query"], c.get("filters") or {}, c.get("limit") or limit, after))
            times.append(1000 * (time.perf_counter() - began))
            rounds += 1
            ids += [h["chunk_id"] for h in page.hits if h["chunk_id"] not in ids]
            after = page.next_cursor
            if c["expectedChunkId"] in ids or after is None:
                break
        found = c["expectedChunkId"] in ids
        out.append({"expected": c["expectedChunkId"], "ranked": ids, "rounds": rounds if found else most + 1, "name": c.get("name"), "category": c.get("category")})
    return out, times


def evaluate_retrieval(spark: SparkSession, engine: search.Engine | search.ScanEngine, cases: Sequence[dict], warm: int = 3) -> dict:
    """Summary of an engine over evaluation cases, with the peak memory of this process and its children."""
    with evaluate.PeakMemory() as memory:
        warm_up(engine, cases, warm)
        ranked, times = rank_cases(engine, cases)
    rows = spark.createDataFrame([(c["expected"], c["ranked"], c["rounds"], c["name"], c["category"]) for c in ranked], "expected string, ranked array<string>, rounds int, name string, category string")
    ms = spark.createDataFrame([(t,) for t in times], "ms double")
    return evaluate.full_summary(rows, ms, ms.where("false"), peak_mb=memory.mb or 0.0).first().asDict()
