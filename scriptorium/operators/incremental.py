"""Incremental building: files and vectors are done anew only where their fingerprint changed."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import embedding_input, joined_hash

from . import vectors
from .chunking import chunk_files

#: Versions of the cache's form and of what is embedded; another makes a cache useless.
CACHE_VERSION, INPUT_VERSION = 1, 1
CANARY_FILES = 10


def file_fingerprint(markdown: Column, strategy: Column, metadata: Column) -> Column:
    """Of a file's text and settings; the order of metadata doesn't matter."""
    return joined_hash(F.to_json(strategy), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(metadata)))), markdown)


def config_fingerprint(fields: Mapping[str, object]) -> str:
    return hashlib.sha256("\0".join(f"{k}={v}" for k, v in sorted(fields.items())).encode()).hexdigest()


def vector_fingerprint(config: str, text: Column) -> Column:
    return joined_hash(F.lit(str(INPUT_VERSION)), F.lit(config), text)


def with_fingerprints(files: DataFrame) -> DataFrame:
    return files.withColumn("file_fingerprint", file_fingerprint(F.col("markdown"), F.col("strategy"), F.col("metadata")))


def rechunk(files: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Chunks with file_fingerprint: those of unchanged files from `previous`, the others made now.

    files: path, markdown, strategy, metadata. A previous index without fingerprints isn't used.
    """
    files = with_fingerprints(files)
    marks = files.select(F.col("path").alias("filepath"), "file_fingerprint")
    if previous is None or "file_fingerprint" not in previous.columns:
        return chunk_files(files).join(marks, "filepath")
    known = previous.select(F.col("filepath").alias("path"), "file_fingerprint").distinct()
    new = chunk_files(files.join(known, ["path", "file_fingerprint"], "left_anti")).join(marks, "filepath")
    kept = previous.join(marks, ["filepath", "file_fingerprint"], "left_semi")
    return new.unionByName(kept.select(*new.columns))


def canary(files: DataFrame, previous: DataFrame) -> bool:
    """Whether a few files that haven't changed still chunk as they did."""
    marks = with_fingerprints(files)
    known = previous.select(F.col("filepath").alias("path"), "file_fingerprint").distinct()
    some = marks.join(known, ["path", "file_fingerprint"], "left_semi").orderBy("path").limit(CANARY_FILES)
    compared = ["chunk_id", "filepath", "heading", "heading_level", "content", "content_text", "breadcrumb", "chunk_index"]
    now = chunk_files(some).select(*compared)
    then = previous.join(some.select(F.col("path").alias("filepath")), "filepath", "left_semi").select(*compared)
    return not now.exceptAll(then).limit(1).count() and not then.exceptAll(now).limit(1).count()


def corpus_fingerprint(files: DataFrame) -> str:
    """Of all files and their settings, whatever their order: the key of an index of the corpus."""
    rows = with_fingerprints(files).select(F.conv(F.substring(joined_hash(F.col("path"), F.col("file_fingerprint")), 1, 15), 16, 10).cast("decimal(38,0)").alias("h"))
    r = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("h"), F.lit(0)).alias("sum"), F.coalesce(F.bit_xor(F.col("h").cast("bigint")), F.lit(0)).alias("xor")).first()
    return hashlib.sha256(f"{r['n']}:{r['sum']}:{r['xor']}".encode()).hexdigest()[:16]


# ------------------------------------------------------------------ embeddings
@dataclass
class Embedded:
    vectors: DataFrame  # chunk_id, fingerprint, vector
    cache: DataFrame  # fingerprint, chunk_id, vector of the current corpus


def fingerprinted(chunks: DataFrame, config: str) -> DataFrame:
    text = embedding_input(F.col("breadcrumb"), F.coalesce(F.nullif("content_text", F.lit("")), F.col("content")))
    return chunks.select("chunk_id", text.alias("input")).withColumn("fingerprint", vector_fingerprint(config, F.col("input")))


def embed(chunks: DataFrame, provider: vectors.Provider, cache: DataFrame | None = None) -> Embedded:
    """Vectors of all chunks: cached ones by fingerprint, the rest from the provider. The cache keeps what the corpus still has."""
    marked = fingerprinted(chunks, provider_fingerprint(provider))
    if cache is None:
        made = vectors.embedded(marked, "input", provider).select("chunk_id", "fingerprint", "vector")
    else:
        cached = cache.select("fingerprint", "vector").dropDuplicates(["fingerprint"])
        hits = marked.join(cached, "fingerprint").select("chunk_id", "fingerprint", "vector")
        misses = marked.join(cached, "fingerprint", "left_anti")
        made = hits.unionByName(vectors.embedded(misses, "input", provider).select("chunk_id", "fingerprint", "vector"))
    return Embedded(made, made.select("fingerprint", "chunk_id", "vector"))


def provider_fingerprint(provider: vectors.Provider) -> str:
    return config_fingerprint({"provider": provider.name, "dimensions": provider.dimensions})


def cache_counts(chunks: DataFrame, cache: DataFrame, config: str) -> DataFrame:
    """total, hits, misses and the share of hits in percent."""
    known = cache.select("fingerprint").distinct().withColumn("hit", F.lit(1))
    rows = fingerprinted(chunks, config).join(known, "fingerprint", "left")
    out = rows.agg(F.count("*").alias("total"), F.count("hit").alias("hits"))
    return out.select("total", "hits", (F.col("total") - F.col("hits")).alias("misses"), F.round(F.when(F.col("total") > 0, 100.0 * F.col("hits") / F.col("total")).otherwise(0.0), 6).alias("hit_percent"))


def save_cache(cache: DataFrame, base: str, config: str) -> None:
    """Write beside, move the old one away, move the new one in."""
    new, live, old = (os.path.join(base, n) for n in ("cache.new", "cache", "cache.old"))
    for d in (new, old):
        shutil.rmtree(d, ignore_errors=True)
    cache.write.parquet(f"{new}/vectors")
    with open(f"{new}/meta.json", "w", encoding="utf-8") as f:
        json.dump({"cache_version": CACHE_VERSION, "format_version": INPUT_VERSION, "config_fingerprint": config}, f)
    if os.path.exists(live):
        os.rename(live, old)
    os.rename(new, live)
    shutil.rmtree(old, ignore_errors=True)


def load_cache(spark: SparkSession, base: str, config: str) -> tuple[DataFrame | None, str | None]:
    """The cache, or None and why not."""
    live = os.path.join(base, "cache")
    if not os.path.isdir(live):
        return None, None
    try:
        with open(f"{live}/meta.json", encoding="utf-8") as f:
            meta = json.load(f)
        if (meta["cache_version"], meta["format_version"]) != (CACHE_VERSION, INPUT_VERSION):
            return None, "The embedding cache has another version and is not used."
        if meta["config_fingerprint"] != config:
            return None, "The embedding cache is of another provider and is not used."
        return spark.read.schema("fingerprint string, chunk_id string, vector array<float>").parquet(f"{live}/vectors"), None
    except Exception as e:
        return None, f"The embedding cache can't be read and is not used: {e}"


__all__ = ["Embedded", "cache_counts", "canary", "config_fingerprint", "corpus_fingerprint", "embed", "file_fingerprint", "fingerprinted", "load_cache", "provider_fingerprint", "rechunk", "save_cache", "vector_fingerprint", "with_fingerprints"]
