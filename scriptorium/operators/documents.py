"""Retrieval of chunks with their neighbours, whole documents, and resources."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import CHUNK_ID

from .facets import facet
from .index import Index, path_of
from .segments import SegmentedIndex

#: Most neighbours on a side, and the scheme of resources.
MOST_CONTEXT, SCHEME = 5, "docs:///"
#: Spellings of known words in titles.
SPELLINGS = {w.upper(): w for w in ".NET AGI AI API CLI CSharp CSS CSV HTML HTTP HTTPS ID IP JavaScript JS JSON JSONL JWE JWK JWS JWT LLM Markdown MCP ML OpenAI OpenAPI PKI RFC SDK SQL SSE SSL TCP TLS TypeScript UDP URL UUID XML YAML".split()}


class NotFound(KeyError):
    pass


def block(context: Column) -> Column:
    """A chunk's block in the answer (fixed format)."""
    place = F.format_string("Chunk %d of %d", F.col("chunk_index") + 1, F.col("total"))
    role = F.when(context == 0, "Target").otherwise(F.concat(F.lit("Context: "), F.when(context > 0, "+").otherwise(""), context.cast("string")))
    return F.concat(F.lit("--- Chunk: "), F.col("chunk_id"), F.lit(" ("), place, F.lit(") ("), role, F.lit(") ---\n"), F.col("content"))


def in_context(chunks: DataFrame, targets: DataFrame, context: int = 0) -> DataFrame:
    """chunk_id and text of each target (chunk_id): its block and those of up to `context` neighbours on either side.

    An equi-join on file and place, whatever the number of targets and the size of files.
    """
    k = max(0, min(MOST_CONTEXT, context))
    wanted = chunks.join(targets.select("chunk_id").distinct(), "chunk_id", "left_semi").select(F.col("chunk_id").alias("target"), "filepath", F.col("chunk_index").alias("at"))
    places = wanted.select("*", F.explode(F.sequence(F.col("at") - k, F.col("at") + k)).alias("chunk_index"))
    totals = chunks.groupBy("filepath").agg(F.count("*").alias("total"))
    mine = chunks.select("chunk_id", "filepath", "chunk_index", "content")
    near = mine.join(places, ["filepath", "chunk_index"]).join(totals, "filepath")
    texts = near.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("chunk_index", block(F.col("chunk_index") - F.col("at")).alias("text")))).alias("blocks"))
    return texts.select(F.col("target").alias("chunk_id"), F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n").alias("text"))


def whole_documents(chunks: DataFrame) -> DataFrame:
    """filepath and text of each file: its chunks' contents in order."""
    parts = chunks.groupBy("filepath").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("parts"))
    return parts.select("filepath", F.array_join(F.transform("parts", lambda p: p["content"]), "\n\n").alias("text"))


def get_doc(chunks: DataFrame, chunk_id: str, context: int | None = 0) -> str:
    """One chunk with its neighbours; context -1 gives the whole document."""
    if not re.match(CHUNK_ID, chunk_id):
        raise ValueError(f"Chunk ID '{chunk_id}' has invalid format. Expected {{filepath}} or {{filepath}}#{{heading-path}}.")
    target = chunks.where(F.col("chunk_id") == chunk_id).select("chunk_id", "filepath").limit(1)
    found = target.first()
    if found is None:
        raise NotFound(f"Chunk ID '{chunk_id}' not found. Use search_docs to discover valid chunk IDs.")
    if context == -1:
        return whole_documents(chunks.where(F.col("filepath") == found["filepath"])).first()["text"]
    return in_context(chunks.where(F.col("filepath") == found["filepath"]), target, context or 0).first()["text"]


def get_doc_of(index: Index | SegmentedIndex, chunk_id: str, context: int | None = 0) -> str:
    """get_doc over an index: only the folder of the chunk's file is read."""
    path = path_of(chunk_id) if re.match(CHUNK_ID, chunk_id) else chunk_id
    return get_doc(index.chunks_of([path]), chunk_id, context)


def resource_files(chunks: DataFrame, shown: Sequence[tuple[str, str]]) -> DataFrame:
    """filepath and first chunk of the files that have any of the (facet, value) pairs shown as resources."""
    if not shown:
        return chunks.select("filepath", "chunk_id").where(F.lit(False))
    any_of = reduce(lambda a, b: a | b, (facet(k) == v for k, v in shown))
    return chunks.where(any_of & (F.col("chunk_index") == 0)).select("filepath", "chunk_id").dropDuplicates(["filepath"]).orderBy(F.collate("filepath", "UNICODE"))


def shown_values(taxonomy: Mapping[str, Mapping]) -> list[tuple[str, str]]:
    return [(k, v) for k, config in taxonomy.items() for v, p in (config.get("properties") or {}).items() if p.get("mcp_resource")]


def read_resource(chunks: DataFrame, uri: str, shown: Sequence[tuple[str, str]]) -> str:
    if not uri.startswith("docs:"):
        raise ValueError(f"Invalid URI scheme: {uri.split(':', 1)[0]}:. Expected 'docs:'")
    path = re.sub("^docs:/*", "", uri)
    if not path:
        raise ValueError(f"Invalid URI: missing filepath in '{uri}'")
    entry = resource_files(chunks.where(F.col("filepath") == path), shown).first()
    if entry is None:
        raise NotFound(f"Resource not found: {uri}")
    return get_doc(chunks, entry["chunk_id"], -1)


def spelled(part: Column) -> Column:
    """A path part in sentence case, known words as they are spelled."""
    lookup = F.create_map(*(F.lit(x) for kv in SPELLINGS.items() for x in kv))
    words = F.array_remove(F.split(F.regexp_replace(part, "([a-z0-9])([A-Z])", "$1 $2"), r"[\s_./-]+"), "")
    # Sentence case: the first word with a capital, the others lower.
    plain = F.transform(words, lambda w, i: F.when(i == 0, F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000)))).otherwise(F.lower(w)))
    return F.array_join(F.transform(plain, lambda w: F.coalesce(lookup[F.upper(w)], w)), " ")


def resource_title(filepath: Column, title: Column) -> Column:
    """Directories and the file's own title (or its name), joined by ' / '."""
    parts = F.split(filepath, "/")
    name = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    dirs = F.transform(F.slice(parts, 1, F.size(parts) - 1), spelled)
    return F.array_join(F.concat(dirs, F.array(F.coalesce(title, spelled(name)))), " / ")
