"""Manifests: how the files of a directory are chunked and what metadata they carry."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import without_fences

from .chunking import Strategy
from .markdown import first_title, front_matter

#: The manifest's version, the comment that hints at a way to chunk, and the order in which ties of suggestions are broken.
VERSION = "1"
HINT = re.compile(r"<!--\s*mcp_chunking_hint:\s*(\{[^}]+\})\s*-->")
TIE_ORDER = ("h2", "h1", "h3", "file")


class ManifestError(ValueError):
    pass


@dataclass(frozen=True)
class Override:
    pattern: str
    strategy: Strategy | None = None
    metadata: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Manifest:
    strategy: Strategy | None = None
    metadata: Mapping[str, str] = field(default_factory=dict)
    taxonomy: Mapping[str, dict] = field(default_factory=dict)
    instructions: str | None = None
    overrides: tuple[Override, ...] = ()


@dataclass(frozen=True)
class FileConfig:
    strategy: Strategy = Strategy()
    metadata: Mapping[str, str] = field(default_factory=dict)
    title: str | None = None


def _given(value: object) -> bool:
    """Empty objects are given, too."""
    return isinstance(value, (dict, list)) or bool(value)


def _mapping(value: object, name: str) -> dict:
    if not isinstance(value, dict):
        raise ManifestError(f"{name} must be an object")
    return value


def strategy_of(value: object, name: str = "strategy") -> Strategy:
    given = _mapping(value, name)
    for k in ("max_chunk_size", "min_chunk_size"):
        n = given.get(k)
        if n is not None and (not isinstance(n, int) or isinstance(n, bool) or n < 1):
            raise ManifestError(f"{name}.{k} must be a positive integer")
    try:
        return Strategy(given.get("chunk_by"), given.get("max_chunk_size"), given.get("min_chunk_size"))
    except ValueError as e:
        raise ManifestError(f"{name}: {e}") from e


def metadata_of(value: object, name: str = "metadata") -> dict[str, str]:
    out = {}
    for k, v in _mapping(value, name).items():
        if not isinstance(v, str) or not v.strip() or not str(k).strip():
            raise ManifestError(f"{name}.{k} must be a non-empty string")
        out[str(k)] = v
    return out


def taxonomy_of(value: object) -> dict[str, dict]:
    out = {}
    for key, config in _mapping(value, "taxonomy").items():
        config = _mapping(config, f"taxonomy.{key}")
        if set(config) - {"vector_collapse", "properties"} or not isinstance(config.get("vector_collapse", False), bool):
            raise ManifestError(f"Invalid taxonomy config: {key}")
        for v, p in _mapping(config.get("properties", {}), f"taxonomy.{key}.properties").items():
            if set(_mapping(p, f"taxonomy.{key}.properties.{v}")) - {"mcp_resource"} or not isinstance(p.get("mcp_resource", False), bool):
                raise ManifestError(f"Invalid taxonomy config: {key}.{v}")
        out[key] = config
    return out


def manifest_of(value: object) -> Manifest:
    given = _mapping(value, "manifest")
    if given.get("version") != VERSION:
        raise ManifestError(f"manifest.version must be '{VERSION}'")
    said = given.get("mcpServerInstructions")
    if said and (not isinstance(said, str) or not said.strip()):
        raise ManifestError("manifest.mcpServerInstructions must be a non-empty string")
    overrides = given["overrides"] if _given(given.get("overrides")) else []
    if not isinstance(overrides, list):
        raise ManifestError("overrides must be an array")
    made = []
    for n, o in enumerate(overrides):
        o = _mapping(o, f"overrides[{n}]")
        if not isinstance(o.get("pattern"), str) or not o["pattern"].strip():
            raise ManifestError(f"overrides[{n}].pattern must be a non-empty string")
        made.append(Override(o["pattern"], strategy_of(o["strategy"]) if _given(o.get("strategy")) else None, metadata_of(o["metadata"]) if _given(o.get("metadata")) else {}))
    return Manifest(strategy_of(given["strategy"]) if _given(given.get("strategy")) else None, metadata_of(given["metadata"]) if _given(given.get("metadata")) else {}, taxonomy_of(given["taxonomy"]) if _given(given.get("taxonomy")) else {}, said.strip() if said else None, tuple(made))


def parse_manifest(text: str) -> Manifest:
    try:
        return manifest_of(json.loads(text))
    except json.JSONDecodeError as e:
        raise ManifestError("Manifest is not valid JSON") from e


def glob_pattern(glob: str) -> str:
    """A path glob (*, **, ?, [..], {a,b}) as a regular expression; dots are ordinary."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            out += "[" + re.sub("^!", "^", glob[i + 1 : end]).replace("\\", "\\\\") + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def hinted_way(markdown: str) -> str | None:
    """chunk_by of the first hint comment, if it is valid."""
    if not (m := HINT.search(markdown)):
        return None
    try:
        return Strategy(json.loads(m.group(1))["chunk_by"]).chunk_by
    except (ValueError, KeyError, TypeError):
        return None


def relative_to(path: str, base: str) -> str:
    clean = lambda p: re.sub(r"^\./", "", p.replace("\\", "/"))
    path, base = clean(path), clean(base).rstrip("/")
    return path[len(base) + 1 :] if base and base != "." and path.startswith(base + "/") else path


def resolve(path: str, markdown: str | None = None, manifest: Manifest | None = None, base: str = "") -> FileConfig:
    """A file's settings. Later wins: manifest, its overrides in order, the hint comment (only the way), front matter."""
    m = manifest or Manifest()
    strategy, metadata = m.strategy or Strategy(), dict(m.metadata)
    for o in m.overrides:
        if re.match(glob_pattern(o.pattern), relative_to(path, base), re.S):
            strategy = o.strategy or strategy
            metadata |= o.metadata
    if not markdown:
        return FileConfig(strategy, metadata)
    if way := hinted_way(markdown):
        strategy = Strategy(way, strategy.max_chunk_size, strategy.min_chunk_size)
    front, _ = front_matter(markdown)
    if _given(front.get("mcp_strategy")):
        strategy = strategy_of(front["mcp_strategy"], "mcp_strategy")
    elif _given(front.get("mcp_chunking_hint")):
        strategy = strategy_of({"chunk_by": front["mcp_chunking_hint"]}, "mcp_chunking_hint")
    for key in ("metadata", "mcp_metadata"):
        if _given(front.get(key)):
            metadata |= metadata_of(front[key], key)
    title = front.get("title")
    return FileConfig(strategy, metadata, title.strip() if isinstance(title, str) and title.strip() else first_title(markdown))


def nearest(path: str, manifests: Mapping[str, Manifest]) -> tuple[str, Manifest] | None:
    """The manifest of the closest directory above a file; directories are '' for the root."""
    parts = path.split("/")[:-1]
    for k in range(len(parts), -1, -1):
        d = "/".join(parts[:k])
        if d in manifests:
            return d, manifests[d]
    return None


#: Manifests up to which they are broadcast to the paths.
BROADCAST_MANIFESTS = 50_000


def nearest_of(paths: DataFrame, known: DataFrame) -> DataFrame:
    """paths (path, ...) with the columns of the manifest (dir, ...) in the closest directory above each; null where there is none.

    An equi-join of every directory above a path with the manifests; of those that match the longest
    counts. As a directory near the root is above very many paths, the manifests are broadcast while
    they are few; beyond that the join is a shuffle, whose large partitions Spark splits.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    steps = paths.select("path").distinct().select("path", F.explode(above).alias("dir"))
    few = known.limit(BROADCAST_MANIFESTS + 1).count() <= BROADCAST_MANIFESTS
    dirs = known.select("dir")
    near = steps.join(F.broadcast(dirs) if few else dirs, "dir").groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("dir"))
    found = near.join(F.broadcast(known) if few else known, "dir")
    return paths.join(found, "path", "left")


RESOLVED = "path string, markdown string, strategy struct<chunk_by:string,max_chunk_size:int,min_chunk_size:int>, metadata map<string,string>, title string, has_manifest boolean"
_STRATEGY = pa.struct([("chunk_by", pa.string()), ("max_chunk_size", pa.int32()), ("min_chunk_size", pa.int32())])


def resolved_batch(files: Iterable[tuple[str, str, Manifest | None, str]]) -> pa.RecordBatch:
    """Files (path, text, manifest, its directory) with their settings, as RESOLVED says."""
    rows = []
    for path, text, known, base in files:
        c = resolve(path, text, known, base)
        rows.append((path, text, vars(c.strategy), list(c.metadata.items()), c.title, known is not None))
    kinds = (pa.string(), pa.string(), _STRATEGY, pa.map_(pa.string(), pa.string()), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["path", "markdown", "strategy", "metadata", "title", "has_manifest"])


def resolved(files: DataFrame) -> DataFrame:
    """Settings of files (path, markdown) beside the text of their manifest and its directory (manifest, dir; null without one)."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed = functools.lru_cache(1000)(parse_manifest)
        for b in batches:
            columns = (b.column(k).to_pylist() for k in range(4))
            yield resolved_batch((p, t, parsed(m) if m is not None else None, d or "") for p, t, m, d in zip(*columns, strict=True))

    return files.select("path", "markdown", "manifest", "dir").mapInArrow(over, RESOLVED)


def merged_taxonomy(manifests: Iterable[Manifest]) -> dict[str, dict]:
    """What any manifest sets to true, for each key."""
    out: dict[str, dict] = {}
    for m in manifests:
        for key, config in m.taxonomy.items():
            shown = {v: {"mcp_resource": True} for v, p in config.get("properties", {}).items() if p.get("mcp_resource")}
            if config.get("vector_collapse") or shown:
                have = out.setdefault(key, {"vector_collapse": False})
                have["vector_collapse"] |= bool(config.get("vector_collapse"))
                if shown:
                    have.setdefault("properties", {}).update(shown)
    return out


# ------------------------------------------------------------------ suggesting a manifest
def suggested_way(markdown: Column) -> Column:
    """The way to chunk that a file's headings suggest."""
    plain = without_fences(markdown)
    n = F.struct(*(F.regexp_count(plain, F.lit(rf"(?m)^\s{{0,3}}#{{{k}}}\s+\S+")).alias(f"h{k}") for k in (1, 2, 3)))

    def pick(c: Column) -> Column:
        return F.when((c["h3"] >= 6) & (c["h3"] >= 2 * c["h2"]), "h3").when(c["h2"] >= 2, "h2").when(c["h1"] >= 2, "h1").when(c["h3"] >= 2, "h3").otherwise("file")

    return F.transform(F.array(n), pick)[0]


def suggestions(files: DataFrame) -> DataFrame:
    """path and way of each file (path, markdown)."""
    return files.select("path", suggested_way(F.col("markdown")).alias("way"))


def majority(suggested: DataFrame) -> DataFrame:
    """The most frequent way as one row, ties in TIE_ORDER; h2 without files."""
    rank = F.array_position(F.array(*(F.lit(x) for x in TIE_ORDER)), F.col("way"))
    all_ways = suggested.sparkSession.createDataFrame([(w,) for w in TIE_ORDER], "way string")
    counts = all_ways.join(suggested.groupBy("way").count(), "way", "left").select("way", F.coalesce("count", F.lit(0)).alias("n"))
    return counts.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("n"), rank))).where("nth = 1").select("way", "n")


def suggest_manifest(files: DataFrame) -> dict:
    """A manifest document: the majority's way, and an override for every file that differs."""
    found = suggestions(files)
    way = majority(found).first()["way"]
    others = found.where(F.col("way") != way).orderBy(F.collate("path", "UNICODE")).collect()  # file names, one for each exception
    out: dict = {"version": VERSION, "strategy": {"chunk_by": way}}
    if others:
        out["overrides"] = [{"pattern": r["path"], "strategy": {"chunk_by": r["way"]}} for r in others]
    return out


__all__ = ["FileConfig", "Manifest", "ManifestError", "Override", "glob_pattern", "hinted_way", "majority", "manifest_of", "merged_taxonomy", "nearest", "parse_manifest", "resolve", "suggest_manifest", "suggested_way", "suggestions"]
