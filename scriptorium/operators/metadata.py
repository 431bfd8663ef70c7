"""Corpus metadata: taxonomy, statistics, the metadata document and the tools' schemas."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Limits of a taxonomy, and the version of the metadata document.
MOST_KEYS, MOST_KEY_CHARS, MOST_VALUES, MOST_VALUE_CHARS = 64, 64, 512, 128
DOCUMENT_VERSION, MAJOR = "1.0.0", 1
_SEMVER = re.compile(r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?$")


class MetadataError(ValueError):
    pass


def taxonomy(chunks: DataFrame, most: int = MOST_VALUES) -> DataFrame:
    """key and its distinct non-empty values in the collated order; one more than `most` of them at most, which is too many."""
    pairs = chunks.select(F.explode("metadata").alias("key", "value")).where(F.col("value") != "").distinct()
    first = Window.partitionBy("key").orderBy(F.collate("value", "UNICODE"), "value")
    few = pairs.withColumn("at", F.row_number().over(first)).where(F.col("at") <= most + 1)
    return few.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("values"))


def extracted(stored: Column, flat: Mapping[str, Column]) -> Column:
    """Non-empty metadata of a JSON object, or of flat columns where the JSON can't be read."""
    read = F.from_json(stored, "map<string,string>")
    fallback = F.create_map(*(x for k, c in flat.items() for x in (F.lit(k), c.cast("string")))) if flat else F.create_map().cast("map<string,string>")
    return F.map_filter(F.coalesce(read, fallback), lambda k, v: v.isNotNull() & (v != ""))


def metadata_keys(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.explode(F.map_keys("metadata")).alias("key")).distinct()


def corpus_statistics(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("total_chunks"), F.count_distinct("filepath").alias("total_files"))


def configured(values: DataFrame, config: DataFrame) -> DataFrame:
    """Taxonomy rows with what the manifests say of the key (key, vector_collapse, properties)."""
    return values.join(config, "key", "left").withColumn("vector_collapse", F.coalesce("vector_collapse", F.lit(False)))


def unused_keys(config: DataFrame, values: DataFrame) -> DataFrame:
    """Configured keys that no chunk has."""
    return config.join(values, "key", "left_anti").select("key")


def collapse_keys(taxonomy: Mapping[str, Mapping]) -> list[str]:
    return [k for k, v in taxonomy.items() if v.get("vector_collapse")]


def build_document(chunks: DataFrame, description: str, config: Mapping[str, Mapping] | None = None, files: Mapping[str, Mapping] | None = None, prompts: Sequence[Mapping] = (), embedding: Mapping | None = None, commit: str | None = None, instructions: str | None = None) -> dict:
    """The metadata document of a corpus; the taxonomy, bounded by its limits, comes to the driver."""
    config = config or {}
    found = {r["key"]: list(r["values"]) for r in taxonomy(chunks).orderBy(F.collate("key", "UNICODE")).limit(MOST_KEYS + 1).collect()}
    n = corpus_statistics(chunks).first()
    stats = {"total_chunks": n["total_chunks"], "total_files": n["total_files"], "indexed_at": datetime.now(UTC).isoformat().replace("+00:00", "Z")}
    out = {"metadata_version": DOCUMENT_VERSION, "corpus_description": description, "taxonomy": {k: {"description": f"Filter results by {k}.", "values": v, **config.get(k, {})} for k, v in found.items()}, "stats": stats | ({"source_commit": commit} if commit else {}), "embedding": dict(embedding) if embedding else None, "files": dict(files or {})}
    if prompts:
        out["prompts"] = list(prompts)
    if instructions:
        out["mcpServerInstructions"] = instructions
    return normalized_document(out)


def collation_key(text: str) -> tuple[str, str, str]:
    """Order of a text among others as people sort: letters first, then accents, then small before capital."""
    split = unicodedata.normalize("NFD", text)
    return "".join(c for c in split if not unicodedata.combining(c)).casefold(), split.casefold(), text.swapcase()


def _said(value: object, name: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise MetadataError(f"{name} must be a non-empty string")
    return value.strip()


def _count(value: object, name: str, least: int = 0) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or value < least:
        raise MetadataError(f"{name} must be an integer of at least {least}")
    return value


def normalized_taxonomy(value: object) -> dict[str, dict]:
    if not isinstance(value, Mapping):
        raise MetadataError("taxonomy must be an object")
    if len(value) > MOST_KEYS:
        raise MetadataError(f"taxonomy has more than {MOST_KEYS} keys")
    out = {}
    for key, config in value.items():
        if not key or len(key) > MOST_KEY_CHARS or not isinstance(config, Mapping) or not isinstance(config.get("values"), (list, tuple)):
            raise MetadataError(f"taxonomy.{key} is invalid")
        values = sorted({_said(v, f"taxonomy.{key}.values") for v in config["values"]}, key=collation_key)
        if len(values) > MOST_VALUES or any(len(v) > MOST_VALUE_CHARS for v in values):
            raise MetadataError(f"taxonomy.{key} has too many or too long values")
        made: dict = {"values": values}
        if config.get("description") is not None:
            made["description"] = _said(config["description"], f"taxonomy.{key}.description")
        if config.get("vector_collapse"):
            made["vector_collapse"] = True
        if config.get("properties"):
            made["properties"] = {v: {"mcp_resource": bool(p.get("mcp_resource"))} for v, p in config["properties"].items()}
        out[key] = made
    return out


def normalized_document(value: object, major: int = MAJOR) -> dict:
    """A checked metadata document."""
    if not isinstance(value, Mapping):
        raise MetadataError("metadata must be an object")
    version = _said(value.get("metadata_version"), "metadata_version")
    m = _SEMVER.match(version)
    if not m:
        raise MetadataError("metadata_version must be valid semver")
    if int(m.group(1)) != major:
        raise MetadataError(f"Unsupported metadata_version major: expected {major}.x.x, got {version}")
    stats = value.get("stats")
    if not isinstance(stats, Mapping):
        raise MetadataError("stats must be an object")
    counted = {k: _count(stats.get(k), f"stats.{k}") for k in ("total_chunks", "total_files")}
    counted |= {"indexed_at": _said(stats.get("indexed_at"), "stats.indexed_at")}
    if stats.get("source_commit") is not None:
        counted["source_commit"] = _said(stats["source_commit"], "stats.source_commit")
    embedding = value.get("embedding")
    if embedding is not None:
        if not isinstance(embedding, Mapping):
            raise MetadataError("embedding must be an object or null")
        embedding = {"provider": _said(embedding.get("provider"), "embedding.provider"), "model": _said(embedding.get("model"), "embedding.model"), "dimensions": _count(embedding.get("dimensions"), "embedding.dimensions", 1)}
    files = value.get("files") or {}
    if not isinstance(files, Mapping) or not all(isinstance(f, Mapping) for f in files.values()):
        raise MetadataError("files must be an object of objects")
    names = [_said(p.get("name") if isinstance(p, Mapping) else None, "prompts[].name") for p in value.get("prompts") or []]
    if len(set(names)) < len(names):
        raise MetadataError("Duplicate prompt name")
    out = {"metadata_version": version, "corpus_description": _said(value.get("corpus_description"), "corpus_description"), "taxonomy": normalized_taxonomy(value.get("taxonomy")), "stats": counted, "embedding": embedding, "files": {k: dict(f) for k, f in files.items()}}
    if names:
        out["prompts"] = [dict(p) for p in value["prompts"]]
    if value.get("mcpServerInstructions") is not None:
        out["mcpServerInstructions"] = _said(value["mcpServerInstructions"], "mcpServerInstructions")
    return out


# ------------------------------------------------------------------ tools
def search_schema(taxonomy: Mapping[str, Mapping]) -> dict:
    """JSON schema of the search tool, each facet with its values."""
    props: dict = {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 50}, "cursor": {"type": "string"}}
    if taxonomy:
        props["filters"] = {"type": "object", "additionalProperties": False, "properties": {k: {"type": "string", "enum": list(v["values"])} for k, v in taxonomy.items()}}
    return {"type": "object", "properties": props, "required": ["query"], "additionalProperties": False}


def get_schema() -> dict:
    return {"type": "object", "properties": {"chunk_id": {"type": "string", "minLength": 1}, "context": {"type": "integer", "minimum": 0, "maximum": 5}}, "required": ["chunk_id"], "additionalProperties": False}


def check_arguments(given: object, schema: Mapping) -> dict:
    """Arguments that fit a tool's schema, strings trimmed."""
    if not isinstance(given, Mapping):
        raise ValueError("arguments must be an object")
    props = schema["properties"]
    if extra := sorted(set(given) - set(props)):
        raise ValueError(f"Unknown fields: {', '.join(extra)}")
    out = {}
    for name, how in props.items():
        v = given.get(name)
        if v is None:
            if name in schema["required"]:
                raise ValueError(f"{name} is required")
            continue
        if how["type"] == "string":
            v = _said(v, name)
        elif how["type"] == "integer":
            if not isinstance(v, int) or isinstance(v, bool) or not how["minimum"] <= v <= how["maximum"]:
                raise ValueError(f"{name} must be an integer from {how['minimum']} to {how['maximum']}")
        else:
            if not isinstance(v, Mapping):
                raise ValueError(f"{name} must be an object")
            for k, x in v.items():
                allowed = how["properties"].get(k, {}).get("enum")
                if allowed is None:
                    raise ValueError(f"Unknown filter '{k}'")
                if x not in allowed:
                    raise ValueError(f"Invalid value '{x}' for filter '{k}'. Allowed: {', '.join(allowed)}")
        out[name] = v
    return out


class Tools:
    """Tool registry: the two built-in ones and custom ones; errors become results."""

    def __init__(self, engine, document: Mapping, prefix: str = ""):
        self.engine, self.document, self.prefix = engine, document, prefix
        name = lambda n: f"{prefix}_{n}" if prefix else n
        self.schemas = {name("search_docs"): search_schema(document["taxonomy"]), name("get_doc"): get_schema()}
        self.handlers = {name("search_docs"): self._search, name("get_doc"): self._get}

    def add(self, name: str, schema: Mapping, handler) -> None:
        if not re.fullmatch(r"[A-Za-z0-9_-]{1,64}", name):
            raise ValueError(f"Invalid tool name '{name}'")
        if name in self.handlers:
            raise ValueError(f"Tool '{name}' is there already")
        self.schemas[name], self.handlers[name] = schema, handler

    def list(self) -> list[dict]:
        return [{"name": n, "inputSchema": s} for n, s in self.schemas.items()]

    def call(self, name: str, arguments: object) -> dict:
        try:
            if name not in self.handlers:
                raise ValueError(f"Unknown tool '{name}'")
            return {"content": self.handlers[name](arguments), "is_error": False}
        except Exception as e:
            return {"content": str(e), "is_error": True}

    def _search(self, arguments: object):
        from .search import Request

        a = check_arguments(arguments, search_schema(self.document["taxonomy"]))
        return vars(self.engine.search(Request(a["query"], a.get("filters", {}), a.get("limit"), a.get("cursor"), list(self.document["taxonomy"]))))

    def _get(self, arguments: object):
        from .documents import get_doc, get_doc_of

        a = check_arguments(arguments, get_schema())
        if hasattr(self.engine, "index"):
            return get_doc_of(self.engine.index, a["chunk_id"], a.get("context", 0))
        return get_doc(self.engine.chunks, a["chunk_id"], a.get("context", 0))
