"""Markdown files to chunks: by heading, with size rules.

One pass over a file's blocks, on the executors; see chunk_files().
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame

from scriptorium.functions.text import slugify

from .markdown import Block, blocks

#: Heading depth of each way to chunk, and the size beyond which a chunk is split anyway.
LEVELS = {"h1": 1, "h2": 2, "h3": 3}
WAYS = (*LEVELS, "file")
MOST_CHARS = 20_000


@dataclass(frozen=True)
class Strategy:
    chunk_by: str = "h2"
    max_chunk_size: int | None = None
    min_chunk_size: int | None = None

    def __post_init__(self) -> None:
        if self.chunk_by not in WAYS:
            raise ValueError(f"chunk_by must be one of {', '.join(WAYS)}")


@dataclass(frozen=True)
class Section:
    """A run of blocks under a heading (kind heading), before the first one (preamble), or a whole file."""

    kind: str
    nodes: tuple[Block, ...]
    slug: str = ""
    heading: str = ""
    level: int = 0
    above: tuple[tuple[str, str], ...] = ()  # (heading, slug) from the top
    part: int = 1

    def source(self, text: str) -> str:
        return text[self.nodes[0].start : self.nodes[-1].end] if self.nodes else ""

    def size(self, text: str) -> int:
        return len(self.source(text))


class _Slugs:
    """Slugs that are told apart by a number under one parent."""

    def __init__(self) -> None:
        self.seen: dict[tuple[str, ...], int] = {}

    def next(self, parents: Sequence[str], heading: str) -> str:
        slug = slugify(heading)
        n = self.seen[(*parents, "", slug)] = self.seen.get((*parents, "", slug), 0) + 1
        return slug if n == 1 else f"{slug}-{n}"


def sections(nodes: Sequence[Block], level: int) -> list[Section]:
    """Split at the headings of one depth; the others only give ancestors."""
    slugs, path = _Slugs(), {}
    out = [Section("preamble", (), "_preamble")]
    for b in nodes:
        if b.kind == "heading":
            path = {d: x for d, x in path.items() if d < b.depth}
            name = b.text.strip() or "section"
            above = tuple(path[d] for d in sorted(path))
            slug = slugs.next([s for _, s in above], name)
            path[b.depth] = (name, slug)
            if b.depth == level:
                out.append(Section("heading", (b,), slug, name, level, above))
                continue
        out[-1] = replace(out[-1], nodes=(*out[-1].nodes, b))
    return out if len(out) == 1 or out[0].nodes else out[1:]


def refine(s: Section, text: str, most: int) -> list[Section]:
    """Sections of at most `most` characters: by ever deeper headings, then between blocks; a block stays whole."""
    if s.size(text) <= most:
        return [s]
    level = s.level + 1
    while level <= 6 and not any(b.kind == "heading" and b.depth == level for b in s.nodes):
        level += 1
    if level > 6:
        return packed(replace(s, level=6), text, most)
    slugs, out = _Slugs(), []
    # What stands before the first deeper heading keeps the section's own, at the depth that was searched last.
    current = replace(s, nodes=(), level=level - 1, part=1)
    above = (*s.above, (s.heading, s.slug)) if s.heading or s.slug else s.above
    for b in s.nodes:
        if b.kind == "heading" and b.depth == level:
            out.append(current)
            name = b.text.strip() or "section"
            current = Section("heading", (b,), slugs.next((), name), name, level, above)
        else:
            current = replace(current, nodes=(*current.nodes, b))
    out.append(current)
    return [r for x in out if x.source(text).strip() for r in refine(x, text, most)]


def packed(s: Section, text: str, most: int) -> list[Section]:
    """Parts of a section, each as many blocks as fit."""
    groups: list[list[Block]] = []
    room = 0
    for b in s.nodes:
        size = b.end - b.start
        if not groups or size > room:
            groups.append([])
            room = most
        groups[-1].append(b)
        room -= size
    return [replace(s, nodes=tuple(g), part=k) for k, g in enumerate(groups, 1)]


def joined(parts: Sequence[Section], text: str, least: int) -> list[Section]:
    """Parts of one section that are too small go to the part before them."""
    out: list[Section] = []
    for s in parts:
        same = out and (out[-1].kind, out[-1].slug, out[-1].heading, out[-1].level, [x for _, x in out[-1].above]) == (s.kind, s.slug, s.heading, s.level, [x for _, x in s.above])
        if same and s.size(text) < least:
            out[-1] = replace(out[-1], nodes=out[-1].nodes + s.nodes)
        else:
            out.append(s)
    return out


def chunk_id(path: str, s: Section) -> str:
    part = f"-part-{s.part}" if s.part > 1 else ""
    if s.kind == "file":
        return f"{path}#_part-{s.part}" if part else path
    if s.kind == "preamble":
        return f"{path}#_preamble{part}"
    return f"{path}#{'/'.join([*(x for _, x in s.above), s.slug + part])}"


def chunk(path: str, text: str, strategy: Strategy = Strategy(), metadata: Mapping[str, str] | None = None) -> list[dict]:
    """The chunks of one file, as rows of CHUNK_SCHEMA."""
    if not path.strip():
        raise ValueError("filepath is required")
    nodes = [b for b in blocks(text) if b.kind != "yaml"]
    found = [Section("file", tuple(nodes))] if strategy.chunk_by == "file" else sections(nodes, LEVELS[strategy.chunk_by])
    found = [r for s in found for r in refine(s, text, strategy.max_chunk_size or MOST_CHARS)]
    if strategy.min_chunk_size and len(found) > 1:
        found = joined(found, text, strategy.min_chunk_size)
    return [
        {
            "chunk_id": chunk_id(path, s),
            "filepath": path,
            "heading": s.heading,
            "heading_level": s.level,
            "content": s.source(text),
            "content_text": "\n\n".join(b.text for b in s.nodes),
            "breadcrumb": " > ".join([path, *(x for x, _ in (*s.above, (s.heading, "")) if x)]),
            "chunk_index": k,
            "metadata": dict(metadata or {}),
        }
        for k, s in enumerate(found)
    ]


ARROW = pa.schema([("chunk_id", pa.string()), ("filepath", pa.string()), ("heading", pa.string()), ("heading_level", pa.int32()), ("content", pa.string()), ("content_text", pa.string()), ("breadcrumb", pa.string()), ("chunk_index", pa.int32()), ("metadata", pa.map_(pa.string(), pa.string()))])
SQL_SCHEMA = "chunk_id string, filepath string, heading string, heading_level int, content string, content_text string, breadcrumb string, chunk_index int, metadata map<string,string>"


def rows_to_batch(rows: Sequence[dict]) -> pa.RecordBatch:
    columns = [pa.array([list(r[f.name].items()) if f.name == "metadata" else r[f.name] for r in rows], f.type) for f in ARROW]
    return pa.RecordBatch.from_arrays(columns, schema=ARROW)


def chunk_files(files: DataFrame, strategy: Strategy = Strategy()) -> DataFrame:
    """Chunks of files (path, markdown and, if given, strategy and metadata columns); no shuffle."""
    own = [c for c in ("strategy", "metadata") if c in files.columns]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[dict] = []
            for i in range(b.num_rows):
                r = {n: b.column(k)[i].as_py() for k, n in enumerate(b.schema.names)}
                how = Strategy(**r["strategy"]) if r.get("strategy") else strategy
                rows += chunk(r["path"], r["markdown"] or "", how, dict(r.get("metadata") or {}))
                if len(rows) >= 2000:
                    yield rows_to_batch(rows)
                    rows = []
            yield rows_to_batch(rows)

    return files.select("path", "markdown", *own).mapInArrow(over, SQL_SCHEMA)
