"""An index of immutable segments: a change writes what changed, and nothing else is rewritten.

A segment has the tables of `index` (chunks, heads, postings, terms) of the files that were new
or changed when it was made, and a sequence number. A file's latest version counts: an update
that brings or removes files leaves marks, their paths with the update's number, and a row of a
segment is dead if its file is marked with a greater number. So that statistics stay those of the
live rows without reading segments again, an update also writes what its marks take from each
segment: document frequencies and lengths of the dead chunks, made from these chunks alone.
Frequencies and lengths of the index are sums over segments less these.

Segments of one tier, that is of about one size, are merged once there are FACTOR of them, and a
segment alone once half of it is dead; merging takes live rows over as they are, postings too.
A segment is thus rewritten about log(size) times in its life, and a search reads few segments.

Which segments and marks count is in a manifest of its own for each version, written whole under
its number; a number can be taken once, so of two writers one fails and changes nothing. Readers
keep the version they opened; `clean` removes what the latest versions don't name, also what a
failed update left. Updates from a stream carry its name and batch: one that the manifest has is
not applied again.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import tokenized
from scriptorium.session import written
from scriptorium.sources.storage import Store

from . import incremental, index
from .chunking import chunk_files

#: Segments of a tier before they are merged, live chunks of the smallest tier, and versions that `clean` keeps.
FACTOR, SMALLEST, KEPT = 4, 1000, 3
#: Chunks for each partition of a segment's tables.
PART_CHUNKS = 5_000
#: Marked files up to which they are broadcast, and up to which they are part of the plan, where they prune the files that are read.
BROADCAST_MARKS, LITERAL_MARKS = 1_000_000, 1000
TERMS_SCHEMA, LENGTHS_SCHEMA = "segment string, term string, field string, df long", "segment string, field string, n long, total long"


class Conflict(RuntimeError):
    """Another writer published a version meanwhile."""


@dataclass(frozen=True)
class Segment:
    id: str
    seq: int
    chunks: int
    dead: int = 0

    @property
    def live(self) -> int:
        return self.chunks - self.dead


@dataclass(frozen=True)
class Mark:
    id: str
    seq: int
    files: int


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    segments: tuple[Segment, ...] = ()
    marks: tuple[Mark, ...] = ()
    applied: dict[str, int] = field(default_factory=dict)  # last batch of each stream

    @property
    def last(self) -> int:
        return max((x.seq for x in (*self.segments, *self.marks)), default=0)

    def text(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @classmethod
    def of(cls, text: str) -> Manifest:
        m = json.loads(text)
        return cls(m["version"], tuple(Segment(**s) for s in m["segments"]), tuple(Mark(**x) for x in m["marks"]), m["applied"])


def latest(spark: SparkSession, base: str, version: int | None = None) -> Manifest:
    """The manifest of a version, the last one without it; an empty one if there is none."""
    store = Store(spark, base)
    names = [n for n in store.names("manifests") if n.endswith(".json")]
    if version is not None:
        names = [n for n in names if n == f"{version:012}.json"]
        if not names:
            raise ValueError(f"There is no version {version}")
    return Manifest.of(store.read(f"manifests/{names[-1]}")) if names else Manifest()


def publish(spark: SparkSession, base: str, m: Manifest) -> Manifest:
    """Write the version after m; Conflict if there is one."""
    new = replace(m, version=m.version + 1)
    if not Store(spark, base).create(f"manifests/{new.version:012}.json", new.text()):
        raise Conflict(f"Version {new.version} of {base} was published by another writer")
    return new


# ------------------------------------------------------------------ reading
class SegmentedIndex:
    """One version of the index, with the tables of a published index for search and retrieval."""

    def __init__(self, spark: SparkSession, base: str, manifest: Manifest | None = None) -> None:
        self.spark, self.base, self.manifest = spark, base.rstrip("/"), manifest or latest(spark, base)

    @property
    def path(self) -> str:
        return self.base

    @property
    def version(self) -> str:
        return str(self.manifest.version)

    def at(self, version: str) -> SegmentedIndex:
        """Another version of the same index, as long as it is kept."""
        if version == self.version:
            return self
        try:
            return SegmentedIndex(self.spark, self.base, latest(self.spark, self.base, int(version)))
        except ValueError as e:
            raise LookupError(f"There is no version {version} any more") from e

    def near(self) -> None:
        """Segments have no index of vectors; they are compared exactly."""
        return None

    def _marks(self, s: Segment) -> DataFrame | None:
        """Paths that are dead in a segment, and None if none is."""
        mine = [m for m in self.manifest.marks if m.seq > s.seq] if s.dead else []
        if not mine:
            return None
        paths = self.spark.read.schema("filepath string").parquet(*[f"{self.base}/marks/{m.id}/files" for m in mine]).distinct()
        return F.broadcast(paths) if sum(m.files for m in mine) <= BROADCAST_MARKS else paths

    def chunks_of(self, paths: Sequence[str]) -> DataFrame:
        """The live chunks of some files, of each segment from their folders alone."""
        return self._union((self.live(s, "chunks", paths) for s in self.manifest.segments), EMPTY_CHUNKS)

    def live(self, s: Segment, name: str, paths: Sequence[str] | None = None) -> DataFrame:
        """The live rows of chunks (of some files), heads or postings of a segment."""
        rows = self.spark.read.parquet(f"{self.base}/segments/{s.id}/{name}")
        if name == "chunks":
            rows = index.of_files(rows, paths) if paths is not None else rows.drop("folders", "folder")
        dead = self._marks(s)
        if dead is None:
            return rows
        if name == "postings":
            return rows.withColumn("filepath", F.substring_index("chunk_id", "#", 1)).join(dead, "filepath", "left_anti").drop("filepath")
        return rows.join(dead, "filepath", "left_anti").select(*rows.columns)

    def _union(self, tables: Iterable[DataFrame], schema: str) -> DataFrame:
        tables = list(tables)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables) if tables else self.spark.createDataFrame([], schema)

    def _taken(self, name: str, schema: str) -> DataFrame:
        """What marks take from the segments of this version."""
        paths = [f"{self.base}/marks/{m.id}/{name}" for m in self.manifest.marks]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.where(F.col("segment").isin([s.id for s in self.manifest.segments]))

    def table(self, name: str) -> DataFrame:
        ids = [s.id for s in self.manifest.segments]
        if name in ("chunks", "heads", "postings"):
            empty = {"chunks": EMPTY_CHUNKS, "heads": EMPTY_HEADS, "postings": EMPTY_POSTINGS}[name]
            return self._union((self.live(s, name) for s in self.manifest.segments), empty)
        if name == "terms":
            there = self._union((self.spark.read.parquet(f"{self.base}/segments/{i}/terms") for i in ids), "term string, field string, df long")
            rows = there.unionByName(self._taken("terms", TERMS_SCHEMA).select("term", "field", (-F.col("df")).alias("df")))
            return rows.groupBy("term", "field").agg(F.sum("df").alias("df")).where("df > 0")
        if name == "fields":
            there = self._union((self.spark.read.parquet(f"{self.base}/segments/{i}/lengths") for i in ids), "field string, n long, total long")
            rows = there.unionByName(self._taken("lengths", LENGTHS_SCHEMA).select("field", (-F.col("n")).alias("n"), (-F.col("total")).alias("total")))
            return rows.groupBy("field").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0").select("field", "n", (F.col("total") / F.col("n")).alias("avgdl"))
        raise ValueError(f"There is no table '{name}'")

    def files(self) -> DataFrame:
        """filepath and file_fingerprint of the live files."""
        return self.table("heads").select("filepath", "file_fingerprint").distinct()


EMPTY_HEADS = "chunk_id string, filepath string, heading string, heading_level int, breadcrumb string, chunk_index int, metadata map<string,string>, file_fingerprint string"
EMPTY_CHUNKS = EMPTY_HEADS + ", content string, content_text string"
EMPTY_POSTINGS = "term string, field string, chunk_id string, dl int, tf int, positions array<int>"


def lengths(chunks: DataFrame, *by: str) -> DataFrame:
    """field, chunks and sum of their lengths, for each value of `by`."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.size(tokenized(F.lower(f))).alias("dl")) for f in index.FIELDS))
    rows = chunks.select(*by, F.explode(fields).alias("f"))
    return rows.groupBy(*by, "f.field").agg(F.count("*").alias("n"), F.sum("f.dl").alias("total"))


# ------------------------------------------------------------------ writing
def update(spark: SparkSession, base: str, chunks: DataFrame | None, touched: DataFrame, stream: str | None = None, batch: int | None = None) -> Manifest:
    """Publish a version in which the touched files (filepath) have these chunks and no others.

    Chunks of files that aren't touched raise an error. With a stream's name and batch number the
    update is applied once, however often it is asked for.
    """
    store, base = Store(spark, base), base.rstrip("/")
    m = latest(spark, base)
    if stream is not None and m.applied.get(stream, -1) >= batch:
        return m
    applied = {**m.applied, stream: batch} if stream is not None else m.applied
    seq = m.last + 1
    made = uuid.uuid4().hex
    mark, segment = f"{base}/marks/{seq:012}-{made}", f"{base}/segments/{seq:012}-{made}"
    touched.select("filepath").distinct().coalesce(1).write.parquet(f"{mark}/files")
    paths = spark.read.parquet(f"{mark}/files")
    n_files = paths.count()
    if not n_files:
        store.delete(f"marks/{seq:012}-{made}")
        return publish(spark, base, replace(m, applied=applied)) if stream is not None else m
    few = [r["filepath"] for r in paths.collect()] if n_files <= LITERAL_MARKS else None
    near = F.broadcast(paths) if n_files <= BROADCAST_MARKS else paths
    segments = list(m.segments)
    # What dies: the live chunks of the touched files, read by path.
    view = SegmentedIndex(spark, base, m)
    dying = [view.live(s, "chunks", few).join(near, "filepath", "left_semi").select(F.lit(s.id).alias("segment"), "chunk_id", *index.FIELDS) for s in segments]
    dead: dict[str, int] = {}
    if dying:
        rows = written(reduce(DataFrame.unionByName, dying), "dying")
        dead = {r["segment"]: r["n"] for r in rows.groupBy("segment").agg(F.count("*").alias("n")).collect()}  # a row for each segment
    if dead:
        of = rows.select(F.concat_ws("\0", "segment", "chunk_id").alias("chunk_id"), *index.FIELDS)  # postings() keeps ids, so the segment goes with them
        lost = index.postings(of).groupBy(F.substring_index("chunk_id", "\0", 1).alias("segment"), "term", "field").agg(F.count("*").alias("df"))
        lost.coalesce(_parts(sum(dead.values()))).write.parquet(f"{mark}/terms")
        lengths(rows, "segment").coalesce(1).write.parquet(f"{mark}/lengths")
        segments = [replace(s, dead=s.dead + dead.get(s.id, 0)) for s in segments]
    marks = [*m.marks, Mark(f"{seq:012}-{made}", seq, n_files)] if dead else list(m.marks)
    if not dead:
        store.delete(f"marks/{seq:012}-{made}/files")
    if chunks is not None:
        new = _write(chunks, segment, None)
        if new:
            stray = spark.read.parquet(f"{segment}/heads").select("filepath").distinct().join(written(touched.select("filepath").distinct(), "touched"), "filepath", "left_anti").limit(1).collect()
            if stray:
                raise ValueError(f"The chunks of {stray[0]['filepath']} come with an update that doesn't touch it")
            segments.append(Segment(f"{seq:012}-{made}", seq, new))
        else:
            store.delete(f"segments/{seq:012}-{made}")
    return publish(spark, base, _trimmed(replace(m, segments=tuple(segments), marks=tuple(marks), applied=applied)))


def _parts(chunks: int) -> int:
    return 1 + chunks // PART_CHUNKS


def _write(chunks: DataFrame, path: str, made: DataFrame | None, at_most: int | None = None) -> int:
    """Write a segment's tables; how many chunks it has."""
    spark = chunks.sparkSession
    rows = chunks if at_most is not None else written(chunks, "segment")
    n = at_most if at_most is not None else rows.count()
    if not n:
        return 0
    stored = index.write_tables(rows, path, min(_parts(n), int(spark.conf.get("spark.sql.shuffle.partitions"))), made)
    lengths(stored).coalesce(1).write.parquet(f"{path}/lengths")
    return n


def _trimmed(m: Manifest) -> Manifest:
    """Without segments that are dead whole, and marks that no segment needs any more."""
    segments = tuple(s for s in m.segments if s.live > 0)
    marks = tuple(x for x in m.marks if any(s.dead and s.seq < x.seq for s in segments))
    return replace(m, segments=segments, marks=marks)


def due(m: Manifest, factor: int = FACTOR) -> list[Segment]:
    """The segments to merge next: the smallest tier that has `factor` of them, else one that is half dead."""
    tiers: dict[int, list[Segment]] = {}
    for s in m.segments:
        tiers.setdefault(max(0, math.floor(math.log(max(s.live, 1) / SMALLEST, factor))), []).append(s)
    for t in sorted(tiers):
        if len(tiers[t]) >= factor:
            return tiers[t]
    return [s for s in m.segments if 2 * s.dead >= s.chunks][:1]


def merge(spark: SparkSession, base: str, choose: Callable[[Manifest], list[Segment]] = due) -> Manifest:
    """Merge segments as long as some are due; the last manifest."""
    base = base.rstrip("/")
    m = latest(spark, base)
    while some := choose(m):
        view = SegmentedIndex(spark, base, m)
        of = lambda name: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [view.live(s, name) for s in some])
        seq, made = max(s.seq for s in some), uuid.uuid4().hex
        n = sum(s.live for s in some)
        rest = tuple(s for s in m.segments if s not in some)
        if n:
            # Live rows of all these have no mark above their own number that is not already taken off.
            _write(of("chunks"), f"{base}/segments/{seq:012}-{made}", of("postings"), n)
            rest = (*rest, Segment(f"{seq:012}-{made}", seq, n))
        m = publish(spark, base, _trimmed(replace(m, segments=rest)))
    return m


def clean(spark: SparkSession, base: str, kept: int = KEPT) -> list[str]:
    """Remove what none of the last `kept` versions names; the folders removed. Not while an update runs."""
    store = Store(spark, base)
    names = [n for n in store.names("manifests") if n.endswith(".json")]
    known = [Manifest.of(store.read(f"manifests/{n}")) for n in names[-kept:]]
    wanted = {f"segments/{s.id}" for m in known for s in m.segments} | {f"marks/{x.id}" for m in known for x in m.marks}
    gone = [f"{folder}/{n}" for folder in ("segments", "marks") for n in store.names(folder) if f"{folder}/{n}" not in wanted]
    gone += [f"manifests/{n}" for n in store.names("manifests") if n not in names[-kept:]]
    for name in gone:
        store.delete(name)
    return gone


@dataclass(frozen=True)
class Synced:
    index: SegmentedIndex
    changed: int
    removed: int


def sync(spark: SparkSession, base: str, files: DataFrame, complete: bool = True, removed: DataFrame | None = None, stream: str | None = None, batch: int | None = None) -> Synced:
    """Bring the index to these files (path, markdown, strategy, metadata): only what has another fingerprint is chunked and written.

    complete: files that aren't given are removed; otherwise they stay, but for those `removed` (path).
    """
    marked = incremental.with_fingerprints(files)
    known = SegmentedIndex(spark, base).files()
    new = written(marked.join(known.withColumnRenamed("filepath", "path"), ["path", "file_fingerprint"], "left_anti"), "changed")
    gone = known.select("filepath").join(files.select(F.col("path").alias("filepath")), "filepath", "left_anti") if complete else known.select("filepath").where(F.lit(False))
    if removed is not None:
        gone = gone.unionByName(known.select("filepath").join(removed.select(F.col("path").alias("filepath")), "filepath", "left_semi")).distinct()
    gone = written(gone, "gone")
    marks = new.select(F.col("path").alias("filepath"), "file_fingerprint")
    chunks = chunk_files(new.drop("file_fingerprint")).join(marks, "filepath")
    touched = marks.select("filepath").unionByName(gone)
    update(spark, base, chunks, touched, stream, batch)
    m = merge(spark, base.rstrip("/"))
    return Synced(SegmentedIndex(spark, base, m), new.count(), gone.count())


__all__ = ["Conflict", "Manifest", "Segment", "SegmentedIndex", "Synced", "clean", "due", "latest", "merge", "publish", "sync", "update"]
