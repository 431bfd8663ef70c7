"""The index: chunks, postings, term statistics and field statistics as Parquet tables.

Postings are clustered by term and sorted within files, so that a query's terms read
a few row groups. Chunks are in folders by a hash of their file's path, sorted by path
and place: the chunks of a path, or the one of an id, which begins with its path, are in
one file that the path names without looking into any other. Files are dealt into blocks
of about BLOCK_CHUNKS chunks, and `impacts` has for each term, field and block the
greatest part of a score that a chunk there can have, so that a search for the best few
leaves out blocks that can't have one of them.
A version directory is written whole and becomes current by replacing a pointer file.
For batches of queries, which read the chunks, an index can be written without postings and
`impacts`: what else reads these makes them from the chunks.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import tokenize, tokenized
from scriptorium.session import lean

from . import quantised

FIELDS = {"heading": 3.0, "content_text": 1.0}
POINTER = "CURRENT"
#: BM25's usual parameters.
K1, B = 1.2, 0.75
#: Chunks of a block, on average.
BLOCK_CHUNKS = 128
#: Chunks for each partition of the postings at most.
SORTED_CHUNKS = 10_000


def saturation(tf: Column, dl: Column, avgdl: Column) -> Column:
    """BM25's score of a term in a chunk, but for the term's weight."""
    return (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / avgdl))


def of_files(rows: DataFrame, paths: Sequence[str]) -> DataFrame:
    """The chunks of some files of a table in folders; other folders aren't read."""
    hashes = F.array(*(F.xxhash64(F.lit(p)) for p in paths))
    here = F.exists(hashes, lambda h: F.pmod(h, F.col("folders")) == F.col("folder"))
    return rows.where(here & F.col("filepath").isin(list(paths))).drop("folders", "folder")


def path_of(chunk_id: str) -> str:
    """The path that a chunk id begins with."""
    return chunk_id.split("#", 1)[0]


POSTINGS = "term string, field string, chunk_id string, dl int, tf int, positions array<int>"
#: Terms that are grouped at once.
GROUPED_TERMS = 1_000_000


def _grouped(ids: Sequence[str], field: str, texts: Sequence[list[str]]) -> pa.RecordBatch:
    """Postings of the terms of some chunks: sorted by chunk and term, a run of equal ones is a posting."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    terms = pa.array([t for some in texts for t in some], pa.string()).dictionary_encode()
    known = max(1, len(terms.dictionary))
    pair = np.repeat(np.arange(len(texts)), lengths) * known + terms.indices.to_numpy()
    places = np.arange(len(pair)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    begins = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.array([], np.int64)
    ends = np.r_[begins[1:], len(pair)] if len(pair) else begins
    chunk, term = np.divmod(pair[begins], known)
    offsets = pa.array(np.r_[begins, len(pair)] if len(pair) else [0], pa.int32())
    columns = [terms.dictionary.take(pa.array(term)), pa.array([field] * len(begins), pa.string()), pa.array(ids, pa.string()).take(pa.array(chunk)), pa.array(lengths[chunk], pa.int32()), pa.array(ends - begins, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(places[order], pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, names=["term", "field", "chunk_id", "dl", "tf", "positions"])


def postings(chunks: DataFrame) -> DataFrame:
    """term, field, chunk_id, dl, tf and positions of every term of every chunk; a task groups the terms of a few chunks at a time, without a shuffle."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("chunk_id").to_pylist()
            for f in FIELDS:
                texts: list[list[str]] = []
                start, n = 0, 0
                for i, text in enumerate(b.column(f).to_pylist()):
                    texts.append(tokenize(text or ""))
                    n += len(texts[-1])
                    if n >= GROUPED_TERMS:
                        yield _grouped(ids[start : i + 1], f, texts)
                        start, n, texts = i + 1, 0, []
                if texts:
                    yield _grouped(ids[start:], f, texts)

    lean(chunks.sparkSession)
    return chunks.select("chunk_id", *(F.lower(f).alias(f) for f in FIELDS)).mapInArrow(over, POSTINGS)


def field_statistics(chunks: DataFrame) -> DataFrame:
    """Chunks and mean length of each field."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.size(tokenized(F.lower(f))).alias("dl")) for f in FIELDS))
    return chunks.select(F.explode(fields).alias("f")).groupBy("f.field").agg(F.count("*").alias("n"), F.avg("f.dl").alias("avgdl"))


def frequencies(chunks: DataFrame) -> DataFrame:
    """term, field and df: chunks with each term in each field, without postings."""
    terms = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.array_distinct(tokenized(F.lower(f))).alias("terms")) for f in FIELDS)))
    return chunks.select(terms.alias("f")).select(F.explode("f.terms").alias("term"), "f.field").groupBy("term", "field").agg(F.count("*").alias("df"))


def _in_blocks(made: DataFrame, size: int) -> DataFrame:
    """Postings with the block of their chunk's file, among `size` chunks."""
    blocks = max(1, size // BLOCK_CHUNKS)
    return made.withColumn("block", F.pmod(F.xxhash64(F.substring_index("chunk_id", "#", 1)), F.lit(blocks)).cast("int"))


def _impacts(made: DataFrame, fields: DataFrame) -> DataFrame:
    """Postings and the greatest part of a score of each term, field and block."""
    scored = made.join(F.broadcast(fields.select("field", "avgdl")), "field")  # a row for each field
    return scored.groupBy("term", "field", "block").agg(F.count("*").alias("n"), F.max(saturation(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("top"))


@dataclass
class Index:
    """A published index."""

    spark: SparkSession
    path: str
    _near: dict = field(default_factory=dict, repr=False, compare=False)

    def table(self, name: str) -> DataFrame:
        try:
            rows = self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException:
            if name not in ("postings", "impacts"):
                raise
            return self._made(name)
        return rows.drop("folders", "folder") if name == "chunks" else rows

    def _made(self, name: str) -> DataFrame:
        """Postings or impacts of an index that was written without them."""
        if name == "impacts":
            return _impacts(self.table("postings"), self.table("fields"))
        chunks = self.table("chunks")
        return _in_blocks(postings(chunks), chunks.count())

    def chunks_of(self, paths: Sequence[str]) -> DataFrame:
        """The chunks of some files, read from their folders alone."""
        return of_files(self.spark.read.parquet(f"{self.path}/chunks"), paths)

    def impacts(self) -> DataFrame:
        return self.table("impacts")

    def near(self) -> tuple[DataFrame, DataFrame, quantised.Model] | None:
        """Cells, sizes of their parts and model of the vector index; None where there are too few vectors for one."""
        if "model" not in self._near:
            try:
                self._near["model"] = quantised.load(self.spark, f"{self.path}/near")
            except AnalysisException:
                self._near["model"] = None
        model = self._near["model"]
        return None if model is None else (self.table("near/cells"), self.table("near/sizes"), model)

    @property
    def version(self) -> str:
        return os.path.basename(self.path.rstrip("/"))

    def at(self, version: str) -> Index:
        """Another version of the same index, as long as it is kept."""
        if version == self.version:
            return self
        other = Index(self.spark, os.path.join(os.path.dirname(self.path.rstrip("/")), version))
        if not re.fullmatch(r"v-[0-9a-f]+", version) or not os.path.isdir(other.path):
            raise LookupError(f"There is no version {version} any more")
        return other

    @property
    def metadata(self) -> dict:
        rows = self.spark.read.text(f"{self.path}/metadata.json", wholetext=True).first()
        return json.loads(rows[0])

    @classmethod
    def open(cls, spark: SparkSession, base: str) -> Index:
        with open(os.path.join(base, POINTER), encoding="utf-8") as f:
            return cls(spark, os.path.join(base, f.read().strip()))


def write_tables(chunks: DataFrame, path: str, n: int, made: DataFrame | None = None, for_batches: bool = False, order: str | None = None) -> DataFrame:
    """Write chunks, heads, postings (but for_batches) and terms in n partitions each; `made` are the chunks' postings if they are there already. The chunks as written.

    order: chunks come without chunk_index, which is their place in their file by this column; they are dealt out once for both.
    """
    spark = chunks.sparkSession
    placed = chunks.withColumn("folders", F.lit(n)).withColumn("folder", F.pmod(F.xxhash64("filepath"), F.lit(n)).cast("int"))
    placed = placed.repartition(n, "folder")
    if order:
        placed = placed.withColumn("chunk_index", (F.row_number().over(Window.partitionBy("folder", "filepath").orderBy(order)) - 1).cast("int"))
    placed.sortWithinPartitions("folder", "filepath", "chunk_index").write.partitionBy("folders", "folder").parquet(f"{path}/chunks")
    stored = spark.read.schema(placed.drop("folders", "folder").schema).parquet(f"{path}/chunks")
    size = stored.count()
    if not size:  # folders without rows leave no file to read columns from
        placed.limit(0).write.mode("overwrite").parquet(f"{path}/chunks")
    # What ranking needs of a chunk, without its texts, by chunk id.
    stored.select(*(c for c in stored.columns if c not in ("content", "content_text", "vector"))).repartitionByRange(n, "chunk_id").sortWithinPartitions("chunk_id").write.parquet(f"{path}/heads")
    if for_batches:
        frequencies(stored).sortWithinPartitions("term").write.parquet(f"{path}/terms")
        return stored
    made = postings(stored) if made is None else made
    n = max(n, 1 + size // SORTED_CHUNKS)  # what a task sorts stays the same, however large the corpus
    _in_blocks(made, size).repartitionByRange(n, "term", "block", "chunk_id").sortWithinPartitions("term", "field", "block", "chunk_id").write.parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("term", "field").agg(F.count("*").alias("df")).sortWithinPartitions("term").write.parquet(f"{path}/terms")
    return stored


def build(chunks: DataFrame, base: str, metadata: dict | None = None, vectors: DataFrame | None = None, partitions: int | None = None, for_batches: bool = False, order: str | None = None) -> Index:
    """Write a new version of the index under `base` and publish it. An empty corpus gives empty tables.

    for_batches: without postings and impacts, which `search.search_many` doesn't read; what does makes them from the chunks each time.
    order: a column that makes chunk_index, where chunks have none.
    """
    spark = chunks.sparkSession
    os.makedirs(base, exist_ok=True)
    version = f"v-{uuid.uuid4().hex}"
    path = os.path.join(base, version)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if vectors is not None:
        chunks = chunks.join(vectors.select("chunk_id", "vector"), "chunk_id", "left")
    stored = write_tables(chunks, path, n, for_batches=for_batches, order=order)
    field_statistics(stored).coalesce(1).write.parquet(f"{path}/fields")
    if not for_batches:
        impacts = _impacts(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/fields"))
        # Not dealt into ranges again: each file is sorted, and its pages tell which terms they have.
        impacts.sortWithinPartitions("term", "field", "block").write.parquet(f"{path}/impacts")
    if vectors is not None:
        quantised.save(stored.select("chunk_id", "vector"), f"{path}/near", partitions=n)
    with open(os.path.join(path, "metadata.json"), "w", encoding="utf-8") as f:
        json.dump(metadata or {}, f, ensure_ascii=False, indent=2)
    publish(base, version)
    return Index(spark, path)


def publish(base: str, version: str) -> None:
    """Point to a version; the one pointed to before stays, older ones go."""
    pointer = os.path.join(base, POINTER)
    before = None
    if os.path.exists(pointer):
        with open(pointer, encoding="utf-8") as f:
            before = f.read().strip()
    with open(f"{pointer}.tmp", "w", encoding="utf-8") as f:
        f.write(version)
    os.replace(f"{pointer}.tmp", pointer)
    for name in os.listdir(base):
        if name.startswith("v-") and name not in (version, before):
            shutil.rmtree(os.path.join(base, name), ignore_errors=True)


def export_json(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines."""
    chunks.write.mode("overwrite").json(path)


def export_json_array(chunks: DataFrame, path: str) -> int:
    """Chunks as one JSON array in a file of the driver, partition by partition; how many there were."""
    n = 0
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        f.write("[")
        for r in chunks.select(F.to_json(F.struct("*")).alias("json")).toLocalIterator():
            f.write(f"{',' if n else ''}\n{r['json']}")
            n += 1
        f.write("\n]\n")
    os.replace(f"{path}.tmp", path)
    return n
