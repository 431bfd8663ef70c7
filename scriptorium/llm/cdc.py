"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of every text; where its upper BITS bits are zero
a chunk ends, so that cuts depend on the last 32 bytes alone and an insertion
moves the cuts near it only. Chunks have MIN_CHUNK to MAX_CHUNK bytes (ends of
documents aside) and end between characters. A chunk whose 128-bit digest stands
in two or more documents is repeated; unbroken repeated chunks of a document make
a stretch. Stretches of at least MIN_RUN bytes are repeated passages, parted where the
first document to have the chunks changes. The document with the smallest doc_id keeps
its copy.

Edge cases: null and empty texts have no chunks; rows with equal doc_id and text
count as one document; a null doc_id counts as a hash of the text, one that is no number as a hash of itself; repeats within one document
alone are left; further columns are ignored, or kept by deduplicate().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, number, table, tidy, written

BITS, MIN_CHUNK, MAX_CHUNK, MIN_RUN = 4, 16, 96, 90
WINDOW = 32
_GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)
_BATCH = 2_000_000


def gear(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rolling hash at every byte; first: offsets of texts that are WINDOW bytes apart at least, the gaps being zero."""
    h = _GEAR[data]
    for s in first:
        h[s - WINDOW : s] = 0
    k = 1
    while k < WINDOW:
        moved = h[:-k] << np.uint32(k)
        h[k:] += moved
        k *= 2
    return h


def cuts(candidates: list[int], start: int, end: int, inside: np.ndarray) -> list[int]:
    """Ends of the chunks of one text at start..end; inside[i]: byte i continues a character."""
    out, last = [], start
    for c in [*candidates, end]:
        while c - last > MAX_CHUNK:
            forced = last + MAX_CHUNK
            while inside[forced]:
                forced -= 1
            out.append(forced)
            last = forced
        if c - last >= MIN_CHUNK or c == end and c > last:
            out.append(c)
            last = c
    return out


def chunks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: high and low halves of the chunks' digests, and their starts, sizes in characters and sizes in bytes."""
    raw = [t.encode() for t in texts]
    gap = bytes(WINDOW)
    joined = gap + gap.join(raw) + b"\0"
    data = np.frombuffer(joined, np.uint8)
    first = np.cumsum([WINDOW, *(len(r) + WINDOW for r in raw)])[:-1]
    inside = (data & 0xC0) == 0x80
    h = gear(data, first)
    may = np.flatnonzero((h >> np.uint32(32 - BITS)) == 0) + 1
    may = may[~inside[may]] if len(may) and may[-1] < len(inside) else may[:-1][~inside[may[:-1]]]
    at_char = np.cumsum(~inside)  # characters up to and with a byte
    lo, hi = np.searchsorted(may, first, "right"), np.searchsorted(may, first + [len(r) for r in raw], "left")
    for s, r, a, b in zip(first.tolist(), raw, lo, hi, strict=True):
        ends = cuts(may[a:b].tolist(), s, s + len(r), inside)
        starts = [s, *ends[:-1]] if ends else []
        digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(joined[i:j]) for i, j in zip(starts, ends, strict=True)]), ">i8").astype(np.int64)
        places = np.array([s, *ends]) if ends else np.array([s])
        chars = at_char[places - 1] - at_char[s - 1]
        yield digest[::2], digest[1::2], chars[:-1], np.diff(chars), np.diff(places)


def _id() -> Column:
    return number(F.col("doc_id"), F.col("text"))


SCHEMA = "hi long, lo long, doc long, text_key int, idx int, start int, n_chars short, n_bytes short"


def chunked(docs: DataFrame) -> DataFrame:
    """All chunks of docs (doc_id, text)."""

    @tidy
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            i = 0
            while i < b.num_rows:
                some, held = [], 0
                while i + len(some) < b.num_rows and held < _BATCH:
                    some.append(texts[i + len(some)].as_py())
                    held += len(some[-1])
                got = list(chunks(some))
                n = [len(x[0]) for x in got]
                keys = np.array([xxhash.xxh32_intdigest(t.encode()) for t in some], np.uint32).astype(np.int32)
                col = lambda k, kind: pa.array(np.concatenate([x[k] for x in got]).astype(kind))  # noqa: E731,B023
                yield pa.RecordBatch.from_arrays(
                    [col(0, np.int64), col(1, np.int64), pa.array(np.repeat(ids[i : i + len(some)], n)), pa.array(np.repeat(keys, n)), pa.array(np.concatenate([np.arange(x) for x in n]).astype(np.int32)), col(2, np.int32), col(3, np.int16), col(4, np.int16)],
                    names=[x.split()[0] for x in SCHEMA.split(", ")],
                )
                i += len(some)

    whole = docs.where(F.col("text").isNotNull() & (F.col("text") != "")).select(_id().alias("doc_id"), "text")
    return whole.mapInArrow(over, SCHEMA)


def repeated(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """One row for each repeated passage of each document.

    Columns: doc_id, text_key, start_char, n_chars, n_bytes, n_chunks, first_doc_id (the smallest that has
    its chunks), kept (the document is the first to have it). A passage may be less than min_run bytes of a
    stretch that has as many.
    """
    lean(docs.sparkSession)
    parts = chunked(docs)
    twice = parts.groupBy("hi", "lo").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"))
    twice = written(twice.where("first_doc < last_doc").drop("last_doc"), "repeated")  # so that a hot digest's join can be split
    found = parts.join(twice, ["hi", "lo"]).drop("hi", "lo").dropDuplicates(["doc", "text_key", "idx"])
    order = Window.partitionBy("doc", "text_key").orderBy("idx")
    found = found.withColumn("island", F.col("idx") - F.row_number().over(order)).withColumn("turn", (F.col("first_doc") != F.lag("first_doc").over(order)).cast("int"))
    found = found.withColumn("part", F.coalesce(F.sum("turn").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)))
    runs = found.groupBy("doc", "text_key", "island", "part").agg(
        F.min("start").cast("long").alias("start_char"), F.sum("n_chars").alias("n_chars"), F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_chunks"), F.min("first_doc").alias("first_doc_id")
    )
    stretch = Window.partitionBy("doc", "text_key", "island")
    runs = runs.withColumn("stretch", F.sum("n_bytes").over(stretch)).where(F.col("stretch") >= min_run)
    return runs.select(F.col("doc").alias("doc_id"), "text_key", "start_char", "n_chars", "n_bytes", "n_chunks", "first_doc_id", (F.col("first_doc_id") == F.col("doc")).alias("kept"))


def deduplicate(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """docs with the repeated passages that an earlier document keeps taken out of `text`."""
    gone = repeated(docs.select("doc_id", "text"), min_run).where(~F.col("kept"))
    own = "_cdc" + "_" * max(map(len, docs.columns))  # no column of docs starts like this and is as long
    k, its_doc, its_key, its_spans = (f"{own}{x}" for x in ("k", "doc", "key", "spans"))
    spans = gone.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start_char", "n_chars")).alias(its_spans)).select(F.col("doc_id").alias(its_doc), F.col("text_key").alias(its_key), its_spans)

    @F.pandas_udf("int")
    def key(texts: pd.Series) -> pd.Series:
        return pd.Series([0 if t is None else np.uint32(xxhash.xxh32_intdigest(t.encode())).astype(np.int32) for t in texts], dtype="int32")

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, ss in zip(texts, spans, strict=True):
            if t is None or ss is None:
                out.append(t)
                continue
            kept, at = [], 0
            for s in sorted((x["start_char"], x["n_chars"]) for x in ss):
                kept.append(t[at : s[0]])
                at = s[0] + s[1]
            out.append("".join(kept) + t[at:])
        return pd.Series(out, dtype=object)

    on = [_id() == F.col(its_doc), F.col(k) == F.col(its_key)]
    return docs.withColumn(k, key("text")).join(spans, on, "left").withColumn("text", without("text", its_spans)).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(table(spark, sf_dir, "documents"))
