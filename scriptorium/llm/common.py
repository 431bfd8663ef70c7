"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import lean, shared_dir, written

#: Words stand between runs of these characters, once A-Z are lower-cased (fixed value of the word contract).
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tidy(work: Callable) -> Callable:
    """A function over an iterator of batches that gives its memory back at the end: Python workers live on for other tasks."""

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library can
                ctypes.CDLL(None).malloc_trim(0)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) words of a text; null gives an empty array."""
    found = F.split(F.translate(text, UPPER, LOWER), BETWEEN_WORDS)  # several times faster than extracting matches
    return F.coalesce(F.array_remove(found, ""), F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, also inside the lambdas of body."""
    return F.transform(F.array(value), body)[0]


def held_out(doc_id: Column) -> Column:
    """True for rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def number(doc_id: Column, text: Column) -> Column:
    """doc_id as a long: itself if it is one, a hash of it if it isn't, a hash of the text if it is null."""
    return F.coalesce(doc_id.try_cast("long"), F.when(doc_id.isNotNull(), F.xxhash64(doc_id.cast("string"))), F.xxhash64(text))


__all__ = ["BETWEEN_WORDS", "held_out", "lean", "let", "number", "shared_dir", "table", "tidy", "words", "written"]
