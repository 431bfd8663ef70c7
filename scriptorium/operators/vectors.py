"""Embedding providers and exact nearest rows."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: dimensions of the hash provider.
HASH_DIMENSIONS = 256
#: Seconds before the first further attempt.
FIRST_WAIT = 0.5
#: Fixed value: fewest vectors that are worth an inverted file.
LEAST_FOR_CELLS = 256
#: Vectors that cells are fitted on at most, rounds of fitting, and cells that a query looks into.
SAMPLE_VECTORS, FIT_ROUNDS, PROBES = 50_000, 8, 16


class Provider(Protocol):
    """What turns texts into vectors. An empty vector means that there is none."""

    name: str
    dimensions: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class NoProvider:
    name: str = "none"
    dimensions: int = 0

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return [[] for _ in texts]


@dataclass(frozen=True)
class HashProvider:
    """Bytes added to and taken from buckets in turn, at unit length. Only for tests."""

    dimensions: int = HASH_DIMENSIONS
    name: str = "hash"

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return [hash_vector(t, self.dimensions).tolist() for t in texts]


def hash_vector(text: str, dimensions: int = HASH_DIMENSIONS) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8).astype(np.float64)
    at = np.arange(len(raw))
    v = np.bincount(at % dimensions, np.where(at % 2 == 0, raw, -raw), dimensions)
    size = math.sqrt(float(v @ v))
    return v / size if size else v


class RemoteError(RuntimeError):
    """A provider's refusal: its HTTP status and what it says of when to come again."""

    def __init__(self, status: int, retry_after: str | None = None, message: str = ""):
        super().__init__(message or f"HTTP {status}")
        self.status, self.retry_after = status, retry_after


def retryable(status: int) -> bool:
    return status == 429 or 500 <= status < 600


def backoff(attempt: int, retry_after: str | None = None, now: datetime | None = None) -> float:
    """Seconds to wait before another attempt (from 0): what the answer asks for, in seconds or as a date, or else twice as long each time."""
    if retry_after:
        try:
            return max(0.0, float(retry_after))
        except ValueError:
            try:
                return max(0.0, (parsedate_to_datetime(retry_after) - (now or datetime.now(UTC))).total_seconds())
            except ValueError:
                pass
    return FIRST_WAIT * 2**attempt


@dataclass(frozen=True)
class CallableProvider:
    """Any function from texts to vectors, or to (place, vector) pairs in any order.

    It is called with batches of at most `batch` texts of at most `most_chars` characters, `concurrency` at a time;
    refusals with status 429 or 5xx, and other errors, are tried again `retries` times, other statuses aren't.
    """

    function: Callable[[list[str]], list]
    dimensions: int
    name: str = "custom"
    batch: int = 128
    most_chars: int = 24_000
    retries: int = 3
    concurrency: int = 4
    sleep: Callable[[float], None] = time.sleep

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        batches = [[t[: self.most_chars] for t in texts[i : i + self.batch]] for i in range(0, len(texts), self.batch)]
        if len(batches) < 2:
            return [v for b in batches for v in self._one(b)]
        with ThreadPoolExecutor(self.concurrency) as pool:
            return [v for got in pool.map(self._one, batches) for v in got]

    def _one(self, some: list[str]) -> list[list[float]]:
        for attempt in range(self.retries + 1):
            try:
                got = self.function(some)
                break
            except Exception as e:
                refused = isinstance(e, RemoteError)
                if attempt == self.retries or refused and not retryable(e.status):
                    raise
                self.sleep(backoff(attempt, e.retry_after if refused else None))
        if len(got) != len(some):
            raise ValueError(f"{len(some)} texts gave {len(got)} vectors")
        if got and isinstance(got[0], tuple):
            placed = dict(got)
            if sorted(placed) != list(range(len(some))):
                raise ValueError("The answer doesn't have a vector for each text")
            got = [placed[i] for i in range(len(some))]
        if any(len(v) != self.dimensions for v in got):
            raise ValueError(f"A vector doesn't have {self.dimensions} dimensions")
        return got


PROVIDERS: dict[str, Callable[..., Provider]] = {"none": NoProvider, "hash": HashProvider, "custom": CallableProvider}


def provider(kind: str, **options: object) -> Provider:
    if kind not in PROVIDERS:
        raise ValueError(f"Unknown embedding provider '{kind}'. Known: {', '.join(PROVIDERS)}")
    return PROVIDERS[kind](**options)


def embedded(rows: DataFrame, text: str, using: Provider, into: str = "vector") -> DataFrame:
    """rows with the vectors of a text column, computed in batches on the executors."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(using.embed(list(s.fillna(""))), index=s.index)

    return rows.withColumn(into, embed(text))


def distance(v: Column, query: Sequence[float]) -> Column:
    """Euclidean distance in double precision."""
    there = F.array(*(F.lit(float(x)) for x in query))
    square = F.zip_with(v.cast("array<double>"), there, lambda a, b: (a - b) * (a - b))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))


def nearest(rows: DataFrame, query: Sequence[float], k: int, vector: str = "vector", key: str = "chunk_id") -> DataFrame:
    """The k nearest rows, ties by key."""
    return rows.where(F.size(vector) == len(query)).withColumn("distance", distance(F.col(vector), query)).orderBy("distance", key).limit(k)


# ------------------------------------------------------------------ inverted file
def sampled(rows: DataFrame, n: int, vector: str = "vector", key: str = "chunk_id", sample: int = SAMPLE_VECTORS) -> np.ndarray:
    """At most `sample` of n vectors, chosen by a hash of their keys."""
    share = min(1.0, 1.2 * sample / max(n, 1))
    some = rows.where(F.pmod(F.xxhash64(F.col(key)), F.lit(10**6)) < int(share * 10**6) + 1).orderBy(F.xxhash64(F.col(key))).limit(sample)
    return np.array([r[0] for r in some.select(F.col(vector).cast("array<double>")).collect()])


def means(x: np.ndarray, k: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """k centres of x by Lloyd's rounds, from a fixed choice of k rows."""
    k = max(1, min(k, len(x)))
    centres = x[np.random.default_rng(7).permutation(len(x))[:k]]
    for _ in range(rounds):
        at = nearest_cells(x, centres, 1)[:, 0]
        size = np.bincount(at, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


def fit_cells(rows: DataFrame, vector: str = "vector", key: str = "chunk_id", sample: int = SAMPLE_VECTORS) -> np.ndarray | None:
    """Centres of about sqrt(n) cells, fitted on at most `sample` vectors chosen by hash; None for fewer than LEAST_FOR_CELLS vectors."""
    rows = rows.where(F.size(vector) > 0)
    n = rows.count()
    if n < LEAST_FOR_CELLS:
        return None
    return means(sampled(rows, n, vector, key, sample), round(math.sqrt(n)))


def nearest_cells(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each row, nearest first."""
    d = (centres**2).sum(1)[None, :] - 2 * x @ centres.T
    n = min(n, len(centres))
    some = np.argpartition(d, n - 1, axis=1)[:, :n]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)


def with_cells(rows: DataFrame, centres: np.ndarray, vector: str = "vector") -> DataFrame:
    """rows with the `cell` of their vector; every row is indexed, those without a vector in cell -1."""

    @F.pandas_udf("int")
    def cell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = np.full(len(s), -1)
            for i in range(0, len(s), 1000):
                part = s.iloc[i : i + 1000]
                ok = np.flatnonzero([v is not None and len(v) == centres.shape[1] for v in part])
                if len(ok):
                    out[i + ok] = nearest_cells(np.stack([np.asarray(part.iloc[j], np.float64) for j in ok]), centres, 1)[:, 0]
            yield pd.Series(out, index=s.index, dtype="int32")

    return rows.withColumn("cell", cell(F.col(vector)))


def nearest_in_cells(rows: DataFrame, centres: np.ndarray, query: Sequence[float], k: int, probes: int = PROBES, vector: str = "vector", key: str = "chunk_id") -> DataFrame:
    """The k nearest rows of the `probes` cells nearest to the query; with rows partitioned by cell no other file is read."""
    cells = nearest_cells(np.asarray([query], np.float64), centres, probes)[0].tolist()
    return nearest(rows.where(F.col("cell").isin(cells)), query, k, vector, key)


def parse_spec(spec: str) -> tuple[str, str | None]:
    """Provider and model of `provider/model`; the model may be left out and may have slashes."""
    kind, _, model = spec.strip().partition("/")
    if kind not in PROVIDERS:
        raise ValueError(f"Unknown embedding provider '{kind}'. Known: {', '.join(PROVIDERS)}")
    return kind, model or None
