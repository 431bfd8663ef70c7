"""Nearest vectors through an inverted file with product quantisation.

Cells are fitted on a bounded sample of the vectors (`vectors.SAMPLE_VECTORS`, chosen by hash);
so are, on what the sample differs from its cells' centres, the codebooks: SUB dimensions at a
time are replaced by the number of the nearest of ENTRIES entries. Every row is indexed: a row's
cell, its code of a byte for each SUB dimensions, and its vector, sorted by cell, so that a query
reads the codes of the cells it looks into, and whole vectors only of the rows that are worth it.

How many cells a query must look into is measured when the index is fitted: so many that for
TRIALS vectors of the sample SHARE of their ten exact nearest in the sample are in the cells
looked into. Data in clusters need few cells, data without any structure a large part of them.

A query ranks the rows of these cells by tables of distances to the entries and takes
the best for an exact comparison; distances and order are those of the vectors. `exact_many`
takes all that bounds by the codes leave, so that its answer is that of a full comparison. Large cells are
cut into parts of about PART_ROWS rows, and queries that look into one part are taken
QUERY_BLOCK at a time, so that no task holds a whole cell or all queries, however they crowd.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.session import written

from . import vectors

#: Fixed value: fewest vectors that are worth an index.
LEAST = vectors.LEAST_FOR_CELLS
#: Dimensions that share a byte, entries of a codebook, and cells at most.
SUB, ENTRIES, MOST_CELLS = 4, 256, 65_536
#: Share of the nearest that the cells must hold, vectors that it is measured with, and rows that are compared exactly for each that is asked for.
SHARE, TRIALS, RERANK = 0.97, 200, 20
PART_ROWS, QUERY_BLOCK = 50_000, 5_000
#: Rows, on average, that an exact search compares in one task.
GROUP_ROWS = 20_000


@dataclass(frozen=True)
class Model:
    """Centres of the cells and the codebooks; dimensions are filled up with zeros to a multiple of SUB."""

    dimensions: int
    centres: np.ndarray  # cells x filled dimensions
    codebooks: np.ndarray  # parts of a vector x entries x SUB
    looks: int  # cells that a query looks into

    def filled(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.centres.shape[1] - x.shape[1])))

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells and codes of vectors."""
        x = self.filled(x)
        cells = vectors.nearest_cells(x, self.centres, 1)[:, 0]
        rest = x - self.centres[cells]
        codes = [vectors.nearest_cells(rest[:, j * SUB : (j + 1) * SUB], book, 1)[:, 0] for j, book in enumerate(self.codebooks)]
        return cells.astype(np.int32), np.stack(codes, axis=1).astype(np.uint8)

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        return vectors.nearest_cells(self.filled(x), self.centres, n)

    def distances(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Approximate squared distances, queries x codes, of rows of a cell."""
        rest = (self.filled(queries) - self.centres[cell]).reshape(len(queries), len(self.codebooks), 1, SUB)
        tables = ((rest - self.codebooks[None]) ** 2).sum(-1)  # queries x parts x entries
        out = np.zeros((len(queries), len(codes)))
        for j in range(tables.shape[1]):
            out += tables[:, j, codes[:, j]]
        return out


    def gaps(self, x: np.ndarray, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How far vectors are from what their codes stand for."""
        meant = self.centres[cells] + np.concatenate([book[codes[:, j]] for j, book in enumerate(self.codebooks)], axis=1)
        return np.sqrt(((self.filled(x) - meant) ** 2).sum(1))


def usable(vector: str, dimensions: int | None = None) -> Column:
    """Whether there is a vector (of so many dimensions) with finite components only."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dimensions if dimensions else F.size(v) > 0) & finite, F.lit(False))


def fit(rows: DataFrame, vector: str = "vector", key: str = "chunk_id", sample: int = vectors.SAMPLE_VECTORS, least: int = LEAST) -> Model | None:
    """A model with about sqrt(n) cells; None for fewer than `least` vectors. The dimensions are those most vectors have."""
    rows = rows.where(usable(vector))
    sizes = {r["d"]: r["n"] for r in rows.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()}
    if not sizes or (n := next(iter(sizes.values()))) < least:
        return None
    dimensions = next(iter(sizes))
    x = vectors.sampled(rows.where(F.size(vector) == dimensions), n, vector, key, sample)
    x = np.pad(x, ((0, 0), (0, -dimensions % SUB)))
    centres = vectors.means(x, min(round(math.sqrt(n)), MOST_CELLS))
    rest = x - centres[vectors.nearest_cells(x, centres, 1)[:, 0]]
    books = [vectors.means(rest[:, j : j + SUB], ENTRIES) for j in range(0, x.shape[1], SUB)]
    return Model(dimensions, centres, np.stack(books), looks_for(x, centres))


def looks_for(x: np.ndarray, centres: np.ndarray) -> int:
    """Cells, in order of nearness, that hold SHARE of the ten nearest of TRIALS rows of x."""
    cells = vectors.nearest_cells(x, centres, 1)[:, 0]
    step = max(1, len(x) // TRIALS)
    ranks = []
    for i in range(0, step * min(TRIALS, len(x)), step):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        near = np.argpartition(d, min(10, len(d) - 1))[:10]
        place = np.empty(len(centres), int)
        place[vectors.nearest_cells(x[i : i + 1], centres, len(centres))[0]] = np.arange(len(centres))
        ranks += place[cells[near]].tolist()
    return int(np.quantile(ranks, SHARE, method="higher")) + 1


def indexed(rows: DataFrame, model: Model, vector: str = "vector", key: str = "chunk_id") -> DataFrame:
    """key, cell, part, code and vector of every row with a vector of the model's dimensions, large cells in parts."""
    kind = dict(rows.dtypes)[key]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 2000):
                some = b.iloc[i : i + 2000]
                cells, codes = model.coded(np.stack([np.asarray(v, np.float64) for v in some["vector"]]))
                yield pd.DataFrame({key: some[key], "cell": cells, "code": [c.tobytes() for c in codes], "vector": some["vector"]})

    valid = rows.where(usable(vector, model.dimensions)).select(key, F.col(vector).cast("array<float>").alias("vector"))
    coded = written(valid.mapInPandas(encode, f"`{key}` {kind}, cell int, code binary, vector array<float>"), "codes")
    parts = coded.groupBy("cell").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))  # MOST_CELLS rows at most
    placed = coded.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")).cast("int"))
    return placed.select(key, "cell", "part", "code", "vector")


def save(rows: DataFrame, path: str, vector: str = "vector", key: str = "chunk_id", partitions: int | None = None) -> Model | None:
    """Fit, index and write the vectors of rows under a path: cells, sorted by cell, sizes of their parts, and the model. Nothing for too few."""
    model = fit(rows, vector, key)
    if model is None:
        return None
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("cell", "part", key)
    indexed(rows, model, vector, key).repartitionByRange(n, *order).sortWithinPartitions(*order).write.parquet(f"{path}/cells")
    spark.read.parquet(f"{path}/cells").groupBy("cell", "part").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/sizes")
    entries = [("centre", i, c.tolist()) for i, c in enumerate(model.centres)] + [("book", j * ENTRIES + e, v.tolist()) for j, book in enumerate(model.codebooks) for e, v in enumerate(book)] + [("dimensions", model.dimensions, []), ("looks", model.looks, [])]
    spark.createDataFrame(entries, "kind string, at long, values array<double>").coalesce(1).write.parquet(f"{path}/model")
    return model


def load(spark: SparkSession, path: str) -> Model:
    """The model written under a path: MOST_CELLS centres and the codebooks at most."""
    rows = spark.read.parquet(f"{path}/model").orderBy("at").collect()
    of = lambda kind: [r for r in rows if r["kind"] == kind]
    books: dict[int, list] = {}
    for r in of("book"):
        books.setdefault(r["at"] // ENTRIES, []).append(r["values"])
    return Model(of("dimensions")[0]["at"], np.array([r["values"] for r in of("centre")]), np.array([books[j] for j in sorted(books)]), of("looks")[0]["at"])


def _best(distances: np.ndarray, names: np.ndarray, n: int) -> np.ndarray:
    """Places of the n smallest distances, ties by name."""
    if len(distances) <= n:
        return np.arange(len(distances))
    last = np.partition(distances, n - 1)[n - 1]
    sure = np.flatnonzero(distances < last)
    ties = sorted(np.flatnonzero(distances == last), key=lambda i: names[i])
    return np.concatenate([sure, np.array(ties[: n - len(sure)], dtype=sure.dtype)])


def nearest(cells: DataFrame, model: Model, query: Sequence[float], k: int, probes: int | None = None, rerank: int | None = None, allowed: DataFrame | None = None, key: str = "chunk_id") -> DataFrame:
    """key and exact distance of the k nearest rows found for one query; `allowed` (key) limits the rows before any is ranked."""
    if len(query) != model.dimensions:
        return cells.select(key, F.lit(0.0).alias("distance")).where(F.lit(False))
    kind = dict(cells.dtypes)[key]
    q = np.asarray([query], np.float64)
    near = model.probes(q, probes or model.looks)[0].tolist()
    most = max(k, rerank or RERANK * k)
    mine = cells.where(F.col("cell").isin(near))
    rows = mine.select(key, "cell", "code")
    rows = rows.join(allowed.select(key), key, "left_semi") if allowed is not None else rows

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = np.empty(len(b))
            codes = np.frombuffer(b"".join(b["code"]), np.uint8).reshape(len(b), -1)
            at = b["cell"].to_numpy()
            for c in np.unique(at):
                d[at == c] = model.distances(q, int(c), codes[at == c])[0]
            best = _best(d, b[key].to_numpy(), most)
            yield pd.DataFrame({key: b[key].to_numpy()[best], "cell": at[best], "approximate": d[best]})

    found = rows.mapInPandas(rank, f"`{key}` {kind}, cell int, approximate double").orderBy("approximate", key).limit(most)
    exact = mine.select(key, "cell", "vector").join(F.broadcast(found), ["cell", key])  # found has `most` rows at most
    return exact.select(key, vectors.distance(F.col("vector"), query).alias("distance")).orderBy("distance", key).limit(k)


def exact_many(cells: DataFrame, model: Model, queries: DataFrame, k: int, allowed: DataFrame | None = None, key: str = "chunk_id") -> DataFrame:
    """query_id, key, distance and rank (from 1) of the k nearest of all rows, for each row of queries (query_id, vector).

    A row's distance differs from that of its code by the distance between row and code at most: of the rows of a
    group of cells those are compared exactly that can be nearer by this than the k-th surely is. None is missed.
    """
    kind, query_kind = dict(cells.dtypes)[key], dict(queries.dtypes)["query_id"]
    asked = written(queries.where(usable("vector", model.dimensions)).select("query_id", F.col("vector").cast("array<double>").alias("query")), "asked")
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    groups = max(1, math.ceil(cells.count() / GROUP_ROWS))
    rows = cells.select(key, "cell", "code", "vector", F.pmod(F.xxhash64("cell", "part"), F.lit(groups)).cast("int").alias("place"))
    rows = rows.join(allowed.select(key), key, "left_semi") if allowed is not None else rows
    spark = cells.sparkSession
    rows = rows.crossJoin(F.broadcast(spark.range(blocks).select(F.col("id").cast("int").alias("turn"))))  # once for each block of queries
    theirs = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).crossJoin(F.broadcast(spark.range(groups).select(F.col("id").cast("int").alias("group"))))

    def compare(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        found: list[list] = [[], [], []]
        if len(mine) and len(theirs):
            mine = mine.sort_values(["cell", key], ignore_index=True)
            x = np.stack([np.asarray(v, np.float64) for v in mine["vector"]])
            codes = np.frombuffer(b"".join(mine["code"]), np.uint8).reshape(len(mine), -1)
            at, names, ids = mine["cell"].to_numpy(), mine[key].to_numpy(), theirs["query_id"].to_numpy()
            gaps = model.gaps(x, at, codes)
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            for i in range(0, len(theirs), 32):
                q = np.stack([np.asarray(v, np.float64) for v in theirs["query"].iloc[i : i + 32]])
                d = np.concatenate([model.distances(q, int(at[a]), codes[a:b]) for a, b in zip(starts, [*starts[1:], len(at)], strict=True)], axis=1)
                d = np.sqrt(np.maximum(d, 0))
                for j, one in enumerate(d):
                    last = np.partition(one + gaps, k - 1)[k - 1] if len(one) > k else np.inf
                    may = np.flatnonzero(one - gaps <= last + 1e-9 * (1 + abs(last)))  # sums in another order differ by less
                    true = np.sqrt(((x[may] - q[j]) ** 2).sum(1))
                    best = _nearly_best(true, k)
                    found[0] += [ids[i + j]] * len(best)
                    found[1] += names[may[best]].tolist()
                    found[2] += true[best].tolist()
        return pd.DataFrame({"query_id": found[0], key: found[1]})

    picked = rows.groupBy("place", "turn").cogroup(theirs.groupBy("group", "block")).applyInPandas(compare, f"query_id {query_kind}, `{key}` {kind}")
    return _ordered(picked.join(cells.select(key, "vector"), key), asked, k, key)


def _nearly_best(distances: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest distances, and of all that differ from the k-th by rounding alone."""
    if len(distances) <= k:
        return np.arange(len(distances))
    last = np.partition(distances, k - 1)[k - 1]
    return np.flatnonzero(distances <= last + 1e-9 * (1 + last))


def _ordered(found: DataFrame, asked: DataFrame, k: int, key: str) -> DataFrame:
    """The k nearest of each query by exact distance, ties by key."""
    square = F.zip_with(F.col("vector").cast("array<double>"), "query", lambda a, b: (a - b) * (a - b))
    exact = found.join(asked, "query_id").select("query_id", key, F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x)).alias("distance"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", key))
    return exact.withColumn("rank", nth).where(F.col("rank") <= k)


def nearest_many(cells: DataFrame, sizes: DataFrame, model: Model, queries: DataFrame, k: int, probes: int | None = None, rerank: int | None = None, allowed: DataFrame | None = None, key: str = "chunk_id", exact: bool = False) -> DataFrame:
    """query_id, key, distance and rank (from 1) of the k nearest rows found for each row of queries (query_id, vector), in one job.

    exact: of all rows, none missed, whatever their number.
    """
    if exact:
        return exact_many(cells, model, queries, k, allowed, key)
    kind, query_kind = dict(cells.dtypes)[key], dict(queries.dtypes)["query_id"]
    most = max(k, rerank or RERANK * k)
    asked = written(queries.where(usable("vector", model.dimensions)).select("query_id", F.col("vector").cast("array<double>").alias("query")), "asked")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 2000):
                some = b.iloc[i : i + 2000]
                near = model.probes(np.stack([np.asarray(v, np.float64) for v in some["query"]]), probes or model.looks)
                at = np.repeat(np.arange(len(some)), near.shape[1])
                yield pd.DataFrame({"query_id": some["query_id"].to_numpy()[at], "query": some["query"].to_numpy()[at], "cell": near.ravel().astype(np.int32)})

    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    looks = asked.mapInPandas(look, f"query_id {query_kind}, query array<double>, cell int").join(sizes.select("cell", "part"), "cell")
    looks = written(looks.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")), "looks")
    rows = cells.select(key, "cell", "part", "code")
    rows = rows.join(allowed.select(key), key, "left_semi") if allowed is not None else rows
    turns = looks.select("cell", "part", "block").distinct().toDF("cell", "part", "turn")
    rows = rows.join(turns, ["cell", "part"])  # once for each block of queries that looks there

    def rank(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(mine) and len(theirs):
            codes = np.frombuffer(b"".join(mine["code"]), np.uint8).reshape(len(mine), -1)
            cell, names, ids = int(mine["cell"].iloc[0]), mine[key].to_numpy(), theirs["query_id"].to_numpy()
            for i in range(0, len(theirs), 32):
                d = model.distances(np.stack([np.asarray(v, np.float64) for v in theirs["query"].iloc[i : i + 32]]), cell, codes)
                for j, one in enumerate(d):
                    best = _best(one, names, most)
                    out.append(pd.DataFrame({"query_id": ids[i + j], key: names[best], "cell": cell, "part": int(mine["part"].iloc[0]), "approximate": one[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], key: [], "cell": [], "part": [], "approximate": []})

    ranked = rows.groupBy("cell", "part", "turn").cogroup(looks.groupBy("cell", "part", "block")).applyInPandas(rank, f"query_id {query_kind}, `{key}` {kind}, cell int, part int, approximate double")
    order = Window.partitionBy("query_id").orderBy("approximate", key)
    found = ranked.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    return _ordered(found.join(cells.select(key, "cell", "part", "vector"), ["cell", "part", key]), asked, k, key)


__all__ = ["Model", "exact_many", "fit", "indexed", "load", "nearest", "nearest_many", "save", "usable"]
