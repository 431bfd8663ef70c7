"""Uniform shuffle of rows into shards of exact sizes, with DataFrame functions only.

Rows are permuted where they lie: each partition sorts by a random key and is written with
the places of its rows. How many rows of a partition go to a shard isn't left to the rows:
the communication matrix (partitions x shards) is drawn, with the partitions' counts as row
sums and the shards' sizes as column sums, from the distribution that a uniform permutation
of all rows gives it, the multivariate hypergeometric. It is drawn by halving: of the places
that a range of partitions has in each shard, the left half of the range gets a multivariate
hypergeometric part, and so on down to single partitions. A single draw is a rejection by
ratio of uniforms against the exact probabilities (differences of log factorials).

The first places of a partition go to shard 0, the next to shard 1 and so on. Within a shard
rows are permuted once more: a second random key cuts the shard into cells of about CELL_ROWS
rows, so that no task holds a shard; cells are counted without the texts, which fixes where
their slots begin, and only then are the rows exchanged, once, and ranked in their cell.

Law: `rows`. Shard sizes differ by one at most, the first shards being the larger ones. Equal
texts are no group: a uniform shuffle scatters copies.

Edge cases: null and empty texts and null doc_ids are rows like others; repeated rows each get
a slot; an empty table gives no rows; the given columns come back in the struct `row`, so that
none clashes. With fewer rows than shards the last shards are empty. One seed gives the same
matrix again; the permutations follow the partitions that Spark reads.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, table, written

SHARDS, SEED = 16, 11
#: Rows of a cell, on average.
CELL_ROWS = 4096
#: Rows of the matrix and of the table of cells up to which they are broadcast; larger ones are joined by shuffle.
BROADCAST_PARTS, BROADCAST_CELLS = 100_000, 1_000_000
#: Trials of a draw, by stages; each is accepted with a probability of about a half or more.
TRIALS = (2, 8, 64, 1024)
#: Fixed values of the method: 2 sqrt(2 / e) and 3 - 2 sqrt(3 / e).
WIDTH, MARGIN = 2 * math.sqrt(2 / math.e), 3 - 2 * math.sqrt(3 / math.e)
#: Bits of monotonically_increasing_id() that count rows within a partition.
ROW_BITS = 33


def log_factorials(a: Column, b: Column) -> Column:
    """ln a! - ln b! without the loss of taking large numbers from each other."""

    def series(z: Column) -> Column:
        return (1 / F.lit(12.0) - (1 / F.lit(360.0) - 1 / (F.lit(1260.0) * z * z)) / (z * z)) / z

    def of(p: Column) -> Column:
        x, y = p["x"], p["y"]
        ratio = F.lit(1.0)
        for i in range(1, 10):  # the series is good to 1e-12 from 10 on
            ratio = ratio * ((x - i) / (y - i))
        return (x - y) * F.log(x) + (y - 0.5) * F.log1p((x - y) / y) - (x - y) + series(x) - series(y) - F.log(ratio)

    return let(F.struct((a + 10.0).alias("x"), (b + 10.0).alias("y")), of)


def hypergeometric(total: Column, good: Column, drawn: Column, *key: Column) -> Column:
    """How many of `good` among `total` are among `drawn` taken without replacement; the key decides the outcome."""

    def uniform(i: Column, which: int) -> Column:
        return (F.shiftrightunsigned(F.xxhash64(*key, i, F.lit(which)), 11).cast("double") + 0.5) / float(1 << 53)

    def of(p: Column) -> Column:
        def trial(i: Column) -> Column:
            def judged(c: Column) -> Column:
                x, mode = c["x"], p["mode"]
                odds = log_factorials(mode, x) + log_factorials(p["g"] - mode, p["g"] - x) + log_factorials(p["n"] - mode, p["n"] - x) + log_factorials(p["rest"] + mode, p["rest"] + x)
                inside = (x >= p["low"]) & (x <= p["high"])
                return F.struct(x.alias("x"), F.when(inside, 2 * F.log(c["u"]) <= odds).otherwise(F.lit(False)).alias("taken"))

            made = let(uniform(i, 0), lambda u: F.struct(F.floor(p["mean"] + 0.5 + p["h"] * (uniform(i, 1) - 0.5) / u).cast("double").alias("x"), u.alias("u")))
            return let(made, judged)

        def stage(first: int, last: int) -> Column:
            return F.get(F.filter(F.transform(F.sequence(F.lit(first), F.lit(last - 1)), trial), lambda c: c["taken"]), 0)["x"]

        stages = [stage(a, b) for a, b in zip((0, *TRIALS), TRIALS, strict=False)]
        return F.when(p["low"] == p["high"], p["low"]).otherwise(F.coalesce(*stages, p["mode"])).cast("long")

    def shaped(v: Column) -> Column:
        share = v["g"] / F.greatest(v["t"], F.lit(1.0))
        spread = v["n"] * share * (1 - share) * (v["t"] - v["n"]) / F.greatest(v["t"] - 1, F.lit(1.0))
        return F.struct(
            v["g"].alias("g"), v["n"].alias("n"), (v["t"] - v["g"] - v["n"]).alias("rest"), (v["n"] * share).alias("mean"), (F.lit(WIDTH) * F.sqrt(F.greatest(spread, F.lit(0.0)) + 0.5) + MARGIN).alias("h"),
            F.floor((v["n"] + 1) * (v["g"] + 1) / (v["t"] + 2)).cast("double").alias("mode"), F.greatest(F.lit(0.0), v["n"] - (v["t"] - v["g"])).alias("low"), F.least(v["n"], v["g"]).alias("high"),
        )

    given = F.struct(total.cast("double").alias("t"), good.cast("double").alias("g"), drawn.cast("double").alias("n"))
    return let(let(given, shaped), of)


def parted(room: Column, drawn: Column, *key: Column) -> Column:
    """Of the places room[s], how many each s gets of `drawn` taken uniformly from all of them."""

    def step(acc: Column, i: Column) -> Column:
        x = hypergeometric(acc["total"], room[i], acc["left"], *key, i)
        return let(x, lambda v: F.struct((acc["total"] - room[i]).alias("total"), (acc["left"] - v).alias("left"), F.concat(acc["out"], F.array(v)).alias("out")))

    start = F.struct(_sum(room).alias("total"), drawn.cast("long").alias("left"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.size(room) - 1), start, step, lambda acc: acc["out"])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a + b)


def matrix(counts: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """part and row, the numbers of its rows for each shard, of counts (part, n)."""
    parts = counts.count()
    one = counts.agg(F.array_sort(F.collect_list(F.struct("part", F.col("n").cast("long").alias("n")))).alias("parts"))  # one small entry a partition
    total = _sum(F.transform("parts", lambda p: p["n"]))
    size = let(total, lambda n: F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.floor(n / shards).cast("long") + F.when(s < n % shards, 1).otherwise(0)))
    tree = one.where(F.size("parts") > 0).select("parts", size.alias("room"))
    for _ in range(math.ceil(math.log2(max(parts, 1)))):
        half = F.floor(F.size("parts") / 2).cast("int")
        left, right = F.slice("parts", F.lit(1), half), F.slice("parts", half + 1, F.size("parts") - half)
        mine = parted(F.col("room"), _sum(F.transform(left, lambda p: p["n"])), F.lit(seed), F.col("parts")[0]["part"], F.size("parts"))
        split = tree.select("parts", "room", F.when(F.size("parts") > 1, mine).alias("mine"), left.alias("left"), right.alias("right"))
        both = F.array(F.struct(F.col("left").alias("parts"), F.col("mine").alias("room")), F.struct(F.col("right").alias("parts"), F.zip_with("room", "mine", lambda a, b: a - b).alias("room")))
        tree = split.select(F.explode(F.when(F.size("parts") > 1, both).otherwise(F.array(F.struct("parts", "room")))).alias("node")).select("node.*")
    return tree.select(F.col("parts")[0]["part"].alias("part"), F.col("room").alias("row"))


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Every row of docs once, in the struct `row`, with shard (0 to shards - 1) and slot (0, 1, ... within the shard)."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.rand(seed).alias("key"), F.rand(seed + 1).alias("again")).sortWithinPartitions("key")
    place = F.monotonically_increasing_id().bitwiseAND((1 << ROW_BITS) - 1)
    local = written(keyed.select("row", "again", F.spark_partition_id().alias("part"), place.alias("place")), "local")
    counts = written(local.groupBy("part").agg(F.count("*").alias("n")), "counts")
    size = counts.agg(F.count("*").alias("parts"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    drawn = written(matrix(counts, shards, seed), "matrix")
    bounds = drawn.select("part", F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda s: _sum(F.slice("row", F.lit(1), s))).alias("ends"))
    placed = local.join(F.broadcast(bounds) if size["parts"] <= BROADCAST_PARTS else bounds, "part")
    cells = max(1, math.ceil(size["rows"] / (shards * cell_rows)))
    cell = F.floor(F.col("again") * cells).cast("int")
    placed = placed.select("row", "again", "part", "place", F.size(F.filter("ends", lambda e: e <= F.col("place"))).alias("shard"), cell.alias("cell"))
    held = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    begins = written(held.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin")), "cells")
    begins = F.broadcast(begins) if shards * cells <= BROADCAST_CELLS else begins
    rank = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("again", "part", "place"))
    return placed.join(begins, ["shard", "cell"]).select("row", "shard", (F.col("begin") + rank - 1).alias("slot"))


def save(rows: DataFrame, path: str) -> None:
    """Write shuffled rows as Parquet, a folder for each shard, rows in the order of their slots within a file."""
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").select("row.*", "slot", "shard").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("row.text"), F.lit("")).cast("binary")
    rows = shuffled(table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("row.doc_id").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
