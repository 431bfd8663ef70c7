"""Exact quantiles in bounded memory.

Equal values of a group are counted first, so that what is left has a row for each distinct value.
These rows are dealt into ranges of (group, value) over all tasks, sums within the ranges are added
up from range to range, and of each group the rows that hold a wanted rank are picked. No task holds
a group, and nothing is collected. Up to FEW rows Spark's own percentiles, which hold the distinct
values of a group in one buffer, give the same numbers with one shuffle less.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.session import written

#: Rows up to which Spark's percentiles are used.
FEW = 200_000
NEAREST, BETWEEN = "nearest", "between"


def _places(how: str, share: float, n: Column) -> list[Column]:
    """The ranks, from 1, that a quantile needs: one, or the two that it lies between."""
    if how == NEAREST:
        return [F.greatest(F.lit(1), F.ceil(n * share))]
    at = (n - 1) * share
    return [F.floor(at) + 1, F.ceil(at) + 1]


def _spark(value: str, how: str, share: float) -> Column:
    kind = "disc" if how == NEAREST else "cont"
    return F.expr(f"percentile_{kind}({share}) WITHIN GROUP (ORDER BY `{value}`)")


def quantiles(rows: DataFrame, wanted: Mapping[str, Mapping[str, tuple[str, float]]], by: Sequence[str] = (), few: int = FEW) -> DataFrame:
    """by and the quantiles of some columns: {column: {name: (how, share)}}, null where a group has no value.

    how is `nearest`, the value at rank ceil(n share), or `between`, on the line between the two
    values around (n - 1) share. Nulls don't count. Without `by` there is one row.
    """
    names = {n: (c, *spec) for c, of in wanted.items() for n, spec in of.items()}
    if rows.limit(few + 1).count() <= few:
        found = [_spark(c, how, share).alias(n) for n, (c, how, share) in names.items()]
        return rows.groupBy(*by).agg(*found) if by else rows.agg(*found)
    groups = rows.select(*by).distinct() if by else rows.sparkSession.range(1).select()
    return reduce(lambda a, c: _joined(a, _ranged(rows, c, wanted[c], by), by), wanted, groups)


def _joined(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    if not by:
        return a.crossJoin(b)  # one row each
    same = reduce(lambda x, y: x & y, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by))
    return a.alias("a").join(b.alias("b"), same, "left").select("a.*", *(F.col(f"b.{c}") for c in b.columns if c not in by))


def _ranged(rows: DataFrame, value: str, names: Mapping[str, tuple[str, float]], by: Sequence[str]) -> DataFrame:
    keys = [f"_{i}" for i in range(len(by))]
    some = rows.where(F.col(value).isNotNull()).select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(value).alias("value"))
    counts = some.groupBy(*keys, "value").agg(F.count("*").alias("n"))
    placed = written(counts.repartitionByRange(*keys, "value").withColumn("part", F.spark_partition_id()), "values")
    sums = placed.groupBy(*keys, "part").agg(F.sum("n").alias("n"))  # a row for each group and range that it is in
    before = Window.partitionBy(*keys).orderBy("part")
    sums = sums.select(*keys, "part", (F.sum("n").over(before) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(*keys)).alias("total"))
    match = reduce(lambda x, y: x & y, (F.col(f"p.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys), F.col("p.part") == F.col("s.part"))
    within = placed.withColumn("up_to", F.sum("n").over(Window.partitionBy("part", *keys).orderBy("value")))
    ends = within.alias("p").join(sums.alias("s"), match).select(*(F.col(f"p.{k}") for k in keys), "p.value", "p.n", (F.col("p.up_to") + F.col("s.before")).alias("end"), "s.total")

    def holds(place: Column) -> Column:
        return (F.col("end") - F.col("n") < place) & (place <= F.col("end"))

    wanted = {(n, i): p for n, (how, share) in names.items() for i, p in enumerate(_places(how, share, F.col("total")))}
    picked = ends.where(reduce(lambda a, b: a | b, map(holds, wanted.values())))  # a few rows of each group
    found = picked.groupBy(*keys).agg(F.max("total").alias("total"), *(F.max(F.when(holds(p), F.col("value"))).alias(f"{n}_{i}") for (n, i), p in wanted.items()))
    out = []
    for n, (how, share) in names.items():
        low = F.col(f"{n}_0")
        if how == BETWEEN:
            at = (F.col("total") - 1) * share
            low = low + (F.col(f"{n}_1") - low) * (at - F.floor(at))
        out.append((low if how == NEAREST else low.cast("double")).alias(n))
    return found.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=True)), *out) if by else found.select(*out)


__all__ = ["BETWEEN", "NEAREST", "quantiles"]
