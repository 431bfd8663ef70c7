"""Collapsing of variants: one hit for a section that several languages (or other facets) have."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .facets import facet


def _starred(place: Column):
    return lambda x: F.when(x["i"] == place, F.lit("*")).otherwise(x["p"])


def variant_key(keys: Sequence[str]) -> Column:
    """Path with the facets' segments as *, heading and part; null if a facet is empty or in no segment."""
    if not keys:
        return F.lit(None).cast("string")
    parts, changed, missing = F.split("filepath", "/"), F.lit(False), F.lit(False)
    for k in keys:
        place = F.array_position(parts, facet(k))
        missing = missing | (facet(k) == "")
        changed = changed | (place > 0)
        parts = F.transform(F.arrays_zip(parts.alias("p"), F.sequence(F.lit(1), F.size(parts)).alias("i")), _starred(place))
    part = F.regexp_extract("chunk_id", r"-part-(\d+)$", 1)
    key = F.concat(F.array_join(parts, "/"), F.lit(":"), F.col("heading"), F.when(part != "", F.concat(F.lit(":"), part)).otherwise(""))
    return F.when(changed & ~missing, key)


def collapsed(hits: DataFrame, keys: Sequence[str], filters: Mapping[str, str], order: Sequence[Column]) -> DataFrame:
    """First hit, in `order`, of each key; hits without one all stay. A facet that is filtered on doesn't collapse."""
    active = [k for k in keys if not filters.get(k)]
    if not active:
        return hits
    hits = hits.withColumn("variant", variant_key(active))
    lone = hits.where(F.col("variant").isNull())
    first = F.row_number().over(Window.partitionBy("variant").orderBy(*order))
    grouped = hits.where(F.col("variant").isNotNull()).withColumn("nth", first).where("nth = 1").drop("nth")
    return grouped.unionByName(lone).drop("variant")
