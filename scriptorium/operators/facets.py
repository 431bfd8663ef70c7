"""Facet predicates over chunks with a `metadata` map."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The facets with a rule of their own, and the scopes it knows.
LANGUAGE, SCOPE = "language", "scope"
SDK_SCOPE, GUIDE_SCOPE = "sdk-specific", "global-guide"


class UnknownValue(ValueError):
    """A filter value that the taxonomy doesn't have."""


def facet(key: str) -> Column:
    """A facet's value, '' where it is missing: comparisons with it are never null."""
    return F.coalesce(F.col("metadata")[key], F.lit(""))


def equal(filters: Mapping[str, str]) -> Column:
    return reduce(lambda a, b: a & b, (facet(k) == v for k, v in filters.items()), F.lit(True))


def matching(filters: Mapping[str, str], taxonomy: Sequence[str] | None = None) -> Column:
    """Conjunction of the filters. A language without a scope takes in shared guides and what names no other language."""
    language, scope = filters.get(LANGUAGE), filters.get(SCOPE)
    known = taxonomy is None or (LANGUAGE in taxonomy and SCOPE in taxonomy)
    if not (language and not scope and known):
        return equal({k: v for k, v in filters.items() if v or k not in (LANGUAGE, SCOPE)})
    own = facet(LANGUAGE) == language
    by_scope = F.when(facet(SCOPE) == SDK_SCOPE, own).when(facet(SCOPE) == GUIDE_SCOPE, F.lit(True)).otherwise(own | (facet(LANGUAGE) == ""))
    return by_scope & equal({k: v for k, v in filters.items() if k not in (LANGUAGE, SCOPE)})


def validate(filters: Mapping[str, str], taxonomy: Mapping[str, Sequence[str]]) -> None:
    for k, v in filters.items():
        if k not in taxonomy:
            raise UnknownValue(f"Unknown filter '{k}'.")
        if v not in taxonomy[k]:
            raise UnknownValue(f"Invalid value '{v}' for filter '{k}'. Allowed: {', '.join(taxonomy[k])}")


def file_list(chunks: DataFrame, filters: Mapping[str, str]) -> DataFrame:
    """First chunk of each file under plain equality, in locale order."""
    return chunks.where(equal(filters) & (F.col("chunk_index") == 0)).select("filepath", "chunk_id").orderBy(F.collate("filepath", "UNICODE"))
