"""Substring scoring, as the in-memory engine ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import normalize, normalized, occurrences, query_terms

#: Weight of a heading's matches, and of a whole phrase.
HEADING_WEIGHT, PHRASE_WEIGHT = 3, 1.25


def score(query: str, phrase_weight: float = PHRASE_WEIGHT, heading: Column | None = None, content: Column | None = None) -> Column:
    terms, phrase = query_terms(query), normalize(query)
    if not terms:
        return F.lit(0.0)
    heading = normalized(F.col("heading") if heading is None else heading)
    content = normalized(F.col("content_text") if content is None else content)

    def of(h: Column, c: Column) -> Column:
        total = F.lit(0)
        for t in terms:
            total = total + occurrences(c, t) + HEADING_WEIGHT * occurrences(h, t)
        return total + F.when(F.contains(c, F.lit(phrase)) | F.contains(h, F.lit(phrase)), F.lit(phrase_weight)).otherwise(0.0)

    # The normalised texts are computed once a row.
    return F.transform(F.array(F.struct(heading.alias("h"), content.alias("c"))), lambda x: of(x["h"], x["c"]))[0]


def scored(chunks: DataFrame, query: str, phrase_weight: float = PHRASE_WEIGHT) -> DataFrame:
    """chunks with a positive score. Only what has a term as it stands is normalised and counted."""
    may = reduce(lambda a, b: a | b, (F.contains(F.lower(c), F.lit(t)) for c in ("content_text", "heading") for t in query_terms(query)), F.lit(False))
    return chunks.where(may).withColumn("score", score(query, phrase_weight)).where("score > 0")


def order(collated: bool = True) -> list[Column]:
    """Best first, ties by chunk id, in locale or in binary order."""
    return [F.desc("score"), *([F.collate("chunk_id", "UNICODE")] if collated else []), F.col("chunk_id")]


def behind(score: float, chunk_id: str) -> Column:
    """Whether a row comes after a hit in the collated order."""
    mine, last = F.collate("chunk_id", "UNICODE"), F.collate(F.lit(chunk_id), "UNICODE")
    later = (mine > last) | ((mine == last) & (F.col("chunk_id") > chunk_id))
    return (F.col("score") < score) | ((F.col("score") == score) & later)
