"""Ranked search: match, phrase and vector lists fused by reciprocal rank."""

from __future__ import annotations

import copy
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import clamp_limit, normalized, query_terms, snippet, tokenized
from scriptorium.session import written

from . import batched, collapse, cursor, lexical, quantised, vectors
from .facets import facet, matching
from .index import BLOCK_CHUNKS, FIELDS, K1, B, Index

#: The fusion's constant and the lists' weights; bounds of the phrase's slop.
RANK_CONSTANT, WEIGHTS, MOST_SLOP = 60, {"match": 1.0, "phrase": 1.25, "vector": 1.0}, 5
#: Rows beyond a page, times a page, and most rows of each list that take part in a fusion with a cap.
BEYOND, TIMES, MOST_CANDIDATES = 200, 5, 5000
#: Rows of a list that are ranked in one task; longer lists are ranked in ranges, with the same result.
ONE_TASK = 200_000
#: Rows of the vector list that an index of vectors gives, for one query and for each of many.
NEAREST, NEAREST_OF_MANY = MOST_CANDIDATES, 200
#: Blocks that the threshold of a search for the best few is taken from, for each block of rows wanted, and blocks up to which they are part of the plan.
FIRST_BLOCKS, LITERAL_BLOCKS = 4, 2000
#: Terms of a phrase, those with the fewest postings, that its candidates are found by.
RAREST = 3


@dataclass(frozen=True)
class Request:
    query: str
    filters: Mapping[str, str] = field(default_factory=dict)
    limit: int | None = None
    cursor: str | None = None
    taxonomy: Sequence[str] | None = None
    weights: Mapping[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Result:
    hits: list[dict]
    next_cursor: str | None
    hint: dict | None


def slop_of(slop: float | None) -> int:
    return max(0, min(MOST_SLOP, int(slop // 1))) if slop is not None else 0


def idf(df: Column, n: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def bm25(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column) -> Column:
    return idf(df, n) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / avgdl))


def _times(terms: Column, term: str) -> Column:
    return F.size(F.filter(terms, lambda x: x == term))


def _measures(terms: Sequence[str]) -> Column:
    """For each field its length and the occurrences of the terms; the fields are split once a row."""
    split = F.struct(*(tokenized(F.lower(f)).alias(f) for f in FIELDS))
    return F.transform(F.array(split), lambda x: F.struct(*(F.struct(F.size(x[f]).alias("dl"), F.array(*(_times(x[f], t) for t in terms)).alias("tf")).alias(f) for f in FIELDS)))[0]


# ------------------------------------------------------------------ over chunks, without an index
def match_scan(chunks: DataFrame, query: str, keep: Sequence[str] = ("chunk_id",)) -> DataFrame:
    """keep and BM25 `score` (9 decimals) of chunks that have a term of the query. Two passes over chunks, no shuffle of their terms."""
    terms = list(dict.fromkeys(query_terms(query)))
    if not terms:
        return chunks.select(*keep, F.lit(0.0).alias("score")).where(F.lit(False))
    pairs = [(f, i) for f in FIELDS for i in range(len(terms))]
    m = chunks.select(_measures(terms).alias("m"))
    stats = m.agg(F.count("*").alias("n"), *(F.avg(f"m.{f}.dl").alias(f"avgdl_{f}") for f in FIELDS), *(F.count_if(F.col(f"m.{f}.tf")[i] > 0).alias(f"df_{f}_{i}") for f, i in pairs))
    total: Column = F.lit(0.0)
    for f, i in pairs:
        tf = F.col(f"m.{f}.tf")[i]
        total = total + F.when(tf > 0, FIELDS[f] * bm25(tf, F.col(f"m.{f}.dl"), F.col(f"df_{f}_{i}"), F.col("n"), F.col(f"avgdl_{f}"))).otherwise(0.0)
    # A plain substring test comes first; only what passes it is split.
    may = reduce(lambda a, b: a | b, (F.contains(F.lower(f), F.lit(t)) for f in FIELDS for t in terms))
    has = reduce(lambda a, b: a | b, (F.exists(f"m.{f}.tf", lambda x: x > 0) for f in FIELDS))
    some = chunks.where(may).select(*keep, _measures(terms).alias("m")).where(has)
    return some.crossJoin(F.broadcast(stats)).select(*keep, F.round(total, 9).alias("score"))  # stats is one row


def phrase_count(terms: Column, phrase: Sequence[str], slop: int = 0) -> Column:
    """Places where the phrase begins: its terms in order with at most `slop` further terms between them."""
    wanted = F.array(*(F.lit(t) for t in phrase))
    k = len(phrase)

    def begins(x: Column, i: Column) -> Column:
        seen = F.aggregate(F.slice(terms, i + 1, F.lit(k + slop)), F.lit(0), lambda m, y: F.when((m < k) & (y == F.get(wanted, m)), m + 1).otherwise(m))
        return (x == phrase[0]) & (seen == k)

    return F.size(F.filter(terms, begins))


def phrase_scan(chunks: DataFrame, query: str, slop: int = 0, keep: Sequence[str] = ("chunk_id",)) -> DataFrame:
    """keep and occurrences `score` of chunks whose content has the query's terms as a phrase."""
    phrase = query_terms(query)
    if not phrase:
        return chunks.select(*keep, F.lit(0.0).alias("score")).where(F.lit(False))
    terms = tokenized(F.lower("content_text"))
    has = reduce(lambda a, b: a & b, (F.contains(F.lower("content_text"), F.lit(t)) for t in dict.fromkeys(phrase)))
    # The terms are split once a row.
    count = F.transform(F.array(terms), lambda ts: phrase_count(ts, phrase, slop_of(slop)))[0]
    return chunks.where(has).select(*keep, count.cast("double").alias("score")).where("score > 0")


def candidate_cap(offset: int, limit: int) -> int:
    """Rows of each list that take part in the fusion for a page, where they are capped."""
    return min(max(offset + limit + BEYOND, TIMES * limit), MOST_CANDIDATES)


def ranked(rows: DataFrame, name: str, limit: int | None = None, key: str = "chunk_id", best: Column | None = None, by: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """by, key and 1-based rank in a list, or in the lists of each value of `by`; with a limit only the first rows of one list are ranked.

    most: rows that are known to be there at most; up to ONE_TASK of them are ranked at once and
    nothing is written. Without a limit and such knowledge rows are dealt into ranges of the order, ranked within them, and the sizes of
    the ranges before are added: no task holds a whole list.
    """
    order = [F.desc("score") if best is None else best, F.col(key)]
    made = lambda df, rank: df.select(*by, key, rank.alias("rank"), F.lit(name).alias("list"))
    if limit:
        return made(rows.orderBy(*order).limit(limit), F.row_number().over(Window.orderBy(*order)))
    if most is not None and most <= ONE_TASK:
        return made(rows, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    rows = written(rows.select(*by, key, "score"), "list")
    n = rows.count()
    if n <= ONE_TASK:
        return made(rows, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    parts = -(-n // ONE_TASK) * 2
    placed = written(rows.repartitionByRange(parts, *by, *order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = placed.groupBy("part", *by).count()  # parts + lists rows at most
    before = sizes.withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    few = not by or before.limit(ONE_TASK + 1).count() <= ONE_TASK
    within = placed.withColumn("rank", F.row_number().over(Window.partitionBy("part", *by).orderBy(*order)))
    joined = within.join(F.broadcast(before) if few else before, ["part", *by])
    return made(joined, (F.col("rank") + F.col("before")).cast("int"))


def fused(lists: Sequence[DataFrame], weights: Mapping[str, float] | None = None, key: str = "chunk_id", by: Sequence[str] = ()) -> DataFrame:
    """by, key and `score`: the sum of w / (60 + rank) over the lists, 6 decimals. One shuffle for any number of lists."""
    weights = {**WEIGHTS, **(weights or {})}
    rows = reduce(DataFrame.unionByName, lists).groupBy(*by, key).agg(*(F.min(F.when(F.col("list") == name, F.col("rank"))).alias(name) for name in WEIGHTS))
    parts = [F.coalesce(F.lit(float(w)) / (RANK_CONSTANT + F.col(name)), F.lit(0.0)) if (w := weights[name]) > 0 else F.lit(0.0) for name in WEIGHTS]
    return rows.select(*by, key, F.round(parts[0] + parts[1] + parts[2], 6).alias("score"))


# ------------------------------------------------------------------ over an index
def most_hits(index: Index, queries: Sequence[str]) -> int:
    """Rows that all match lists of some queries can have: the postings of their terms."""
    terms = sorted({t for q in queries for t in query_terms(q)})
    found = index.table("terms").where(F.col("term").isin(terms)).groupBy("term").agg(F.sum("df").alias("df")).collect()  # a row for each term
    df = {r["term"]: r["df"] for r in found}
    return sum(df.get(t, 0) for q in queries for t in dict.fromkeys(query_terms(q)))


def match_index(index: Index, query: str, allowed: DataFrame | None, within: Column | None = None) -> DataFrame:
    """chunk_id and BM25 `score`; within: a condition on postings, which must take in or leave out a chunk's postings together."""
    terms = list(dict.fromkeys(query_terms(query)))
    rows = index.table("postings").where(F.col("term").isin(terms) & (F.lit(True) if within is None else within)).select("term", "field", "chunk_id", "tf", "dl")
    stats = index.table("terms").where(F.col("term").isin(terms)).join(F.broadcast(index.table("fields")), "field")  # a row for each term and field
    weight = F.create_map(*(F.lit(x) for kv in FIELDS.items() for x in kv))[F.col("field")]
    rows = rows.join(F.broadcast(stats), ["term", "field"])
    if allowed is not None:
        rows = rows.join(allowed, "chunk_id", "left_semi")
    return rows.groupBy("chunk_id").agg(F.round(F.sum(weight * bm25(F.col("tf"), F.col("dl"), F.col("df"), F.col("n"), F.col("avgdl"))), 9).alias("score"))


@dataclass(frozen=True)
class Pruned:
    """The best rows of a match list, and how many of the blocks with a term of the query they were looked for in."""

    rows: DataFrame
    blocks: int
    read: int


def match_best(index: Index, query: str, k: int, allowed: DataFrame | None = None) -> Pruned:
    """The k best chunks of the match list, ties by id, without scoring blocks that can't have one of them.

    A block's bound is the sum of what its terms can give at most. The k-th best score in the blocks
    with the greatest bounds is a threshold: only blocks whose bound reaches it can matter.
    """
    terms = list(dict.fromkeys(query_terms(query)))
    stats = index.table("terms").where(F.col("term").isin(terms)).join(F.broadcast(index.table("fields")), "field")  # a row for each term and field
    weight = F.create_map(*(F.lit(x) for kv in FIELDS.items() for x in kv))[F.col("field")]
    tops = index.impacts().where(F.col("term").isin(terms)).select("term", "field", "block", "top").join(F.broadcast(stats), ["term", "field"])
    bounds = written(tops.groupBy("block").agg(F.sum(weight * idf(F.col("df"), F.col("n")) * F.col("top")).alias("bound")), "bounds")
    blocks = bounds.count()
    best = lambda df: df.orderBy(F.desc("score"), "chunk_id").limit(k)
    first = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(FIRST_BLOCKS * (1 + k // BLOCK_CHUNKS)).collect()]
    seen = best(match_index(index, query, allowed, F.col("block").isin(first))).agg(F.min("score").alias("score"), F.count("*").alias("n")).first()
    if seen["n"] < k:
        return Pruned(best(match_index(index, query, allowed)), blocks, blocks)
    may = bounds.where(F.col("bound") >= seen["score"] - 1e-6 * (1 + abs(seen["score"])))  # sums in another order differ by less
    ids = [r["block"] for r in may.select("block").limit(LITERAL_BLOCKS + 1).collect()]
    if len(ids) <= LITERAL_BLOCKS:
        return Pruned(best(match_index(index, query, allowed, F.col("block").isin(ids))), blocks, len(ids))
    return Pruned(best(match_index(index, query, allowed)), blocks, blocks)


def phrase_index(index: Index, query: str, slop: int, allowed: DataFrame | None) -> DataFrame:
    phrase = query_terms(query) or [""]  # no posting has an empty term
    rows = index.table("postings").where((F.col("field") == "content_text") & F.col("term").isin(phrase))
    if allowed is not None:
        rows = rows.join(allowed, "chunk_id", "left_semi")
    # The terms of a chunk at their places, put together again from the positions.
    placed = rows.groupBy("chunk_id").agg(F.count("*").alias("n"), F.array_sort(F.flatten(F.collect_list(F.transform("positions", lambda p: F.struct(p.alias("pos"), F.col("term").alias("term")))))).alias("at")).where(F.col("n") == len(set(phrase)))
    return placed.select("chunk_id", _placed_count(F.col("at"), F.array(*(F.lit(t) for t in phrase)), slop_of(slop)).alias("score")).where("score > 0")


def _placed_count(at: Column, phrase: Column, slop: int) -> Column:
    """Places where the phrase begins among terms at positions, as phrase_count."""
    k = F.size(phrase)

    def begins(x: Column, i: Column) -> Column:
        ahead = F.slice(at, i + 1, k + F.lit(slop))
        seen = F.aggregate(ahead, F.lit(0), lambda m, y: F.when((m < k) & (y["pos"] - x["pos"] < k + slop) & (y["term"] == F.get(phrase, m)), m + 1).otherwise(m))
        return (x["term"] == phrase[0]) & (seen == k)

    return F.size(F.filter(at, begins)).cast("double")


# ------------------------------------------------------------------ many queries over an index in one job
def match_many(index: Index, terms: DataFrame) -> DataFrame:
    """query_id, chunk_id and BM25 `score` for all terms (query_id, term) of many queries."""
    stats = index.table("terms").join(F.broadcast(index.table("fields")), "field")  # fields has a row for each field
    stats = batched.few(terms.join(stats, "term"))
    rows = index.table("postings").select("term", "field", "chunk_id", "tf", "dl").join(stats, ["term", "field"])
    weight = F.create_map(*(F.lit(x) for kv in FIELDS.items() for x in kv))[F.col("field")]
    return rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum(weight * bm25(F.col("tf"), F.col("dl"), F.col("df"), F.col("n"), F.col("avgdl"))), 9).alias("score"))


def phrase_many(index: Index, phrases: DataFrame, slop: int = 0, allowed: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id and occurrences `score` for the phrases (query_id, phrase) of many queries.

    The chunks that have a phrase's RAREST terms with the fewest postings are found first, so that
    those of common terms are read for these alone.
    """
    terms = phrases.select("query_id", F.explode(F.array_distinct("phrase")).alias("term"), F.size(F.array_distinct("phrase")).alias("wanted"))
    df = index.table("terms").where(F.col("field") == "content_text").select("term", "df")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("df", F.lit(0)), "term"))
    terms = written(terms.join(df, "term", "left").withColumn("nth", nth).drop("df"), "terms")
    content = index.table("postings").where(F.col("field") == "content_text").select("term", "chunk_id", "positions")
    content = content.join(allowed.select("chunk_id"), "chunk_id", "left_semi") if allowed is not None else content
    rare = content.drop("positions").join(batched.few(terms.where(F.col("nth") <= RAREST)), "term")
    may = rare.groupBy("query_id", "chunk_id").agg(F.count("*").alias("n"), F.first("wanted").alias("wanted")).where(F.col("n") == F.least("wanted", F.lit(RAREST)))
    may = written(may.select("query_id", "chunk_id").join(batched.few(terms), "query_id"), "candidates")  # a row for each term
    rows = content.join(batched.few(may), ["term", "chunk_id"])
    at = F.array_sort(F.flatten(F.collect_list(F.transform("positions", lambda p: F.struct(p.alias("pos"), F.col("term").alias("term"))))))
    placed = rows.groupBy("query_id", "chunk_id").agg(F.count("*").alias("n"), F.first("wanted").alias("wanted"), at.alias("at")).where("n = wanted")
    return placed.join(batched.few(phrases), "query_id").select("query_id", "chunk_id", _placed_count(F.col("at"), F.col("phrase"), slop_of(slop)).alias("score")).where("score > 0")


def near_many(index: Index, queries: DataFrame, k: int = NEAREST_OF_MANY, allowed: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """query_id, chunk_id and distance `score` of the nearest chunks of each of queries (query_id, vector).

    By the index of vectors with its usual probes; exact: the nearest of all, none missed.
    """
    if (near := index.near()) is not None:
        cells, sizes, model = near
        return quantised.nearest_many(cells, sizes, model, queries, k, allowed=allowed, exact=exact).select("query_id", "chunk_id", F.col("distance").alias("score"))
    rows = index.table("chunks").where(F.col("vector").isNotNull()).select("chunk_id", "vector")
    rows = rows.join(allowed, "chunk_id", "left_semi") if allowed is not None else rows
    few = F.broadcast(rows.select("chunk_id", F.col("vector").cast("array<double>").alias("there")).limit(quantised.LEAST))  # without an index there are fewer
    square = F.zip_with(F.col("vector").cast("array<double>"), "there", lambda a, b: (a - b) * (a - b))
    return queries.join(few, F.size("vector") == F.size("there")).select("query_id", "chunk_id", F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x)).alias("score"))


def near_all(index: Index, queries: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id and distance `score` of every chunk with a vector, for each of queries (query_id, vector)."""
    rows = index.table("chunks").where(quantised.usable("vector")).select("chunk_id", F.col("vector").cast("array<double>").alias("there"))
    rows = rows.join(allowed, "chunk_id", "left_semi") if allowed is not None else rows
    square = F.zip_with(F.col("vector").cast("array<double>"), "there", lambda a, b: (a - b) * (a - b))
    pairs = rows.crossJoin(batched.few(queries.where(quantised.usable("vector")))).where(F.size("vector") == F.size("there"))
    return pairs.select("query_id", "chunk_id", F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x)).alias("score"))


def depths(limit: int, weights: Mapping[str, float]) -> tuple[int, int] | None:
    """Ranks of the match and of the phrase list, beyond which in both a row of no third list can't be among the best `limit`; None where there are no such.

    If the match list has `limit` rows, that many have the part of its rank `limit` at least; what is
    beyond has less in both parts together, also when they are rounded. If it has fewer, all are within.
    """
    match, phrase = float(weights["match"]), max(0.0, float(weights["phrase"]))
    deep = 2 * limit + 10
    room = match * (1 / (RANK_CONSTANT + limit) - 1 / (RANK_CONSTANT + deep + 1)) - 4e-6
    if match <= 0 or room <= 0 or (most := int(phrase / room) + 1) > MOST_CANDIDATES:
        return None
    return deep, most


def depths_with_vectors(limit: int, weights: Mapping[str, float]) -> tuple[int, int, int] | None:
    """As `depths`, with a rank of the vector list too: a row beyond all three can't be among the best `limit`."""
    w = float(weights["vector"])
    phrase, near = (depths(limit, {"match": weights["match"], "phrase": 2 * max(0.0, float(weights[x]))}) for x in ("phrase", "vector"))  # half of what is left for each
    if phrase is None or near is None:
        return None
    deep = max(near)
    # Where fewer match, the vector list's own first rows are ahead.
    return (*phrase, deep) if w * (1 / (RANK_CONSTANT + limit) - 1 / (RANK_CONSTANT + deep + 1)) > 4e-6 else None


def search_many(index: Index, queries: DataFrame, limit: int | None = None, slop: int = 0, weights: Mapping[str, float] | None = None, provider: vectors.Provider | None = None, filters: Mapping[str, str] | None = None, taxonomy: Sequence[str] | None = None, exact: bool = False) -> DataFrame:
    """query_id, rank, chunk_id and score of the best hits of each row of queries (query_id, query): match, phrase and, with a provider, vector lists fused.

    All queries read the chunks together; the filters are those of all queries. The match and phrase lists take part whole:
    a row that can be among the best (`depths`) has its exact rank in both, however far down. The vector list has the
    NEAREST_OF_MANY nearest of each query; exact: it is whole too, with a row for each query and vector.
    """
    asked = written(queries.select("query_id", tokenized(normalized(F.col("query"))).alias("phrase"), "query").where(F.size("phrase") > 0), "queries")
    wanted = matching(filters, taxonomy) if filters else F.lit(True)
    allowed = index.table("heads").where(wanted).select("chunk_id") if filters else None
    most, weighted = clamp_limit(limit), {**WEIGHTS, **(weights or {})}
    bounds: tuple[int, ...] | None = depths(most, weighted)
    near = None
    if provider is not None and provider.dimensions and "vector" in index.table("chunks").columns:
        there = vectors.embedded(asked, "query", provider).select("query_id", "vector")
        found = near_all(index, there, allowed) if exact else near_many(index, there, allowed=allowed)
        near = written(ranked(found, "vector", best=F.asc("score"), by=["query_id"]), "near")
        bounds = depths_with_vectors(most, weighted) if exact else bounds
    if bounds is None:
        match = match_many(index, asked.select("query_id", F.explode(F.array_distinct("phrase")).alias("term")))
        match = match.join(allowed, "chunk_id", "left_semi") if allowed is not None else match
        lists = [ranked(match, "match", by=["query_id"]), ranked(phrase_many(index, asked.select("query_id", "phrase"), slop, allowed), "phrase", by=["query_id"])]
    else:
        named = None if near is None else near.where(F.col("rank") <= bounds[2]) if exact else near
        lists = [batched.list_ranks(index, asked, *bounds[:2], slop_of(slop), named, lambda rows: rows.where(wanted))]
        if exact and near is not None:  # of the whole list, what can be among the best
            may = written(lists[0].unionByName(named).select("query_id", "chunk_id").distinct(), "named")
            near = near.join(may, ["query_id", "chunk_id"], "left_semi")
    scores = fused([*lists, near] if near is not None else lists, weights, by=["query_id"])
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select("query_id", "rank", "chunk_id", "score")


class Engine:
    """Search and retrieval over a published index. Lists are fused whole; capped: at most candidate_cap rows of each.

    The vector list has the NEAREST nearest chunks by the index of vectors; exact: all chunks by their exact distance.
    seek: cursors name the last hit and the index's version in place of an offset: the next page goes on behind that
    hit, in that version, also when another was published meanwhile, and nothing before it is sorted again.
    """

    def __init__(self, index: Index, collapse_keys: Sequence[str] = (), slop: int = 0, weights: Mapping[str, float] | None = None, provider: vectors.Provider | None = None, capped: bool = False, exact: bool = False, seek: bool = False):
        self.index, self.collapse_keys, self.slop, self.weights, self.provider, self.capped, self.exact, self.seek = index, list(collapse_keys), slop, dict(weights or {}), provider, capped, exact, seek
        self.warnings: list[str] = []

    @property
    def chunks(self) -> DataFrame:
        return self.index.table("chunks")

    @property
    def heads(self) -> DataFrame:
        """Chunks without their texts and vectors."""
        return self.index.table("heads")

    def hits(self, request: Request) -> DataFrame:
        """All hits with their scores, collapsed; no texts are read."""
        allowed = self.heads.where(matching(request.filters, request.taxonomy)).select("chunk_id") if request.filters else None
        cap = None
        if self.capped and not self.seek:
            offset = cursor.decode_search(request.cursor, request.query.strip(), request.filters) if request.cursor else 0
            cap = candidate_cap(offset, clamp_limit(request.limit))
        most = most_hits(self.index, [request.query]) if cap is None else None
        if cap is not None and hasattr(self.index, "impacts"):
            match = match_best(self.index, request.query, cap, allowed).rows
        else:
            match = match_index(self.index, request.query, allowed)
        lists = [ranked(match, "match", cap, most=most), ranked(phrase_index(self.index, request.query, self.slop, allowed), "phrase", cap, most=most)]
        if (near := self._near(request, allowed, cap)) is not None:
            lists.append(near)
        scores = fused(lists, {**self.weights, **request.weights})
        rows = self.heads.join(scores, "chunk_id")
        return collapse.collapsed(rows, self.collapse_keys, request.filters, [F.desc("score"), F.collate("chunk_id", "UNICODE")])

    def _near(self, request: Request, allowed: DataFrame | None, cap: int | None) -> DataFrame | None:
        """The vector list; without a provider, or if it fails, there is none."""
        if self.provider is None or not self.provider.dimensions or "vector" not in self.chunks.columns:
            return None
        try:
            query = self.provider.embed([request.query])[0]
        except Exception as e:
            if not self.warnings:
                self.warnings.append(f"Vector search failed, lexical results only: {e}")
            return None
        if not self.exact and (near := self.index.near()) is not None and len(query) == near[2].dimensions:
            k = cap or NEAREST
            found = quantised.nearest(near[0], near[2], query, k, allowed=allowed).select("chunk_id", F.col("distance").alias("score"))
            return ranked(found, "vector", best=F.asc("score"), most=k)
        rows = self.chunks.where(F.col("vector").isNotNull())
        rows = rows.join(allowed, "chunk_id", "left_semi") if allowed is not None else rows
        return ranked(rows.select("chunk_id", vectors.distance(F.col("vector"), query).alias("score")), "vector", cap, best=F.asc("score"))

    def search(self, request: Request) -> Result:
        engine, after = self, None
        if self.seek and request.cursor:
            score, chunk_id, version = cursor.decode_seek(request.cursor, request.query.strip(), request.filters)
            after = (score, chunk_id)
            if version != self.index.version:
                engine = copy.copy(self)
                try:
                    engine.index = self.index.at(version)
                except LookupError as e:
                    raise cursor.BadCursor("The cursor's version of the index is gone") from e
        i = engine.index
        return page(engine.hits(request), i.table("chunks"), request, lambda q: match_index(i, q, None).select("chunk_id"), i.chunks_of, i.version if self.seek else None, after)


class ScanEngine:
    """Substring search straight over chunks."""

    def __init__(self, chunks: DataFrame, collapse_keys: Sequence[str] = (), phrase_weight: float = lexical.PHRASE_WEIGHT):
        self.chunks, self.collapse_keys, self.phrase_weight = chunks, list(collapse_keys), phrase_weight

    def hits(self, request: Request) -> DataFrame:
        weight = request.weights.get("phrase", self.phrase_weight)
        rows = lexical.scored(self.chunks.where(matching(request.filters, request.taxonomy)), request.query, weight)
        return collapse.collapsed(rows, self.collapse_keys, request.filters, lexical.order())

    def search(self, request: Request) -> Result:
        return page(self.hits(request), self.chunks, request, lambda q: lexical.scored(self.chunks, q, 0.0).select("chunk_id"))


def page(hits: DataFrame, chunks: DataFrame, request: Request, unfiltered: Callable[[str], DataFrame], of_files: Callable[[Sequence[str]], DataFrame] | None = None, version: str | None = None, after: tuple[float, str] | None = None) -> Result:
    """One page of hits; at most limit + 1 rows come to the driver. of_files: a quicker way to the chunks of some files.

    With a version cursors name the last hit; `after` is that of the page before.
    """
    query = request.query.strip()
    if not query:
        raise ValueError("query is required")
    limit = clamp_limit(request.limit)
    offset = cursor.decode_search(request.cursor, query, request.filters) if request.cursor and version is None else 0
    if after is not None:
        hits = hits.where(lexical.behind(*after))
    rows = hits.orderBy(*lexical.order())
    rows = (rows.offset(offset) if offset else rows).limit(limit + 1)
    found = [r.asDict() for r in rows.select("chunk_id", "heading", "breadcrumb", "filepath", F.map_filter("metadata", lambda k, v: v != "").alias("metadata"), F.round("score", 6).alias("score"), F.col("score").alias("exact")).collect()]
    more = len(found) > limit
    shown = found[:limit]
    last = shown[-1]["exact"] if shown else 0.0
    for r in shown:
        del r["exact"]
    if shown:  # only their texts are read
        paths = sorted({r["filepath"] for r in shown})
        mine = of_files(paths) if of_files else chunks.where(F.col("filepath").isin(paths))
        mine = mine.where(F.col("chunk_id").isin([r["chunk_id"] for r in shown]))
        texts = {r["chunk_id"]: r["snippet"] for r in mine.select("chunk_id", snippet(F.col("content_text"), query).alias("snippet")).collect()}
        for r in shown:
            r["snippet"] = texts[r["chunk_id"]]
    following = None
    if more:
        following = cursor.encode_search(offset + limit, limit, query, request.filters) if version is None else cursor.encode_seek(last, shown[-1]["chunk_id"], version, query, request.filters)
    return Result(shown, following, None if found or after else hint(chunks, unfiltered(query), query, request.filters))


# ------------------------------------------------------------------ hints
def suggestions(chunks: DataFrame, matches: DataFrame, filters: Mapping[str, str]) -> DataFrame:
    """key and other values, sorted, that the unfiltered matches have for each filter."""
    rows = chunks.join(matches, "chunk_id", "left_semi")
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), facet(k).alias("value"), F.lit(v).alias("active")) for k, v in filters.items())))
    return rows.select(pairs.alias("p")).select("p.*").where((F.col("value") != "") & (F.col("value") != F.col("active"))).groupBy("key").agg(F.array_sort(F.collect_set("value")).alias("values"))


#: The messages are fixed values.
def hint(chunks: DataFrame, matches: DataFrame, query: str, filters: Mapping[str, str]) -> dict:
    if not matches.limit(1).count():
        return {"message": "0 results found. No matches were found for this query in the indexed corpus.", "suggested_filters": {}}
    found = {r["key"]: list(r["values"]) for r in suggestions(chunks, matches, filters).collect()} if filters else {}
    said = ", ".join(f"{k}='{v}'" for k, v in filters.items())
    return {"message": f"0 results found for query '{query}'{f' with filters {said}' if said else ''}.", "suggested_filters": found}



__all__ = ["Engine", "Request", "Result", "ScanEngine", "bm25", "fused", "hint", "candidate_cap", "match_best", "match_index", "match_many", "match_scan", "most_hits", "near_all", "near_many", "page", "phrase_count", "phrase_index", "phrase_many", "phrase_scan", "ranked", "search_many", "slop_of", "suggestions"]
