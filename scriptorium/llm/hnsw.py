"""Approximate nearest neighbours by inner product: one navigable small-world graph a shard.

Equal vectors form a class that enters the graphs once, with its smallest ids;
classes are dealt to shards of about SHARD_ROWS by hash. Each shard's graph is
built once and stored as flat arrays (vectors, and for every level the nodes and
a padded neighbour matrix). Queries go to every shard in blocks, and the shards'
results are merged. One more coordinate gives all vectors of a shard the same
norm, so that the largest inner product is the smallest distance and the graph
is metric.

Edge cases: rows whose id or vector is null, whose vector is empty, zero or has a
null or non-finite component take no part; vectors are only compared with those
of their own length; rows equal in id and vector count once; of several vectors under one id
each is a candidate and the smallest is the query; fewer candidates
than k give fewer rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, table, tidy, written

SHARD_ROWS, LINKS, BREADTH_BUILD, BREADTH_SEARCH, BLOCK_ROWS = 16_384, 16, 80, 120, 1024


# ------------------------------------------------------------------ the graph
def beam(vecs: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, breadth: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries in step; ids (-1: none) and products, best first."""
    q, n = len(queries), len(vecs)
    breadth = min(breadth, n)
    ids = np.full((q, breadth), -1, np.int64)
    score = np.full((q, breadth), -np.inf)
    done = np.zeros((q, breadth), bool)
    seen = np.zeros((q, n), bool)
    ids[:, 0], score[:, 0] = entry, np.einsum("qd,qd->q", vecs[entry], queries)
    seen[np.arange(q), entry] = True
    while True:
        open_score = np.where(done | (ids < 0), -np.inf, score)
        at = open_score.argmax(1)
        live = np.flatnonzero(open_score[np.arange(q), at] > -np.inf)
        if not len(live):
            break
        done[live, at[live]] = True
        near = links[ids[live, at[live]]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        rows, cols = np.nonzero(fresh)
        if not len(rows):
            continue
        new = near[rows, cols]
        seen[live[rows], new] = True
        got = np.full(near.shape, -np.inf)
        got[rows, cols] = np.einsum("ed,ed->e", vecs[new], queries[live[rows]])
        some = fresh.any(1)
        live, near, got = live[some], near[some], got[some]
        all_score = np.concatenate([score[live], got], 1)
        keep = np.argpartition(-all_score, breadth - 1, axis=1)[:, :breadth]
        score[live] = np.take_along_axis(all_score, keep, 1)
        kept = np.take_along_axis(np.concatenate([ids[live], np.where(got > -np.inf, near, -1)], 1), keep, 1)
        ids[live] = np.where(score[live] > -np.inf, kept, -1)
        done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros(near.shape, bool)], 1), keep, 1)
    order = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)


def diverse(vecs: np.ndarray, base: np.ndarray, cands: np.ndarray, m: int) -> np.ndarray:
    """For each base node up to m of its candidates (-1: none): near ones that are not nearer to one already taken, then the rest by nearness."""
    b, w = cands.shape
    valid = cands >= 0
    own = np.where(valid, np.einsum("bwd,bd->bw", vecs[cands], vecs[base]), -np.inf)
    out = np.full((b, m), -1, np.int64)
    free, spare = valid.copy(), np.zeros((b, w), bool)
    rows = np.arange(b)
    for k in range(m):
        first = np.where(free, own, -np.inf)
        later = np.where(spare, own, -np.inf)
        use = np.where(free.any(1, keepdims=True), first, later)
        at = use.argmax(1)
        ok = use[rows, at] > -np.inf
        if not ok.any():
            break
        pick = cands[rows, at]
        out[ok, k] = pick[ok]
        free[rows, at] = spare[rows, at] = False
        close = np.einsum("bwd,bd->bw", vecs[cands], vecs[pick]) > own
        moved = free & close & ok[:, None]
        spare |= moved
        free &= ~moved
    return out


def build_level(vecs: np.ndarray, entry: np.ndarray, m: int, breadth: int) -> np.ndarray:
    """Neighbour matrix (2m wide) of one level; nodes are inserted in order, some at a time."""
    n, width = len(vecs), 2 * m
    links = np.full((n, width), -1, np.int64)
    if n <= width + 1:  # small enough to link every node with every other
        for i in range(n):
            links[i, : n - 1] = [j for j in range(n) if j != i]
        return links
    start = width + 1
    for i in range(start):
        links[i] = [j for j in range(start) if j != i]
    at = start
    while at < n:
        new = np.arange(at, min(n, at + min(128, max(8, at // 4))))
        first = np.where(entry[new] < at, entry[new], 0)
        found, _ = beam(vecs[:at], links[:at], vecs[new], first, breadth)
        # nodes inserted together may be neighbours too
        among = vecs[new] @ vecs[new].T
        np.fill_diagonal(among, -np.inf)
        near = np.argsort(-among, axis=1)[:, : min(m, len(new) - 1)]
        links[new, :m] = diverse(vecs, new, np.concatenate([found, new[near]], 1), m)
        src, col = np.nonzero(links[new, :m] >= 0)
        to, who = links[new[src], col], new[src]
        order = np.argsort(to, kind="stable")
        to, who = to[order], who[order]
        nodes, begin, count = np.unique(to, return_index=True, return_counts=True)
        extra = np.full((len(nodes), count.max()), -1, np.int64)
        inside = np.arange(len(to)) - np.repeat(begin, count)
        extra[np.repeat(np.arange(len(nodes)), count), inside] = who
        extra[(extra[:, :, None] == links[nodes][:, None, :]).any(2)] = -1
        wide = np.concatenate([links[nodes], extra], 1)
        wide = np.take_along_axis(wide, np.argsort(wide < 0, axis=1, kind="stable"), 1)
        fits = (wide[:, width:] < 0).all(1)
        links[nodes[fits]] = wide[fits, :width]
        if not fits.all():
            links[nodes[~fits]] = diverse(vecs, nodes[~fits], wide[~fits], width)
        at = int(new[-1]) + 1
    return links


def build(raw: np.ndarray, ids: np.ndarray, m: int = LINKS, breadth: int = BREADTH_BUILD) -> dict:
    """Flat arrays of a graph over raw (n x d)."""
    n = len(raw)
    norm2 = np.einsum("nd,nd->n", raw, raw)
    vecs = np.concatenate([raw, np.sqrt(np.maximum(0, norm2.max() - norm2))[:, None]], 1)
    u = np.random.default_rng(17).random(n)
    level = np.floor(-np.log(np.maximum(u, 1e-300)) / np.log(m)).astype(int)
    nodes, links = [], []
    for lv in range(level.max(), -1, -1):
        own = np.flatnonzero(level >= lv)
        entry = descend(vecs, nodes, links, vecs[own]) if nodes else np.zeros(len(own), int)
        place = np.full(n, n, int)
        place[own] = np.arange(len(own))
        links.append(build_level(vecs[own], place[entry], m, breadth).astype(np.int32))
        nodes.append(own.astype(np.int32))
    return {"vecs": vecs, "nodes": nodes, "links": links, "ids": ids}


def descend(vecs: np.ndarray, nodes: list, links: list, queries: np.ndarray) -> np.ndarray:
    """The node nearest to each query, greedily through the given levels from the top."""
    at = np.zeros(len(queries), int) + int(nodes[0][0])
    for own, near in zip(nodes, links, strict=True):
        place = np.searchsorted(own, at)
        found, _ = beam(vecs[own], near, queries, place, 4)
        at = own[found[:, 0]].astype(int)
    return at


def search(graph: dict, queries: np.ndarray, k: int, breadth: int = BREADTH_SEARCH) -> tuple[np.ndarray, np.ndarray]:
    vecs, nodes, links = graph["vecs"], graph["nodes"], graph["links"]
    asked = np.concatenate([queries, np.zeros((len(queries), 1))], 1)
    entry = descend(vecs, nodes[:-1], links[:-1], asked) if len(nodes) > 1 else np.zeros(len(asked), int)
    found, _ = beam(vecs, links[-1], asked, entry, max(breadth, k))
    return found[:, :k], np.where(found[:, :k] >= 0, np.einsum("qkd,qd->qk", vecs[found[:, :k], :-1], queries), -np.inf)


# ------------------------------------------------------------------ Spark
def usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def classes(vectors: DataFrame, keep: int) -> DataFrame:
    """One row for each distinct vector: class_id (its smallest id), embedding, ids (the `keep` smallest).

    Ids are cut to the smallest `keep` in every batch and again for each salt, so
    that a vector that a third of all rows share is never gathered in one task.
    """

    @tidy
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            keys = pd.Series([np.asarray(v, np.float64).tobytes() for v in b["embedding"]], index=b.index)
            ids = b["vec_id"].groupby(keys, sort=False).agg(lambda s: sorted(set(s))[:keep])
            yield pd.DataFrame({"vec": ids.index, "ids": ids.to_numpy()})

    part = vectors.mapInPandas(cut, "vec binary, ids array<bigint>").withColumn("salt", F.spark_partition_id() % 64)
    less = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, keep)
    part = part.groupBy("vec", "salt").agg(less("ids").alias("ids"))
    return part.groupBy("vec").agg(less("ids").alias("ids")).select(F.col("ids")[0].alias("class_id"), "vec", "ids")


def nearest(vectors: DataFrame, asked: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k rows of vectors (vec_id, embedding) nearest to each row of asked, other than itself.

    Columns: query_id, rank, vec_id, score.
    """
    lean(vectors.sparkSession)  # a row with a graph is a batch of its own
    ok = lambda df: df.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    known = written(classes(ok(vectors), k + 1), "vectors")
    shards = max(1, -(-known.count() // shard_rows))
    dealt = known.select("class_id", "vec", F.length("vec").alias("bytes"), F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int").alias("shard"))

    def make(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("class_id")
        g = build(np.stack([np.frombuffer(v) for v in rows["vec"]]), rows["class_id"].to_numpy(np.int64))
        flat = lambda xs: [x.tobytes() for x in xs]
        return pd.DataFrame({"shard": [int(key[0])], "bytes": [int(key[1])], "vecs": [g["vecs"].tobytes()], "ids": [g["ids"].tobytes()], "nodes": [flat(g["nodes"])], "links": [flat(g["links"])]})

    graphs = written(dealt.groupBy("shard", "bytes").applyInPandas(make, "shard int, bytes int, vecs binary, ids binary, nodes array<binary>, links array<binary>"), "graphs")

    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        qs = np.stack([np.asarray(v, np.float64) for v in rows["embedding"]])
        return pd.DataFrame({"bytes": [int(key[0])], "q_ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "qs": [qs.tobytes()]})

    # Full blocks, however few queries a partition has: every block meets every graph.
    sought = written(ok(asked).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "asked")
    n_blocks = max(1, -(-sought.count() // BLOCK_ROWS))
    numbered = sought.withColumn("bytes", 8 * F.size("embedding")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)))
    blocks = numbered.groupBy("bytes", "block").applyInPandas(block, "bytes int, q_ids binary, qs binary")
    pairs = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(graphs, ["shard", "bytes"])

    @tidy
    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                d = r.bytes // 8
                qs, q_ids, ids = np.frombuffer(r.qs).reshape(-1, d), np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.ids, np.int64)
                nodes = [np.frombuffer(x, np.int32) for x in r.nodes]
                links = [np.frombuffer(x, np.int32).reshape(len(o), -1) for x, o in zip(r.links, nodes, strict=True)]
                graph = {"vecs": np.frombuffer(r.vecs).reshape(-1, d + 1), "nodes": nodes, "links": links}
                for i in range(0, len(qs), 256):
                    found, score = search(graph, qs[i : i + 256], k + 1)
                    row, col = np.nonzero(found >= 0)
                    yield pd.DataFrame({"query_id": q_ids[i : i + 256][row], "class_id": ids[found[row, col]], "score": score[row, col]})

    found = pairs.mapInPandas(look, "query_id long, class_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "class_id")
    found = found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1).drop("at")
    rows = found.join(known.select("class_id", "ids"), "class_id").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)
