"""Near-duplicate documents by BagMinHash.

A text is the multiset of its five-word shingles. Every shingle has a Poisson
process of points on (time, weight): the dyadic cells [0,1), [1,2), [2,4) ... of
the discretised weight axis have independent processes, the bits of a point's hash
say where in its cell it lies, and it counts if that is below the shingle's
multiplicity. Each point falls into one of REGISTERS registers, which keeps the
earliest time; two texts agree in a register with a probability equal to their
weighted Jaccard similarity. Points are made in ascending time up to a bound by
which nearly all registers are filled, and further for the texts where some aren't.

BANDS bands of ROWS registers give buckets. Texts with one bag of shingles are one
node. In a bucket every node is compared with a pivot, another order choosing the
pivot of each band; pairs of at least THRESHOLD, by the exact similarity of their
bags, are linked and connected. The members of buckets that still hold several
components go through an exact prefix-filter join, so that no link between components
is lost to the choice of pivots. There each member of the smaller component is compared
with the centre of the larger; as 1 - similarity is a metric, only members of the
larger at least as far from their centre as that result leaves room for can be linked
to it, and only those are compared. No group is expanded into all its pairs.

Edge cases: texts of one to four words have one shingle of them all; texts without
words form a class only with rows of equal text (null: with null); rows with equal
doc_id count as one document (doc_id names a text); a null doc_id is replaced by a
hash of the text; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, number, table, tidy, written

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 36, 7
REGISTERS = BANDS * ROWS
#: Ids (8 bytes each) up to which a set is broadcast.
BROADCAST_IDS = 2_000_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_CHARS = 1_000_000
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (fixed constants of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Bags:
    """Shingle multisets of texts."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Sorted shingle hashes and their multiplicities."""
        ws = _WORD.findall(text.lower()) if text else []
        if not ws:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(self.words) > 500_000:
            self.words.clear()
        get, new = self.words.get, xxhash.xxh3_64_intdigest
        h = [get(w) for w in ws]
        if None in h:
            for i, w in enumerate(ws):
                if h[i] is None:
                    h[i] = self.words[w] = new(w.encode())
        a = np.array(h, np.uint64)
        n = max(1, len(a) - SHINGLE + 1)
        s = np.zeros(n, np.uint64)
        for k in range(min(SHINGLE, len(a))):
            s = _mix(s * _U(0x9E3779B97F4A7C15) + a[k : k + n])
        return np.unique(s, return_counts=True)


def signatures(hashes: np.ndarray, counts: np.ndarray, doc: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """Earliest times (n x registers) of n bags given as flat arrays; doc: the bag of each shingle. Empty bags stay infinite."""
    total = np.bincount(doc, counts, n)
    sig = np.full((n, registers), np.inf)
    want, reach = np.flatnonzero(total > 0), np.log(registers) + 3.0
    seed, start, rate, weight, of = [_mix(hashes)], [np.zeros(len(hashes))], [np.ones(len(hashes))], [counts], [doc]
    cell = 1
    while (more := np.flatnonzero(counts > cell)).size:  # cell [cell, 2 cell) is partly covered
        seed.append(_mix(hashes[more] + _U(cell * 0xD1342543DE82EF95 & 2**64 - 1)))
        start.append(np.full(len(more), float(cell)))
        rate.append(np.full(len(more), float(cell)))
        weight.append(counts[more])
        of.append(doc[more])
        cell *= 2
    seed, start, rate, weight, of = map(np.concatenate, (seed, start, rate, weight, of))
    while len(want):
        wanted = np.zeros(n, bool)
        wanted[want] = True
        bound = np.where(wanted, reach / np.maximum(total, 1), -1.0)
        live = np.flatnonzero(wanted[of])
        at, k = np.zeros(len(live)), 0
        while len(live):
            block = int(np.clip(200_000 // len(live), 1, 256))
            steps = np.arange(k + 1, k + block + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
            x = _mix(seed[live][:, None] + steps[None, :])
            gaps = -np.log(((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / (registers * rate[live][:, None])
            gaps[:, 0] += at
            t = np.cumsum(gaps, 1) if block > 1 else gaps
            r, c = np.nonzero(t <= bound[of[live]][:, None])
            e = live[r]
            y = _mix(x[r, c] + _U(1))
            where = start[e] + (y & _U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * rate[e]
            ok = where < weight[e]
            reg = ((y >> _U(32)) * _U(registers) >> _U(32)).astype(np.int64)
            np.minimum.at(sig.ravel(), of[e[ok]] * registers + reg[ok], t[r, c][ok])
            going = t[:, -1] <= bound[of[live]]
            live, at, k = live[going], t[going, -1], k + block
        want = want[np.isinf(sig[want]).any(1)]
        reach *= 2
    return sig


def bands(sig: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A hash for each band of each signature."""
    bits = np.ascontiguousarray(sig[:, : n_bands * rows]).view(np.uint64).reshape(len(sig), n_bands, rows)
    h = np.tile(np.arange(n_bands, dtype=np.uint64), (len(sig), 1))
    for k in range(rows):
        h = _mix(h * _U(0x9E3779B97F4A7C15) + bits[:, :, k])
    return h.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags of sorted hashes and multiplicities."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (total - both)


def _id() -> Column:
    return number(F.col("doc_id"), F.col("text"))


def _subsets(b: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Parts of a batch (id, text) of about _CHARS characters."""
    i = 0
    while i < b.num_rows:
        some: list[str | None] = []
        held = 0
        while i + len(some) < b.num_rows and held < _CHARS:
            some.append(b.column(1)[i + len(some)].as_py())
            held += len(some[-1] or "")
        yield b.column(0).slice(i, len(some)), some
        i += len(some)


def signed(docs: DataFrame) -> DataFrame:
    """id, hi, lo (digest of the bag, or of a text without words), weight, bands of each row."""

    @tidy
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags = Bags()
        for b in batches:
            for ids, texts in _subsets(b):
                got = [bags.of(t) for t in texts]
                doc = np.repeat(np.arange(len(got)), [len(x[0]) for x in got])
                sig = signatures(np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got]), doc, len(got))
                own = bands(sig)
                digest = [xxhash.xxh3_128_digest(h.tobytes() + c.tobytes()) if len(h) else xxhash.xxh3_128_digest(b"\1" + t.encode() if t is not None else b"\0") for (h, c), t in zip(got, texts, strict=True)]
                halves = np.frombuffer(b"".join(digest), ">i8").astype(np.int64)
                has = np.array([len(x[0]) > 0 for x in got])
                ends = np.cumsum([0, *np.where(has, BANDS, 0)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(halves[::2]), pa.array(halves[1::2]), pa.array([int(x[1].sum()) for x in got], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(own[has].ravel()))],
                    names=["id", "hi", "lo", "weight", "bands"],
                )

    return docs.select(_id().alias("id"), "text").mapInArrow(over, "id long, hi long, lo long, weight long, bands array<long>")


def bagged(docs: DataFrame) -> DataFrame:
    """id and bag (hashes, multiplicities) of each row of docs (id, text)."""

    @tidy
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags = Bags()
        for b in batches:
            for ids, texts in _subsets(b):
                packed = [pack(*bags.of(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([ids, pa.array(packed, pa.binary())], names=["id", "bag"])

    return docs.select("id", "text").mapInArrow(over, "id long, bag binary")


def pack(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted hashes, then only those multiplicities that aren't 1 with their places."""
    more = np.flatnonzero(counts != 1).astype(np.uint32)
    return np.uint64(len(hashes)).tobytes() + hashes.astype(np.uint64).tobytes() + more.tobytes() + counts[more].astype(np.uint32).tobytes()


def unpack(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(bag, np.uint64, 1)[0])
    counts = np.ones(n, np.int64)
    more = np.frombuffer(bag, np.uint32, offset=8 * (n + 1))
    counts[more[: len(more) // 2]] = more[len(more) // 2 :]
    return np.frombuffer(bag, np.uint64, n, 8), counts


def measured(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """pairs (a, b) with their similarity."""
    both = pairs.join(bags.select(F.col("id").alias("b"), F.col("bag").alias("bag_b")), "b").join(bags.select(F.col("id").alias("a"), F.col("bag").alias("bag_a")), "a")

    @tidy
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last, bag = None, None
            found = []
            for i in range(b.num_rows):
                raw = b.column(2)[i].as_py()
                if raw != last:
                    last, bag = raw, unpack(raw)
                found.append(similarity(bag, unpack(b.column(3)[i].as_py())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.float64())], names=["a", "b", "similarity"])

    return both.select("a", "b", "bag_a", "bag_b").mapInArrow(over, "a long, b long, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """id and component (its smallest id) of every node of the undirected edges (a, b), by large and small stars."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (now["n"], now["h"]) == before or not now["n"]:
            break
        before = (now["n"], now["h"])
        around = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        star = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = written(star, "large")
        least = written(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
        low = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(low.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small")
    return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")


def _ids(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def prefixes(bags: DataFrame, of: DataFrame, threshold: float) -> DataFrame:
    """The rare shingles of each bag that stand in several components; of: id and component of the bags.

    Shingles are ordered from rare to common. Two bags that reach the threshold share a shingle among their
    first ones that weigh more than 1 - threshold of each.
    """

    @tidy
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                h, c = unpack(b.column(2)[i].as_py())
                at = pa.array(np.full(len(h), i))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(h.view(np.int64)), pa.array(c), pa.array(np.full(len(h), c.sum()))], names=["id", "component", "shingle", "n", "weight"])

    each = written(of.join(bags, "id").select("id", "component", "bag").mapInArrow(over, "id long, component long, shingle long, n long, weight long"), "shingles")
    common = written(each.groupBy("shingle").agg(F.count("*").alias("freq"), F.min("component").alias("c0"), F.max("component").alias("c1")), "common")
    order = Window.partitionBy("id").orderBy("freq", "shingle").rowsBetween(Window.unboundedPreceding, -1)
    first = each.join(common, "shingle").withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("before") <= (1 - threshold) * F.col("weight") + 1e-9)
    return first.where("c0 < c1").select("shingle", "id", "component", "weight", (F.col("weight") - F.col("before")).alias("left"))


def across(bags: DataFrame, of: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b, similarity) between different components; of: id and component of the bags to compare."""
    slack = 1e-9
    radius = measured(of.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b")), bags)
    of = written(of.join(radius.select(F.col("b").alias("id"), (1 - F.col("similarity")).alias("far")), "id", "left").withColumn("far", F.coalesce("far", F.lit(0.0))), "radius")
    size = written(of.groupBy("component").agg(F.count("*").alias("size"), F.max("far").alias("reach")), "sizes")
    first = prefixes(bags, of.select("id", "component"), threshold).join(size, "component")
    first = written(first.join(of.select("id", "far"), "id").select("shingle", "id", "component", "weight", "left", "size", "reach", "far"), "prefixes")
    # From their first common shingle on, the lighter rest bounds what two bags share.
    part = threshold / (1 + threshold)
    own = first.select("shingle", "id", "weight", "left", F.col("component").alias("own"), F.col("size").alias("own_size"))
    others = first.groupBy("shingle", "component", "size", "reach").agg(F.max("left").alias("most"), F.min("weight").alias("lightest"))
    larger = (F.struct("own_size", "own") < F.struct("size", "component")) & (F.least("left", "most") >= part * (F.col("weight") + F.col("lightest")) - slack)
    met = written(own.join(others, "shingle").where(larger).select("id", "component", "reach").distinct(), "met")
    tried = written(measured(met.select(F.col("component").alias("a"), F.col("id").alias("b")), bags), "tried")
    links = tried.where(F.col("similarity") >= threshold)
    room = tried.where(F.col("similarity") < threshold).select(F.col("b").alias("id"), F.col("a").alias("component"), (threshold - F.col("similarity") - slack).alias("least"))
    room = written(room.join(size, "component").where("reach >= least").select("id", "component", "least"), "room")
    mine = written(first.select("shingle", "id", "weight", "left").join(room, "id").select("shingle", "component", "least", F.col("id").alias("a"), F.col("weight").alias("weight_a"), F.col("left").alias("left_a")), "mine")
    theirs = first.select("shingle", "component", "far", F.col("id").alias("b"), F.col("weight").alias("weight_b"), F.col("left").alias("left_b"))
    enough = part * (F.col("weight_a") + F.col("weight_b")) - slack
    near = (F.col("far") >= F.col("least")) & (F.least("left_a", "left_b") >= enough)
    pairs = written(mine.join(theirs, ["shingle", "component"]).where(near).select("a", "b").distinct(), "far-pairs")
    return links.unionByName(measured(pairs, bags).where(F.col("similarity") >= threshold))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """For each row of docs (doc_id, text): id (doc_id, or a hash if it is null), same_id (smallest id with the same
    bag), class_id (smallest id of its class of near duplicates), n_links (verified links of its bag to other bags,
    as many as hold the class together) and nearest (the greatest similarity among these; null without any)."""
    lean(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    signs = written(signed(docs), "signs")
    same = written(signs.groupBy("hi", "lo").agg(F.min("id").alias("same_id")), "same")
    rows = written(signs.join(same, ["hi", "lo"]).select("id", "same_id", "bands"), "rows")
    nodes = rows.where("id = same_id").dropDuplicates(["id"])
    buckets = nodes.select("id", F.explode("bands").alias("bucket"))
    # Another order of the ids for each bucket picks its pivot.
    pivots = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min_by("id", F.xxhash64("bucket", "id")).alias("pivot")).where("n > 1").drop("n")
    members = written(buckets.join(written(pivots, "pivots"), "bucket"), "members")
    pairs = written(members.where("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct(), "pairs")
    some = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "compared")
    bags = written(bagged(docs.select(_id().alias("id"), "text").join(_ids(some), "id", "left_semi")).dropDuplicates(["id"]), "bags")
    edges = written(measured(pairs, bags).where(F.col("similarity") >= threshold), "links")
    found = written(components(edges.select("a", "b")), "found")
    # Members that are in one bucket but not in one component.
    labelled = written(members.join(found, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component")), "labelled")
    mixed = written(labelled.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("bucket"), "mixed")
    rest = written(labelled.join(mixed, "bucket").select("id", "component").distinct(), "rest")
    if rest.limit(1).count():
        edges = written(edges.unionByName(across(bags, rest, threshold)), "all-links")
        found = written(components(edges.select("a", "b")), "found")
    ends = edges.select(F.explode(F.array("a", "b")).alias("id"), "similarity").groupBy("id").agg(F.count("*").alias("n_links"), F.max("similarity").alias("nearest"))
    classes = ends.join(found, "id", "left").select(F.col("id").alias("same_id"), F.coalesce("component", "id").alias("class_id"), "n_links", "nearest")
    out = rows.select("id", "same_id").join(classes, "same_id", "left")
    return out.select("id", "same_id", F.coalesce("class_id", "same_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "nearest")


def representatives(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of docs for each class of near duplicates, columns as they were.

    Of different texts under one doc_id one counts under it, the others each under a hash.
    """
    key = "_node" + "_" * max(map(len, docs.columns))  # no column of docs has this name
    first, last = f"{key}f", f"{key}l"
    left = docs.withColumn(key, _id())
    shared = left.select(key, F.xxhash64("text").alias(first)).groupBy(key).agg(F.min(first).alias(first), F.max(first).alias(last))
    shared = written(shared.where(F.col(first) < F.col(last)).drop(last), "shared-ids")
    if shared.limit(1).count():
        other = F.xxhash64("text") != F.col(first)
        left = left.join(_ids(shared), key, "left").withColumn(key, F.when(other, F.xxhash64(key, "text").bitwiseAND(F.lit(2**63 - 1))).otherwise(F.col(key))).drop(first)
    found = written(near_duplicates(left.select(F.col(key).alias("doc_id"), "text"), threshold), "classes")
    gone = written(found.where("id <> class_id").select("id").distinct(), "gone")
    again = written(found.groupBy("id").count().where("count > 1").select("id"), "again")  # rows that are repeated as a whole
    named = lambda df: _ids(df.withColumnRenamed("id", key))
    out = left.join(named(gone), key, "left_anti")
    if again.limit(1).count():
        once = out.join(named(again), key, "left_semi").dropDuplicates([key])
        out = out.join(named(again), key, "left_anti").unionByName(once)
    return out.drop(key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")
