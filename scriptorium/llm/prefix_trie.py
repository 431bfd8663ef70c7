"""The prefix trie of conversations as a Cartesian tree over their sorted order.

Each turn becomes a token of 20 bytes: 128 bits of its role and text and its number of words;
texts travel no further. Conversations are rebuilt as token strings and sorted by range over
all tasks, so that every subtree is an interval of the order. LCP(j) is the number of turns
that conversation j shares with the one before it. The sequence at j opens the nodes of depths
LCP(j) + 1 to its length, the whole unary chain, and each of them ends at the nearest later
position whose LCP is smaller: nodes of one depth over one interval are one node, whatever the
number of equal LCPs in it.

Nearest smaller values are found in parallel. A block is what one task holds of the order; a
stack finds those within it in one reading, with memory for the open path only. What stays
open at a block's end is resolved from one row for each block: the least LCP in it, the one at
its border and its sums. The interval runs on to the nearest later block with a smaller
minimum; blocks between add their sums whole, the last adds the part before its first smaller
LCP. The same search backwards tells whose interval a block's first path continues. All that a
node reports is a sum or a minimum over its interval:

    saved_tokens(v) = words of members below v's parent - words of the nodes of v's subtree

as each node's words count n_convs times in the first sum and once in the second.

The decimal ids of a node's ends are hashed as they come, in order; where equal conversations
fill several blocks, their pieces are put together again by one reading in order.

Edge cases: rows without conv_id belong to no conversation and are left out; turns with equal
numbers are ordered by role and then by the digest of role and text, so repeated rows are
repeated turns; null roles and texts are empty; a conversation that is left without turns ends
at the root; an empty table has no nodes; further columns are ignored. Texts may be of any
length; of a conversation a task holds 20 bytes a turn and the counts of its open path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, tidy, written

#: Conversations of this many neighbouring ids share the first of them as their opening; HEAD - 1 turns of it at most (fixed values of the contract).
FAMILY, HEAD = 20, 4
#: Words stand between runs of these characters (fixed value of the contract).
GAPS = r"[\x20\x09-\x0D]+"
#: Bytes of a token: digest and number of words.
DIGEST, TOKEN = 16, 20
#: Ids that are held before they go on as a piece, and finished rows held for their parents.
PIECE_IDS, HELD_ROWS = 8192, 20_000
#: Rows up to which what open nodes are called is broadcast.
BROADCAST_REFS = 1_000_000
FAR = 1 << 40
NODE, FRAGMENT, BLOCK, PIECE = range(4)
EMPTY = hashlib.sha256().hexdigest()

_FIELDS = {
    "kind": "int", "block": "int", "ref": "long", "parent_ref": "long", "conv": "long", "parent_conv": "long", "depth": "long", "n": "long", "children": "long", "marks": "long", "total": "long", "fresh": "long", "before": "long", "sha": "string",
    "left": "boolean", "open": "boolean", "first_key": "binary", "last_key": "binary", "least": "long", "seq": "long", "text": "string",
}
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
WALK_SCHEMA = ", ".join(f"{k} {v}" for k, v in _FIELDS.items())
WALK = pa.schema([(k, _ARROW[v]) for k, v in _FIELDS.items()])


# ------------------------------------------------------------------ token strings
def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id and key, the tokens of its rebuilt turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, F.lit(":"), text))
    n_words = F.size(F.array_remove(F.split(text, GAPS), ""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), "turn", role.alias("role"), digest.alias("digest"), F.lpad(F.hex(n_words), 8, "0").alias("words"))
    own = turns.repartition("base").groupBy("base", "conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "digest", "words"))).alias("turns"))
    own = own.select("base", "conv_id", F.transform("turns", lambda t: F.concat(t["digest"], t["words"])).alias("turns"))
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, HEAD - 1))).over(Window.partitionBy("base"))
    some = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int")
    both = own.select("conv_id", "turns", F.coalesce(head, F.array().cast("array<string>")).alias("head"), some.alias("some"))
    joined = F.concat(F.slice("head", F.lit(1), F.col("some")), F.slice("turns", F.col("some") + 1, F.size("turns")))
    return both.select("conv_id", F.unhex(F.array_join(joined, "")).alias("key"))


def common(a: bytes, b: bytes) -> int:
    """Tokens that two keys begin with."""
    low, high = 0, min(len(a), len(b)) // TOKEN
    if a[: high * TOKEN] == b[: high * TOKEN]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low * TOKEN : mid * TOKEN] == b[low * TOKEN : mid * TOKEN]:
            low = mid
        else:
            high = mid
    return low


def words_of(key: bytes, tokens: int) -> int:
    return sum(int.from_bytes(key[i * TOKEN + DIGEST : (i + 1) * TOKEN], "big") for i in range(tokens))


# ------------------------------------------------------------------ within a block
class _Open:
    """A node whose interval hasn't ended. marks: positions after its first at which some sequence ended for good;
    total: words of its members; fresh: words of the nodes below and at it."""

    __slots__ = ("before", "children", "fresh", "hash", "ids", "kids", "left", "low", "marks", "n", "pieces", "serial", "total", "used")

    def __init__(self, serial: int, words: int, before: int, left: bool) -> None:
        self.serial, self.fresh, self.before, self.left = serial, words, before, left
        self.n = self.marks = self.total = self.children = self.pieces = 0
        self.low = FAR << 20
        self.hash = None
        self.ids: list[str] = []
        self.kids: list[dict] = []
        self.used = left  # whether its name is known outside


class _Walk:
    """One block: rows come in order, nodes go out as their intervals end."""

    def __init__(self, block: int) -> None:
        self.block, self.out, self.stack, self.serial, self.held = block, [], [], 0, 0
        self.first_key: bytes | None = None
        self.last_key = b""
        self.least, self.least_n, self.n, self.marks, self.total, self.fresh, self.low = FAR, 0, 0, 0, 0, 0, FAR << 20

    def ref(self, node: _Open) -> int:
        return (self.block << 40) | node.serial

    def open_to(self, key: bytes, depth: int) -> None:
        """Open the nodes of key that aren't open yet."""
        for d in range(len(self.stack), depth + 1):
            words = int.from_bytes(key[d * TOKEN - TOKEN + DIGEST : d * TOKEN], "big") if d else 0
            above = self.stack[-1] if d else None
            before = above.before + (int.from_bytes(key[d * TOKEN - 2 * TOKEN + DIGEST : (d - 1) * TOKEN], "big") if d > 1 else 0) if d else 0
            if above:
                above.children += 1
            self.stack.append(_Open(self.serial, words, before, self.n == 0))
            self.serial += 1
            self.fresh += words if self.n else 0

    def spill(self, node: _Open, always: bool) -> None:
        """Feed the held ids to the node's hash; as a piece too if others may have to go on with them."""
        if not node.ids:
            return
        text = ",".join(node.ids)
        if node.hash is None:
            node.hash = hashlib.sha256(text.encode())
        else:
            node.hash.update(b"," + text.encode())
        if always or node.pieces or len(node.ids) >= PIECE_IDS:
            self.out.append({"kind": PIECE, "block": self.block, "ref": self.ref(node), "seq": node.pieces, "text": text})
            node.pieces += 1
        node.ids = []

    def release(self, node: _Open, conv: int | None) -> None:
        """Send the finished children of a node, with its smallest member or, while that isn't known, with its name."""
        for kid in node.kids:
            kid["parent_conv" if conv is not None else "parent_ref"] = conv if conv is not None else self.ref(node)
            self.out.append(kid)
        if node.kids and conv is None:
            node.used = True
        self.held -= len(node.kids)
        node.kids = []

    def leave(self, at_end: bool) -> None:
        """Take the deepest node from the stack."""
        node, depth = self.stack.pop(), len(self.stack)
        above = self.stack[-1] if self.stack else None
        edge = node.left or at_end
        self.spill(node, edge)
        row = {"kind": NODE, "block": self.block, "conv": node.low, "depth": depth, "n": node.n, "children": node.children, "marks": node.marks, "total": node.total, "fresh": node.fresh, "before": node.before, "sha": node.hash.hexdigest() if node.hash else EMPTY}
        self.release(node, None if edge else node.low)
        if edge:
            row |= {"kind": FRAGMENT, "left": node.left, "open": at_end, "ref": self.ref(node), "parent_ref": self.ref(above) if above else None}
            if above:
                above.used = True
            self.out.append(row)
        else:
            row["ref"] = self.ref(node) if node.used else None
            above.kids.append(row)
            self.held += 1
        if above:
            above.n += node.n
            above.low = min(above.low, node.low)
            above.marks += node.marks
            above.total += node.total
            above.fresh += node.fresh

    def add(self, key: bytes, conv: int) -> None:
        length = len(key) // TOKEN
        if self.first_key is None:
            self.first_key = key
        else:
            shared = common(self.last_key, key)
            while len(self.stack) > shared + 1:
                self.leave(False)
            if shared < len(self.last_key) // TOKEN:
                self.stack[-1].marks += 1
                self.marks += 1
            if shared < self.least:
                self.least, self.least_n = shared, 0
            self.least_n += shared == self.least and length > shared
        self.open_to(key, length)
        node, words = self.stack[-1], 0
        words = node.before + (int.from_bytes(key[-TOKEN + DIGEST :], "big") if length else 0)
        node.n += 1
        node.low = min(node.low, conv)
        node.total += words
        node.ids.append(str(conv))
        if len(node.ids) >= PIECE_IDS:
            self.spill(node, False)
        self.n, self.total, self.low, self.last_key = self.n + 1, self.total + words, min(self.low, conv), key
        if self.held > HELD_ROWS:
            for open_node in self.stack:
                self.release(open_node, None)

    def end(self) -> None:
        if self.first_key is None:
            return
        while self.stack:
            self.leave(True)
        self.out.append({"kind": BLOCK, "block": self.block, "first_key": self.first_key, "last_key": self.last_key, "least": self.least, "children": self.least_n, "n": self.n, "conv": self.low, "marks": self.marks, "total": self.total, "fresh": self.fresh})


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walk = _Walk(TaskContext.get().partitionId())
    for b in batches:
        for key, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            walk.add(key, conv)
            if len(walk.out) >= 5000:
                yield pa.RecordBatch.from_pylist(walk.out, schema=WALK)
                walk.out = []
    walk.end()
    if walk.out:
        yield pa.RecordBatch.from_pylist(walk.out, schema=WALK)


# ------------------------------------------------------------------ across blocks
BORDERS = pa.schema([(k, pa.int64()) for k in ("block", "border", "first_len", "ended", "shared_words", "least", "children", "n", "conv", "marks", "total", "fresh")])


def _bordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """LCPs at the blocks' borders, from their keys and the last key of the block before."""
    for b in batches:
        rows = []
        for r in b.to_pylist():
            before, key = r.pop("previous"), r.pop("first_key")
            border = -1 if before is None else common(before, key)
            shared = words_of(key, max(border, 0))
            r["fresh"] += words_of(key, len(key) // TOKEN) - shared
            rows.append(r | {"border": border, "first_len": len(key) // TOKEN, "ended": int(before is not None and border < len(before) // TOKEN), "shared_words": shared})
        yield pa.RecordBatch.from_pylist(rows, schema=BORDERS)


class Minima:
    """Block minima: nearest smaller blocks and sums over the blocks between. A row for each block, in order."""

    def __init__(self, rows: dict[str, np.ndarray]) -> None:
        self.rows = rows
        self.low = np.minimum(rows["border"], rows["least"])
        self.table = self._doubled(self.low)
        self.back = self._doubled(self.low[::-1].copy())
        self.convs = self._doubled(rows["conv"])
        sums = {"n": rows["n"], "marks": rows["marks"] + rows["ended"], "total": rows["total"], "fresh": rows["fresh"]}
        self.sums = {k: np.concatenate([[0], np.cumsum(v)]) for k, v in sums.items()}
        size = len(self.low)
        at = np.concatenate([rows["least"], rows["border"]])
        order = np.argsort(key := np.maximum(at, 0) * (size + 1) + np.tile(np.arange(size), 2) + (at < 0) * -(1 << 60), kind="stable")
        self.opened_at = key[order]
        self.opened = np.concatenate([[0], np.cumsum(np.concatenate([rows["children"], (rows["first_len"] > rows["border"]).astype(np.int64)])[order])])

    @staticmethod
    def _doubled(v: np.ndarray) -> list[np.ndarray]:
        out = [v]
        while 2 ** len(out) <= len(v):
            h = 2 ** (len(out) - 1)
            out.append(np.minimum(out[-1][:-h], out[-1][h:]))
        return out

    @staticmethod
    def _search(doubled: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first place from `at` on whose value is below depth; the number of places if there is none."""
        at = at.copy()
        for k in reversed(range(len(doubled))):
            inside = np.minimum(at, len(doubled[k]) - 1)
            at += np.where((at < len(doubled[k])) & (doubled[k][inside] >= depth), 2**k, 0)
        return at

    def next_smaller(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return self._search(self.table, at + 1, depth)

    def previous_smaller(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        size = len(self.low)
        return size - 1 - self._search(self.back, size - at, depth)

    def between(self, a: np.ndarray, b: np.ndarray, depth: np.ndarray) -> dict[str, np.ndarray]:
        """Sums over the blocks after a and before b, none of which has an LCP below depth."""
        out = {k: v[b] - v[a + 1] for k, v in self.sums.items()}
        size = len(self.low)
        from_, to = (np.searchsorted(self.opened_at, depth * (size + 1) + x) for x in (a + 1, b))
        out["children"] = self.opened[to] - self.opened[from_]
        conv = np.full(len(a), FAR << 20)
        n = b - a - 1
        for k, level in enumerate(self.convs):
            use = (n >= 2**k) & (n < 2 ** (k + 1))
            conv[use] = np.minimum(level[a[use] + 1], level[b[use] - 2**k])
        return out | {"conv": conv}


RESOLVED = "block long, depth long, ref long, parent_ref long, begins boolean, open boolean, owner long, closer long, conv long, n long, children long, marks long, total long, fresh long, before long, sha string, crossed boolean, border long, shared_words long, ended long"


def _resolver(rows: dict[str, np.ndarray]):
    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Minima(rows)
        size = len(blocks.low)
        for b in batches:
            v = {k: b.column(k).to_numpy(zero_copy_only=False) for k in ("block", "depth", "conv", "n", "children", "marks", "total", "fresh", "before", "left", "open")}
            at, depth = np.searchsorted(rows["block"], v["block"]), v["depth"].astype(np.int64)
            begins = ~v["left"].astype(bool) | (depth > rows["border"][at])
            runs_on = begins & v["open"].astype(bool)
            until = np.where(runs_on, blocks.next_smaller(at, depth), at + 1)
            more = blocks.between(at, until, depth)
            inside = np.minimum(until, size - 1)
            closed_in = runs_on & (until < size) & (rows["border"][inside] >= depth)
            owner = np.where(begins, at, blocks.previous_smaller(at, np.where(begins, FAR, depth)))
            # equal conversations go on in the next block
            following = np.minimum(at + 1, size - 1)
            crossed = runs_on & (at + 1 < size) & (rows["border"][following] == depth) & (rows["first_len"][following] == depth)
            cols = [
                pa.array(v["block"].astype(np.int64)), pa.array(depth), b.column("ref"), b.column("parent_ref"), pa.array(begins), b.column("open"), pa.array(rows["block"][owner]), pa.array(rows["block"][inside], mask=~closed_in),
                pa.array(np.where(runs_on, np.minimum(v["conv"], more["conv"]), v["conv"])), *(pa.array(v[k] + np.where(runs_on, more[k], 0)) for k in ("n", "children", "marks", "total", "fresh")), pa.array(v["before"]), b.column("sha"), pa.array(crossed),
                *(pa.array(rows[k][at]) for k in ("border", "shared_words", "ended")),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in RESOLVED.split(", ")])

    return resolve


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of pieces that come in order of owner, block and seq."""
    owner, state = None, None
    for b in batches:
        out = []
        for who, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if who != owner:
                if state:
                    out.append((owner, state.hexdigest()))
                owner, state = who, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.string())], names=["ref", "whole"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([owner], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["ref", "whole"])


def _finished(conv: Column | str = "conv") -> list[Column | str]:
    saved = F.col("total") - F.col("n") * F.col("before") - F.col("fresh")
    return ["ref", "parent_ref", F.col(conv).alias("conv"), "depth", "n", "children", (F.col("marks") + 1).alias("leaves"), saved.alias("saved"), "sha"]


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, turn, role, text), one row each."""
    strings = written(rebuilt(conversations), "strings")
    order = strings.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    walked = written(order.mapInArrow(tidy(_walked), WALK_SCHEMA), "walk")

    previous = F.lag("last_key").over(Window.orderBy("block"))
    blocks = walked.where(F.col("kind") == BLOCK).select(F.col("block").cast("long").alias("block"), "first_key", previous.alias("previous"), "least", "children", "n", "conv", "marks", "total", "fresh")
    borders = blocks.mapInArrow(_bordered, ", ".join(f"{k} long" for k in BORDERS.names)).toPandas().sort_values("block")  # a row of numbers for each block, that is for each partition of one shuffle
    rows = {k: borders[k].to_numpy(np.int64) for k in BORDERS.names}

    edges = walked.where(F.col("kind") == FRAGMENT).select("block", "depth", "ref", "parent_ref", "conv", "n", "children", "marks", "total", "fresh", "before", "sha", "left", "open")
    edges = written(edges.mapInArrow(_resolver(rows), RESOLVED), "edges")
    begun = edges.where("begins")
    # What a block adds before its first LCP below depth; its path up to the border isn't new there.
    last = edges.where("not begins").select(
        F.col("block").alias("closer"), "depth", F.col("conv").alias("conv_2"), F.col("n").alias("n_2"), (F.col("children") - F.when(F.col("border") > F.col("depth"), 1).otherwise(0)).alias("children_2"),
        (F.col("marks") + F.col("ended")).alias("marks_2"), F.col("total").alias("total_2"), (F.col("fresh") - F.col("shared_words") + F.col("before")).alias("fresh_2"),
    )
    whole = begun.join(last, ["closer", "depth"], "left")
    added = {k: (F.col(k) + F.coalesce(F.col(f"{k}_2"), F.lit(0))).alias(k) for k in ("n", "children", "marks", "total", "fresh")}
    whole = written(whole.select("block", "depth", "ref", "parent_ref", F.least("conv", "conv_2").alias("conv"), *added.values(), "before", "sha", "open", "crossed"), "spanning")
    continued = edges.where("not begins").select(F.col("ref").alias("later"), F.col("owner").alias("block"), "depth")  # of the nodes still open at a block's end there is one at each depth

    # Ends of equal conversations in several blocks.
    crossed = whole.where("crossed")
    owners = crossed.select(F.col("ref").alias("piece_ref"), "ref").unionByName(continued.join(crossed, ["block", "depth"]).select(F.col("later").alias("piece_ref"), "ref"))
    pieces = walked.where(F.col("kind") == PIECE).select(F.col("ref").alias("piece_ref"), F.col("block").alias("at"), "seq", "text")
    in_order = pieces.join(owners, "piece_ref").repartition("ref").sortWithinPartitions("ref", "at", "seq")
    hashes = in_order.select("ref", "text").mapInArrow(_joined, "ref long, whole string")
    whole = written(whole.join(hashes, "ref", "left").withColumn("sha", F.coalesce("whole", "sha")).drop("whole"), "spanning")

    nodes = walked.where(F.col("kind") == NODE)
    names = whole.select("ref", F.col("conv").alias("named")).unionByName(nodes.where("ref is not null").select("ref", F.col("conv").alias("named")))
    carried = continued.join(whole.where("open"), ["block", "depth"]).select(F.col("later").alias("ref"), F.col("conv").alias("named"))
    names = written(names.unionByName(carried), "names").withColumnRenamed("ref", "parent_ref")
    names = F.broadcast(names) if names.count() <= BROADCAST_REFS else names

    known = nodes.where("parent_ref is null").select(*_finished(), "parent_conv")
    top = whole.where("parent_ref is null").select(*_finished(), F.lit(None).cast("long").alias("parent_conv"))
    unknown = nodes.where("parent_ref is not null").select(*_finished()).unionByName(whole.where("parent_ref is not null").select(*_finished()))
    found = unknown.join(names, "parent_ref").withColumnRenamed("named", "parent_conv")
    return known.unionByName(top).unionByName(found.select(*known.columns)).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("sha").alias("ends_sha256")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list(k ORDER BY turn NULLS FIRST, role, m) AS ks, list(w ORDER BY turn NULLS FIRST, role, m) AS ws
  FROM (SELECT conv_id, turn, role, md5(strlen(role) || ':' || role || ':' || text) AS m, sha256(strlen(role) || ':' || role || text) AS k,
               len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM t)
  GROUP BY conv_id),
h AS (
  SELECT *, (xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: xor(p >> 1, CASE WHEN p % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 4)::BIGINT AS h
  FROM c),
r AS (
  SELECT a.conv_id, list_concat(coalesce(b.ks, [])[1:a.h], a.ks[a.h + 1:]) AS ks, list_concat(coalesce(b.ws, [])[1:a.h], a.ws[a.h + 1:]) AS ws
  FROM h a LEFT JOIN c b ON b.conv_id = a.conv_id - a.conv_id % 20),
p AS (
  SELECT conv_id, d, len(ks) AS size, array_to_string(ks[1:d], ',') AS node, array_to_string(ks[1:d - 1], ',') AS parent, ks[d + 1] AS next, coalesce(ws[d], 0) AS w, ks
  FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM r)),
n AS (
  SELECT node, d, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, count(DISTINCT next) AS n_children, (count(*) - 1) * min(w) AS saved, arg_min(ks, conv_id) AS ks,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256
  FROM p GROUP BY node, d),
s AS (
  SELECT array_to_string(ks[1:e], ',') AS node, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM n) GROUP BY 1)
SELECT n.conv_id, n.d::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.node = n.node LEFT JOIN n up ON n.d > 0 AND up.node = n.parent AND up.d = n.d - 1
"""
