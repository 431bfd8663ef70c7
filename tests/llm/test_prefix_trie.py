"""The trie against a dictionary of prefixes, over one block and over many."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from scriptorium.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    for c, turns in own.items():
        turns.sort(key=lambda t: (*t[:3], hashlib.md5(f"{len(t[2].encode())}:{t[2]}:{t[3]}".encode()).hexdigest()))
        own[c] = [t[2:] for t in turns]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (c % 20 if c >= 0 else -(-c % 20))
        seq = tuple(own.get(first, [])[:h] + turns[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    kids = collections.defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out, leaves, saved = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids[p])
        sha = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], sha))
    return sorted(out, key=str)


def talks(seed, n, words=3, turns=7, copies=0.3):
    g = random.Random(seed)
    rows, known = [], []
    for c in g.sample(range(3 * n), n):
        if known and g.random() < copies:
            seq = g.choice(known)[: g.randrange(0, turns + 1)] + [("user", " ".join(g.choice("ab c\n") for _ in range(g.randrange(words))))] * g.randrange(2)
        else:
            seq = [(g.choice(["user", "assistant", None]), g.choice([None, "", "a", "b b", "c  c\tc", " x\ny "])) for _ in range(g.randrange(1, turns + 1))]
        known.append(seq)
        order = list(range(len(seq)))
        rows += [(c, None if i == 0 and g.random() < 0.1 else i, *seq[i]) for i in order]
    g.shuffle(rows)
    return rows


def result(spark, rows, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return sorted(map(tuple, prefix_trie.trie(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


@pytest.mark.parametrize("seed,n,parts,copies", [(1, 60, 1, 0.3), (2, 60, 7, 0.5), (3, 40, 40, 0.7), (4, 150, 23, 0.9), (5, 25, 60, 0.95)])
def test_against_brute_force(spark, seed, n, parts, copies):
    rows = talks(seed, n, copies=copies)
    assert result(spark, rows, parts) == brute(rows)


def test_equal_conversations_over_many_blocks(spark):
    """Copies fill several blocks, some of one conversation only; others end on them or go on from them."""
    copy = [("user", "a b"), ("assistant", "c")]
    rows = [(20 * c, i, *t) for c in range(90) for i, t in enumerate(copy)]
    rows += [(20 * c + 5, i, *t) for c in range(30) for i, t in enumerate([*copy, ("user", f"more {c % 7}")])]
    assert result(spark, rows, 24) == brute(rows)


def test_one_deep_conversation(spark):
    rows = [(c, i, "user", f"word {i % 5}") for c in (3, 4, 25) for i in range(300 + c)]
    assert result(spark, rows, 5) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (7, None, None, None), (7, 1, "", ""), (7, 1, "", ""), (7, 1, "b", "z"), (7, 1, "a", "y " * 50_000), (-25, 1, "user", "negative"), (-20, 0, "user", "base"), (40, 1, "user", "alone"), (9, 0, "user", "only one")]
    assert result(spark, rows, 4) == brute(rows)
    assert result(spark, [(9, 0, "user", "t")], 3) == brute([(9, 0, "user", "t")])
    more = spark.createDataFrame([(*r, 1, 2, "k") for r in rows], SCHEMA + ", base int, n int, key string")
    assert sorted(map(tuple, prefix_trie.trie(more).collect()), key=str) == brute(rows)
    assert prefix_trie.trie(more.where("false")).collect() == []


def test_the_walk_holds_bounded_rows(monkeypatch, spark):
    """Rows that leave before their parents are named end as the others do."""
    monkeypatch.setattr(prefix_trie, "HELD_ROWS", 3)
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 2)
    walk = prefix_trie._Walk(0)
    keys = sorted((bytes([a]) * 20 + (bytes([b]) * 20 if b else b""), a * 10 + b) for a in range(1, 5) for b in range(4))
    for k, c in keys:
        walk.add(k, c)
    walk.end()
    kinds = collections.Counter(r["kind"] for r in walk.out)
    assert kinds[prefix_trie.NODE] + kinds[prefix_trie.FRAGMENT] == 1 + 4 + 12
    named = {r["ref"] for r in walk.out if r["kind"] in (0, 1) and r.get("ref") is not None}
    assert {r["parent_ref"] for r in walk.out if r.get("parent_ref") is not None} <= named


def test_nearest_smaller_blocks():
    g = np.random.default_rng(3)
    for size in (1, 2, 9, 40):
        zero = np.zeros(size, np.int64)
        rows = {k: zero for k in ("n", "marks", "ended", "total", "fresh", "first_len")} | {"border": np.append([-1], g.integers(0, 6, size - 1)), "least": g.integers(0, 6, size), "children": zero + 1, "conv": g.integers(0, 99, size)}
        m = prefix_trie.Minima(rows)
        low = np.minimum(rows["border"], rows["least"])
        for i in range(size):
            for d in range(7):
                at, depth = np.array([i]), np.array([d])
                j = next((j for j in range(i + 1, size) if low[j] < d), size)
                assert m.next_smaller(at, depth)[0] == j
                assert m.previous_smaller(at, depth)[0] == next((j for j in range(i - 1, -1, -1) if low[j] < d), -1)
                got = m.between(at, np.array([j]), depth)
                assert got["children"][0] == sum(int(rows["least"][x] == d) for x in range(i + 1, j))
                assert got["conv"][0] == min((rows["conv"][x] for x in range(i + 1, j)), default=prefix_trie.FAR << 20)


def test_sizes_of_blocks_do_not_matter(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    want = brute([tuple(r) for r in rows])
    assert result(spark, rows, 3) == want
    assert result(spark, rows, 50) == want
