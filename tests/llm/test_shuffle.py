"""The uniform shuffle: exact sizes, the distribution of its draws, nothing lost."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import shuffle
from scriptorium.llm.common import table

SF = "/root/testdata/sf0.001"


def exact(total, good, drawn):
    return {x: math.comb(good, x) * math.comb(total - good, drawn - x) / math.comb(total, drawn) for x in range(max(0, drawn - total + good), min(good, drawn) + 1)}


@pytest.mark.parametrize("total,good,drawn", [(5, 2, 2), (40, 1, 20), (60, 30, 15), (100, 90, 50), (7, 7, 3), (9, 0, 4), (6, 3, 6)])
def test_draws_follow_the_hypergeometric_distribution(spark, total, good, drawn):
    n = 3000
    got = spark.range(n).select(shuffle.hypergeometric(F.lit(total), F.lit(good), F.lit(drawn), F.lit(3), F.col("id")).alias("x")).groupBy("x").count().collect()
    p = exact(total, good, drawn)
    assert {r.x for r in got} <= set(p)
    seen = {r.x: r["count"] for r in got}
    many = [x for x in p if n * p[x] >= 5]
    chi = sum((seen.get(x, 0) - n * p[x]) ** 2 / (n * p[x]) for x in many)
    assert chi < len(many) + 5 * math.sqrt(2 * len(many)) + 5


def test_log_factorials_of_small_and_large_numbers(spark):
    pairs = [(0.0, 5.0), (3.0, 0.0), (170.0, 3.0), (2e10, 2e10 - 3e5), (5.0, 5.0)]
    for r in spark.createDataFrame(pairs, "a double, b double").select("a", "b", shuffle.log_factorials(F.col("a"), F.col("b")).alias("d")).collect():
        assert r.d == pytest.approx(math.lgamma(r.a + 1) - math.lgamma(r.b + 1), rel=1e-8, abs=1e-8)


def test_the_matrix_has_both_sums(spark):
    counts = [(3 * i, n) for i, n in enumerate([5, 1, 40, 0, 7, 300, 12])]
    rows = shuffle.matrix(spark.createDataFrame(counts, "part int, n long"), 16, 4).collect()
    assert {r.part: sum(r.row) for r in rows} == dict(counts)
    assert min(min(r.row) for r in rows) >= 0
    total = sum(n for _, n in counts)
    assert [sum(c) for c in zip(*(r.row for r in rows), strict=True)] == [total // 16 + (s < total % 16) for s in range(16)]


def test_cells_of_the_matrix_are_spread_as_by_a_permutation(spark):
    """Over many seeds the first entry of a 3 x 2 matrix follows its exact distribution."""
    counts = spark.createDataFrame([(0, 4), (1, 6), (2, 10)], "part int, n long")
    seen = collections.Counter()
    one = counts.agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("parts"))
    seeds = spark.range(3000).crossJoin(one)
    # the same draw that matrix() makes at its root, for many keys
    got = seeds.select(shuffle.parted(F.array(F.lit(10), F.lit(10)).cast("array<bigint>"), F.lit(4), F.col("id")).alias("v")).collect()
    seen.update(r.v[0] for r in got)
    assert all(sum(r.v) == 4 for r in got)
    chi = sum((seen[x] - 3000 * p) ** 2 / (3000 * p) for x, p in exact(20, 10, 4).items())
    assert chi < 25


def checked(rows, n, shards=16):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert sum(map(len, by.values())) == n
    for s in range(shards):
        assert sorted(by.get(s, [])) == list(range(n // shards + (s < n % shards)))


def test_query_against_brute_force(spark):
    docs = table(spark, SF, "documents").collect()
    rows = shuffle.query(spark, SF).collect()
    checked(rows, len(docs))
    want = collections.Counter((d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_rows_are_mixed(spark):
    """Neighbours of the input are as often in one shard as chance has it, in each of several partitions and cells."""
    n = 8000
    docs = spark.range(0, n, 1, 7).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = shuffle.shuffled(docs, cell_rows=100).select("row.doc_id", "shard", "slot").collect()
    checked(rows, n)
    at = {r.doc_id: (r.shard, r.slot) for r in rows}
    same = sum(at[i][0] == at[i + 1][0] for i in range(n - 1))
    assert abs(same - n / 16) < 6 * math.sqrt(n / 16)
    slots = np.array([at[i][1] for i in range(n)], float)
    assert abs(np.corrcoef(slots, np.arange(n))[0, 1]) < 0.06


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "no id", "c"), (4, "one", "d"), (4, "one", "d"), (5, "x" * 300_000, "e"), (6, "ñ日", None)]
    docs = spark.createDataFrame([(*r, 1, 2, 3.0) for r in rows], "doc_id long, text string, row string, shard int, slot int, part double")
    got = shuffle.shuffled(docs).collect()
    assert collections.Counter(tuple(r.row) for r in got) == collections.Counter((*r, 1, 2, 3.0) for r in rows)
    checked(got, len(rows))
    assert shuffle.shuffled(docs.where("false")).collect() == []


def test_files(spark, tmp_path):
    rows = shuffle.shuffled(table(spark, SF, "documents"))
    shuffle.save(rows, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.select("doc_id", "text", "shard", "slot").exceptAll(rows.select("row.doc_id", "row.text", "shard", "slot")).count() == 0
    assert sorted(p.name for p in (tmp_path / "shards").iterdir() if p.is_dir()) == sorted(f"shard={s}" for s in range(16))
