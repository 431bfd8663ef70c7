"""Benchmark decontamination by winnowing, with DataFrame functions only.

A window is 13 consecutive words of an item (all words of a shorter item). Of
every window of L words the smallest of its k-gram hashes is its fingerprint,
k = min(5, L): a window that a document shares with an item has the same k-grams
and so the same fingerprint, therefore no shared span of L words can be missed.
Documents that share a fingerprint are then compared window by window, on the
words themselves.

Edge cases: null text has no words; an item without words is left out, as is an
item whose item_id is null; equal item_ids count once; repeated documents each
get their own row with the same result; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, words, written

WINDOW, KGRAM = 13, 5
#: Rows of an item table, and characters in it, up to which it is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS, BROADCAST_CHARS = 400_000, 64_000_000
#: Keys (16 bytes each) up to which a set is broadcast.
BROADCAST_IDS = 2_000_000
#: Item fingerprints up to which they are looked up in a hash set that is part of the plan.
LITERAL_MARKS = 20_000


def fingerprints(hashes: Column, length: int, kgram: int = KGRAM) -> Column:
    """For every window of `length` words the smallest of its k-gram hashes."""
    k = min(kgram, length)
    w = length - k + 1

    def over(values: Column, size: int, make) -> Column:
        last = F.size(values) - F.lit(size)
        steps = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(steps, lambda i: make([values[i + F.lit(j)] for j in range(size)]))

    def of(h: Column) -> Column:
        grams = over(h, k, lambda v: F.xxhash64(F.lit(k), *v))
        return grams if w == 1 else let(grams, lambda g: over(g, w, lambda v: F.least(*v)))

    return let(hashes, of)


def windows(ws: Column, length: int) -> Column:
    """Array of {pos, gram} of all windows of `length` words."""

    def of(v: Column) -> Column:
        last = F.size(v) - F.lit(length)
        steps = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(steps, lambda i: F.struct(i.alias("pos"), F.lit(length).alias("len"), F.array_join(F.slice(v, i + 1, F.lit(length)), " ").alias("gram")))

    return let(ws, of)


def _small(df: DataFrame, limit: int, texts: str | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows, and BROADCAST_CHARS characters in the column `texts`."""
    size = df.agg(F.count("*").alias("n"), F.sum(F.length(texts)).alias("chars") if texts else F.lit(0).alias("chars")).first()
    return F.broadcast(df) if size["n"] <= limit and (size["chars"] or 0) <= BROADCAST_CHARS else df


def _key() -> Column:
    """128 bits that stand for a row."""
    return F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(1), "text", "doc_id").alias("b"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, literal_marks: int = LITERAL_MARKS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each row of docs (doc_id, text) against items (item_id, text).

    Columns: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.
    """
    return compared(docs, items, window, literal_marks, broadcast_rows).drop("key")


def compared(docs: DataFrame, items: DataFrame, window: int = WINDOW, literal_marks: int = LITERAL_MARKS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of decontaminate() with the key (of doc_id and text) of their document."""
    items = items.where(F.col("item_id").isNotNull()).select("item_id", words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    items = written(items.select("item_id", "ws", F.least(F.size("ws"), F.lit(window)).alias("len")), "items")
    lengths = sorted(r[0] for r in items.select("len").distinct().collect())  # at most `window` values
    docs = docs.select("doc_id", "text").withColumn("key", _key())
    none = F.sha2(F.lit("").cast("binary"), 256)
    nothing = F.array().cast("array<bigint>")
    if not lengths:
        zero = F.lit(0).cast("long")
        return docs.select("key", "doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"), zero.alias("n_hit"), zero.alias("n_items"), none.alias("items_sha256"), F.lit(False).alias("contaminated"))
    hashed = lambda ws: F.transform(ws, lambda x: F.xxhash64(x))
    theirs = [F.when(F.col("len") == n, fingerprints(hashed(F.col("ws")), n)).otherwise(nothing) for n in lengths]
    marks = written(items.select(F.explode(F.concat(*theirs)).alias("fp")).distinct(), "marks")
    few = [r[0] for r in marks.limit(literal_marks + 1).collect()]
    split = docs.select("key", "doc_id", words(F.col("text")).alias("ws"))
    prints = let(hashed(F.col("ws")), lambda h: F.concat(*[fingerprints(h, n) for n in lengths]))
    if len(few) <= literal_marks:
        touched = F.exists(prints, lambda x: x.isin(few))
        split = split.select("key", "doc_id", "ws", touched.alias("touched"))
    else:  # the marks are joined, by shuffle if there are too many to broadcast
        found = split.select("key", F.explode(F.array_distinct(prints)).alias("fp")).join(_small(marks, broadcast_rows), "fp", "left_semi").select("key").distinct()
        split = docs.join(found.withColumn("touched", F.lit(True)), "key", "left").select("key", "doc_id", words(F.col("text")).alias("ws"), F.coalesce("touched", F.lit(False)).alias("touched"))
    # Words are kept of the documents that share a fingerprint, which are then compared on all their windows.
    seen = written(split.select("key", "doc_id", F.size("ws").cast("long").alias("n_words"), F.when(F.col("touched"), F.col("ws")).alias("ws")), "touched")
    sought = reduce(DataFrame.unionByName, [items.where(F.col("len") == n).select("item_id", F.explode(windows(F.col("ws"), n)).alias("w")) for n in lengths])
    sought = _small(written(sought.select("item_id", F.col("w.gram").alias("gram"), F.col("w.len").alias("len")).distinct(), "sought"), broadcast_rows, "gram")
    mine = seen.where(F.col("ws").isNotNull()).select("key", F.explode(F.concat(*[windows(F.col("ws"), n) for n in lengths])).alias("w")).select("key", "w.pos", "w.len", "w.gram")
    hits = mine.join(sought, ["gram", "len"]).select("key", F.col("item_id").cast("string").alias("item_id"), F.struct("pos", "len").alias("span"))
    by_doc = hits.groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("ids"), F.array_sort(F.collect_set("span")).alias("spans"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def cover(acc: Column, s: Column) -> Column:
        end = s["pos"] + s["len"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["pos"]))).alias("n"), F.greatest(acc["end"], end).alias("end"))

    by_doc = by_doc.select("key", F.aggregate("spans", start, cover)["n"].cast("long").alias("hit"), F.size("ids").cast("long").alias("items"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("sha"))
    zero = F.lit(0).cast("long")
    out = seen.join(by_doc, "key", "left").select("key", "doc_id", "n_words", F.coalesce("hit", zero).alias("n_hit"), F.coalesce("items", zero).alias("n_items"), F.coalesce("sha", none).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without its contaminated rows, columns as they were; rows with equal doc_id and text go together."""
    verdict = compared(docs.select("doc_id", "text"), items)
    name = "_bad" + "_" * max(map(len, docs.columns))  # no column of docs has this name
    bad = written(verdict.where("contaminated").select(F.col("key").alias(name)).distinct(), "contaminated")
    return docs.join(_small(bad, BROADCAST_IDS), _key() == F.col(name), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
il AS (SELECT item_id, ws, least(len(ws), 13) AS n FROM i WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[p:p + n - 1], ' ') AS gram
       FROM (SELECT item_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS p FROM il)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT rid, n, p, array_to_string(ws[p:p + n - 1], ' ') AS gram
       FROM (SELECT rid, n, ws, unnest(range(1, len(ws) - n + 2)) AS p FROM d, lens WHERE len(ws) >= n)),
h AS (SELECT rid, n, p, item_id FROM dw JOIN iw USING (n, gram)),
c AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS pos FROM h) GROUP BY rid),
s AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM h) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN s USING (rid)
"""
