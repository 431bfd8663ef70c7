"""Collocations of two and three words by pivot partitioning.

Texts are cut into pieces and words and written once as chunks of word codes with their own
word lists. Word counts of all chunks add up to the frequencies of the corpus; words below the
least count can be in no candidate and become gaps, the others get ids in one order over all
languages: falling frequency, then language and word. Each chunk gets back the ids of its own
words by a join; no dictionary of the corpus is broadcast.

Of an n-gram the rarest word, that with the largest id, is its pivot. Around every occurrence
of a word the text is rewritten to what the n-grams that this occurrence owns can use: up to
two words on either side, as far as they are no rarer than the pivot; to the left an equal word
ends the fragment too, as the n-gram then belongs to that earlier occurrence. Equal fragments
of a chunk are counted, which leaves few for frequent words, and routed to the pivot's
partition as ids. Pivots with more than SALT_ROWS occurrences are dealt to several partitions
by their fragments. A partition mines its fragments alone; an n-gram comes only from its
pivot's partition, so its count is final there, but for dealt pivots, whose partial counts are
added up once more.

Counts are exact over all texts; scores are made with decimals of 38 digits.

Edge cases: null texts are empty, null languages are `und`; repeated rows count as often as
they are there; texts of any length are taken whole, and a very long one makes a chunk of its
own; an empty table gives no rows; further columns are ignored. Words may hold any character
but space, tab and the piece marks. More than 2^31 frequent words raise an error.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, lean, table, tidy, written

LEAST, TOP, ABSORBED_PERCENT = 10, 2000, 50
#: Words of a chunk at most, but for longer texts, and different words of all languages after which chunks end.
CHUNK_WORDS, CHUNK_VOCABULARY = 4_000_000, 600_000
#: Occurrences of a pivot that go to one partition, about.
SALT_ROWS = 1_000_000
#: Parts of a language whose best rows are found before those of the language.
RANK_PARTS = 16
#: Fixed values of the contract: what parts words, and what parts pieces.
GAPS, MARKS = " \t", ".,;:!?\n\x0b\x0c\r"
#: A mark in the word stream, with code 0; no word holds a capital once A-Z are lower-cased.
BREAK = b"A"
_TABLE = bytes.maketrans((UPPER + "\t" + MARKS).encode(), (LOWER + " " + "\n" * len(MARKS)).encode())

CHUNKS = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("size", pa.int64()), ("codes", pa.binary())])
FRAGMENTS = pa.schema([("pivot", pa.int64()), ("salt", pa.int32()), ("left", pa.int64()), ("right", pa.int64()), ("n", pa.int64())])
PACKED = 32
#: Pieces of codes that are rewritten at a time.
SLICE = 1_000_000


def stream(text: str) -> list[bytes]:
    """The words of a text in order, with BREAK where a piece ends."""
    return text.encode().translate(_TABLE).replace(b"\n", b" " + BREAK + b" ").split()


class _Chunk:
    """Codes of the texts of one language; word k of the list has code k + 1."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {BREAK: 0}
        self.codes: list[np.ndarray] = []
        self.size = 0

    def add(self, tokens: list[bytes]) -> None:
        at, words = pd.factorize(np.array(tokens, dtype=object))
        put = self.known.setdefault
        self.codes.append(np.array([put(w, len(self.known)) for w in words], np.int32)[at])
        self.size += len(tokens)

    def batch(self, chunk: int, lang: str) -> pa.RecordBatch:
        codes = np.concatenate(self.codes)
        counts = np.bincount(codes, minlength=len(self.known))[1:]
        words = [w.decode() for w in self.known][1:]
        packed = pa.compress(codes.tobytes(), "zstd", asbytes=True)
        return pa.RecordBatch.from_pydict({"chunk": [chunk], "lang": [lang], "words": [words], "counts": [counts], "size": [codes.nbytes], "codes": [packed]}, schema=CHUNKS)


def _coded(chunk_words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, _Chunk] = {}
    serial, first = 0, TaskContext.get().partitionId() << 32

    def flushed() -> Iterator[pa.RecordBatch]:
        nonlocal serial
        while held:
            lang, chunk = held.popitem()
            yield chunk.batch(first + serial, lang)
            serial += 1

    for b in batches:
        tokens: dict[str, list[bytes]] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            mine = tokens.setdefault(lang, [])
            mine += stream(text)
            mine.append(BREAK)
        if held and sum(c.size for c in held.values()) + sum(map(len, tokens.values())) > chunk_words:
            yield from flushed()
        for lang, mine in tokens.items():
            held.setdefault(lang, _Chunk()).add(mine)
        if sum(len(c.known) for c in held.values()) > CHUNK_VOCABULARY:
            yield from flushed()
    yield from flushed()


def fragments(r: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rewritten fragments (second left, left, pivot, right, second right; 0 for none) and how often each is there.

    r: ranks of a text's words, 1 for the most frequent word, 0 for those in no candidate and for breaks.
    """
    base = int(r.max(initial=0)) + 1
    r = np.concatenate([[0, 0], r, [0, 0]])
    a, b, w, d, e = r[:-4], r[1:-3], r[2:-2], r[3:-1], r[4:]
    left = np.where(b < w, b, 0)
    second_left = np.where((left > 0) & (a < w), a, 0)
    right = np.where(d <= w, d, 0)
    second_right = np.where((right > 0) & (e <= w), e, 0)
    use = (w > 0) & ((left > 0) | (right > 0))
    columns = [c[use].astype(np.int64) for c in (second_left, left, w, right, second_right)]
    key, top = columns[0], base
    for c in columns[1:]:
        if top > (1 << 62) // base:
            found, key = np.unique(key, return_inverse=True)
            top = len(found) + 1
        key, top = key * base + c, top * base
    _, at, n = np.unique(key, return_index=True, return_counts=True)
    return [c[at] for c in columns], n


def _rewritten(salt_rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            known = b.column("known")[i].values
            at, ids, f = (known.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            order = np.argsort(ids)
            names, parts = np.concatenate([[0], ids[order]]), np.concatenate([[0], -(-f[order] // salt_rows)])
            size = b.column("size")[i].as_py()
            codes = np.frombuffer(pa.decompress(b.column("codes")[i].as_buffer(), size, "zstd"), np.int32)
            ranks = np.zeros(max(int(codes.max(initial=0)), int(at.max(initial=0))) + 1, np.int32)
            ranks[at[order]] = np.arange(1, len(order) + 1)
            ranks = ranks[codes]
            gaps = np.flatnonzero(ranks == 0)
            cuts = [0]
            while len(ranks) - cuts[-1] > SLICE:  # at a gap, as no fragment goes over one
                after = np.searchsorted(gaps, cuts[-1] + SLICE)
                if after == len(gaps):
                    break
                cuts.append(int(gaps[after]))
            for first, last in zip(cuts, [*cuts[1:], len(ranks)], strict=True):
                (l2, l1, w, r1, r2), n = fragments(ranks[first:last])
                left, right = (names[l2] << PACKED) | names[l1], (names[r1] << PACKED) | names[r2]
                salt = np.where(parts[w] > 1, 1 + (left * 31 + right) % np.maximum(parts[w], 1), 0)
                for s in range(0, len(n), 100_000):
                    part = slice(s, s + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(names[w[part]]), pa.array(salt[part].astype(np.int32)), pa.array(left[part]), pa.array(right[part]), pa.array(n[part].astype(np.int64))], schema=FRAGMENTS)


def chunks(docs: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """docs (text, lang) as chunks of codes: chunk, lang, words, counts, size, codes."""
    lean(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(tidy(functools.partial(_coded, chunk_words)), "chunk long, lang string, words array<string>, counts array<long>, size long, codes binary")


def word_counts(coded: DataFrame) -> DataFrame:
    rows = coded.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    return rows.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))


def numbered(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, word, f and id, from 1 for the most frequent, of the words that are there `least` times."""
    order = [F.desc("f"), F.col("lang"), F.col("word")]
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranked = counts.where(F.col("f") >= least).repartitionByRange(*order).sortWithinPartitions(*order)
    ranked = written(ranked.select("lang", "word", "f", F.spark_partition_id().alias("part"), row.alias("row")), "ranked")
    sizes = ranked.groupBy("part").agg(F.count("*").alias("size"))  # a row for each partition of one shuffle
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("begin"))
    total = ranked.count()
    if total >= 1 << (PACKED - 1):
        raise ValueError(f"{total} frequent words are more than {1 << (PACKED - 1)}")
    return ranked.join(F.broadcast(begins), "part").select("lang", "word", "f", (F.col("begin") + F.col("row") + 1).alias("id"))


def routed(coded: DataFrame, words: DataFrame, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Fragments (pivot, salt, left, right, n) of all chunks; salt is 0 for pivots that aren't dealt."""
    mine = coded.select("chunk", "lang", F.posexplode("words").alias("at", "word"))
    known = mine.join(words, ["lang", "word"]).groupBy("chunk").agg(F.collect_list(F.struct((F.col("at") + 1).alias("at"), "id", "f")).alias("known"))
    return coded.select("chunk", "size", "codes").join(known, "chunk").mapInArrow(tidy(functools.partial(_rewritten, salt_rows)), "pivot long, salt int, left long, right long, n long")


def mined(parts: DataFrame, least: int = LEAST) -> DataFrame:
    """First, second and third id (0 for none) and a of all n-grams that are there `least` times, each from its pivot's fragments."""
    low = (1 << PACKED) - 1
    pivot, left, right = F.col("pivot"), F.col("left").bitwiseAND(low), F.shiftright("right", PACKED)
    far_left, far_right = F.shiftright("left", PACKED), F.col("right").bitwiseAND(low)

    def gram(when: Column, *ids: Column) -> Column:
        return F.when(when, F.struct(*(c.alias(k) for k, c in zip(("one", "two", "three"), [*ids, F.lit(0).cast("long")], strict=False))))

    grams = F.array(gram(left > 0, left, pivot), gram(right > 0, pivot, right), gram(far_left > 0, far_left, left, pivot), gram((left > 0) & (right > 0), left, pivot, right), gram(far_right > 0, pivot, right, far_right))
    dealt = parts.repartition("pivot", "salt").select("pivot", "salt", "n", F.explode(grams).alias("g")).where("g is not null")
    owned = dealt.groupBy("pivot", "salt", "g.one", "g.two", "g.three").agg(F.sum("n").alias("a"))
    owned = written(owned.where((F.col("salt") > 0) | (F.col("a") >= least)).select("one", "two", "three", "a", (F.col("salt") > 0).alias("partial")), "grams")
    summed = owned.where("partial").groupBy("one", "two", "three").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return owned.where("not partial").select("one", "two", "three", "a").unionByName(summed)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, absorbed_percent: int = ABSORBED_PERCENT, salt_rows: int = SALT_ROWS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """The best `top` collocations of each language of docs (text, lang): lang, rank, phrase, a, l, r, n, score."""
    coded = written(chunks(docs, chunk_words), "chunks")
    counts = written(word_counts(coded), "words")
    words = written(numbered(counts, least), "numbered")
    found = written(mined(routed(coded, words, salt_rows), least), "candidates")
    pairs, triples = found.where("three = 0").drop("three"), found.where("three > 0")
    front = F.struct(F.lit(True).alias("front"), F.col("one").alias("x"), F.col("two").alias("y"))
    back = F.struct(F.lit(False).alias("front"), F.col("two").alias("x"), F.col("three").alias("y"))
    sides = triples.select("one", "two", "three", "a", F.explode(F.array(front, back)).alias("side")).select("one", "two", "three", "a", "side.*")
    # Every pair within a candidate is a candidate.
    inner = written(sides.join(pairs.select(F.col("one").alias("x"), F.col("two").alias("y"), F.col("a").alias("pair_n")), ["x", "y"]), "inner")
    ends = inner.groupBy("one", "two", "three").agg(F.max("a").alias("a"), F.max(F.when(F.col("front"), F.col("pair_n"))).alias("front_n"), F.max(F.when(~F.col("front"), F.col("pair_n"))).alias("back_n"))
    absorbed = inner.where(100 * F.col("a") >= absorbed_percent * F.col("pair_n")).select(F.col("x").alias("one"), F.col("y").alias("two")).distinct()
    nothing = F.lit(None).cast("long")
    alone = pairs.join(absorbed, ["one", "two"], "left_anti").select("one", "two", F.lit(0).cast("long").alias("three"), "a", nothing.alias("front_n"), nothing.alias("back_n"))
    kept = alone.unionByName(ends).withColumn("last", F.when(F.col("three") > 0, F.col("three")).otherwise(F.col("two")))
    kept = kept.join(words.select(F.col("id").alias("one"), "lang", F.col("word").alias("word_1"), F.col("f").alias("first_n")), "one")
    kept = kept.join(words.select(F.col("id").alias("last"), F.col("word").alias("word_3"), F.col("f").alias("last_n")), "last")
    middle = kept.where("three > 0").join(words.select(F.col("id").alias("two"), F.col("word").alias("word_2")), "two")
    kept = kept.where("three = 0").withColumn("word_2", F.lit(None).cast("string")).unionByName(middle)

    def cut(k: int, left: Column, right: Column) -> Column:
        whole = [c.cast("decimal(38,0)") for c in (F.lit(1_000_000), F.col("a"), F.col("a"), left, right)]
        score = F.call_function("div", whole[0] * whole[1] * whole[2], whole[3] * whole[4])
        return F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))

    one, two = cut(1, F.col("first_n"), F.coalesce("back_n", "last_n")), cut(2, F.col("front_n"), F.col("last_n"))
    best = F.when(F.col("front_n").isNull(), one).otherwise(F.least(one, two))
    scored = kept.select("lang", F.concat_ws(" ", "word_1", "word_2", "word_3").alias("phrase"), "a", best.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best_first = (F.desc("score"), F.desc("a"), "phrase")
    # First the best of each of RANK_PARTS parts of a language, so that one task ranks top * RANK_PARTS rows at most, however many candidates there are.
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    scored = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best_first))).where(F.col("rank") <= top)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best_first))).where(F.col("rank") <= top)
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH p AS (
  SELECT row_number() OVER () AS id, lang, piece FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
      FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 10),
x AS (SELECT c.lang, c.phrase, c.a, c.k, j, l.a AS l, r.a AS r, ((1000000::HUGEINT * c.a * c.a) // (l.a::HUGEINT * r.a))::BIGINT AS score
      FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
      JOIN f l ON l.lang = c.lang AND l.k = c.j AND l.phrase = array_to_string(c.ws[1:c.j], ' ')
      JOIN f r ON r.lang = c.lang AND r.k = c.k - c.j AND r.phrase = array_to_string(c.ws[c.j + 1:], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
gone AS (SELECT DISTINCT s.lang, s.phrase FROM c s
         JOIN (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE k = 3) t
           ON s.lang = t.lang AND s.phrase = t.phrase AND 100 * t.a >= 50 * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b JOIN n USING (lang) ANTI JOIN gone USING (lang, phrase)
QUALIFY rank <= 2000
"""
