"""Language identification by compression with per-language zstandard dictionaries.

For every language a raw-content dictionary is made of labelled texts. A text is
lower-cased, reduced to its letters and cut into pieces of PIECE bytes; every piece
is compressed with each dictionary behind a passage of LEAD bytes of that language,
and counts for what it adds to the passage alone, so that frame headers and tables
don't drown short texts. The language with the smallest sum wins.
The verdict is rejected as too close when the runner-up's sum exceeds the winner's
by less than what texts in none of the languages show by chance: REJECT_MARGIN of it,
NOISE bytes for a match that happens to be there (times the bytes of a letter, as a match
spans whole letters), and FEW / letters bytes for what frames alone make of a few letters.
So ties and near-ties are rejected at every length. A text that no dictionary shortens,
against the same compressor without one, is rejected too; where only one language is
known, nothing but this decides, and NOISE bytes are let pass.

The dictionaries are fitted on a bounded sample: of the distinct labelled texts of a
language, held-out rows aside, the SAMPLE_DOCS of least hash, each whole.

Edge cases: a text that is null or has no letter is `und` with score 0; ties go
to the language with more labelled rows; rows with null lang are never learnt from;
without any labelled row everything is `und`; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, lean, table, tidy, written

SAMPLE_DOCS = 64
PIECE, LEAD = 8192, 800
#: Measured on sentences in scripts and languages without a dictionary and on random letters.
REJECT_MARGIN, NOISE, FEW = 0.02, 4, 20
#: Sampled rows (24 bytes each) up to which they are broadcast to find their texts.
BROADCAST_ROWS = 1_000_000

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower-cased words of letters with one space between them; empty if there is no letter."""
    found = _NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""
    return found if any(c.isalpha() for c in found[:64]) or any(c.isalpha() for c in found) else ""


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict[str, tuple[bytes, bytes]]:
    """Passage and dictionary content for each language of docs (doc_id, text, lang), held-out rows aside; most frequent first."""
    rows = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text", F.xxhash64("text").alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    distinct = rows.where(F.col("text").isNotNull()).select("lang", "h").distinct()
    least = Window.partitionBy("lang").orderBy("h")
    chosen = written(distinct.withColumn("k", F.row_number().over(least)).where(F.col("k") <= sample_docs).drop("k"), "sample")
    few = chosen.count() <= BROADCAST_ROWS
    found = rows.join(F.broadcast(chosen) if few else chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    learnt: dict[str, list[str]] = {}
    for r in found.orderBy("lang", "h").collect():  # sample_docs a language
        learnt.setdefault(r["lang"], []).append(letters(r["text"]))
    made = {lang: " ".join(t for t in texts if t).encode() for lang, texts in learnt.items()}
    return {lang: (made[lang][:LEAD], made[lang][LEAD:] or made[lang]) for lang in sorted(made, key=lambda x: (-counts[x], x)) if made[lang]}


class Sizes:
    """Compressed sizes of a text under each dictionary."""

    def __init__(self, dicts: dict[str, tuple[bytes, bytes]]):
        self.langs = list(dicts)
        self.with_dict: list[tuple[zstandard.ZstdCompressor, bytes, int]] = []
        self.without = zstandard.ZstdCompressor(compression_params=self._parameters(15))
        self.frame = len(self.without.compress(b""))
        for lead, content in dicts.values():
            p = self._parameters(min(27, max(15, (len(content) + LEAD + PIECE).bit_length())))
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            c = zstandard.ZstdCompressor(dict_data=d, compression_params=p)
            self.with_dict.append((c, lead + b" ", len(c.compress(lead + b" "))))

    @staticmethod
    def _parameters(window: int) -> zstandard.ZstdCompressionParameters:
        return zstandard.ZstdCompressionParameters(
            format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False, window_log=window, strategy=zstandard.STRATEGY_LAZY, hash_log=15, chain_log=15, search_log=3, min_match=4, target_length=8
        )

    def of(self, text: str) -> list[int]:
        pieces = self._pieces(text)
        return [sum(len(c.compress(lead + p)) - own for p in pieces) for c, lead, own in self.with_dict]

    def alone(self, text: str) -> int:
        """The size without any dictionary."""
        return sum(len(self.without.compress(p)) - self.frame for p in self._pieces(text))

    @staticmethod
    def _pieces(text: str) -> list[bytes]:
        data = text.encode()
        return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


def judge(sizes: Sizes, text: str | None) -> tuple[str, float, bool]:
    """Language, score from 0 to 1, and whether the verdict is rejected."""
    found = letters(text)
    if not found or not sizes.langs:
        return "und", 0.0, True
    n = sizes.of(found)
    order = sorted(range(len(n)), key=lambda i: (n[i], i))
    best = n[order[0]]
    chance = REJECT_MARGIN * best + NOISE * len(found.encode()) / len(found) + FEW / len(found)
    close = len(n) > 1 and n[order[1]] - best < chance
    close = close or best >= sizes.alone(found) + (NOISE if len(n) == 1 else 0)
    weight = sum(math.exp(-min(60.0, 0.5 * (x - best))) for x in n)
    return sizes.langs[order[0]], 1 / weight, close


def identify(docs: DataFrame, dicts: dict[str, tuple[bytes, bytes]]) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, held_out, lang_pred, score, rejected."""

    @tidy
    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = Sizes(dicts)
        for b in batches:
            got = [judge(sizes, t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": [x[0] for x in got], "score": [x[1] for x in got], "rejected": [x[2] for x in got]})

    lean(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInPandas(over, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, dicts: dict[str, tuple[bytes, bytes]]) -> DataFrame:
    """The rows of docs, whole and as they were, whose verdict is not rejected."""

    at = docs.columns.index("text")

    @tidy
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(dicts)
        for b in batches:
            yield b.filter(pa.array([not judge(sizes, t)[2] for t in b.column(at).to_pylist()], pa.bool_()))

    lean(docs.sparkSession)
    return docs.mapInArrow(over, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs.select("doc_id", "text", "lang")))
