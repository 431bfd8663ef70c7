"""Token counts of sections and fields from one encoding of the whole document.

A document is encoded once. The byte span of every token is joined with the
spans of the sections by binary search over their bounds, and a token that
crosses a bound goes where RULES says:

  first    to the section that holds its first byte
  largest  to the section that holds most of its bytes, the earlier one on a tie
  share    to every section it touches, in proportion to its bytes there

so that the counts of a document's sections always add up to its tokens.

Edge cases: a null or empty text is one empty section without tokens; an empty
section (two bounds at one place) gets no token; a character that is split into
several tokens counts as the bytes of each; text of any length is encoded whole;
repeated rows each give their own sections; further columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from .common import lean, table, tidy

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before this vocabulary's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("first", "largest", "share")
#: White space in runs too long for the pattern's engine; such a run but its last character is one piece anyway.
_LONG = re.compile("[ \\t-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{4000,}")


class Encoder:
    def __init__(self, ranks_path: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, i in ranks.items():
            self.length[i] = len(piece)

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        for m in _LONG.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            out += self.encoding.encode_ordinary(text[at : m.start()])
            out += self.encoding._encode_single_piece(text[m.start() : end])
            at = end
        return out + self.encoding.encode_ordinary(text[at:]) if at else self.encoding.encode_ordinary(text)

    def ends(self, text: str) -> np.ndarray:
        """Byte offset behind each token."""
        return np.cumsum(self.length[np.asarray(self.ids(text), np.int64)])


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str = "largest") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross a bound.

    ends: byte offsets behind the tokens; bounds: byte offsets 0 = b0 <= b1 ... <= length of the n + 1 section bounds.
    """
    n = len(bounds) - 1
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    first = np.searchsorted(bounds[1:], starts, "right")  # the section of the first byte
    last = np.searchsorted(bounds[1:], ends - 1, "right")
    cross = first != last
    counts = np.bincount(first[~cross], minlength=n).astype(float)
    crossing = np.zeros(n, np.int64)
    for s, e, i, j in zip(starts[cross], ends[cross], first[cross], last[cross], strict=True):
        parts = np.minimum(bounds[i + 1 : j + 2], e) - np.maximum(bounds[i : j + 1], s)
        if rule == "share":
            counts[i : j + 1] += parts / (e - s)
            crossing[i : j + 1] += parts > 0
        else:
            to = i if rule == "first" else i + int(parts.argmax())
            counts[to] += 1
            crossing[to] += 1
    return counts, crossing


def lines(text: str) -> list[tuple[str, int]]:
    """Sections of plain text: (name, length) of each line with its line break."""
    return [("line", len(x)) for x in re.findall(r"[^\n]*\n|[^\n]+", text)]


def count(docs: DataFrame, rule: str = "largest", ranks_path: str = RANKS, sections: Callable[[str], list[tuple[str, int]]] = lines, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each section of each document: its id, section (from 0), name, start and length in characters, n_tokens, n_crossing."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    whole = rule != "share"

    @tidy
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        for b in batches:
            rows: list[tuple] = []
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py() or ""
                parts = sections(text) or [("line", 0)]
                size = np.array([0, *(x[1] for x in parts)], np.int64)
                chars = np.cumsum(size)
                if text.isascii():
                    bounds = chars
                else:
                    raw = np.frombuffer(text.encode(), np.uint8)
                    bounds = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))[chars]
                got, crossing = attribute(enc.ends(text), bounds, rule)
                rows.append((i, parts, chars, got, crossing))
                if len(rows) == 512 or i == b.num_rows - 1:
                    n = [len(r[1]) for r in rows]
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column(0).take(pa.array(np.repeat([r[0] for r in rows], n))),
                            pa.array(np.concatenate([np.arange(x) for x in n]), pa.int32()),
                            pa.array([p[0] for r in rows for p in r[1]], pa.string()),
                            pa.array(np.concatenate([r[2][:-1] for r in rows]), pa.int64()),
                            pa.array(np.concatenate([np.diff(r[2]) for r in rows]), pa.int64()),
                            pa.array(np.concatenate([r[3] for r in rows])).cast(pa.int64() if whole else pa.float64()),
                            pa.array(np.concatenate([r[4] for r in rows]), pa.int64()),
                        ],
                        names=["id", "section", "name", "start_char", "n_chars", "n_tokens", "n_crossing"],
                    )
                    rows = []

    lean(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    out = docs.select(id_col, text_col).mapInArrow(over, f"id {kind}, section int, name string, start_char long, n_chars long, n_tokens {'long' if whole else 'double'}, n_crossing long")
    return out.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(table(spark, sf_dir, "documents"))
