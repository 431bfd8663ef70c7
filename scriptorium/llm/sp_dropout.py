"""SentencePiece encoding with seeded merge-dropout, and decoding.

Encoding follows the agenda of a BPE model: of all adjacent pairs that form a
piece the one with the best score, the leftmost on a tie, is merged next. With
dropout a candidate is skipped when it comes up if a keyed hash of (seed, document,
segment of the document, how many candidates came up before in the segment) falls
below `dropout`; a new pair that a neighbour's merge makes is a new candidate. So
every occurrence of a word has draws of its own, and everything repeats for a seed.

Where two neighbouring characters stand side by side in no piece of the model nothing
can merge across, so that a document falls into segments that merge independently.
What a segment becomes depends on its characters and on which of its candidates are
skipped: results are kept by a 64-bit hash of both in a bounded table, and computed, all
in step with numpy, where they aren't there. An occurrence starts from the result without
skips; its draws for the candidates of that run tell the first skip, which leads to the
result with that skip, and so on. As every document is decoded again, a document that two
equal hashes spoil is seen, and encoded anew segment by segment.

Edge cases: null or empty text gives no ids; decode(encode(t)) == t for every
text: characters without a piece, and U+2581, which stands for the space in
pieces, are encoded as bytes; repeated documents with one doc_id get equal ids;
a null doc_id counts as one id; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
DROPOUT, SEED = 0.1, 42
#: Characters worked on at once, rows encoded at once, segments merged in step; entries kept, longest segment that is kept; longest segment merged without a heap.
_CHUNK, _ROWS, _BLOCK, _KEPT_MOST, _KEPT_WIDTH, _LONG = 200_000, 96, 8192, 350_000, 16, 64
_NONE, _PAD = np.int32(2**31 - 1), np.int32(-(2**31))
_U = np.uint64
_FULL, _STEP = 2**64 - 1, 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64 bits (fixed constants of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _mix_one(x: int) -> int:
    """_mix of one number."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _FULL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _FULL
    return x ^ x >> 31


class Codec:
    def __init__(self, model_path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        self.byte_id = [0] * 256
        self.raw: list[bytes] = []
        normal: dict[str, int] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                normal[piece] = i
                self.raw.append(piece.replace(SPACE, " ").encode())
        self.char_id = np.full(0x110000, -1, np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.char_id[ord(" " if p == SPACE else p)] = i
        # Which characters are neighbours in some piece; 0 stands for all that are in none.
        chars = {c: k + 1 for k, c in enumerate(sorted(set("".join(normal))))}
        self.char_no = np.zeros(0x110000, np.int32)
        for c, k in chars.items():
            self.char_no[ord(" " if c == SPACE else c)] = k
        self.char_no[ord(SPACE)] = 0
        self.side = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p in normal:
            for x, y in zip(p, p[1:], strict=False):
                self.side[chars[x], chars[y]] = True
        by_score = sorted((i for p, i in normal.items() if len(p) > 1), key=lambda i: (-sp.get_score(i), i))
        self.of_rank = np.array(by_score, np.int32)
        rank = {i: k for k, i in enumerate(by_score)}
        keys, ranks = [], []
        for p, i in normal.items():
            for cut in range(1, len(p)):
                left, right = normal.get(p[:cut]), normal.get(p[cut:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    ranks.append(rank[i])
        self.pairs = dict(zip(keys, ranks, strict=True))
        # The same for numpy: buckets as wide as the fullest.
        key = np.array(keys or [-1], np.int64)
        self.bits = max(4, len(key).bit_length() + 2)
        bucket = self._bucket(key)
        order = np.argsort(bucket, kind="stable")
        inside = np.arange(len(key)) - np.searchsorted(bucket[order], bucket[order])
        shape = (1 << self.bits, int(inside.max()) + 1)
        self.t_key, self.t_rank = np.full(shape, -1, np.int64), np.full(shape, _NONE, np.int32)
        self.t_key[bucket[order], inside], self.t_rank[bucket[order], inside] = key[order], np.array(ranks or [_NONE], np.int32)[order]
        self.kept = Kept()

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _U(_STEP)) >> _U(64 - self.bits)).astype(np.int64)

    # -------------------------------------------------------------- merging
    def _symbols(self, points: np.ndarray) -> list[int]:
        """Ids of characters; -1 - c for a character c without a piece."""
        ids = self.char_id[points]
        return np.where(ids < 0, -1 - points.astype(np.int64), ids).tolist()

    def _told(self, sym: list[int]) -> list[int]:
        """Ids of symbols, characters without a piece as bytes."""
        if min(sym) >= 0:
            return sym
        out: list[int] = []
        for s in sym:
            if s >= 0:
                out.append(s)
            else:
                out += [self.byte_id[x] for x in chr(-1 - s).encode()]
        return out

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge; _NONE if it forms no piece."""
        key = left.astype(np.int64) << 20 | right
        at = self._bucket(key)
        return np.where(self.t_key[at] == key[:, None], self.t_rank[at], _NONE).min(1)

    def merge(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray, skipped: list[np.ndarray], own: np.ndarray | None = None, limit: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segments points[start : start + size], all in step: their ids one behind the other, how many each has, and how many candidates came up.

        Candidate number k of a segment is skipped if k stands in one of its columns of `skipped`, or, where `own`
        is given, if its draw falls below limit.
        """
        n, width = len(starts), int(sizes.max()) + 1
        col = np.arange(width)
        char = points[np.minimum(starts[:, None] + col, len(points) - 1)]
        ids = self.char_id[char]
        sym = np.where(ids < 0, np.int32(-1) - char.astype(np.int32), ids)
        sym[col >= sizes[:, None]] = _PAD
        rank = self.look(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, width - 1)
        final, asked, rows, step = np.empty_like(sym), np.empty(n, np.int16), np.arange(n), 0
        while True:
            at = rank.argmin(1)
            best = rank[np.arange(len(rows)), at]
            live = best != _NONE
            if not live.all():
                final[rows[~live]], asked[rows[~live]] = sym[~live], step
                rows, at, best, sym, rank = rows[live], at[live], best[live], sym[live], rank[live]
                if not len(rows):
                    break
            skip = np.zeros(len(rows), bool)
            for k in skipped:
                skip |= k[rows] == step
            if own is not None:
                skip |= _mix(own[rows] + _U((step + 1) * _STEP & _FULL)) < _U(limit)
            step += 1
            rank[skip, at[skip]] = _NONE
            m = np.flatnonzero(~skip)
            a, s, r, line = at[m], sym[m], rank[m], np.arange(len(m))
            s[:, :-1] = np.where(col[:-1] > a[:, None], s[:, 1:], s[:, :-1])
            s[line, a] = self.of_rank[best[m]]
            r[:, :-1] = np.where(col[:-2] > a[:, None], r[:, 1:], r[:, :-1])
            r[:, -1] = _NONE
            inner = np.flatnonzero(a > 0)
            new = self.look(np.concatenate([s[line, a], s[inner, a[inner] - 1]]), np.concatenate([s[line, a + 1], s[inner, a[inner]]]))
            r[line, a], r[inner, a[inner] - 1] = new[: len(m)], new[len(m) :]
            sym[m], rank[m] = s, r
        alive = final != _PAD
        flat, count = final[alive], alive.sum(1)
        raw = np.flatnonzero(flat < 0)
        if len(raw):
            told = [[self.byte_id[x] for x in chr(-1 - c).encode()] for c in flat[raw].tolist()]
            long = np.ones(len(flat), np.int64)
            long[raw] = list(map(len, told))
            count = np.bincount(np.repeat(np.arange(n), count), long, n).astype(np.int64)
            flat = np.repeat(flat, long)
            flat[flat < 0] = np.fromiter(chain.from_iterable(told), np.int32)
        return flat, count, asked

    def merge_long(self, sym: list[int], own: int, limit: int) -> list[int]:
        """Ids of a segment of any length with a heap; own: what the draws of this occurrence are keyed by."""
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []
        gone = -1 - 0x110000

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n and (r := self.pairs.get(sym[i] << 20 | sym[j])) is not None:
                heapq.heappush(heap, (r, i, sym[i], sym[j]))

        for i in range(n - 1):
            offer(i)
        asked = 0
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            asked += 1
            if limit and _mix_one(own + asked * _STEP & _FULL) < limit:
                continue
            sym[i], sym[j], nxt[i] = int(self.of_rank[r]), gone, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            offer(i)
            if prv[i] >= 0:
                offer(prv[i])
        return self._told([s for s in sym if s != gone])

    def _bounds(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Code points, and where segments begin."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        no = self.char_no[points]
        return points, np.flatnonzero(np.concatenate([[True], ~self.side[no[:-1], no[1:]]]))

    def _parts(self, text: str) -> Iterator[str]:
        """A text that starts with a space, cut into parts of about _CHUNK characters where a segment begins."""
        at = 0
        while len(text) - at > 2 * _CHUNK:
            to = at + _CHUNK
            while to < len(text) and self.side[self.char_no[ord(text[to - 1])], self.char_no[ord(text[to])]]:
                to += 1
            yield text[at:to]
            at = to
        yield text[at:]

    def _of_segments(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray, own: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments one behind the other, and how many each has."""
        kept = self.kept
        if kept.n > _KEPT_MOST:
            kept.empty()
        entry = np.zeros(len(starts), np.int64)
        live = np.flatnonzero(sizes <= _KEPT_WIDTH)
        inside = np.arange(len(points), dtype=np.uint64) - np.repeat(starts.astype(np.uint64), sizes)
        name = np.add.reduceat(_mix(points + (inside << _U(32))), starts)
        name = _mix(name[live] + _U(1))
        since, skipped = np.zeros(len(live), np.int16), []
        while len(live):  # each round adds one skipped candidate to those that have a further one
            names, where, of = np.unique(name, return_index=True, return_inverse=True)
            found = kept.find(names)
            new = np.flatnonzero(found < 0)
            for i in range(0, len(new), _BLOCK):
                one = new[i : i + _BLOCK]
                pick = where[one]
                found[one] = kept.add(names[one], *self.merge(points, starts[live[pick]], sizes[live[pick]], [k[pick] for k in skipped]))
            entry[live] = found[of]
            if dropout <= 0:
                break
            who, k = _first_skips(own[live], since, kept.asked[found[of]], dropout)
            live, skipped = live[who], [*(x[who] for x in skipped), k]
            name, since = _mix(name[who] + (k.astype(np.uint64) + _U(1)) * _U(_STEP)), k + np.int16(1)
        kept.mark()  # what is added from here on is for this call only
        limit = min(_FULL, int(dropout * 2**64))
        long = np.flatnonzero((sizes > _KEPT_WIDTH) & (sizes <= _LONG))
        for i in range(0, len(long), _BLOCK // 8):
            one = long[i : i + _BLOCK // 8]
            entry[one] = kept.add(None, *self.merge(points, starts[one], sizes[one], [], own[one] if limit else None, limit))
        for i in np.flatnonzero(sizes > _LONG).tolist():
            ids = self.merge_long(self._symbols(points[starts[i] : starts[i] + sizes[i]]), int(own[i]), limit)
            entry[i] = kept.add(None, np.array(ids, np.int32), np.array([len(ids)]), np.zeros(1, np.int16))[0]
        out = kept.ids_of(entry)
        kept.back()
        return out

    def encode_many(self, texts: list[str | None], keys: list[int], dropout: float = DROPOUT, seed: int = SEED) -> list[np.ndarray]:
        """The ids of each text; keys: 64-bit numbers that stand for each document in the draws."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        done = [0] * len(texts)  # segments so far
        waiting: list[tuple[int, str]] = []
        held = 0

        def flush() -> None:
            part_sizes = np.fromiter((len(part) for _, part in waiting), np.int64, len(waiting))
            first = np.cumsum(part_sizes) - part_sizes
            points, starts = self._bounds("".join(part for _, part in waiting))
            starts = np.union1d(starts, first)
            sizes = np.diff(np.append(starts, len(points)))
            at_doc = np.searchsorted(starts, first)  # the first segment of each part
            count = np.diff(np.append(at_doc, len(starts)))
            order = np.arange(len(starts)) + np.repeat(np.array([done[i] for i, _ in waiting]) - at_doc, count)
            doc = _mix(np.array([(seed * _STEP + keys[i]) & _FULL for i, _ in waiting], np.uint64))
            own = _mix(order.astype(np.uint64) * _U(_STEP) + np.repeat(doc, count))
            flat, n = self._of_segments(points, starts, sizes, own, dropout)
            ends = np.cumsum(n)[np.append(at_doc[1:], len(starts)) - 1]
            for (i, _), ids_of, c in zip(waiting, np.split(flat, ends[:-1]), count.tolist(), strict=True):
                out[i].append(ids_of)
                done[i] += c
            waiting.clear()

        for i, text in enumerate(texts):
            for part in self._parts(" " + text) if text else ():
                waiting.append((i, part))
                held += len(part)
                if held >= _CHUNK:
                    flush()
                    held = 0
        if waiting:
            flush()
        none = np.zeros(0, np.int32)
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else none for x in out]

    def encode(self, text: str | None, key: int = 0, dropout: float = 0.0, seed: int = SEED) -> list[int]:
        return self.encode_many([text], [key], dropout, seed)[0].tolist()

    def encode_singly(self, text: str, key: int, dropout: float = DROPOUT, seed: int = SEED) -> list[int]:
        """What encode gives, segment by segment with nothing kept."""
        points, starts = self._bounds(" " + text)
        doc = _mix_one((seed * _STEP + key) & _FULL)
        out: list[int] = []
        for order, (s, e) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(points)], strict=True)):
            out += self.merge_long(self._symbols(points[s:e]), _mix_one(order * _STEP + doc & _FULL), min(_FULL, int(dropout * 2**64)))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


class Kept:
    """Ids of segments by a 64-bit name in flat arrays of bounded size; emptied when full."""

    def __init__(self) -> None:
        self.empty()

    def empty(self) -> None:
        self.n, self.end = 0, 0
        self._slots(17)
        self.start, self.size, self.asked = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int16)
        self.ids = np.zeros(1 << 18, np.int32)

    def _slots(self, bits: int) -> None:
        self.bits = bits
        self.names, self.at = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def find(self, names: np.ndarray) -> np.ndarray:
        """Entry of each name; -1 where there is none."""
        out = np.full(len(names), -1, np.int64)
        todo, slot = np.arange(len(names)), (names >> _U(64 - self.bits)).astype(np.int64)
        while len(todo):
            entry = self.at[slot]
            hit = (entry >= 0) & (self.names[slot] == names[todo])
            out[todo[hit]] = entry[hit]
            more = ~hit & (entry >= 0)
            todo, slot = todo[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return out

    def _enter(self, names: np.ndarray, entries: np.ndarray) -> None:
        todo, slot = np.arange(len(names)), (names >> _U(64 - self.bits)).astype(np.int64)
        while len(todo):
            free = self.at[slot] < 0
            self.at[slot[free]] = entries[todo[free]]
            won = self.at[slot] == entries[todo]
            self.names[slot[won]] = names[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def add(self, names: np.ndarray | None, flat: np.ndarray, count: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Entries of new names, whose ids stand in flat one behind the other, and how many candidates each asked for."""
        n, k = self.n, len(count)
        while n + k > len(self.start):
            self.start, self.size, self.asked = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.asked))
        while self.end + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.start[n : n + k] = self.end + np.cumsum(count) - count
        self.size[n : n + k], self.asked[n : n + k] = count, asked
        self.ids[self.end : self.end + len(flat)] = flat
        self.n, self.end = n + k, self.end + len(flat)
        entries = np.arange(n, n + k)
        if names is not None:
            if self.n > 0.7 * (1 << self.bits):
                old, there = self.names[self.at >= 0], self.at[self.at >= 0]
                self._slots(self.bits + 1)
                self._enter(old, there)
            self._enter(names, entries)
        return entries

    def mark(self) -> None:
        self.kept_n, self.kept_end = self.n, self.end

    def back(self) -> None:
        self.n, self.end = self.kept_n, self.kept_end

    def ids_of(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.size[entries].astype(np.int64)
        behind = np.cumsum(n)
        return self.ids[np.repeat(self.start[entries] - (behind - n), n) + np.arange(behind[-1])], n


def _first_skips(own: np.ndarray, since: np.ndarray, asked: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Which occurrences skip a candidate numbered since..asked - 1, and the first that they skip."""
    n = np.maximum(asked - since, 0).astype(np.int64)
    of = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n - since, n)
    hit = np.flatnonzero(_mix(own[of] + (k.astype(np.uint64) + _U(1)) * _U(_STEP)) < _U(min(_FULL, int(dropout * 2**64))))
    if len(hit):
        hit = hit[np.concatenate([[True], of[hit[1:]] != of[hit[:-1]]])]
    return of[hit], k[hit].astype(np.int16)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, model_path: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, ids, n_tokens, lossless (decoding gave the text again)."""

    @tidy
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for b in batches:
            for i in range(0, b.num_rows, _ROWS):
                part = b.slice(i, _ROWS)
                texts = part.column(1).to_pylist()
                keys = [xxhash.xxh3_64_intdigest(str(x)) for x in part.column(0).to_pylist()]
                ids = c.encode_many(texts, keys, dropout, seed)
                lossless = [c.decode(x.tolist()) == (t or "") for x, t in zip(ids, texts, strict=True)]
                for j in (j for j, fine in enumerate(lossless) if not fine):
                    ids[j] = np.array(c.encode_singly(texts[j], keys[j], dropout, seed), np.int32)
                    lossless[j] = c.decode(ids[j].tolist()) == texts[j]
                ends = np.cumsum([0, *map(len, ids)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(np.diff(ends), pa.int64()), pa.array(lossless)], names=["doc_id", "ids", "n_tokens", "lossless"])

    lean(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(over, f"doc_id {kind}, ids array<int>, n_tokens long, lossless boolean")


def decode(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id and text of rows (doc_id, ids)."""

    @tidy
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(over, f"doc_id {kind}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
