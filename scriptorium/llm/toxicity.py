"""Toxicity of obfuscated text: a noisy channel is undone, then the restored text is scored.

A token that holds a sign or digit that may stand for a letter, a repeated letter or signs
between letters, and a stretch of three or more tokens of at most two characters, becomes a
lattice: each run of equal characters offers the strings it may stand for, nothing, or a word
boundary, each space a boundary or nothing, a sign that masks a letter each vowel, each with a
channel cost. The path of least cost
under a character trigram model, found by Viterbi over all states, is the restored text; a token
of digits alone may stay a number instead. Other tokens have one path and are left as they are.
Words and word beginnings of the restored text, as present or absent, feed a logistic regression.

The character model counts the trigrams of all texts, each whole. The regression is fitted on
at most SAMPLE_ROWS labelled rows chosen by hash, held-out rows aside, with the FEATURES most
telling features (by likelihood ratio, at least LEAST_TELL in LEAST_DOCS texts). Every text is
scored whole.

Edge cases: null and empty texts get the score of a text without features; without labels of
both kinds the score is 0 throughout; null labels are left out, of several labels of a doc_id the
largest counts, and of several texts the one with the smallest hash; repeated documents get equal scores; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, lean, table, tidy, written

#: Distinct tokens, and characters in them, that a task holds before it tells their trigrams.
HELD_WORDS, HELD_CHARS = 250_000, 10_000_000
SAMPLE_ROWS, FEATURES, LEAST_DOCS, LEAST_TELL = 20_000, 3000, 3, 12.0
THRESHOLD, RIDGE = 0.3, 0.03

#: What signs may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i"}
MASKS, VOWELS = "*#_%", "aeiou"
BETWEEN = frozenset(".-_*~^'`·•/\\,:;\"#%&=?)]}>[{“”«»„")
_LEAD, _TRAIL = "\"'[{*#%&.,;:?-_~`«»“”„", "\"')]}>*#%&.,;:?-_~`«»“”"
_ODD = re.compile(r"[0-9@$!|+(<€£¡]")
_WORD = re.compile(r"[^\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")
_AGAIN = re.compile(r"([^\W\d_])\1")
_INSIDE = re.compile(r"[^\W\d_](?:[^\w\s]|_)+[^\W\d_]")
_SHORT = re.compile(r"(?<!\S)\S{1,2}(?:[ \t]\S{1,2}){2,}(?!\S)")
_SPLIT = re.compile(r"[\s\-/]+")
#: Channel costs: a sign for a letter inside or at the edge of a token, a run of signs for one letter or two, a repeated letter
#: for one, a doubled one for one; a sign that means nothing inside, behind and before a
#: word, and each of those rarely put at an edge; a sign for a boundary; digits that
#: stay digits, each of them; spaces that mean nothing between single characters and between others; a number and each digit.
SIGN, EDGE_SIGN, SIGNS_ONE, SIGNS_TWO, STRETCHED, DOUBLED = 0.7, 1.2, 1.2, 0.9, 0.3, 2.0
NOTHING, EDGE_NOTHING, LEAD_NOTHING, ODD_EDGE_NOTHING, BREAK, DIGITS, DIGIT = 0.4, 0.1, 0.8, 1.0, 0.6, 4.0, 2.3
JOIN_SINGLE, JOIN, NUMBER = 0.3, 3.0, 2.0
#: A sign inside a word for a vowel that it hides.
MASKED = 1.5


START, END = "\x02", "\x03"


class CharModel:
    """Interpolated character trigrams over words; \\x02 starts and \\x03 ends a word."""

    def __init__(self, counts: dict[str, int]):
        self.three: Counter = Counter(counts)
        self.two: Counter = Counter()
        self.one: Counter = Counter()
        self.head: Counter = Counter()
        for g, n in self.three.items():
            self.two[g[1:]] += n
            self.one[g[2]] += n
            self.head[g[:2]] += n
        self.mid: Counter = Counter()
        for g, n in self.two.items():
            self.mid[g[0]] += n
        self.total = sum(self.one.values()) or 1
        self.costs: dict[str, float] = {}

    def cost(self, a: str, b: str, c: str) -> float:
        g = a + b + c
        if (got := self.costs.get(g)) is None:
            p3 = self.three[g] / self.head[a + b] if self.head[a + b] else 0.0
            p2 = self.two[b + c] / self.mid[b] if self.mid[b] else 0.0
            p1 = (self.one[c] + 0.5) / (self.total + 100)
            got = self.costs[g] = -math.log(0.8 * p3 + 0.15 * p2 + 0.05 * p1)
        return got


def trigrams(texts: list[str]) -> Counter:
    return spelled(Counter(w for t in texts for w in _WORD.findall(t.lower())))


def words_of(found: dict[str, int]) -> Counter:
    """Lower-case words of tokens that occur so many times: no word goes over white space."""
    out: Counter = Counter()
    for t, n in found.items():
        if t.isalpha():
            out[t] += n
        else:
            for w in _WORD.findall(t):
                out[w] += n
    return out


def spelled(words: dict[str, int]) -> Counter:
    """Trigrams of lower-case words that occur so many times."""
    found: defaultdict = defaultdict(int)
    for w, n in words.items():
        w = f"{START}{START}{w}{END}"
        for i in range(len(w) - 2):
            found[w[i : i + 3]] += n
    return Counter(found)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters what it may stand for (" ": a word boundary), with the channel costs."""
    out: list[list[tuple[str, float]]] = []
    i, size = 0, len(token)
    while i < size:
        c, j = token[i], i
        while j < size and token[j] == c:
            j += 1
        n = j - i
        edge = i == 0 or j == size or token[i - 1].isspace() or token[j].isspace()
        if c.isspace():
            single = (i < 2 or token[i - 2].isspace()) and (j > size - 2 or token[j + 1].isspace())
            ways = [(" ", 0.0), ("", JOIN_SINGLE if single else JOIN)]
        elif c.isalpha():
            ways = [(c, 0.0 if n == 1 else DOUBLED if n == 2 else STRETCHED)]
            if n > 1:
                ways.append((c + c, 0.0 if n == 2 else 2 * STRETCHED))
        else:
            ways = []
            for m in LEET.get(c, ""):
                ways.append((m, SIGNS_ONE if n > 1 else EDGE_SIGN if edge and not c.isdigit() else SIGN))
                if n > 1:
                    ways.append((m + m, SIGNS_TWO))
            if c.isalnum():
                ways.append((c * n, DIGITS))
            else:
                ways.append(("", NOTHING if not edge else ODD_EDGE_NOTHING * n if c in "$@+€£¡" else LEAD_NOTHING if j < size and not token[j].isspace() and c in LEET else EDGE_NOTHING))
                if not edge:
                    ways.append((" ", BREAK))
                    if c in MASKS and n == 1:
                        ways += [(m, MASKED) for m in VOWELS]
        out.append(ways)
        i = j
    return out


def path_cost(said: str, lm: CharModel) -> float:
    """What the model charges for restored text: words letter by letter, characters that are none at a flat rate."""
    total, a, b = 0.0, START, START
    for c in said:
        total, a, b = _next(total, a, b, c, lm)
    return total + (lm.cost(a, b, END) if b != START else 0.0)


def _next(total: float, a: str, b: str, c: str, lm: CharModel) -> tuple[float, str, str]:
    if c == " ":
        return total + (lm.cost(a, b, END) if b != START else 0.0), START, START
    if not c.isalpha():
        return total + DIGIT, START, START
    return total + lm.cost(a, b, c), b, c


def decode(token: str, lm: CharModel) -> str:
    """The likeliest restored form of a lower-case token or stretch of tokens."""
    best: dict[tuple[str, str], tuple[float, int]] = {(START, START): (0.0, -1)}
    steps: list[tuple[int, str]] = []  # (step before, what was said)
    for ways in lattice(token):
        new: dict[tuple[str, str], tuple[float, int, str]] = {}
        for (a0, b0), (cost, back) in best.items():
            for said, price in ways:
                total, a, b = cost + price, a0, b0
                for c in said:
                    total, a, b = _next(total, a, b, c, lm)
                old = new.get((a, b))
                if old is None or total < old[0]:
                    new[a, b] = (total, back, said)
        best = {}
        for state, (total, back, said) in new.items():
            best[state] = (total, len(steps))
            steps.append((back, said))
    total, back = min((cost + (lm.cost(a, b, END) if b != START else 0.0), k) for (a, b), (cost, k) in best.items())
    if token.isdigit() and NUMBER + DIGIT * len(token) <= total:
        return token
    out: list[str] = []
    while back >= 0:
        back, said = steps[back]
        out.append(said)
    return "".join(reversed(out))


def undoubled(word: str, at: int, lm: CharModel) -> str:
    """What decode gives for a word of letters of which only those at `at` and behind are equal: two paths that differ in a few trigrams."""
    w, k = f"{START}{START}{word}{END}", at + 3
    both = sum(lm.cost(w[j - 2], w[j - 1], w[j]) for j in range(k, min(k + 3, len(w))))
    v = w[:k] + w[k + 1 :]
    one = DOUBLED + sum(lm.cost(v[j - 2], v[j - 1], v[j]) for j in range(k, min(k + 2, len(v))))
    return word if both <= one else v[2:-1]


def restore_token(token: str, lm: CharModel) -> str:
    """Lower-case core of a token or a stretch of short ones, restored where it may be obfuscated."""
    core = token.lower().lstrip(_LEAD).rstrip(_TRAIL)
    again = _AGAIN.search(core)
    if not core or core.isalpha() and not again:
        return core
    if again and core.isalpha() and not _AGAIN.search(core, again.start() + 1):
        return undoubled(core, again.start(), lm)
    if _ODD.search(core) or again or _INSIDE.search(core) or " " in core or "\t" in core:
        return decode(core, lm).strip()
    return core


def tokens(text: str) -> list[str]:
    """Tokens of a text; three or more in a row of at most two characters form one."""
    out: list[str] = []
    at = 0
    for m in _SHORT.finditer(text):
        out += text[at : m.start()].split()
        out.append(m.group())
        at = m.end()
    return out + text[at:].split()


def restore(text: str | None, lm: CharModel) -> str:
    """The restored text."""
    return " ".join(restore_token(t, lm) for t in tokens(text or ""))


def features(word: str) -> list[str]:
    """A restored word and its beginnings."""
    out = [word] if len(word) >= 3 else []
    return out + [f"{word[:k]}-" for k in (4, 5, 6, 7) if len(word) > k]


class Reader:
    """Features of texts, each token being restored once; tokens without a feature that counts are only known as such."""

    HELD = 600_000

    def __init__(self, lm: CharModel, only: dict[str, int] | None = None):
        self.lm, self.only = lm, only
        self.known: set[str] = set()
        self.telling: dict[str, tuple] = {}
        self.starts = {f[:4] for f in only} if only is not None else None

    def silent(self, token: str) -> bool:
        """Whether a token of plain letters can't have a feature that counts, however a doubled letter of it is restored."""
        core = token.lower().lstrip(_LEAD).rstrip(_TRAIL)
        if not core.isalpha() or core[:4] in self.starts:
            return False
        again = _AGAIN.search(core)
        if again is None:
            return True
        k = again.start()
        return not _AGAIN.search(core, k + 1) and (core[: k + 1] + core[k + 2 :])[:4] not in self.starts

    def told(self, token: str) -> tuple:
        if self.starts is not None and self.silent(token):
            return ()
        names = [f for w in _SPLIT.split(restore_token(token, self.lm)) for f in features(w)]
        return tuple(names) if self.only is None else tuple(self.only[f] for f in names if f in self.only)

    def of(self, text: str | None) -> set:
        found: set = set()
        if not text:
            return found
        if len(self.known) > self.HELD:
            self.known.clear()
            self.telling.clear()
        mine = set(tokens(text))
        new = mine - self.known
        for t in new:
            if got := self.told(t):
                self.telling[t] = got
        self.known |= new
        for t in mine & self.telling.keys() if len(mine) < len(self.telling) else [t for t in self.telling if t in mine]:
            found.update(self.telling[t])
        return found


class Model:
    """Weights of features and a constant."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, constant: float, known: bool = True):
        self.names, self.weights, self.constant, self.known = names, weights, constant, known

    def score(self, found: set[int]) -> float:
        if not self.known:
            return 0.0
        x = self.constant + sum(self.weights[i] for i in found)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def regress(rows: list[np.ndarray], y: np.ndarray, n: int, ridge: float = RIDGE, steps: int = 300) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on rows of present features, by steps of Adam."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    of = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
    w, b = np.zeros(n), math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    g2w, g2b, mw, mb = np.zeros(n), 0.0, np.zeros(n), 0.0
    for k in range(1, steps + 1):
        z = b + np.bincount(at, w[of], len(rows))
        r = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        gw, gb = (np.bincount(of, r[at], n) + ridge * w) / len(y), r.mean()
        mw, mb = 0.9 * mw + 0.1 * gw, 0.9 * mb + 0.1 * gb
        g2w, g2b = 0.999 * g2w + 0.001 * gw**2, 0.999 * g2b + 0.001 * gb**2
        c1, c2 = 1 - 0.9**k, 1 - 0.999**k
        w = w - 0.05 * (mw / c1) / (np.sqrt(g2w / c2) + 1e-9)
        b = b - 0.05 * (mb / c1) / (math.sqrt(g2b / c2) + 1e-9)
    return w, b


def some_of(rows: DataFrame, counted: DataFrame, wanted: float) -> DataFrame:
    """About `wanted` of rows, chosen by a hash of doc_id; counted: as many rows, with few columns."""
    part = wanted / max(1, counted.count())
    return rows if part >= 1 else rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(10**9)) < int(part * 10**9))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, n_features: int = FEATURES) -> tuple[CharModel, Model]:
    """Character model and regression from docs (doc_id, text) and labels (doc_id, toxic)."""
    lean(docs.sparkSession)
    docs = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.col("text") != ""))

    @tidy
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def told() -> Iterator[pa.RecordBatch]:
            found = spelled(words_of(words))
            words.clear()
            names, n = list(found), list(found.values())
            for i in range(0, len(names), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(names[i : i + 50_000], pa.string()), pa.array(n[i : i + 50_000], pa.int64())], names=["gram", "n"])

        for b in batches:
            for t in b.column(0):
                words.update(t.as_py().lower().split())
            if len(words) > HELD_WORDS or sum(map(len, words)) > HELD_CHARS:
                yield from told()
        yield from told()

    all_grams = docs.select("text").mapInArrow(grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # distinct trigrams: bounded by the alphabets, not by the texts
    lm = CharModel(dict(zip(all_grams["gram"].to_pylist(), all_grams["n"].to_pylist(), strict=True)))
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    # Few more than are wanted are left to be sorted.
    chosen = some_of(known, known, 1.2 * sample_rows).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # one text of a doc_id
    sample = written(sample.select("doc_id", "text", "toxic"), "labelled")

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, n = Reader(lm), defaultdict(lambda: [0, 0])

        def told() -> Iterator[pa.RecordBatch]:
            rows = list(n.items())
            n.clear()
            for i in range(0, len(rows), 50_000):
                some = rows[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in some], pa.string()), *(pa.array([v[k] for _, v in some], pa.int64()) for k in (0, 1))], names=["feature", "n0", "n1"])

        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for f in reader.of(t):
                    n[f][y > 0] += 1
            if len(n) > 500_000:
                yield from told()
        yield from told()

    totals = {int(r["toxic"] > 0): r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        return lm, Model({}, np.zeros(0), 0.0, known=False)
    seen = sample.select("text", "toxic").mapInArrow(count, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= LEAST_DOCS)
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(F.lit(0.0))
    both, share = F.col("n0") + F.col("n1"), n1 / (n0 + n1)
    tell = 2 * (part(F.col("n1"), both * share) + part(F.col("n0"), both * (1 - share)) + part(n1 - F.col("n1"), (n0 + n1 - both) * share) + part(n0 - F.col("n0"), (n0 + n1 - both) * (1 - share)))
    top = seen.withColumn("tell", tell).where(F.col("tell") >= LEAST_TELL).orderBy(F.desc("tell"), "feature").limit(n_features).collect()
    names = {r["feature"]: i for i, r in enumerate(top)}

    @tidy
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(lm, names)
        for b in batches:
            yield pd.DataFrame({"found": [sorted(reader.of(t)) for t in b["text"]], "toxic": b["toxic"]})

    got = sample.mapInPandas(rows, "found array<int>, toxic int").collect()  # at most sample_rows
    got.sort(key=lambda r: (r["found"], r["toxic"]))
    w, b = regress([np.array(r["found"], np.int64) for r in got], np.array([float(r["toxic"] > 0) for r in got]), len(names))
    return lm, Model(names, w, b)


def scored(docs: DataFrame, lm: CharModel, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs (doc_id, text)."""

    @tidy
    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(lm, model.names)
        for b in batches:
            s = [model.score(reader.of(t)) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": s, "predicted": [int(x >= threshold) for x in s]})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInPandas(over, f"doc_id {kind}, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, *learn(docs, table(spark, sf_dir, "labels")))
