"""Collocations against a count of everything."""

import collections
import random
import re

import numpy as np
import pytest

from scriptorium.llm import collocations


def brute(rows, least, top, absorbed):
    f, n = collections.Counter(), collections.Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in (1, 2, 3):
                f.update((lang, tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = collections.defaultdict(list)
    for (lang, ws), a in cands.items():
        if any(lang == m and len(v) > len(ws) and any(v[i : i + len(ws)] == ws for i in range(len(v))) and 100 * b >= absorbed * a for (m, v), b in cands.items()):
            continue
        score, _, l, r = min((1_000_000 * a * a // (f[lang, ws[:k]] * f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws)))
        out[lang].append((-score, -a, " ".join(ws).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top]))


def texts(seed, n, words="a b c d e f g h the of Über ñ'1 日本".split()):
    g = random.Random(seed)
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!", " ? "]
    return [("".join(g.choice(words[: g.choice([2, 5, len(words)])]) + g.choice(marks) for _ in range(g.randrange(0, 60))), g.choice(["en", "de", None])) for _ in range(n)]


@pytest.mark.parametrize("salt_rows,chunk_words,least,top", [(10**6, 400_000, 10, 2000), (20, 100, 5, 2000), (1, 1, 10, 7)])
def test_against_brute_force(spark, salt_rows, chunk_words, least, top):
    rows = texts(salt_rows, 120)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    got = collocations.collocations(docs, least, top, salt_rows=salt_rows, chunk_words=chunk_words)
    assert sorted(map(tuple, got.collect())) == brute(rows, least, top, 50)


def test_odd_rows(spark):
    """Nulls, empty texts, one word repeated, repeated rows, a very long text, capitals that would be marks, other columns."""
    rows = [(None, None), ("", "en"), ("A A a A", "en"), ("x " * 30_000 + ".", "en"), *[("New York, new YORK", None)] * 12, ("\x00 \x1f\xa0  \x00 \x1f\xa0  " * 20, "en"), ("y" * 100_000, "en")]
    docs = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "text string, lang string, n int, phrase string, a int")
    got = collocations.collocations(docs, salt_rows=50, chunk_words=1000)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, 2000, 50)
    assert collocations.collocations(docs.where("false")).collect() == []


def test_products_beyond_64_bits(spark):
    f = 3_000_000_000_000
    found = spark.createDataFrame([("en", "p q", 2, f - 1)], "lang string, phrase string, size int, a long")
    got = found.selectExpr("(cast(1000000 as decimal(38,0)) * cast(a as decimal(38,0)) * cast(a as decimal(38,0))) div (cast(a + 1 as decimal(38,0)) * cast(a + 1 as decimal(38,0))) as s").first().s
    assert got == 1_000_000 * (f - 1) ** 2 // f**2


def test_each_n_gram_has_one_owner():
    g = np.random.default_rng(2)
    for _ in range(30):
        codes = g.integers(-1, 6, 80).astype(np.int32)
        ranks = g.permutation(7)[:6].astype(np.int64)
        want, r = collections.Counter(), [0 if c < 0 else int(ranks[c]) for c in codes]
        for k in (2, 3):
            want.update(t for i in range(len(r) - k + 1) if 0 not in (t := tuple(r[i : i + k])))
        got = collections.Counter()
        columns, n = collocations.fragments(np.array(r))
        for l2, l1, w, r1, r2, m in zip(*columns, n, strict=True):
            for t in ((l1, w), (w, r1), (l2, l1, w), (l1, w, r1), (w, r1, r2)):
                if 0 not in t:
                    assert max(t) == w
                    got[tuple(map(int, t))] += int(m)
        assert got == want
