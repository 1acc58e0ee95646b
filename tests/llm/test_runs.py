"""Periodic runs against a plain search."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from passwatch.llm import queries, runs
from tests.oracle import SF, connect


def plain_runs(words):
    """Every run, by trying all periods and all stretches."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        k = q
        while k < n:
            if words[k] != words[k - q]:
                k += 1
                continue
            s = k
            while k < n and words[k] == words[k - q]:
                k += 1
            if k - s + q >= max(6, 4 * q):
                out.setdefault((s - q, k - s + q), q)  # smaller periods come first
    return sorted((s, length, q) for (s, length), q in out.items())


def plain_collapsed(words, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_runs_of_random_words():
    r = random.Random(3)
    for case in range(400):
        texts = []
        for _ in range(r.randrange(1, 5)):
            letters, words = r.randrange(1, 6), []
            for _ in range(r.randrange(0, 6)):
                words += [r.randrange(letters) for _ in range(r.randrange(1, 12))] * r.randrange(1, 8)
            texts.append(words)
        bounds = np.cumsum([0, *map(len, texts)])
        found = runs.runs_of(np.array([w for t in texts for w in t], np.int64), bounds)
        for k, t in enumerate(texts):
            assert [tuple(x[1:]) for x in found.tolist() if x[0] == k] == plain_runs(t), (case, t)


def test_runs_of_runs():
    """Fibonacci words, powers of powers and long periods."""
    a, b = [0], [0, 1]
    for _ in range(10):
        a, b = b, b + a
    root = [random.Random(1).randrange(50) for _ in range(90)]
    for t in (b, (([0] * 7 + [1]) * 6 + [2]) * 5, root * 4 + root[:11], [0] * 500, ([0] * 40 + [1]) * 4, [0, 0, 1, 1] * 30):
        assert [tuple(x[1:]) for x in runs.runs_of(np.array(t), np.array([0, len(t)])).tolist()] == plain_runs(t)


def test_edges(spark):
    texts = [None, "", " \n\t ", "a", "a a a a a", "a a a a a a", "x  a\tb\na b a b a b y", "é é é é é é é", "a a a a a a", "a b " * 5 + "b a " * 5, "w " * 50_000]
    rows = [(i if i else None, t, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[6]], "doc_id bigint, text string, runs int").withColumns({"collapsed": F.lit(1), "n_words": F.lit("x"), "__own": F.lit(2)})
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.find(df).collect()), key=str)
    want = sorted(((i, len(plain_words(t)), found := plain_runs(plain_words(t)) if i < 10 else [(0, 50_000, 1)], plain_collapsed(plain_words(t), found)) for i, t, in [(x[2], x[1]) for x in [*rows, rows[6]]]), key=str)
    assert got == want
    assert runs.find(df.limit(0)).count() == 0


def test_a_very_long_text(spark):
    """A million words of two kinds and a million of one: time doesn't grow with the square of a word's occurrences."""
    body = np.random.default_rng(1).choice(["the", "of"], 1_000_000).tolist()
    text = " ".join(body) + " " + " ".join(["a b b"] * 300_000)
    (row,) = runs.find(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    assert row.n_words == 1_900_000
    assert (1_000_000, 900_000, 3) in [tuple(x) for x in row.runs]


def test_query(spark):
    want = {}
    for doc_id, text in connect().execute("SELECT doc_id, text FROM documents").fetchall():
        words, h = plain_words(text), zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        found = plain_runs(words)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        want[doc_id] = (len(found), *best, best[0] is not None and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(plain_collapsed(words, found).encode()).hexdigest())
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli or False, r.runs_sha256, r.collapsed_sha256) for r in queries.op11_runs(spark, SF).collect()}
    assert got == want
    assert sum(x[0] > 0 for x in got.values()) > 10
