"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from passwatch.llm import collocations, queries, tally
from tests.oracle import connect, same


def plain(rows, least=10, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        body = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", body):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    out = {}
    longer = {}
    for (lang, p), a in f.items():
        if len(p) == 3 and a >= least:
            for q in (p[:2], p[1:]):
                longer[lang, q] = max(a, longer.get((lang, q), 0))
    for (lang, p), a in f.items():
        if len(p) == 1 or a < least or 100 * longer.get((lang, p), 0) >= 50 * a:
            continue
        score, _, left, right = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows_ in out.items() for k, (s, a, p, left, right) in enumerate(sorted(rows_)[:top]))


def rows_of(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for _, t in df.dtypes[3:]} | {df.dtypes[1][1]} == {"bigint"}
    return sorted(tuple(r) for r in df.collect())


def some(r, n, kinds):
    words = [r.choice(["W%d", "é%d", "x%dY", "|%d"]) % i for i in range(kinds)]
    weights = [1 / (i + 1) for i in range(kinds)]
    ends = [" ", " ", " ", "  ", "\t", ". ", "\n", ",", "; ", "\x0b"]
    return ["".join(w + r.choice(ends) for w in r.choices(words, weights, k=r.randrange(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("bounds", [{}, {"HEAD": 3}, {"DENSE": 1, "MOST_CODES": 20, "MOST_WORDS": 10, "SLICE": 300}])
def test_equals_a_plain_count(spark, monkeypatch, bounds):
    """Also with few ranked words and pairs, and with tallies that overflow again and again."""
    for name, value in bounds.items():
        for module in (collocations, tally):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, value)
    r = random.Random(4)
    rows = [(r.choice(["en", "de", None, "und", ""]), t) for t in some(r, 120, 30)]
    rows += [("en", None), (None, None), ("fr", ""), ("en", "a b c " * 400), ("en", "a b c " * 400), ("xx", "one two"), ("yy", "the The THE the the the the the the the the the")]
    df = spark.createDataFrame([(x, t, 1, 2) for x, t in rows], "lang string, text string, word int, n int").withColumn("w1", F.lit(0))
    got = rows_of(collocations.mine(df, top=50))
    assert got == plain(rows, top=50)
    assert {x[0] for x in got} >= {"en", "und", "yy"}


def test_no_rows(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert collocations.mine(df).count() == 0
    assert rows_of(collocations.mine(spark.createDataFrame([("en", None), (None, "a b")], df.schema))) == []


def test_products_beyond_64_bits(spark):
    (row,) = spark.createDataFrame([(10**14 + 1, 10**14 + 3, 10**14 + 7)], "a long, l long, r long").select(collocations.scored("a", "l", "r").alias("s")).collect()
    assert row.s == 1000000 * (10**14 + 1) ** 2 // ((10**14 + 3) * (10**14 + 7))


@pytest.mark.parametrize("most", [1 << 20, 1000])
def test_tally_by_tiles(monkeypatch, most):
    monkeypatch.setattr(tally, "MOST_CODES", most)
    r = np.random.default_rng(2)
    one, want = tally.Tally(), Counter()
    for _ in range(5):
        a, b = (np.minimum(r.zipf(1.3, 60_000), 400_000) for _ in "ab")
        one.add(a, b)
        want.update(zip(a.tolist(), b.tolist()))
    assert one.tiles and bool(one.full) == (most == 1000)
    a, b, n = one.take()
    assert dict(zip(zip(a.tolist(), b.tolist()), n.tolist())) == want
    assert not len(one.take()[0])


def test_query_equals_duckdb(spark):
    same(spark, queries.op13_collocations, queries.OP13_SQL)
    rows = connect().execute("SELECT lang, text FROM documents").fetchall()
    assert len(rows_of(queries.op13_collocations(spark, "/root/testdata/sf0.001"))) == len(plain(rows))
