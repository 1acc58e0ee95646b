"""The class-based language model against plain forms of its parts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from passwatch.llm import classes, queries, tally
from tests.oracle import SF, connect


def words_of(text):
    body = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", body)


def matrix_of(texts, of):
    out = np.zeros((classes.SIZE, classes.SIZE))
    for words in texts:
        row = [classes.END, *(of[w] for w in words), classes.END]
        for a, b in zip(row, row[1:]):
            out[a, b] += 1
    return out


def test_gains():
    """The gain of a class is the likelihood with the word in it, up to a constant."""
    r = random.Random(7)
    texts = [[r.choice("aabcdefgh") for _ in range(r.randrange(0, 30))] for _ in range(40)]
    of = {w: r.randrange(5) for w in "abcdefgh"}
    for word in "abh":
        pairs = Counter((a, b) for t in texts for a, b in zip(["", *t], [*t, ""]))
        kind = lambda w: of[w] if w else classes.END
        before, behind = np.zeros(classes.SIZE), np.zeros(classes.SIZE)
        for (a, b), n in pairs.items():
            if a != b and b == word:
                before[kind(a)] += n
            if a != b and a == word:
                behind[kind(b)] += n
        without = matrix_of(texts, of)
        without[of[word]] -= behind
        without[:, of[word]] -= before
        without[of[word], of[word]] -= pairs[word, word]
        got = classes.gains(without, classes.xlogx(without), before, behind, pairs[word, word])
        want = [classes.likelihood(matrix_of(texts, of | {word: c})) for c in range(7)]
        assert np.allclose(got[:7] - got[0], np.array(want) - want[0])


def test_exchange_raises_the_likelihood(spark):
    r = random.Random(1)
    nouns, verbs = [f"n{i}" for i in range(40)], [f"v{i}" for i in range(40)]
    texts = [" ".join(x for _ in range(r.randrange(1, 8)) for x in (r.choice(nouns), r.choice(verbs))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "__text string")
    counts = tally.word_counts(df.select(F.lit("").alias("lang"), "__text"), classes.WORD).where("word is not null")
    of = {x.word: x["class"] for x in classes.word_classes(df, counts).collect()}
    assert set(of) == set(nouns + verbs) and not {of[w] for w in nouns} & {of[w] for w in verbs}
    core = sorted(of, key=lambda w: (-Counter(" ".join(texts).split())[w], w))
    split = [t.split() for t in texts]
    assert classes.likelihood(matrix_of(split, of)) >= classes.likelihood(matrix_of(split, {w: i % classes.CLASSES for i, w in enumerate(core)}))


def plain_scores(rows, of):
    """(n_tokens, n_known, N, base, score) of each (text, learn). of: the class of each training word."""
    train = [words_of(t) for t, learn in rows if learn]
    c = Counter(w for words in train for w in words)
    ends, n = len(train), sum(c.values()) + len(train)
    kinds = len(c) + (ends > 0)
    assert set(of) == set(c)
    assert {w for w in c if c[w] < classes.FEW} == {w for w in of if of[w] == classes.RARE}
    step = matrix_of(train, of)
    total, share = Counter(), (step.sum(axis=0) + 1) / (step.sum() + classes.SIZE)
    size = Counter(of.values())
    for w, k in c.items():
        total[of[w]] += k

    def behind(a):
        kinds_of = max(int((step[a] > 0).sum()), 1)
        return (step[a] + kinds_of * share) / (step[a].sum() + kinds_of)

    def word(w):
        k = of.get(w, classes.RARE)
        return (c[w] + 1) / (total[k] + size[k] + 1) if k == classes.RARE else c[w] / total[k]

    ways = [behind(a) for a in range(classes.SIZE)]
    assert all(math.isclose(p.sum(), 1) for p in ways)
    for k in set(of.values()) | {classes.RARE}:
        assert math.isclose(sum(word(w) for w in of if of[w] == k) + (word("") if k == classes.RARE else 0), 1)
    out = []
    for text, _ in rows:
        words, last, base, score = words_of(text), classes.END, 0.0, 0.0
        for w in [*words, None]:
            count = ends if w is None else c[w]
            base += math.log10((count + 1) / (n + kinds + 1))
            now = classes.END if w is None else of.get(w, classes.RARE)
            score += math.log10(ways[last][now]) + (0 if w is None else math.log10(word(w)))
            last = now
        out.append((len(words) + 1, sum(w in c for w in words) + (ends > 0), n, pytest.approx(base), pytest.approx(score)))
    return out


def classes_of(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "__text string")
    counts = tally.word_counts(df.select(F.lit("").alias("lang"), "__text"), classes.WORD).where("word is not null")
    return {x.word: x["class"] for x in classes.word_classes(df, counts).collect()}


@pytest.mark.parametrize("core, head", [(classes.CORE, classes.HEAD), (4, 10), (6, 3)])
def test_scores(spark, monkeypatch, core, head):
    """Also with few words in the core and few that travel to the tasks."""
    monkeypatch.setattr(classes, "CORE", core)
    monkeypatch.setattr(classes, "HEAD", head)
    r = random.Random(9)
    texts = [" ".join(r.choices(["The", "the", "of", "é", "a|b", "x1", "y\x0b", "zz", "q,", "rare%d" % r.randrange(99)], k=r.randrange(0, 40))) for _ in range(150)]
    texts += [None, "", " \n", "never seen words here", "the of " * 4000, texts[0], texts[0]]
    rows = [(t, i % 5 != 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, learn, 1, 2) for i, (t, learn) in enumerate(rows)], "doc_id long, text string, learn boolean, score int, word int").withColumns({"seq": F.lit(1), "n": F.lit(2), "class": F.lit(3)})
    got = {x.doc_id: tuple(x)[1:] for x in classes.score(df, F.col("learn")).collect()}
    assert [got[i] for i in range(len(rows))] == plain_scores(rows, classes_of(spark, [t for t, learn in rows if learn]))


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "a b", False), (2, None, None)], "doc_id long, text string, learn boolean")
    got = {x.doc_id: tuple(x)[1:] for x in classes.score(df, F.col("learn")).collect()}
    way = math.log10(1 / classes.SIZE)
    assert got == {1: (3, 0, 0, 0.0, pytest.approx(3 * way)), 2: (1, 0, 0, 0.0, pytest.approx(way))}
    assert classes.score(df.limit(0), F.col("learn")).count() == 0
    assert [tuple(x) for x in classes.score(df.limit(0).unionByName(df.where("doc_id = 2").withColumn("learn", F.lit(True))), F.col("learn")).select("n_tokens", "n_known", "train_tokens").collect()] == [(1, 1, 1)]


def test_query(spark):
    rows = connect().execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    of = classes_of(spark, [t for (_, t), h in zip(rows, held) if not h])
    want = plain_scores([(t, not h) for (_, t), h in zip(rows, held)], of)
    got = {x.doc_id: x for x in queries.op12_lm(spark, SF).collect()}
    assert len(got) == len(rows)
    for (i, _), h, w in zip(rows, held, want):
        x = got[i]
        assert (x.held_out, (x.n_tokens, x.n_known, x.train_tokens, x.base_score, x.score)) == (h, w)
    assert sum(x.score for x in got.values()) > sum(x.base_score for x in got.values())
