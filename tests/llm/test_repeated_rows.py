"""Rows that repeat: the work follows the rows, and samples stay within their bounds."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from passwatch.llm import quality, queries, repeats
from passwatch.llm.common import joined_bytes
from tests.oracle import SF, connect


def test_runs_of_equal_rows_come_once(spark):
    """300 equal rows without an id: the list that is joined to each of them has each run once."""
    r = random.Random(2)
    text = "".join(r.choice("abcdefgh ") for _ in range(4000))
    df = spark.createDataFrame([(None, text)] * 300 + [(7, text[:1000] + "#")], "doc bigint, text string").withColumn("doc", F.coalesce("doc", F.lit(repeats.NO_ID)))
    found = repeats.repeated(df, 200).select("doc", F.size("runs").alias("n")).collect()
    assert len(found) == 2 and all(x.n <= 100 for x in found)
    rows = repeats.deduplicate(df.withColumnRenamed("doc", "doc_id")).collect()
    assert len(rows) == 301 and {len(x.kept) for x in rows} == {0, 1}


def test_a_sample_of_one_id_is_one_row(spark):
    docs = spark.createDataFrame([(1, f"text {k} " * (k + 1)) for k in range(50)] + [(2, "other"), (3, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id bigint, quality int")
    x, mark = quality.sample_features(docs, labels.where("doc_id = 1"), 1, "doc_id", "text")
    assert len(x) == len(mark) == 1
    x, mark = quality.sample_features(docs, labels, 10, "doc_id", "text")
    assert sorted(mark) == [0, 0, 1]


def plain_fit(x, mark):
    """The same pairs, but gradient steps alone, and every cut tried."""
    rows = sorted(zip(mark.tolist(), *reversed(x.T.tolist())))
    mark = np.array([r[0] for r in rows])
    x = np.array([r[:0:-1] for r in rows])
    wide = np.array([[*r, *(v * v for v in r)] for r in x])
    good, bad = np.flatnonzero(mark == 1), np.flatnonzero(mark == 0)
    draw = np.random.default_rng(7)
    n = min(quality.PAIRS, len(good) * len(bad))
    scale = np.maximum(wide.std(axis=0), 1e-6)
    a, b = draw.choice(good, n), draw.choice(bad, n)
    diff = (wide[a] - wide[b]) / scale
    w, ahead = np.zeros(diff.shape[1]), np.zeros(diff.shape[1])
    rate = 1 / (np.linalg.eigvalsh(diff.T @ diff / n).max() / 4 + 1e-3)
    for k in range(4000):
        slope = diff.T @ (1 / (1 + np.exp(-diff @ ahead)) - 1) / n + 1e-3 * ahead
        new = ahead - rate * slope
        w, ahead = new, new + k / (k + 3) * (new - w)
    worth = wide @ (w / scale)
    by = np.sort(worth)
    right = [sum((worth < by[i]) == (mark == 0)) if i < len(by) else sum(mark == 0) for i in range(len(by) + 1)]
    best = [i for i, n_ in enumerate(right) if n_ == max(right)]
    cut = np.quantile(worth, best[len(best) // 2] / len(by))
    return lambda f: 1 / (1 + np.exp(-np.clip((np.array([[*r, *(v * v for v in r)] for r in f]) @ (w / scale) - cut) / worth.std() * 3 + np.log(quality.THRESHOLD / (1 - quality.THRESHOLD)), -30, 30)))


def test_quality_query_against_a_plain_fit(spark):
    import pyarrow as pa

    con = connect()
    docs = con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    marks = dict(con.execute("SELECT doc_id, quality FROM labels WHERE quality IN (0, 1)").fetchall())
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in docs}
    x = dict(zip([i for i, _ in docs], quality.features(*joined_bytes(pa.array([t for _, t in docs])))))
    learned = [i for i, _ in docs if i in marks and not held[i]]
    score = plain_fit(np.array([x[i] for i in learned]), np.array([marks[i] for i in learned]))
    want = dict(zip(x, score(np.array(list(x.values())))))
    got = {r.doc_id: r for r in queries.op5_quality(spark, SF).collect()}
    assert got.keys() == want.keys()
    assert all(got[i].held_out == held[i] and abs(got[i].score - want[i]) < 0.02 for i in want)
    assert sum(got[i].predicted == (want[i] >= quality.THRESHOLD) for i in want) >= 0.99 * len(want)
