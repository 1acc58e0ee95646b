"""Search in blocks against plain loops."""

import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import functions as F

from passwatch.functions.geo import l2_normalize
from passwatch.operators import index, retrieve


def rows(seed=1):
    """Copies, near ties, opposite and zero vectors, other dimensions, nulls."""
    r = random.Random(seed)
    base = [[r.gauss(0, 1) for _ in range(6)] for _ in range(40)]
    out = [(i, list(r.choice(base)) if r.random() < 0.6 else [-x for x in r.choice(base)]) for i in range(400)]
    out += [(400 + i, [0.0] * 6) for i in range(3)] + [(410 + i, [1.0, float(i)]) for i in range(5)] + [(420, None), (421, [1.0, None, 0, 0, 0, 0])]
    return [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in out]


def plain(data, k, threshold):
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in data if v is not None and None not in v}
    out = []
    for q in [i for i in unit if i % 20 == 0]:
        scored = [(-float(Decimal(repr(float(unit[q] @ v))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) + 0.0, i) for i, v in unit.items() if len(v) == len(unit[q])]
        out += [(q, i, -s + 0.0, n + 1) for n, (s, i) in enumerate(sorted(scored)[:k]) if -s >= threshold]
    return sorted(out)


def test_blocks(spark, tmp_path):
    data = rows()
    v = spark.createDataFrame(data, "id long, embedding array<double>")
    q = v.where("id % 20 = 0").select(F.col("id").alias("q_id"), F.col("embedding").alias("q_embedding"))
    listed = lambda df: sorted((r.q_id, r.id, r.score, r["rank"]) for r in df.collect())
    for bytes_ in (500, 1 << 22):
        for k, threshold in ((3, -1.0), (50, 0.2)):
            assert listed(retrieve.retrieve_topk(q, v, k, threshold, block_bytes=bytes_)) == plain(data, k, threshold)
    six = [(i, x) for i, x in data if x is None or len(x) == 6 and None not in x]
    v, store = spark.createDataFrame(six, "id long, embedding array<double>"), f"file://{tmp_path}/index"
    index.build(v, store)
    assert listed(index.search(q.where("size(q_embedding) = 6"), store, 5, -1.0)[0]) == plain(six, 5, -1.0)


def test_half_up():
    x = np.array([0.0000005, -0.0000005, 0.1234565, 0.12345649999, 1.0, -0.25])
    assert retrieve.half_up(x).tolist() == [1, -1, 123457, 123456, 1000000, -250000]


def test_length_is_taken_once(spark):
    """3,000 vectors of 1,500 components: their length was taken for every component, 6.75 billion products."""
    v = spark.range(3000).select(F.transform(F.sequence(F.lit(1), F.lit(1500)), lambda x: (x + F.col("id")).cast("double")).alias("v"))
    assert v.agg(F.sum(F.aggregate(l2_normalize("v"), F.lit(0.0), lambda s, x: s + x * x))).first()[0] > 2999.9
