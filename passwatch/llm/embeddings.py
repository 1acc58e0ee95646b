"""Embedding near-duplicates by randomised-rotation binary codes.

Every unit vector is turned by one random rotation and kept as the signs of its coordinates, with a correction factor: the
inner product of the vector and its code. Code against turned vector, divided by that factor, is an unbiased estimate of the
cosine, and its error is at most sqrt(1 - cos^2) * sqrt(1 - factor^2) / factor * min(1, confidence / sqrt(D - 1)). A pair whose estimate lies
below the threshold by more than that bound is dropped; all others are recomputed in double precision. With `confidence`
unset the bound is the certain one, so the codes lose no pair.

Equal vectors of one label are one class and never compared. Classes meet by label, all of them, whatever its size: a label beyond BLOCK classes
is cut into blocks and pairs of blocks are dealt out. A block pair returns sums of links and a spanning set of its links, never all pairs.

Edge cases: a vector that is null, empty, zero, or holds a null or non-finite component, and a vector with a null label, links with
nothing; vectors of different lengths never link; ids must be unique; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passwatch.llm.common import components, star_of, written

THRESHOLD = 0.93
BLOCK = 2048
SEED = 20240229


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, 0]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def near(x: np.ndarray, y: np.ndarray, same: bool, threshold: float, confidence: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of x and j of y (i < j where they are the same) with a cosine of at least the threshold."""
    dim = x.shape[1]
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    y = y / np.linalg.norm(y, axis=1, keepdims=True)
    turn = rotation(dim)
    turned = x @ turn.T
    code = np.where(turned > 0, np.float32(1), np.float32(-1))
    factor = np.abs(turned).sum(axis=1) / math.sqrt(dim)
    estimate = code @ (y @ turn.T).T.astype(np.float32)
    estimate /= (factor * math.sqrt(dim))[:, None].astype(np.float32)
    share = 1.0 if confidence is None or dim < 2 else min(1.0, confidence / math.sqrt(dim - 1))
    error = np.sqrt(np.maximum(1 - factor**2, 0)) / factor * math.sqrt(1 - threshold**2) * share
    i, j = np.nonzero(estimate >= (threshold - error - 1e-4)[:, None].astype(np.float32))
    if same:
        i, j = i[i < j], j[i < j]
    keep = np.zeros(len(i), bool)
    for a in range(0, len(i), 1 << 17):
        s = slice(a, a + (1 << 17))
        keep[s] = np.einsum("ij,ij->i", x[i[s]], y[j[s]]) >= threshold
    return i[keep], j[keep]


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """One table for each run of equal values in the first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(edges, edges[1:]):
            if held and held[-1].column(0)[0].as_py() != key[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def classes_of(vectors: DataFrame, key: str, embedding: str, label: str) -> DataFrame:
    """node (the smallest id), copies, label and embedding of each different vector that can link."""
    sound = F.expr(f"`{embedding}` is not null and size(`{embedding}`) > 0 and forall(`{embedding}`, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(`{embedding}`, x -> x <> 0)")
    return vectors.where(F.col(label).isNotNull()).where(sound).groupBy(F.col(label).alias("label"), F.col(embedding).alias("embedding")).agg(F.min(key).alias("node"), F.count("*").alias("copies"))


def placed(classes: DataFrame, block: int) -> DataFrame:
    """task, side, alone, node, copies, embedding: each class in every block pair of its label and length."""
    dealt = classes.withColumn("cell", F.xxhash64("label", F.size("embedding")))
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int"))
    rows = dealt.join(sizes, "cell").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    paired = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "k"), F.greatest("own", "k")
    return paired.select(F.xxhash64("cell", low, high).alias("task"), F.when(F.col("own") == low, 0).otherwise(1).alias("side"), (low == high).alias("alone"), "node", "copies", "embedding")


def linked(classes: DataFrame, threshold: float = THRESHOLD, confidence: float | None = None, block: int = BLOCK) -> DataFrame:
    """node, links (vectors of other classes linked with it) and root (a spanning set of links), in parts that add up."""

    def join(batches):
        for task in runs(batches):
            task = task.combine_chunks()
            side = task["side"].to_numpy()
            alone = task["alone"][0].as_py()
            node, copies = task["node"].to_numpy(), task["copies"].to_numpy()
            x = matrix(task["embedding"].chunk(0))
            left = np.flatnonzero(side == 0)
            right = left if alone else np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                continue
            i, j = near(x[left], x[right], alone, threshold, confidence)
            i, j = left[i], right[j]
            links = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
            some = np.flatnonzero(links)
            root = dict(zip(*(c.tolist() for c in star_of(node[i], node[j]))))
            yield pa.record_batch([pa.array(node[some]), pa.array(links[some].astype(np.int64)), pa.array([root.get(v) for v in node[some].tolist()], pa.int64())], ["node", "links", "root"])

    return placed(classes, block).repartition("task").sortWithinPartitions("task").mapInArrow(join, "node long, links long, root long")


def grouped(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, confidence: float | None = None) -> DataFrame:
    """key, n_links, component_id and kept for every row of vectors."""
    classes = written(classes_of(vectors, key, embedding, label), "classes")
    found = written(linked(classes, threshold, confidence), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("root is not null").select("node", "root"), "node", "root").withColumnRenamed("root", "component")
    named = classes.join(links, "node", "left").join(roots, "node", "left").select("label", "embedding", "copies", "node", "links", "component")
    rows = vectors.select(F.col(key).alias("__key"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    joined = rows.join(named, ["label", "embedding"], "left")
    component = F.coalesce("component", "node", "__key").cast("long")
    return joined.select(F.col("__key").alias(key), F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("__key")).alias("kept"))
