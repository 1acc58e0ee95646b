"""A stored vector index: an inverted file of k-means cells with bounds, which make its search exact.

A cell holds the unit vectors nearest to its centre, and the largest angle between the centre and any of them. Whatever lies in a cell has at most
the cosine of the angle from the query to the centre less that angle as its product with the query. A search first looks into the PROBES
best cells of each query, and then into every other cell whose bound reaches the k-th score found: what is skipped can't be among the k best.

The index is a store of versions (sources/versioned.py): vectors by cell and the table of cells change together. It names the vectors that
it was made of (their number, dimension, backend and a sum of hashes); load_or_build() makes it anew where it is absent, made of
others, or when that is forced. Vectors that are null or empty are not in it; zero vectors are a cell of their own, with products of 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from passwatch.functions.geo import l2_normalize
from passwatch.operators.retrieve import BLOCK_BYTES, QUERY_BLOCKS, best_of_blocks, bytes_of, comparable
from passwatch.sources import versioned

MOST_CELLS = 1024
FITTED = 30_000  # vectors, about, that the centres are fitted on; all are indexed, and the search is exact whatever the centres
PROBES = 2
ZERO = -1  # the cell of zero vectors


def stamp_of(vectors: DataFrame, backend: str) -> dict:
    """What an index must have been made of to fit these vectors (id, embedding)."""
    n, dim, least, total = vectors.where("size(embedding) > 0").agg(F.count("*"), F.max(F.size("embedding")), F.min(F.size("embedding")), F.sum(F.xxhash64("id", "embedding").cast("decimal(38,0)"))).first()
    if n and dim != least:
        raise ValueError(f"vectors of {least} and of {dim} dimensions")
    return {"n": n, "dim": dim or 0, "backend": backend, "stamp": str(total or 0)}


def centres_of(unit: DataFrame, n: int) -> np.ndarray:
    """At most MOST_CELLS unit centres; only they reach the driver."""
    some = unit.where(F.exists("embedding", lambda x: x != 0) & (F.pmod(F.xxhash64("id"), F.lit(max(1, n // FITTED))) == 0)).select(array_to_vector("embedding").alias("features"))
    k = max(1, min(MOST_CELLS, int(np.ceil(np.sqrt(n) / 2))))
    found = np.array(KMeans(k=k, seed=7, maxIter=10).fit(some).clusterCenters()) if n and not some.isEmpty() else np.zeros((0, 0))
    size = np.linalg.norm(found, axis=1, keepdims=True) if len(found) else found
    return (found / size)[size[:, 0] > 0] if len(found) else found


def build(vectors: DataFrame, path: str, backend: str = "given", stamp: dict | None = None) -> None:
    """Write a new version of the index of vectors (id, embedding); stamp: stamp_of() them, where it is known."""
    spark, stamp = vectors.sparkSession, stamp or stamp_of(vectors, backend)
    unit = vectors.where("size(embedding) > 0").select("id", l2_normalize(F.col("embedding").cast("array<double>")).alias("embedding")).persist()  # read again and again
    centres = centres_of(unit, stamp["n"])
    shared = spark.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            zero = ~v.any(axis=1)
            near = v @ shared.value.T if len(shared.value) else np.zeros((len(v), 1))
            cell = np.where(zero, ZERO, near.argmax(axis=1))
            cos = np.where(zero, 0.0, near.max(axis=1))
            yield pa.record_batch([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(cos)], [*batch.schema.names, "cell", "cos"])

    kind = vectors.schema["id"].dataType.simpleString()
    placed = unit.mapInArrow(place, f"id {kind}, embedding array<double>, cell int, cos double").persist()
    names = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)] + [(ZERO, None)], "cell int, centre array<double>")
    cells = placed.groupBy("cell").agg(F.count("*").alias("size"), F.min("cos").alias("least_cos")).join(names, "cell", "left")
    cells = cells.withColumns({c: F.lit(v) for c, v in stamp.items()})
    head = spark.createDataFrame([(-2, 0, None, None, *stamp.values())], cells.select("cell", "size", "least_cos", "centre", *stamp).schema)
    try:
        every = versioned.manifest(spark, path)["batches"].get("index", -1) + 1
        versioned.apply(spark, path, {"vectors": versioned.Change(placed, "id", "cell", replace=True), "cells": versioned.Change(cells.select(*head.columns).unionByName(head), "cell", "backend", replace=True)}, "index", every)
    finally:
        placed.unpersist()
        unit.unpersist()


def fits(spark: SparkSession, path: str, stamp: dict) -> bool:
    """Whether the stored index was made of vectors with this stamp."""
    if "cells" not in versioned.manifest(spark, path)["tables"]:
        return False
    found = versioned.read(spark, path, "cells").where("cell = -2").select(*stamp).first()
    return found is not None and found.asDict() == stamp


def load_or_build(vectors: DataFrame, path: str, backend: str = "given", force: bool = False) -> bool:
    """See that the store holds an index of vectors; whether it was made anew."""
    stamp = stamp_of(vectors, backend)
    if not force and fits(vectors.sparkSession, path, stamp):
        return False
    build(vectors, path, backend, stamp)
    return True


def search(queries: DataFrame, path: str, k: int = 3, score_threshold: float = 0.0, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The k best vectors (q_id, id, score, rank) of each query (q_id, q_embedding), the same as those of retrieve_topk(), and q_id, cells, looked_into."""
    spark = queries.sparkSession
    version = versioned.manifest(spark, path)["version"] if version is None else version
    vectors = versioned.read(spark, path, "vectors", version).select("id", "embedding", "cell")
    stored = versioned.read(spark, path, "cells", version).where("cell <> -2")
    rows = stored.select("cell", "least_cos", "centre", "size").orderBy("cell").collect()  # at most MOST_CELLS + 1
    dim = max((len(r.centre) for r in rows if r.centre), default=0)
    centres = np.array([r.centre or [0.0] * dim for r in rows]).reshape(len(rows), dim)
    cells, spread = np.array([r.cell for r in rows], np.int32), np.arccos(np.clip([r.least_cos if r.cell != ZERO else 1.0 for r in rows], -1, 1))
    parts = np.array([-(-r.size * (dim * 8 + 16) // BLOCK_BYTES) for r in rows], np.int64)  # a large cell is dealt to several tasks
    shared = spark.sparkContext.broadcast((centres, cells, spread, parts))
    q = queries.where(comparable("q_embedding")).select("q_id", l2_normalize(F.col("q_embedding").cast("array<double>")).alias("q_embedding"))
    blocks = max(1, -(-bytes_of(q.withColumn("__dim", F.size("q_embedding"))) // (QUERY_BLOCKS * BLOCK_BYTES)))
    part = F.pmod(F.xxhash64("id", "embedding"), F.ceil(F.col("size") * (dim * 8 + 16) / BLOCK_BYTES)).cast("int")
    vectors = vectors.join(F.broadcast(stored.select("cell", "size")), "cell").select("id", "embedding", "cell", part.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    kind = queries.schema["q_id"].dataType.simpleString()

    def bounds(v: np.ndarray) -> np.ndarray:
        """The largest score that a vector of each cell can have, as scores are rounded."""
        centres, cells, spread, _ = shared.value
        if not len(cells):
            return np.zeros((len(v), 0))
        angle = np.arccos(np.clip(v @ centres.T, -1, 1))
        size = np.linalg.norm(v, axis=1, keepdims=True)
        return np.where(cells == ZERO, 0.0, np.cos(np.maximum(angle - spread, 0)) * np.minimum(size, 1)) + 2e-6

    def chosen(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, cells, _, parts = shared.value
            for batch in batches:
                v = batch.column("q_embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                bound = bounds(v)
                rank = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1)
                take = rank < PROBES
                kth = batch.column("kth").to_numpy(zero_copy_only=False).astype(float)
                if not first:
                    take = ~take & (bound >= np.where(np.isnan(kth), -np.inf, kth)[:, None])
                i, c = np.nonzero(take)
                many = parts[c]
                i, c, part = np.repeat(i, many), np.repeat(c, many), np.arange(many.sum()) - np.repeat(many.cumsum() - many, many)
                at = pa.array(i)
                yield pa.record_batch([batch.column(n).take(at) for n in ("q_id", "q_embedding", "kth", "block")] + [pa.array(cells[c]), pa.array(part.astype(np.int32))], ["q_id", "q_embedding", "kth", "block", "cell", "part"])

        return run

    best = W.partitionBy("q_id").orderBy(F.desc("score"), "id")
    top = lambda d: d.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    keys = ["cell", "part", "block"]
    scored = lambda pairs: best_of_blocks(pairs, vectors, keys, k)
    schema = f"q_id {kind}, q_embedding array<double>, kth double, block int, cell int, part int"
    asked = q.where("size(q_embedding) > 0").withColumn("block", F.pmod(F.xxhash64("q_id"), F.lit(blocks)).cast("int"))
    near = asked.withColumn("kth", F.lit(None).cast("double")).mapInArrow(chosen(True), schema)
    found = scored(near)
    kth = found.where(F.col("rank") == k).select("q_id", F.col("score").alias("kth"))
    rest = asked.join(kth, "q_id", "left").mapInArrow(chosen(False), schema)
    out = top(found.drop("rank").unionByName(scored(rest).drop("rank"))).where(F.col("score") >= score_threshold)
    near, rest = (d.where("part = 0") for d in (near, rest))
    looked = near.select("q_id").unionByName(rest.select("q_id")).groupBy("q_id").agg(F.count("*").alias("looked_into")).withColumn("cells", F.lit(len(rows)).cast("long"))
    return out, looked
