"""Retrieval over knowledge chunks."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, BucketedRandomProjectionLSH, HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from passwatch.functions.geo import l2_normalize
from passwatch.functions.text import fixed, percent

BLOCK_BYTES = 4 << 20  # vectors of a block, as doubles
QUERY_BLOCKS = 4  # a block of queries holds so many times as much, since each copies all vectors
PRODUCTS = 1 << 20  # products that a task holds at a time


def build_vector_table(chunks: DataFrame, features: int = 256, backend: str = "hashing-tf-idf") -> DataFrame:
    """id, embedding (unit length), dim and backend of "title. content" of every chunk. The IDF is fitted over all chunks."""
    rows = chunks.select("id", F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("content", F.lit(""))).alias("text"))
    stages = [Tokenizer(inputCol="text", outputCol="words"), HashingTF(inputCol="words", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="idf"), Normalizer(inputCol="idf", outputCol="unit")]
    made = Pipeline(stages=stages).fit(rows).transform(rows)
    return made.select("id", vector_to_array("unit").alias("embedding"), F.lit(features).alias("dim"), F.lit(backend).alias("backend"))


def load_vector_table(df: DataFrame, dim: int, backend: str) -> DataFrame:
    """Only vectors that this query side can be compared with."""
    return df.where((F.col("dim") == dim) & (F.col("backend") == backend))


def half_up(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """x rounded as F.round() does, half up by the shortest decimal form, in units of the last digit (int64); x must be finite."""
    scaled = np.abs(x) * 10.0**digits
    out = np.floor(scaled + 0.5)
    near_tie = np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4
    if near_tie.any():
        some, at = np.unique(np.abs(x[near_tie]), return_inverse=True)
        step = Decimal(1).scaleb(-digits)
        out[near_tie] = np.array([int(Decimal(repr(float(v))).quantize(step, ROUND_HALF_UP).scaleb(digits)) for v in some], float)[at]
    return (np.sign(x) * out).astype(np.int64)


def unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    """An Arrow column of arrays of one length as rows of unit length; zero rows stay."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    v = flat.reshape(len(column), -1)
    size = np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
    return np.divide(v, size, out=v.copy(), where=size != 0)


def best_of_block(k: int):
    """A function of a block of queries (q_id, q_embedding, kth) and one of vectors (id, embedding): the k best of each query, q_id, id and score.

    Scores are products of unit vectors, rounded to six digits; of equal scores the smaller id is the better. Scores below kth, where there is one, are left out.
    """

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        order = pc.sort_indices(vectors.select(["id"]), sort_keys=[("id", "ascending")], null_placement="at_start")
        vectors = vectors.take(order)
        n, least = len(vectors), queries.column("kth").to_numpy().astype(float)
        i, j, score = [], [], []
        if n and len(queries):
            a, b = unit_rows(queries.column("q_embedding")), unit_rows(vectors.column("embedding"))
            step, take = max(1, PRODUCTS // n), min(k, n)
            for at in range(0, len(a), step):
                raw = a[at : at + step] @ b.T
                bad = np.isnan(raw)
                units = half_up(np.where(bad, 0.0, raw))
                key = np.where(bad, 1 << 31, units) * n + (n - 1 - np.arange(n))  # not-a-number ranks first, as in a sort by Spark
                top = np.argpartition(-key, take - 1, axis=1)[:, :take]
                found = np.take_along_axis(np.where(bad, np.nan, units / 1e6), top, 1)
                r, c = np.nonzero(~(found < least[at : at + step, None]))
                i.append(r + at)
                j.append(top[r, c])
                score.append(found[r, c])
        i, j, score = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((i, np.int64), (j, np.int64), (score, float)))
        return pa.table({"q_id": queries.column("q_id").take(pa.array(i)), "id": vectors.column("id").take(pa.array(j)), "score": pa.array(score)})

    return run


def best_of_blocks(queries: DataFrame, vectors: DataFrame, keys: list[str], k: int) -> DataFrame:
    """q_id, id, score and rank of the k best of each query among the vectors of all blocks (keys) that the query is dealt to."""
    q = queries if "kth" in queries.columns else queries.withColumn("kth", F.lit(None).cast("double"))
    kinds = f"q_id {queries.schema['q_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"
    q = q.withColumn("kth", F.coalesce("kth", F.lit(float("-inf"))))
    found = q.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInArrow(best_of_block(k), kinds)
    best = W.partitionBy("q_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def comparable(v: str) -> Column:
    """Whether a vector has a product with others: it is not null and holds no null."""
    return F.col(v).isNotNull() & ~F.exists(v, lambda x: x.isNull())


def bytes_of(rows: DataFrame) -> int:
    """Bytes of vectors of __dim components as doubles, with their ids."""
    return rows.agg(F.sum(F.col("__dim") * 8 + 16)).first()[0] or 0


def retrieve_topk(queries: DataFrame, vectors: DataFrame, k: int = 3, score_threshold: float = 0.0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k best vectors (id, embedding) of each query (q_id, q_embedding) by inner product of unit vectors, then those that reach the threshold.

    Exact search by a stated query set: every query meets all vectors of its dimension. Both sides are counted and dealt to blocks of about block_bytes; a task
    multiplies a block of queries with one of vectors and keeps the k best of each query. Nothing passes the driver but the counts.
    """
    q = queries.where(comparable("q_embedding")).select("q_id", "q_embedding", F.size("q_embedding").alias("__dim"))
    v = vectors.where(comparable("embedding")).select("id", "embedding", F.size("embedding").alias("__dim"))
    blocks = [max(1, -(-bytes_of(d) // most)) for d, most in ((q, QUERY_BLOCKS * block_bytes), (v, block_bytes))]
    dealt = lambda d, name, n: F.pmod(F.xxhash64(*d.columns), F.lit(n)).cast("int").alias(name)
    every = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    q = q.select("*", dealt(q, "__q", blocks[0]), every("__v", blocks[1]))
    v = v.select("*", dealt(v, "__v", blocks[1]), every("__q", blocks[0]))
    return best_of_blocks(q, v, ["__dim", "__q", "__v"], k).where(F.col("score") >= score_threshold)


def retrieve_approx(queries: DataFrame, vectors: DataFrame, distance: float, bucket: float = 0.5, tables: int = 4) -> DataFrame:
    """Pairs (q_id, id) within a Euclidean distance of unit vectors, by locality-sensitive hashing: for many queries and many vectors."""
    from pyspark.ml.functions import array_to_vector

    q = queries.select("q_id", array_to_vector(l2_normalize("q_embedding")).alias("v"))
    v = vectors.select("id", array_to_vector(l2_normalize("embedding")).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=7).fit(v)
    return model.approxSimilarityJoin(q, v, distance, "distance").select("datasetA.q_id", "datasetB.id", "distance")


def hydrate_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    return hits.join(chunks, "id")


def chunks_by_category(chunks: DataFrame, category: str) -> DataFrame:
    return chunks.where(F.col("category") == category)


def chunks_by_tags(chunks: DataFrame, tags: list[str]) -> DataFrame:
    """Chunks that share any tag."""
    return chunks.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))


def categories(chunks: DataFrame) -> DataFrame:
    return chunks.select("category").distinct().orderBy("category")


def format_context(hits: DataFrame, header: str = "RETRIEVED MARITIME KNOWLEDGE CONTEXT") -> DataFrame:
    """q_id and one text block of its chunks (id, title, content) in the order of rank."""
    line = F.concat(F.lit("\n["), F.col("id").cast("string"), F.lit("] "), "title", F.lit("\n"), "content")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    return hits.groupBy("q_id").agg(F.concat_ws("\n", F.lit(f"\n--- {header} ---"), listed, F.lit("--- END CONTEXT ---\n")).alias("context"))


def retrieval_query_text(scenes: DataFrame, detections: DataFrame) -> DataFrame:
    """The search text of each scene. scenes: cloud_cover and footprint bounds; types are sorted."""
    by = detections.groupBy("scene_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.coalesce("type", F.lit("unknown")))), ", ").alias("types"), F.max(F.coalesce("conf", F.lit(1.0)) < 0.55).alias("low"))
    s = scenes.join(by, "scene_id", "left")
    middle = lambda a, z: (F.coalesce(a, F.lit(0.0)) + F.coalesce(z, F.lit(0.0))) / 2
    return s.select(
        "scene_id",
        F.concat_ws(
            ". ",
            F.when(F.col("types").isNotNull(), F.concat("types", F.lit(" detection"))),
            F.concat(F.lit("Indian Ocean maritime zone lat "), fixed(middle("lat_min", "lat_max"), 2), F.lit(" lon "), fixed(middle("lon_min", "lon_max"), 2)),
            F.when(F.col("cloud_cover") > 0.3, F.concat(F.lit("cloud cover "), percent("cloud_cover"), F.lit(" degraded sensing"))),
            F.when(F.col("n") >= 3, "vessel cluster multiple detections"),
            F.when(F.col("low"), "low confidence detection uncertain identification"),
        ).alias("query"),
    )
