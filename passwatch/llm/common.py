"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed to a kernel in slices of about this many bytes, so that a task's memory follows the slice and the
#: longest text, not the partition.
SLICE_BYTES = 1 << 20
#: Edges that a task of components() holds at once.
EDGES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back, so that a lost executor costs a read."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by written() that no later plan reads."""
    if path := getattr(df, "_written_at", None):
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(where, True)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about `limit` bytes of `column`; one text is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(size) // limit
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow string or binary column as one byte array, and n + 1 offsets; a null is an empty text."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    filled = pc.fill_null(column.cast(kind), b"")
    offset = np.frombuffer(filled.buffers()[1], np.int64 if kind == pa.large_binary() else np.int32)
    offset = offset[filled.offset : filled.offset + len(filled) + 1].astype(np.int64)
    data = np.frombuffer(filled.buffers()[2], np.uint8) if filled.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offset[0] : offset[-1]], offset - offset[0]


def texts_of(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session that hands Arrow batches of at most 8 MB to Python unless it says otherwise: a batch of long texts is bounded, too."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return df


def map_arrow(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str, limit: int = SLICE_BYTES) -> DataFrame:
    """Apply a kernel to slices of a DataFrame by the size of the `text` column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, limit):
            yield kernel(batch)

    return small_batches(df).mapInArrow(run, schema)


#: The classes of bytes that op 7's contract and the word kernels use.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3  # odd, so that it has an inverse modulo 2**64
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher."""
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n at least."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16) * 5 // 4
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            run = np.full(size, np.uint64(base))
            run[0] = 1
            _POWERS[name] = np.cumprod(run, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """s[i] is the polynomial of values[:i]; range_hash() gives that of a range from it."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(up[: len(values)] * (values.astype(np.uint64) + np.uint64(1)), out=out[1:], dtype=np.uint64)
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] that doesn't depend on where the range lies."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def words_of(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every maximal run of word bytes; no word crosses a text's edge."""
    inside = is_word[data]
    flag = np.zeros(len(data) + 1, bool)
    flag[1:-1] = inside[1:] != inside[:-1] if len(data) else False
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True  # also the end of the last text
    cut = flag | begins
    cut[0] = cut[-1] = True
    edge = np.flatnonzero(cut)
    start, end = edge[:-1], edge[1:]
    keep = inside[start] if len(data) else np.zeros(0, bool)
    start, end = start[keep], end[keep]
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating stars. edges: long columns a, b; loops and repeats do no harm.

    Returns node, root with one row for each node that has an edge to another; root is the smallest node of its component.
    Every round writes its edges to the shared folder. Each partition then replaces its own edges by a spanning star,
    which keeps the components and leaves few rounds, and none where the edges fill one partition only: a round is jobs and plans
    that the driver has to hold. The rounds end when the edges are stars. Minima are combined before their shuffle and the joins carry only
    ids, by merging, so that AQE can split the edges of a node with very many of them and no rows pass the driver. Empty edges give an empty result.
    """

    def spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 2
        for batch in batches:
            held = [np.concatenate([x, y.to_numpy()]) for x, y in zip(held, batch.columns)]
            if len(held[0]) >= EDGES:
                held = star_of(*held)
            if len(held[0]) >= EDGES // 2:  # still: the next edges begin anew, so that a task holds so many at most
                yield pa.record_batch(held, ["a", "b"])
                held = [x[:0] for x in held]
        yield pa.record_batch(star_of(*held), ["a", "b"])

    def stars(some: DataFrame) -> DataFrame:
        return some.mapInArrow(spanning, "a long, b long")

    cur = written(stars(stars(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")).distinct()), "edges")
    while True:
        ends = cur.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(cur.select(F.col("b").alias("node"), F.lit(0).alias("up")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where("up > 1 or up = 1 and n > 1").isEmpty():
            out = cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
            out._written_at = cur._written_at  # for discard()
            return out
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        new = written(stars(small), "edges")
        discard(cur)
        cur = new


def star_of(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """A spanning star (node, smallest node) of each component of the edges (a, b), by repeated minima."""
    if not len(a):
        return [np.zeros(0, np.int64), np.zeros(0, np.int64)]
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        if (rx == ry).all():
            break
        low, high = np.minimum(rx, ry), np.maximum(rx, ry)
        np.minimum.at(root, high, low)
        while not np.array_equal(up := root[root], root):
            root = up
    keep = root != np.arange(len(nodes))
    return [nodes[keep], nodes[root[keep]]]
