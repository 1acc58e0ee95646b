"""Tiles and label files."""

from __future__ import annotations

import io
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BANDS = 6
CLOUD = 0.8  # reflectance of the green band from which a pixel counts as cloud
BATCH = "32m"  # bytes of files that go to Python at a time
TILES = 32 << 20  # bytes of decoded tiles that go back at a time
ROWS = 10_000  # tiles that go back at a time, at most
ARCHIVE = 8 << 20  # bytes of arrays in an archive


def scan_tiles(spark: SparkSession, folder: str, first_n: int | None = None) -> DataFrame:
    """Array files in the order of their paths: path, scene_id (the file's stem) and body. A *.npy file is a tile, a *.npz archive holds many.

    The driver lists the files, so that many tiles should lie in archives (write_npz): a file of a few megabytes costs it no more than one tile.
    """
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.np[yz]").load(folder)
    rows = rows.select("path", F.regexp_extract("path", r"([^/]+)\.np[yz]$", 1).alias("scene_id"), F.col("content").alias("body"))
    return rows if first_n is None else rows.orderBy("path").limit(first_n)


def decode_tiles(files: DataFrame, bands: int = BANDS) -> tuple[DataFrame, DataFrame]:
    """Tiles (scene_id, h, w, bands as float32 bytes, cloud_cover, raw_bytes) of scan_tiles() rows, and the quarantine: path and reason.

    A body must be an array file of shape (h, w, bands) of numbers, or an archive of such files, whose tiles are named by its members; a file without bytes has no row. Bodies
    come from Spark's own reader, so that any store that it reads will do, and go to Python BATCH bytes at a time. cloud_cover is the share of pixels over CLOUD in the second
    band, 0 for a tile without pixels.
    """
    conf = files.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)

    def one(body: bytes | None) -> tuple[np.ndarray | None, str | None]:
        try:
            tile = np.load(io.BytesIO(body or b""), allow_pickle=False)
        except (ValueError, EOFError, OSError) as e:
            return None, f"not an array file: {type(e).__name__}"
        if not isinstance(tile, np.ndarray):
            return None, "an archive in an archive"
        if tile.ndim != 3 or tile.shape[2] != bands:
            return None, f"shape {tile.shape}"
        if tile.dtype.kind not in "fiu":
            return None, f"type {tile.dtype}"
        return np.ascontiguousarray(tile, np.float32), None

    def every(path: str, scene: str, body: bytes | None) -> Iterator[tuple]:
        """path, scene_id, tile and reason of each array of a file."""
        if not (body or b"").startswith(b"PK"):
            yield path, scene, *one(body)
            return
        try:
            archive = zipfile.ZipFile(io.BytesIO(body))
        except zipfile.BadZipFile as e:
            yield path, scene, None, f"not an archive: {type(e).__name__}"
            return
        with archive:
            for name in archive.namelist():
                try:
                    found = one(archive.read(name))
                except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError) as e:
                    found = None, f"not an archive's member: {type(e).__name__}"
                yield f"{path}#{name}", name.rsplit("/", 1)[-1].removesuffix(".npy"), *found

    names, kinds = ["path", "scene_id", "h", "w", "bands", "cloud_cover", "raw_bytes", "reason"], (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.int64(), pa.string())
    made = lambda rows: pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for file in zip(*(c.to_pylist() for c in batch.columns)):
                for path, scene, tile, reason in every(*file):
                    if tile is None:
                        rows.append((path, scene, None, None, None, None, None, reason))
                    else:
                        cloud = float((tile[:, :, 1] > CLOUD).mean()) if tile.size else 0.0
                        rows.append((path, scene, *tile.shape[:2], tile.tobytes(), cloud, tile.nbytes, None))
                        held += tile.nbytes
                    if held >= TILES or len(rows) >= ROWS:
                        yield made(rows)
                        rows, held = [], 0
            if rows:
                yield made(rows)

    rows = files.select("path", "scene_id", "body").mapInArrow(run, "path string, scene_id string, h int, w int, bands binary, cloud_cover double, raw_bytes long, reason string")
    return rows.where("reason is null").drop("path", "reason"), rows.where("reason is not null").select("path", "reason")


def write_npy(tiles: DataFrame, folder: str, bands: int = BANDS) -> DataFrame:
    """Write each tile (scene_id, h, w, bands as float32 bytes) as an array file of a shared folder; one row for each file: scene_id, path.

    The files are written as the result is read. A file gets its name when it is whole, so that a task that is run again leaves no half of one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for scene, h, w, body in zip(*(c.to_pylist() for c in batch.columns)):
                store, root = fs.FileSystem.from_uri(folder if urlparse(folder).scheme else f"file://{folder}")
                store.create_dir(root, recursive=True)
                out = io.BytesIO()
                np.save(out, np.frombuffer(body, np.float32).reshape(h, w, bands))
                part = f"{root}/.{scene}.{id(batch)}"
                with store.open_output_stream(part) as sink:
                    sink.write(out.getvalue())
                store.move(part, f"{root}/{scene}.npy")
                made.append((scene, f"{root}/{scene}.npy"))
            cols = list(zip(*made)) or [[], []]
            yield pa.record_batch([pa.array(c, pa.string()) for c in cols], ["scene_id", "path"])

    return tiles.select("scene_id", "h", "w", "bands").mapInArrow(run, "scene_id string, path string")


def write_npz(tiles: DataFrame, folder: str, bands: int = BANDS, size: int = ARCHIVE) -> DataFrame:
    """Write tiles (scene_id, h, w, bands as float32 bytes) as archives of array files, each of about `size` bytes of arrays; one row for each tile: scene_id, path.

    The files are written as the result is read. The tiles of a partition are in the order of their names, so that a task that is run again writes the same archives
    under the same names; each gets its name when it is whole.
    """
    job = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, heads = TaskContext.get(), {}
        store, root = fs.FileSystem.from_uri(folder if urlparse(folder).scheme else f"file://{folder}")
        store.create_dir(root, recursive=True)

        def member(h: int, w: int, body: bytes) -> bytes:
            if (h, w) not in heads:  # array files of one size begin alike
                out = io.BytesIO()
                np.save(out, np.frombuffer(body, np.float32).reshape(h, w, bands))
                heads[h, w] = out.getvalue()[: out.tell() - len(body)]
            return heads[h, w] + body

        def archives() -> Iterator[list]:
            held, rows = 0, []
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    rows.append(row)
                    held += len(row[-1])
                    if held >= size:
                        yield rows
                        held, rows = 0, []
            if rows:
                yield rows

        for n, rows in enumerate(archives()):
            out, name = io.BytesIO(), f"{root}/{job}-{task.partitionId():06d}-{n:06d}.npz"
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as archive:
                for scene, h, w, body in rows:
                    archive.writestr(f"{scene}.npy", member(h, w, body))
            part = f"{root}/.{name.rsplit('/', 1)[1]}.{task.taskAttemptId()}"
            with store.open_output_stream(part) as sink:
                sink.write(out.getbuffer())
            store.move(part, name)
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([name] * len(rows), pa.string())], ["scene_id", "path"])

    return tiles.select("scene_id", "h", "w", "bands").sortWithinPartitions("scene_id").mapInArrow(run, "scene_id string, path string")


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Tile rows as Parquet; a tile's id comes from its scene and place."""
    tiles.withColumn("tile_id", F.concat_ws("_", "scene_id", F.lpad(F.col("ty").cast("string"), 4, "0"), F.lpad(F.col("tx").cast("string"), 4, "0"))).write.mode("overwrite").parquet(path)


def parse_labels(lines: DataFrame) -> DataFrame:
    """lines (stem, value) to label rows; lines that don't have five numbers go."""
    parts = F.split(F.trim("value"), r"\s+")
    five = lines.withColumn("p", parts).where(F.size("p") == 5)
    number = lambda i: F.expr(f"try_cast(p[{i}] as double)")
    out = five.select("stem", F.expr("try_cast(try_cast(p[0] as double) as int)").alias("cls"), *[number(i + 1).alias(c) for i, c in enumerate(("cx", "cy", "w", "h"))])
    return out.dropna()


def scan_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Label files of a folder. The stem is what stands before a tab in a line (write_labels), else the file's name.

    An empty file gives no rows, nor does a folder without label files; a missing folder is an error.
    """
    lines = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").text(folder)
    named = F.col("value").contains("\t")
    stem = F.when(named, F.substring_index("value", "\t", 1)).otherwise(F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", ""))
    return parse_labels(lines.select(stem.alias("stem"), F.when(named, F.expr("substring(value, instr(value, '\\t') + 1)")).otherwise(F.col("value")).alias("value")))


def label_lines(labels: DataFrame) -> DataFrame:
    """stem and the text line of each label."""
    return labels.select("stem", F.format_string("%d %.6f %.6f %.6f %.6f", "cls", "cx", "cy", "w", "h").alias("value"))


def write_labels(labels: DataFrame, path: str) -> None:
    """Label lines with their stem before a tab; the lines of a stem share a file, and a file holds many stems."""
    lines = label_lines(labels).repartition("stem").sortWithinPartitions("stem")
    lines.select(F.concat(F.col("stem").cast("string"), F.lit("\t"), "value").alias("value")).write.mode("overwrite").text(path)
