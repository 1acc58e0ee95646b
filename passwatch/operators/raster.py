"""Rasters as pixel rows (scene_no, y, x, bands) for relational work, and as tile rows for kernels."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passwatch.operators.detect import CLASSES, CONF_LEAST, IOU_MOST, kept_boxes

BANDS = ("b2", "b3", "b4", "b8", "b11", "b12")  # fixed values: the six bands in their order
STRIP = 1 << 18  # pixels of a resized band that a task makes at a time
ANCHORS = 1 << 16  # boxes that score_tiles() hands over at a time
#: Simulated bands as (red, green, blue) weights.
MIXES = {"b8": (0.25, 0.45, 0.30), "b11": (0.80, 0.30, -0.20), "b12": (0.70, 0.20, -0.10)}


def assemble_bands(values: DataFrame, keys: tuple[str, ...] = ("scene_no", "y", "x")) -> DataFrame:
    """Long band values (keys, band, value) to one row a pixel; pixels that lack one of the six bands go."""
    wide = values.groupBy(*keys).agg(*[F.first(F.when(F.col("band") == b, F.col("value")), ignorenulls=True).alias(b) for b in BANDS])
    return wide.dropna(subset=list(BANDS))  # one grouping: a task adds up a pixel's bands before the shuffle


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def normalize_reflectance(pixels: DataFrame, scale: float = 10_000.0) -> DataFrame:
    return pixels.withColumns({b: clip01(F.col(b) / scale) for b in BANDS})


def band_math(pixels: DataFrame, formulas: dict[str, str] | None = None) -> DataFrame:
    """New bands as clipped SQL expressions over the pixel's bands; by default the mixes that simulate b8, b11 and b12 from colour."""
    formulas = formulas or {name: " + ".join(f"({w}D) * {c}" for w, c in zip(mix, ("b4", "b3", "b2"))) for name, mix in MIXES.items()}
    return pixels.withColumns({name: clip01(F.expr(text)) for name, text in formulas.items()})


def cloud_cover(pixels: DataFrame, scene: str = "scene_no") -> DataFrame:
    """The share of pixels whose green band is above 0.8."""
    return pixels.groupBy(scene).agg(F.round(F.avg((F.col("b3") > 0.8).cast("double")), 6).alias("cloud_cover"))


def tile_scene(pixels: DataFrame, size: int = 64, overlap: int = 0, height: int = 640, width: int = 640, pad: bool = False) -> DataFrame:
    """pixels with ty, tx (tile numbers) and py, px (place in the tile): one row for each tile that holds a pixel.

    pad mirrors the scene at its lower and right edges, so that the last tiles are full.
    """
    step = size - overlap

    def cut(at: str, length: int, name: str, place: str, df: DataFrame) -> DataFrame:
        if pad:
            last = -(-length // step) * step - step + size
            mirrored = F.array_distinct(F.array(F.col(at), 2 * (length - 1) - F.col(at)))
            df = df.withColumn("__p", F.explode(F.filter(mirrored, lambda v: (v < last) & ((v == F.col(at)) | (v >= length)))))
        else:
            df = df.withColumn("__p", F.col(at))
        first = F.greatest(F.lit(0), F.ceil((F.col("__p") - size + 1) / step).cast("int"))
        final = F.least(F.lit((length - 1) // step), F.floor(F.col("__p") / step).cast("int"))
        df = df.withColumn(name, F.explode(F.when(first <= final, F.sequence(first, final)).otherwise(F.array().cast("array<int>"))))
        return df.withColumn(place, (F.col("__p") - F.col(name) * step).cast("int")).drop("__p")

    return cut("x", width, "tx", "px", cut("y", height, "ty", "py", pixels))


def weights(n: int, to: int) -> np.ndarray:
    """For each target row (to) the weights of the n source rows."""
    place = np.clip((np.arange(to) + 0.5) * (n / to) - 0.5, 0.0, n - 1.0)
    return np.maximum(0.0, 1.0 - np.abs(place[:, None] - np.arange(n)[None, :]))


def upsampled(y: np.ndarray, x: np.ndarray, value: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, ...]:
    """Grids of the targets: their value, whether a source touches them, and whether one with a value does. rows and cols are weights(); masked values are null.

    What is not finite spreads to the targets that it touches, and no further.
    """
    size = rows.shape[1], cols.shape[1]
    null = np.ma.getmaskarray(value)
    plain = np.ma.getdata(value)
    there, here, odd = np.zeros(size), np.zeros(size), []
    held = np.zeros(size)
    np.add.at(there, (y, x), 1.0)
    np.add.at(here, (y, x), ~null)
    finite = np.isfinite(plain) & ~null
    np.add.at(held, (y[finite], x[finite]), plain[finite])
    spread = lambda a: (rows > 0).astype(float) @ a @ (cols > 0).astype(float).T > 0
    out = rows @ held @ cols.T
    for sign in (np.isnan(plain), plain == np.inf, plain == -np.inf):
        at = np.zeros(size)
        np.add.at(at, (y[sign & ~null], x[sign & ~null]), 1.0)
        odd.append(spread(at) if at.any() else np.zeros(out.shape, bool))
    nan, up, down = odd
    out = np.where(nan | (up & down), np.nan, np.where(up, np.inf, np.where(down, -np.inf, out)))
    return out, spread(there), spread(here)


def strips(pixels: DataFrame, columns: list[str], rows: np.ndarray, width: int, high: int) -> DataFrame:
    """columns, y and x of the source pixels within the grid, dealt to the strips (__strip) of `high` target rows that they touch."""
    touch = [np.flatnonzero(rows[:, k] > 0) // high for k in range(rows.shape[1])]
    first, last = (F.element_at(F.lit([int(t[at]) if len(t) else at for t in touch]), F.col("y").cast("int") + 1) for at in (0, -1))  # of an untouched row: none
    inside = pixels.where((F.col("y") >= 0) & (F.col("y") < rows.shape[1]) & (F.col("x") >= 0) & (F.col("x") < width))
    into = F.when(last >= first, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<int>"))
    return inside.select(*columns, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.explode(into).alias("__strip"))


def masked(column: pa.ChunkedArray) -> np.ndarray:
    """A column of doubles with its nulls masked."""
    return np.ma.masked_array(column.to_numpy().astype(float), column.is_null().to_numpy())


def resize_bilinear(pixels: DataFrame, height: int, width: int, to_height: int, to_width: int, band: str = "value", keys: tuple[str, ...] = ("scene_no",)) -> DataFrame:
    """A band (keys, y, x, value) on another grid: each target pixel takes four neighbours by weight, edges repeated.

    Targets lie in strips of about STRIP pixels. A source goes to the strips that it touches, once or twice, and a strip is two products of weights with a dense
    grid; no row is made for a source and a target.
    """
    high = max(1, STRIP // max(to_width, 1))
    rows, cols = weights(height, to_height), weights(width, to_width)
    dealt = strips(pixels.withColumn("__value", F.col(band).cast("double")), [*keys, "__value"], rows, width, high)
    kinds = [(k, pixels.schema[k].dataType.simpleString()) for k in keys]

    def run(key: tuple, source: pa.Table) -> pa.Table:
        strip = key[-1].as_py()
        out, there, here = upsampled(source.column("y").to_numpy(), source.column("x").to_numpy(), masked(source.column("__value")), rows[strip * high : (strip + 1) * high], cols)
        y, x = np.nonzero(there)
        made = {k: pa.repeat(v, len(y)) for k, v in zip(keys, key)}
        return pa.table({**made, "y": pa.array((y + strip * high).astype(np.int32)), "x": pa.array(x.astype(np.int32)), band: pa.array(out[y, x], mask=~here[y, x])})

    schema = ", ".join([*(f"`{k}` {t}" for k, t in kinds), f"y int, x int, `{band}` double"])
    return dealt.groupBy(*keys, "__strip").applyInArrow(run, schema)


def stack_bands(fine: DataFrame, coarse: DataFrame, height: int, width: int, keys: tuple[str, ...] = ("scene_no",)) -> DataFrame:
    """Four fine bands and two coarse ones (long form, band and value) on the fine grid, one row a pixel; pixels that lack one of the six go.

    Strips of the fine grid meet the coarse pixels that touch them. The coarse bands are resized there and read where a fine pixel lies, so that no row is made for the others.
    """
    high = max(1, STRIP // max(width, 1))
    rows, cols = weights(height // 2, height), weights(width // 2, width)
    low = strips(coarse.withColumn("__value", F.col("value").cast("double")), [*keys, "band", "__value"], rows, width // 2, high)
    wide = fine.groupBy(*keys, "y", "x").agg(*[F.first(F.when(F.col("band") == b, F.col("value").cast("double")), ignorenulls=True).alias(b) for b in BANDS[:4]])
    wide = wide.dropna(subset=list(BANDS[:4])).where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width))
    wide = wide.withColumns({"y": F.col("y").cast("int"), "x": F.col("x").cast("int")}).withColumn("__strip", F.floor(F.col("y") / high).cast("int"))

    def run(key: tuple, pixels: pa.Table, source: pa.Table) -> pa.Table:
        strip = key[-1].as_py()
        y, x, band = pixels.column("y").to_numpy(), pixels.column("x").to_numpy(), np.array(source.column("band").to_pylist(), object)
        out = pixels.drop_columns(["__strip"])
        for b in BANDS[4:]:
            some = source.filter(pa.array(band == b, pa.bool_()))
            value, _, here = upsampled(some.column("y").to_numpy(), some.column("x").to_numpy(), masked(some.column("__value")), rows[strip * high : (strip + 1) * high], cols)
            at = y - strip * high, x
            out = out.append_column(b, pa.array(value[at], mask=~here[at]))
        return out

    schema = ", ".join(f"`{c}` {t}" for c, t in wide.drop("__strip").dtypes) + "".join(f", `{b}` double" for b in BANDS[4:])
    return wide.groupBy(*keys, "__strip").cogroup(low.groupBy(*keys, "__strip")).applyInArrow(run, schema).dropna(subset=list(BANDS))


def batch_tensor(tile: np.ndarray) -> np.ndarray:
    """(H, W, 6) to (1, 6, H, W) float32; several tiles of one size, (N, H, W, 6), to (N, 6, H, W)."""
    tiles = np.asarray(tile, np.float32)
    return np.ascontiguousarray((tiles[None] if tiles.ndim == 3 else tiles).transpose(0, 3, 1, 2))


def score_tiles(tiles: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], body: str = "bands") -> DataFrame:
    """Run a detector over tile rows (scene_id, h, w, bands as float32 bytes): anchor, cx, cy, w, h, scores of every box.

    `load` makes the model once for each task; it takes a (1, 6, H, W) tensor and returns (1, 4 + classes, N). The boxes of many tiles go back
    at a time, about ANCHORS of them.
    """

    def rows(scenes: list[str], raws: list[np.ndarray]) -> pa.RecordBatch:
        counts = [raw.shape[1] for raw in raws]
        kinds = np.repeat([raw.shape[0] - 4 for raw in raws], counts)
        anchors = np.concatenate([np.arange(n, dtype=np.int32) for n in counts])
        corners = np.concatenate([raw[:4] for raw in raws], axis=1).astype(np.float32)
        scores = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(kinds)]).astype(np.int32), pa.array(np.concatenate([raw[4:].T.ravel() for raw in raws]).astype(np.float32)))
        named = pa.array(scenes, pa.string()).take(pa.array(np.repeat(np.arange(len(scenes)), counts)))
        return pa.record_batch([named, pa.array(anchors), *(pa.array(c) for c in corners), scores], ["scene_id", "anchor", "cx", "cy", "w", "h", "scores"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            scenes, raws, held = [], [], 0
            for scene, h, w, tile in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                raws.append(model(batch_tensor(np.frombuffer(tile.as_buffer(), np.float32).reshape(h, w, 6)))[0])
                scenes.append(scene)
                held += raws[-1].shape[1]
                if held >= ANCHORS:
                    yield rows(scenes, raws)
                    scenes, raws, held = [], [], 0
            if raws:
                yield rows(scenes, raws)

    return tiles.select("scene_id", "h", "w", body).mapInArrow(run, "scene_id string, anchor int, cx float, cy float, w float, h float, scores array<float>")


def detect_tiles(tiles: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], conf_least: float = CONF_LEAST, iou_most: float = IOU_MOST, clock: Callable[[], float] = time.perf_counter) -> DataFrame:
    """One row a tile, from tensor to detections in one pass: its other columns, inference_ms, and found (type, conf, x1, y1, x2, y2; best first).

    tiles: scene_id, h, w, bands and any others. `load` as in score_tiles(). A box's class is its first best score; boxes below conf_least go,
    corners are cut to whole pixels and suppressed across classes. Of equal confidences the later anchor comes first, as in nms().
    """
    others = [c for c in tiles.columns if c not in ("scene_id", "h", "w", "bands")]
    kinds = [(c, tiles.schema[c].dataType.simpleString()) for c in others]

    def found(raw: np.ndarray) -> list[dict]:
        scores = raw[4:]
        best, conf = scores.argmax(axis=0), scores.max(axis=0)
        at = np.flatnonzero(conf.astype(np.float64) >= conf_least)
        at = at[np.lexsort([-at, -conf[at]])]
        cx, cy, w, h = raw[:4, at]
        corners = [np.trunc(x).astype(np.int32) for x in (cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)]
        keep = kept_boxes(*(c.astype(float) for c in corners), iou_most) if len(at) else at
        names = [CLASSES[k] if k < len(CLASSES) else "unknown" for k in best[at][keep].tolist()]
        return [{"type": t, "conf": float(c), "x1": int(a), "y1": int(b), "x2": int(d), "y2": int(e)} for t, c, a, b, d, e in zip(names, conf[at][keep], *(c[keep] for c in corners))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            out, took = [], []
            for h, w, body in zip(batch["h"], batch["w"], batch["bands"]):
                began = clock()
                raw = model(batch_tensor(np.frombuffer(body, np.float32).reshape(h, w, -1)))[0]
                took.append((clock() - began) * 1000)
                out.append(found(raw))
            yield batch[["scene_id", *others]].assign(inference_ms=took, found=out)

    schema = ", ".join(["scene_id string", *(f"`{c}` {k}" for c, k in kinds), "inference_ms double, found array<struct<type: string, conf: double, x1: int, y1: int, x2: int, y2: int>>"])
    return tiles.mapInPandas(run, schema)


def tile_label_join(tiles: DataFrame, labels: DataFrame, key: str = "stem") -> DataFrame:
    """Tiles with their label rows; a tile without labels keeps one row of nulls."""
    return tiles.join(labels, key, "left")


def tile_footprint_join(scenes: DataFrame, footprints: DataFrame) -> DataFrame:
    from passwatch.operators.detect import default_footprint

    return default_footprint(scenes.join(footprints, "scene_id", "left"))


def dataset_stats(tiles: DataFrame, labels: DataFrame, key: str = "stem") -> DataFrame:
    """Tiles, tiles with objects, objects, and objects per tile."""
    per = tiles.join(labels.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return per.agg(F.count("*").alias("tiles"), F.count_if(F.col("n") > 0).alias("with_objects"), F.coalesce(F.sum("n"), F.lit(0)).alias("objects")).withColumn("per_tile", F.round(F.col("objects") / F.greatest(F.col("tiles"), F.lit(1)), 6))


def split_train_val(df: DataFrame, train: int, total: int, key: str = "stem") -> DataFrame:
    """Consecutive ids into train and val; ids beyond both go."""
    return df.where(F.col(key) < total).withColumn("split", F.when(F.col(key) < train, "train").otherwise("val"))
