"""Raw detector boxes to detections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passwatch.functions.geo import iou, pixel_to_latlon
from passwatch.functions.text import TYPE_CODES, lookup

CONF_LEAST = 0.35
IOU_MOST = 0.45
CLASSES = ("ship", "airplane", "storage-tank", "harbor")  # fixed values: class ids of the detector


def best_class(predictions: DataFrame, conf_least: float = CONF_LEAST) -> DataFrame:
    """predictions (scores ARRAY) with class_id (the first best score), conf and type; rows below the threshold go."""
    conf = F.array_max("scores")
    scored = predictions.withColumn("conf", conf.cast("double")).where(F.col("conf") >= conf_least)
    scored = scored.withColumn("class_id", (F.array_position("scores", F.array_max("scores")) - 1).cast("int"))
    return scored.withColumn("type", F.coalesce(F.get(F.array(*map(F.lit, CLASSES)), F.col("class_id")), F.lit("unknown")))


def xywh_to_xyxy(boxes: DataFrame) -> DataFrame:
    """Centre and size to corners x1, y1, x2, y2."""
    return boxes.withColumns({"x1": F.col("cx") - F.col("w") / 2, "y1": F.col("cy") - F.col("h") / 2, "x2": F.col("cx") + F.col("w") / 2, "y2": F.col("cy") + F.col("h") / 2})


def bbox_trunc(boxes: DataFrame) -> DataFrame:
    """Corners as ints, truncated toward zero."""
    return boxes.withColumns({c: F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2")})


def geo_project(boxes: DataFrame, tile: int = 640) -> DataFrame:
    """boxes with footprint bounds (null: the default box) and corners get lat and lon of their centre."""
    b = default_footprint(boxes)
    lat, lon = pixel_to_latlon(*(F.col(c) for c in ("x1", "y1", "x2", "y2", "lat_min", "lat_max", "lon_min", "lon_max")), tile)
    return b.withColumns({"lat": lat, "lon": lon})


def default_footprint(df: DataFrame) -> DataFrame:
    """Missing bounds become 8-9 N, 77-78 E; a footprint is missing as a whole."""
    missing = F.col("lat_min").isNull() | F.col("lat_max").isNull() | F.col("lon_min").isNull() | F.col("lon_max").isNull()
    return df.withColumns({c: F.when(missing, v).otherwise(F.col(c)) for c, v in (("lat_min", 8.0), ("lat_max", 9.0), ("lon_min", 77.0), ("lon_max", 78.0))})


def nms(boxes: DataFrame, scene: str = "scene_id", iou_most: float = IOU_MOST) -> DataFrame:
    """Greedy suppression across classes within a scene, with built-in functions: for scenes of up to some hundred boxes."""
    one = F.struct((-F.col("conf")).alias("o"), (-F.col("det_id")).alias("p"), "det_id", "x1", "y1", "x2", "y2")
    corners = lambda b: [b["x1"], b["y1"], b["x2"], b["y2"]]
    kind = "array<struct<o:double,p:bigint,det_id:bigint,x1:int,y1:int,x2:int,y2:int>>"
    kept = F.aggregate("all", F.array().cast(kind), lambda keep, b: F.when(F.exists(keep, lambda k: iou(corners(k), corners(b)) > iou_most), keep).otherwise(F.concat(keep, F.array(b))))
    grouped = boxes.groupBy(scene).agg(F.array_sort(F.collect_list(one)).alias("all"))
    return grouped.select(scene, F.explode(F.transform(kept, lambda b: b["det_id"])).alias("det_id"))


def kept_boxes(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, iou_most: float = IOU_MOST) -> np.ndarray:
    """Places of the boxes that greedy suppression keeps; the boxes come best first."""
    area = (x2 - x1) * (y2 - y1)
    left, out = np.arange(len(x1)), []
    while len(left):
        i, rest = left[0], left[1:]
        out.append(i)
        inter = np.maximum(0, np.minimum(x2[i], x2[rest]) - np.maximum(x1[i], x1[rest])) * np.maximum(0, np.minimum(y2[i], y2[rest]) - np.maximum(y1[i], y1[rest]))
        left = rest[inter / (area[i] + area[rest] - inter + 1e-8) <= iou_most]
    return np.array(out, np.int64)


def nms_kernel(boxes: DataFrame, scene: str = "scene_id", iou_most: float = IOU_MOST, per_class: bool = False) -> DataFrame:
    """The same for scenes of thousands of boxes (a detector has at most 8,400 anchors a tile), one Arrow batch a scene."""
    keys = [scene, "type"] if per_class else [scene]

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["conf", "det_id"], ascending=False)
        return pdf.iloc[kept_boxes(*(pdf[c].to_numpy(float) for c in ("x1", "y1", "x2", "y2")), iou_most)][[scene, "det_id"]]

    columns = list(dict.fromkeys([*keys, scene, "det_id", "conf", "x1", "y1", "x2", "y2"]))
    kinds = dict(boxes.dtypes)
    return boxes.select(*columns).groupBy(*keys).applyInPandas(keep, f"{scene} {kinds[scene]}, det_id {kinds['det_id']}")


def scene_hash_id(tiles: DataFrame, body: str = "body", scene: str = "scene_id", prefix: str = "SCENE-") -> DataFrame:
    """An id from the tile's bytes where there is none."""
    made = F.concat(F.lit(prefix), F.upper(F.substring(F.md5(F.col(body).cast("binary")), 1, 8)))
    return tiles.withColumn(scene, F.coalesce(F.col(scene), made) if scene in tiles.columns else made)


def valid_bbox(df: DataFrame, bbox: str = "bbox_px") -> DataFrame:
    return df.where(F.size(bbox) == 4)


def clamp_bbox(df: DataFrame, width: int = 640, height: int = 640) -> DataFrame:
    """Corners inside the tile, at least one pixel wide and high."""
    x1, y1 = F.greatest(F.lit(0), F.least("x1", F.lit(width - 1))), F.greatest(F.lit(0), F.least("y1", F.lit(height - 1)))
    return df.withColumns({"x1": x1, "y1": y1, "x2": F.greatest(x1 + 1, F.least("x2", F.lit(width))), "y2": F.greatest(y1 + 1, F.least("y2", F.lit(height)))})


def type_to_code(kind) -> F.Column:
    return lookup(F.lower(F.trim(kind)), TYPE_CODES, 0)


def code_to_type(code) -> F.Column:
    return lookup(code, {v: k for k, v in TYPE_CODES.items()}, "unknown")


def explode_detections(briefs: DataFrame) -> DataFrame:
    """One row per anomaly of a brief with its position; a brief without any keeps one row of nulls."""
    rows = briefs.select("scene_id", "timestamp_utc", F.posexplode_outer("anomalies").alias("det_idx", "a"))
    return rows.select("scene_id", "timestamp_utc", "det_idx", F.col("a.type").alias("type"), F.col("a.lat_lon")[0].alias("lat"), F.col("a.lat_lon")[1].alias("lon"), F.col("a.conf").alias("conf"), F.col("a.bbox_px").alias("bbox_px"))


def assemble_brief(scenes: DataFrame, detections: DataFrame, footprints: DataFrame, model_version: str = "detector-1") -> DataFrame:
    """One nested brief per scene; without detections its list is empty. Detections are grouped once, by scene."""
    one = F.struct("det_idx", F.struct(F.col("type"), F.array(F.round("lat", 6), F.round("lon", 6)).alias("lat_lon"), F.round("conf", 4).alias("conf"), F.array("x1", "y1", "x2", "y2").alias("bbox_px")).alias("a"))
    grouped = detections.groupBy("scene_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["a"]).alias("found"))
    nothing = F.array().cast(grouped.schema["found"].dataType)
    full = default_footprint(scenes.join(footprints, "scene_id", "left")).join(grouped, "scene_id", "left")
    return full.select(
        "scene_id",
        "timestamp_utc",
        F.struct("lat_min", "lat_max", "lon_min", "lon_max").alias("tile_footprint"),
        F.round("cloud_cover", 3).alias("cloud_cover"),
        F.size(F.coalesce("found", nothing)).alias("anomaly_count"),
        F.coalesce("found", nothing).alias("anomalies"),
        F.struct(F.lit(model_version).alias("model_version"), F.round("inference_ms", 1).alias("inference_ms"), "compression_ratio").alias("meta"),
    )


def to_wire(detections: DataFrame) -> DataFrame:
    """Wire-typed columns: code, float confidence, exactly four box values."""
    four = F.slice(F.concat(F.coalesce("bbox_px", F.array().cast("array<int>")), F.array(*[F.lit(0)] * 4)), 1, 4)
    return detections.select("det_id", type_to_code(F.col("type")).alias("type_code"), "lat", "lon", F.col("conf").cast("float").alias("confidence"), four.alias("bbox"))


def from_wire(wire: DataFrame) -> DataFrame:
    """Back from wire columns, with the JSON view of each detection."""
    rows = wire.select("det_id", code_to_type(F.col("type_code")).alias("type"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round(F.col("confidence").cast("double"), 4).alias("conf"), F.col("bbox").alias("bbox_px"))
    return rows.withColumn("json", F.to_json(F.struct("type", F.array("lat", "lon").alias("lat_lon"), "conf", "bbox_px")))
