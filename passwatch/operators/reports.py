"""Status, size and map tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from passwatch.functions.text import CLASS_COLORS, conf_color, display_ts, fixed, lookup, percent, thousands

RAW_TILE = 640 * 640 * 6 * 4
RAW_SCENE = 100 * 1024 * 1024


def batch_summary(scenes: DataFrame) -> DataFrame:
    """Tiles, detections, mean latency and ratio of a batch; zeros for an empty one."""
    n = F.greatest(F.count("*"), F.lit(1))
    a = scenes.agg(F.count("*").alias("tiles"), F.coalesce(F.sum("anomaly_count"), F.lit(0)).alias("anomalies"), F.round(F.coalesce(F.sum("inference_ms"), F.lit(0.0)) / n, 1).alias("avg_ms"), (F.coalesce(F.sum("compression_ratio"), F.lit(0)) / n).alias("ratio"))
    return a.select("tiles", "anomalies", "avg_ms", F.concat(thousands(F.round("ratio").cast("bigint")), F.lit(":1")).alias("avg_ratio"), (F.col("avg_ms") < 800).alias("latency_ok"))


def mission_status(scenes: DataFrame) -> DataFrame:
    """The status strip: sums and means over all scenes; the ratio is the first scene's, and the mean ratio stands beside it."""
    a = scenes.agg(F.sum("anomaly_count").alias("total_anomalies"), F.round(F.avg("inference_ms"), 6).alias("avg_ms"), F.round(F.avg("cloud_cover"), 6).alias("avg_cloud"), F.min_by("compression_ratio", "scene_id").alias("first_ratio"), F.round(F.avg("compression_ratio"), 6).alias("avg_ratio"))
    return a.withColumn("state", F.when(F.col("total_anomalies") > 0, "ANOMALY DETECTED").otherwise("NOMINAL"))


def map_centre(footprints: DataFrame) -> DataFrame:
    return footprints.agg(F.round(F.coalesce(F.avg(F.col("lat_min") + F.col("lat_max")) / 2, F.lit(8.5)), 6).alias("lat"), F.round(F.coalesce(F.avg(F.col("lon_min") + F.col("lon_max")) / 2, F.lit(77.5)), 6).alias("lon"))


def has_full_footprint(df: DataFrame) -> DataFrame:
    return df.where("lat_min is not null and lat_max is not null and lon_min is not null and lon_max is not null")


def footprint_rings(scenes: DataFrame) -> DataFrame:
    """A closed ring of (lat, lon) points for each scene with a full footprint, one row a point, and its tooltip."""
    corners = [("lat_min", "lon_min"), ("lat_min", "lon_max"), ("lat_max", "lon_max"), ("lat_max", "lon_min"), ("lat_min", "lon_min")]
    ring = F.array(*[F.struct(F.col(a).alias("lat"), F.col(b).alias("lon")) for a, b in corners])
    tip = F.concat("scene_id", F.lit(" | CLOUD "), percent("cloud_cover"))
    return has_full_footprint(scenes).select("scene_id", tip.alias("tooltip"), F.posexplode(ring).alias("point", "p")).select("scene_id", "tooltip", "point", "p.lat", "p.lon")


def map_points(detections: DataFrame, scenes: DataFrame) -> DataFrame:
    """A point row for each detection: radius, size, colours, label and hover text."""
    d = detections.join(scenes.select("scene_id", "inference_ms", "compression_ratio"), "scene_id", "left")
    hover = F.concat(F.upper("type"), F.lit(" | Scene: "), "scene_id", F.lit(" | Conf: "), percent("conf"), F.lit(" | Lat: "), fixed("lat", 4), F.lit(" Lon: "), fixed("lon", 4), F.lit(" | Inference: "), fixed("inference_ms", 0), F.lit("ms | "), thousands("compression_ratio"), F.lit(":1 compression"))
    return d.select("det_id", "lat", "lon", (10 + (F.col("conf") * 8).cast("int")).alias("radius"), (12 + (F.col("conf") * 20).cast("int")).alias("size"), conf_color("conf").alias("color"), lookup("type", CLASS_COLORS, CLASS_COLORS["unknown"]).alias("class_color"), F.concat("type", F.lit(" ("), percent("conf"), F.lit(")")).alias("label"), hover.alias("hover"))


def first_per_class(detections: DataFrame) -> DataFrame:
    """The first marker of each class, which shows the legend. Minima are combined before the shuffle: a class may hold any share of the rows."""
    first = F.min(F.struct("scene_id", "det_idx", "det_id"))
    return detections.groupBy("type").agg(first.alias("f")).select("type", "f.scene_id", "f.det_idx", "f.det_id")


def intelligence_feed(scenes: DataFrame, detections: DataFrame) -> DataFrame:
    """Per scene its time and its detections, or one row that says there are none."""
    rows = scenes.select("scene_id", F.concat(F.lit("ORBITAL TIMESTAMP: "), display_ts("timestamp_utc"), F.lit(" UTC")).alias("shown")).join(detections.select("scene_id", "det_idx", "type", "conf", "lat", "lon"), "scene_id", "left")
    card = F.concat("type", F.lit(" "), percent("conf"), F.lit(" @ "), fixed("lat", 4), F.lit(", "), fixed("lon", 4))
    return rows.select("scene_id", "shown", F.coalesce("det_idx", F.lit(-1)).alias("det_idx"), F.coalesce(card, F.lit("NO ANOMALIES DETECTED IN SECTOR.")).alias("card"), conf_color("conf").alias("color"))


def varint(n: Column) -> Column:
    """Bytes of a non-negative varint."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(n)) / 7)).cast("int")


def delimited(n: Column) -> Column:
    """Bytes of a length-delimited field with a one-byte tag and n bytes of content."""
    return 1 + varint(n) + n


def wire_size(briefs: DataFrame) -> DataFrame:
    """briefs (nested) with wire_bytes: their size in the binary encoding, where default values take no room."""
    from passwatch.operators.detect import type_to_code

    number = lambda x, size: F.when(x != 0, size).otherwise(0)
    fp = F.col("tile_footprint")
    box = sum((number(fp[c], 9) for c in ("lat_min", "lat_max", "lon_min", "lon_max")), F.lit(0))

    def one(a: Column) -> Column:
        code = type_to_code(a["type"])
        pixels = F.aggregate(a["bbox_px"], F.lit(0), lambda s, v: s + F.when(v < 0, 10).otherwise(varint(v)))
        size = F.when(code != 0, 1 + varint(code)).otherwise(0) + number(a["lat_lon"][0], 9) + number(a["lat_lon"][1], 9) + number(a["conf"], 5) + F.when(F.size(a["bbox_px"]) > 0, delimited(pixels)).otherwise(0)
        return delimited(size)

    text = lambda c: F.when(F.octet_length(c) > 0, delimited(F.octet_length(c))).otherwise(0)
    total = text("scene_id") + text("timestamp_utc") + delimited(box) + number(F.col("cloud_cover"), 5) + F.aggregate("anomalies", F.lit(0), lambda s, a: s + one(a))
    total += number(F.col("meta.inference_ms"), 5) + text("meta.model_version") + F.when(F.col("meta.compression_ratio") != 0, 1 + varint(F.col("meta.compression_ratio"))).otherwise(0)
    return briefs.withColumn("wire_bytes", total.cast("int"))


def brief_json(briefs: DataFrame) -> DataFrame:
    """briefs with json: one compact document, keys in their fixed order."""
    return briefs.withColumn("json", F.to_json(F.struct("scene_id", "timestamp_utc", "tile_footprint", "cloud_cover", "anomaly_count", "anomalies", "meta")))


def compression_ratio(briefs: DataFrame, raw_bytes: int = RAW_TILE) -> DataFrame:
    """scene_id and raw bytes over JSON bytes, at least 1; the JSON is measured with its ratio field at 0."""
    zero = briefs.withColumn("meta", F.col("meta").withField("compression_ratio", F.lit(0).cast("bigint")))
    return brief_json(zero).select("scene_id", F.greatest(F.lit(1), F.floor(F.lit(raw_bytes) / F.octet_length("json"))).cast("bigint").alias("ratio"))


def compression_report(briefs: DataFrame) -> DataFrame:
    b = wire_size(brief_json(briefs)).withColumn("json_bytes", F.octet_length("json"))
    return b.select(
        "scene_id", "json_bytes", "wire_bytes",
        F.round(F.col("json_bytes") / F.greatest("wire_bytes", F.lit(1)), 6).alias("wire_vs_json"),
        F.round(F.lit(RAW_TILE) / F.greatest("json_bytes", F.lit(1)), 6).alias("json_vs_tile"),
        F.round(F.lit(RAW_TILE) / F.greatest("wire_bytes", F.lit(1)), 6).alias("wire_vs_tile"),
        F.round(F.lit(RAW_SCENE) / F.greatest("wire_bytes", F.lit(1)), 6).alias("wire_vs_scene"),
        (F.col("meta.inference_ms") < 800).alias("latency_ok"), (F.col("wire_bytes") < 2048).alias("size_ok"),
    )


def compression_text(report: DataFrame) -> DataFrame:
    """scene_id and the fixed-width text of its report."""
    bar, met = "─" * 52, lambda c: F.when(F.col(c), "✓ MET").otherwise("✗ MISSED")
    wide = lambda c, n: F.lpad(thousands(c), F.greatest(F.lit(n), F.length(thousands(c))), F.lit(" "))
    lines = [
        F.lit(""), F.lit(bar), F.concat(F.lit("  Compression Report — "), "scene_id"), F.lit(bar),
        F.concat(F.lit("  Raw tile  (640×640×6 float32): "), wide(F.lit(RAW_TILE), 10), F.lit(f" B  ({RAW_TILE / 1e6:.2f} MB)")),
        F.concat(F.lit("  Raw scene (100 MB Sentinel-2): "), wide(F.lit(RAW_SCENE), 10), F.lit(" B  (100.00 MB)")),
        F.concat(F.lit("  JSON payload               :   "), wide("json_bytes", 10), F.lit(" B")),
        F.concat(F.lit("  Proto binary               :   "), wide("wire_bytes", 10), F.lit(" B")), F.lit(bar),
        F.concat(F.lit("  Proto vs JSON              :   "), F.format_string("%8.1f", "wire_vs_json"), F.lit("× smaller")),
        F.concat(F.lit("  JSON  vs raw tile          :   "), wide("json_vs_tile", 8), F.lit(":1")),
        F.concat(F.lit("  Proto vs raw tile          :   "), wide("wire_vs_tile", 8), F.lit(":1")),
        F.concat(F.lit("  Proto vs raw scene (100MB) :   "), wide("wire_vs_scene", 8), F.lit(":1")), F.lit(bar),
        F.concat(F.lit("  <800ms latency target      :   "), met("latency_ok")), F.concat(F.lit("  <2KB proto size target     :   "), met("size_ok")), F.lit(bar), F.lit(""),
    ]
    return report.select("scene_id", F.concat_ws("\n", *lines).alias("text"))
