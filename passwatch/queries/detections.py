"""Queries of the detector's boxes and of briefs."""

from pyspark.sql import functions as F

from passwatch.adapters import rounded
from passwatch.functions import geo, rules, text
from passwatch.operators import detect, reports
from passwatch.queries import query
from passwatch.sources import briefs as brief_files

#: Raw predictions derived from detections: four scores that depend on the confidence.
PREDICTIONS = "SELECT scene_id, det_id AS anchor, x1, y1, x2, y2, [conf, ((det_id * 17) % 1000) / 1000.0E0, ((det_id * 43) % 1000) / 1000.0E0, conf / 2] AS scores FROM detections"


def predictions(m):
    return m.detections.select("scene_id", F.col("det_id").alias("anchor"), "x1", "y1", "x2", "y2", F.array(F.col("conf"), F.col("det_id") * 17 % 1000 / 1000.0, F.col("det_id") * 43 % 1000 / 1000.0, F.col("conf") / 2).alias("scores"))


@query(f"""WITH p AS ({PREDICTIONS}), s AS (SELECT *, list_max(scores) AS conf FROM p)
SELECT anchor, conf, CAST(list_position(scores, conf) - 1 AS INT) AS class_id, ['ship', 'airplane', 'storage-tank', 'harbor'][list_position(scores, conf)] AS type FROM s WHERE conf >= 0.35""")
def best_class(m):
    return detect.best_class(predictions(m)).select("anchor", "conf", "class_id", "type")


CENTRED = "SELECT det_id, (x1 + x2) / 2.0E0 AS cx, (y1 + y2) / 2.0E0 AS cy, (x2 - x1) * 1.0E0 AS w, (y2 - y1) * 1.0E0 AS h FROM detections"


def centred(m):
    return m.detections.select("det_id", ((F.col("x1") + F.col("x2")) / 2.0).alias("cx"), ((F.col("y1") + F.col("y2")) / 2.0).alias("cy"), (F.col("x2") - F.col("x1")).cast("double").alias("w"), (F.col("y2") - F.col("y1")).cast("double").alias("h"))


@query(f"WITH c AS ({CENTRED}) SELECT det_id, cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2 FROM c")
def xywh_to_xyxy(m):
    return detect.xywh_to_xyxy(centred(m)).select("det_id", "x1", "y1", "x2", "y2")


@query("SELECT det_id, CAST(trunc(x1 - 0.75E0) AS INT) AS x1, CAST(trunc(y1 + 0.25E0) AS INT) AS y1, CAST(trunc(x2 + 0.5E0) AS INT) AS x2, CAST(trunc(y2 - 0.5E0) AS INT) AS y2 FROM detections")
def bbox_trunc(m):
    moved = m.detections.select("det_id", (F.col("x1") - 0.75).alias("x1"), (F.col("y1") + 0.25).alias("y1"), (F.col("x2") + 0.5).alias("x2"), (F.col("y2") - 0.5).alias("y2"))
    return detect.bbox_trunc(moved)


BOUNDS = "coalesce(f.lat_min, 8.0E0) AS lat_min, coalesce(f.lat_max, 9.0E0) AS lat_max, coalesce(f.lon_min, 77.0E0) AS lon_min, coalesce(f.lon_max, 78.0E0) AS lon_max"


@query(f"""WITH b AS (SELECT d.det_id, d.x1, d.y1, d.x2, d.y2, {BOUNDS} FROM detections d LEFT JOIN footprints f ON f.scene_id = d.scene_id)
SELECT det_id, CAST(round(CAST(lat_max - (y1 + y2) / 2.0E0 / 640 * (lat_max - lat_min) AS DECIMAL(18, 10)), 6) AS DOUBLE) AS lat, CAST(round(CAST(lon_min + (x1 + x2) / 2.0E0 / 640 * (lon_max - lon_min) AS DECIMAL(18, 10)), 6) AS DOUBLE) AS lon FROM b""")
def pixel_to_latlon(m):
    return detect.geo_project(m.detections.drop("lat", "lon").join(m.footprints, "scene_id", "left")).select("det_id", "lat", "lon")


@query(f"SELECT s.scene_id, {BOUNDS} FROM scenes s LEFT JOIN footprints f ON f.scene_id = s.scene_id")
def default_footprint(m):
    return detect.default_footprint(m.scenes.select("scene_id").join(m.footprints, "scene_id", "left"))


@query("SELECT doc_id, 'SCENE-' || upper(substr(md5(text), 1, 8)) AS scene_id FROM documents")
def scene_hash_id(m):
    return detect.scene_hash_id(m.table("documents").select("doc_id", "text"), "text").select("doc_id", "scene_id")


@query("SELECT det_id, CASE lower(trim(type)) WHEN 'ship' THEN 1 WHEN 'airplane' THEN 2 WHEN 'storage-tank' THEN 3 WHEN 'harbor' THEN 4 ELSE 0 END AS code FROM (SELECT det_id, ' ' || upper(type) || ' ' AS type FROM detections)")
def type_to_code(m):
    return m.detections.select("det_id", detect.type_to_code(F.concat(F.lit(" "), F.upper("type"), F.lit(" "))).alias("code"))


@query("SELECT det_id, CASE det_id % 7 WHEN 1 THEN 'ship' WHEN 2 THEN 'airplane' WHEN 3 THEN 'storage-tank' WHEN 4 THEN 'harbor' ELSE 'unknown' END AS type FROM detections")
def code_to_type(m):
    return m.detections.select("det_id", detect.code_to_type((F.col("det_id") % 7).cast("int")).alias("type"))


WIRE = """SELECT det_id, CASE type WHEN 'ship' THEN 1 WHEN 'airplane' THEN 2 WHEN 'storage-tank' THEN 3 WHEN 'harbor' THEN 4 ELSE 0 END AS type_code, lat, lon, CAST(conf AS FLOAT) AS confidence,
 x1 AS b0, y1 AS b1, CASE WHEN det_id % 3 = 0 THEN 0 ELSE x2 END AS b2, CASE WHEN det_id % 3 = 0 THEN 0 ELSE y2 END AS b3 FROM detections"""


def wire(m):
    """Every third box lacks its last two values."""
    return detect.to_wire(m.detections.withColumn("bbox_px", F.when(F.col("det_id") % 3 == 0, F.array("x1", "y1")).otherwise(F.array("x1", "y1", "x2", "y2"))))


@query(WIRE)
def to_wire_columns(m):
    return wire(m).select("det_id", "type_code", "lat", "lon", "confidence", *[F.col("bbox")[i].alias(f"b{i}") for i in range(4)])


@query(f"""WITH w AS ({WIRE}) SELECT det_id, CASE type_code WHEN 1 THEN 'ship' WHEN 2 THEN 'airplane' WHEN 3 THEN 'storage-tank' WHEN 4 THEN 'harbor' ELSE 'unknown' END AS type,
 round(lat, 6) AS lat, round(lon, 6) AS lon, round(CAST(confidence AS DOUBLE), 4) AS conf, b0 || ',' || b1 || ',' || b2 || ',' || b3 AS bbox FROM w""")
def from_wire_columns(m):
    return detect.from_wire(wire(m)).select("det_id", "type", "lat", "lon", "conf", F.concat_ws(",", F.col("bbox_px").cast("array<string>")).alias("bbox"))


@query("""SELECT det_id, upper('REQ-' || substr(md5(lat_text || lon_text), 1, 6)) AS request_id, 1 AS priority FROM (SELECT det_id, CAST(CAST(lat * 1000 AS BIGINT) AS VARCHAR) AS lat_text, CAST(CAST(lon * 1000 AS BIGINT) AS VARCHAR) AS lon_text FROM detections)""")
def ovv_manual_request(m):
    from passwatch.operators.policy import ovv_manual_request as made

    points = m.detections.select("det_id", F.round(F.col("lat") * 1000).cast("bigint").alias("lat"), F.round(F.col("lon") * 1000).cast("bigint").alias("lon"))
    return made(points).select("det_id", "request_id", "priority")


@query("SELECT det_id, CASE WHEN conf > 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier FROM detections")
def risk_tier(m):
    return m.detections.select("det_id", rules.risk_tier(F.col("conf")).alias("risk_tier"))


@query("SELECT det_id, CASE WHEN conf >= 0.8 AND conf <= 1 THEN '#d4d4d4' WHEN conf >= 0.6 AND conf <= 0.8 THEN '#8b8b8b' ELSE '#f5f5f5' END AS color FROM detections")
def conf_bucket(m):
    return m.detections.select("det_id", text.conf_color("conf").alias("color"))


@query("SELECT scene_id, CASE alert_level WHEN 'GREEN' THEN '#22c55e' WHEN 'YELLOW' THEN '#eab308' WHEN 'ORANGE' THEN '#f97316' WHEN 'RED' THEN '#ef4444' ELSE '#6b7280' END AS color FROM advisories")
def alert_color(m):
    return m.advisories.select("scene_id", text.lookup("alert_level", text.ALERT_COLORS, "#6b7280").alias("color"))


@query("SELECT det_id, CASE type WHEN 'ship' THEN '#3b82f6' WHEN 'airplane' THEN '#f59e0b' WHEN 'storage-tank' THEN '#8b5cf6' WHEN 'harbor' THEN '#10b981' ELSE '#6b7280' END AS color FROM detections")
def class_color(m):
    return m.detections.select("det_id", text.lookup("type", text.CLASS_COLORS, "#6b7280").alias("color"))


@query("SELECT det_id FROM detections WHERE conf < 0.55")
def low_conf_filter(m):
    return m.detections.where("conf < 0.55").select("det_id")


@query("SELECT s.scene_id FROM scenes s JOIN footprints f ON f.scene_id = s.scene_id WHERE lat_min IS NOT NULL AND lat_max IS NOT NULL AND lon_min IS NOT NULL AND lon_max IS NOT NULL")
def has_full_footprint(m):
    return reports.has_full_footprint(m.scenes.select("scene_id").join(m.footprints, "scene_id", "left")).select("scene_id")


@query("SELECT det_id, x1, y1, x2, y2 FROM detections WHERE det_id % 5 <> 0")
def valid_bbox(m):
    """Every fifth box is cut to two values, and so invalid."""
    some = m.detections.withColumn("bbox_px", F.when(F.col("det_id") % 5 == 0, F.array("x1", "y1")).otherwise(F.array("x1", "y1", "x2", "y2")))
    return detect.valid_bbox(some).select("det_id", *[F.col("bbox_px")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])


@query("""WITH c AS (SELECT det_id, greatest(0, least(x1, 319)) AS a, greatest(0, least(y1, 319)) AS b, x2, y2 FROM detections)
SELECT det_id, a AS x1, b AS y1, greatest(a + 1, least(x2, 320)) AS x2, greatest(b + 1, least(y2, 320)) AS y2 FROM c""")
def clamp_bbox(m):
    return detect.clamp_bbox(m.detections.select("det_id", "x1", "y1", "x2", "y2"), 320, 320)


@query("""SELECT a.det_id, b.det_id AS other, round(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) /
 ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) + 1e-8), 6) AS iou
 FROM detections a JOIN detections b ON a.scene_id = b.scene_id AND b.det_idx = a.det_idx + 1""")
def iou(m):
    d = m.detections.select("scene_id", "det_id", "det_idx", "x1", "y1", "x2", "y2")
    b = d.select("scene_id", (F.col("det_idx") - 1).alias("det_idx"), *[F.col(c).alias("o_" + c) for c in ("det_id", "x1", "y1", "x2", "y2")])
    at = lambda p: [F.col(p + c).cast("double") for c in ("x1", "y1", "x2", "y2")]
    return d.join(b, ["scene_id", "det_idx"]).select("det_id", F.col("o_det_id").alias("other"), F.round(geo.iou(at(""), at("o_")), 6).alias("iou"))


NMS = """WITH RECURSIVE b AS (SELECT scene_id, det_id, x1, y1, x2, y2, row_number() OVER (PARTITION BY scene_id ORDER BY conf DESC, det_id DESC) AS rn FROM detections WHERE conf >= 0.35),
r(scene_id, rn, kept) AS (SELECT DISTINCT scene_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(i BIGINT, x1 INT, y1 INT, x2 INT, y2 INT)[]) FROM b
 UNION ALL SELECT b.scene_id, b.rn, CASE WHEN len(list_filter(r.kept, lambda k: greatest(0, least(k.x2, b.x2) - greatest(k.x1, b.x1)) * greatest(0, least(k.y2, b.y2) - greatest(k.y1, b.y1)) /
   ((k.x2 - k.x1) * (k.y2 - k.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(0, least(k.x2, b.x2) - greatest(k.x1, b.x1)) * greatest(0, least(k.y2, b.y2) - greatest(k.y1, b.y1)) + 1e-8) > 0.45)) > 0
   THEN r.kept ELSE list_append(r.kept, {'i': b.det_id, 'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2}) END FROM r JOIN b ON b.scene_id = r.scene_id AND b.rn = r.rn + 1),
l AS (SELECT scene_id, max_by(kept, rn) AS kept FROM r GROUP BY scene_id)
SELECT scene_id, u.i AS det_id FROM (SELECT scene_id, unnest(kept) AS u FROM l)"""


@query(NMS)
def nms(m):
    """Within a scene, so that a task holds one scene's boxes and not a day's."""
    return detect.nms(m.detections.where("conf >= 0.35"))


def briefs(m):
    return detect.assemble_brief(m.scenes, m.detections, m.footprints)


@query(f"""WITH d AS (SELECT scene_id, count(*) AS n, string_agg(type || ':' || CAST(x1 AS VARCHAR), ',' ORDER BY det_idx) AS found FROM detections GROUP BY scene_id)
SELECT s.scene_id, s.timestamp_utc, s.cloud_cover, CAST(coalesce(d.n, 0) AS INT) AS anomaly_count, coalesce(d.found, '') AS found, {BOUNDS} FROM scenes s LEFT JOIN d ON d.scene_id = s.scene_id LEFT JOIN footprints f ON f.scene_id = s.scene_id""")
def assemble_brief(m):
    found = F.array_join(F.transform("anomalies", lambda a: F.concat(a["type"], F.lit(":"), a["bbox_px"][0].cast("string"))), ",")
    return briefs(m).select("scene_id", "timestamp_utc", "cloud_cover", "anomaly_count", found.alias("found"), "tile_footprint.*")


@query("SELECT s.scene_id, d.det_idx, d.type, d.lat, d.lon, d.conf, d.x1, d.y2 FROM scenes s LEFT JOIN detections d ON d.scene_id = s.scene_id")
def explode_detections(m):
    return detect.explode_detections(briefs(m)).select("scene_id", "det_idx", "type", "lat", "lon", "conf", F.col("bbox_px")[0].alias("x1"), F.col("bbox_px")[3].alias("y2"))


#: A brief's JSON by concatenation.
JSON_SQL = f"""
j AS (SELECT scene_id, string_agg('{{"type":"' || type || '","lat_lon":[' || round(lat, 6) || ',' || round(lon, 6) || '],"conf":' || conf || ',"bbox_px":[' || x1 || ',' || y1 || ',' || x2 || ',' || y2 || ']}}', ',' ORDER BY det_idx) AS found, count(*) AS n FROM detections GROUP BY scene_id),
b AS (SELECT s.scene_id, s.timestamp_utc, s.cloud_cover, s.inference_ms, s.compression_ratio, coalesce(j.found, '') AS found, coalesce(j.n, 0) AS n, {BOUNDS} FROM scenes s LEFT JOIN j ON j.scene_id = s.scene_id LEFT JOIN footprints f ON f.scene_id = s.scene_id),
t AS (SELECT *, '{{"scene_id":"' || scene_id || '","timestamp_utc":"' || timestamp_utc || '","tile_footprint":{{"lat_min":' || lat_min || ',"lat_max":' || lat_max || ',"lon_min":' || lon_min || ',"lon_max":' || lon_max || '}},"cloud_cover":' || cloud_cover || ',"anomaly_count":' || n ||
 ',"anomalies":[' || found || '],"meta":{{"model_version":"detector-1","inference_ms":' || inference_ms || ',"compression_ratio":' AS head FROM b)"""


@query(f"WITH {JSON_SQL} SELECT scene_id, head || compression_ratio || '}}}}' AS json FROM t".replace("}}}}", "}}"))
def write_briefs(m):
    """The documents as they stand in the files."""
    from passwatch.queries.sources import place

    folder = place(m.spark)
    brief_files.write_briefs(briefs(m), folder, digits=4)
    return m.spark.read.text(folder).select(F.get_json_object("value", "$.scene_id").alias("scene_id"), F.col("value").alias("json"))


@query(f"WITH {JSON_SQL} SELECT scene_id, CAST(greatest(1, 9830400 // octet_length(encode(head || '0}}}}'))) AS BIGINT) AS ratio FROM t".replace("}}}}", "}}"))
def compression_ratio(m):
    return reports.compression_ratio(briefs(m))


#: Bytes of a varint, by the number's size.
def _v(x: str) -> str:
    return f"(CASE WHEN {x} < 128 THEN 1 WHEN {x} < 16384 THEN 2 WHEN {x} < 2097152 THEN 3 ELSE 4 END)"


def _ld(x: str) -> str:
    return f"(1 + {_v(x)} + ({x}))"


_PX = " + ".join(_v(c) for c in ("x1", "y1", "x2", "y2"))
_ONE = f"(CASE WHEN type = 'unknown' THEN 0 ELSE 2 END + CASE WHEN lat <> 0 THEN 9 ELSE 0 END + CASE WHEN lon <> 0 THEN 9 ELSE 0 END + CASE WHEN conf <> 0 THEN 5 ELSE 0 END + {_ld('px')})"
_FOOT = " + ".join(f"CASE WHEN {c} <> 0 THEN 9 ELSE 0 END" for c in ("lat_min", "lat_max", "lon_min", "lon_max"))
SIZES_SQL = f"""
x AS (SELECT scene_id, type, lat, lon, conf, {_PX} AS px FROM detections), y AS (SELECT scene_id, {_ONE} AS one FROM x), z AS (SELECT scene_id, sum({_ld('one')}) AS found_bytes FROM y GROUP BY scene_id),
w AS (SELECT t.scene_id, t.inference_ms, octet_length(encode(t.head || t.compression_ratio || '}}}}')) AS json_bytes, t.compression_ratio,
 {_ld('strlen(t.scene_id)')} + {_ld('strlen(t.timestamp_utc)')} + {_ld(_FOOT)} + CASE WHEN t.cloud_cover <> 0 THEN 5 ELSE 0 END + coalesce(z.found_bytes, 0) + CASE WHEN t.inference_ms <> 0 THEN 5 ELSE 0 END + {_ld('10')} + 1 + {_v('t.compression_ratio')} AS wire_bytes
 FROM t LEFT JOIN z ON z.scene_id = t.scene_id)""".replace("}}}}", "}}")


@query(f"""WITH {JSON_SQL}, {SIZES_SQL} SELECT scene_id, CAST(json_bytes AS INT) AS json_bytes, CAST(wire_bytes AS INT) AS wire_bytes, round(json_bytes / wire_bytes, 6) AS wire_vs_json, round(9830400 / json_bytes, 6) AS json_vs_tile,
 round(9830400 / wire_bytes, 6) AS wire_vs_tile, round(104857600 / wire_bytes, 6) AS wire_vs_scene, inference_ms < 800 AS latency_ok, wire_bytes < 2048 AS size_ok FROM w""")
def compression_report(m):
    return reports.compression_report(briefs(m))


_BAR = "'" + "─" * 52 + "'"
_WIDE = "lpad(format('{{:,}}', {0}), CAST(greatest({1}, length(format('{{:,}}', {0}))) AS INT), ' ')"
_RATIO = "CAST(round_even({}, 0) AS BIGINT)"
_MET = "CASE WHEN {} THEN '✓ MET' ELSE '✗ MISSED' END"


@query(f"""WITH {JSON_SQL}, {SIZES_SQL}, r AS (SELECT scene_id, CAST(json_bytes AS BIGINT) AS jb, CAST(wire_bytes AS BIGINT) AS wb, round(json_bytes / wire_bytes, 6) AS wj, {_RATIO.format('round(9830400 / json_bytes, 6)')} AS jt,
 {_RATIO.format('round(9830400 / wire_bytes, 6)')} AS wt, {_RATIO.format('round(104857600 / wire_bytes, 6)')} AS ws, inference_ms < 800 AS lat, wire_bytes < 2048 AS small FROM w)
SELECT scene_id, concat_ws(chr(10), '', {_BAR}, '  Compression Report — ' || scene_id, {_BAR}, '  Raw tile  (640×640×6 float32):  9,830,400 B  (9.83 MB)', '  Raw scene (100 MB Sentinel-2): 104,857,600 B  (100.00 MB)',
 '  JSON payload               :   ' || {_WIDE.format('jb', 10)} || ' B', '  Proto binary               :   ' || {_WIDE.format('wb', 10)} || ' B', {_BAR}, '  Proto vs JSON              :   ' || printf('%8.1f', {rounded('wj', 1)}) || '× smaller',
 '  JSON  vs raw tile          :   ' || {_WIDE.format('jt', 8)} || ':1', '  Proto vs raw tile          :   ' || {_WIDE.format('wt', 8)} || ':1', '  Proto vs raw scene (100MB) :   ' || {_WIDE.format('ws', 8)} || ':1', {_BAR},
 '  <800ms latency target      :   ' || {_MET.format('lat')}, '  <2KB proto size target     :   ' || {_MET.format('small')}, {_BAR}, '') AS text FROM r""")
def compression_text(m):
    return reports.compression_text(reports.compression_report(briefs(m)))


@query("""SELECT count(*) AS tiles, CAST(sum(anomaly_count) AS BIGINT) AS anomalies, round(avg(inference_ms), 1) AS avg_ms, format('{:,}', CAST(round(avg(compression_ratio)) AS BIGINT)) || ':1' AS avg_ratio, round(avg(inference_ms), 1) < 800 AS latency_ok FROM scenes""")
def batch_summary(m):
    return reports.batch_summary(m.scenes)


@query("""SELECT CAST(sum(anomaly_count) AS BIGINT) AS total_anomalies, round(avg(inference_ms), 6) AS avg_ms, round(avg(cloud_cover), 6) AS avg_cloud, min_by(compression_ratio, scene_id) AS first_ratio, round(avg(compression_ratio), 6) AS avg_ratio,
 CASE WHEN sum(anomaly_count) > 0 THEN 'ANOMALY DETECTED' ELSE 'NOMINAL' END AS state FROM scenes""")
def mission_status(m):
    return reports.mission_status(m.scenes)


@query("SELECT round(avg(lat_min + lat_max) / 2, 6) AS lat, round(avg(lon_min + lon_max) / 2, 6) AS lon FROM footprints")
def map_centre(m):
    return reports.map_centre(m.footprints)


PCT = "CAST(CAST(round({} * 100) AS INT) AS VARCHAR) || '%'"


@query(f"""SELECT d.det_id, d.lat, d.lon, 10 + CAST(trunc(conf * 8) AS INT) AS radius, 12 + CAST(trunc(conf * 20) AS INT) AS size, CASE WHEN conf >= 0.8 THEN '#d4d4d4' WHEN conf >= 0.6 THEN '#8b8b8b' ELSE '#f5f5f5' END AS color,
 CASE type WHEN 'ship' THEN '#3b82f6' WHEN 'airplane' THEN '#f59e0b' WHEN 'storage-tank' THEN '#8b5cf6' WHEN 'harbor' THEN '#10b981' ELSE '#6b7280' END AS class_color, type || ' (' || {PCT.format('conf')} || ')' AS label,
 upper(type) || ' | Scene: ' || d.scene_id || ' | Conf: ' || {PCT.format('conf')} || ' | Lat: ' || printf('%.4f', d.lat) || ' Lon: ' || printf('%.4f', d.lon) || ' | Inference: ' || printf('%.0f', s.inference_ms) || 'ms | ' || format('{{:,}}', s.compression_ratio) || ':1 compression' AS hover
 FROM detections d LEFT JOIN scenes s ON s.scene_id = d.scene_id""")
def map_layers(m):
    return reports.map_points(m.detections, m.scenes)


@query(f"""WITH r AS (SELECT s.scene_id, s.scene_id || ' | CLOUD ' || {PCT.format('s.cloud_cover')} AS tooltip, f.* EXCLUDE (scene_id) FROM scenes s JOIN footprints f ON f.scene_id = s.scene_id)
SELECT scene_id, tooltip, p AS point, CASE WHEN p IN (0, 1, 4) THEN lat_min ELSE lat_max END AS lat, CASE WHEN p IN (0, 3, 4) THEN lon_min ELSE lon_max END AS lon FROM r, (SELECT CAST(unnest(range(0, 5)) AS INT) AS p)""")
def map_rings(m):
    return reports.footprint_rings(m.scenes.join(m.footprints, "scene_id", "left"))


@query("SELECT type, scene_id, det_idx, det_id FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY scene_id, det_idx, det_id) AS r FROM detections) WHERE r = 1")
def first_per_class(m):
    return reports.first_per_class(m.detections)


@query(f"""SELECT s.scene_id, 'ORBITAL TIMESTAMP: ' || replace(substr(s.timestamp_utc, 1, 19), 'T', ' ') || ' UTC' AS shown, coalesce(d.det_idx, -1) AS det_idx,
 coalesce(d.type || ' ' || {PCT.format('d.conf')} || ' @ ' || printf('%.4f', d.lat) || ', ' || printf('%.4f', d.lon), 'NO ANOMALIES DETECTED IN SECTOR.') AS card,
 CASE WHEN d.conf >= 0.8 THEN '#d4d4d4' WHEN d.conf >= 0.6 THEN '#8b8b8b' WHEN d.conf >= 0 THEN '#f5f5f5' ELSE '#8b8b8b' END AS color FROM scenes s LEFT JOIN detections d ON d.scene_id = s.scene_id""")
def intelligence_feed(m):
    return reports.intelligence_feed(m.scenes, m.detections)


@query("SELECT scene_id, replace(substr(timestamp_utc, 1, 19), 'T', ' ') AS a, substr(timestamp_utc, 1, 16) AS b, substr(timestamp_utc, 1, 10) AS c FROM scenes")
def display_ts(m):
    return m.scenes.select("scene_id", text.display_ts("timestamp_utc").alias("a"), F.substring("timestamp_utc", 1, 16).alias("b"), text.display_ts("timestamp_utc", 10).alias("c"))


@query("SELECT scene_id, (f.lat_min + f.lat_max) / 2 AS lat, (f.lon_min + f.lon_max) / 2 AS lon FROM footprints f")
def footprint_centre(m):
    return m.footprints.select("scene_id", ((F.col("lat_min") + F.col("lat_max")) / 2).alias("lat"), ((F.col("lon_min") + F.col("lon_max")) / 2).alias("lon"))


@query(f"SELECT s.scene_id, s.cloud_cover, {BOUNDS} FROM scenes s LEFT JOIN footprints f ON f.scene_id = s.scene_id")
def tile_footprint_join(m):
    from passwatch.operators.raster import tile_footprint_join as join

    return join(m.scenes.select("scene_id", "cloud_cover"), m.footprints)
