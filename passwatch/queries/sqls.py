"""The scalar functions as spark.sql() uses them, with the DuckDB texts of their DataFrame forms."""

from passwatch.functions.sql import register
from passwatch.operators import policy
from passwatch.queries import query
from passwatch.queries.decisions import FEATURES, ZONED, level
from passwatch.queries.history import BOX, KM


def text(m, body: str, **views):
    """A SQL text over DataFrames; the functions of the library are known in it."""
    register(m.spark)
    return m.spark.sql(body, **views)


@query(f"SELECT d.det_id, round({KM.format(a='8.41E0', o='77.82E0', b='d')}, 6) AS km FROM detections d")
def sql_haversine_km(m):
    return text(m, "SELECT det_id, round(haversine_km(8.41D, 77.82D, lat, lon), 6) AS km FROM {d}", d=m.detections)


@query(f"SELECT det_id FROM detections d WHERE {BOX.format(a='10.5E0', o='75.5E0')} AND {KM.format(a='10.5E0', o='75.5E0', b='d')} <= 50")
def sql_near_km(m):
    return text(m, "SELECT det_id FROM {d} WHERE near_km(10.5D, 75.5D, lat, lon, 50D)", d=m.detections)


@query("""SELECT a.det_id, b.det_id AS other, round(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) /
 ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) + 1e-8), 6) AS iou
 FROM detections a JOIN detections b ON a.scene_id = b.scene_id AND b.det_idx = a.det_idx + 1""")
def sql_iou(m):
    return text(m, "SELECT a.det_id, b.det_id AS other, round(box_iou(a.x1, a.y1, a.x2, a.y2, b.x1, b.y1, b.x2, b.y2), 6) AS iou FROM {d} a JOIN {d} b ON a.scene_id = b.scene_id AND b.det_idx = a.det_idx + 1", d=m.detections)


@query("SELECT a.id, round(list_dot_product(a.embedding, b.embedding) + 1e-9, 6) AS dot, round(sqrt(list_dot_product(a.embedding, a.embedding)), 6) AS norm FROM vectors a JOIN vectors b ON b.id = a.id + 1")
def sql_dot(m):
    return text(m, "SELECT a.id, round(dot(a.embedding, b.embedding) + 1e-9D, 6) AS dot, round(l2_norm(a.embedding), 6) AS norm FROM {v} a JOIN {v} b ON b.id = a.id + 1", v=m.vectors)


@query(f"WITH {ZONED}, {FEATURES}, a AS (SELECT s.scene_id, s.cloud_cover, coalesce(f.n, 0) AS n, coalesce(f.max_conf, 0) AS max_conf, coalesce(f.in_zone, false) AS in_zone, CAST(s.compression_ratio % 5 AS INT) AS h FROM scenes s LEFT JOIN features f ON f.scene_id = s.scene_id) SELECT scene_id, {level('h')} AS policy_alert FROM a")
def sql_alert_level(m):
    found = policy.alert_features(policy.zoned_detections(m.detections, m.zones))
    return text(m, "SELECT s.scene_id, alert_level(coalesce(f.n, 0), f.max_conf, f.in_zone, s.cloud_cover, cast(s.compression_ratio % 5 as int)) AS policy_alert FROM {s} s LEFT JOIN {f} f ON f.scene_id = s.scene_id", s=m.scenes, f=found)
