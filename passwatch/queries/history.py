"""Queries of the detection history."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from passwatch.adapters import rounded
from passwatch.functions import geo
from passwatch.operators import memory, spatial
from passwatch.queries import query
from passwatch.queries.sources import place
from passwatch.sources import versioned
from passwatch.sources.versioned import Change

KM = "6371.0E0 * 2 * asin(sqrt(pow(sin(radians({b}.lat - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {o}) / 2), 2)))"
BOX = "d.lat BETWEEN {a} - 50.0E0 / 111.0E0 AND {a} + 50.0E0 / 111.0E0 AND d.lon BETWEEN {o} - 50.0E0 / (111.0E0 * cos(radians({a})) + 1e-9) AND {o} + 50.0E0 / (111.0E0 * cos(radians({a})) + 1e-9)"
NEAR = f"{BOX.format(a='q.lat', o='q.lon')} AND {KM.format(a='q.lat', o='q.lon', b='d')} <= 50.0E0"
#: Hits of every scene's first detection, newest first.
HITS = f"""h AS (SELECT q.scene_id AS q_id, q.lat AS q_lat, q.lon AS q_lon, d.*, row_number() OVER (PARTITION BY q.scene_id ORDER BY d.timestamp_utc DESC, d.det_id DESC) - 1 AS pass_number
 FROM (SELECT * FROM detections WHERE det_idx = 0) q JOIN detections d ON d.scene_id <> q.scene_id AND {NEAR}), n AS (SELECT * FROM h WHERE pass_number < 20)"""


def columns(m):
    return m.detections.select("scene_id", "det_id", "type", "lat", "lon", "conf", "ts", "timestamp_utc")


def hits(m, detections=None):
    return spatial.newest_near(spatial.first_points(m.detections).drop("q_ts"), columns(m) if detections is None else detections)


def alerted(m):
    """hits() with the alert of the detection's scene: each detection gets it once, before the queries share it."""
    return hits(m, memory.history_with_scene(columns(m), m.advisories))


@query(f"SELECT d.det_id, round({KM.format(a='8.41E0', o='77.82E0', b='d')}, 6) AS km FROM detections d")
def haversine_km(m):
    return m.detections.select("det_id", F.round(geo.haversine_km(F.lit(8.41), F.lit(77.82), F.col("lat"), F.col("lon")), 6).alias("km"))


@query(f"SELECT det_id, round({KM.format(a='10.5E0', o='75.5E0', b='d')}, 6) AS distance_km FROM detections d WHERE {BOX.format(a='10.5E0', o='75.5E0')} AND {KM.format(a='10.5E0', o='75.5E0', b='d')} <= 50 ORDER BY timestamp_utc DESC, det_id DESC LIMIT 20")
def query_region(m):
    return spatial.query_region(m.detections, 10.5, 75.5).select("det_id", F.round("distance_km", 6).alias("distance_km"))


@query(f"SELECT q.scene_id AS q_id, count(*) AS n, round(sum({KM.format(a='q.lat', o='q.lon', b='d')}), 3) AS km FROM (SELECT * FROM detections WHERE det_idx = 0) q JOIN detections d ON {NEAR} GROUP BY q.scene_id")
def region_join(m):
    return spatial.near_totals(spatial.first_points(m.detections), m.detections, exclude_self=False).select("q_id", "n", F.round("km", 3).alias("km"))


@query(f"SELECT q.scene_id AS q_id, count(*) AS n FROM (SELECT * FROM detections WHERE det_idx = 0) q JOIN detections d ON d.scene_id <> q.scene_id AND {NEAR} GROUP BY q.scene_id")
def exclude_self(m):
    return spatial.near_totals(spatial.first_points(m.detections), m.detections).select("q_id", "n")


@query(f"SELECT q.scene_id, CAST(least(count(*), 20) AS INT) AS history_count FROM (SELECT * FROM detections WHERE det_idx = 0) q JOIN detections d ON d.scene_id <> q.scene_id AND d.ts < q.ts AND {NEAR} GROUP BY q.scene_id")
def history_asof(m):
    return spatial.history_count(m.detections, as_of=True)


@query(f"SELECT q.scene_id, CAST(least(count(*), 20) AS INT) AS history_count FROM (SELECT * FROM detections WHERE det_idx = 0) q JOIN detections d ON d.scene_id <> q.scene_id AND {NEAR} GROUP BY q.scene_id")
def history_count(m):
    return spatial.history_count(m.detections)


@query("SELECT d.det_id, d.type, a.alert_level FROM detections d LEFT JOIN advisories a ON a.scene_id = d.scene_id")
def history_with_scene(m):
    return memory.history_with_scene(m.detections, m.advisories).select("det_id", "type", "alert_level")


@query(f"WITH {HITS} SELECT q_id, det_id, pass_number FROM n")
def pass_number(m):
    return hits(m).select("q_id", "det_id", F.col("pass_number").cast("bigint").alias("pass_number"))


@query(f"WITH {HITS} SELECT q_id, type, count(*) AS n FROM n GROUP BY q_id, type")
def type_counts(m):
    return spatial.type_counts(hits(m)).select("q_id", "type", "n")


@query(f"WITH {HITS}, c AS (SELECT q_id, type, min(pass_number) AS f FROM n GROUP BY q_id, type HAVING count(*) >= 2) SELECT q_id, string_agg(type, ', ' ORDER BY f) AS recurring_types FROM c GROUP BY q_id")
def recurring_types(m):
    return spatial.recurring_types(hits(m))


@query(f"WITH {HITS} SELECT q_id, count(DISTINCT scene_id) AS total_passes, count(*) AS anomaly_count, min(timestamp_utc) AS first_seen, max(timestamp_utc) AS last_seen, count(*) >= 2 AS is_recurring FROM n GROUP BY q_id")
def region_summary(m):
    return spatial.region_summary(hits(m))


@query(f"""WITH b AS (SELECT q.scene_id AS q_id, q.lat AS q_lat, q.lon AS q_lon, d.*, row_number() OVER (PARTITION BY q.scene_id ORDER BY d.timestamp_utc DESC, d.det_id DESC) AS r
 FROM (SELECT * FROM detections WHERE det_idx = 0) q JOIN detections d ON d.scene_id <> q.scene_id AND {BOX.format(a='q.lat', o='q.lon')}),
n AS (SELECT q_id, det_id, row_number() OVER (PARTITION BY q_id ORDER BY timestamp_utc DESC, det_id DESC) - 1 AS pass_number FROM b AS d WHERE r <= 60 AND {KM.format(a='d.q_lat', o='d.q_lon', b='d')} <= 50)
SELECT * FROM n WHERE pass_number < 20""")
def overfetch_limit(m):
    found = spatial.overfetched_near(spatial.first_points(m.detections).drop("q_ts"), columns(m))
    return found.select("q_id", "det_id", F.col("pass_number").cast("bigint").alias("pass_number"))


LINE = "'  • ' || upper(type) || ' at (' || printf('%.4f', lat) || '°, ' || printf('%.4f', lon) || '°), conf=' || CAST(round(conf * 100) AS INT) || '%, observed ' || CASE WHEN pass_number > 0 THEN pass_number || ' pass(es) ago' ELSE 'current pass' END || coalesce(' [ADVISORY: ' || alert_level || ']', '') || ' [' || substr(timestamp_utc, 1, 10) || ']'"


@query(f"WITH {HITS} SELECT n.q_id, n.pass_number, {LINE} AS line FROM n LEFT JOIN advisories a ON a.scene_id = n.scene_id")
def history_line(m):
    return memory.history_line(alerted(m)).select("q_id", F.col("pass_number").cast("bigint").alias("pass_number"), "line")


@query(f"""WITH {HITS}, l AS (SELECT n.*, {LINE} AS line FROM n LEFT JOIN advisories a ON a.scene_id = n.scene_id),
c AS (SELECT q_id, string_agg(type, ', ' ORDER BY f) AS again FROM (SELECT q_id, type, min(pass_number) AS f FROM n GROUP BY q_id, type HAVING count(*) >= 2) GROUP BY q_id),
s AS (SELECT q_id, any_value(q_lat) AS a, any_value(q_lon) AS o, count(*) AS k, count(DISTINCT scene_id) AS p, min(timestamp_utc) AS first_seen, max(timestamp_utc) AS last_seen, string_agg(line, chr(10) ORDER BY pass_number) FILTER (pass_number < 5) AS lines FROM l GROUP BY q_id)
SELECT s.q_id, concat_ws(chr(10), 'Regional history (≈50km around (' || printf('%.3f', a) || '°, ' || printf('%.3f', o) || '°)): ' || k || ' anomaly detection(s) across ' || p || ' orbital pass(es).', '  Recurring object types: ' || upper(again) || '.',
 '  Observed from ' || substr(first_seen, 1, 10) || ' to ' || substr(last_seen, 1, 10) || '.', lines) AS text FROM s LEFT JOIN c ON c.q_id = s.q_id""")
def history_text(m):
    return memory.history_text(alerted(m))


@query("SELECT scene_id, timestamp_utc, anomaly_count, cloud_cover FROM scenes ORDER BY timestamp_utc DESC, scene_id LIMIT 50")
def timeline(m):
    return memory.timeline(m.scenes).select("scene_id", "timestamp_utc", "anomaly_count", "cloud_cover")


@query("""WITH s AS (SELECT s.*, a.alert_level FROM scenes s LEFT JOIN advisories a ON a.scene_id = s.scene_id ORDER BY s.timestamp_utc DESC, s.scene_id LIMIT 10)
SELECT scene_id, CASE alert_level WHEN 'RED' THEN '[!]' WHEN 'ORANGE' THEN '[*]' WHEN 'YELLOW' THEN '[-]' WHEN 'GREEN' THEN '[+]' ELSE '[?]' END || ' **' || scene_id || '** | ' || substr(timestamp_utc, 1, 16) || ' UTC | ' || anomaly_count || ' anomaly(s) | Alert: ' || coalesce(alert_level, 'N/A') AS line FROM s""")
def timeline_lines(m):
    return memory.timeline_lines(m.scenes.join(m.advisories.select("scene_id", "alert_level"), "scene_id", "left"))


@query("SELECT det_id, lat, lon, conf AS weight FROM detections ORDER BY conf DESC, det_id LIMIT 500")
def heatmap_top(m):
    return memory.heatmap_top(m.detections)


@query("SELECT (SELECT count(*) FROM scenes) AS total_scenes, (SELECT count(*) FROM detections) AS total_anomalies")
def memory_totals(m):
    return memory.memory_totals(m.scenes, m.detections)


@query("""WITH fresh AS (SELECT scene_id, timestamp_utc, 0 AS anomaly_count FROM scenes WHERE compression_ratio % 4 = 0), old AS (SELECT scene_id, timestamp_utc, anomaly_count FROM scenes)
SELECT * FROM old WHERE scene_id NOT IN (SELECT scene_id FROM fresh) UNION ALL SELECT * FROM fresh""")
def scene_replace(m):
    s = m.scenes.select("scene_id", "timestamp_utc", "anomaly_count", "compression_ratio")
    fresh = s.where("compression_ratio % 4 = 0").withColumn("anomaly_count", F.lit(0))
    return memory.scene_replace(s, fresh).drop("compression_ratio")


@query("""WITH learned AS (SELECT scene_id FROM scenes WHERE compression_ratio % 3 = 0)
SELECT d.det_id, CASE WHEN l.scene_id IS NULL THEN d.conf ELSE round(d.conf / 2, 4) END AS conf FROM detections d LEFT JOIN learned l ON l.scene_id = d.scene_id WHERE l.scene_id IS NULL OR d.det_idx = 0""")
def remember(m):
    """Scenes whose ratio divides by three come again, with their first detection only and half its confidence; both tables are stored as versions."""
    s = m.scenes.select("scene_id", "compression_ratio")
    again = s.where("compression_ratio % 3 = 0")
    d = m.detections.select("scene_id", "det_id", "det_idx", "conf")
    new = d.join(again, "scene_id", "left_semi").where("det_idx = 0").withColumn("conf", F.round(F.col("conf") / 2, 4))
    store, spark = place(m.spark), m.spark
    part = F.pmod(F.xxhash64("scene_id"), F.lit(8)).cast("string")
    tables = lambda scenes, found: {"scenes": Change(scenes.withColumn("part", part), partition="part"), "detections": Change(found.withColumn("part", part), partition="part", keys=scenes)}
    versioned.apply(spark, store, tables(s, d), "first", 0)
    for _ in range(2):  # a batch that is run again changes nothing
        versioned.apply(spark, store, tables(again, new), "again", 0)
    return versioned.read(spark, store, "detections").select("det_id", "conf")


@query("""WITH learned AS (SELECT scene_id FROM scenes WHERE compression_ratio % 3 = 0)
SELECT d.det_id, CASE WHEN l.scene_id IS NULL THEN d.conf ELSE round(d.conf / 2, 4) END AS conf FROM detections d LEFT JOIN learned l ON l.scene_id = d.scene_id WHERE l.scene_id IS NULL OR d.det_idx = 0""")
def remember_tables(m):
    """The same between tables that are not stored."""
    s = m.scenes.select("scene_id", "compression_ratio")
    again = s.where("compression_ratio % 3 = 0")
    d = m.detections.select("scene_id", "det_id", "det_idx", "conf")
    new = d.join(again, "scene_id", "left_semi").where("det_idx = 0").withColumn("conf", F.round(F.col("conf") / 2, 4))
    return memory.remember(s, d, again, new)[1].select("det_id", "conf")


@query(f"SELECT scene_id, det_idx, {rounded('lat', 1)} AS klat, {rounded('lon', 1)} AS klon FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, {rounded('lat', 1)}, {rounded('lon', 1)} ORDER BY det_idx) AS r FROM detections WHERE det_idx < 3) WHERE r = 1")
def region_keys(m):
    return memory.region_keys(m.detections).select("scene_id", "det_idx", "klat", "klon")


@query("""WITH j AS (SELECT *, CASE WHEN abs(lon - lag(lon) OVER (PARTITION BY track ORDER BY i)) > 180 THEN 1 ELSE 0 END AS jump FROM tracks)
SELECT track, i, CAST(sum(jump) OVER (PARTITION BY track ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM j""")
def split_track(m):
    return spatial.split_track(m.tracks).select("track", "i", "segment")


@query("SELECT scene_id, det_idx FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY det_idx) AS r FROM detections) WHERE r <= 3")
def first_n(m):
    """The work cap of an analysis: the first three detections of a scene."""
    order = W.partitionBy("scene_id").orderBy("det_idx")
    return m.detections.withColumn("r", F.row_number().over(order)).where("r <= 3").select("scene_id", "det_idx")
