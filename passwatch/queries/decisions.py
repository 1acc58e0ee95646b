"""Queries of alerts, follow-up requests and advisory briefs."""

from pyspark.sql import functions as F

from passwatch.adapters import rounded
from passwatch.functions import rules
from passwatch.operators import brief, policy
from passwatch.plans import mission
from passwatch.queries import query
from passwatch.queries.detections import PCT
from passwatch.queries.history import NEAR

ZONED = """zoned AS (SELECT * EXCLUDE (r) FROM (SELECT d.*, z.zone, row_number() OVER (PARTITION BY d.det_id ORDER BY z.zone_order) AS r FROM detections d LEFT JOIN zones z
 ON d.lat BETWEEN z.lat_min AND z.lat_max AND d.lon BETWEEN z.lon_min AND z.lon_max) WHERE r = 1)"""
FEATURES = "features AS (SELECT scene_id, count(*) AS n, max(conf) AS max_conf, bool_or(zone IS NOT NULL) AS in_zone FROM zoned GROUP BY scene_id)"
PAST = f"past AS (SELECT q.scene_id, CAST(least(count(*), 20) AS INT) AS history_count FROM (SELECT * FROM detections WHERE det_idx = 0) q JOIN detections d ON d.scene_id <> q.scene_id AND {NEAR} GROUP BY q.scene_id)"


def level(history: str) -> str:
    return f"""CASE WHEN n = 0 AND cloud_cover > 0.4 AND {history} > 0 THEN 'YELLOW' WHEN n = 0 THEN 'GREEN' WHEN n >= 3 OR max_conf >= 0.85 AND in_zone OR {history} >= 3 THEN 'RED'
 WHEN max_conf >= 0.70 OR in_zone AND max_conf >= 0.60 OR cloud_cover > 0.4 AND {history} > 0 THEN 'ORANGE' WHEN max_conf >= 0.40 THEN 'YELLOW' ELSE 'GREEN' END"""


ALERTS = f"""alerts AS (SELECT *, {level('history_count')} AS policy_alert FROM (SELECT s.*, coalesce(f.n, 0) AS n, coalesce(f.max_conf, 0) AS max_conf, coalesce(f.in_zone, false) AS in_zone, coalesce(p.history_count, 0) AS history_count
 FROM scenes s LEFT JOIN features f ON f.scene_id = s.scene_id LEFT JOIN past p ON p.scene_id = s.scene_id))"""
TRIGGERED = """triggered AS (SELECT z.*, coalesce(p.history_count, 0) AS h, CASE WHEN conf >= 0.85 AND zone IS NOT NULL THEN 1 WHEN h >= 3 THEN 1 WHEN conf >= 0.70 AND zone IS NOT NULL THEN 2 WHEN h >= 2 THEN 2 WHEN conf >= 0.80 AND type IN ('airplane', 'ship') THEN 2
 WHEN conf < 0.55 AND zone IS NOT NULL THEN 3 ELSE 5 END AS priority,
 CASE WHEN conf >= 0.85 AND zone IS NOT NULL THEN 'High-confidence ' || type || ' in ' || zone WHEN h >= 3 THEN 'Recurring anomaly — ' || h || ' prior observations' WHEN conf >= 0.70 AND zone IS NOT NULL THEN 'Medium-high confidence ' || type || ' in ' || zone
 WHEN h >= 2 THEN 'Repeated anomaly — ' || h || ' prior observations' WHEN conf >= 0.80 AND type IN ('airplane', 'ship') THEN 'High confidence ' || type || ' requires verification' WHEN conf < 0.55 AND zone IS NOT NULL THEN 'Low-confidence detection in ' || zone || ' — verify'
 ELSE 'No OVV trigger conditions met' END AS reason FROM zoned z LEFT JOIN past p ON p.scene_id = z.scene_id)"""
DEDUPED = f"deduped AS (SELECT *, {rounded('lat', 2)} AS klat, {rounded('lon', 2)} AS klon FROM triggered WHERE priority < 5 QUALIFY row_number() OVER (PARTITION BY scene_id, {rounded('lat', 2)}, {rounded('lon', 2)} ORDER BY det_idx) = 1)"
ASKED = f"""asked AS (SELECT a.* FROM advisories a WHERE a.ovv_trigger AND NOT EXISTS (SELECT 1 FROM deduped p WHERE p.scene_id = a.scene_id AND p.klat = {rounded('a.ovv_lat', 2)} AND p.klon = {rounded('a.ovv_lon', 2)}))"""
NUMBERED = """both_kinds AS (SELECT scene_id, lat, lon, reason, priority, 'policy' AS source, 0 AS source_rank, det_idx FROM deduped UNION ALL SELECT scene_id, ovv_lat, ovv_lon, ovv_reason, ovv_priority, 'llm', 1, 0 FROM asked),
numbered AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY source_rank, det_idx) AS seq FROM both_kinds),
requests AS (SELECT *, 'OVV-' || lpad(CAST(seq AS VARCHAR), 3, '0') AS request_id FROM numbered QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY priority, seq) <= 3)"""
FULL = f"{ZONED}, {FEATURES}, {PAST}, {ALERTS}, {TRIGGERED}, {DEDUPED}, {ASKED}, {NUMBERED}"
DECIDED = f"""{FULL}, finals AS (SELECT a.*, CASE WHEN v.scene_id IS NULL THEN a.policy_alert WHEN array_position(['GREEN', 'YELLOW', 'ORANGE', 'RED'], a.policy_alert) >= coalesce(array_position(['GREEN', 'YELLOW', 'ORANGE', 'RED'], v.alert_level), 1) THEN a.policy_alert ELSE v.alert_level END AS final_alert,
 CASE WHEN v.scene_id IS NULL THEN 'policy' ELSE 'hybrid' END AS basis FROM alerts a LEFT JOIN advisories v ON v.scene_id = a.scene_id),
tasks AS (SELECT scene_id, count(*) AS n_requests, min(priority) AS first_priority FROM requests GROUP BY scene_id),
decided AS (SELECT f.scene_id, f.timestamp_utc, f.n, f.history_count, f.policy_alert, f.final_alert, f.basis, coalesce(t.n_requests, 0) AS n_requests, CAST(t.first_priority AS INT) AS first_priority,
 coalesce(nullif(concat_ws('; ', CASE WHEN t.n_requests > 0 THEN 'OVV scheduled: ' || t.n_requests || ' request(s) (priority ' || t.first_priority || ')' END, CASE WHEN f.final_alert IN ('ORANGE', 'RED') THEN 'Alert dispatched: ' || f.final_alert END), ''), 'No action required — monitoring continued.') AS actions
 FROM finals f LEFT JOIN tasks t ON t.scene_id = f.scene_id)"""


def zoned(m):
    return policy.zoned_detections(m.detections, m.zones)


def cycle(m):
    return mission.mission_cycle(m.scenes, m.detections, m.zones, m.advisories)


@query(f"WITH {ZONED} SELECT det_id, zone FROM zoned")
def risk_zone_join(m):
    return zoned(m).select("det_id", "zone")


@query(f"WITH {ZONED}, {FEATURES} SELECT * FROM features")
def alert_features(m):
    return policy.alert_features(zoned(m))


@query(f"WITH {ZONED}, {FEATURES}, a AS (SELECT s.scene_id, s.cloud_cover, coalesce(f.n, 0) AS n, coalesce(f.max_conf, 0) AS max_conf, coalesce(f.in_zone, false) AS in_zone FROM scenes s LEFT JOIN features f ON f.scene_id = s.scene_id) SELECT scene_id, {level('0')} AS policy_alert FROM a")
def alert_level(m):
    return policy.alert_level(m.scenes, policy.alert_features(zoned(m))).select("scene_id", "policy_alert")


@query(f"WITH {ZONED}, {PAST}, {TRIGGERED} SELECT det_id, priority < 5 AS trigger, reason, priority FROM triggered")
def ovv_trigger(m):
    from passwatch.operators.spatial import history_count

    return policy.ovv_triggers(zoned(m), history_count(m.detections)).select("det_id", "trigger", "reason", "priority")


@query("SELECT scene_id, CASE WHEN p >= coalesce(array_position(['GREEN', 'YELLOW', 'ORANGE', 'RED'], alert_level), 1) THEN ['GREEN', 'YELLOW', 'ORANGE', 'RED'][p] ELSE alert_level END AS alert FROM (SELECT scene_id, alert_level, CAST(1 + ovv_priority % 4 AS INT) AS p FROM advisories)")
def reconcile_alert(m):
    names = F.array(*[F.lit(x) for x in ("GREEN", "YELLOW", "ORANGE", "RED")])
    return m.advisories.select("scene_id", rules.reconcile_alert(names[F.col("ovv_priority") % 4], F.col("alert_level")).alias("alert"))


@query(f"WITH {ZONED}, {PAST}, {TRIGGERED}, {DEDUPED} SELECT det_id, klat, klon FROM deduped")
def ovv_dedupe(m):
    return policy.ovv_dedupe(policy.ovv_triggers(zoned(m), _past(m))).select("det_id", "klat", "klon")


def _past(m):
    from passwatch.operators.spatial import history_count

    return history_count(m.detections)


def _policy(m):
    return policy.ovv_dedupe(policy.ovv_triggers(zoned(m), _past(m)))


@query(f"WITH {ZONED}, {PAST}, {TRIGGERED}, {DEDUPED}, {ASKED} SELECT scene_id, ovv_priority AS priority FROM asked")
def advisory_ovv_anti(m):
    return policy.advisory_ovv_anti(m.advisories, _policy(m)).select("scene_id", "priority")


def _both(m):
    p = _policy(m)
    return policy.ovv_union(p, policy.advisory_ovv_anti(m.advisories, p))


@query(f"WITH {ZONED}, {PAST}, {TRIGGERED}, {DEDUPED}, {ASKED}, {NUMBERED} SELECT scene_id, lat, lon, reason, CAST(priority AS INT) AS priority, source FROM both_kinds")
def ovv_union(m):
    return _both(m).select("scene_id", "lat", "lon", "reason", "priority", "source")


@query(f"WITH {ZONED}, {PAST}, {TRIGGERED}, {DEDUPED}, {ASKED}, {NUMBERED} SELECT scene_id, CAST(seq AS INT) AS seq, 'OVV-' || lpad(CAST(seq AS VARCHAR), 3, '0') AS request_id, source FROM numbered")
def ovv_number(m):
    return policy.ovv_number(_both(m)).select("scene_id", "seq", "request_id", "source")


@query(f"WITH {FULL} SELECT scene_id, request_id, CAST(priority AS INT) AS priority, source, reason FROM requests")
def ovv_cap(m):
    return cycle(m)[1].select("scene_id", "request_id", "priority", "source", "reason")


@query(f"WITH {DECIDED} SELECT scene_id, n_requests, actions FROM decided")
def decision_actions(m):
    return cycle(m)[0].select("scene_id", "n_requests", "actions")


@query(f"WITH {DECIDED} SELECT scene_id, timestamp_utc, n, history_count, policy_alert, final_alert, basis, n_requests, first_priority, actions FROM decided")
def mission_cycle(m):
    return cycle(m)[0].select("scene_id", "timestamp_utc", "n", "history_count", "policy_alert", "final_alert", "basis", "n_requests", "first_priority", "actions")


@query("SELECT s.scene_id, s.anomaly_count, a.alert_level, a.summary FROM scenes s LEFT JOIN advisories a ON a.scene_id = s.scene_id")
def brief_join(m):
    return m.scenes.select("scene_id", "anomaly_count").join(m.advisories.select("scene_id", "alert_level", "summary"), "scene_id", "left")


COUNTS = "counts AS (SELECT scene_id, anomaly_count AS detected, CAST(greatest(anomaly_count + compression_ratio % 3 - 1, 0) AS INT) AS reported FROM scenes)"


def counts(m):
    """What a report of each scene claims: one more, one less or as many as there are."""
    return m.scenes.select("scene_id", F.col("anomaly_count").alias("detected"), F.greatest(F.col("anomaly_count") + F.col("compression_ratio") % 3 - 1, F.lit(0)).cast("int").alias("reported"))


@query(f"WITH {COUNTS} SELECT scene_id, detected, reported, CASE WHEN detected = reported THEN 1.0E0 ELSE 0.0E0 END AS accuracy, detected = reported AS is_faithful, CASE WHEN reported > detected THEN 'Hallucination (Over-reporting)' WHEN reported < detected THEN 'Omission (Under-reporting)' END AS failure_mode FROM counts")
def faithfulness(m):
    return brief.faithfulness(counts(m))


@query(f"WITH {COUNTS} SELECT round(avg(CASE WHEN detected = reported THEN 1.0E0 ELSE 0.0E0 END), 6) AS accuracy, count(*) AS scenes FROM counts")
def corpus_faithfulness(m):
    return brief.faithfulness(counts(m)).agg(F.round(F.avg("accuracy"), 6).alias("accuracy"), F.count("*").alias("scenes"))


@query("SELECT a.scene_id, coalesce(d.n, 0) AS detected, a.alert_level FROM advisories a JOIN scenes s ON s.scene_id = a.scene_id LEFT JOIN (SELECT scene_id, count(*) AS n FROM detections GROUP BY scene_id) d ON d.scene_id = a.scene_id")
def eval_join(m):
    n = m.detections.groupBy("scene_id").agg(F.count("*").alias("n"))
    return m.scenes.select("scene_id").join(m.advisories.select("scene_id", "alert_level"), "scene_id").join(n, "scene_id", "left").select("scene_id", F.coalesce("n", F.lit(0)).alias("detected"), "alert_level")


TEXTS = "texts AS (SELECT scene_id, CASE compression_ratio % 3 WHEN 0 THEN 'A ship and an Airplane' WHEN 1 THEN 'shipping near the harbor' ELSE 'nothing to see' END AS text FROM scenes)"


def texts(m):
    return m.scenes.select("scene_id", F.when(F.col("compression_ratio") % 3 == 0, "A ship and an Airplane").when(F.col("compression_ratio") % 3 == 1, "shipping near the harbor").otherwise("nothing to see").alias("text"))


@query(f"""WITH {TEXTS}, c AS (SELECT t.scene_id, count(d.det_id) AS detected, count(d.det_id) FILTER (contains(lower(t.text), d.type)) AS named, any_value((length(lower(text)) - length(replace(lower(text), 'ship', ''))) // 4 + (length(lower(text)) - length(replace(lower(text), 'harbor', ''))) // 6) AS loose
 FROM texts t LEFT JOIN detections d ON d.scene_id = t.scene_id GROUP BY t.scene_id) SELECT scene_id, CAST(detected AS INT) AS detected, CAST(CASE WHEN named = 0 AND detected > 0 THEN least(loose, detected) ELSE named END AS INT) AS reported FROM c""")
def faithfulness_text(m):
    return brief.reported_in_text(texts(m), m.detections)


@query("SELECT scene_id, type, count(*) AS n, min(det_idx) AS first_at FROM detections GROUP BY scene_id, type")
def scene_type_counts(m):
    return brief.scene_type_counts(m.detections)


def narrated(table: str, alert: str) -> str:
    """The narratives of all scenes, with alerts from a table."""
    return f"""
t AS (SELECT scene_id, type, count(*) AS n, min(det_idx) AS f FROM detections GROUP BY scene_id, type), l AS (SELECT scene_id, string_agg(n || ' ' || type || CASE WHEN n > 1 THEN 's' ELSE '' END, ', ' ORDER BY f) AS types FROM t GROUP BY scene_id),
s2 AS (SELECT s.scene_id, s.cloud_cover, a.{alert} AS alert_level, l.types, (coalesce(f.lat_min, 0) + coalesce(f.lat_max, 0)) / 2 AS la, (coalesce(f.lon_min, 0) + coalesce(f.lon_max, 0)) / 2 AS lo FROM scenes s LEFT JOIN {table} a ON a.scene_id = s.scene_id LEFT JOIN footprints f ON f.scene_id = s.scene_id LEFT JOIN l ON l.scene_id = s.scene_id),
narrated AS (SELECT scene_id, CASE WHEN types IS NULL THEN 'No anomalies detected in scene ' || scene_id || CASE WHEN cloud_cover > 0.3 THEN ' (sensing degraded by ' || {PCT.format('cloud_cover')} || ' cloud cover)' ELSE '' END || '.'
 ELSE lower(types) || ' detected at (' || printf('%.3f', la) || '°N, ' || printf('%.3f', lo) || '°E)' || CASE WHEN cloud_cover > 0.2 THEN ' under ' || {PCT.format('cloud_cover')} || ' cloud cover' ELSE '' END ||
 CASE alert_level WHEN 'RED' THEN ' — IMMEDIATE ATTENTION REQUIRED' WHEN 'ORANGE' THEN ' — elevated activity flagged' WHEN 'YELLOW' THEN ' — monitoring recommended' ELSE '' END || '.' END AS narrative FROM s2)"""


NARRATED = narrated("advisories", "alert_level")


def narratives(m):
    s = m.scenes.select("scene_id", "cloud_cover").join(m.advisories.select("scene_id", "alert_level"), "scene_id", "left").join(m.footprints, "scene_id", "left")
    return brief.scene_narrative(s, m.detections)


def _spot(lat: str, lon: str) -> str:
    return f"' | (' || printf('%.4f', {rounded(lat, 4)}) || '°, ' || printf('%.4f', {rounded(lon, 4)}) || '°)'"


@query(f"""WITH {DECIDED}, {narrated("decided", "final_alert")},
found AS (SELECT scene_id, string_agg('  ' || upper(type) || ' @ ' || substr({_spot("lat", "lon")}, 4) || ' | conf=' || {PCT.format("conf")} || ' | risk=' || CASE WHEN conf > 0.6 THEN 'MEDIUM' ELSE 'LOW' END || chr(10) || '    → Policy rule applied; LLM assessment unavailable.', chr(10) ORDER BY det_idx) AS lines FROM detections GROUP BY scene_id),
planned AS (SELECT scene_id, string_agg('  [' || request_id || '] Priority ' || priority || {_spot("lat", "lon")} || ' | Source: ' || upper(source) || chr(10) || '    → ' || reason, chr(10) ORDER BY priority, seq) AS lines FROM requests GROUP BY scene_id)
SELECT d.scene_id, concat_ws(chr(10), repeat('═', 60), '  MISSION LOG — ' || d.scene_id, '  ' || d.timestamp_utc, repeat('═', 60), '', '  SENSOR REPORT', repeat('─', 60), '  Detections    : ' || d.n, '  Cloud Cover   : ' || {PCT.format("s.cloud_cover")},
 '  Inference     : ' || CAST(CAST(round(s.inference_ms) AS BIGINT) AS VARCHAR) || 'ms on-board', '  Compression   : ' || format('{{:,}}', CAST(s.compression_ratio AS BIGINT)) || ':1', '', '  INTELLIGENCE ASSESSMENT', repeat('─', 60), '  Alert Level   : ' || d.final_alert, '  Decision Basis: ' || upper(d.basis),
 '  LLM Available : ' || CASE WHEN d.basis = 'hybrid' THEN 'Yes' ELSE 'No (policy fallback)' END, chr(10) || '  Summary: ' || coalesce(a.summary, 'Policy-only analysis: ' || d.n || ' anomaly(s) detected. LLM analyst unavailable.'), '  Narrative: ' || t.narrative,
 chr(10) || '  ANOMALY ASSESSMENTS' || chr(10) || repeat('─', 60) || chr(10) || f.lines, coalesce(chr(10) || '  OVV SCHEDULE' || chr(10) || repeat('─', 60) || chr(10) || p.lines, chr(10) || '  OVV SCHEDULE: None required'),
 chr(10) || '  ACTIONS TAKEN' || chr(10) || repeat('─', 60) || chr(10) || '  • ' || replace(d.actions, '; ', chr(10) || '  • '), repeat('═', 60)) AS log
 FROM decided d JOIN scenes s ON s.scene_id = d.scene_id JOIN narrated t ON t.scene_id = d.scene_id LEFT JOIN advisories a ON a.scene_id = d.scene_id LEFT JOIN found f ON f.scene_id = d.scene_id LEFT JOIN planned p ON p.scene_id = d.scene_id""")
def mission_log(m):
    return mission.mission_logs(m.scenes, m.detections, m.zones, m.advisories, m.footprints)


@query(f"WITH {NARRATED} SELECT * FROM narrated")
def scene_narrative(m):
    return narratives(m)


@query(f"WITH {NARRATED} SELECT a.scene_id, CASE WHEN a.ovv_trigger THEN a.summary ELSE n.narrative END AS scene_narrative FROM advisories a JOIN narrated n ON n.scene_id = a.scene_id")
def fill_narrative(m):
    given = m.advisories.select("scene_id", F.when(F.col("ovv_trigger"), F.col("summary")).otherwise("").alias("scene_narrative"))
    return brief.fill_narrative(given, narratives(m))


@query(f"""WITH {ZONED}, {FEATURES}, a AS (SELECT s.scene_id, {level('0')} AS alert_level, n FROM (SELECT s.scene_id, s.cloud_cover, coalesce(f.n, 0) AS n, coalesce(f.max_conf, 0) AS max_conf, coalesce(f.in_zone, false) AS in_zone FROM scenes s LEFT JOIN features f ON f.scene_id = s.scene_id) s),
r AS (SELECT scene_id, string_agg(type || '/' || CASE WHEN conf > 0.6 THEN 'MEDIUM' ELSE 'LOW' END, ',' ORDER BY det_idx) AS risks FROM detections GROUP BY scene_id)
SELECT a.scene_id, a.alert_level, 'Policy-only analysis: ' || n || ' anomaly(s) detected. LLM analyst unavailable.' AS summary, n || ' detection(s) flagged by onboard model.' AS scene_narrative, 'Policy alert computed: ' || alert_level AS trace, coalesce(risks, '') AS risks FROM a LEFT JOIN r ON r.scene_id = a.scene_id""")
def fallback_brief(m):
    made = brief.fallback_brief(policy.alert_level(m.scenes, policy.alert_features(zoned(m))), m.detections)
    risks = F.array_join(F.transform("anomaly_assessments", lambda a: F.concat(a["type"], F.lit("/"), a["risk_tier"])), ",")
    return made.select("scene_id", "alert_level", "summary", "scene_narrative", F.col("reasoning_trace")[1].alias("trace"), risks.alias("risks"))


@query("""WITH m AS (SELECT scene_id, 'Analyse this telemetry payload and return your structured brief:' || chr(10) || chr(10) || chr(10) || 'TELEMETRY PAYLOAD:' || chr(10) || scene_id AS head, CASE WHEN compression_ratio % 2 = 0 THEN 'CONTEXT' END AS c, CASE WHEN compression_ratio % 3 = 0 THEN 'PAST' END AS h FROM scenes)
SELECT scene_id, concat_ws(chr(10) || chr(10), head, c, chr(10) || '--- HISTORICAL CONTEXT (prior orbital passes) ---' || chr(10) || h || chr(10) || '--- END HISTORICAL CONTEXT ---') AS message FROM m""")
def analyst_message(m):
    context = F.when(F.col("compression_ratio") % 2 == 0, "CONTEXT").otherwise("")
    past = F.when(F.col("compression_ratio") % 3 == 0, "PAST")
    return m.scenes.select("scene_id", brief.analyst_message(F.col("scene_id"), context, past).alias("message"))


@query("""WITH w AS (SELECT a.scene_id, a.alert_level, a.summary, s.compression_ratio % 5 AS way FROM advisories a JOIN scenes s ON s.scene_id = a.scene_id),
j AS (SELECT *, '{"alert_level":"' || alert_level || '","summary":"' || summary || '","anomaly_assessments":[{"type":"ship","risk_tier":"HIGH"}]}' AS doc FROM w)
SELECT scene_id, way < 3 AS parsed, CASE WHEN way < 4 THEN alert_level ELSE 'UNKNOWN' END AS alert_level, CASE WHEN way < 4 THEN summary ELSE 'Parse error. Salvaged data shown.' END AS summary,
 CAST(CASE WHEN way < 4 THEN 1 ELSE 0 END AS INT) AS assessments, CAST(CASE WHEN way = 3 THEN least(500, length(doc) - 3) WHEN way = 4 THEN 0 END AS INT) AS kept FROM j""")
def parse_brief_json(m):
    """Advisories as JSON in five forms: clean, fenced, inside other text, cut off, and empty."""
    doc = F.to_json(F.struct("alert_level", "summary", F.array(F.struct(F.lit("ship").alias("type"), F.lit("HIGH").alias("risk_tier"))).alias("anomaly_assessments")))
    way = F.col("compression_ratio") % 5
    raw = F.when(way == 0, doc).when(way == 1, F.concat(F.lit("```json\n"), doc, F.lit("\n```"))).when(way == 2, F.concat(F.lit("Here it is: "), doc, F.lit(" Done."))).when(way == 3, F.substring(doc, 1, 1000).substr(F.lit(1), F.length(doc) - 3)).otherwise("")
    parsed = brief.parse_brief_json(m.advisories.join(m.scenes.select("scene_id", "compression_ratio"), "scene_id").select("scene_id", raw.alias("raw")))
    return parsed.select("scene_id", "parsed", "brief.alert_level", "brief.summary", F.size("brief.anomaly_assessments").alias("assessments"), F.length("raw_head").alias("kept"))

