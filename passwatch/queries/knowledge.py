"""Queries of the knowledge table and of vector retrieval."""

from pyspark.sql import functions as F

from passwatch.adapters import rounded
from passwatch.functions import geo
from passwatch.operators import brief, index, reports, retrieve
from passwatch.plans import mission
from passwatch.queries import query
from passwatch.queries.detections import JSON_SQL, PCT, briefs
from passwatch.queries.history import LINE, NEAR
from passwatch.queries.sources import place
from passwatch.sources import versioned

TAGGED = "tagged AS (SELECT id, category, title, content, list_distinct(string_split(lower(title), ' ')) AS tags FROM chunks)"
#: The stated query set of a search: every vector whose id divides by 20, against all vectors.
SCORED = """q AS (SELECT id AS q_id, list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding))) AS e FROM vectors WHERE id % 20 = 0),
v AS (SELECT id, list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding))) AS e FROM vectors),
scored AS (SELECT q_id, id, round(list_dot_product(q.e, v.e), 6) AS score FROM q, v),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS rank FROM scored)"""


def tagged(m):
    return m.chunks.withColumn("tags", F.array_distinct(F.split(F.lower("title"), " ")))


def asked(m):
    return m.vectors.where("id % 20 = 0").select(F.col("id").alias("q_id"), F.col("embedding").alias("q_embedding"))


@query("SELECT id, category, title, length(content) AS n FROM chunks")
def scan_chunks(m):
    return m.chunks.select("id", "category", "title", F.length("content").cast("bigint").alias("n"))


@query("SELECT id FROM chunks WHERE category = 'src0'")
def chunks_by_category(m):
    return retrieve.chunks_by_category(m.chunks, "src0").select("id")


@query(f"WITH {TAGGED} SELECT id FROM tagged WHERE list_has_any(tags, ['the', 'la', 'der'])")
def chunks_by_tags(m):
    return retrieve.chunks_by_tags(tagged(m), ["the", "la", "der"]).select("id")


@query("SELECT DISTINCT category FROM chunks")
def categories(m):
    return retrieve.categories(m.chunks)


@query()
def build_vector_table(m):
    made, store = retrieve.build_vector_table(m.chunks), place(m.spark)
    index.load_or_build(made, store, "hashing-tf-idf")
    stored = versioned.read(m.spark, store, "vectors").select("id", "embedding", F.lit(256).alias("dim"), F.lit("hashing-tf-idf").alias("backend"))
    return retrieve.load_vector_table(stored, 256, "hashing-tf-idf").select("id", F.round(geo.dot("embedding", "embedding"), 6).alias("norm"), "dim")


@query("SELECT a.id, round(list_dot_product(a.embedding, b.embedding) + 1e-9, 6) AS dot FROM vectors a JOIN vectors b ON b.id = a.id + 1")
def dot(m):
    """Every vector with the next one."""
    after = m.vectors.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("other"))
    return m.vectors.join(after, "id").select("id", F.round(geo.dot("embedding", "other") + 1e-9, 6).alias("dot"))


@query("SELECT id, round(sqrt(list_dot_product(embedding, embedding)), 6) AS norm, round(embedding[1] / sqrt(list_dot_product(embedding, embedding)), 6) AS first FROM vectors")
def l2_normalize(m):
    return m.vectors.select("id", F.round(F.sqrt(geo.dot("embedding", "embedding")), 6).alias("norm"), F.round(geo.l2_normalize("embedding")[0], 6).alias("first"))


@query(f"WITH {SCORED} SELECT q_id, id, score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 3")
def retrieve_topk(m):
    return retrieve.retrieve_topk(asked(m), m.vectors, k=3, score_threshold=-1.0)


@query(f"WITH {SCORED} SELECT q_id, id, score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 3")
def retrieve_indexed(m):
    """The same by a stored index, which is built, found to fit, and searched with cells left out."""
    store = place(m.spark)
    index.load_or_build(m.vectors, store)
    if index.load_or_build(m.vectors, store):
        raise ValueError("the stored index does not fit its own vectors")
    return index.search(asked(m), store, k=3, score_threshold=-1.0)[0]


@query(f"WITH {SCORED} SELECT q_id, id, score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 4")
def vector_topk(m):
    return retrieve.retrieve_topk(asked(m), m.vectors, k=4, score_threshold=-1.0)


@query(f"WITH {SCORED} SELECT q_id, id, score FROM ranked WHERE rank <= 4 AND score >= 0.5")
def score_threshold(m):
    return retrieve.retrieve_topk(asked(m), m.vectors, k=4, score_threshold=0.5).select("q_id", "id", "score")


@query(f"WITH {SCORED} SELECT r.q_id, r.id, c.category, c.title FROM ranked r JOIN chunks c ON c.id = r.id WHERE r.rank <= 3")
def hydrate_chunks(m):
    return retrieve.hydrate_chunks(retrieve.retrieve_topk(asked(m), m.vectors, 3, -1.0), m.chunks).select("q_id", "id", "category", "title")


@query(f"""WITH {SCORED} SELECT r.q_id, md5(chr(10) || '--- RETRIEVED MARITIME KNOWLEDGE CONTEXT ---' || chr(10) || string_agg(chr(10) || '[' || r.id || '] ' || c.title || chr(10) || c.content, chr(10) ORDER BY r.rank) || chr(10) || '--- END CONTEXT ---' || chr(10)) AS digest
 FROM ranked r JOIN chunks c ON c.id = r.id WHERE r.rank <= 4 GROUP BY r.q_id""")
def format_context(m):
    hits = retrieve.hydrate_chunks(retrieve.retrieve_topk(asked(m), m.vectors, 4, -1.0), m.chunks)
    return retrieve.format_context(hits).select("q_id", F.md5(F.col("context").cast("binary")).alias("digest"))


@query(f"""WITH b AS (SELECT scene_id, count(*) AS n, string_agg(DISTINCT type, ', ' ORDER BY type) AS types, bool_or(conf < 0.55) AS low FROM detections GROUP BY scene_id)
SELECT s.scene_id, concat_ws('. ', b.types || ' detection', 'Indian Ocean maritime zone lat ' || printf('%.2f', (coalesce(f.lat_min, 0) + coalesce(f.lat_max, 0)) / 2) || ' lon ' || printf('%.2f', (coalesce(f.lon_min, 0) + coalesce(f.lon_max, 0)) / 2),
 CASE WHEN s.cloud_cover > 0.3 THEN 'cloud cover ' || {PCT.format('s.cloud_cover')} || ' degraded sensing' END, CASE WHEN b.n >= 3 THEN 'vessel cluster multiple detections' END, CASE WHEN b.low THEN 'low confidence detection uncertain identification' END) AS query
 FROM scenes s LEFT JOIN b ON b.scene_id = s.scene_id LEFT JOIN footprints f ON f.scene_id = s.scene_id""")
def retrieval_query_text(m):
    return retrieve.retrieval_query_text(m.scenes.select("scene_id", "cloud_cover").join(m.footprints, "scene_id", "left"), m.detections)


#: The history of each of a scene's regions, without alerts, as one text a scene.
REGIONAL = f"""keys AS (SELECT scene_id || '#' || det_idx AS q_id, scene_id AS q_scene, det_idx AS q_idx, lat, lon FROM detections WHERE det_idx < 3 QUALIFY row_number() OVER (PARTITION BY scene_id, {rounded('lat', 1)}, {rounded('lon', 1)} ORDER BY det_idx) = 1),
h AS (SELECT q.q_id, q.lat AS q_lat, q.lon AS q_lon, d.*, CAST(NULL AS VARCHAR) AS alert_level, row_number() OVER (PARTITION BY q.q_id ORDER BY d.timestamp_utc DESC, d.det_id DESC) - 1 AS pass_number FROM keys q JOIN detections d ON d.scene_id <> q.q_scene AND {NEAR}),
l AS (SELECT *, {LINE} AS line FROM h WHERE pass_number < 20),
again AS (SELECT q_id, string_agg(type, ', ' ORDER BY f) AS again FROM (SELECT q_id, type, min(pass_number) AS f FROM l GROUP BY q_id, type HAVING count(*) >= 2) GROUP BY q_id),
seen AS (SELECT q_id, any_value(q_lat) AS a, any_value(q_lon) AS o, count(*) AS k, count(DISTINCT scene_id) AS p, min(timestamp_utc) AS first_seen, max(timestamp_utc) AS last_seen, string_agg(line, chr(10) ORDER BY pass_number) FILTER (pass_number < 5) AS lines FROM l GROUP BY q_id),
texts AS (SELECT seen.q_id, concat_ws(chr(10), 'Regional history (≈50km around (' || printf('%.3f', a) || '°, ' || printf('%.3f', o) || '°)): ' || k || ' anomaly detection(s) across ' || p || ' orbital pass(es).', '  Recurring object types: ' || upper(again) || '.',
 '  Observed from ' || substr(first_seen, 1, 10) || ' to ' || substr(last_seen, 1, 10) || '.', lines) AS text FROM seen LEFT JOIN again ON again.q_id = seen.q_id),
histories AS (SELECT k.q_scene AS scene_id, string_agg(x.text, chr(10) || chr(10) ORDER BY k.q_idx) AS history FROM texts x JOIN keys k ON k.q_id = x.q_id GROUP BY k.q_scene)"""


@query(f"""WITH {JSON_SQL}, {REGIONAL}, units AS (SELECT id, list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding))) AS e FROM vectors),
named AS (SELECT scene_id, compression_ratio * 7919 % (SELECT count(*) FROM vectors) AS vid FROM scenes), scored AS (SELECT q.id AS vid, v.id, round(list_dot_product(q.e, v.e), 6) AS score FROM units q, units v WHERE q.id IN (SELECT vid FROM named)),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 4 AND score >= 0),
found AS (SELECT r.vid, chr(10) || '--- RETRIEVED MARITIME KNOWLEDGE CONTEXT ---' || chr(10) || string_agg(chr(10) || '[' || r.id || '] ' || c.title || chr(10) || c.content, chr(10) ORDER BY r.rank) || chr(10) || '--- END CONTEXT ---' || chr(10) AS context FROM ranked r JOIN chunks c ON c.id = r.id GROUP BY r.vid),
said AS (SELECT t.scene_id, concat_ws(chr(10) || chr(10), 'Analyse this telemetry payload and return your structured brief:' || chr(10), 'TELEMETRY PAYLOAD:' || chr(10) || t.head || t.compression_ratio || '}}}}', f.context, chr(10) || '--- HISTORICAL CONTEXT (prior orbital passes) ---' || chr(10) || p.history || chr(10) || '--- END HISTORICAL CONTEXT ---') AS message
 FROM t LEFT JOIN named n ON n.scene_id = t.scene_id LEFT JOIN found f ON f.vid = n.vid LEFT JOIN histories p ON p.scene_id = t.scene_id)
SELECT scene_id, md5(message) AS digest, CAST(length(message) AS INT) AS n_chars FROM said""")
def analyst_context(m):
    """Every scene's message; its search vector is that of the vector whose id its ratio names, among all there are."""
    many = m.vectors.count()
    searches = m.scenes.select("scene_id", (F.col("compression_ratio") * 7919 % many).alias("q_id"))
    vectors = m.vectors.select(F.col("id").alias("q_id"), F.col("embedding").alias("q_embedding")).join(searches.select("q_id").distinct(), "q_id", "left_semi")
    made = mission.analyst_context(reports.brief_json(briefs(m)).select("scene_id", "json"), searches, m.detections, m.vectors, m.chunks, vectors)
    return made.select("scene_id", F.md5(F.col("message").cast("binary")).alias("digest"), F.length("message").alias("n_chars"))


@query("SELECT conv_id, turn, length(trim(raw)) AS n, 'UNKNOWN' AS alert_level FROM reports")
def parse_reports(m):
    """The assistant turns as advisory responses: none is JSON, so that all are salvaged."""
    parsed = brief.parse_brief_json(m.reports)
    return parsed.select("conv_id", "turn", F.length(F.trim("raw")).cast("bigint").alias("n"), "brief.alert_level")
