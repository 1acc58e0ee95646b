"""Every branch and boundary of the decision rules, and golden values of texts and geometry."""

import math
import random

import pytest
from pyspark.sql import functions as F

from passwatch.functions import geo, rules, text
from passwatch.operators import brief, detect, policy, raster, reports, retrieve, spatial, spectral


@pytest.mark.parametrize(
    ("n", "conf", "zone", "cloud", "past", "want"),
    [
        (0, None, None, 0.5, 1, "YELLOW"), (0, None, None, 0.4, 1, "GREEN"), (0, None, None, 0.5, 0, "GREEN"),
        (3, 0.1, False, 0.0, 0, "RED"), (1, 0.85, True, 0.0, 0, "RED"), (1, 0.84, True, 0.0, 0, "ORANGE"), (1, 0.1, False, 0.0, 3, "RED"),
        (1, 0.70, False, 0.0, 0, "ORANGE"), (1, 0.60, True, 0.0, 0, "ORANGE"), (1, 0.59, True, 0.0, 0, "YELLOW"), (1, 0.1, False, 0.41, 1, "ORANGE"),
        (1, 0.40, False, 0.0, 0, "YELLOW"), (1, 0.39, False, 0.0, 0, "GREEN"), (2, 0.39, True, 0.4, 2, "GREEN"),
    ],
)
def test_alert_level(spark, n, conf, zone, cloud, past, want):
    row = spark.createDataFrame([(n, conf, zone, cloud, past)], "n int, c double, z boolean, cl double, h int")
    assert row.select(rules.alert_level(*map(F.col, ("n", "c", "z", "cl", "h")))).first()[0] == want


@pytest.mark.parametrize(
    ("conf", "kind", "zone", "past", "priority"),
    [
        (0.85, "ship", "Z", 0, 1), (0.2, "harbor", None, 3, 1), (0.70, "harbor", "Z", 0, 2), (0.2, "harbor", None, 2, 2), (0.80, "ship", None, 0, 2), (0.80, "airplane", None, 0, 2),
        (0.80, "harbor", None, 0, 5), (0.54, "ship", "Z", 0, 3), (0.55, "ship", "Z", 0, 5), (0.69, "ship", "Z", 0, 5), (None, None, None, 0, 5),
    ],
)
def test_ovv_trigger(spark, conf, kind, zone, past, priority):
    row = spark.createDataFrame([(conf, kind, zone, past)], "c double, k string, z string, h int")
    got = row.select(rules.ovv_trigger(*map(F.col, ("c", "k", "z", "h"))).alias("t")).first()[0]
    assert (got.priority, got.trigger) == (priority, priority < 5)


def test_reconcile(spark):
    rows = spark.createDataFrame([("GREEN", "UNKNOWN"), ("YELLOW", "RED"), ("RED", "GREEN"), ("GREEN", "odd")], "p string, a string")
    assert [r[0] for r in rows.select(rules.reconcile_alert(F.col("p"), F.col("a"))).collect()] == ["GREEN", "RED", "RED", "GREEN"]


def test_three_detections(spark):
    scene = spark.createDataFrame([("A", "2026-04-24T09:12:44Z", 0.08, 312.4, 85000)], "scene_id string, timestamp_utc string, cloud_cover double, inference_ms double, compression_ratio bigint")
    det = spark.createDataFrame(
        [("A", 0, 1, "ship", 8.412, 77.821, 0.87, 320, 210, 380, 250), ("A", 1, 2, "ship", 8.388, 77.795, 0.79, 280, 300, 340, 330), ("A", 2, 3, "harbor", 8.501, 77.901, 0.92, 450, 140, 560, 220)],
        "scene_id string, det_idx int, det_id bigint, type string, lat double, lon double, conf double, x1 int, y1 int, x2 int, y2 int",
    )
    zones = spark.createDataFrame([(0, "Palk Strait", 8.0, 10.0, 79.0, 80.0)], "zone_order int, zone string, lat_min double, lat_max double, lon_min double, lon_max double")
    zoned = spatial.risk_zone_join(det, zones)
    assert policy.alert_level(scene, policy.alert_features(zoned)).first().policy_alert == "RED"
    asked = policy.ovv_dedupe(policy.ovv_triggers(zoned)).collect()
    assert [(r.det_id, r.priority) for r in asked] == [(1, 2)]
    foot = spark.createDataFrame([("A", 8.0, 9.0, 77.0, 78.0)], "scene_id string, lat_min double, lat_max double, lon_min double, lon_max double")
    made = detect.assemble_brief(scene.withColumn("scene_id", F.lit("A")), det, foot).withColumn("scene_id", F.lit("ABC-COMPRESS-CHECK"))
    assert reports.compression_report(made).first().wire_bytes == 226 - 19 + len("detector-1")


def test_geometry(spark):
    box = spark.createDataFrame([(305, 305, 335, 335), (0, 0, 10, 10), (630, 630, 640, 640)], "x1 int, y1 int, x2 int, y2 int")
    lat, lon = geo.pixel_to_latlon(*map(F.col, ("x1", "y1", "x2", "y2")), F.lit(8.0), F.lit(9.0), F.lit(77.0), F.lit(78.0))
    got = [tuple(r) for r in box.select(lat, lon).collect()]
    assert got[0] == (8.5, 77.5) and got[1] == pytest.approx((9.0, 77.0), abs=0.01) and got[2] == pytest.approx((8.0, 78.0), abs=0.01)
    km = spark.range(1).select(geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).first()[0]
    assert km == pytest.approx(math.pi * 6371.0 / 180)


def test_nms_forms_agree(spark):
    import random

    r = random.Random(3)
    data = [(f"s{k % 6}", k, "ship", r.random(), a := r.randrange(100), b := r.randrange(100), a + r.randrange(5, 60), b + r.randrange(5, 60)) for k in range(300)]
    boxes = spark.createDataFrame(data, "scene_id string, det_id bigint, type string, conf double, x1 int, y1 int, x2 int, y2 int")
    pair = lambda df: sorted(tuple(x) for x in df.select("scene_id", "det_id").collect())
    assert pair(detect.nms(boxes)) == pair(detect.nms_kernel(boxes))


def test_region_join_equals_plain(spark):
    import random

    r = random.Random(4)
    det = spark.createDataFrame([(f"s{k % 90}", k, 60 * r.random(), 8 + 8 * r.random(), k) for k in range(600)], "scene_id string, det_id bigint, lat double, lon double, ts bigint")
    q = det.where("det_id < 60").select(F.col("det_id").alias("q_id"), F.col("scene_id").alias("q_scene"), F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon"))
    y, x = geo.half_box(F.col("q_lat"), 300.0)
    plain = q.join(det, (F.col("scene_id") != F.col("q_scene")) & F.col("lat").between(F.col("q_lat") - y, F.col("q_lat") + y) & F.col("lon").between(F.col("q_lon") - x, F.col("q_lon") + x)).where(geo.haversine_km(F.col("q_lat"), F.col("q_lon"), F.col("lat"), F.col("lon")) <= 300)
    assert sorted(map(tuple, spatial.region_join(q, det, 300.0).select("q_id", "det_id").collect())) == sorted(map(tuple, plain.select("q_id", "det_id").collect()))


def test_zone_forms_agree(spark):
    det = spark.createDataFrame([(k, 8 + (k * 7 % 100) / 20, 72 + (k * 13 % 100) / 15) for k in range(200)], "det_id bigint, lat double, lon double")
    zones = spark.createDataFrame([(1, "b", 8.0, 10.0, 72.0, 75.0), (0, "a", 9.0, 12.0, 73.0, 77.0)], "zone_order int, zone string, lat_min double, lat_max double, lon_min double, lon_max double")
    pairs = [sorted((r.det_id, r.zone or "") for r in spatial.risk_zone_join(det, zones, most).collect()) for most in (256, 0)]
    assert pairs[0] == pairs[1] and {z for _, z in pairs[0]} == {"", "a", "b"}


def test_parse_brief_forms(spark):
    good = '{"alert_level": "RED", "summary": "s", "anomaly_assessments": [{"type": "ship", "risk_tier": "HIGH"}]}'
    rows = [(1, good), (2, f"```json\n{good}\n```"), (3, f"Here: {good} Bye."), (4, good[:-20]), (5, ""), (6, None)]
    got = {r.i: r for r in brief.parse_brief_json(spark.createDataFrame(rows, "i int, raw string")).collect()}
    assert all(got[i].parsed and got[i].brief.alert_level == "RED" for i in (1, 2, 3))
    assert not got[4].parsed and got[4].brief.alert_level == "RED" and got[4].brief.anomaly_assessments[0].type == "ship"
    assert got[5].brief.alert_level == "UNKNOWN" and not got[6].parsed


def test_empty_tables(spark):
    none = spark.createDataFrame([], "scene_id string, det_idx int, det_id bigint, type string, lat double, lon double, conf double, ts timestamp, timestamp_utc string, x1 int, y1 int, x2 int, y2 int, anomaly_count int, cloud_cover double, inference_ms double, compression_ratio bigint")
    assert spatial.history_count(none).count() == 0
    assert reports.batch_summary(none).first().tiles == 0
    assert brief.scene_narrative(none.withColumns({c: F.lit(None).cast("double") for c in ("lat_min", "lat_max", "lon_min", "lon_max")}).withColumn("alert_level", F.lit("RED")), none).count() == 0
    vectors = spark.createDataFrame([], "q_id bigint, q_embedding array<double>, id bigint, embedding array<double>")
    assert retrieve.retrieve_topk(vectors, vectors).count() == 0


def test_spectral_example(spark):
    import random

    r = random.Random(1)
    rows = []
    for y in range(170, 272):
        for x in range(200, 472):
            inside = 200 <= y < 240 and 310 <= x < 360
            low = [0.05 + 0.2 * r.random() for _ in range(6)]
            rows.append((1, y, x, low[0], 0.30 if inside else low[1], low[2], low[3], 0.45 if inside else low[4], 0.40 if inside else low[5]))
    pixels = spark.createDataFrame(rows, "scene_no bigint, y int, x int, b2 double, b3 double, b4 double, b8 double, b11 double, b12 double")
    box = spark.createDataFrame([(1, 1, "ship", 8.4, 77.8, 0.87, 310, 200, 360, 240)], "det_id bigint, scene_no bigint, type string, lat double, lon double, conf double, x1 int, y1 int, x2 int, y2 int")
    got = spectral.explain_batch(box, pixels).first()
    assert set(got.dominant_bands.split(", ")) == {"B11 (SWIR1)", "B12 (SWIR2)"} and "strong SWIR" in got.signature and got.quality == "high"


def test_resize_and_tiles(spark):
    flat = spark.createDataFrame([(1, y, x, 2.0) for y in range(4) for x in range(4)], "scene_no bigint, y int, x int, value double")
    up = raster.resize_bilinear(flat, 4, 4, 8, 8).collect()
    assert len(up) == 64 and all(r.value == pytest.approx(2.0) for r in up)
    ramp = spark.createDataFrame([(1, y, x, float(x)) for y in range(4) for x in range(4)], "scene_no bigint, y int, x int, value double")
    row = {r.x: r.value for r in raster.resize_bilinear(ramp, 4, 4, 8, 8).where("y = 3").collect()}
    assert [row[i] for i in range(8)] == pytest.approx([0, 0.25, 0.75, 1.25, 1.75, 2.25, 2.75, 3])
    cut = raster.tile_scene(flat, size=3, height=4, width=4, pad=True)
    assert {(r.ty, r.tx): r.n for r in cut.groupBy("ty", "tx").agg(F.count("*").alias("n")).collect()} == {(a, b): 9 for a in (0, 1) for b in (0, 1)}


def test_text_helpers(spark):
    row = spark.createDataFrame([("B11 (SWIR1)", 0.005, "2026-04-24T09:12:44Z"), ("plain", 0.8, None)], "n string, x double, t string")
    got = [tuple(r) for r in row.select(text.short_band_name("n"), text.percent("x"), text.display_ts("t", 19), text.conf_color("x")).collect()]
    assert got == [("SWIR1", "1%", "2026-04-24 09:12:44", "#f5f5f5"), ("plain", "80%", None, "#d4d4d4")]


def test_build_vector_table_equals_plain_tf_idf(spark):
    """Counts of hashed words times ln((n + 1) / (df + 1)), of unit length; null parts are empty."""
    from pyspark.ml.feature import HashingTF

    chunks = [(1, "a b", "c C d"), (2, None, "b x"), (3, "q", None), (4, "a b", "b b c")]
    made = {r["id"]: r for r in retrieve.build_vector_table(spark.createDataFrame(chunks, "id long, title string, content string"), 64).collect()}
    hashed = HashingTF(inputCol="words", outputCol="tf", numFeatures=64)
    counts = {}
    for i, title, content in chunks:
        row = counts.setdefault(i, [0] * 64)
        for word in f"{title or ''}. {content or ''}".lower().split():
            row[hashed.indexOf(word)] += 1
    weight = [math.log(5 / (1 + sum(c[k] > 0 for c in counts.values()))) for k in range(64)]
    for i, c in counts.items():
        plain = [a * b for a, b in zip(c, weight)]
        size = math.sqrt(sum(v * v for v in plain))
        assert made[i]["embedding"] == pytest.approx([v / size for v in plain])
        assert made[i]["dim"] == 64


def test_fixed_rounds_as_printf(spark):
    """Ties of the shortest decimal form, which are held as a little less or more, true ties, and any others."""
    from passwatch.functions.text import fixed

    r = random.Random(3)
    values = [0.575, 0.565, 0.125, 0.375, 2.675, 1.005, -0.575, 0.0, 1e15, 123456.785] + [k / 1000 for k in range(5, 1000, 10)] + [r.uniform(-5, 5) for _ in range(200)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", fixed("v", 2).alias("two"), fixed("v", 1).alias("one")).collect()
    assert [(x.two, x.one) for x in rows] == [("%.2f" % x.v, "%.1f" % x.v) for x in rows]
    assert spark.range(1).select(fixed(F.lit(None).cast("double"), 2)).first()[0] == spark.range(1).select(F.format_string("%.2f", F.lit(None).cast("double"))).first()[0]
