"""The mission log makes its parts once, and requests in one pass equal those of the separate steps."""

import random

import pytest
from pyspark.sql import functions as F

from passwatch.adapters import Model
from passwatch.operators import policy
from passwatch.plans import mission
from passwatch.queries import QUERIES
from tests.oracle import SF

TRIGGERED = "scene_id string, det_idx int, type string, lat double, lon double, conf double, trigger boolean, reason string, priority int"
ADVISORIES = "scene_id string, ovv_trigger boolean, ovv_lat double, ovv_lon double, ovv_priority int, ovv_reason string"


def test_parts_are_made_once(spark):
    """Decisions, requests and counts stood in the log's plan several times (each for every use of a part)."""
    m = Model(spark, SF)
    made = mission.mission_logs(m.scenes, m.detections, m.zones, m.advisories, m.footprints)
    plan = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
    orders = [line for line in plan if "Relation" in line and "o_orderkey" in line]
    assert len(orders) == 4  # scenes, advisories for decisions and for requests, footprints


def test_accepted_requests_equal_the_separate_steps(spark):
    """Several detections and several advisory requests of a place, requests without one, and scenes without an id."""
    r = random.Random(5)
    scene = lambda: r.choice(["a", "b", "c", None])
    place = lambda: r.choice([8.0, 8.001, 8.01, 8.014, 0.001, -0.001, 8.02])
    found = [(scene(), i, r.choice(["ship", None]), place(), place(), r.random(), r.random() < 0.5, f"r{i}", r.randrange(1, 4)) for i in range(60)]
    asked = [(r.choice(["a", "b", "c", "d", None]), r.random() < 0.8, place(), r.choice([place(), None]), r.choice([1, None]), r.choice([f"x{i}", None])) for i in range(60)]
    triggered, advisories = spark.createDataFrame(found, TRIGGERED), spark.createDataFrame(asked, ADVISORIES)
    p = policy.ovv_dedupe(triggered)
    plain = policy.ovv_union(p, policy.advisory_ovv_anti(advisories, p))
    got = policy.ovv_accepted(triggered, advisories)
    assert got.columns == plain.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    assert plain.groupBy("source").count().count() == 2


def test_log_of_odd_scenes(spark):
    """No detections, no advisory, no footprint, a missing confidence and type, and a scene without an id."""
    scenes = spark.createDataFrame([("a", "t1", 0.5, 12.5, 1234), ("b", "t2", None, None, None), (None, "t3", 0.1, 1.0, 1)], "scene_id string, timestamp_utc string, cloud_cover double, inference_ms double, compression_ratio bigint")
    found = [("a", i, i, t, 8.0 + i, 72.0, c, "t") for i, t, c in ((0, "ship", 0.9), (1, None, 0.5), (2, "ship", None), (3, "harbor", 0.575))]
    detections = spark.createDataFrame(found, "scene_id string, det_idx int, det_id bigint, type string, lat double, lon double, conf double, ts string")
    zones = spark.createDataFrame([(0, "Z", 8.0, 8.5, 71.0, 73.0)], "zone_order int, zone string, lat_min double, lat_max double, lon_min double, lon_max double")
    advisories = spark.createDataFrame([("a", "RED", "told", True, 8.0, 72.0, 1, "seen")], "scene_id string, alert_level string, summary string, ovv_trigger boolean, ovv_lat double, ovv_lon double, ovv_priority int, ovv_reason string")
    footprints = spark.createDataFrame([("x", 8.0, 9.0, 72.0, 73.0)], "scene_id string, lat_min double, lat_max double, lon_min double, lon_max double")
    logs = {r.scene_id: r.log.splitlines() for r in mission.mission_logs(scenes, detections, zones, advisories, footprints).collect()}
    assert set(logs) == {"a", "b"}
    assert "  Narrative: 2 ships, 1 unknown, 1 harbor detected at (0.000°N, 0.000°E) under 50% cloud cover — IMMEDIATE ATTENTION REQUIRED." in logs["a"]
    assert [x for x in logs["a"] if " @ " in x] == ["  SHIP @ (8.0000°, 72.0000°) | conf=90% | risk=MEDIUM", "  HARBOR @ (11.0000°, 72.0000°) | conf=57% | risk=LOW"]
    assert [x for x in logs["a"] if "Priority" in x] == ["  [OVV-001] Priority 1 | (8.0000°, 72.0000°) | Source: POLICY"]
    assert "  Detections    : 4" in logs["a"] and "  Inference     : 12ms on-board" in logs["a"] and "  Compression   : 1,234:1" in logs["a"]
    assert logs["b"][-5:] == ["", "  ACTIONS TAKEN", "─" * 60, "  • No action required — monitoring continued.", "═" * 60]
    assert "  OVV SCHEDULE: None required" in logs["b"] and "  Narrative: No anomalies detected in scene b." in logs["b"]


def test_search_vectors_and_hits_do_not_go_to_scenes(spark):
    """Every scene carried its search vector through joins and a sort, and every region had a row for each of its hits."""
    plan = QUERIES["analyst_context"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [x for x in plan if "posexplode(" in x]
    assert not [x for x in plan if "q_embedding" in x and ("Aggregate" in x or "Join" in x and "LeftSemi" not in x)]


@pytest.mark.parametrize(("searches_most", "bytes_most", "sent"), [(9, 1 << 20, 2), (9, 0, 1), (0, 1 << 20, 0)])
def test_context_of_odd_scenes(spark, monkeypatch, searches_most, bytes_most, sent):
    """Contexts sent to the scenes, hits alone sent to the chunks (which were all dealt out), and nothing sent: a shared search, none, one without a vector, one of a vector that has no product, a scene without an id, and one that comes twice."""
    briefs = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), ("d", "D"), (None, "N"), ("e", "E1"), ("e", "E2")], "scene_id string, json string")
    searches = spark.createDataFrame([("a", 1), ("b", 1), ("d", 9), ("e", 3), (None, 1)], "scene_id string, q_id long")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None)], "id long, embedding array<double>")
    chunks = spark.createDataFrame([(1, "s", "one", "first"), (2, "s", "two", "second")], "id long, category string, title string, content string")
    found = [("a", 0, 0, "ship", 8.0, 72.0), ("a", 1, 1, "ship", 8.02, 72.0), ("a", 2, 2, "harbor", 8.8, 72.0), ("a", 3, 3, "harbor", 20.0, 72.0), ("e", 0, 4, "ship", 8.4, 72.0)]
    detections = spark.createDataFrame([(*x, 0.5, "2024-01-01T00:00:00Z") for x in found], "scene_id string, det_idx int, det_id long, type string, lat double, lon double, conf double, timestamp_utc string")
    monkeypatch.setattr(mission, "SHARED_SEARCHES", searches_most)
    monkeypatch.setattr(mission, "SHARED_BYTES", bytes_most)
    queries = vectors.select(vectors.id.alias("q_id"), vectors.embedding.alias("q_embedding"))
    made = mission.analyst_context(briefs, searches, detections, vectors, chunks, queries, k=1)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == sent
    got = sorted((str(r.scene_id), r.message) for r in made.collect())
    text = dict(got)
    assert [s for s, _ in got] == ["None", "a", "b", "c", "d", "e", "e"]
    assert "[1] one\nfirst" in text["a"] and "[1] one\nfirst" in text["b"] and "second" not in text["a"]
    assert all("RETRIEVED" not in text[s] for s in ("None", "c", "d", "e"))
    assert text["a"].count("Regional history") == 2 and text["a"].index("(8.000°, 72.000°)): 1 ") < text["a"].index("(8.800°, 72.000°)): 1 ")
    assert all("3 anomaly detection(s) across 1 orbital pass(es)" in m for s, m in got if s == "e")
    assert all("HISTORICAL" not in text[s] for s in ("None", "b", "c", "d"))
