"""Streams: state that ends, replayed batches, restarts, late rows."""

import json
import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from passwatch.operators import spatial
from passwatch.queries.streams import rocks
from passwatch.sources import versioned
from passwatch.streaming import stream

START = datetime(2026, 4, 24, 9, 0, tzinfo=timezone.utc)


def brief(name, minutes, places=((8.4, 77.8),), conf=0.5, cloud=0.1):
    found = [{"type": "ship", "lat_lon": list(p), "conf": conf, "bbox_px": [1, 2, 3, 4]} for p in places]
    at = (START + timedelta(minutes=minutes)).strftime("%Y-%m-%dT%H:%M:%SZ")
    return json.dumps({"scene_id": name, "timestamp_utc": at, "tile_footprint": None, "cloud_cover": cloud, "anomaly_count": len(found), "anomalies": found, "meta": None})


def put(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(lines))
    os.utime(folder / f"{name}.json", (1.7e9 + int(name), 1.7e9 + int(name)))  # a stream takes files in the order of their times


def zones(spark):
    return spark.createDataFrame([(0, "Palk", 8.0, 10.0, 79.0, 80.0)], "zone_order int, zone string, lat_min double, lat_max double, lon_min double, lon_max double")


def decisions(spark, store):
    return {r.scene_id: (r.history_count, r.policy_alert, r.n_requests, r.batch) for r in versioned.read(spark, store, "decisions").collect()}


def test_alerts_by_the_stored_history(spark, tmp_path):
    """Three scenes of one place, one elsewhere; a scene that comes again; replays and a restart change nothing."""
    folder, store, check = tmp_path / "in", f"file://{tmp_path}/store", f"file://{tmp_path}/check"
    far = ((-40.0, 10.0),)
    put(folder, "1", brief("a", 0, conf=0.3), brief("far", 0, far, conf=0.3))
    run = lambda: stream.stream_alerts(stream.stream_briefs(spark, str(folder), 1), zones(spark), store, check).awaitTermination()
    run()
    assert decisions(spark, store) == {"a": (0, "GREEN", 0, 0), "far": (0, "GREEN", 0, 0)}
    put(folder, "2", brief("b", 5, ((8.41, 77.81), (8.5, 77.9), (8.6, 77.6)), conf=0.3), brief("b", 4, conf=0.9), "broken")
    run()
    put(folder, "3", brief("c", 9, conf=0.3), brief("none", 9, (), cloud=0.9))
    run()
    got = decisions(spark, store)
    assert got["b"] == (1, "RED", 0, 1)  # three detections; the newest brief of the batch
    assert got["c"] == (4, "RED", 1, 2) and got["none"] == (0, "GREEN", 0, 2)
    put(folder, "4", brief("a", 20, far, conf=0.3))
    run()
    assert decisions(spark, store)["a"] == (1, "GREEN", 0, 3)  # far; its own earlier detection has gone
    places = {(r.scene_id, r.lat) for r in versioned.read(spark, store, "detections").collect()}
    assert places == {("a", -40.0), ("far", -40.0), ("b", 8.41), ("b", 8.5), ("b", 8.6), ("c", 8.4)}

    version = versioned.manifest(spark, store)["version"]
    name = stream.query_id(spark, check)
    batch = spark.read.schema(stream.SCHEMA).json(str(folder / "3.json")).drop("_corrupt_record").withColumn("ts", F.to_timestamp("timestamp_utc"))
    assert stream.decide_batch(batch, 2, zones(spark), store, name) == version
    assert versioned.manifest(spark, store)["version"] == version
    assert stream.decide_batch(batch, 0, zones(spark), store, "another stream") == version + 1  # same number, another stream
    assert decisions(spark, store)["c"] == (3, "RED", 1, 0)


def test_a_crash_amid_a_batch(spark, tmp_path, monkeypatch):
    folder, store, check = tmp_path / "in", f"file://{tmp_path}/store", f"file://{tmp_path}/check"
    put(folder, "1", brief("a", 0))
    start = lambda: stream.stream_alerts(stream.stream_briefs(spark, str(folder), 1), zones(spark), store, check)
    commit = versioned.commit
    monkeypatch.setattr(versioned, "commit", lambda *a: 1 / 0)
    with pytest.raises(Exception, match="division"):
        start().awaitTermination()
    assert versioned.manifest(spark, store)["version"] == 0

    def late(*a):
        commit(*a)
        raise RuntimeError("after the manifest")

    monkeypatch.setattr(versioned, "commit", late)
    with pytest.raises(Exception, match="after the manifest"):
        start().awaitTermination()
    monkeypatch.setattr(versioned, "commit", commit)
    start().awaitTermination()
    assert versioned.manifest(spark, store)["version"] == 1
    assert set(decisions(spark, store)) == {"a"}


def test_a_batch_is_decided_once(spark, tmp_path):
    """The store looks at decisions and requests several times; what they read is read once for each of the two."""
    seen = spark.sparkContext.accumulator(0)

    def looked_at(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    kinds = "scene_id string, alert_level string, summary string, ovv_trigger boolean, ovv_lat double, ovv_lon double, ovv_priority int, ovv_reason string"
    advisories = spark.createDataFrame([("a", "ORANGE", "s", True, 8.4, 77.8, 2, "r")], kinds).mapInPandas(looked_at, kinds)
    put(tmp_path / "in", "1", brief("a", 0, conf=0.3), brief("b", 1, conf=0.9))
    batch = spark.read.schema(stream.SCHEMA).json(f"{tmp_path}/in").drop("_corrupt_record").withColumn("ts", F.to_timestamp("timestamp_utc"))
    store = f"file://{tmp_path}/store"
    stream.decide_batch(batch, 0, zones(spark), store, "w", advisories)
    assert set(decisions(spark, store)) == {"a", "b"} and [r.scene_id for r in versioned.read(spark, store, "requests").where("source = 'llm'").collect()] == ["a"]
    assert 0 < seen.value <= 2


def test_history_of_the_blocks_in_reach(spark, tmp_path):
    """Pruned reading finds every neighbour, over the edges of blocks."""
    store = f"file://{tmp_path}/store"
    places = [(8.01, 75.99), (7.99, 76.01), (8.3, 76.3), (11.99, 80.01), (60.0, 10.0)]
    rows = spark.createDataFrame([(f"s{i}", i, lat, lon) for i, (lat, lon) in enumerate(places)], "scene_id string, det_id int, lat double, lon double").withColumns({"ts": F.lit(START), "block": stream.block(F.col("lat"), F.col("lon"))})
    versioned.apply(spark, store, {"detections": versioned.Change(rows, partition="block")}, "w", 0)
    q = spark.createDataFrame([("q", "q", 8.0, 76.0)], "q_id string, q_scene string, q_lat double, q_lon double").withColumn("q_ts", F.lit(START))
    near = stream.history_near(spark, store, 1, q)
    assert near.count() == 3
    assert [r.n for r in spatial.capped_count(q, near).collect()] == [3]


def run(rows, out, check, mode="append"):
    if mode == "append":
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return rows.sparkSession.read.schema(rows.schema).parquet(out)
    made = []
    query = rows.writeStream.outputMode(mode).foreachBatch(lambda b, k: made.extend((k, *r) for r in b.collect())).option("checkpointLocation", check).trigger(availableNow=True).start()
    query.awaitTermination()
    return made, [s for p in query.recentProgress for s in p["stateOperators"]]


def points(spark, folder):
    rows = spark.readStream.schema("cell string, minute long").option("maxFilesPerTrigger", 1).json(str(folder))
    return rows.withColumn("ts", F.timestamp_seconds(F.lit(int(START.timestamp())) + F.col("minute") * 60))


def at(*minutes, cell="c"):
    return [json.dumps({"cell": cell, "minute": m}) for m in minutes]


def test_recurrence_ends_and_begins_anew(spark, tmp_path):
    """A quiet cell is closed by the watermark; the stream goes on from its checkpoint; rows behind the watermark go."""
    folder, check = tmp_path / "in", str(tmp_path / "check")
    with rocks(spark):
        go = lambda: [r[1:] for r in run(stream.stream_recurrence(points(spark, folder), "10 minutes", 3600), "", check, "update")[0]]
        put(folder, "1", *at(0, 5, 3))
        assert go() == [("c", 3, 3, True, False)]
        put(folder, "2", *at(50))
        assert go() == [("c", 1, 4, True, False)]
        put(folder, "3", *at(200, cell="other"))
        assert sorted(go()) == [("c", 0, 4, True, True), ("other", 1, 1, False, False)]
        put(folder, "4", *at(60), *at(210, 400))  # the first is behind the watermark; the last comes an expiry later
        assert sorted(go())[:2] == [("c", 1, 1, False, False), ("c", 1, 1, False, True)]


def test_latest_wins_and_is_forgotten(spark, tmp_path):
    folder, check = tmp_path / "in", str(tmp_path / "check")
    with rocks(spark):
        def go():
            made, state = run(stream.stream_latest(stream.stream_briefs(spark, str(folder), 1), "10 minutes", 3600).select("scene_id", "cloud_cover", F.size("anomalies")), "", check, "update")
            return sorted(r[1:] for r in made), state[-1]["numRowsTotal"]

        put(folder, "1", brief("a", 10, cloud=0.1), brief("a", 20, cloud=0.2), brief("b", 10, cloud=0.3))
        assert go() == ([("a", 0.2, 1), ("b", 0.3, 1)], 2)
        put(folder, "2", brief("a", 15, cloud=0.9), brief("b", 30, (), cloud=0.4))
        assert go()[0] == [("b", 0.4, 0)]  # an older version changes nothing
        put(folder, "3", brief("z", 500, cloud=0.5))
        assert go() == ([("z", 0.5, 1)], 1)  # the others are forgotten


def test_latest_of_scenes_that_share_a_bucket(spark, tmp_path):
    """Random briefs of many scenes against a plain model; the state has a row for a bucket, and each scene is forgotten at its own time."""
    folder, check, r = tmp_path / "in", str(tmp_path / "check"), random.Random(4)
    newest, want = {}, []
    with rocks(spark):
        for k in range(3):
            rows = [(f"s{r.randrange(30)}", r.randrange(20 * k, 20 * k + 40), round(r.random(), 6)) for _ in range(50)]
            put(folder, str(k + 1), *[brief(name, m, cloud=c) for name, m, c in rows])
            batch = {}
            for name, m, c in rows:
                text = f"{c}"
                batch[name] = max(batch.get(name, (m, text)), (m, text))
            for name, (m, text) in batch.items():
                if m >= newest.get(name, -1):
                    newest[name] = m
                    want.append((k, name, float(text)))
        put(folder, "4", brief("late", 145, cloud=0.5))  # the watermark goes to minute 135: scenes of minute 75 or before are forgotten
        made, state = run(stream.stream_latest(stream.stream_briefs(spark, str(folder), 1), "10 minutes", 3600, buckets=2).select("scene_id", "cloud_cover"), "", check, "update")
        assert sorted(x for x in made if x[1] != "late") == sorted(want)
        assert max(s["numRowsTotal"] for s in state) <= 2
        put(folder, "5", brief("s0", 200, cloud=0.25), brief("s1", 136, cloud=0.75))
        put(folder, "6", brief("s0", 195, cloud=0.5))
        again, _ = run(stream.stream_latest(stream.stream_briefs(spark, str(folder), 1), "10 minutes", 3600, buckets=2).select("scene_id", "cloud_cover"), "", check, "update")
        assert sorted(x[1:] for x in again) == [("s0", 0.25), ("s1", 0.75)]


def test_windows_and_sessions_merge_over_batches(spark, tmp_path):
    folder = tmp_path / "in"
    put(folder, "1", *at(0, 8, 5))
    put(folder, "2", *at(14, 16), *at(15, cell="d"))
    put(folder, "3", *at(300))
    put(folder, "4", *at(301))
    put(folder, "5", *at(20, 302))  # 20 is late: Spark judges by the watermark before the last batch
    put(folder, "6", *at(9000))
    rows = points(spark, folder).withWatermark("ts", "5 minutes")
    got = run(stream.sessions(rows, "10 minutes"), str(tmp_path / "o1"), str(tmp_path / "c1"))
    assert sorted((r.cell, r.n) for r in got.collect()) == [("c", 3), ("c", 5), ("d", 1)]
    got = run(stream.pass_windows(rows.withColumn("conf", F.lit(0.5)).withColumnRenamed("cell", "zone"), "10 minutes"), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert sorted((r.zone, r.n) for r in got.collect()) == [("c", 2), ("c", 3), ("c", 3), ("d", 1)]
    late = stream.late_rows(spark.read.json(str(folder)).where("minute < 9000"), got)
    assert [(r.zone, r.n) for r in late.collect()] == [("(late)", 1)]
