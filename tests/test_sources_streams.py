"""Files and streams."""

import json

import numpy as np
from pyspark.sql import functions as F

from passwatch.operators import detect, memory, raster, reports
from passwatch.plans import mission
from passwatch.sources import briefs, tiles, versioned
from passwatch.streaming import stream


def doc(name: str, n: int = 1, ts: str = "2026-04-24T09:12:44Z", lat: float = 8.4) -> str:
    found = [{"type": "ship", "lat_lon": [lat, 77.8], "conf": 0.87, "bbox_px": [1, 2, 3, 4]}] * n
    return json.dumps({"scene_id": name, "timestamp_utc": ts, "tile_footprint": {"lat_min": 8, "lat_max": 9, "lon_min": 77, "lon_max": 78}, "cloud_cover": 0.1, "anomaly_count": n, "anomalies": found, "meta": {"model_version": "m", "inference_ms": 1.0, "compression_ratio": 5}})


def test_read_briefs(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.json").write_text(doc(f"s{k}", k))
    (tmp_path / "bad.json").write_text("not json")
    (tmp_path / "note.txt").write_text("x")
    good, bad = briefs.read_briefs(spark, str(tmp_path))
    assert sorted(r.scene_id for r in good.collect()) == ["s0", "s1", "s2"]
    assert [r.source_file.rsplit("/", 1)[1] for r in bad.collect()] == ["bad.json"]


def test_briefs_over_several_lines(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps(json.loads(doc("s1", 2)), indent=2))
    (tmp_path / "2.json").write_text(doc("s2"))
    (tmp_path / "3.json").write_text("{ broken")
    good, bad = briefs.read_briefs(spark, str(tmp_path), multi_line=True)
    assert sorted((r.scene_id, len(r.anomalies)) for r in good.collect()) == [("s1", 2), ("s2", 1)]
    assert [r.source_file.rsplit("/", 1)[1] for r in bad.collect()] == ["3.json"]
    rows = stream.stream_briefs(spark, str(tmp_path), multi_line=True).select("scene_id")
    rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.scene_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["s1", "s2"]


def test_labels_and_tiles(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 0.5 0.5 0.1 0.1\n1 2 3\nx y z v w\n\n3 0.1 0.2 0.3 0.4\n")
    (tmp_path / "b.txt").write_text("")
    assert sorted((r.stem, r.cls) for r in tiles.scan_labels(spark, str(tmp_path)).collect()) == [("a", 0), ("a", 3)]
    for k in (2, 0, 1):
        (tmp_path / f"t{k}.npy").write_bytes(b"x")
    assert [r.scene_id for r in tiles.scan_tiles(spark, str(tmp_path), 2).collect()] == ["t0", "t1"]


def test_array_files(spark, tmp_path):
    """Tiles of several sizes and types go through files; what isn't a tile is named, with the reason."""
    r = np.random.default_rng(1)
    made = {f"t{k}": r.random((h, w, 6)).astype(np.float32) for k, (h, w) in enumerate([(8, 8), (3, 5), (1, 1), (0, 4)])}
    rows = spark.createDataFrame([(k, t.shape[0], t.shape[1], t.tobytes()) for k, t in made.items()], "scene_id string, h int, w int, bands binary")
    folder = f"file://{tmp_path}/tiles"
    assert {r.scene_id for r in tiles.write_npy(rows, folder).collect()} == set(made)
    np.save(tmp_path / "tiles" / "ints.npy", np.arange(24).reshape(2, 2, 6))
    for name, body in (("flat", np.zeros((4, 6))), ("seven", np.zeros((2, 2, 7))), ("text", np.full((1, 1, 6), "x"))):
        np.save(tmp_path / "tiles" / f"{name}.npy", body)
    (tmp_path / "tiles" / "empty.npy").write_bytes(b"")
    (tmp_path / "tiles" / "cut.npy").write_bytes((tmp_path / "tiles" / "t0.npy").read_bytes()[:200])
    np.save(tmp_path / "tiles" / "pickle.npy", np.array([{"a": 1}], object), allow_pickle=True)
    good, bad = tiles.decode_tiles(tiles.scan_tiles(spark, folder))
    got = {r.scene_id: r for r in good.collect()}
    assert set(got) == {*made, "ints"}
    for k, t in made.items():
        assert (np.frombuffer(got[k].bands, np.float32).reshape(got[k].h, got[k].w, 6) == t).all()
        assert got[k].cloud_cover == (float((t[:, :, 1] > 0.8).mean()) if t.size else 0.0) and got[k].raw_bytes == t.nbytes
    assert {r.path.rsplit("/", 1)[1][:-4] for r in bad.collect()} == {"flat", "seven", "text", "cut", "pickle"}  # Spark reads no row from an empty file


def test_detections_of_tiles(spark):
    """Every box of a random detector, against the operators one by one."""
    load = lambda: lambda tensor: np.random.default_rng(int(tensor.sum() * 1000)).random((1, 8, 60), np.float32) * np.array([30, 30, 9, 9, 1, 1, 1, 1], np.float32)[None, :, None]
    r = np.random.default_rng(3)
    rows = spark.createDataFrame([(f"t{k}", 4, 4, r.random((4, 4, 6)).astype(np.float32).tobytes(), k) for k in range(5)], "scene_id string, h int, w int, bands binary, extra int")
    found = raster.detect_tiles(rows, load)
    got = {(x.scene_id, d.type, round(d.conf, 6), d.x1, d.y1, d.x2, d.y2) for x in found.collect() for d in x.found}
    boxes = detect.bbox_trunc(detect.xywh_to_xyxy(detect.best_class(raster.score_tiles(rows, load)))).withColumn("det_id", F.col("anchor").cast("long"))
    kept = boxes.join(detect.nms_kernel(boxes), ["scene_id", "det_id"])
    assert got == {(x.scene_id, x.type, round(x.conf, 6), x.x1, x.y1, x.x2, x.y2) for x in kept.collect()} and len(got) > 20
    assert {x.extra for x in found.collect()} == set(range(5))
    footprints = spark.createDataFrame([("t1", 10.0, 11.0, 70.0, 71.0)], "scene_id string, lat_min double, lat_max double, lon_min double, lon_max double")
    made = mission.tile_batch(rows.withColumns({"cloud_cover": F.lit(0.25), "raw_bytes": F.lit(10**6).cast("long")}), footprints, load, F.lit("2026-01-01T00:00:00Z"), clock=lambda: 1.0).collect()
    assert {x.scene_id: (x.anomaly_count, x.tile_footprint.lat_min) for x in made} == {f"t{k}": (sum(g[0] == f"t{k}" for g in got), 10.0 if k == 1 else 8.0) for k in range(5)}
    zero = reports.brief_json(spark.createDataFrame(made).withColumn("meta", F.col("meta").withField("compression_ratio", F.lit(0))))
    assert {x.scene_id: 10**6 // len(x.json) for x in zero.collect()} == {x.scene_id: x.meta.compression_ratio for x in made}


def test_remember_and_save(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "d1"), ("b", 2, "d1"), ("c", 3, "d2")], "scene_id string, v int, date string")
    path = str(tmp_path / "t")
    memory.save(rows, path)
    memory.save(spark.createDataFrame([("z", 9, "d2")], rows.schema), path)
    assert sorted(r.scene_id for r in spark.read.parquet(path).collect()) == ["a", "b", "z"]
    new = spark.createDataFrame([("a", 7, "d1"), ("q", 8, "d3")], rows.schema)
    assert sorted((r.scene_id, r.v) for r in memory.scene_replace(rows, new).collect()) == [("a", 7), ("b", 2), ("c", 3), ("q", 8)]


def test_remembering_keeps_every_scene(spark, tmp_path):
    """Two batches of one date keep both scenes; a scene that comes again moves its date, also off a date that it leaves empty."""
    path = f"file://{tmp_path}/scenes"
    each = stream.remembering(path, writer="one")

    def batch(*rows):
        return spark.createDataFrame(rows, "scene_id string, ts string, v int").withColumn("ts", F.to_timestamp("ts"))

    def stored():
        return sorted((r.scene_id, str(r.date), r.v) for r in versioned.read(spark, path, "scenes").collect())

    each(batch(("a", "2026-01-01 05:00:00", 1), ("m", "2026-01-07 05:00:00", 5)), 0)
    each(batch(("b", "2026-01-01 06:00:00", 2)), 1)
    assert stored() == [("a", "2026-01-01", 1), ("b", "2026-01-01", 2), ("m", "2026-01-07", 5)]
    again = batch(("a", "2026-01-02 05:00:00", 4), ("a", "2026-01-02 03:00:00", 3), ("m", "2026-01-01 09:00:00", 6))
    for _ in range(2):  # a batch that is run twice changes nothing
        each(again, 2)
        assert stored() == [("a", "2026-01-02", 4), ("b", "2026-01-01", 2), ("m", "2026-01-01", 6)]


def test_streams(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    (folder / "1.json").write_text(doc("a") + "\n" + doc("b", 3, "2026-04-24T10:12:44Z") + "\nbroken")
    (folder / "2.json").write_text(doc("a", 2, "2026-04-24T09:30:00Z"))
    rows = stream.stream_dedupe(stream.stream_briefs(spark, str(folder)))
    rows.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.scene_id for r in spark.read.parquet(str(out)).collect()) == ["a", "b"]


def test_windows_and_sessions(spark):
    rows = spark.createDataFrame([("c", "2026-01-01 00:00:10", 0.5), ("c", "2026-01-01 00:30:00", 0.9), ("c", "2026-01-01 09:00:00", 0.1)], "cell string, ts string, conf double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.n for r in stream.pass_windows(rows, key="cell").collect()) == [1, 2]
    assert sorted(r.n for r in stream.sessions(rows).collect()) == [1, 2]
