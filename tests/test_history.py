"""Counts of the history against the join of all pairs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from passwatch.operators import memory, spatial

SCHEMA = "scene_id string, det_idx int, det_id long, lat double, lon double, ts timestamp"


def clumps(seed):
    """Detections in clumps of very different density, at the equator, in the north, near the pole and at the date line; ties and nulls."""
    r, out, start = random.Random(seed), [], datetime(2024, 1, 1)
    for lat, lon, spread, n in ((0.01, 10, 0.02, 150), (8, 77, 1.5, 250), (-33, 151, 0.4, 60), (69.9, 20, 1.0, 120), (89.8, 5, 0.3, 25), (60, 179.9, 0.2, 30), (8, 77, 0, 70)):
        for _ in range(n):
            scene = f"s{r.randrange(120)}" if r.random() < 0.8 else "one"
            out.append([scene, r.choice([0, 1, 2]), len(out), min(90.0, r.gauss(lat, spread)), max(-180.0, min(180.0, r.gauss(lon, spread))), start + timedelta(minutes=r.randrange(300))])
    for k, column in ((3, 3), (7, 4), (11, 5), (13, 0)):
        out[k][column] = None
    return [tuple(x) for x in out]


def all_pairs(detections, limit, as_of):
    joined = spatial.region_join(spatial.first_points(detections), detections.select("scene_id", "lat", "lon", "ts"), as_of=as_of)
    return {r.q_id: r.n for r in joined.groupBy("q_id").agg(F.least(F.count("*"), F.lit(limit)).cast("int").alias("n")).collect()}


@pytest.mark.parametrize("as_of", [False, True])
@pytest.mark.parametrize("limit", [20, 3, 1])
def test_history_count(spark, as_of, limit):
    for seed in (1,):
        d = spark.createDataFrame(clumps(seed), SCHEMA)
        got = {r.scene_id: r.history_count for r in spatial.history_count(d, limit=limit, as_of=as_of).collect()}
        want = all_pairs(d, limit, as_of)
        assert got == want
        assert limit in want.values() and (limit < 20 or len(set(want.values())) > 5)


def test_no_detections(spark):
    assert spatial.history_count(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_of_a_dense_place(spark):
    """40,000 detections of one place: all pairs would be 1.6 billion rows."""
    rows = spark.range(40_000).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("scene_id"), F.lit(0).alias("det_idx"), F.col("id").alias("det_id"), (8 + F.col("id") % 7 / 1000).alias("lat"), (77 + F.col("id") % 11 / 1000).alias("lon"), F.timestamp_seconds(F.col("id")).alias("ts"))
    got = spatial.history_count(rows, as_of=True).groupBy("history_count").count().collect()
    assert {r.history_count: r["count"] for r in got} == {**{k: 1 for k in range(1, 20)}, 20: 40_000 - 20}


def asked_of(detections):
    return spatial.first_points(detections).drop("q_ts")


def dated(rows):
    return rows.withColumn("timestamp_utc", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))


@pytest.mark.parametrize("limit", [20, 2])
def test_newest_near(spark, limit):
    """The lists and the totals against the join of all pairs: clumps, a scene that is everywhere, ties and nulls."""
    d = dated(spark.createDataFrame(clumps(2), SCHEMA)).select("scene_id", "det_idx", "det_id", "lat", "lon", "ts", "timestamp_utc").localCheckpoint()
    held, q = d.select("scene_id", "det_id", "lat", "lon", "timestamp_utc"), asked_of(d).withColumn("q_id", F.concat("q_id", F.lit("@"), F.coalesce(F.col("q_lat"), F.lit(0.0)).cast("string"), F.coalesce(F.col("q_lon"), F.lit(0.0)).cast("string")))
    q = q.dropDuplicates(["q_id"]).localCheckpoint()
    rows = lambda df: sorted((r.q_id, r.pass_number, r.det_id) for r in df.collect())
    joined = spatial.region_join(q, held).localCheckpoint()
    assert rows(spatial.newest_near(q, held, limit=limit)) == rows(spatial.newest(joined, limit))
    totals = {r.q_id: (r.n, round(r.km, 6)) for r in spatial.near_totals(q, held).collect()}
    assert totals == {r.q_id: (r.n, round(r.km, 6)) for r in joined.groupBy("q_id").agg(F.count("*").alias("n"), F.sum("distance_km").alias("km")).collect()}
    everyone = spatial.region_join(q, held, exclude_self=False).groupBy("q_id").agg(F.count("*").alias("n"))
    assert {r.q_id: r.n for r in spatial.near_totals(q, held, exclude_self=False).collect()} == {r.q_id: r.n for r in everyone.collect()}
    y, x = spatial.half_box(F.col("q_lat"), 50.0)
    box = q.crossJoin(held).where((F.col("scene_id") != F.col("q_scene")) & F.col("lat").between(F.col("q_lat") - y, F.col("q_lat") + y) & F.col("lon").between(F.col("q_lon") - x, F.col("q_lon") + x))
    assert rows(spatial.overfetched_near(q, held, limit)) == rows(spatial.overfetched(box, limit))


def test_lists_of_a_dense_place(spark):
    """The newest hits and the totals of 40,000 queries around which all 40,000 detections lie: the join had 1.6 billion rows."""
    rows = spark.range(40_000).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("scene_id"), F.lit(0).alias("det_idx"), F.col("id").alias("det_id"), (8 + F.col("id") % 7 / 1000).alias("lat"), (77 + F.col("id") % 11 / 1000).alias("lon"), F.timestamp_seconds(F.col("id")).alias("ts"))
    rows = dated(rows)
    hits = spatial.newest_near(asked_of(rows), rows.select("scene_id", "det_id", "lat", "lon", "timestamp_utc"))
    by = hits.groupBy("q_id").agg(F.count("*").alias("n"), F.min("det_id").alias("least"), F.max("pass_number").alias("last"))
    assert [tuple(r) for r in by.groupBy("n", "last").agg(F.count("*"), F.min("least"), F.max("least")).collect()] == [(20, 19, 40_000, 39_979, 39_980)]
    assert spatial.near_totals(asked_of(rows), rows).groupBy("n").count().collect() == [(39_999, 40_000)]


@pytest.mark.parametrize("limit", [20, 2])
def test_shared_texts(spark, limit):
    """A text for each place and not for each hit: the same as from the rows of hits, also for scenes among a place's newest, alone there, or everywhere, and without type or time."""
    d = dated(spark.createDataFrame(clumps(3), SCHEMA)).withColumn("type", F.element_at(F.array(*map(F.lit, ("ship", "harbor", "airplane")), F.lit(None)), (F.col("det_id") % 4 + 1).cast("int")))
    d = d.withColumns({"conf": F.when(F.col("det_id") % 9 > 0, F.col("det_id") % 100 / 100), "timestamp_utc": F.when(F.col("det_id") % 7 > 0, F.col("timestamp_utc"))}).localCheckpoint()
    held = d.select("scene_id", "det_id", "type", "lat", "lon", "conf", "timestamp_utc")
    q = d.select(F.col("det_id").alias("q_id"), F.col("scene_id").alias("q_scene"), F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon"), "det_idx").localCheckpoint()
    want = memory.history_text(spatial.newest_near(q, held, limit=limit).withColumn("alert_level", F.lit(None).cast("string")))
    got = memory.shared_texts(q, held, limit=limit)
    assert got.columns == [*q.columns, "text"]
    texts = {r.q_id: r.text for r in got.collect()}
    assert texts == {r.q_id: r.text for r in want.collect()}
    assert any("Recurring" in x for x in texts.values()) and len(texts) > 600 and len(set(texts.values())) > 50


def test_texts_of_a_dense_place(spark):
    """The texts of 40,000 queries of 77 places: no row is made for a query and a hit (there were 800,000)."""
    rows = dated(spark.range(40_000).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("scene_id"), F.col("id").alias("det_id"), F.lit("ship").alias("type"), (8 + F.col("id") % 7 / 1000).alias("lat"), (77 + F.col("id") % 11 / 1000).alias("lon"), F.lit(0.5).alias("conf"), F.timestamp_seconds(F.col("id")).alias("ts")))
    texts = memory.shared_texts(rows.select(F.col("scene_id").alias("q_scene"), F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon")), rows.drop("ts"))
    assert "posexplode" not in texts._jdf.queryExecution().optimizedPlan().toString()
    by = texts.groupBy("q_lat", "q_lon", "text").count()
    assert [tuple(r) for r in by.agg(F.sum("count"), F.count("*"), F.count_distinct("q_lat", "q_lon")).collect()] == [(40_000, 77 + 5, 77)]  # five lines are told
