"""Queries of the streaming operators: briefs arrive as files and run through a stream to its end."""

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from passwatch.operators import policy, reports
from passwatch.queries import query
from passwatch.queries.decisions import ALERTS, DEDUPED, FEATURES, TRIGGERED, ZONED
from passwatch.queries.detections import briefs
from passwatch.queries.history import NEAR
from passwatch.queries.sources import place, renamed
from passwatch.sources import versioned
from passwatch.streaming import stream

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTS = 4  # batches of the streams whose order of arrival matters
FILES = 2  # files of each


def arrived(m) -> str:
    """All briefs as JSON files in the shared folder."""
    folder = place(m.spark)
    reports.brief_json(briefs(m)).select("scene_id", "json").repartition(4, "scene_id").select(F.col("json").alias("value")).write.option("compression", "none").text(folder)
    return renamed(m, folder)


def in_turn(m, rows, part) -> str:
    """rows (value) as files of one folder that came one part (0 to PARTS - 1) after another."""
    spark, folder = m.spark, place(m.spark)
    where = spark._jvm.org.apache.hadoop.fs.Path
    store = where(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(where(folder))
    for k in range(PARTS):
        rows.where(part == k).select("value").repartition(FILES).write.option("compression", "none").text(f"{folder}-{k}")
        for status in store.listStatus(where(f"{folder}-{k}")):
            name = status.getPath().getName()
            if name.endswith(".txt"):
                store.rename(status.getPath(), where(folder, f"{k}-{name[:-4]}.json"))
    return folder


@contextmanager
def rocks(spark):
    """The RocksDB state store for the streams within; afterwards the session is as it was."""
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, old)


def ran(m, rows, mode: str = "append"):
    """Run a stream to its end into a table of the shared folder, and read that."""
    spark, name = m.spark, place(m.spark)
    if mode == "append":
        rows.writeStream.format("parquet").option("path", name).option("checkpointLocation", name + "-state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(rows.schema).parquet(name)

    def each(batch, number):
        batch.write.mode("overwrite").parquet(f"{name}/part={number}")

    rows.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", name + "-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("basePath", name).parquet(name)


@query("SELECT scene_id, cloud_cover, anomaly_count FROM scenes")
def stream_briefs(m):
    return ran(m, stream.stream_briefs(m.spark, arrived(m)).select("scene_id", "cloud_cover", "anomaly_count"))


@query("SELECT scene_id FROM scenes")
def stream_dedupe(m):
    """The same files twice: each scene comes out once."""
    folder = arrived(m)
    twice = stream.stream_briefs(m.spark, folder).unionByName(stream.stream_briefs(m.spark, folder))
    return ran(m, stream.stream_dedupe(twice, "40000 days").select("scene_id"))


@query("SELECT scene_id, CASE WHEN compression_ratio % 3 = 0 THEN 0.5E0 WHEN compression_ratio % 3 = 1 THEN 0.25E0 ELSE cloud_cover END AS cloud_cover, CAST(CASE WHEN compression_ratio % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS versions FROM scenes")
def stream_latest(m):
    """Every third scene comes again later with another cloud cover, which wins; every third but one comes again as an older version, which doesn't."""
    b = briefs(m).withColumn("cloud_cover", F.when(F.col("meta.compression_ratio") % 3 == 1, 0.25).otherwise(F.col("cloud_cover")))
    b = b.withColumn("at", F.to_timestamp("timestamp_utc"))
    stamp = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    later = b.where("meta.compression_ratio % 3 = 0").withColumns({"cloud_cover": F.lit(0.5), "timestamp_utc": stamp(F.col("at") + F.expr("interval 5 minutes"))})
    older = b.where("meta.compression_ratio % 3 = 1").withColumns({"cloud_cover": F.lit(0.75), "timestamp_utc": stamp(F.col("at") - F.expr("interval 5 minutes"))})
    rows = b.withColumn("part", F.lit(0)).unionByName(later.withColumn("part", F.lit(1))).unionByName(older.withColumn("part", F.lit(2)))
    folder = in_turn(m, reports.brief_json(rows).select("part", F.col("json").alias("value")), F.col("part"))
    with rocks(m.spark):
        found = ran(m, stream.stream_latest(stream.stream_briefs(m.spark, folder, FILES), "40000 days", 86400).select("scene_id", "cloud_cover", "ts"), "update")
        return found.groupBy("scene_id").agg(F.max_by("cloud_cover", "part").alias("cloud_cover"), F.count("*").alias("versions"))


def quarters(m):
    """detections as JSON lines (value) with part: the quarter of the time span in which they lie, but late ones come in the last part.

    One more row, long after all others, moves the watermark behind them; what it opens itself stays open.
    """
    d = m.detections.select("det_id", "type", "conf", "lat", "lon", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    lo, hi = d.agg(F.min("t"), F.max("t")).first()
    quarter = F.floor((F.col("t") - lo) * PARTS / (hi - lo + 1)).cast("int")
    rows = d.withColumn("part", F.when((quarter == 0) & (F.col("det_id") % 50 == 0), PARTS - 1).otherwise(quarter))
    end = m.spark.range(1).select(F.lit(-1).cast("long").alias("det_id"), F.lit("end").alias("type"), F.lit(0.0).alias("conf"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.lit(hi + 40 * 86400).alias("t"), F.lit(PARTS - 1).alias("part"))
    return rows.unionByName(end).select("part", F.to_json(F.struct("det_id", "type", "conf", "lat", "lon", "t")).alias("value"))


def streamed(m, folder: str):
    """The detections of in_turn(quarters()), as a stream of a batch for each part."""
    rows = m.spark.readStream.schema("det_id long, type string, conf double, lat double, lon double, t long").option("maxFilesPerTrigger", FILES).json(folder)
    return rows.withColumn("ts", F.timestamp_seconds("t"))


#: The detections that a stream by quarters keeps: those of the first quarter that come last are behind the watermark.
KEPT = """span AS (SELECT CAST(floor(epoch(min(ts))) AS BIGINT) AS lo, CAST(floor(epoch(max(ts))) AS BIGINT) AS hi FROM detections),
kept AS (SELECT d.*, CAST(floor(epoch(d.ts)) AS BIGINT) AS t FROM detections d, span WHERE NOT ((CAST(floor(epoch(d.ts)) AS BIGINT) - lo) * 4 // (hi - lo + 1) = 0 AND det_id % 50 = 0))"""


@query(f"""WITH {KEPT}, r AS (SELECT floor(lat / 0.5) AS y, floor(lon / 0.5) AS x, t, lag(t) OVER (PARTITION BY floor(lat / 0.5), floor(lon / 0.5) ORDER BY t) AS before FROM kept),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR t > before + 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY y, x ORDER BY t, before ROWS UNBOUNDED PRECEDING) AS turn FROM r)
SELECT CAST(y AS BIGINT) || ':' || CAST(x AS BIGINT) AS cell, count(*) AS total FROM g GROUP BY y, x, turn""")
def stream_recurrence(m):
    """Detections of the cells, which close after twelve quiet hours and then start anew: the total of each time that a cell was closed."""
    folder = in_turn(m, quarters(m), F.col("part"))
    rows = streamed(m, folder).withColumn("cell", F.concat_ws(":", F.floor(F.col("lat") / 0.5).cast("string"), F.floor(F.col("lon") / 0.5).cast("string")))
    with rocks(m.spark):
        return ran(m, stream.stream_recurrence(rows, "1 hour", 12 * 3600), "update").where("closed").select("cell", "total")


@query(f"""WITH {KEPT}, w AS (SELECT t // 5520 AS pass, z.zone, count(*) AS n, max(conf) AS max_conf FROM kept d LEFT JOIN zones z ON d.lat BETWEEN z.lat_min AND z.lat_max AND d.lon BETWEEN z.lon_min AND z.lon_max GROUP BY 1, 2)
SELECT * FROM w UNION ALL SELECT NULL, '(late)', (SELECT count(*) FROM detections) - (SELECT count(*) FROM kept), NULL""")
def stream_pass_windows(m):
    """Tumbling windows of a pass and zone as a stream; what came behind the watermark is counted in a row of its own."""
    folder = in_turn(m, quarters(m), F.col("part"))
    zoned = policy.zoned_detections(streamed(m, folder), m.zones).withWatermark("ts", "1 hour")
    windows = ran(m, stream.pass_windows(zoned)).select((F.unix_timestamp("window_start") / 5520).cast("bigint").alias("pass"), "zone", "n", "max_conf")
    return windows.unionByName(stream.late_rows(m.spark.read.json(folder).where("type <> 'end'"), windows))


@query(f"""WITH {KEPT}, c AS (SELECT type, t, lag(t) OVER (PARTITION BY type ORDER BY t) AS before FROM kept), s AS (SELECT type, t, sum(CASE WHEN before IS NULL OR t > before + 600 THEN 1 ELSE 0 END) OVER (PARTITION BY type ORDER BY t) AS s FROM c)
SELECT type, count(*) AS n, min(t) AS started FROM s GROUP BY type, s""")
def stream_sessions(m):
    """Sessions of each type with gaps of over ten minutes, as a stream in append mode: they merge over batches, and late detections go."""
    folder = in_turn(m, quarters(m), F.col("part"))
    found = ran(m, stream.sessions(streamed(m, folder).withWatermark("ts", "1 hour"), "10 minutes", "type"))
    return found.select("type", "n", F.unix_seconds("session_start").alias("started"))


PAST = f"""placed AS (SELECT d.*, s.compression_ratio % {PARTS} AS part FROM detections d JOIN scenes s ON s.scene_id = d.scene_id),
past AS (SELECT q.scene_id, CAST(least(count(*), 20) AS INT) AS history_count FROM (SELECT * FROM placed WHERE det_idx = 0) q JOIN placed d ON d.part < q.part AND d.scene_id <> q.scene_id AND {NEAR} GROUP BY q.scene_id)"""


@query(f"""WITH {ZONED}, {FEATURES}, {PAST}, {ALERTS}, {TRIGGERED}, {DEDUPED}, tasks AS (SELECT scene_id, least(count(*), 3) AS n_requests, min(priority) AS first_priority FROM deduped GROUP BY scene_id)
SELECT a.scene_id, a.compression_ratio % {PARTS} AS batch, CAST(a.history_count AS INT) AS history_count, a.policy_alert, coalesce(t.n_requests, 0) AS n_requests, CAST(t.first_priority AS INT) AS first_priority FROM alerts a LEFT JOIN tasks t ON t.scene_id = a.scene_id""")
def stream_alerts(m):
    """Each batch of briefs is decided by the rules against what earlier batches have stored, and stored; the stored decisions are read."""
    rows = reports.brief_json(briefs(m)).select((F.col("meta.compression_ratio") % PARTS).alias("part"), F.col("json").alias("value"))
    folder, store = in_turn(m, rows, F.col("part")), place(m.spark)
    stream.stream_alerts(stream.stream_briefs(m.spark, folder, FILES), m.zones, store, f"{store}-state-{uuid.uuid4().hex}", layout="yyyy").awaitTermination()
    return versioned.read(m.spark, store, "decisions").select("scene_id", "batch", "history_count", "policy_alert", "n_requests", "first_priority")
