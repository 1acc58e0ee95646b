"""Streams of briefs: reading, de-duplication, windows, recurrence and alerts.

State that outlives a batch is bounded by event time: timers close what the watermark has passed. The stateful processors need the RocksDB
state store.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from passwatch.operators import memory, spatial
from passwatch.plans import mission
from passwatch.sources import versioned
from passwatch.sources.briefs import SCHEMA

WATERMARK = "6 hours"
PASS = "92 minutes"
EXPIRES = 30 * 24 * 3600  # seconds after which a quiet cell starts anew
BUCKETS = 1024  # of the scenes of stream_latest()
BLOCK = 4.0  # degrees of the stored history's partitions


def stream_briefs(spark: SparkSession, folder: str, files_per_trigger: int = 100, multi_line: bool = False) -> DataFrame:
    """New JSON briefs of a folder, with ts; what isn't a brief goes (read_briefs() shows it). With multi_line a file is one document."""
    rows = spark.readStream.schema(SCHEMA).option("multiLine", multi_line).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.json").json(folder)
    return rows.where("_corrupt_record is null and scene_id is not null").drop("_corrupt_record").withColumn("ts", F.to_timestamp("timestamp_utc"))


def stream_dedupe(briefs: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """The first brief of each scene within the watermark; stream_latest() gives the last instead."""
    return briefs.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["scene_id"])


def exploded(briefs: DataFrame, cell: float = 0.5) -> DataFrame:
    """One row per detection of a brief with its grid cell."""
    rows = briefs.select("scene_id", "ts", F.explode("anomalies").alias("a"))
    rows = rows.select("scene_id", "ts", F.col("a.type").alias("type"), F.col("a.lat_lon")[0].alias("lat"), F.col("a.lat_lon")[1].alias("lon"), F.col("a.conf").alias("conf"))
    return rows.withColumn("cell", F.concat_ws(":", F.floor(F.col("lat") / cell).cast("string"), F.floor(F.col("lon") / cell).cast("string")))


def pass_windows(detections: DataFrame, width: str = PASS, key: str = "zone") -> DataFrame:
    """Detections and best confidence of each key in tumbling windows; works on a batch and, with a watermark on ts, on a stream."""
    by = detections.groupBy(F.window("ts", width).alias("w"), F.col(key)).agg(F.count("*").alias("n"), F.max("conf").alias("max_conf"))
    return by.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n", "max_conf")


def late_rows(arrived: DataFrame, windows: DataFrame) -> DataFrame:
    """A row '(late)' with the number of rows that arrived and are in no window: they came behind the watermark. windows: all that were closed."""
    both = arrived.agg(F.count("*").alias("n")).unionByName(windows.agg((-F.coalesce(F.sum("n"), F.lit(0))).alias("n")))
    return both.agg(F.sum("n").alias("n")).select(*[(F.lit("(late)") if c == "zone" else F.col("n") if c == "n" else F.lit(None).cast(t)).alias(c) for c, t in windows.dtypes])


def sessions(detections: DataFrame, gap: str = "3 hours", key: str = "cell") -> DataFrame:
    """Runs of detections of each key without a gap; works on a batch and, with a watermark on ts, on a stream."""
    by = detections.groupBy(F.session_window("ts", gap).alias("w"), F.col(key)).agg(F.count("*").alias("n"))
    return by.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")


class Latest(StatefulProcessor):
    """Holds the times of the newest versions of the scenes of a bucket and gives out rows that are newer. A scene's time goes when the watermark passes it.

    A bucket's times are one table of the state (Arrow's stream format), so that a call to it costs two accesses and not several for each scene.
    """

    def __init__(self, keep_seconds: float) -> None:
        self.keep_ms = int(keep_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "held binary, due long")

    def load(self) -> tuple[pd.Series, int | None]:
        """The scenes' times, and the time of the bucket's timer."""
        if not self.newest.exists():
            return pd.Series([], index=pd.Index([], dtype=object), dtype="int64"), None
        held, due = self.newest.get()
        table = pa.ipc.open_stream(held).read_all()
        return pd.Series(table.column("ms").to_numpy(), index=pd.Index(table.column("scene_id").to_pylist(), dtype=object)), due

    def save(self, times: pd.Series, due: int | None) -> None:
        """due: the time of the timer that runs, None if there is none."""
        first = int(times.min()) + self.keep_ms if len(times) else None
        if due is not None and due != first:
            self.handle.deleteTimer(due)
        if first is None:
            self.newest.clear()
            return
        if due != first:
            self.handle.registerTimer(first)
        table, sink = pa.table({"scene_id": pa.array(times.index, pa.string()), "ms": pa.array(times.to_numpy(), pa.int64())}), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.newest.update((sink.getvalue().to_pybytes(), first))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = None
        for frame in rows:
            both = frame[["scene_id", "ms", "value"]] if last is None else pd.concat([last, frame[["scene_id", "ms", "value"]]])
            last = both.sort_values(["scene_id", "ms", "value"]).drop_duplicates("scene_id", keep="last")
        times, due = self.load()
        before = times.reindex(last["scene_id"]).to_numpy(float)
        last = last[np.isnan(before) | (last["ms"].to_numpy(float) >= before)]
        if len(last):
            new = pd.Series(last["ms"].to_numpy("int64"), index=pd.Index(last["scene_id"], dtype=object))
            self.save(pd.concat([times[~times.index.isin(new.index)], new]), due)
            yield last[["value"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times, _ = self.load()
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        self.save(times[times + self.keep_ms > passed], None)
        return iter(())

    def close(self) -> None:
        pass


def stream_latest(briefs: DataFrame, delay: str = WATERMARK, keep_seconds: float = 6 * 3600, buckets: int = BUCKETS) -> DataFrame:
    """The newest brief of each scene, again each time that a newer one comes (update mode): the later brief wins, as when it is remembered.

    Of equal times that with the larger JSON text wins within a batch, and the later batch wins between batches. A scene's state goes when the
    watermark is keep_seconds past its newest brief. Briefs behind the watermark, and without a scene or a time, go. The scenes are dealt to so many buckets of state; the
    number belongs to the checkpoint.
    """
    packed = briefs.where("scene_id is not null and ts is not null").withWatermark("ts", delay).select("scene_id", "ts", F.unix_millis("ts").alias("ms"), F.to_json(F.struct(*briefs.columns)).alias("value"))
    dealt = packed.withColumn("bucket", F.pmod(F.xxhash64("scene_id"), F.lit(buckets)).cast("int"))
    out = dealt.groupBy("bucket").transformWithStateInPandas(Latest(keep_seconds), "value string", "Update", "EventTime")
    return out.select(F.from_json("value", briefs.schema).alias("b")).select("b.*")


class Recurrence(StatefulProcessor):
    """Counts the detections of a cell until none has come for some time; then the cell is closed and starts anew."""

    def __init__(self, expires_seconds: float) -> None:
        self.expires_ms = int(expires_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times = sorted(int(ms) for frame in rows for ms in frame["ms"])
        n, last = self.seen.get() if self.seen.exists() else (0, None)
        if last is not None:
            self.handle.deleteTimer(last + self.expires_ms)
        new, out = 0, []
        for ms in times:
            if last is not None and ms > last + self.expires_ms:
                out.append((new, n, True))  # its time has passed, though the watermark hasn't come so far
                new = n = 0
            new, n, last = new + 1, n + 1, ms if last is None else max(last, ms)
        self.seen.update((n, last))
        self.handle.registerTimer(last + self.expires_ms)
        yield self.row(key, [*out, (new, n, False)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n = self.seen.get()[0]
        self.seen.clear()
        yield self.row(key, [(0, n, True)])

    @staticmethod
    def row(key, found: list[tuple[int, int, bool]]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], new, n, n >= 2, closed) for new, n, closed in found], columns=["cell", "new", "total", "recurring", "closed"])

    def close(self) -> None:
        pass


def stream_recurrence(detections: DataFrame, delay: str = WATERMARK, expires_seconds: float = EXPIRES) -> DataFrame:
    """For each trigger and cell: new detections, all since the cell was last closed, whether it recurs, and whether this row closes it.

    A cell is closed once the watermark is expires_seconds past its last detection. Detections behind the watermark, and without a time, go.
    """
    rows = detections.where("ts is not null and cell is not null").withWatermark("ts", delay).select("cell", "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("cell").transformWithStateInPandas(Recurrence(expires_seconds), "cell string, new long, total long, recurring boolean, closed boolean", "Update", "EventTime")


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream gave itself when its checkpoint began; another checkpoint is another stream, even with the same batch numbers."""
    path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint, "metadata")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["id"]
    finally:
        stream.close()


def block(lat, lon):
    """The partition of the stored history that a place lies in."""
    return F.concat_ws(":", F.floor(lat / BLOCK).cast("string"), F.floor(lon / BLOCK).cast("string"))


def history_near(spark: SparkSession, store: str, version: int, queries: DataFrame) -> DataFrame | None:
    """The stored detections of the blocks that circles around the query points can touch, as of a version; None while nothing is stored."""
    entry = versioned.manifest(spark, store, version)["tables"].get("detections") if version else None
    if entry is None:
        return None
    y, x = spatial.half_box(F.col("q_lat"), spatial.RADIUS_KM)
    span = lambda at, half: F.explode(F.sequence(F.floor((at - half) / BLOCK), F.floor((at + half) / BLOCK)))
    reach = queries.where("q_lat is not null and q_lon is not null").select(span(F.col("q_lat"), y).alias("y"), "q_lon", F.least(x, F.lit(360.0)).alias("x")).select("y", span(F.col("q_lon"), F.col("x")).alias("x"))
    near = {r.b for r in reach.select(F.concat_ws(":", F.col("y").cast("string"), F.col("x").cast("string")).alias("b")).distinct().collect()}  # blocks of the globe
    return versioned.read(spark, store, "detections", version, near)


def decide_batch(batch: DataFrame, batch_id: int, zones: DataFrame, store: str, writer: str, advisories: DataFrame | None = None, layout: str = "yyyy-MM-dd") -> int:
    """Decide the scenes of a batch by the rules against what the store held before, and bring decisions, requests and the batch itself into it.

    All four tables change in one version, which also names the batch: a batch that is run again changes nothing, and after a crash nothing of
    it is there. Of a scene that comes twice in a batch the newest brief counts; one that has come in an earlier batch is replaced in all tables.
    """
    spark = batch.sparkSession
    base = versioned.manifest(spark, store)
    if base["batches"].get(writer, -1) >= batch_id:
        return base["version"]
    held = []

    def once(rows: DataFrame) -> DataFrame:
        """rows, kept while the batch is decided: the store looks at them several times, and decisions read requests and counts."""
        held.append(rows.persist(StorageLevel.MEMORY_AND_DISK))
        return rows

    briefs = once(memory.newest(batch))
    try:
        at = [F.lit(batch_id).cast("long").alias("batch"), F.lit(base["version"]).cast("long").alias("history_version")]
        scenes = briefs.select("scene_id", "ts", "timestamp_utc", "cloud_cover", F.date_format("ts", layout).alias("date"))
        found = briefs.select("scene_id", "ts", "timestamp_utc", F.posexplode("anomalies").alias("det_idx", "a"))
        a = lambda c: F.col(f"a.{c}").alias(c)
        found = found.select("scene_id", "ts", "timestamp_utc", "det_idx", F.concat_ws("#", "scene_id", F.col("det_idx").cast("string")).alias("det_id"), a("type"), F.get("a.lat_lon", F.lit(0)).alias("lat"), F.get("a.lat_lon", F.lit(1)).alias("lon"), a("conf"))
        points = spatial.first_points(found)
        stored = history_near(spark, store, base["version"], points)
        counts = once(spatial.capped_count(points, found.limit(0) if stored is None else stored).select(F.col("q_id").alias("scene_id"), F.col("n").alias("history_count")))
        if advisories is None:
            advisories = spark.createDataFrame([], "scene_id string, alert_level string, summary string, ovv_trigger boolean, ovv_lat double, ovv_lon double, ovv_priority int, ovv_reason string")
        decisions, requests = mission.mission_cycle(scenes, found, zones, advisories, history=counts)
        requests, decisions = once(requests), once(decisions)
        keys = briefs.select("scene_id")
        dated = requests.join(scenes.select("scene_id", "date"), "scene_id")
        return versioned.apply(
            spark,
            store,
            {
                "decisions": versioned.Change(decisions.select("*", *at), keys=keys),
                "requests": versioned.Change(dated.select("*", *at), keys=keys),
                "scenes": versioned.Change(scenes, keys=keys),
                "detections": versioned.Change(found.withColumn("block", block(F.col("lat"), F.col("lon"))), partition="block", keys=keys),
            },
            writer,
            batch_id,
        )
    finally:
        for rows in reversed(held):
            rows.unpersist()


def stream_alerts(briefs: DataFrame, zones: DataFrame, store: str, checkpoint: str, advisories: DataFrame | None = None, layout: str = "yyyy-MM-dd"):
    """Start a query that decides each micro-batch against the stored history and stores it (decide_batch); store: a folder of versions."""

    def each(batch: DataFrame, batch_id: int) -> None:
        decide_batch(batch, batch_id, zones, store, query_id(batch.sparkSession, checkpoint), advisories, layout)

    return briefs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def remembering(store: str, checkpoint: str | None = None, writer: str | None = None):
    """A foreachBatch function that keeps the last brief of every scene, laid out by date, also of scenes that change their date.

    The stream is known by its checkpoint, or by a name of its own.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        name = query_id(batch.sparkSession, checkpoint) if writer is None else writer
        rows = memory.newest(batch.withColumn("date", F.to_date("ts"))).persist()
        versioned.apply(batch.sparkSession, store, {"scenes": versioned.Change(rows)}, name, batch_id)
        rows.unpersist()

    return each
