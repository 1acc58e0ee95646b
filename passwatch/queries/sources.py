"""Queries that go through files: what is written into the session's shared folder is read again by the library's readers."""

import tempfile
import uuid

from pyspark.sql import functions as F

from passwatch.adapters import rounded
from passwatch.operators import crowd, raster, reports
from passwatch.plans import mission
from passwatch.queries import query, rasters
from passwatch.queries.detections import JSON_SQL, NMS, briefs
from passwatch.sources import briefs as brief_files
from passwatch.sources import tiles as tile_files


def place(spark) -> str:
    """A new folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/files-{uuid.uuid4().hex}"


def damaged(m) -> str:
    """All briefs as JSON lines; every tenth is cut off."""
    folder = place(m.spark)
    text = F.when(F.col("meta.compression_ratio") % 10 == 0, F.expr("left(json, 40)")).otherwise(F.col("json"))
    reports.brief_json(briefs(m)).select(text.alias("value")).write.option("compression", "none").format("text").save(folder + "/lines")
    return folder + "/lines"


@query("""WITH d AS (SELECT scene_id, count(*) AS n FROM detections GROUP BY scene_id)
SELECT s.scene_id, s.timestamp_utc, s.cloud_cover, CAST(coalesce(d.n, 0) AS INT) AS anomaly_count FROM scenes s LEFT JOIN d ON d.scene_id = s.scene_id WHERE s.compression_ratio % 10 <> 0""")
def read_briefs(m):
    good, _ = brief_files.read_briefs(m.spark, renamed(m, damaged(m)))
    return good.select("scene_id", "timestamp_utc", "cloud_cover", F.size("anomalies").alias("anomaly_count"))


@query(f"WITH {JSON_SQL} SELECT left(head, 40) AS text, 2 * count(*) AS times FROM t WHERE compression_ratio % 10 = 0 GROUP BY 1")
def read_briefs_multi(m):
    """Two folders at once, and what could not be read of each."""
    paths = [renamed(m, damaged(m)), renamed(m, damaged(m))]
    _, bad = brief_files.read_briefs(m.spark, paths)
    return bad.groupBy("text").agg(F.count("*").alias("times"))


def renamed(m, folder: str) -> str:
    """The same files with the ending .json."""
    where = m.spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = where.getFileSystem(m.spark._jsc.sc().hadoopConfiguration())
    for status in store.listStatus(where):
        path = status.getPath()
        if path.getName().endswith(".txt"):
            store.rename(path, m.spark._jvm.org.apache.hadoop.fs.Path(folder, path.getName()[:-4] + ".json"))
    return folder


@query(f"SELECT CAST(stem AS VARCHAR) AS stem, cls, {', '.join(f'{rounded(c, 6)} AS {c}' for c in ('cx', 'cy', 'w', 'h'))} FROM box_labels")
def scan_labels(m):
    """Label files, written and scanned again; beside them lie a file of lines of four numbers and an empty one, which give nothing."""
    folder = place(m.spark)
    tile_files.write_labels(m.box_labels, folder)
    m.box_labels.select(F.lit("1 2 3 4").alias("value")).distinct().write.mode("append").text(folder)
    m.box_labels.select(F.lit("").alias("value")).distinct().write.mode("append").text(folder)
    return tile_files.scan_labels(m.spark, folder)


@query(f"SELECT CAST(stem AS VARCHAR) AS stem, format('{{:d}} {{:.6f}} {{:.6f}} {{:.6f}} {{:.6f}}', cls, {', '.join(rounded(c, 6) for c in ('cx', 'cy', 'w', 'h'))}) AS value FROM box_labels")
def write_labels(m):
    folder = place(m.spark)
    tile_files.write_labels(m.box_labels, folder)
    parts = F.split("value", "\t")
    return m.spark.read.text(folder).select(parts[0].alias("stem"), parts[1].alias("value"))


@query("""WITH t AS (SELECT CAST(unnest(range(0, 10)) AS INT) AS t) SELECT p.scene_no || '_' || lpad(CAST(a.t AS VARCHAR), 4, '0') || '_' || lpad(CAST(b.t AS VARCHAR), 4, '0') AS tile_id, count(*) AS n
 FROM pixels p JOIN t a ON p.y // 64 = a.t JOIN t b ON p.x // 64 = b.t GROUP BY 1""")
def write_tiles(m):
    cut = raster.tile_scene(m.pixels.select(F.col("scene_no").cast("string").alias("scene_id"), "y", "x", "b2"), size=64)
    folder = place(m.spark)
    tile_files.write_tiles(cut, folder)
    return m.spark.read.parquet(folder).groupBy("tile_id").agg(F.count("*").alias("n"))


def array_files(m) -> str:
    """A folder of archives with an array file for each tile of the scenes."""
    folder = place(m.spark)
    tile_files.write_npz(rasters.tile_frames(m), folder).count()
    return folder


@query(f"""WITH {rasters.CELLS} SELECT scene_id, 8 AS h, 8 AS w, CAST(sum({" + ".join(rasters.BANDS)}) AS BIGINT) AS total, CAST(sum(b11 * (py * 8 + px)) AS BIGINT) AS place, round(count(*) FILTER (b3 > 204) / 64.0E0, 6) AS cloud_cover FROM cells GROUP BY scene_id""")
def scan_tiles(m):
    """Array files, scanned and decoded: size, sum of all values in 256ths, those of a band by place, and the cloud cover."""

    def sums(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            tiles = [np.rint(np.frombuffer(v, np.float32).reshape(h, w, 6) * 256).astype(np.int64) for v, h, w in zip(b.bands, b.h, b.w)]
            yield pd.DataFrame({"scene_id": b.scene_id, "h": b.h, "w": b.w, "total": [int(t.sum()) for t in tiles], "place": [int((t[:, :, 4].ravel() * np.arange(t.shape[0] * t.shape[1])).sum()) for t in tiles], "cloud_cover": b.cloud_cover.round(6)})

    good, _ = tile_files.decode_tiles(tile_files.scan_tiles(m.spark, array_files(m)))
    return good.mapInPandas(sums, "scene_id string, h int, w int, total long, place long, cloud_cover double")


def _box_detector():
    """Three boxes by a tile's band means: the whole tile, a weaker one that it covers, and a small one in the corner."""
    import numpy as np

    def model(tensor):
        means = tensor[0].mean(axis=(1, 2))
        scores = means[[3, 4, 5, 0]][:, None] * np.array([[1, 0.875, 0.75]], np.float32)
        return np.concatenate([np.array([[4, 4, 1], [4, 4, 1], [8, 7, 2], [8, 7, 2]], np.float32), scores])[None].astype(np.float32)

    return model


@query(f"""WITH {rasters.CELLS}, s AS (SELECT scene_id, {", ".join(f"sum({b}) / 16384.0E0 AS {b}" for b in ("b8", "b11", "b12", "b2"))}, count(*) FILTER (b3 > 204) / 64.0E0 AS cloud FROM cells GROUP BY scene_id),
b AS (SELECT *, greatest(b8, b11, b12, b2) AS conf, CASE WHEN scene_id LIKE '%0' THEN 10.0E0 ELSE 8.0E0 END AS south, CASE WHEN scene_id LIKE '%0' THEN 70.0E0 ELSE 77.0E0 END AS west FROM s),
t AS (SELECT *, CASE WHEN b8 = conf THEN 'ship' WHEN b11 = conf THEN 'airplane' WHEN b12 = conf THEN 'storage-tank' ELSE 'harbor' END AS type FROM b)
SELECT scene_id, '2026-04-24T09:12:44Z' AS timestamp_utc, round(cloud, 3) AS cloud_cover, CAST(CASE WHEN conf * 0.75 >= 0.35 THEN 2 WHEN conf >= 0.35 THEN 1 ELSE 0 END AS INT) AS anomaly_count,
 concat_ws(';', CASE WHEN conf >= 0.35 THEN type || ' ' || {rounded('conf', 4)} || ' ' || (south + 0.5E0) || ' ' || (west + 0.5E0) || ' 0 8' END, CASE WHEN conf * 0.75 >= 0.35 THEN type || ' ' || {rounded('conf * 0.75', 4)} || ' ' || (south + 0.875E0) || ' ' || (west + 0.125E0) || ' 0 2' END) AS found FROM t""")
def tile_batch(m):
    """From array files to brief files: scanned, decoded, scored, suppressed, placed, assembled, written and read again."""
    spark = m.spark
    tiles, _ = tile_files.decode_tiles(tile_files.scan_tiles(spark, array_files(m)))
    part = lambda c: (F.col(c) / 80).cast("int").cast("string")
    named = m.pixels.where("x < 80").select(F.concat_ws("_", F.col("scene_no").cast("string"), part("y"), part("x")).alias("scene_id")).distinct()
    footprints = named.select("scene_id", F.lit(10.0).alias("lat_min"), F.lit(11.0).alias("lat_max"), F.lit(70.0).alias("lon_min"), F.lit(71.0).alias("lon_max"))
    briefs_made = mission.tile_batch(tiles, footprints, _box_detector, F.lit("2026-04-24T09:12:44Z"), tile_size=8)
    folder = place(spark)
    brief_files.write_briefs(briefs_made, folder)
    good, _ = brief_files.read_briefs(spark, folder)
    one = lambda a: F.concat_ws(" ", a["type"], a["conf"].cast("string"), a["lat_lon"][0].cast("string"), a["lat_lon"][1].cast("string"), a["bbox_px"][0].cast("string"), a["bbox_px"][3].cast("string"))
    return good.select("scene_id", "timestamp_utc", "cloud_cover", "anomaly_count", F.array_join(F.transform("anomalies", one), ";").alias("found"))


@query(f"""WITH {rasters.CELLS} SELECT scene_id, 0 AS anchor, 4.0E0 AS cx, 4.0E0 AS cy, 8.0E0 AS w, 8.0E0 AS h, {", ".join(f"round(sum({b}) / 16384.0E0, 6) AS {b}_mean" for b in ("b8", "b11", "b12", "b2"))} FROM cells GROUP BY scene_id""")
def score_tiles(m):
    """The scoring hook with a detector that reports each tile's band means as the scores of one box."""
    scored = raster.score_tiles(rasters.tile_frames(m), rasters._mean_detector)
    means = [F.round(F.col("scores")[i].cast("double"), 6).alias(f"{b}_mean") for i, b in enumerate(("b8", "b11", "b12", "b2"))]
    return scored.select("scene_id", "anchor", *[F.col(c).cast("double").alias(c) for c in ("cx", "cy", "w", "h")], *means)


@query(NMS)
def nms_crowded(m):
    """Suppression by rounds over cells of 128 pixels, for scenes that no task should hold."""
    return crowd.nms_crowded(m.detections.where("conf >= 0.35"), place(m.spark), cell=128)
