"""JSON briefs: readers that quarantine what cannot be parsed, and the writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "scene_id string, timestamp_utc string, tile_footprint struct<lat_min:double, lat_max:double, lon_min:double, lon_max:double>, cloud_cover double, anomaly_count int,"
    " anomalies array<struct<type:string, lat_lon:array<double>, conf:double, bbox_px:array<int>>>, meta struct<model_version:string, inference_ms:double, compression_ratio:bigint>, _corrupt_record string"
)


def read_briefs(spark: SparkSession, paths: str | list[str], multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Briefs of one or several paths (files or folders of *.json), and the quarantine: source file and text of what isn't a brief.

    A line is a document; with multi_line a file is one, over as many lines as it likes.
    """
    rows = spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").option("multiLine", multi_line).option("pathGlobFilter", "*.json").json(paths).withColumn("source_file", F.col("_metadata.file_path"))
    bad = F.col("_corrupt_record").isNotNull() | F.col("scene_id").isNull()
    return rows.where(~bad).drop("_corrupt_record"), rows.where(bad).select("source_file", F.col("_corrupt_record").alias("text"))


def write_briefs(briefs: DataFrame, path: str, digits: int = 10) -> None:
    """One compact document a line, keys in their fixed order, in *.json files laid out by date, or by so many digits of the time.

    briefs: nested, as assemble_brief() gives them.
    """
    columns = ("scene_id", "timestamp_utc", "tile_footprint", "cloud_cover", "anomaly_count", "anomalies", "meta")
    briefs.select(F.substring("timestamp_utc", 1, digits).alias("date"), *columns).write.partitionBy("date").mode("overwrite").json(path)
