"""The history of scenes and detections as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from passwatch.functions.text import ALERT_ICONS, display_ts, fixed, lookup, percent


def scene_replace(existing: DataFrame, incoming: DataFrame, key: str = "scene_id") -> DataFrame:
    """existing without the keys of incoming, and incoming: an upsert by key that may bring several rows a key."""
    keys = incoming.select(key).distinct()
    return existing.join(keys, key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def remember(scenes: DataFrame, detections: DataFrame, new_scenes: DataFrame, new_detections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after scenes have been (re)learned: a scene's old detections go, whether or not it brings new ones."""
    kept = detections.join(new_scenes.select("scene_id").distinct(), "scene_id", "left_anti")
    return scene_replace(scenes, new_scenes), kept.unionByName(new_detections, allowMissingColumns=True)


def save(df: DataFrame, path: str, partition: str = "date") -> None:
    """Replace only the partitions that df has rows of, each whole; files hold neighbours in space together, and a large date has several."""
    by = [partition, *[c for c in ("lat", "lon") if c in df.columns]]
    ordered = df.repartitionByRange(*by).sortWithinPartitions(*by)
    ordered.write.option("partitionOverwriteMode", "dynamic").partitionBy(partition).mode("overwrite").parquet(path)


def newest(rows: DataFrame, key: str = "scene_id", ts: str = "ts") -> DataFrame:
    """The row of each key with the largest ts."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), ts).alias("__row")).select("__row.*")


def history_with_scene(detections: DataFrame, scenes: DataFrame) -> DataFrame:
    """Detections with their scene's alert level; a detection without a scene stays."""
    return detections.join(scenes.select("scene_id", "alert_level"), "scene_id", "left")


def timeline(scenes: DataFrame, limit: int = 50) -> DataFrame:
    """The newest scenes, ties by id."""
    return scenes.orderBy(F.desc("timestamp_utc"), "scene_id").limit(limit)


def timeline_lines(scenes: DataFrame, limit: int = 10) -> DataFrame:
    """One text line for each of the newest scenes."""
    line = F.concat(lookup("alert_level", ALERT_ICONS, "[?]"), F.lit(" **"), "scene_id", F.lit("** | "), F.substring("timestamp_utc", 1, 16), F.lit(" UTC | "), F.col("anomaly_count").cast("string"), F.lit(" anomaly(s) | Alert: "), F.coalesce("alert_level", F.lit("N/A")))
    return timeline(scenes, limit).select("scene_id", line.alias("line"))


def heatmap_top(detections: DataFrame, limit: int = 500) -> DataFrame:
    """The most confident points."""
    return detections.orderBy(F.desc("conf"), "det_id").limit(limit).select("det_id", "lat", "lon", F.col("conf").alias("weight"))


def memory_totals(scenes: DataFrame, detections: DataFrame) -> DataFrame:
    return scenes.agg(F.count("*").alias("total_scenes")).crossJoin(detections.agg(F.count("*").alias("total_anomalies")))


def line_of(hit: Callable[[str], Column], pass_number: Column, alert: Column) -> Column:
    """The text line of a hit, whose columns hit() names."""
    age = F.when(pass_number > 0, F.concat(pass_number.cast("string"), F.lit(" pass(es) ago"))).otherwise("current pass")
    told = F.coalesce(F.concat(F.lit(" [ADVISORY: "), alert, F.lit("]")), F.lit(""))
    return F.concat(F.lit("  • "), F.upper(hit("type")), F.lit(" at ("), fixed(hit("lat"), 4), F.lit("°, "), fixed(hit("lon"), 4), F.lit("°), conf="), percent(hit("conf")), F.lit(", observed "), age, told, F.lit(" ["), display_ts(hit("timestamp_utc"), 10), F.lit("]"))


def history_line(hits: DataFrame) -> DataFrame:
    """One text line for each hit (type, lat, lon, conf, pass_number, alert_level, timestamp_utc)."""
    return hits.withColumn("line", line_of(F.col, F.col("pass_number"), F.col("alert_level")))


def summary_lines(n: Column, passes: Column, types: Column, first: Column, last: Column, lines: Column, radius_km: float) -> Column:
    """The text of the region around (q_lat, q_lon). types: of all hits, newest first; recurring ones stand in the order of first appearance."""
    often = F.filter(F.array_distinct(types), lambda t: F.size(F.filter(types, lambda x: x == t)) >= 2)
    recurring = F.when(F.size(often) > 0, F.array_join(often, ", "))
    head = F.concat(F.lit(f"Regional history (≈{radius_km:.0f}km around ("), fixed("q_lat", 3), F.lit("°, "), fixed("q_lon", 3), F.lit("°)): "), n.cast("string"), F.lit(" anomaly detection(s) across "), passes.cast("string"), F.lit(" orbital pass(es)."))
    again = F.concat(F.lit("  Recurring object types: "), F.upper(recurring), F.lit("."))
    seen = F.concat(F.lit("  Observed from "), display_ts(first, 10), F.lit(" to "), display_ts(last, 10), F.lit("."))
    return F.concat_ws("\n", head, again, seen, lines)


def history_text(hits: DataFrame, radius_km: float = 50.0, most_lines: int = 5) -> DataFrame:
    """q_id and the text of its region: a summary, recurring types, the time span and the first lines. hits has q_lat, q_lon."""
    from passwatch.operators.spatial import of_query

    lined = history_line(hits)
    first = F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("pass_number") < most_lines, F.struct("pass_number", "line")))), lambda x: x["line"]), 1, most_lines)
    types = F.transform(F.array_sort(F.collect_list(F.struct("pass_number", "type"))), lambda x: x["type"])
    by = lined.groupBy(*of_query(hits)).agg(F.count("*").alias("n"), F.count_distinct("scene_id").alias("passes"), F.min("timestamp_utc").alias("a"), F.max("timestamp_utc").alias("z"), first.alias("lines"), types.alias("types"))
    return by.select("q_id", summary_lines(*map(F.col, ("n", "passes", "types", "a", "z", "lines")), radius_km).alias("text"))


def text_of_list(hits: str, radius_km: float, most_lines: int) -> Column:
    """The text of history_text() from a column of hits, newest first, without alerts."""
    of, none = F.col(hits), F.lit(None).cast("string")
    lines = F.transform(F.slice(of, 1, most_lines), lambda d, i: line_of(lambda c: d[c], i, none))
    return summary_lines(F.size(of), F.size(F.array_distinct(of["scene_id"])), of["type"], F.array_min(of["timestamp_utc"]), F.array_max(of["timestamp_utc"]), lines, radius_km)


def shared_texts(queries: DataFrame, detections: DataFrame, radius_km: float = 50.0, limit: int = 20, most_lines: int = 5) -> DataFrame:
    """queries (q_scene, q_lat, q_lon) that have hits, with the text of history_text() over their newest_near(), without alerts.

    A place's text is made once, from its list. Only a query whose own scene is among the place's newest has a text of its own. No row is made for a
    query and a hit, and the rows come out by place, so that equal texts stand together and a shuffle's compression holds them about once.
    """
    from passwatch.operators import spatial

    asked = spatial.asking(queries)
    lists = spatial.place_lists(asked, detections, radius_km, limit).withColumn("__newest", F.slice("around", 1, limit))
    lists = lists.select("q_lat", "q_lon", "around", F.col("__newest")["scene_id"].alias("__scenes"), text_of_list("__newest", radius_km, most_lines).alias("__text"))
    met = asked.join(lists, ["q_lat", "q_lon"]).withColumn("__own", F.when(F.array_contains("__scenes", F.col("q_scene")), spatial.of_others("around", limit)))
    met = met.where(F.col("__own").isNull() | (F.size("__own") > 0))
    return met.select(*queries.columns, F.when(F.col("__own").isNull(), F.col("__text")).otherwise(text_of_list("__own", radius_km, most_lines)).alias("text"))


def region_keys(detections: DataFrame, first_n: int = 3) -> DataFrame:
    """The different 0.1-degree regions of a scene's first detections, in their order."""
    keyed = detections.where(F.col("det_idx") < first_n).withColumns({"klat": F.round("lat", 1), "klon": F.round("lon", 1)})
    one = W.partitionBy("scene_id", "klat", "klon").orderBy("det_idx")
    return keyed.withColumn("__r", F.row_number().over(one)).where("__r = 1").drop("__r")
