"""Alerts and follow-up requests for whole tables of scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from passwatch.functions import rules
from passwatch.operators.spatial import risk_zone_join

REQUESTS = 3  # a pass's bandwidth


def alert_features(zoned: DataFrame) -> DataFrame:
    """Per scene: detections, best confidence, and whether any lies in a zone. zoned: detections with zone."""
    return zoned.groupBy("scene_id").agg(F.count("*").alias("n"), F.max("conf").alias("max_conf"), F.max(F.col("zone").isNotNull()).alias("in_zone"))


def alert_level(scenes: DataFrame, features: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """scenes with n, max_conf, in_zone, history_count and policy_alert; a scene without detections has n = 0."""
    out = scenes.join(features, "scene_id", "left")
    out = out.join(history, "scene_id", "left") if history is not None else out.withColumn("history_count", F.lit(0))
    out = out.withColumns({"n": F.coalesce("n", F.lit(0)), "in_zone": F.coalesce("in_zone", F.lit(False)), "history_count": F.coalesce("history_count", F.lit(0))})
    return out.withColumn("policy_alert", rules.alert_level(F.col("n"), F.col("max_conf"), F.col("in_zone"), F.coalesce("cloud_cover", F.lit(0.0)), F.col("history_count")))


def ovv_triggers(zoned: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Detections that call for a follow-up, with reason and priority."""
    rows = zoned.join(history, "scene_id", "left") if history is not None else zoned.withColumn("history_count", F.lit(0))
    decided = rows.withColumn("t", rules.ovv_trigger(F.col("conf"), F.col("type"), F.col("zone"), F.coalesce("history_count", F.lit(0))))
    return decided.select("*", "t.trigger", "t.reason", "t.priority").drop("t")


def ovv_dedupe(triggered: DataFrame) -> DataFrame:
    """The first request of each 0.01-degree place of a scene."""
    keyed = triggered.where("trigger").withColumns({"klat": F.round("lat", 2), "klon": F.round("lon", 2)})
    first = W.partitionBy("scene_id", "klat", "klon").orderBy("det_idx")
    return keyed.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")


def ovv_asked(advisories: DataFrame) -> DataFrame:
    """The requests of advisories, each with its 0.01-degree place."""
    asked = advisories.where("ovv_trigger and ovv_lat is not null and ovv_lon is not null")
    return asked.select("scene_id", F.col("ovv_lat").alias("lat"), F.col("ovv_lon").alias("lon"), F.coalesce("ovv_reason", F.lit("LLM recommendation")).alias("reason"), F.coalesce("ovv_priority", F.lit(3)).alias("priority"), F.lit(0.0).alias("conf"), F.round("ovv_lat", 2).alias("klat"), F.round("ovv_lon", 2).alias("klon"))


def advisory_ovv_anti(advisories: DataFrame, policy: DataFrame) -> DataFrame:
    """Advisory requests whose place the policy hasn't covered."""
    return ovv_asked(advisories).join(policy.select("scene_id", "klat", "klon"), ["scene_id", "klat", "klon"], "left_anti")


def ovv_union(policy: DataFrame, advisory: DataFrame) -> DataFrame:
    """Both kinds of requests, tagged by source, in the order of acceptance (source_rank, det_idx)."""
    a = policy.select("scene_id", "lat", "lon", "reason", "priority", "conf", "det_idx", F.lit("policy").alias("source"), F.lit(0).alias("source_rank"))
    b = advisory.select("scene_id", "lat", "lon", "reason", "priority", "conf", F.lit(0).alias("det_idx"), F.lit("llm").alias("source"), F.lit(1).alias("source_rank"))
    return a.unionByName(b)


def ovv_accepted(triggered: DataFrame, advisories: DataFrame) -> DataFrame:
    """The rows of ovv_union(p, advisory_ovv_anti(advisories, p)) for p = ovv_dedupe(triggered), which are made once here.

    Both kinds meet at their places: the first detection of a place stays, and an advisory's request where no detection is. All rows of a
    scene lie in one task from here on, so that numbering, cap and totals need no other shuffle.
    """
    place = W.partitionBy("scene_id", F.round("lat", 2), F.round("lon", 2)).orderBy("source_rank", "det_idx")
    rows = ovv_union(triggered.where("trigger"), ovv_asked(advisories)).repartition("scene_id")
    met = rows.withColumns({"__r": F.row_number().over(place), "__first": F.first("source_rank").over(place)})
    free = (F.col("__first") == 1) | F.col("scene_id").isNull()
    return met.where(F.when(F.col("source_rank") == 0, F.col("__r") == 1).otherwise(free)).drop("__r", "__first")


def ovv_number(requests: DataFrame) -> DataFrame:
    """seq and request_id in the order of acceptance, before any cap."""
    order = W.partitionBy("scene_id").orderBy("source_rank", "det_idx")
    numbered = requests.withColumn("seq", F.row_number().over(order))
    return numbered.withColumn("request_id", F.concat(F.lit("OVV-"), F.when(F.col("seq") < 1000, F.lpad(F.col("seq").cast("string"), 3, "0")).otherwise(F.col("seq").cast("string"))))


def ovv_cap(numbered: DataFrame, most: int = REQUESTS) -> DataFrame:
    """The most urgent requests of each scene, earlier ones first among equals."""
    order = W.partitionBy("scene_id").orderBy("priority", "seq")
    return numbered.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def ovv_requests(zoned: DataFrame, history: DataFrame | None, advisories: DataFrame) -> DataFrame:
    return ovv_cap(ovv_number(ovv_accepted(ovv_triggers(zoned, history), advisories)))


def decision_actions(scenes: DataFrame, requests: DataFrame, *also: Column) -> DataFrame:
    """scenes (final_alert) with n_requests, first_priority and the actions as one text. also: other aggregates of a scene's requests."""
    by = requests.groupBy("scene_id").agg(F.count("*").alias("n_requests"), F.min("priority").alias("first_priority"), *also)
    out = scenes.join(by, "scene_id", "left").withColumn("n_requests", F.coalesce("n_requests", F.lit(0)))
    scheduled = F.when(F.col("n_requests") > 0, F.concat(F.lit("OVV scheduled: "), F.col("n_requests").cast("string"), F.lit(" request(s) (priority "), F.col("first_priority").cast("string"), F.lit(")")))
    sent = F.when(F.col("final_alert").isin("ORANGE", "RED"), F.concat(F.lit("Alert dispatched: "), "final_alert"))
    text = F.concat_ws("; ", scheduled, sent)
    return out.withColumn("actions", F.when(text == "", "No action required — monitoring continued.").otherwise(text))


def zoned_detections(detections: DataFrame, zones: DataFrame) -> DataFrame:
    return risk_zone_join(detections, zones)


def ovv_manual_request(points: DataFrame, lat: str = "lat", lon: str = "lon", reason: str = "operator request") -> DataFrame:
    """A request row of an operator for each point."""
    made = F.upper(F.substring(F.md5(F.concat(F.col(lat).cast("string"), F.col(lon).cast("string"))), 1, 6))
    return points.withColumns({"request_id": F.concat(F.lit("REQ-"), made), "reason": F.lit(reason), "priority": F.lit(1)})
