"""Advisory briefs: parsing, fallback, texts and faithfulness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passwatch.functions.rules import risk_tier
from passwatch.functions.text import ALERT_NOTES, fixed, lookup, percent, thousands

# The schema of an advisory brief, and the lines of the log.
BRIEF = (
    "alert_level string, summary string, scene_narrative string, reasoning_trace array<string>, anomaly_assessments array<struct<type:string, risk_tier:string, reasoning:string,"
    " uncertainty_factors:array<string>, lat_lon:array<double>, conf:double, spectral_notes:string>>, evidence_used array<string>,"
    " ovv_recommendation struct<trigger:boolean, reason:string, priority:int, target_coords:array<double>>, bandwidth_note string"
)
HEAVY, THIN = "═" * 60, "─" * 60


def parse_brief_json(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """responses with brief (a struct), parsed (whether the JSON was whole) and raw_head.

    Code fences are stripped and the text from the first to the last brace is read. Where that fails, alert, summary, narrative and up to
    three pairs of type and risk are salvaged by patterns, with confidence 0.5.
    """
    text = F.trim(raw)
    text = F.when(text.startswith("```"), F.trim(F.regexp_replace(F.trim(F.regexp_replace(text, "^`+|`+$", "")), "^(?i)json", ""))).otherwise(text)
    first, last = F.locate("{", text), F.length(text) - F.locate("}", F.reverse(text)) + 1
    body = F.when((first > 0) & (F.locate("}", text) > 0) & (last > first), F.substring(text, first, last - first + 1)).otherwise(text)
    whole = F.get_json_object(body, "$").isNotNull()
    found = lambda key, default: F.coalesce(F.nullif(F.regexp_extract(raw, f'"{key}"\\s*:\\s*"([^"]+)"', 1), F.lit("")), F.lit(default))
    every = lambda key: F.regexp_extract_all(raw, F.lit(f'"{key}"\\s*:\\s*"([^"]+)"'), F.lit(1))
    pairs = F.transform(F.slice(every("type"), 1, 3), lambda t, i: F.struct(t.alias("type"), F.coalesce(F.get(every("risk_tier"), i), F.lit("UNKNOWN")).alias("risk_tier"), F.lit("Recovered from malformed JSON stream.").alias("reasoning"), F.lit(None).cast("array<string>").alias("uncertainty_factors"), F.lit(None).cast("array<double>").alias("lat_lon"), F.lit(0.5).alias("conf"), F.lit(None).cast("string").alias("spectral_notes")))
    some = F.col(raw).contains('"anomaly_assessments"') & F.col(raw).contains('"type"')
    salvaged = F.struct(
        found("alert_level", "UNKNOWN").alias("alert_level"),
        found("summary", "Parse error. Salvaged data shown.").alias("summary"),
        found("scene_narrative", "Partial analysis recovered.").alias("scene_narrative"),
        F.array().cast("array<string>").alias("reasoning_trace"),
        F.when(some, pairs).otherwise(F.slice(pairs, 1, 0)).alias("anomaly_assessments"),
        F.array().cast("array<string>").alias("evidence_used"),
        F.struct(F.lit(False).alias("trigger"), F.lit("parse error").alias("reason"), F.lit(5).alias("priority"), F.lit(None).cast("array<double>").alias("target_coords")).alias("ovv_recommendation"),
        F.lit("Recovered via regex fallback.").alias("bandwidth_note"),
    )
    parsed = F.from_json(body, BRIEF, {"mode": "PERMISSIVE"})
    return responses.withColumn("parsed", F.coalesce(whole, F.lit(False))).withColumn("brief", F.when(F.col("parsed"), parsed).otherwise(salvaged)).withColumn("raw_head", F.when(~F.col("parsed"), F.substring(raw, 1, 500)))


def scene_type_counts(detections: DataFrame) -> DataFrame:
    """Detections per scene and type, with the place of the first one."""
    return detections.groupBy("scene_id", F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"), F.min("det_idx").alias("first_at"))


def listed_types(counted: DataFrame, *also: Column) -> DataFrame:
    """The rows of scene_type_counts() as one text a scene, in the order of first appearance. also: other aggregates of a scene's types."""
    part = F.concat(F.col("n").cast("string"), F.lit(" "), "type", F.when(F.col("n") > 1, "s").otherwise(""))
    return counted.groupBy("scene_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("first_at", part.alias("part"))))["part"], ", ").alias("types"), *also)


def centre() -> Column:
    """The middle of a footprint's bounds as text."""
    middle = lambda a, z: (F.coalesce(a, F.lit(0.0)) + F.coalesce(z, F.lit(0.0))) / 2
    return F.concat(F.lit("("), fixed(middle("lat_min", "lat_max"), 3), F.lit("°N, "), fixed(middle("lon_min", "lon_max"), 3), F.lit("°E)"))


def narrative(alert: Column, at: Column) -> Column:
    """One sentence about a scene of the columns types (null: no detections) and cloud_cover. at: its centre() (null: no footprint)."""
    cloud = F.coalesce("cloud_cover", F.lit(0.0))
    none = F.concat(F.lit("No anomalies detected in scene "), "scene_id", F.when(cloud > 0.3, F.concat(F.lit(" (sensing degraded by "), percent(cloud), F.lit(" cloud cover)"))).otherwise(""), F.lit("."))
    some = F.concat(F.lower("types"), F.lit(" detected at "), F.coalesce(at, F.lit("(0.000°N, 0.000°E)")), F.when(cloud > 0.2, F.concat(F.lit(" under "), percent(cloud), F.lit(" cloud cover"))).otherwise(""), lookup(alert, ALERT_NOTES, ""), F.lit("."))
    return F.when(F.col("types").isNull(), none).otherwise(some)


def scene_narrative(scenes: DataFrame, detections: DataFrame) -> DataFrame:
    """scene_id and one sentence about it. scenes: cloud_cover, footprint bounds, alert_level."""
    told = scenes.withColumn("at", centre()).join(listed_types(scene_type_counts(detections)), "scene_id", "left")
    return told.select("scene_id", narrative(F.col("alert_level"), F.col("at")).alias("narrative"))


def fill_narrative(briefs: DataFrame, narratives: DataFrame) -> DataFrame:
    """briefs (scene_narrative) with the deterministic sentence where there is none."""
    return briefs.join(narratives, "scene_id", "left").withColumn("scene_narrative", F.coalesce(F.nullif("scene_narrative", F.lit("")), "narrative")).drop("narrative")


def fallback_brief(scenes: DataFrame, detections: DataFrame) -> DataFrame:
    """The structured brief of a scene without an advisory. scenes: policy_alert."""
    one = F.struct("det_idx", F.struct(F.coalesce("type", F.lit("unknown")).alias("type"), risk_tier(F.col("conf")).alias("risk_tier"), F.lit("Policy rule applied; LLM assessment unavailable.").alias("reasoning"), F.array(F.lit("LLM unavailable")).alias("uncertainty_factors"), F.array("lat", "lon").alias("lat_lon"), F.coalesce("conf", F.lit(0.0)).alias("conf"), F.lit("").alias("spectral_notes")).alias("a"))
    grouped = detections.groupBy("scene_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["a"]).alias("found"))
    s = scenes.join(grouped, "scene_id", "left")
    n = F.when(F.col("found").isNull(), F.lit(0)).otherwise(F.size("found")).cast("string")
    return s.select(
        "scene_id",
        F.col("policy_alert").alias("alert_level"),
        F.concat(F.lit("Policy-only analysis: "), n, F.lit(" anomaly(s) detected. LLM analyst unavailable.")).alias("summary"),
        F.concat(n, F.lit(" detection(s) flagged by onboard model.")).alias("scene_narrative"),
        F.array(F.lit("LLM analyst unavailable — deterministic policy rules applied."), F.concat(F.lit("Policy alert computed: "), "policy_alert")).alias("reasoning_trace"),
        F.coalesce("found", F.array().cast(grouped.schema["found"].dataType)).alias("anomaly_assessments"),
        F.array(F.lit("policy_engine")).alias("evidence_used"),
        F.struct(F.lit(False).alias("trigger"), F.lit("policy-only mode").alias("reason"), F.lit(5).alias("priority")).alias("ovv_recommendation"),
        F.lit("Policy-only analysis; LLM call skipped.").alias("bandwidth_note"),
    )


def faithfulness(counts: DataFrame) -> DataFrame:
    """counts (scene_id, detected, reported) with accuracy and failure_mode."""
    over, under = F.col("reported") > F.col("detected"), F.col("reported") < F.col("detected")
    return counts.withColumns({"accuracy": F.when(over | under, 0.0).otherwise(1.0), "is_faithful": ~(over | under), "failure_mode": F.when(over, "Hallucination (Over-reporting)").when(under, "Omission (Under-reporting)")})


def reported_in_text(reports: DataFrame, detections: DataFrame, key: str = "scene_id", text: str = "text") -> DataFrame:
    """For reports without assessments: detections whose type the text names, else mentions of ship and harbor, at most the detections there are."""
    low = F.lower(text)
    types = detections.groupBy(key).agg(F.collect_list(F.lower("type")).alias("types"))
    r = reports.join(types, key, "left").withColumn("types", F.coalesce("types", F.array().cast("array<string>")))
    named = F.size(F.filter("types", lambda t: F.instr(low, t) > 0))
    loose = F.least(F.regexp_count(low, F.lit("ship")) + F.regexp_count(low, F.lit("harbor")), F.size("types"))
    return r.select(key, F.size("types").alias("detected"), F.when((named == 0) & (F.size("types") > 0), loose).otherwise(named).alias("reported"))


def analyst_message(payload: Column, context: Column, history: Column) -> Column:
    """The message for an advisory provider; empty parts leave no gap."""
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    past = F.when(some(history).isNotNull(), F.concat(F.lit("\n--- HISTORICAL CONTEXT (prior orbital passes) ---\n"), history, F.lit("\n--- END HISTORICAL CONTEXT ---")))
    return F.concat_ws("\n\n", F.lit("Analyse this telemetry payload and return your structured brief:\n"), F.concat(F.lit("TELEMETRY PAYLOAD:\n"), payload), some(context), past)


def scene_findings(dealt: DataFrame) -> DataFrame:
    """Per scene what alert_features() tells, its types as text, and the lines of its detections (found), from one pass over them.

    dealt: detections with zone, risk_tier and reasoning; where all of a scene lie in one task (repartition("scene_id")) there is no other shuffle.
    """
    line = F.concat(F.lit("  "), F.upper("type"), F.lit(" @ ("), fixed("lat", 4), F.lit("°, "), fixed("lon", 4), F.lit("°) | conf="), percent("conf"), F.lit(" | risk="), "risk_tier", F.lit("\n    → "), "reasoning")
    kind = F.coalesce("type", F.lit("unknown")).alias("type")
    by_type = dealt.withColumn("__line", line).groupBy("scene_id", kind).agg(
        F.count("*").alias("n"), F.min("det_idx").alias("first_at"), F.max("conf").alias("max_conf"), F.max(F.col("zone").isNotNull()).alias("in_zone"), F.collect_list(F.struct("det_idx", "__line")).alias("__lines")
    )
    lines = F.sort_array(F.flatten(F.collect_list("__lines")))["__line"]
    return listed_types(by_type, F.sum("n").alias("n"), F.max("max_conf").alias("max_conf"), F.max("in_zone").alias("in_zone"), lines.alias("found"))


def request_lines() -> Column:
    """The lines of a scene's requests as an aggregate: place, request_id, priority, lat, lon, source, reason."""
    task = F.concat(F.lit("  ["), "request_id", F.lit("] Priority "), F.col("priority").cast("string"), F.lit(" | ("), fixed("lat", 4), F.lit("°, "), fixed("lon", 4), F.lit("°) | Source: "), F.upper("source"), F.lit("\n    → "), "reason")
    return F.sort_array(F.collect_list(F.struct("place", task.alias("line"))))["line"]


def sensor_lines() -> Column:
    """The lines of a scene's cloud_cover, inference_ms and compression_ratio."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("  Cloud Cover   : "), percent("cloud_cover")),
        F.concat(F.lit("  Inference     : "), fixed("inference_ms", 0), F.lit("ms on-board")),
        F.concat(F.lit("  Compression   : "), thousands("compression_ratio"), F.lit(":1")),
    )


def verdict_lines(summary: Column, told: Column) -> Column:
    """The lines of a scene's final_alert and basis, its summary and its narrative."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("  Alert Level   : "), "final_alert"), F.concat(F.lit("  Decision Basis: "), F.upper("basis")),
        F.concat(F.lit("  LLM Available : "), F.when(F.col("basis") == "hybrid", "Yes").otherwise("No (policy fallback)")),
        F.concat(F.lit("\n  Summary: "), summary), F.concat(F.lit("  Narrative: "), told),
    )


def mission_log(decisions: DataFrame) -> DataFrame:
    """scene_id and its audit text.

    decisions: timestamp_utc, n, sensors (sensor_lines()), verdict (verdict_lines()), actions (joined by "; "), and null where there are none
    found (lines of scene_findings()) and tasks (request_lines()). The parts are made at the joins that bring their columns: all of them in
    one projection are a method too long for the JVM to compile, which it then interprets.
    """
    title = lambda text, some: F.when(some.isNotNull(), F.lit(f"\n  {text}\n{THIN}"))
    acts = F.concat(F.lit(f"\n  ACTIONS TAKEN\n{THIN}\n  • "), F.replace("actions", F.lit("; "), F.lit("\n  • ")))
    text = F.concat_ws(
        "\n",
        F.lit(HEAVY), F.concat(F.lit("  MISSION LOG — "), "scene_id"), F.concat(F.lit("  "), "timestamp_utc"), F.lit(f"{HEAVY}\n\n  SENSOR REPORT\n{THIN}"),
        F.concat(F.lit("  Detections    : "), F.col("n").cast("string")), "sensors",
        F.lit(f"\n  INTELLIGENCE ASSESSMENT\n{THIN}"), "verdict",
        title("ANOMALY ASSESSMENTS", F.col("found")), "found",
        F.coalesce(title("OVV SCHEDULE", F.col("tasks")), F.lit("\n  OVV SCHEDULE: None required")), "tasks",
        acts, F.lit(HEAVY),
    )
    return decisions.select("scene_id", text.alias("log"))
