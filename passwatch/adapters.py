"""The detection model as views over the driver's tables.

One text serves Spark and DuckDB: integer arithmetic only, so that both engines agree to the last bit. {iso:x} is the one
engine-dependent part, a timestamp as an ISO string.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

SCENE = "CONCAT('S', CAST(user_id AS STRING), '-', CAST(CAST(ts AS DATE) AS STRING))"

VIEWS = {
    "detections": f"""
SELECT {SCENE} AS scene_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) - 1 AS INT) AS det_idx, event_id AS det_id, ts, {{iso:ts}} AS timestamp_utc,
 CASE event_type WHEN 'click' THEN 'ship' WHEN 'view' THEN 'airplane' WHEN 'signup' THEN 'storage-tank' WHEN 'purchase' THEN 'harbor' ELSE 'unknown' END AS type,
 8.0E0 + ((event_id * 7919) % 6000) / 1000.0E0 AS lat, 72.0E0 + ((event_id * 104729) % 8000) / 1000.0E0 AS lon, ((event_id * 31) % 1000) / 1000.0E0 AS conf,
 CAST((event_id * 37) % 560 AS INT) AS x1, CAST((event_id * 53) % 560 AS INT) AS y1,
 CAST((event_id * 37) % 560 + 20 + (event_id * 11) % 60 AS INT) AS x2, CAST((event_id * 53) % 560 + 20 + (event_id * 13) % 60 AS INT) AS y2
FROM events""",
    "found_scenes": f"""
SELECT {SCENE} AS scene_id, MIN(ts) AS ts, CAST(COUNT(*) AS INT) AS anomaly_count, ((user_id * 17 + MIN(event_id) * 29) % 100) / 100.0E0 AS cloud_cover,
 ((MIN(event_id) * 13) % 900) / 1.0E0 AS inference_ms, CAST(30000 + (MIN(event_id) * 7) % 5000 AS BIGINT) AS compression_ratio
FROM events GROUP BY user_id, CAST(ts AS DATE)""",
    "empty_scenes": """
SELECT CONCAT('E', CAST(o_orderkey AS STRING)) AS scene_id, CAST(o_orderdate AS TIMESTAMP) AS ts, 0 AS anomaly_count, ((o_orderkey * 13) % 100) / 100.0E0 AS cloud_cover,
 (o_orderkey % 900) / 1.0E0 AS inference_ms, CAST(30000 + o_orderkey % 5000 AS BIGINT) AS compression_ratio
FROM orders""",
    "scenes": """
SELECT scene_id, CAST(ts AS TIMESTAMP) AS ts, {iso:ts} AS timestamp_utc, anomaly_count, cloud_cover, inference_ms, compression_ratio FROM found_scenes
UNION ALL SELECT scene_id, ts, {iso:ts} AS timestamp_utc, anomaly_count, cloud_cover, inference_ms, compression_ratio FROM empty_scenes""",
    "zones": """
SELECT * FROM (VALUES (0, 'Gulf of Aden', 10.0E0, 15.0E0, 45.0E0, 55.0E0), (1, 'Strait of Malacca', 1.0E0, 6.0E0, 100.0E0, 104.0E0),
 (2, 'Lakshadweep EEZ', 8.0E0, 14.0E0, 72.0E0, 77.0E0), (3, 'Palk Strait', 8.0E0, 10.0E0, 79.0E0, 80.0E0)) AS z(zone_order, zone, lat_min, lat_max, lon_min, lon_max)""",
    "footprints": """
SELECT scene_id, 8.0E0 + compression_ratio % 6 AS lat_min, 9.0E0 + compression_ratio % 6 AS lat_max, 72.0E0 + compression_ratio % 8 AS lon_min, 73.0E0 + compression_ratio % 8 AS lon_max
FROM scenes WHERE compression_ratio % 5 <> 0""",
    "advisories": """
SELECT scene_id, CASE compression_ratio % 6 WHEN 0 THEN 'GREEN' WHEN 1 THEN 'YELLOW' WHEN 2 THEN 'ORANGE' WHEN 3 THEN 'RED' ELSE 'UNKNOWN' END AS alert_level,
 CONCAT('Advisory for ', scene_id) AS summary, compression_ratio % 3 = 0 AS ovv_trigger, 8.0E0 + (compression_ratio % 6000) / 1000.0E0 AS ovv_lat, 72.0E0 + ((compression_ratio * 7) % 8000) / 1000.0E0 AS ovv_lon,
 CAST(1 + compression_ratio % 4 AS INT) AS ovv_priority, 'advisory recommendation' AS ovv_reason
FROM scenes WHERE compression_ratio % 7 < 4""",
    "pixels": """
SELECT CAST(l_suppkey AS BIGINT) AS scene_no, CAST(l_partkey % 640 AS INT) AS x, CAST((l_orderkey * 7 + l_linenumber) % 640 AS INT) AS y,
 ((l_orderkey * 3 + l_partkey) % 1000) / 1000.0E0 AS b2, ((l_orderkey * 5 + l_partkey) % 1000) / 1000.0E0 AS b3, ((l_orderkey * 7 + l_partkey) % 1000) / 1000.0E0 AS b4,
 ((l_orderkey * 11 + l_partkey) % 1000) / 1000.0E0 AS b8, ((l_orderkey * 13 + l_partkey) % 1000) / 1000.0E0 AS b11, ((l_orderkey * 17 + l_partkey) % 1000) / 1000.0E0 AS b12
FROM lineitem""",
    "boxes": """
SELECT det_id, 1 + det_id % (SELECT COUNT(*) FROM supplier) AS scene_no, type, lat, lon, conf, x1, y1, x2, y2 FROM detections""",
    "tiles_raw": """
SELECT CAST(p_partkey AS BIGINT) AS stem, p_name AS body FROM part""",
    "box_labels": """
SELECT det_id, det_id % 2500 AS stem, CAST(det_id % 4 AS INT) AS cls, (x1 + x2) / 2.0E0 / 640.0E0 AS cx, (y1 + y2) / 2.0E0 / 640.0E0 AS cy, (x2 - x1) / 640.0E0 AS w, (y2 - y1) / 640.0E0 AS h FROM detections WHERE det_id % 2500 % 5 <> 0""",
    "chunks": """
SELECT doc_id AS id, source AS category, SPLIT_PART(text, CHR(10), 1) AS title, text AS content FROM documents""",
    "vectors": """
SELECT vec_id AS id, label AS category, CAST(embedding AS {doubles}) AS embedding FROM embeddings""",
    "reports": """
SELECT conv_id, turn, text AS raw FROM conversations WHERE role = 'assistant'""",
    "tracks": """
SELECT user_id AS track, event_id AS i, ((event_id * 7919) % 140000) / 1000.0E0 - 70 AS lat, ((event_id * 104729) % 360000) / 1000.0E0 - 180 AS lon FROM events""",
}
SPARK = {"iso": "date_format({0}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")", "doubles": "ARRAY<DOUBLE>"}
DUCKDB = {"iso": "strftime({0}, '%Y-%m-%dT%H:%M:%SZ')", "doubles": "DOUBLE[]"}


def rendered(text: str, dialect: dict[str, str]) -> str:
    text = text.replace("{doubles}", dialect["doubles"])
    return re.sub(r"\{iso:([^}]*)\}", lambda m: dialect["iso"].format(m[1]), text)


def rounded(x: str, digits: int) -> str:
    """DuckDB text that rounds a double half up by its shortest decimal form, as Spark does."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DOUBLE)"


def needs(text: str) -> list[str]:
    """The views that a text reads, those that they need first."""
    out: list[str] = []

    def visit(body: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", body, re.I) and name not in out:
                visit(VIEWS[name])
                if name not in out:
                    out.append(name)

    visit(text)
    return out


def oracle(body: str) -> str:
    """A DuckDB query with the views that it reads in front."""
    own = body.strip()
    ctes = ",\n".join(f"{name} AS ({rendered(VIEWS[name], DUCKDB).strip()})" for name in needs(own))
    own = rendered(own, DUCKDB)
    if not ctes:
        return own
    if own.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{own[len('WITH RECURSIVE'):].lstrip()}"
    return f"WITH {ctes},\n{own[4:].lstrip()}" if own.upper().startswith("WITH") else f"WITH {ctes}\n{own}"


class Model:
    """The views as DataFrames: model.detections, model.scenes, ..."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        if name not in self._made:
            text = rendered(VIEWS[name], SPARK).replace("{", "{{").replace("}", "}}")
            inputs = set(re.findall(r"\b(?:FROM|JOIN)\s+([a-z_]+)", text)) - {"z"}
            frames = {x: getattr(self, x) if x in VIEWS else self.table(x) for x in inputs}
            for x in inputs:
                text = re.sub(rf"\b(FROM|JOIN)\s+{x}\b", rf"\1 {{{x}}}", text)
            self._made[name] = self.spark.sql(text, **frames)
        return self._made[name]

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")
