"""Spatial joins: grid cells make the distance join an equi-join, which hash joins and skew splitting can serve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from passwatch.functions.geo import DEGREE_KM, EARTH_KM, half_box, haversine_km

CELL = 0.5
CELL_OF_COUNTS = 0.125
RADIUS_KM = 50.0
LIMIT = 20


def query_region(detections: DataFrame, lat: float, lon: float, radius_km: float = RADIUS_KM, limit: int = LIMIT, exclude_scene_id: str | None = None) -> DataFrame:
    """Detections within a radius of one point, newest first. The box is pushed down to the scan before the distance is taken."""
    y, x = half_box(F.lit(lat), radius_km)
    near = detections.where(F.col("lat").between(F.lit(lat) - y, F.lit(lat) + y) & F.col("lon").between(F.lit(lon) - x, F.lit(lon) + x))
    if exclude_scene_id is not None:
        near = near.where(F.col("scene_id") != exclude_scene_id)
    near = near.withColumn("distance_km", haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))).where(F.col("distance_km") <= radius_km)
    return near.orderBy(F.desc("timestamp_utc"), F.desc("det_id")).limit(limit)


def region_join(queries: DataFrame, detections: DataFrame, radius_km: float = RADIUS_KM, cell: float = CELL, exclude_self: bool = True, as_of: bool = False) -> DataFrame:
    """For every query point (q_id, q_scene, q_lat, q_lon, and q_ts for as_of) the detections within the radius, with distance_km.

    exclude_self leaves out the query's own scene; as_of keeps only detections from before the query.
    """
    y, x = half_box(F.col("q_lat"), radius_km)
    span = lambda at, half: F.sequence(F.floor((at - half) / cell).cast("int"), F.floor((at + half) / cell).cast("int"))
    dealt = queries.withColumn("__y", y).withColumn("__x", x).withColumn("__cy", F.explode(span(F.col("q_lat"), F.col("__y")))).withColumn("__cx", F.explode(span(F.col("q_lon"), F.least(F.col("__x"), F.lit(360.0)))))  # near a pole the box is the globe
    placed = detections.withColumn("__cy", F.floor(F.col("lat") / cell).cast("int")).withColumn("__cx", F.floor(F.col("lon") / cell).cast("int"))
    keep: Column = F.col("lat").between(F.col("q_lat") - F.col("__y"), F.col("q_lat") + F.col("__y")) & F.col("lon").between(F.col("q_lon") - F.col("__x"), F.col("q_lon") + F.col("__x"))
    if exclude_self:
        keep &= F.col("scene_id") != F.col("q_scene")
    if as_of:
        keep &= F.col("ts") < F.col("q_ts")
    near = dealt.join(placed, ["__cy", "__cx"]).where(keep)
    return near.withColumn("distance_km", haversine_km(F.col("q_lat"), F.col("q_lon"), F.col("lat"), F.col("lon"))).where(F.col("distance_km") <= radius_km).drop("__cy", "__cx", "__y", "__x")


def first_points(detections: DataFrame) -> DataFrame:
    """The query point of every scene: its first detection."""
    return detections.where("det_idx = 0").select(F.col("scene_id").alias("q_id"), F.col("scene_id").alias("q_scene"), F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon"), F.col("ts").alias("q_ts"))


def newest(joined: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The newest hits of each query, numbered from 0 (pass_number)."""
    order = W.partitionBy("q_id").orderBy(F.desc("timestamp_utc"), F.desc("det_id"))
    # the filter on the rank itself lets Spark keep each task's best rows only, before the shuffle
    return joined.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= limit).withColumn("pass_number", F.col("__r") - 1).drop("__r")


def overfetched(joined_box: DataFrame, limit: int = LIMIT, radius_km: float = RADIUS_KM) -> DataFrame:
    """The compatible form: the newest 3 x limit rows of the box are fetched before distances are tested, so true hits can be lost."""
    order = W.partitionBy("q_id").orderBy(F.desc("timestamp_utc"), F.desc("det_id"))
    fetched = joined_box.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= 3 * limit)
    near = fetched.withColumn("distance_km", haversine_km(F.col("q_lat"), F.col("q_lon"), F.col("lat"), F.col("lon"))).where(F.col("distance_km") <= radius_km)
    return near.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= limit).withColumn("pass_number", F.col("__r") - 1).drop("__r")


def near_totals(queries: DataFrame, detections: DataFrame, radius_km: float = RADIUS_KM, exclude_self: bool = True) -> DataFrame:
    """q_id, n and km of every query (q_id, q_scene, q_lat, q_lon) that has hits: their number and the sum of their distances, as over region_join().

    Rows of one place share their distances: places meet places, each with its number of rows, and a query reads the totals of its place. What
    exclude_self leaves out is taken off again: the query's own scene meets the query by the scene's id. Rows thus grow with the pairs of places that are near.
    """
    keep = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    asked = queries.where("q_lat is not null and q_lon is not null").select("q_id", "q_scene", "q_lat", "q_lon")
    if exclude_self:
        keep, asked = keep & F.col("scene_id").isNotNull(), asked.where("q_scene is not null")
    rows = detections.where(keep).select("scene_id", "lat", "lon")
    near = region_join(asked.select("q_lat", "q_lon").distinct(), rows.groupBy("lat", "lon").agg(F.count("*").alias("__n")), radius_km, exclude_self=False)
    held = near.groupBy("q_lat", "q_lon").agg(F.sum("__n").alias("n"), F.sum(F.col("__n") * F.col("distance_km")).alias("km"))
    out = asked.join(held, ["q_lat", "q_lon"]).select("q_id", "n", "km")
    if exclude_self:
        own = asked.join(rows, F.col("q_scene") == F.col("scene_id")).withColumn("distance_km", haversine_km(F.col("q_lat"), F.col("q_lon"), F.col("lat"), F.col("lon")))
        out = out.unionByName(own.where(in_reach(radius_km)).select("q_id", F.lit(-1).cast("long").alias("n"), (-F.col("distance_km")).alias("km")))
    return out.groupBy("q_id").agg(F.sum("n").alias("n"), F.sum("km").alias("km")).where("n > 0")


def in_reach(radius_km: float, box_only: bool = False) -> Column:
    """Whether (lat, lon), at distance_km, lies in the box around the query point and, unless box_only, within the radius."""
    y, x = half_box(F.col("q_lat"), radius_km)
    near = F.col("lat").between(F.col("q_lat") - y, F.col("q_lat") + y) & F.col("lon").between(F.col("q_lon") - x, F.col("q_lon") + x)
    return near if box_only else near & (F.col("distance_km") <= radius_km)


def newest_of_each(rows: DataFrame, by: list[str], limit: int) -> DataFrame:
    """The newest rows of each place that a list of the `limit` newest without any one scene can need; as thinned(), for the newest."""
    last = lambda *keys: F.row_number().over(W.partitionBy(*by, *keys).orderBy(F.desc("timestamp_utc"), F.desc("det_id")))
    some = rows.withColumn("__r", last("scene_id")).where(F.col("__r") <= limit)
    return some.withColumn("__r", last()).where(F.col("__r") <= 2 * limit)


def place_lists(queries: DataFrame, detections: DataFrame, radius_km: float = RADIUS_KM, limit: int = LIMIT, box_only: bool = False, cell: float = CELL_OF_COUNTS) -> DataFrame:
    """q_lat, q_lon and around of every place of queries (q_lat, q_lon) that has hits: its newest hits of all scenes, newest first, with distance_km, as many as the
    `limit` newest without any one scene can need.

    No row is made for every query and detection that are near. A place keeps its newest detections (newest_of_each()). All queries of a cell
    share a bound: as many of the cells wholly within the radius are as new as that as any of the queries can need, so only detections as new are dealt to
    the cell. They meet the places of its queries, and each place keeps its newest. Rows thus grow with the detections and the
    places that ask. Detections heaped on the border of the radius, all newer than what lies within, are tested by every place of the cell.
    """
    there = F.col("scene_id").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    columns = detections.columns
    placed = newest_of_each(detections.where(there), ["lat", "lon"], limit).drop("__r").withColumns({"__cy": in_cell(F.col("lat"), cell), "__cx": in_cell(F.col("lon"), cell)})
    spots = queries.select("q_lat", "q_lon").distinct().withColumns({"__qy": in_cell(F.col("q_lat"), cell), "__qx": in_cell(F.col("q_lon"), cell)})
    farthest = F.least(F.lit(90.0), F.greatest(F.abs(F.col("__qy") * cell), F.abs((F.col("__qy") + 1) * cell)))
    rows, cols = cells_around(F.col("__qy"), F.col("__qx"), farthest, cell, radius_km)
    around = spots.select("__qy", "__qx").distinct().withColumn("__cy", F.explode(rows)).withColumn("__cx", F.explode(cols))

    held = newest_of_each(placed.select("__cy", "__cx", "scene_id", "timestamp_utc", "det_id"), ["__cy", "__cx"], limit).drop("__r")
    sure = around.where(wholly_near(F.col("__qy"), F.col("__qx"), F.col("__cy"), F.col("__cx"), cell, radius_km))
    bound = newest_of_each(sure.join(held, ["__cy", "__cx"]), ["__qy", "__qx"], limit).where(F.col("__r") == 2 * limit)
    bound = bound.select("__qy", "__qx", F.col("timestamp_utc").alias("__ts"), F.col("det_id").alias("__id"))
    fresh = F.col("__ts").isNull() | (F.col("timestamp_utc") > F.col("__ts")) | ((F.col("timestamp_utc") == F.col("__ts")) & (F.col("__id").isNull() | (F.col("det_id") >= F.col("__id"))))
    dealt = around.join(bound, ["__qy", "__qx"], "left").join(placed, ["__cy", "__cx"]).where(fresh).select("__qy", "__qx", *columns)

    near = spots.join(dealt, ["__qy", "__qx"]).withColumn("distance_km", haversine_km(F.col("q_lat"), F.col("q_lon"), F.col("lat"), F.col("lon"))).where(in_reach(radius_km, box_only))
    one = F.struct(F.col("__r"), *columns, "distance_km")
    return newest_of_each(near, ["q_lat", "q_lon"], limit).groupBy("q_lat", "q_lon").agg(F.array_sort(F.collect_list(one)).alias("around"))


def asking(queries: DataFrame) -> DataFrame:
    """Queries that can have hits of other scenes."""
    return queries.where("q_scene is not null and q_lat is not null and q_lon is not null")


def of_others(around: str, limit: int = LIMIT) -> Column:
    """Of a place's hits the `limit` newest that are not of the query's scene."""
    return F.slice(F.filter(around, lambda d: d["scene_id"] != F.col("q_scene")), 1, limit)


def newest_lists(queries: DataFrame, detections: DataFrame, radius_km: float = RADIUS_KM, limit: int = LIMIT, box_only: bool = False, cell: float = CELL_OF_COUNTS) -> DataFrame:
    """queries (q_id, q_scene, q_lat, q_lon) with found: the newest `limit` hits of other scenes, newest first, with distance_km; no hit: no row. A query reads its place's list."""
    asked = asking(queries)
    lists = place_lists(asked, detections, radius_km, limit, box_only, cell)
    return asked.join(lists, ["q_lat", "q_lon"]).withColumn("found", of_others("around", limit)).drop("around").where(F.size("found") > 0)


def listed(lists: DataFrame) -> DataFrame:
    """A row for each hit of newest_lists(), numbered from 0 (pass_number)."""
    names = [c for c in lists.schema["found"].dataType.elementType.names if c != "__r"]
    rows = lists.select(*[c for c in lists.columns if c != "found"], F.posexplode("found").alias("pass_number", "d"))
    return rows.select(*[c for c in lists.columns if c != "found"], *[F.col(f"d.{c}").alias(c) for c in names], "pass_number")


def newest_near(queries: DataFrame, detections: DataFrame, radius_km: float = RADIUS_KM, limit: int = LIMIT) -> DataFrame:
    """The rows of newest(region_join(queries, detections)), without the join of all that are near."""
    return listed(newest_lists(queries, detections, radius_km, limit))


def overfetched_near(queries: DataFrame, detections: DataFrame, limit: int = LIMIT, radius_km: float = RADIUS_KM) -> DataFrame:
    """The rows of overfetched() for the boxes around the queries: of the newest 3 x limit of the box those within the radius, at most `limit`."""
    fetched = newest_lists(queries, detections, radius_km, 3 * limit, box_only=True)
    return listed(fetched.withColumn("found", F.slice(F.filter("found", lambda d: d["distance_km"] <= radius_km), 1, limit)))


def of_query(hits: DataFrame) -> list[str]:
    """The keys of a query's hits. Its place goes along where it is known: hits of newest_near() are laid out by it and need no other shuffle."""
    return [c for c in ("q_lat", "q_lon", "q_id") if c in hits.columns]


def in_cell(at: Column, cell: float) -> Column:
    return F.floor(at / cell).cast("int")


def wholly_near(qy: Column, qx: Column, cy: Column, cx: Column, cell: float, radius_km: float) -> Column:
    """Whether every point of the grid cell (cy, cx) lies within the radius, and the box, of every point of the cell (qy, qx)."""
    least_lat = lambda y: F.greatest(F.lit(0.0), y * cell, -(y + 1) * cell)  # noqa: E731  that nearest to the equator
    high, wide = (F.abs(qy - cy) + 1) * cell, (F.abs(qx - cx) + 1) * cell
    cos_q, cos_c = (F.cos(F.radians(least_lat(v))) for v in (qy, cy))
    part = F.pow(F.sin(F.radians(high) / 2), 2) + cos_q * cos_c * F.pow(F.sin(F.radians(wide) / 2), 2)
    farthest = F.asin(F.sqrt(F.least(part, F.lit(1.0)))) * (2 * EARTH_KM)
    box_y, box_x = F.lit(radius_km / DEGREE_KM), F.lit(radius_km) / (cos_q * DEGREE_KM + 1e-9)
    sure = 1 - 1e-9
    return (farthest <= radius_km * sure) & (high <= box_y * sure) & (wide <= box_x * sure) & (wide <= 180)


def cells_around(y: Column, x: Column, lat: Column, cell: float, radius_km: float) -> tuple[Column, Column]:
    """Arrays of the rows and columns of cells that the box of a point in the cell (y, x), whose latitude is lat, can touch."""
    half_y, half_x = half_box(lat, radius_km)
    rows = F.ceil(half_y / cell)
    cols = F.ceil(F.least(half_x, F.lit(360.0)) / cell)  # no wider than the globe
    edge = lambda v: F.greatest(F.lit(int(-180 // cell) - 1), F.least(F.lit(int(180 // cell) + 1), v)).cast("int")
    return F.sequence((y - rows).cast("int"), (y + rows).cast("int")), F.sequence(edge(x - cols), edge(x + cols))


def thinned(rows: DataFrame, by: list[str], limit: int) -> DataFrame:
    """The earliest rows (scene_id, ts) of each place that a count up to `limit`, as of any time and without any one scene, can need.

    Of a scene the `limit` earliest rows, and of these the 2 * limit earliest of the place: whoever counts a row that is left out has counted
    `limit` earlier ones, at most `limit` of the rest being of the scene that isn't counted. Tasks keep as many before the shuffle.
    """
    first = lambda *keys: F.row_number().over(W.partitionBy(*by, *keys).orderBy("ts"))
    some = rows.withColumn("__r", first("scene_id")).where(F.col("__r") <= limit)
    return some.withColumn("__r", first()).where(F.col("__r") <= 2 * limit).drop("__r")


def capped_count(queries: DataFrame, detections: DataFrame, radius_km: float = RADIUS_KM, limit: int = LIMIT, as_of: bool = False, cell: float = CELL_OF_COUNTS) -> DataFrame:
    """q_id and n: detections of other scenes around the query points (q_id, q_scene, q_lat, q_lon, q_ts), at most `limit`; none: no row.

    as_of counts only detections from before the query. No row is made for a query and a detection where the count is sure without: each
    cell keeps its earliest detections (thinned()), and all queries of a cell share those of the cells that lie wholly within the radius. A
    query that these bring to the limit is done. The others, of which a cell has few since its own detections count for each other, test the
    detections of the cells on the border. Rows thus grow with the detections and the cells that hold queries, not with the density's square.
    """
    there = F.col("scene_id").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    placed = detections.where(there & F.col("ts").isNotNull() if as_of else there).select("scene_id", "lat", "lon", "ts", in_cell(F.col("lat"), cell).alias("__cy"), in_cell(F.col("lon"), cell).alias("__cx"))
    held = thinned(placed.select("__cy", "__cx", "scene_id", "ts"), ["__cy", "__cx"], limit).groupBy("__cy", "__cx").agg(F.collect_list(F.struct("ts", "scene_id")).alias("__held"))
    asked = queries.where("q_lat is not null and q_lon is not null").withColumns({"__qy": in_cell(F.col("q_lat"), cell), "__qx": in_cell(F.col("q_lon"), cell)})
    sure = wholly_near(F.col("__qy"), F.col("__qx"), F.col("__cy"), F.col("__cx"), cell, radius_km)

    farthest = F.least(F.lit(90.0), F.greatest(F.abs(F.col("__qy") * cell), F.abs((F.col("__qy") + 1) * cell)))
    rows, cols = cells_around(F.col("__qy"), F.col("__qx"), farthest, cell, radius_km)
    within = asked.select("__qy", "__qx").distinct().withColumn("__cy", F.explode(rows)).withColumn("__cx", F.explode(cols)).where(sure)
    shared = within.join(held, ["__cy", "__cx"]).select("__qy", "__qx", F.explode("__held").alias("h")).select("__qy", "__qx", "h.ts", "h.scene_id")
    shared = thinned(shared, ["__qy", "__qx"], limit).groupBy("__qy", "__qx").agg(F.collect_list(F.struct("ts", "scene_id")).alias("__held"))
    counts = lambda h: (h["scene_id"] != F.col("q_scene")) & (h["ts"] < F.col("q_ts") if as_of else F.lit(True))
    met = asked.join(shared, ["__qy", "__qx"], "left").withColumn("__known", F.coalesce(F.size(F.filter("__held", counts)), F.lit(0))).drop("__held")

    y, x = half_box(F.col("q_lat"), radius_km)
    rows, cols = cells_around(F.col("__qy"), F.col("__qx"), F.col("q_lat"), cell, radius_km)
    border = met.where(F.col("__known") < limit).withColumn("__cy", F.explode(rows)).withColumn("__cx", F.explode(cols)).where(~sure)
    near = F.col("lat").between(F.col("q_lat") - y, F.col("q_lat") + y) & F.col("lon").between(F.col("q_lon") - x, F.col("q_lon") + x) & (F.col("scene_id") != F.col("q_scene"))
    near &= haversine_km(F.col("q_lat"), F.col("q_lon"), F.col("lat"), F.col("lon")) <= radius_km
    tested = border.join(placed, ["__cy", "__cx"]).where(near & (F.col("ts") < F.col("q_ts")) if as_of else near).groupBy("q_id").agg(F.count("*").alias("__more"))
    total = met.groupBy("q_id").agg(F.sum("__known").alias("__known")).join(tested, "q_id", "left")
    return total.select("q_id", F.least(F.col("__known") + F.coalesce("__more", F.lit(0)), F.lit(limit)).cast("int").alias("n")).where("n > 0")


def history_count(detections: DataFrame, radius_km: float = RADIUS_KM, limit: int = LIMIT, as_of: bool = False) -> DataFrame:
    """scene_id and its history: detections of other scenes near its first detection, at most `limit`. A scene without any has no row."""
    return capped_count(first_points(detections), detections, radius_km, limit, as_of).select(F.col("q_id").alias("scene_id"), F.col("n").alias("history_count"))


def region_summary(hits: DataFrame) -> DataFrame:
    """Per query: distinct scenes, detections, first and last time, and whether it recurs."""
    by = hits.groupBy(*of_query(hits)).agg(
        F.count_distinct("scene_id").alias("total_passes"),
        F.count("*").alias("anomaly_count"),
        F.min("timestamp_utc").alias("first_seen"),
        F.max("timestamp_utc").alias("last_seen"),
        (F.count("*") >= 2).alias("is_recurring"),
    )
    return by.drop("q_lat", "q_lon")


def type_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy(*of_query(hits), "type").agg(F.count("*").alias("n"), F.min("pass_number").alias("first_at"))


def recurring_types(hits: DataFrame) -> DataFrame:
    """Types seen twice or more in a region, joined in the order of first appearance."""
    often = type_counts(hits).where("n >= 2")
    by = often.groupBy(*of_query(often)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_at", "type"))), lambda t: t["type"]), ", ").alias("recurring_types"))
    return by.drop("q_lat", "q_lon")


def risk_zone_join(detections: DataFrame, zones: DataFrame, most: int = 256) -> DataFrame:
    """detections with the first zone, in the declared order, whose bounds hold them; null outside all.

    Up to `most` zones (they are counted) travel as one row to every task and the detections stay where they are. More zones are dealt to
    grid cells, and the first hit is taken per detection.
    """
    names = ["zone_order", "zone", "lat_min", "lat_max", "lon_min", "lon_max"]
    if zones.count() <= most:
        one = zones.agg(F.array_sort(F.collect_list(F.struct(*names))).alias("__zones"))
        holds = lambda z: F.col("lat").between(z["lat_min"], z["lat_max"]) & F.col("lon").between(z["lon_min"], z["lon_max"])
        return detections.join(F.broadcast(one)).withColumn("zone", F.get(F.filter("__zones", holds), F.lit(0))["zone"]).drop("__zones")
    span = lambda a, z: F.explode(F.sequence(F.floor(a).cast("int"), F.floor(z).cast("int")))
    dealt = zones.select(*names).withColumn("__y", span("lat_min", "lat_max")).withColumn("__x", span("lon_min", "lon_max"))
    placed = detections.withColumns({"__y": F.floor("lat").cast("int"), "__x": F.floor("lon").cast("int")})
    hits = placed.select("det_id", "lat", "lon", "__y", "__x").join(dealt, ["__y", "__x"]).where("lat between lat_min and lat_max and lon between lon_min and lon_max")
    first = hits.groupBy("det_id").agg(F.min_by("zone", "zone_order").alias("zone"))
    return detections.join(first, "det_id", "left")


def split_track(tracks: DataFrame) -> DataFrame:
    """tracks (track, i, lat, lon) with segment: a new one where consecutive longitudes jump by more than 180 degrees."""
    order = W.partitionBy("track").orderBy("i")
    jump = F.coalesce((F.abs(F.col("lon") - F.lag("lon").over(order)) > 180).cast("int"), F.lit(0))
    return tracks.withColumn("__jump", jump).withColumn("segment", F.sum("__jump").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("__jump")
