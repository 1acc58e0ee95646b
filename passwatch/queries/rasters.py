"""Queries of pixels, tiles, labels and spectral facts."""

from pyspark.sql import functions as F

from passwatch.adapters import rounded
from passwatch.functions import text
from passwatch.operators import raster, spectral
from passwatch.queries import query

BANDS = raster.BANDS
LONG = " UNION ALL ".join(f"SELECT scene_no, y, x, '{b}' AS band, max({b}) AS value FROM pixels GROUP BY scene_no, y, x" + (" HAVING max(b2) > 0.05" if b == "b2" else "") for b in BANDS)


def one_pixel(m):
    """The pixels with one row a place."""
    return m.pixels.groupBy("scene_no", "y", "x").agg(*[F.max(b).alias(b) for b in BANDS])


@query("SELECT scene_no, y, x, " + ", ".join(f"max({b}) AS {b}" for b in BANDS) + " FROM pixels GROUP BY scene_no, y, x HAVING max(b2) > 0.05")
def assemble_bands(m):
    """Long values of the six bands; dark places lack b2 and go."""
    values = one_pixel(m).select("scene_no", "y", "x", F.inline(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("value")) for b in BANDS])))
    return raster.assemble_bands(values.where("band <> 'b2' or value > 0.05"))


@query("SELECT scene_no, x, y, " + ", ".join(f"least(greatest(({b} * 20000 - 4000) / 10000.0E0, 0), 1) AS {b}" for b in BANDS) + " FROM pixels")
def normalize_reflectance(m):
    return raster.normalize_reflectance(m.pixels.withColumns({b: F.col(b) * 20000 - 4000 for b in BANDS}))


@query("""SELECT scene_no, x, y, round(least(greatest(0.25E0 * b4 + 0.45E0 * b3 + 0.30E0 * b2, 0), 1), 6) AS b8, round(least(greatest(0.80E0 * b4 + 0.30E0 * b3 - 0.20E0 * b2, 0), 1), 6) AS b11,
 round(least(greatest(0.70E0 * b4 + 0.20E0 * b3 - 0.10E0 * b2, 0), 1), 6) AS b12 FROM pixels""")
def band_math(m):
    return raster.band_math(m.pixels).select("scene_no", "x", "y", *[F.round(b, 6).alias(b) for b in ("b8", "b11", "b12")])


@query("SELECT scene_no, round(avg(CASE WHEN b3 > 0.8 THEN 1.0E0 ELSE 0.0E0 END), 6) AS cloud_cover FROM pixels GROUP BY scene_no")
def cloud_cover(m):
    return raster.cloud_cover(m.pixels)


@query("""WITH t AS (SELECT CAST(unnest(range(0, 12)) AS INT) AS t) SELECT a.t AS ty, b.t AS tx, count(*) AS n, sum(p.y - a.t * 56 + (p.x - b.t * 56) * 64) AS place
 FROM pixels p JOIN t a ON p.y >= a.t * 56 AND p.y < a.t * 56 + 64 JOIN t b ON p.x >= b.t * 56 AND p.x < b.t * 56 + 64 GROUP BY a.t, b.t""")
def tile_scene(m):
    cut = raster.tile_scene(m.pixels.select("scene_no", "y", "x"), size=64, overlap=8)
    return cut.groupBy("ty", "tx").agg(F.count("*").alias("n"), F.sum(F.col("py") + F.col("px") * 64).alias("place"))


#: A 40 x 40 grid a scene from the pixels' means.
COARSE = "g AS (SELECT scene_no, CAST(y // 16 AS INT) AS y, CAST(x // 16 AS INT) AS x, avg(b11) AS value FROM pixels GROUP BY 1, 2, 3)"


def coarse(m, band="b11"):
    return m.pixels.groupBy("scene_no", (F.col("y") / 16).cast("int").alias("y"), (F.col("x") / 16).cast("int").alias("x")).agg(F.avg(band).alias("value"))


@query(f"""WITH {COARSE}, t AS (SELECT CAST(unnest(range(0, 80)) AS INT) AS t), s AS (SELECT t, greatest(0, least(39, (t + 0.5E0) * 0.5E0 - 0.5E0)) AS p FROM t),
w AS (SELECT s.t, k.k, 1 - abs(s.p - k.k) AS w FROM s JOIN (SELECT CAST(unnest(range(0, 40)) AS INT) AS k) k ON abs(s.p - k.k) < 1)
SELECT g.scene_no, a.t AS y, b.t AS x, round(sum(g.value * a.w * b.w) + 1e-9, 6) AS value FROM g JOIN w a ON a.k = g.y JOIN w b ON b.k = g.x GROUP BY 1, 2, 3""")
def resize_bilinear(m):
    """20 m to 10 m: places without a source pixel count as dark."""
    return raster.resize_bilinear(coarse(m), 40, 40, 80, 80).withColumn("value", F.round(F.col("value") + 1e-9, 6))


UP = """t AS (SELECT CAST(unnest(range(0, 80)) AS INT) AS t), s AS (SELECT t, greatest(0, least(39, (t + 0.5E0) * 0.5E0 - 0.5E0)) AS p FROM t),
w AS (SELECT s.t, k.k, 1 - abs(s.p - k.k) AS w FROM s JOIN (SELECT CAST(unnest(range(0, 40)) AS INT) AS k) k ON abs(s.p - k.k) < 1)"""


@query(f"""WITH f AS (SELECT scene_no, CAST(y // 8 AS INT) AS y, CAST(x // 8 AS INT) AS x, {", ".join(f"avg({b}) AS {b}" for b in BANDS[:4])} FROM pixels GROUP BY 1, 2, 3),
g AS (SELECT scene_no, CAST(y // 16 AS INT) AS y, CAST(x // 16 AS INT) AS x, avg(b11) AS b11, avg(b12) AS b12 FROM pixels GROUP BY 1, 2, 3), {UP},
u AS (SELECT g.scene_no, a.t AS y, b.t AS x, sum(g.b11 * a.w * b.w) AS b11, sum(g.b12 * a.w * b.w) AS b12 FROM g JOIN w a ON a.k = g.y JOIN w b ON b.k = g.x GROUP BY 1, 2, 3)
SELECT f.scene_no, f.y, f.x, {", ".join(f"round({b} + 1e-9, 6) AS {b}" for b in BANDS)} FROM f JOIN u ON u.scene_no = f.scene_no AND u.y = f.y AND u.x = f.x""")
def stack_bands(m):
    """Four fine bands at 80 x 80 and two coarse ones at 40 x 40, on the fine grid."""
    at = [(F.col("y") / 8).cast("int").alias("y"), (F.col("x") / 8).cast("int").alias("x")]
    fine = m.pixels.groupBy("scene_no", *at).agg(*[F.avg(b).alias(b) for b in BANDS[:4]])
    fine = fine.select("scene_no", "y", "x", F.inline(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("value")) for b in BANDS[:4]])))
    low = coarse(m, "b11").withColumn("band", F.lit("b11")).unionByName(coarse(m, "b12").withColumn("band", F.lit("b12")))
    return raster.stack_bands(fine, low, 80, 80).select("scene_no", "y", "x", *[F.round(F.col(b) + 1e-9, 6).alias(b) for b in BANDS])


#: Cells of 8 x 8 tiles of whole 256ths, so that float32 sums are exact.
CELLS = f"""cells AS (SELECT scene_no || '_' || CAST(y // 80 AS INT) || '_' || CAST(x // 80 AS INT) AS scene_id, CAST(y // 10 % 8 AS INT) AS py, CAST(x // 10 % 8 AS INT) AS px,
 {", ".join(f"CAST(floor(avg({b}) * 256 + 1e-9) AS BIGINT) AS {b}" for b in BANDS)} FROM pixels GROUP BY 1, 2, 3)"""


def tile_frames(m):
    """scene_id, h, w, bands: pixels as 8 x 8 tiles of float32 bytes, in whole 256ths; an empty cell is dark.

    Pixels are dealt by tile once; their cells and tiles are made where they lie.
    """
    tile = ("scene_no", "ty", "tx")
    cell = [(F.col("y") / 80).cast("int").alias("ty"), (F.col("x") / 80).cast("int").alias("tx"), (F.col("y") / 10 % 8).cast("int").alias("py"), (F.col("x") / 10 % 8).cast("int").alias("px")]
    dealt = m.pixels.select("scene_no", *cell, *BANDS).repartition(*tile)
    grid = dealt.groupBy(*tile, "py", "px").agg(*[F.floor(F.avg(b) * 256 + 1e-9).alias(b) for b in BANDS])
    tiles = grid.groupBy(*tile).agg(F.collect_list(F.struct((F.col("py") * 8 + F.col("px")).alias("at"), *BANDS)).alias("cells"))
    return packed(tiles.select(F.concat_ws("_", F.col("scene_no").cast("string"), F.col("ty").cast("string"), F.col("tx").cast("string")).alias("scene_id"), "cells"))


@query(f"""WITH {CELLS} SELECT scene_id, CAST(b AS INT) AS band_no, sum([{", ".join(BANDS)}][b + 1] * (py * 8 + px))::BIGINT AS place, sum([{", ".join(BANDS)}][b + 1])::BIGINT AS total
 FROM cells CROSS JOIN (SELECT unnest(range(0, 6)) AS b) GROUP BY scene_id, b""")
def batch_tensor(m):
    """Every tile's tensor, band by band: its 256ths, and their sum by place."""

    def planes(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            sizes = pd.Series(list(zip(b.h, b.w)))
            for (h, w), at in sizes.groupby(sizes).groups.items():  # tiles of one size are one tensor
                tiles = np.stack([np.frombuffer(v, np.float32).reshape(h, w, 6) for v in b.bands.iloc[at]])
                plane = np.rint(raster.batch_tensor(tiles).reshape(len(at), 6, -1) * 256).astype(np.int64)
                yield pd.DataFrame({"scene_id": np.repeat(b.scene_id.iloc[at].to_numpy(object), 6), "band_no": np.tile(np.arange(6, dtype=np.int32), len(at)), "place": (plane @ np.arange(h * w)).ravel(), "total": plane.sum(axis=2).ravel()})

    return tile_frames(m).mapInPandas(planes, "scene_id string, band_no int, place long, total long")


def packed(tiles):
    """cells (place in an 8 x 8 tile, six bands in 256ths) as float32 bytes; a batch of tiles is one array."""
    import numpy as np
    import pyarrow as pa

    def pack(batches):
        for b in batches:
            cells, n = b.column("cells"), len(b)
            held = cells.flatten()
            of = np.repeat(np.arange(n), np.diff(cells.offsets.to_numpy()))
            values = np.zeros((n * 64, 6), np.float32)
            values[of * 64 + held.field("at").to_numpy()] = np.stack([held.field(c).to_numpy() for c in BANDS], axis=1) / 256
            bands = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * (64 * 6 * 4)), pa.py_buffer(values)])
            yield pa.record_batch([b.column("scene_id"), *(pa.array(np.full(n, 8, np.int32)) for _ in "hw"), bands], ["scene_id", "h", "w", "bands"])

    return tiles.mapInArrow(pack, "scene_id string, h int, w int, bands binary")


def _mean_detector():
    import numpy as np

    def model(tensor):
        means = tensor[0].mean(axis=(1, 2))
        return np.array([[[4], [4], [8], [8], [means[3]], [means[4]], [means[5]], [means[0]]]], np.float32)

    return model


CLAMPED = "c AS (SELECT * EXCLUDE (x1, y1, x2, y2), greatest(0, least(x1, 639)) AS x1, greatest(0, least(y1, 639)) AS y1, greatest(greatest(0, least(x1, 639)) + 1, least(x2, 640)) AS x2, greatest(greatest(0, least(y1, 639)) + 1, least(y2, 640)) AS y2 FROM boxes)"
HIT = f"""{CLAMPED}, k AS (SELECT *, greatest(30, (x2 - x1) * 2) AS g FROM c), hit AS (SELECT k.det_id, k.type, k.conf, k.scene_no, p.b2, p.b3, p.b4, p.b8, p.b11, p.b12, p.y >= k.y1 AND p.y < k.y2 AND p.x >= k.x1 AND p.x < k.x2 AS in_box
 FROM k JOIN pixels p ON p.scene_no = k.scene_no AND p.y >= greatest(0, y1 - g) AND p.y < least(640, y2 + g) AND p.x >= greatest(0, x1 - g) AND p.x < least(640, x2 + g))"""
MEANS = f"""{HIT}, m1 AS (SELECT det_id, any_value(type) AS type, any_value(conf) AS conf, any_value(scene_no) AS scene_no, {', '.join(f'avg({b}) FILTER (in_box) AS t_{b}, avg({b}) AS g_{b}' for b in BANDS)} FROM hit GROUP BY det_id),
means AS (SELECT *, {', '.join(f'round(t_{b} - g_{b}, 12) AS c_{b}' for b in BANDS)}, abs(t_b2 - g_b2) + abs(t_b3 - g_b3) + abs(t_b4 - g_b4) + abs(t_b8 - g_b8) + abs(t_b11 - g_b11) + abs(t_b12 - g_b12) + 1e-8 AS total FROM m1 WHERE t_b2 IS NOT NULL)"""
STRENGTH = "least(greatest(abs(c_b8) + abs(c_b11) + abs(c_b12), 0), 1)"


def means(m):
    return spectral.region_band_means(m.boxes, m.pixels)


@query(f"WITH {HIT} SELECT det_id, count(*) AS n, count(*) FILTER (in_box) AS inside FROM hit GROUP BY det_id")
def pixels_in_bbox(m):
    hit = spectral.pixels_in_bbox(m.boxes, m.pixels)
    return hit.groupBy("det_id").agg(F.count("*").alias("n"), F.count_if("in_box").alias("inside"))


#: A mean may lie on a tie of its last digit, where the order of its sum decides; both sides move it by 1e-9.
@query(f"WITH {MEANS} SELECT det_id, {', '.join(f'round(t_{b} + 1e-9, 6) AS t_{b}, round(c_{b} + 1e-9, 6) AS c_{b}' for b in BANDS)} FROM means")
def region_band_means(m):
    return means(m).select("det_id", *[F.round(F.col(f"{p}_{b}") + 1e-9, 6).alias(f"{p}_{b}") for b in BANDS for p in ("t", "c")])


#: Shares are compared to six digits: their last rounded digit may differ in the order of sums.
@query(f"WITH {MEANS} SELECT det_id, {', '.join(f'round(abs(c_{b}) / total, 6) AS s_{b}' for b in BANDS)} FROM means")
def band_contribution(m):
    return means(m).select("det_id", *[F.round(F.abs(F.col(f"c_{b}")) / spectral.total_contrast(), 6).alias(f"s_{b}") for b in BANDS])


READ = [f"'{n}: ' || CASE WHEN c_{b} > 0.02 THEN 'elevated — {up}' WHEN c_{b} < -0.02 THEN 'suppressed — {down}' ELSE 'neutral — {down}' END AS r_{b}" for n, b, (up, down) in zip(spectral.BAND_NAMES, BANDS, spectral.READINGS)]


@query(f"WITH {MEANS} SELECT det_id, {', '.join(READ)} FROM means")
def band_interpretation(m):
    return means(m).select("det_id", *[spectral.band_interpretation(i, F.col(f"c_{b}")).alias(f"r_{b}") for i, b in enumerate(BANDS)])


UNPIVOT = " UNION ALL ".join(f"SELECT det_id, {i} AS i, '{n}' AS band, round(abs(c_{b}) / total, 3) AS s FROM means" for i, (n, b) in enumerate(zip(spectral.BAND_NAMES, BANDS)))


DOMINANT = f"u AS ({UNPIVOT}), r AS (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY s DESC, i) AS r FROM u), dominant AS (SELECT det_id, string_agg(band, ', ' ORDER BY r) AS dominant_bands FROM r WHERE r <= 2 GROUP BY det_id)"


@query(f"WITH {MEANS}, {DOMINANT} SELECT * FROM dominant")
def dominant_bands(m):
    return spectral.dominant_bands(spectral.band_contribution(means(m)))


SCORES = f"scores AS (SELECT det_id, round(conf + 1e-9, 3) AS model_score, round({STRENGTH} + 1e-9, 3) AS spectral_strength, round((conf + {STRENGTH}) / 2 + 1e-9, 3) AS combined_estimate FROM means)"
GRADES = f"grades AS (SELECT det_id, CASE WHEN conf >= 0.75 AND {STRENGTH} >= 0.3 THEN 'high' WHEN conf >= 0.55 OR {STRENGTH} >= 0.2 THEN 'medium' ELSE 'low' END AS quality FROM means)"


@query(f"WITH {MEANS}, {SCORES} SELECT * FROM scores")
def confidence_breakdown(m):
    return spectral.confidence_breakdown(means(m), m.boxes).drop("quality")


@query(f"WITH {MEANS}, {GRADES} SELECT * FROM grades")
def detection_quality(m):
    return spectral.confidence_breakdown(means(m), m.boxes).select("det_id", "quality")


SIGNED = f"""p AS (SELECT det_id, type, concat_ws('; ', CASE WHEN c_b11 > 0.05 OR c_b12 > 0.05 THEN 'strong SWIR signature (metallic/man-made material confirmed)' END, CASE WHEN c_b8 > 0.03 THEN 'NIR boundary contrast (consistent with moving vessel wake)' END,
 CASE WHEN (c_b2 > 0.05 OR c_b3 > 0.05 OR c_b4 > 0.05) AND NOT (c_b11 > 0.05 OR c_b12 > 0.05) THEN 'visible-band dominant (painted surface or cloud contamination)' END) AS t FROM means),
signed AS (SELECT det_id, CASE WHEN t = '' THEN 'weak spectral contrast across all bands (low-confidence detection)' ELSE t END || CASE type WHEN 'ship' THEN ' Consistent with vessel hull reflectance profile.' WHEN 'airplane' THEN ' Consistent with aluminium fuselage SWIR signature.'
 WHEN 'harbor' THEN ' Consistent with concrete/steel port infrastructure.' WHEN 'storage-tank' THEN ' Consistent with metallic tank surface reflectance.' ELSE '' END AS signature FROM p)"""


@query(f"WITH {MEANS}, {SIGNED} SELECT * FROM signed")
def spectral_signature(m):
    return spectral.spectral_signature(means(m), m.boxes)


STATS = f"stats AS (SELECT scene_no, round(avg(b3), 6) AS b3_mean, {', '.join(f'round(stddev_pop({b}), 6) AS std_{b}' for b in BANDS)} FROM pixels GROUP BY scene_no)"


@query(f"WITH {STATS} SELECT * FROM stats")
def scene_band_stats(m):
    return spectral.scene_band_stats(m.pixels)


@query(f"WITH q AS (SELECT scene_no, {', '.join(f'round(least(greatest(1 - stddev_pop({b}) * 2, 0.2), 1), 2) AS q_{b}' for b in BANDS)} FROM pixels GROUP BY scene_no) SELECT *, round(({' + '.join(f'q_{b}' for b in BANDS)}) / 6, 2) AS overall FROM q")
def band_quality(m):
    return spectral.band_quality(m.pixels)


FACTORS = f"""{STATS}, w AS (SELECT m.det_id, concat_ws('; ', CASE WHEN s.b3_mean > 0.55 THEN 'Cloud contamination (B3 mean=' || printf('%.2f', s.b3_mean) || ' > 0.55 threshold)' END,
 CASE WHEN m.conf < 0.55 THEN 'Low model confidence (' || CAST(round(m.conf * 100) AS INT) || '% < 55% threshold)' END, CASE WHEN (abs(c_b11) + abs(c_b12)) / 2 < 0.03 THEN 'Weak SWIR contrast — no metallic signature confirmation' END,
 CASE WHEN s.std_b8 > 0.2 THEN 'High NIR variability (std=' || printf('%.2f', s.std_b8) || ') — possible sun glint' END) AS t FROM means m JOIN stats s ON s.scene_no = m.scene_no),
doubts AS (SELECT det_id, CASE WHEN t = '' THEN 'No significant uncertainty factors identified' ELSE t END AS factors FROM w)"""


@query(f"WITH {MEANS}, {FACTORS} SELECT * FROM doubts")
def uncertainty_factors(m):
    return spectral.uncertainty_factors(means(m), m.boxes, spectral.scene_band_stats(m.pixels))


@query(f"""WITH d AS (SELECT scene_id, count(*) AS n, count(*) FILTER (conf < 0.55) AS low FROM detections GROUP BY scene_id),
s2 AS (SELECT s.scene_id, s.cloud_cover AS c, coalesce(d.n, 0) AS n, coalesce(d.low, 0) AS low, {rounded('greatest(0.2, 1 - s.cloud_cover * 0.8)', 2)} AS v, {rounded('greatest(0.2, 1 - s.cloud_cover * 0.3)', 2)} AS o FROM scenes s LEFT JOIN d ON d.scene_id = s.scene_id),
t AS (SELECT *, concat_ws('; ', CASE WHEN c > 0.6 THEN 'Severe cloud cover (' || CAST(round(c * 100) AS INT) || '%) — visible bands severely degraded' WHEN c > 0.3 THEN 'Moderate cloud cover (' || CAST(round(c * 100) AS INT) || '%) — reduce confidence thresholds' END,
 CASE WHEN n = 0 AND c > 0.3 THEN 'Zero detections under moderate cloud — may reflect sensing limitation' END, CASE WHEN low > 0 THEN low || ' low-confidence detection(s) — SWIR corroboration recommended' END) AS f,
 concat_ws('; ', CASE WHEN c > 0.6 THEN 'Schedule OVV for next clear pass' WHEN c > 0.3 THEN 'Lower confidence acceptance threshold by 0.10–0.15' END, CASE WHEN n = 0 AND c > 0.3 THEN 'Do not classify as area-clear; re-observe when cloud clears' END,
 CASE WHEN low > 0 THEN 'Cross-validate low-conf detections with SWIR band analysis' END) AS r FROM s2)
SELECT scene_id, {rounded('least(1, c * 1.5)', 2)} AS cloud_factor, v AS visible_quality, o AS infrared_quality, {rounded('(v * 3 + o * 3) / 6', 2)} AS overall_quality, CASE WHEN f = '' THEN 'No significant uncertainty factors — nominal sensing conditions' ELSE f END AS factors,
 CASE WHEN f = '' THEN 'Standard confidence thresholds apply' ELSE r END AS recommendations FROM t""")
def uncertainty_report(m):
    return spectral.uncertainty_report(m.scenes, m.detections)


EXPLAINED = f"""{MEANS}, {DOMINANT}, {SCORES}, {GRADES}, {SIGNED}, {FACTORS}, explained AS (SELECT b.det_id, b.type, b.lat, b.lon, scores.model_score, scores.spectral_strength, scores.combined_estimate, grades.quality, dominant.dominant_bands, signed.signature, doubts.factors
 FROM boxes b JOIN scores ON scores.det_id = b.det_id JOIN grades ON grades.det_id = b.det_id JOIN dominant ON dominant.det_id = b.det_id JOIN signed ON signed.det_id = b.det_id JOIN doubts ON doubts.det_id = b.det_id)"""


@query(f"WITH {EXPLAINED} SELECT * FROM explained")
def explain_batch(m):
    return spectral.explain_batch(m.boxes, m.pixels).drop("text")


@query(f"""WITH {EXPLAINED} SELECT det_id, 'Spectral analysis [' || upper(type) || ' @ (' || printf('%.4f', lat) || '°, ' || printf('%.4f', lon) || '°)]: ' || signature || ' Quality: ' || quality || '. Dominant bands: ' || dominant_bands ||
 '. Uncertainty: ' || array_to_string(string_split(factors, '; ')[1:2], '; ') || '.' AS text FROM explained""")
def explanation_text(m):
    return spectral.explain_batch(m.boxes, m.pixels).select("det_id", "text")


@query("SELECT CAST(unnest(range(0, 6)) AS BIGINT) AS band, unnest(['Blue', 'Green', 'Red', 'NIR', 'SWIR1', 'SWIR2']) AS short, count(*) AS n FROM pixels")
def short_band_name(m):
    names = F.inline(F.array(*[F.struct(F.lit(i).cast("bigint").alias("band"), F.lit(n).alias("name")) for i, n in enumerate(spectral.BAND_NAMES)]))
    return m.pixels.agg(F.count("*").alias("n")).select("n", names).select("band", text.short_band_name("name").alias("short"), "n")


@query("SELECT t.stem, l.det_id, l.cls FROM tiles_raw t LEFT JOIN box_labels l ON l.stem = t.stem")
def tile_label_join(m):
    return raster.tile_label_join(m.tiles_raw, m.box_labels).select("stem", "det_id", "cls")


@query("WITH p AS (SELECT t.stem, count(l.det_id) AS n FROM tiles_raw t LEFT JOIN box_labels l ON l.stem = t.stem GROUP BY t.stem) SELECT count(*) AS tiles, count(*) FILTER (n > 0) AS with_objects, CAST(sum(n) AS BIGINT) AS objects, round(sum(n) / greatest(count(*), 1), 6) AS per_tile FROM p")
def dataset_stats(m):
    return raster.dataset_stats(m.tiles_raw, m.box_labels)


@query("SELECT stem, CASE WHEN stem < 1500 THEN 'train' ELSE 'val' END AS split FROM tiles_raw WHERE stem < 1800")
def split_train_val(m):
    return raster.split_train_val(m.tiles_raw.select("stem"), 1500, 1800)
