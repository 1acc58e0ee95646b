"""Spectral facts of detections and scenes over pixel rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passwatch.functions.rules import detection_quality
from passwatch.functions.text import fixed, percent
from passwatch.operators.detect import clamp_bbox
from passwatch.operators.raster import BANDS

# Names and readings of the six bands, notes of the types.
BAND_NAMES = ("B2 (Blue)", "B3 (Green)", "B4 (Red)", "B8 (NIR)", "B11 (SWIR1)", "B12 (SWIR2)")
READINGS = (
    ("possible foam/wake scatter", "ocean absorption typical"),
    ("bright object or cloud", "ocean typical"),
    ("painted metal surface or dust", "typical"),
    ("wake or boundary signature", "absorbing (water/ocean typical)"),
    ("metallic hull or man-made material", "water (expected low SWIR)"),
    ("steel/alloy surface", "ocean (expected low SWIR)"),
)
TYPE_NOTES = {
    "ship": "Consistent with vessel hull reflectance profile.",
    "airplane": "Consistent with aluminium fuselage SWIR signature.",
    "harbor": "Consistent with concrete/steel port infrastructure.",
    "storage-tank": "Consistent with metallic tank surface reflectance.",
}
PART = 64  # rows and columns of a cell of the pixel join
SIDE = 640  # rows and columns of a tile
BOXES = 50_000  # boxes of a tile that a task takes
TABLE_FROM = 1 << 25  # pairs of a box and a pixel from which a summed-area table is made


def pixels_in_bbox(boxes: DataFrame, pixels: DataFrame, scene: str = "scene_no", part: int = PART) -> DataFrame:
    """Every pixel in the margin box of a detection, with in_box for those in the box itself.

    Boxes are dealt to the cells that their margins touch, so that the join has equal keys (scene and cell) on both sides.
    """
    b = margins(boxes)
    cells = lambda a, z: F.sequence((F.col(a) / part).cast("int"), ((F.col(z) - 1) / part).cast("int"))
    dealt = b.withColumn("cy", F.explode(cells("by1", "by2"))).withColumn("cx", F.explode(cells("bx1", "bx2")))
    placed = pixels.withColumns({"cy": (F.col("y") / part).cast("int"), "cx": (F.col("x") / part).cast("int")})
    # boxes are many rows after they are dealt, which no estimate from their table's size tells: neither side goes through the driver
    hit = dealt.join(placed.hint("merge"), [scene, "cy", "cx"]).where("y >= by1 and y < by2 and x >= bx1 and x < bx2")
    return hit.withColumn("in_box", F.expr("y >= y1 and y < y2 and x >= x1 and x < x2"))


def margins(boxes: DataFrame) -> DataFrame:
    """boxes, clamped, with the corners bx1, by1, bx2, by2 of their margin boxes."""
    b = clamp_bbox(boxes)
    margin = F.greatest(F.lit(30), (F.col("x2") - F.col("x1")) * 2)
    return b.withColumns({"bx1": F.greatest(F.lit(0), F.col("x1") - margin), "bx2": F.least(F.lit(SIDE), F.col("x2") + margin), "by1": F.greatest(F.lit(0), F.col("y1") - margin), "by2": F.least(F.lit(SIDE), F.col("y2") + margin)})


def box_sums(corners: np.ndarray, y: np.ndarray, x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each box (x1, y1, x2, y2) the sum of each column of values over the places (y, x) in it.

    Few places or boxes are compared in blocks; else a summed-area table of the tile is made for each column, and a box costs its four corners.
    """
    x1, y1, x2, y2 = corners.T
    out = np.zeros((len(corners), values.shape[1]))
    if len(corners) * len(y) <= TABLE_FROM:
        step = max(1, (1 << 22) // max(len(y), 1))
        for a in range(0, len(corners), step):
            z = slice(a, a + step)
            inside = (y >= y1[z, None]) & (y < y2[z, None]) & (x >= x1[z, None]) & (x < x2[z, None])
            out[z] = inside.astype(float) @ values
        return out
    for k in range(values.shape[1]):
        table = np.zeros((SIDE + 1, SIDE + 1), np.longdouble)  # longer than the sums that it holds, so that differences lose nothing
        table[y + 1, x + 1] = values[:, k]
        table = table.cumsum(axis=0).cumsum(axis=1)
        out[:, k] = table[y2, x2] - table[y1, x2] - table[y2, x1] + table[y1, x1]
    return out


def region_band_means(boxes: DataFrame, pixels: DataFrame, scene: str = "scene_no", exclude_target: bool = False, block: int = BOXES) -> DataFrame:
    """Per detection: mean of each band in the box (t_*) and in the margin box (g_*; the box itself belongs to it unless excluded), and contrast (c_*).

    A contrast is rounded to 12 digits, so that one at a limit of the rules does not hang on the order of its sums. A box without a pixel has no
    row. No row is made for a box and a pixel: the pixels of a tile, SIDE x SIDE at most since repeated ones are added up before, meet its boxes
    once, and box_sums() does the rest. A tile with more than `block` boxes is dealt to several tasks.
    """
    parts = [e for b in BANDS for e in (F.sum(b).alias(f"s_{b}"), F.count(b).alias(f"n_{b}"))]
    sums = pixels.where(f"y >= 0 and y < {SIDE} and x >= 0 and x < {SIDE}").groupBy(scene, "y", "x").agg(*parts)
    held = margins(boxes).select("det_id", scene, "x1", "y1", "x2", "y2", "bx1", "by1", "bx2", "by2")
    blocks = held.groupBy(scene).agg(F.ceil(F.count("*") / block).cast("int").alias("__n"))
    held = held.join(blocks, scene).withColumn("__block", F.pmod(F.xxhash64("det_id"), F.col("__n")).cast("int")).drop("__n")
    sums = sums.join(blocks, scene).withColumn("__block", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")

    def means(pixel: pa.Table, box: pa.Table) -> pa.Table:
        ids, of = box.column("det_id"), lambda table, *names: np.stack([table.column(c).to_numpy() for c in names], axis=1)  # no frames: most tiles are small
        n = of(pixel, *(f"n_{b}" for b in BANDS)).astype(float)
        total = np.where(n > 0, of(pixel, *(f"s_{b}" for b in BANDS)), 0.0)
        odd = ~np.isfinite(total)
        values = np.concatenate([np.where(odd, 0.0, total), n, odd], axis=1)
        y, x = (pixel.column(c).to_numpy().astype(int) for c in ("y", "x"))
        inner, outer = (box_sums(of(box, *c).astype(int), y, x, values) for c in (("x1", "y1", "x2", "y2"), ("bx1", "by1", "bx2", "by2")))
        if exclude_target:
            outer = outer - inner
        out = {"det_id": ids}
        for name, found in (("t", inner), ("g", outer)):
            count = found[:, 6:12]
            mean = np.divide(found[:, :6], count, out=np.zeros_like(count), where=count > 0)
            mean[found[:, 12:] > 0] = np.nan
            for k, b in enumerate(BANDS):
                out[f"{name}_{b}"] = pa.array(mean[:, k], mask=count[:, k] == 0)
        return pa.table(out)

    schema = f"det_id {boxes.schema['det_id'].dataType.simpleString()}, " + ", ".join(f"{p}_{b} double" for p in "tg" for b in BANDS)
    found = sums.groupBy(scene, "__block").cogroup(held.groupBy(scene, "__block")).applyInArrow(means, schema)
    return found.where("t_b2 is not null").withColumns({f"c_{b}": F.round(F.col(f"t_{b}") - F.col(f"g_{b}"), 12) for b in BANDS})


def contrasts() -> Column:
    return F.array(*[F.col(f"c_{b}") for b in BANDS])


def total_contrast() -> Column:
    return sum((F.abs(F.col(f"c_{b}")) for b in BANDS), F.lit(1e-8))


def band_contribution(means: DataFrame) -> DataFrame:
    """One row per detection and band: mean, contrast and share of the contrast, rounded to 3."""
    one = [F.struct(F.lit(i).alias("band_idx"), F.lit(BAND_NAMES[i]).alias("band"), F.round(f"t_{b}", 3).alias("mean_value"), F.round(f"c_{b}", 3).alias("contrast"), F.round(F.abs(F.col(f"c_{b}")) / total_contrast(), 3).alias("score"), band_interpretation(i, F.col(f"c_{b}")).alias("interpretation")) for i, b in enumerate(BANDS)]
    return means.select("det_id", F.inline(F.array(*one)))


def band_interpretation(i: int, contrast: Column) -> Column:
    sign = F.when(contrast > 0.02, "elevated").when(contrast < -0.02, "suppressed").otherwise("neutral")
    return F.concat(F.lit(f"{BAND_NAMES[i]}: "), sign, F.lit(" — "), F.when(contrast > 0.02, READINGS[i][0]).otherwise(READINGS[i][1]))


def dominant_bands(contributions: DataFrame, n: int = 2) -> DataFrame:
    """The strongest bands of each detection, earlier bands first among equals."""
    one = F.struct((-F.col("score")).alias("s"), "band_idx", "band")
    return contributions.groupBy("det_id").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(one)), 1, n), lambda x: x["band"]), ", ").alias("dominant_bands"))


def steady(x: Column, digits: int) -> Column:
    """Rounded so that a tie goes up whatever the order of the sums behind it."""
    return F.round(x + 1e-9, digits)


def spectral_strength() -> Column:
    return F.least(F.greatest((F.abs("c_b8") + F.abs("c_b11") + F.abs("c_b12")) / 3 * 3.0, F.lit(0.0)), F.lit(1.0))


def breakdown() -> dict[str, Column]:
    """The scores of a detection by its conf and contrasts."""
    s = spectral_strength()
    return {"model_score": steady(F.col("conf"), 3), "spectral_strength": steady(s, 3), "combined_estimate": steady((F.col("conf") + s) / 2, 3), "quality": detection_quality(F.col("conf"), s)}


def confidence_breakdown(means: DataFrame, boxes: DataFrame) -> DataFrame:
    """det_id, model_score, spectral_strength, combined_estimate and quality."""
    return means.join(boxes.select("det_id", "conf"), "det_id").select("det_id", *(c.alias(n) for n, c in breakdown().items()))


def signature() -> Column:
    """The text of a detection's contrasts and type."""
    swir = (F.col("c_b11") > 0.05) | (F.col("c_b12") > 0.05)
    nir = F.col("c_b8") > 0.03
    visible = (F.col("c_b2") > 0.05) | (F.col("c_b3") > 0.05) | (F.col("c_b4") > 0.05)
    parts = F.concat_ws(
        "; ",
        F.when(swir, "strong SWIR signature (metallic/man-made material confirmed)"),
        F.when(nir, "NIR boundary contrast (consistent with moving vessel wake)"),
        F.when(visible & ~swir, "visible-band dominant (painted surface or cloud contamination)"),
    )
    note = F.create_map(*[F.lit(x) for kv in TYPE_NOTES.items() for x in kv])[F.col("type")]
    text = F.when(parts == "", "weak spectral contrast across all bands (low-confidence detection)").otherwise(parts)
    return F.concat_ws(" ", text, note)


def spectral_signature(means: DataFrame, boxes: DataFrame) -> DataFrame:
    return means.join(boxes.select("det_id", "type"), "det_id").select("det_id", signature().alias("signature"))


def scene_band_stats(pixels: DataFrame, scene: str = "scene_no") -> DataFrame:
    """Mean of b3 and population deviation of every band."""
    return pixels.groupBy(scene).agg(F.round(F.avg("b3"), 6).alias("b3_mean"), *[F.round(F.stddev_pop(b), 6).alias(f"std_{b}") for b in BANDS])


def band_quality(pixels: DataFrame, scene: str = "scene_no") -> DataFrame:
    """Quality of each band from its deviation, rounded to 2, and their mean."""
    q = {b: F.round(F.least(F.greatest(1.0 - F.stddev_pop(b) * 2.0, F.lit(0.2)), F.lit(1.0)), 2) for b in BANDS}
    out = pixels.groupBy(scene).agg(*[c.alias(f"q_{b}") for b, c in q.items()])
    return out.withColumn("overall", F.round(sum((F.col(f"q_{b}") for b in BANDS), F.lit(0.0)) / 6, 2))


def factors() -> Column:
    """The doubts about a detection by its contrasts and conf, and its scene's statistics."""
    weak = (F.abs("c_b11") + F.abs("c_b12")) / 2 < 0.03
    text = F.concat_ws(
        "; ",
        F.when(F.col("b3_mean") > 0.55, F.concat(F.lit("Cloud contamination (B3 mean="), fixed("b3_mean", 2), F.lit(" > 0.55 threshold)"))),
        F.when(F.col("conf") < 0.55, F.concat(F.lit("Low model confidence ("), percent("conf"), F.lit(" < 55% threshold)"))),
        F.when(weak, "Weak SWIR contrast — no metallic signature confirmation"),
        F.when(F.col("std_b8") > 0.2, F.concat(F.lit("High NIR variability (std="), fixed("std_b8", 2), F.lit(") — possible sun glint"))),
    )
    return F.when(text == "", "No significant uncertainty factors identified").otherwise(text)


def uncertainty_factors(means: DataFrame, boxes: DataFrame, stats: DataFrame, scene: str = "scene_no") -> DataFrame:
    """det_id and its factors, joined; stats: scene_band_stats()."""
    return means.join(boxes.select("det_id", "conf", scene), "det_id").join(stats, scene).select("det_id", factors().alias("factors"))


def uncertainty_report(scenes: DataFrame, detections: DataFrame) -> DataFrame:
    """Sensing uncertainty of each scene from its cloud cover and detections (without a tile)."""
    low = detections.groupBy("scene_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce("conf", F.lit(1.0)) < 0.55).alias("low_conf"))
    s = scenes.join(low, "scene_id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "low_conf": F.coalesce("low_conf", F.lit(0))})
    cloud = F.col("cloud_cover")
    visible, other = F.round(F.greatest(F.lit(0.2), 1.0 - cloud * 0.8), 2), F.round(F.greatest(F.lit(0.2), 1.0 - cloud * 0.3), 2)
    severe, moderate, blind, weak = cloud > 0.6, (cloud > 0.3) & (cloud <= 0.6), (F.col("n") == 0) & (cloud > 0.3), F.col("low_conf") > 0
    factors = F.concat_ws(
        "; ",
        F.when(severe, F.concat(F.lit("Severe cloud cover ("), percent(cloud), F.lit(") — visible bands severely degraded"))),
        F.when(moderate, F.concat(F.lit("Moderate cloud cover ("), percent(cloud), F.lit(") — reduce confidence thresholds"))),
        F.when(blind, "Zero detections under moderate cloud — may reflect sensing limitation"),
        F.when(weak, F.concat(F.col("low_conf").cast("string"), F.lit(" low-confidence detection(s) — SWIR corroboration recommended"))),
    )
    advice = F.concat_ws(
        "; ",
        F.when(severe, "Schedule OVV for next clear pass"),
        F.when(moderate, "Lower confidence acceptance threshold by 0.10–0.15"),
        F.when(blind, "Do not classify as area-clear; re-observe when cloud clears"),
        F.when(weak, "Cross-validate low-conf detections with SWIR band analysis"),
    )
    return s.select(
        "scene_id",
        F.round(F.least(F.lit(1.0), cloud * 1.5), 2).alias("cloud_factor"),
        visible.alias("visible_quality"),
        other.alias("infrared_quality"),
        F.round((visible * 3 + other * 3) / 6, 2).alias("overall_quality"),
        F.when(factors == "", "No significant uncertainty factors — nominal sensing conditions").otherwise(factors).alias("factors"),
        F.when(factors == "", "Standard confidence thresholds apply").otherwise(advice).alias("recommendations"),
    )


def explain_batch(boxes: DataFrame, pixels: DataFrame, scene: str = "scene_no") -> DataFrame:
    """All spectral facts of every detection whose box holds pixels, with a one-line text: one join with the boxes, one with the scenes' statistics."""
    rows = boxes.select("det_id", "type", "lat", "lon", "conf", scene).join(region_band_means(boxes, pixels, scene), "det_id").join(scene_band_stats(pixels, scene), scene)
    shares = F.array(*[F.struct((-F.round(F.abs(F.col(f"c_{b}")) / total_contrast(), 3)).alias("s"), F.lit(i).alias("i"), F.lit(BAND_NAMES[i]).alias("band")) for i, b in enumerate(BANDS)])
    dominant = F.array_join(F.transform(F.slice(F.array_sort(shares), 1, 2), lambda x: x["band"]), ", ")
    out = rows.select("det_id", "type", "lat", "lon", *(c.alias(n) for n, c in breakdown().items()), dominant.alias("dominant_bands"), signature().alias("signature"), factors().alias("factors"))
    first = F.array_join(F.slice(F.split("factors", "; "), 1, 2), "; ")
    text = F.concat(F.lit("Spectral analysis ["), F.upper("type"), F.lit(" @ ("), fixed("lat", 4), F.lit("°, "), fixed("lon", 4), F.lit("°)]: "), "signature", F.lit(" Quality: "), "quality", F.lit(". Dominant bands: "), "dominant_bands", F.lit(". Uncertainty: "), first, F.lit("."))
    return out.withColumn("text", text)
