"""Band means of boxes against the join of all pixels."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from passwatch.operators import spectral
from passwatch.operators.raster import BANDS


def test_box_sums(monkeypatch):
    r = np.random.default_rng(4)
    place = r.choice(640 * 640, 3000, replace=False)
    y, x, values = place // 640, place % 640, r.random((3000, 3))
    a, z = r.integers(0, 641, (2, 200, 2))
    corners = np.concatenate([np.minimum(a, z), np.maximum(a, z)], axis=1)
    plain = [[values[(y >= b) & (y < d) & (x >= c) & (x < e), k].sum() for k in range(3)] for c, b, e, d in corners.tolist()]
    assert np.allclose(spectral.box_sums(corners, y, x, values), plain, rtol=0, atol=1e-9)
    monkeypatch.setattr(spectral, "TABLE_FROM", 0)
    assert np.allclose(spectral.box_sums(corners, y, x, values), plain, rtol=0, atol=1e-12)


@pytest.mark.parametrize("exclude", [False, True])
@pytest.mark.parametrize("block", [spectral.BOXES, 4])
def test_region_band_means(spark, exclude, block):
    """Repeated pixels, nulls, a NaN, pixels outside the tile, boxes without pixels or outside; also with a tile dealt to many tasks."""
    r = np.random.default_rng(5)
    pixels = [(int(s), int(y), int(x), *(round(float(v), 3) for v in r.random(6))) for s, y, x in zip(r.integers(0, 3, 900), r.integers(0, 200, 900), r.integers(0, 200, 900))]
    pixels += [(0, 50, 50, None, 0.5, None, None, 0.1, 0.2), (0, 50, 50, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6), (1, 199, 199, *[float("nan")] * 6), (0, -1, 5, *[9.0] * 6), (0, 640, 5, *[9.0] * 6)]
    df = spark.createDataFrame(pixels, "scene_no long, y int, x int, " + ", ".join(f"{b} double" for b in BANDS))
    boxes = [(k, int(s), "ship", 8.0, 77.0, 0.5, int(x), int(y), int(x + w), int(y + h)) for k, (s, x, y, w, h) in enumerate(zip(r.integers(0, 4, 60), r.integers(-20, 210, 60), r.integers(-20, 210, 60), r.integers(-3, 90, 60), r.integers(-3, 90, 60)))]
    boxes += [(100, 0, "ship", 8.0, 77.0, 0.5, 600, 600, 700, 700)]
    b = spark.createDataFrame(boxes, "det_id long, scene_no long, type string, lat double, lon double, conf double, x1 int, y1 int, x2 int, y2 int")
    around = F.when(~F.col("in_box"), F.lit(1)) if exclude else F.lit(1)
    hit = spectral.pixels_in_bbox(b, df)
    want = hit.groupBy("det_id").agg(*[F.avg(F.when(F.col("in_box"), F.col(c))).alias(f"t_{c}") for c in BANDS], *[F.avg(F.when(around == 1, F.col(c))).alias(f"g_{c}") for c in BANDS]).where("t_b2 is not null")
    names = ["det_id", *[f"{p}_{c}" for p in "tg" for c in BANDS]]
    show = lambda d: {x[0]: [None if v is None else "nan" if v != v else round(v, 10) for v in x[1:]] for x in d.select(*names).collect()}
    got = spectral.region_band_means(b, df, exclude_target=exclude, block=block)
    assert show(got) == show(want) and len(show(want)) > 15
    assert spectral.region_band_means(b.limit(0), df).count() == 0 and spectral.region_band_means(b, df.limit(0)).count() == 0


def test_pixels_meet_boxes_by_shuffle(spark):
    """Small tables by their estimate become many rows when boxes are dealt to cells: no side is broadcast."""
    from passwatch.operators import spectral

    boxes = spark.createDataFrame([(1, 1, 0, 0, 80, 80)], "det_id long, scene_no long, x1 int, y1 int, x2 int, y2 int")
    pixels = spark.createDataFrame([(1, 5, 5), (1, 100, 100), (1, 600, 600)], "scene_no long, y int, x int")
    hit = spectral.pixels_in_bbox(boxes, pixels)
    assert "BroadcastHashJoin" not in hit._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.y, r.in_box) for r in hit.collect()) == [(5, True), (100, False)]


class Columns:
    """A table that gives its columns and nothing else."""

    def __init__(self, table):
        self.column = table.column


def test_small_tiles_are_read_without_frames(spark, monkeypatch):
    caught = []
    made = PandasCogroupedOps.applyInArrow
    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", lambda self, f, schema: caught.append(f) or made(self, f, schema))
    boxes = spark.createDataFrame([(1, 1, 0, 0, 2, 2)], "det_id long, scene_no long, x1 int, y1 int, x2 int, y2 int")
    pixels = spark.createDataFrame([], "scene_no long, y int, x int, " + ", ".join(f"{b} double" for b in BANDS))
    spectral.region_band_means(boxes, pixels)
    pixel = {"y": [0, 1, 5], "x": [0, 1, 5]} | {f"{p}_{b}": [1.0, 3.0, 5.0] if p == "s" else [1, 1, 1] for b in BANDS for p in "sn"}
    pixel["s_b4"], pixel["n_b4"] = [None, 2.0, float("nan")], [0, 1, 1]
    box = {"det_id": [7, 8], "x1": [0, 3], "y1": [0, 3], "x2": [2, 4], "y2": [2, 4], "bx1": [0, 0], "by1": [0, 0], "bx2": [9, 9], "by2": [9, 9]}
    found = caught[0](Columns(pa.table(pixel)), Columns(pa.table(box))).to_pydict()
    assert found["det_id"] == [7, 8] and found["t_b2"] == [2.0, None] and found["g_b2"] == [3.0, 3.0]
    assert found["t_b4"] == [2.0, None] and all(math.isnan(x) for x in found["g_b4"])
    none = caught[0](Columns(pa.table({k: pa.array([], pa.float64() if k[0] == "s" else pa.int64()) for k in pixel})), Columns(pa.table(box))).to_pydict()
    assert none["t_b2"] == [None, None]
