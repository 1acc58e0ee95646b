"""Resized and stacked bands against plain loops."""

import math
import random

import pytest

from passwatch.operators import raster


def plain(pixels, height, width, to_height, to_width):
    out = {}
    for ty in range(to_height):
        for tx in range(to_width):
            py, px = (min(max((t + 0.5) * n / to - 0.5, 0.0), n - 1.0) for t, n, to in ((ty, height, to_height), (tx, width, to_width)))
            hit = [(v, (1 - abs(py - y)) * (1 - abs(px - x))) for y, x, v in pixels if abs(py - y) < 1 and abs(px - x) < 1]
            if hit:
                held = [v * w for v, w in hit if v is not None]
                out[ty, tx] = sum(held) if held else None
    return out


def near(got, want):
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] is v is None or (math.isnan(v) and math.isnan(got[k])) or got[k] == v or abs(got[k] - v) < 1e-12, (k, got[k], v)


@pytest.mark.parametrize("strip", [1, 40, 1 << 18])
@pytest.mark.parametrize("to", [(12, 14), (9, 5), (3, 2)])
def test_resized(spark, monkeypatch, strip, to):
    """Sparse sources, repeated places, nulls, what is not finite and what lies outside, up and down, in strips of any height."""
    monkeypatch.setattr(raster, "STRIP", strip)
    r = random.Random(4)
    pixels = [(r.randrange(6), r.randrange(7), r.random()) for _ in range(25)]
    odd = pixels[:10] + [(5, 5, None), (0, 0, float("inf")), (5, 6, float("nan"))]
    rows = [("a", *p) for p in pixels] + [("b", *p) for p in odd] + [("a", -1, 3, 1.0), ("a", 6, 3, 1.0)]
    done = raster.resize_bilinear(spark.createDataFrame(rows, "k string, y int, x int, value double"), 6, 7, *to, keys=("k",)).collect()
    assert len(done) == len({(x.k, x.y, x.x) for x in done})
    for k, data in (("a", pixels), ("b", odd)):
        near({(x.y, x.x): x.value for x in done if x.k == k}, plain(data, 6, 7, *to))


@pytest.mark.parametrize("strip", [16, 1 << 18])
def test_stacked(spark, monkeypatch, strip):
    """A fine pixel that lacks a band, and one without a coarse pixel near, go; no row is made for a place without fine pixels."""
    monkeypatch.setattr(raster, "STRIP", strip)
    r = random.Random(6)
    fine = {(y, x): [r.random() for _ in range(4)] for y in range(8) for x in range(8) if r.random() < 0.5 and (y, x) != (7, 7)}
    low = {b: [(y, x, r.random()) for y in range(4) for x in range(4) if y < 3] for b in raster.BANDS[4:]}
    long = [(1, y, x, b, v) for (y, x), vs in fine.items() for b, v in zip(raster.BANDS, vs)] + [(1, 7, 7, "b2", 0.5), (2, 0, 0, "b2", 0.5)]
    kind = "scene_no long, y int, x int, band string, value double"
    coarse = [(1, y, x, b, v) for b, ps in low.items() for y, x, v in ps]
    done = {(p.y, p.x): [p[b] for b in raster.BANDS] for p in raster.stack_bands(spark.createDataFrame(long, kind), spark.createDataFrame(coarse, kind), 8, 8).collect()}
    up = [plain(low[b], 4, 4, 8, 8) for b in raster.BANDS[4:]]
    want = {at: [*v, *(u[at] for u in up)] for at, v in fine.items() if all(at in u for u in up)}
    assert done.keys() == want.keys() and len(want) < len(fine)
    assert all(abs(a - b) < 1e-12 for at in want for a, b in zip(done[at], want[at]))
