"""Tiles by batches: no frame, file or shuffle for each tile."""

from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa

from passwatch.adapters import Model
from passwatch.operators import raster
from passwatch.queries import rasters
from passwatch.queries import sources as queries
from passwatch.sources import tiles as sources
from tests.oracle import SF


class Tiles:
    """Tile rows that keep the function of their tasks."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return lambda table: [b.to_pandas() for b in run(iter(table.to_batches()))]

    def mapInPandas(self, run, schema):  # noqa: N802
        return lambda table: list(run(iter([table.to_pandas()])))


def test_a_batch_of_tiles_is_scored_into_one_frame():
    r = np.random.default_rng(5)
    made = [r.random((h, w, 6)).astype(np.float32) for h, w in [(8, 8), (3, 5), (1, 1)] * 100]
    rows = pa.table({"scene_id": [f"t{i}" for i in range(len(made))], "h": [t.shape[0] for t in made], "w": [t.shape[1] for t in made], "bands": pa.array([t.tobytes() for t in made], pa.binary())})
    model = lambda tensor: np.repeat(tensor.mean(axis=(2, 3))[:, :, None], tensor.shape[3], axis=2)
    frames = raster.score_tiles(Tiles(), lambda: model)(rows)
    assert len(frames) == 1
    want = pd.concat([pd.DataFrame({"scene_id": f"t{i}", "anchor": np.arange(t.shape[1]), "cx": t[:, :, 0].mean(), "last": t[:, :, 5].mean()}) for i, t in enumerate(made)])
    got = frames[0]
    assert got["scene_id"].tolist() == want["scene_id"].tolist() and got["anchor"].tolist() == want["anchor"].tolist()
    assert np.allclose(got["cx"], want["cx"]) and np.allclose([s[1] for s in got["scores"]], want["last"]) and {len(s) for s in got["scores"]} == {2}


def test_tensor_of_several_tiles():
    tiles = np.random.default_rng(6).random((4, 3, 5, 6))
    assert (raster.batch_tensor(tiles) == np.concatenate([raster.batch_tensor(t) for t in tiles])).all()


def test_pixels_are_dealt_to_tiles_once(spark):
    frames = rasters.tile_frames(Model(spark, SF))
    assert frames._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_archives_of_tiles(spark, tmp_path):
    """Tiles of several sizes go through archives, of which a damaged one and odd members are named; the driver lists archives, not tiles."""
    r = np.random.default_rng(7)
    made = {f"t{k}": r.random((2 + k % 3, 4, 6)).astype(np.float32) for k in range(200)}
    rows = spark.createDataFrame([(k, *t.shape[:2], t.tobytes()) for k, t in made.items()], "scene_id string, h int, w int, bands binary").repartition(2)
    folder = tmp_path / "tiles"
    written = sources.write_npz(rows, f"file://{folder}", size=20_000)
    for _ in range(2):  # a task that is run again writes the same files
        assert {x.scene_id for x in written.collect()} == set(made)
        assert len(list(folder.glob("*"))) == len({x.path for x in written.collect()}) <= 6
    some = sorted(folder.glob("*.npz"))[0]
    (folder / "cut.npz").write_bytes(some.read_bytes()[:-40])
    np.savez(folder / "odd.npz", flat=np.zeros((4, 6)), text=np.full((1, 1, 6), "x"))
    np.save(folder / "single.npy", np.ones((2, 2, 6)))
    good, bad = sources.decode_tiles(sources.scan_tiles(spark, f"file://{folder}"))
    got = {x.scene_id: x for x in good.collect()}
    assert set(got) == {*made, "single"} and good.count() == 201
    for k, t in made.items():
        assert (np.frombuffer(got[k].bands, np.float32).reshape(got[k].h, got[k].w, 6) == t).all()
    assert {x.path.rsplit("/", 1)[1] for x in bad.collect()} == {"cut.npz", "odd.npz#flat.npy", "odd.npz#text.npy"}


def test_queries_write_few_array_files(spark):
    folder = queries.array_files(Model(spark, SF))
    found = list(Path(folder.removeprefix("file://")).iterdir())
    assert sum(p.suffix in (".npy", ".npz") for p in found) <= 16  # before: one for each of the tiles
