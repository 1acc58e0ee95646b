import numpy as np
import pytest
from pyspark.sql import functions as F

from passwatch.operators import crowd, detect

SCHEMA = "scene_id string, det_id bigint, type string, conf double, x1 int, y1 int, x2 int, y2 int"


def rows_of(df):
    return sorted((tuple(r) for r in df.select("scene_id", "det_id").collect()), key=str)


def crowd_of(n, size, seed, scenes=1):
    r = np.random.default_rng(seed)
    x, y = r.integers(-50, size, n), r.integers(-50, size, n)
    w, h = r.integers(3, 60, n), r.integers(3, 60, n)
    conf = r.integers(0, 50, n) / 50  # many ties
    return [(f"s{k % scenes}", k, "ship" if k % 3 else "harbor", float(conf[k]), int(x[k]), int(y[k]), int(x[k] + w[k]), int(y[k] + h[k])) for k in range(n)]


@pytest.mark.parametrize("cell", [64, 1000])
def test_rounds_equal_greedy_form(spark, tmp_path, cell):
    boxes = spark.createDataFrame(crowd_of(1200, 400, 1, 2), SCHEMA)
    assert rows_of(crowd.nms_crowded(boxes, str(tmp_path), cell=cell)) == rows_of(detect.nms_kernel(boxes))


def test_classes_apart(spark, tmp_path):
    boxes = spark.createDataFrame(crowd_of(300, 200, 4), SCHEMA)
    assert rows_of(crowd.nms_crowded(boxes, str(tmp_path), per_class=True)) == rows_of(detect.nms_kernel(boxes, per_class=True))


def test_chain_over_many_cells(spark, tmp_path):
    """Each box overlaps with the next only, in falling order: what is kept hangs on the first one, across all borders."""
    boxes = spark.createDataFrame([("s", k, "ship", 1 - k / 100, 3 * k, 0, 3 * k + 10, 10) for k in range(20)], SCHEMA)
    got = rows_of(crowd.nms_crowded(boxes, str(tmp_path), cell=16))
    assert got == rows_of(detect.nms_kernel(boxes)) and len(got) == 10


def test_one_scene_goes_to_many_tasks(spark, tmp_path):
    """20,000 boxes of one scene: no cell holds more than a few of them, and what stays is what the greedy form keeps."""
    data = crowd_of(20_000, 4000, 2)
    boxes = spark.createDataFrame(data, SCHEMA)
    held = boxes.groupBy(F.floor(F.col("x1") / 256), F.floor(F.col("y1") / 256)).count()
    assert held.agg(F.max("count")).first()[0] < 1000
    assert rows_of(crowd.nms_crowded(boxes, str(tmp_path))) == rows_of(detect.nms_kernel(boxes))


def test_nulls_repeats_flat_boxes_and_empty(spark, tmp_path):
    data = [
        ("s", 1, "ship", 0.9, 0, 0, 10, 10), ("s", 1, "ship", 0.9, 0, 0, 10, 10),  # a repeated row is one box too many
        ("s", 2, "ship", None, 0, 0, 10, 10), ("s", 3, "ship", 0.8, None, 0, 10, 10), ("s", 4, "ship", 0.7, 5, 5, 5, 9),
        (None, 5, "ship", None, 0, 0, 10, 10), (None, 6, "ship", 0.1, 0, 0, 10, 10), ("s", None, "ship", 0.5, 40, 40, 50, 50),
    ]
    boxes = spark.createDataFrame(data, SCHEMA).withColumn("row", F.lit(1)).withColumn("kept", F.lit("x"))
    assert rows_of(crowd.nms_crowded(boxes, str(tmp_path), cell=4)) == sorted([("s", 1), ("s", 3), ("s", 4), (None, 6), ("s", None)], key=str)
    assert crowd.nms_crowded(boxes.limit(0), str(tmp_path)).collect() == []


def test_batches_are_cut_between_cells():
    """Cells reach the kernel in batches of many, none of them split, wherever the batches end; nulls are a key of their own."""
    import pandas as pd

    r = np.random.default_rng(5)
    rows = pd.DataFrame({"a": [None if k % 7 == 0 else f"k{k // 5:03}" for k in range(200)], "b": r.integers(0, 2, 200), "n": range(200)}).sort_values(["a", "b"], na_position="first")
    for size in (1, 3, 50, 500):
        cut = list(crowd.whole_groups((rows.iloc[k : k + size] for k in range(0, 200, size)), ["a", "b"]))
        assert [n for c in cut for n in c["n"]] == list(rows["n"])
        groups = [key for c in cut for key in {(str(a), b) for a, b in zip(c["a"], c["b"])}]
        assert len(groups) == len(set(groups))
