"""Suppression in scenes of any number of boxes, by rounds over cells.

A cell holds the boxes that reach into it, so two boxes that overlap meet in a cell. Within a cell boxes are gone through best first. What a kept
box overlaps is dropped. A box that no better one overlaps is kept at once where it lies wholly in the cell; one that reaches over the border is kept when
all its cells find it free, and what it overlaps waits for that. The best waiting box of a scene is settled in every round, so that the rounds
end; cells without a waiting box leave them. A scene's boxes are spread over tasks by cell; there is no row for a pair of boxes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passwatch.operators.detect import IOU_MOST

CELL = 256
FREE, WAITS, DROPPED = 0, 1, 2
CORNERS = ("x1", "y1", "x2", "y2")


def settled(corners: np.ndarray, kept: np.ndarray, whole: np.ndarray, iou_most: float) -> np.ndarray:
    """FREE, WAITS or DROPPED for each box (rows x1, y1, x2, y2, best first) of a cell; kept: known to stay, whole: within the cell."""
    x1, y1, x2, y2 = corners
    area = (x2 - x1) * (y2 - y1)
    found = np.zeros(len(x1), np.int8)
    for i in range(len(x1)):
        if found[i] == DROPPED:
            continue
        rest = i + 1 + np.flatnonzero(found[i + 1 :] != DROPPED)
        inter = np.maximum(0, np.minimum(x2[i], x2[rest]) - np.maximum(x1[i], x1[rest])) * np.maximum(0, np.minimum(y2[i], y2[rest]) - np.maximum(y1[i], y1[rest]))
        met = rest[inter / (area[i] + area[rest] - inter + 1e-8) > iou_most]
        sure = kept[i] or (whole[i] and found[i] == FREE)
        found[met] = DROPPED if sure else WAITS
    return found


def starts(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Whether a row has other keys than the one before; nulls are equal."""
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for c in keys:
        after, before = rows[c].iloc[1:].reset_index(drop=True), rows[c].iloc[:-1].reset_index(drop=True)
        new[1:] |= ((after != before) & ~(after.isna() & before.isna())).to_numpy(bool)
    return new


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Batches of rows sorted by keys, cut so that none ends within a group."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        edges = np.flatnonzero(starts(pd.concat([held[-1].tail(1), batch]) if held else batch, keys)[1 if held else 0 :])
        last = edges[-1] if len(edges) else 0
        if len(edges) and (held or last):
            yield pd.concat([*held, batch.iloc[:last]], ignore_index=True)
            held = []
        held.append(batch.iloc[last:])
    if held:
        yield pd.concat(held, ignore_index=True)


def nms_crowded(boxes: DataFrame, folder: str, scene: str = "scene_id", iou_most: float = IOU_MOST, per_class: bool = False, cell: int = CELL) -> DataFrame:
    """The rows scene, det_id that greedy suppression keeps, as nms_kernel() does, with no task that holds a whole scene.

    boxes has scene, det_id, conf, x1, y1, x2, y2 (and type with `per_class`); other columns are not read. Ties of conf go to the greater det_id,
    repeated rows each count for themselves. A box with a null corner or without an area overlaps with none and stays; a null conf comes last, a null
    scene is a scene. An empty table gives an empty result. `folder` is shared by driver and executors; the rounds' boxes are
    written there and deleted, the rows kept stay as the result. A box counts once for each cell that it reaches into.
    """
    spark = boxes.sparkSession
    keys = [scene, "type"] if per_class else [scene]
    at = f"{folder.rstrip('/')}/crowd-{uuid.uuid4().hex}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{at}/{name}")
        return spark.read.schema(df.schema).parquet(f"{at}/{name}")

    def discard(name: str) -> None:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{name}")
        where.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(where, True)

    def over(low: str, high: str) -> F.Column:
        first, last = F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)
        return F.sequence(first, F.greatest(first, last))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cells in whole_groups(batches, at_cell):
            rows, found = cells["row"].to_numpy(), np.zeros(len(cells), np.int32)
            corners, kept, whole = cells[list(CORNERS)].to_numpy(float).T, cells["kept"].to_numpy(bool), cells["whole"].to_numpy(bool)
            edges = np.flatnonzero(np.append(starts(cells, at_cell), True))
            for a, z in zip(edges[:-1], edges[1:]):
                if z - a > 1:  # a box alone in its cell is free
                    found[a:z] = settled(corners[:, a:z], kept[a:z], whole[a:z], iou_most)
            yield pd.DataFrame({"row": rows, "found": found})

    named = boxes.select(*dict.fromkeys([*keys, "det_id", "conf", *CORNERS])).withColumn("row", F.monotonically_increasing_id())
    flat = F.coalesce((F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1")), F.lit(True))
    every = written(named.withColumn("flat", flat), "boxes")
    result, at_cell = [scene, "det_id"], [*keys, "__cx", "__cy"]
    order = [*at_cell, F.nanvl(F.col("conf").cast("double"), F.lit(None)).desc_nulls_last(), F.desc("det_id"), F.desc("row")]
    every.where("flat").select(*result).write.parquet(f"{at}/kept")
    state, k = every.where(~F.col("flat")).drop("flat").withColumn("kept", F.lit(False)), 0
    while not state.where(~F.col("kept")).isEmpty():
        placed = state.withColumn("__cx", F.explode(over("x1", "x2"))).withColumn("__cy", F.explode(over("y1", "y2")))
        whole = (F.floor(F.col("x1") / cell) == F.floor(F.col("x2") / cell)) & (F.floor(F.col("y1") / cell) == F.floor(F.col("y2") / cell))
        placed = placed.withColumn("whole", whole)
        if k:  # only cells where a box still waits
            busy = placed.where(~F.col("kept")).select(*keys, "__cx", "__cy").distinct()
            same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, "__cx", "__cy")]
            placed = placed.alias("a").join(busy.alias("b"), reduce(and_, same), "left_semi")
        dealt = placed.repartition(*at_cell).sortWithinPartitions(*order).select(*at_cell, "row", *CORNERS, "kept", "whole")
        judged = dealt.mapInPandas(judge, "row long, found int").groupBy("row").agg(F.max("found").alias("found"))
        now = written(state.join(judged, "row").where(F.col("found") < DROPPED), f"round-{k}")
        now.where(~F.col("kept") & (F.col("found") == FREE)).select(*result).write.mode("append").parquet(f"{at}/kept")
        discard(f"round-{k - 1}" if k else "boxes")
        state, k = now.withColumn("kept", F.col("kept") | (F.col("found") == FREE)).drop("found"), k + 1
    if k:
        discard(f"round-{k - 1}")
    return spark.read.schema(every.select(*result).schema).parquet(f"{at}/kept")
