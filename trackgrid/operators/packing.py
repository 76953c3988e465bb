"""Canvas packing on tables."""

from __future__ import annotations

from bisect import bisect_left, insort
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from trackgrid.operators.joins import COLLAGE
from trackgrid.scale import in_whole_groups


def pack_groups(groups: DataFrame, capacity: int, batch: list[str], classes: int = 6) -> DataFrame:
    """Assign tile groups to canvases so that no canvas holds more than ``capacity`` cells.

    Groups are packed per ``batch`` (a video's fixed run of frames, so the largest
    batch is bounded by frames x grid). A group larger than capacity / (k + 1) and at
    most capacity / k shares its canvas with k - 1 others of its class; the smaller
    ones fill canvases in order of size up to the capacity less the largest of them.
    """
    k = F.least(F.floor(F.lit(capacity) / F.col("size")), F.lit(classes + 1)).cast("bigint")
    sized = groups.where(F.assert_true(F.col("size") <= capacity, "group larger than a canvas").isNull()).withColumn(
        "_k", k)
    w = Window.partitionBy(*batch, "_k").orderBy(F.col("size").desc(), "frame_idx", "group_id")
    small_cap = capacity - capacity // (classes + 1)
    before = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1))
    slot = F.when(F.col("_k") <= classes, F.floor((F.row_number().over(w) - 1) / F.col("_k"))).otherwise(
        F.floor(F.coalesce(before, F.lit(0)) / small_cap))
    return sized.withColumn("slot", slot.cast("bigint")).withColumnRenamed("_k", "size_class")


class _FirstFit:
    """Lowest canvas with enough free cells, found by descent in a tree of the most free cells below."""

    def __init__(self, most: int):
        self.leaves = 1 << max(most - 1, 0).bit_length()
        self.free = [0] * (2 * self.leaves)

    def find(self, size: int) -> int | None:
        if self.free[1] < size:
            return None
        at = 1
        while at < self.leaves:
            at = 2 * at + (self.free[2 * at] < size)
        return at - self.leaves

    def put(self, slot: int, free: int) -> None:
        at = slot + self.leaves
        self.free[at] = free
        while at > 1:
            at //= 2
            self.free[at] = max(self.free[2 * at], self.free[2 * at + 1])


class _BestFit:
    """Canvas with the fewest free cells that are enough, from an ordered list."""

    def __init__(self, most: int):
        self.order: list[tuple[int, int]] = []

    def find(self, size: int) -> int | None:
        at = bisect_left(self.order, (size, -1))
        return self.order.pop(at)[1] if at < len(self.order) else None

    def put(self, slot: int, free: int) -> None:
        insort(self.order, (free, slot))


class _EasiestFit:
    """Canvas with the most free cells, if they are enough, from a heap."""

    def __init__(self, most: int):
        self.heap: list[tuple[int, int]] = []

    def find(self, size: int) -> int | None:
        return heappop(self.heap)[1] if self.heap and -self.heap[0][0] >= size else None

    def put(self, slot: int, free: int) -> None:
        heappush(self.heap, (-free, slot))


#: Which of the canvases with room a group goes to.
FITS = {"first": _FirstFit, "best": _BestFit, "easiest": _EasiestFit}


def pack_fit(groups: DataFrame, capacity: int, batch: list[str], mode: str = "easiest") -> DataFrame:
    """Assign tile groups to canvases of ``capacity`` cells in order of size, each to a canvas with room by ``mode``.

    ``first`` takes the lowest canvas with enough free cells, ``best`` the one with the fewest, ``easiest`` the one
    with the most; ties go to the lowest, and a group without room opens a canvas. Adds ``slot``. Batches
    (a video's fixed run of frames, so bounded by frames x grid) are packed side by side.
    """
    fit = FITS[mode]
    checked = groups.where(F.assert_true(F.col("size") <= capacity, "group larger than a canvas").isNull())
    kind = StructType([*checked.schema, StructField("slot", LongType())])

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        of = rows.groupby(batch, sort=False, dropna=False).ngroup().to_numpy()
        rows = rows.assign(_of=of).sort_values(["_of", "size", "frame_idx", "group_id"], ascending=[True, False, True, True], kind="stable")
        sizes, slots = rows["size"].tolist(), []
        ends = np.cumsum(np.bincount(of)).tolist()
        for start, end in zip([0, *ends], ends):
            canvases, free = fit(end - start), []
            for size in sizes[start:end]:
                slot = canvases.find(size)
                if slot is None:
                    slot = len(free)
                    free.append(capacity)
                free[slot] -= size
                canvases.put(slot, free[slot])
                slots.append(slot)
        return rows.drop(columns="_of").assign(slot=slots)

    return in_whole_groups(checked, batch, pack, kind)


def canvas_bound(groups: DataFrame, capacity: int, batch: list[str]) -> DataFrame:
    """Fewest canvases each batch can need."""
    return groups.groupBy(*batch).agg(F.ceil(F.sum("size") / capacity).cast("bigint").alias("min_canvases"))


def crop_index(placements: DataFrame) -> DataFrame:
    """Occupied canvas cells of placed groups. Groups come as rectangles ``h`` x ``w`` or as ``cells``."""
    if "cells" in placements.columns:
        placed = placements.withColumn("_c", F.explode("cells"))
        return placed.select(*COLLAGE, (F.col("py") + F.col("_c.row")).alias("row"),
                             (F.col("px") + F.col("_c.col")).alias("col"), "group_id")
    return placements.withColumn("row", F.explode(F.sequence("py", F.col("py") + F.col("h") - 1))).withColumn(
        "col", F.explode(F.sequence("px", F.col("px") + F.col("w") - 1))).select(*COLLAGE, "row", "col", "group_id")


def collage_range(placements: DataFrame) -> DataFrame:
    return placements.groupBy(*COLLAGE).agg(
        F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"),
        F.count("*").alias("groups"))


def tile_copy_plan(index_map: DataFrame, placements: DataFrame, tilesize: int) -> DataFrame:
    """Source and target pixel corner of every placed tile."""
    both = index_map.join(placements, [*COLLAGE, "group_id"])
    return both.select(
        *COLLAGE, "frame_idx", "group_id",
        ((F.col("row") - F.col("py") + F.col("oy")) * tilesize).alias("src_y"),
        ((F.col("col") - F.col("px") + F.col("ox")) * tilesize).alias("src_x"),
        (F.col("row") * tilesize).alias("dst_y"), (F.col("col") * tilesize).alias("dst_x"))
