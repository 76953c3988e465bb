"""Connected tile groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from trackgrid.functions import geometry as g
from trackgrid.operators.tiles import DIAGONAL, ORTHOGONAL, PADDING, pad_tiles

#: Frames labelled together, in one array of their grids.
FRAMES_PER_GROUP = 128


def _labels(kind: np.ndarray, mode: str) -> np.ndarray:
    """Smallest cell number of each cell's component; ``kind`` is (frames, rows, cols) with a zero border."""
    label = np.where(kind > 0, np.arange(kind.size).reshape(kind.shape), kind.size)
    straight = [(r, c) for r, c in ORTHOGONAL if (r, c) > (0, 0)]
    while True:
        before = label.copy()
        for r, c in straight + DIAGONAL[mode]:
            near = np.roll(kind, (-r, -c), axis=(1, 2))
            # a straight link needs an original at either end, a diagonal one at the end it starts from
            start = (kind == 1) | ((near == 1) if r == 0 or c == 0 else False)
            joined = (kind > 0) & (near > 0) & start
            low = np.where(joined, np.minimum(label, np.roll(label, (-r, -c), axis=(1, 2))), label)
            label = np.minimum(low, np.roll(np.where(joined, low, kind.size), (r, c), axis=(1, 2)))
        flat = np.append(label.ravel(), kind.size)
        label = flat[flat][:-1].reshape(kind.shape)
        if np.array_equal(label, before):
            return label


def _bitmaps(df: DataFrame, rows: int, cols: int, frame: list[str]) -> DataFrame:
    """One row per frame: its tiles, and those one step outside the grid, as bits of 64-bit words.

    Cell numbers count a border around the grid. Words are reduced before the shuffle, so a frame costs
    a row of a few words and not a row per tile.
    """
    near = df.where(g.tile_in_grid(F.col("row") + 1, F.col("col") + 1, rows + 2, cols + 2))
    cell = (F.col("row") + 1) * (cols + 2) + F.col("col") + 1
    bit = near.select(*frame, F.floor(cell / 64).alias("_word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (cell % 64).cast("int")).alias("_bit"))
    words = [F.coalesce(F.bit_or(F.when(F.col("_word") == i, F.col("_bit"))), F.lit(0)).cast("bigint") for i in range(-(-(rows + 2) * (cols + 2) // 64))]
    return bit.groupBy(*frame).agg(F.array(*words).alias("_words"))


def _grouped(words: np.ndarray, mode: str, rows: int, cols: int) -> dict[str, np.ndarray]:
    """Tiles of frames given as bits, frame by frame, with their groups; ``at`` is the frame's position."""
    cells = np.unpackbits(words.astype("<i8", copy=False).view(np.uint8), axis=1, bitorder="little")[:, :(rows + 2) * (cols + 2)]
    tile = cells.reshape(-1, rows + 2, cols + 2).astype(bool)
    kind = np.zeros(tile.shape, np.int8)
    for r, c in PADDING[mode]:
        kind[np.roll(tile, (r, c), axis=(1, 2))] = 2
    kind[tile] = 1
    kind[:, [0, -1]] = 0
    kind[:, :, [0, -1]] = 0
    at, r, c = np.nonzero(kind)
    root = _labels(kind, mode)[at, r, c]
    # A root is the first cell of its group, row by row, so it also has the group's top row.
    counts = np.bincount(root, minlength=kind.size)
    first = np.flatnonzero(counts)
    of = np.empty(kind.size, np.int64)
    of[first] = np.arange(len(first))
    of = of[root]
    held, top, _ = np.unravel_index(first, kind.shape)
    size, oy, ox = counts[first], top - 1, np.full(len(first), cols)
    np.minimum.at(ox, of, c - 1)
    # Groups are numbered by frame and root; a stable sort leaves the root to decide last.
    order = np.lexsort((ox, oy, -size, held))
    rank = np.empty(len(size), np.int64)
    rank[order] = np.arange(len(size)) - np.searchsorted(held, held[order])
    return {"at": at, "row": r - 1, "col": c - 1, "kind": kind[at, r, c], "group_id": rank[of], "size": size[of], "oy": oy[of], "ox": ox[of]}


def group_tiles(df: DataFrame, mode: str, rows: int, cols: int, frame: list[str] | None = None) -> DataFrame:
    """Connected groups of each frame's relevant tiles after padding by ``mode``.

    Adds ``group_id`` (dense, largest group first, then top row, then left column),
    ``size`` and the group's offset ``oy``/``ox``. Padding tiles never join groups on
    their own: a link needs an original tile.

    Components never leave a frame and a frame holds at most rows x cols tiles, so a
    frame is one row of bits whatever the length of a video; padding and labelling take
    many frames at once. No driver rounds.
    """
    frame = frame or ["video", "frame_idx"]
    kinds = {f.name: f.dataType for f in pad_tiles(df, mode, rows, cols, frame).schema}
    bits = _bitmaps(df, rows, cols, frame)
    numbers = ["row", "col", "kind", "group_id", "size", "oy", "ox"]
    schema = StructType([StructField(c, kinds[c]) for c in frame] + [StructField(c, LongType()) for c in numbers])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, FRAMES_PER_GROUP):
                some = batch.slice(start, FRAMES_PER_GROUP)
                found = _grouped(some.column("_words").flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1), mode, rows, cols)
                at = pa.array(found["at"])
                yield pa.RecordBatch.from_arrays([some.column(c).take(at) for c in frame] + [pa.array(found[c].astype(np.int64)) for c in numbers], names=[*frame, *numbers])

    return bits.mapInArrow(label, schema).withColumns({c: F.col(c).cast(kinds[c]) for c in ("row", "col", "kind")})


def group_summary(grouped: DataFrame, frame: list[str] | None = None) -> DataFrame:
    """One row per group with its size and relative cells, ready to be packed."""
    frame = frame or ["video", "frame_idx"]
    cell = F.struct((F.col("row") - F.col("oy")).alias("row"), (F.col("col") - F.col("ox")).alias("col"))
    return grouped.groupBy(*frame, "group_id", "oy", "ox").agg(
        F.count("*").alias("size"), F.array_sort(F.collect_list(cell)).alias("cells"))
