"""Boxes to tiles and cells, tile adjacency and padding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from trackgrid.functions import geometry as g

#: Neighbour offsets (row, col) each padding mode adds around a tile.
PADDING = {
    "none": [],
    "plus": [(-1, 0), (1, 0), (0, -1), (0, 1)],
    "tl": [(-1, 0), (0, -1), (-1, -1)],
    "tr": [(-1, 0), (0, 1), (-1, 1)],
    "bl": [(1, 0), (0, -1), (1, -1)],
    "br": [(1, 0), (0, 1), (1, 1)],
    "square": [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)],
}
ORTHOGONAL = PADDING["plus"]
#: Diagonal links a mode adds, seen from an original tile.
DIAGONAL = {
    "none": [], "plus": [], "tl": [(-1, -1)], "tr": [(-1, 1)], "bl": [(1, -1)], "br": [(1, 1)],
    "square": [(-1, -1), (-1, 1), (1, -1), (1, 1)],
}


def _span(lo: Column, hi: Column) -> Column:
    return F.sequence(lo.cast("bigint"), hi.cast("bigint"))


def _explode_cells(df: DataFrame, r0: Column, r1: Column, c0: Column, c1: Column) -> DataFrame:
    spans = df.withColumns({"_r0": r0, "_r1": r1, "_c0": c0, "_c1": c1})
    return (
        spans.where("_r0 <= _r1 AND _c0 <= _c1")
        .withColumn("row", F.explode(_span(F.col("_r0"), F.col("_r1"))))
        .withColumn("col", F.explode(_span(F.col("_c0"), F.col("_c1"))))
        .drop("_r0", "_r1", "_c0", "_c1")
    )


def boxes_to_tiles(df: DataFrame, tilesize: int, rows: int, cols: int) -> DataFrame:
    """One row per tile a box overlaps; whole-pixel corners, end tile included, clamped to the grid."""

    def tile(v: Column) -> Column:
        return F.floor(v.cast("bigint") / tilesize)

    return _explode_cells(
        df,
        F.greatest(tile(F.col("y1")), F.lit(0)), F.least(tile(F.col("y2")), F.lit(rows - 1)),
        F.greatest(tile(F.col("x1")), F.lit(0)), F.least(tile(F.col("x2")), F.lit(cols - 1)),
    )


_EPS = 1e-9


def _clamp(v: Column, n: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), v))


def boxes_to_cells(df: DataFrame, width: float, height: float, rows: int, cols: int) -> DataFrame:
    """One row per rectangular cell a clipped box overlaps, end-exclusive; boxes outside give none."""
    b = g.clip(g.box(), 0, 0, width, height)
    cw, ch = width / cols, height / rows
    inside = df.where((b.x2 > b.x1) & (b.y2 > b.y1))
    return _explode_cells(
        inside,
        _clamp(F.floor(b.y1 / ch), rows),
        _clamp(F.floor(F.least(F.lit(height - _EPS), b.y2 - _EPS) / ch), rows),
        _clamp(F.floor(b.x1 / cw), cols),
        _clamp(F.floor(F.least(F.lit(width - _EPS), b.x2 - _EPS) / cw), cols),
    )


def center_cell(df: DataFrame, width: float, height: float, rows: int, cols: int) -> DataFrame:
    """Cell (row, col) of the clipped box's centre; NULL when the box is outside the frame."""
    b = g.clip(g.box(), 0, 0, width, height)
    inside = (b.x2 > b.x1) & (b.y2 > b.y1)
    cw, ch = width / cols, height / rows
    row = _clamp(F.floor(F.least(F.lit(height - _EPS), b.cy) / ch), rows)
    col = _clamp(F.floor(F.least(F.lit(width - _EPS), b.cx) / cw), cols)
    return df.withColumns({"row": F.when(inside, row), "col": F.when(inside, col)})


def _offsets(pairs: list[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(r).cast("bigint").alias("r"), F.lit(c).cast("bigint").alias("c"))
                     for r, c in pairs])


#: Frames whose tiles are paired in one call.
FRAMES_PER_PAIRING = 256


def _linked(n: np.ndarray, row: np.ndarray, col: np.ndarray, original: np.ndarray, mode: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the source and target tile of every link within a frame ``n``."""
    r, c = row - row.min() + 1, col - col.min() + 1
    width = c.max() + 2
    key = (n * (r.max() + 2) + r) * width + c
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    pairs = []
    for dr, dc in sorted(set(ORTHOGONAL + DIAGONAL[mode] + [(-r, -c) for r, c in DIAGONAL[mode]])):
        near = key + dr * width + dc
        first = np.searchsorted(ranked, near)
        count = np.searchsorted(ranked, near, "right") - first
        src = np.repeat(np.arange(len(key)), count)
        dst = order[np.arange(len(src)) - np.repeat(np.cumsum(count) - count - first, count)]
        linked = original[src] | original[dst]
        if dr and dc:
            # A diagonal link runs in the mode's direction from an original tile and backwards from padding.
            out, back = (dr, dc) in DIAGONAL[mode], (-dr, -dc) in DIAGONAL[mode]
            linked &= np.where(original[src], out, back) | np.where(original[dst], back, out)
        pairs.append((src[linked], dst[linked]))
    return tuple(np.concatenate(side) for side in zip(*pairs))


def tile_adjacency(df: DataFrame, mode: str = "none", frame: list[str] | None = None) -> DataFrame:
    """Directed neighbour pairs of the tiles of a frame.

    ``df`` may carry ``kind`` (1 original, 2 padding); padding tiles do not link to each other.
    A frame holds at most its grid's tiles, so it travels as one row and its tiles are paired where it
    arrives; neighbours are never rows of a shuffle.
    """
    frame = frame or ["video", "frame_idx"]
    original = F.coalesce(F.col("kind") == 1, F.lit(False)) if "kind" in df.columns else F.lit(True)
    tile = F.struct(F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), original.alias("original"))
    whole = df.dropna(subset=[*frame, "row", "col"]).groupBy(*frame).agg(F.collect_list(tile).alias("_tiles"))
    ends = ["src_row", "src_col", "dst_row", "dst_col"]
    schema = StructType([*[f for f in whole.schema if f.name in frame], *[StructField(c, LongType()) for c in ends]])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, FRAMES_PER_PAIRING):
                some = batch.slice(start, FRAMES_PER_PAIRING)
                lists = some.column("_tiles")
                row, col, first = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
                n = np.repeat(np.arange(some.num_rows), np.diff(lists.offsets.to_numpy()))
                src, dst = _linked(n, row, col, first.astype(bool), mode)
                at = pa.array(n[src])
                yield pa.RecordBatch.from_arrays([some.column(c).take(at) for c in frame] + [pa.array(v) for v in (row[src], col[src], row[dst], col[dst])],
                                                 names=[*frame, *ends])

    kinds = dict(df.dtypes)
    return whole.mapInArrow(pair, schema).withColumns({"src_row": F.col("src_row").cast(kinds["row"]), "src_col": F.col("src_col").cast(kinds["col"])})


def pad_tiles(df: DataFrame, mode: str, rows: int, cols: int, frame: list[str] | None = None) -> DataFrame:
    """Tiles plus the neighbours the mode adds; ``kind`` is 1 for originals, 2 for padding.

    All the copies of a tile are reduced by a partial aggregation before the shuffle.
    """
    frame = frame or ["video", "frame_idx"]
    shifts = [(0, 0)] + PADDING[mode]
    grown = df.select(*frame, "row", "col", F.explode(_offsets(shifts)).alias("_o")).select(
        *frame, (F.col("row") + F.col("_o.r")).alias("row"), (F.col("col") + F.col("_o.c")).alias("col"),
        F.when((F.col("_o.r") == 0) & (F.col("_o.c") == 0), 1).otherwise(2).alias("kind"),
    )
    return grown.where(g.tile_in_grid(F.col("row"), F.col("col"), rows, cols)).groupBy(
        *frame, "row", "col").agg(F.min("kind").alias("kind"))
