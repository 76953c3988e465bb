"""Detector training sets from annotations and from canvases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackgrid.operators import filters, joins, matching
from trackgrid.schemas import BOX


def build_detector_trainset(annotations: DataFrame, stride: int, val_fraction: float, classes: list[str] | None = None,
                            polygon: list[tuple[float, float]] | None = None, nms_threshold: float | None = None,
                            seed: int = 42) -> DataFrame:
    """Labelled boxes of every ``stride``-th frame with the split of their frame.

    ``annotations``: video, frame_idx, det_id, box, score and, with ``classes``, class.
    Frames are split as a whole, by hash, so both splits cover all videos.
    """
    rows = filters.sample_frames(annotations, stride)
    if classes is not None:
        rows = filters.filter_class(rows, classes)
    rows = filters.valid_boxes(rows)
    if polygon is not None:
        rows = filters.exclude_polygon(rows, polygon)
    if nms_threshold is not None:
        rows = matching.nms(rows, nms_threshold)
    image = F.concat_ws("_", F.col("video").cast("string"), F.format_string("%08d", F.col("frame_idx")))
    frames = annotations.where(F.col("frame_idx") % stride == 0).select("video", "frame_idx", image.alias("image")).distinct()
    split = filters.split_frames(frames, "image", val_fraction, seed)
    return rows.join(split, ["video", "frame_idx"]).select("split", "image", "video", "frame_idx", "det_id", *BOX)


def build_canvas_trainset(tracks: DataFrame, placements: DataFrame, index_map: DataFrame, tilesize: int, width: int,
                          height: int, dataset: str, classifier: str) -> DataFrame:
    """One nested annotation entry per canvas with the projected boxes of its frames.

    A canvas holds at most as many boxes as its tiles have centres, so the list of an
    entry is bounded by the canvas and not by the data.
    """
    boxes = joins.project_annotations(tracks, placements, index_map, tilesize, width, height)
    entry = F.struct(F.array(*BOX).alias("bbox"), F.lit("car").alias("class"), F.col("frame_idx").cast("int").alias("frame_idx"), "track_id")
    ordered = F.array_sort(F.collect_list(F.struct("frame_idx", "track_id", entry.alias("e"))))
    lists = boxes.groupBy(*joins.COLLAGE).agg(F.transform(ordered, lambda s: s["e"]).alias("annotations"))
    canvases = placements.select(*joins.COLLAGE).distinct()
    path = F.format_string("%s/%s/%s/%04d.jpg", F.lit(dataset), F.col("video").cast("string"), F.lit(classifier),
                           F.col("collage_idx").cast("int"))
    return canvases.join(lists, joins.COLLAGE, "left").select(
        F.lit(dataset).alias("dataset"), F.col("video").cast("string").alias("video"), path.alias("image_path"),
        F.lit(width).alias("image_width"), F.lit(height).alias("image_height"),
        F.coalesce("annotations", F.array().cast(
            "array<struct<bbox:array<double>,class:string,frame_idx:int,track_id:bigint>>")).alias("annotations"))
