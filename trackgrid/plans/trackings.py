"""Tracks of whole detection tables: baseline and reference tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackgrid.operators.trajectories import interpolate_tracks
from trackgrid.registry import tracker as by_name

#: Clips with fewer frames than this were recorded at half the frame rate.
SHORT_CLIP = 1000


def naive_tracks(detections: DataFrame, tracker: str = "bytetrack", **params) -> DataFrame:
    """Link every frame's detections and fill the gaps of each track."""
    return interpolate_tracks(by_name(tracker, **params)(detections))


def truth_tracks(detections: DataFrame, frame_counts: DataFrame, tracker: str = "ocsort", **params) -> DataFrame:
    """Reference tracks at a common frame rate.

    Clips of at least 1000 frames run at twice the rate, so after tracking they keep
    their even frames, renumbered; short ones stay as they are.
    """
    tracks = naive_tracks(detections, tracker, **params)
    long = F.col("frame_count") >= SHORT_CLIP
    timed = tracks.join(frame_counts.select("video", "frame_count"), "video").where(~long | (F.col("frame_idx") % 2 == 0))
    return timed.withColumn("frame_idx", F.when(long, F.expr("frame_idx div 2")).otherwise(F.col("frame_idx"))).drop("frame_count")
