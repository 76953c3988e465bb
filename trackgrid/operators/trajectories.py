"""Ordered operators over tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackgrid.functions import geometry as g
from trackgrid.scale import BLOCK, with_neighbours
from trackgrid.schemas import BOX

TRACK = ["video", "track_id"]


def interpolate_tracks(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Fill the frames strictly between consecutive observations of a track by straight lines.

    Observed rows come out unchanged; ``interpolated`` marks the added ones.
    """
    keys = keys or TRACK
    ahead = with_neighbours(df.select(*keys, "frame_idx", *BOX), keys, "frame_idx", ["frame_idx", *BOX])
    last = F.coalesce(F.col("next_frame_idx") - 1, F.col("frame_idx"))
    filled = ahead.withColumn("_f", F.explode(F.sequence("frame_idx", last)))
    part = F.coalesce(F.try_divide(F.col("_f") - F.col("frame_idx"), F.col("next_frame_idx") - F.col("frame_idx")), F.lit(0.0))
    return filled.select(
        *keys, F.col("_f").alias("frame_idx"),
        *[(F.col(c) + part * F.coalesce(F.col(f"next_{c}") - F.col(c), F.lit(0.0))).alias(c) for c in BOX],
        (F.col("_f") > F.col("frame_idx")).alias("interpolated"))


def track_velocity(df: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """Unit direction (``dy``, ``dx``) from an earlier observation to each row.

    The earlier one is the oldest at most ``k`` frames back, else the latest before.
    Each block of frames also reads the ``k`` frames before it, so a long track is
    never one window partition.
    """
    keys = keys or TRACK
    width = max(BLOCK, 2 * k)
    blk = F.floor(F.col("frame_idx") / width)
    halo = F.when(F.col("frame_idx") % width >= width - k, F.array(blk, blk + 1)).otherwise(F.array(blk))
    cut = with_neighbours(df, keys, "frame_idx", BOX, forward=None, backward="prev").withColumn("_blk", F.explode(halo))
    w = Window.partitionBy(*keys, "_blk").orderBy("frame_idx").rangeBetween(-k, -1)
    near = F.min_by(F.struct(*BOX), "frame_idx").over(w)
    fallback = F.when(F.col("prev_x1").isNotNull(), F.struct(*[F.col(f"prev_{c}").alias(c) for c in BOX]))
    seen = cut.withColumn("_from", F.coalesce(near, fallback)).where(F.col("_blk") == blk)
    dy, dx = g.direction(g.Box(*[F.col(f"_from.{c}") for c in BOX]), g.box())
    return seen.withColumns({"dy": dy, "dx": dx}).drop("_blk", "_from", *[f"prev_{c}" for c in BOX])


def at_rates(tracks: DataFrame, rates: list[int]) -> DataFrame:
    """The rows each sampling rate sees, keyed by ``rate``; a rate r keeps one row in r."""
    rate = F.explode(F.array(*[F.lit(r).cast("bigint") for r in rates]))
    return tracks.withColumn("rate", rate).where(F.col("frame_idx") % F.col("rate") == 0)


def with_presence(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each track with the frames it is next and previously seen at."""
    return with_neighbours(tracks, keys, "frame_idx", ["frame_idx"], backward="prev")


def association_consistent(matches: DataFrame) -> DataFrame:
    """Whether each matched pair stays associated in both directions.

    ``matches``: video, frame_idx, l_track_id, r_track_id and, per side, the next
    and previous frame that track is seen at (``l_next_frame_idx`` ...). Walking away
    from a match, the first frame with either track decides: both present and matched
    there is correct, anything else is not; no such frame means both ended, correct.
    The pair is matched at that frame exactly when it is the pair's next match.
    """
    keys = [c for c in ("rate", "variant_id", "video", "l_track_id", "r_track_id") if c in matches.columns]
    linked = with_neighbours(matches, keys, "frame_idx", ["frame_idx"], forward="m_next", backward="m_prev")

    def holds(way: str) -> Column:
        left, right, both = F.col(f"l_{way}_frame_idx"), F.col(f"r_{way}_frame_idx"), F.col(f"m_{way}_frame_idx")
        ended = left.isNull() & right.isNull()
        return ended | F.coalesce((left == right) & (left == both), F.lit(False))

    return linked.withColumn("correct", holds("next") & holds("prev")).drop("m_next_frame_idx", "m_prev_frame_idx")


def holds_around(match: str) -> Column:
    """Whether a matched row's ``match`` is the same at its next and previous row (``next_<match>``, ``next_frame_idx`` ...), where there is one."""
    ok = F.col(match).isNotNull()
    for way in ("next", "prev"):
        ok = ok & (F.col(f"{way}_frame_idx").isNull() | F.coalesce(F.col(f"{way}_{match}") == F.col(match), F.lit(False)))
    return ok


def anchor_consistency(anchors: DataFrame, matches: DataFrame) -> DataFrame:
    """Whether each anchor's association holds at the adjacent anchors of its track.

    ``anchors``: video, frame_idx, track_id of retained truth boxes. ``matches``:
    video, frame_idx, l_track_id, r_track_id. An unmatched anchor is incorrect.
    """
    by = [c for c in ("variant_id",) if c in anchors.columns] + ["video"]
    on = [c for c in by if c in matches.columns]
    pair = matches.select(*on, "frame_idx", F.col("l_track_id").alias("track_id"), F.col("r_track_id").alias("_pred"))
    seen = anchors.select(*by, "track_id", "frame_idx").join(pair, [*on, "frame_idx", "track_id"], "left")
    # Matching is one-to-one in a frame, so the pair holds at a frame when the track's match there is the same one.
    around = with_neighbours(seen, [*by, "track_id"], "frame_idx", ["frame_idx", "_pred"], backward="prev")
    return around.select(*by, "frame_idx", "track_id", holds_around("_pred").alias("correct"))


def group_ids(groups: DataFrame, frame: list[str] | None = None) -> DataFrame:
    """Dense ids of the groups of a frame, largest first (then top row, then left column)."""
    frame = frame or ["video", "frame_idx"]
    w = Window.partitionBy(*frame).orderBy(F.col("size").desc(), "min_row", "min_col")
    return groups.withColumn("group_id", F.row_number().over(w) - 1)


def prev_frame_ref(frames: DataFrame) -> DataFrame:
    """Reference frame of each frame: the one before, for the first the one after."""
    both = with_neighbours(frames, ["video"], "frame_idx", ["frame_idx"], backward="prev")
    return both.select("video", "frame_idx", F.coalesce("prev_frame_idx", "next_frame_idx").alias("ref_frame"))


def first_last_per_tile(tiles: DataFrame) -> DataFrame:
    """First and last frame, with group, that each tile is covered in."""
    return tiles.groupBy("video", "row", "col").agg(
        F.min("frame_idx").alias("first_frame"), F.min_by("group_id", "frame_idx").alias("first_group"),
        F.max("frame_idx").alias("last_frame"), F.max_by("group_id", "frame_idx").alias("last_group"))


def largest_groups(groups: DataFrame, n: int, frame: list[str] | None = None) -> DataFrame:
    """The ``n`` largest groups of each frame."""
    return group_ids(groups, frame).where(F.col("group_id") < n)
