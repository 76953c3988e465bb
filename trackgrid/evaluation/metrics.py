"""Tracking accuracy from matched boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackgrid.operators.aggregates import duplicate_keys
from trackgrid.operators.joins import iou_join
from trackgrid.operators.matching import match_continued, match_in_frames, one_to_one
from trackgrid.scale import materialize, with_neighbours
from trackgrid.schemas import BOX

#: Localisation thresholds the HOTA family is averaged over.
ALPHAS = [round(0.05 * i, 2) for i in range(1, 20)]


def prepare_eval(tracks: DataFrame, skip: int = 1, strict: bool = False) -> DataFrame:
    """Evaluation rows: every ``skip``-th frame, numbered without gaps, default class 0 and confidence 1.

    With ``strict`` an id seen twice in a frame is an error.
    """
    out = tracks.where(F.col("frame_idx") % skip == 0)
    if skip > 1:
        out = out.withColumn("frame_idx", F.expr(f"frame_idx div {int(skip)}"))
    for name, value in (("class", 0), ("confidence", 1.0)):
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in tracks.columns else F.lit(value))
    if strict and not duplicate_keys(out, ["video", "frame_idx", "track_id"]).isEmpty():
        raise ValueError("track id repeated in a frame")
    return out


def _ratio(a: Column, b: Column) -> Column:
    return a.cast("double") / F.greatest(F.lit(1.0), b.cast("double"))


def _slim(tracks: DataFrame) -> DataFrame:
    return tracks.select("video", "frame_idx", "track_id", *BOX)


def _sizes(tracks: DataFrame, name: str, key: str) -> DataFrame:
    return tracks.groupBy("video", F.col("track_id").alias(key)).agg(F.count("*").alias(name))


def alignment_pairs(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Overlapping boxes with the global alignment of their tracks.

    A pair of tracks is aligned by its summed relative similarity over the frames
    either is in.
    """
    sim = materialize(iou_join(_slim(gt), _slim(pred)).select("video", "frame_idx", "l_track_id", "r_track_id", "iou"), "hota")
    row = sim.groupBy("video", "frame_idx", "l_track_id").agg(F.sum("iou").alias("_row"))
    col = sim.groupBy("video", "frame_idx", "r_track_id").agg(F.sum("iou").alias("_col"))
    summed = sim.join(row, ["video", "frame_idx", "l_track_id"]).join(col, ["video", "frame_idx", "r_track_id"])
    shared = summed.groupBy("video", "l_track_id", "r_track_id").agg(
        F.sum(F.col("iou") / (F.col("_row") + F.col("_col") - F.col("iou"))).alias("_sim"))
    tracks = shared.join(_sizes(gt, "gt_n", "l_track_id"), ["video", "l_track_id"]).join(
        _sizes(pred, "pred_n", "r_track_id"), ["video", "r_track_id"]).withColumn(
        "alignment", F.col("_sim") / (F.col("gt_n") + F.col("pred_n") - F.col("_sim"))).drop("_sim")
    return sim.join(tracks, ["video", "l_track_id", "r_track_id"])


def hota(gt: DataFrame, pred: DataFrame, combined: bool = True) -> DataFrame:
    """HOTA, DetA, AssA and LocA per video and threshold, with the combination of all videos.

    Boxes are matched once per frame on alignment x similarity; thresholds then count
    the matches similar enough. Each pair of tracks is counted for all thresholds in
    one aggregation, so rows are never multiplied by the thresholds.
    """
    pairs = alignment_pairs(gt, pred)
    matched = match_in_frames(pairs, ["video", "frame_idx"], "frame_idx", ["l_track_id"], ["r_track_id"],
                              [F.round(F.col("alignment") * F.col("iou"), 9)])
    keys = ["video", "l_track_id", "r_track_id", "gt_n", "pred_n"]
    hit = {a: F.col("iou") >= a - 1e-9 for a in ALPHAS}
    per_pair = matched.groupBy(*keys).agg(
        *[F.count_if(hit[a]).alias(f"c{i}") for i, a in enumerate(ALPHAS)],
        *[F.sum(F.when(hit[a], F.col("iou"))).alias(f"s{i}") for i, a in enumerate(ALPHAS)])

    def term(i: int) -> Column:
        c = F.col(f"c{i}")
        return c * c / F.greatest(F.lit(1), F.col("gt_n") + F.col("pred_n") - c)

    per_video = per_pair.groupBy("video").agg(
        *[F.sum(f"c{i}").alias(f"tp{i}") for i in range(len(ALPHAS))],
        *[F.sum(term(i)).alias(f"a{i}") for i in range(len(ALPHAS))],
        *[F.sum(f"s{i}").alias(f"l{i}") for i in range(len(ALPHAS))])
    totals = gt.groupBy("video").agg(F.count("*").alias("gt_dets")).join(
        pred.groupBy("video").agg(F.count("*").alias("pred_dets")), "video", "full").fillna(0)
    long = totals.join(per_video, "video", "left").fillna(0).select(
        "video", "gt_dets", "pred_dets", F.explode(F.array(*[
            F.struct(F.lit(a).alias("alpha"), F.col(f"tp{i}").alias("tp"), F.col(f"a{i}").alias("_ass"),
                     F.col(f"l{i}").alias("_loc")) for i, a in enumerate(ALPHAS)])).alias("_r"),
    ).select("video", "gt_dets", "pred_dets", "_r.*")
    if combined:
        sums = long.groupBy("alpha").agg(*[F.sum(c).alias(c) for c in ("gt_dets", "pred_dets", "tp", "_ass", "_loc")])
        long = long.withColumn("video", F.col("video").cast("string")).unionByName(
            sums.withColumn("video", F.lit("COMBINED")))
    out = long.withColumns({"fn": F.col("gt_dets") - F.col("tp"), "fp": F.col("pred_dets") - F.col("tp"),
                            "AssA": _ratio(F.col("_ass"), F.col("tp")), "LocA": F.when(F.col("tp") > 0, F.col("_loc") / F.col("tp")).otherwise(1.0)})
    out = out.withColumn("DetA", _ratio(F.col("tp"), F.col("tp") + F.col("fn") + F.col("fp")))
    return out.withColumn("HOTA", F.sqrt(F.col("DetA") * F.col("AssA"))).select(
        "video", "alpha", "tp", "fn", "fp", "HOTA", "DetA", "AssA", "LocA")


def hota_mean(per_alpha: DataFrame) -> DataFrame:
    """Means over the thresholds: one row per video."""
    return per_alpha.groupBy("video").agg(*[F.avg(c).alias(f"HOTA_{c}") for c in ("HOTA", "DetA", "AssA")])


def clear_mot(gt: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """MOTA family per video from one-to-one matches at ``threshold``.

    A pair that was matched in the frame before, of those that have both truth and predictions, stays matched
    as long as it is similar enough; others follow by similarity.

    Identity switches compare a track's match with its previous one; fragments count
    the restarts of a track's matched runs. A video without truth has only false positives,
    one without predictions only misses.
    """
    pairs = iou_join(_slim(gt), _slim(pred), threshold).select("video", "frame_idx", F.col("l_track_id").alias("track_id"), F.col("r_track_id").alias("pred_id"), "iou")
    frames = gt.select("video", "frame_idx").distinct().join(pred.select("video", "frame_idx"), ["video", "frame_idx"], "left_semi")
    matched = match_continued(pairs, frames, ["video"], "frame_idx", "track_id", "pred_id", "iou")
    runs = with_neighbours(matched, ["video", "track_id"], "frame_idx", ["frame_idx", "pred_id"], forward=None, backward="prev")
    per_track = runs.groupBy("video", "track_id").agg(
        F.count("*").alias("hits"), F.sum("iou").alias("_iou"),
        F.count_if(F.col("prev_pred_id") != F.col("pred_id")).alias("idsw"),
        F.count_if(F.col("prev_frame_idx") < F.col("frame_idx") - 1).alias("frag"))
    sizes = _sizes(gt, "gt_n", "track_id")
    joined = sizes.join(per_track, ["video", "track_id"], "left").fillna(0)
    share = F.col("hits") / F.col("gt_n")
    out = joined.groupBy("video").agg(
        F.sum("gt_n").alias("gt_dets"), F.sum("hits").alias("tp"), F.sum("idsw").alias("idsw"), F.sum("frag").alias("frag"),
        F.sum("_iou").alias("_iou"), F.count_if(share > 0.8).alias("mt"),
        F.count_if((share >= 0.2) & (share <= 0.8)).alias("pt"), F.count_if(share < 0.2).alias("ml"))
    reported = pred.groupBy("video").agg(F.count("*").alias("pred_dets"))
    out = out.join(reported, "video", "full").fillna(0).withColumns(
        {"fn": F.col("gt_dets") - F.col("tp"), "fp": F.col("pred_dets") - F.col("tp")})
    return out.select("video", "tp", "fn", "fp", "idsw", "frag", "mt", "pt", "ml",
                      _ratio(F.col("tp") - F.col("fp") - F.col("idsw"), F.col("gt_dets")).alias("MOTA"),
                      _ratio(F.col("_iou"), F.col("tp")).alias("MOTP"))


def identity(gt: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """IDF1 family per video: tracks matched one-to-one by the frames they overlap in."""
    shared = iou_join(_slim(gt), _slim(pred), threshold).groupBy("video", "l_track_id", "r_track_id").agg(
        F.count("*").alias("frames"))
    best = one_to_one(shared, ["video"], ["l_track_id"], ["r_track_id"], [F.col("frames")], "identity")
    hit = best.groupBy("video").agg(F.sum("frames").alias("idtp"))
    out = gt.groupBy("video").agg(F.count("*").alias("_g")).join(
        pred.groupBy("video").agg(F.count("*").alias("_p")), "video", "full").join(hit, "video", "left").fillna(0)
    tp = F.col("idtp")
    return out.select("video", "idtp", (F.col("_g") - tp).alias("idfn"), (F.col("_p") - tp).alias("idfp"),
                      _ratio(2 * tp, F.col("_g") + F.col("_p")).alias("IDF1"),
                      _ratio(tp, F.col("_g")).alias("IDR"), _ratio(tp, F.col("_p")).alias("IDP"))


def count_metrics(gt: DataFrame, pred: DataFrame, compat: bool = False) -> DataFrame:
    """Detections and tracks per video; ``compat`` counts tracks as the largest id plus one."""
    def side(df: DataFrame, dets: str, ids: str) -> DataFrame:
        tracks = F.max("track_id") + 1 if compat else F.count_distinct("track_id")
        return df.groupBy("video").agg(F.count("*").alias(dets), tracks.alias(ids))

    return side(gt, "GT_Dets", "GT_IDs").join(side(pred, "Dets", "IDs"), "video", "full").fillna(0)
