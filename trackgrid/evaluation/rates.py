"""Association accuracy per tile and learned sampling rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackgrid.evaluation.metrics import _slim
from trackgrid.operators import aggregates as agg
from trackgrid.operators.filters import filter_by_active_tile
from trackgrid.operators.joins import iou_join, rate_grids
from trackgrid.operators.matching import match_boxes, match_in_frames
from trackgrid.operators.pruning import apply_selection, prune_groups
from trackgrid.operators.tiles import boxes_to_cells, boxes_to_tiles, center_cell
from trackgrid.operators.trajectories import anchor_consistency, association_consistent, at_rates, holds_around, with_presence
from trackgrid.scale import BLOCK, materialize, with_neighbours
from trackgrid.schemas import BOX


RATE_FRAME = ["rate", "video", "frame_idx"]


def consistent_matches(gt: DataFrame, sampled: DataFrame, min_iou: float = 0.3) -> DataFrame:
    """Matched boxes of every rate with ``correct``: the association holds both ways.

    Both tables carry ``rate``; all rates are matched together, keyed apart.
    """
    keys = ["rate", "video", "track_id"]
    # Steps are written one after the other, so that the disks hold the shuffles of one and not of all.
    left, right = (materialize(with_presence(t.select(*RATE_FRAME, "track_id", *BOX), keys), "presence") for t in (gt, sampled))
    # Pairs leave their boxes behind before they are dealt again.
    pairs = iou_join(left, right, min_iou, RATE_FRAME).drop(*[f"{side}_{c}" for side in ("l", "r") for c in BOX])
    matched = match_in_frames(materialize(pairs, "presence"), RATE_FRAME, "frame_idx", ["l_track_id"], ["r_track_id"], [F.col("iou")])
    return association_consistent(materialize(matched, "presence"))


def assoc_counts(gt: DataFrame, sampled: DataFrame, rates: list[int], tilesize: int, rows: int, cols: int,
                 min_iou: float = 0.3) -> DataFrame:
    """Correct and incorrect associations per rate and tile of the truth box; unmatched boxes are incorrect.

    ``sampled`` holds the tracks obtained at each rate (column ``rate``).
    """
    truth = at_rates(_slim(gt), rates)
    seen = sampled.where(F.col("rate").isin(rates) & (F.col("frame_idx") % F.col("rate") == 0))
    good = materialize(consistent_matches(truth, seen, min_iou).select(*RATE_FRAME, F.col("l_track_id").alias("track_id"), "correct"), "presence")
    boxes = truth.join(good, [*RATE_FRAME, "track_id"], "left").withColumn("correct", F.coalesce("correct", F.lit(False)))
    tiles = boxes_to_tiles(boxes, tilesize, rows, cols)
    return tiles.groupBy("rate", "row", "col").agg(
        F.count_if("correct").alias("correct"), F.count_if(~F.col("correct")).alias("incorrect"))


def laplace_accuracy(counts: DataFrame, rates: list[int], rows: int, cols: int) -> DataFrame:
    """(correct + 1) / (correct + incorrect + 2) for every rate and tile; unseen tiles get 0.5.

    The full grid is configuration: it is unioned in as zero counts, not joined.
    """
    spark = counts.sparkSession
    cells = spark.range(rows * cols * len(rates)).select(
        F.floor(F.col("id") / len(rates) / cols).alias("row"), (F.floor(F.col("id") / len(rates)) % cols).alias("col"),
        F.element_at(F.array(*[F.lit(r).cast("bigint") for r in rates]), (F.col("id") % len(rates) + 1).cast("int")).alias("rate"),
        F.lit(0).cast("bigint").alias("correct"), F.lit(0).cast("bigint").alias("incorrect"))
    full = counts.select("row", "col", "rate", "correct", "incorrect").unionByName(cells)
    sums = full.groupBy("row", "col", "rate").agg(F.sum("correct").alias("correct"), F.sum("incorrect").alias("incorrect"))
    return sums.withColumn("accuracy", (F.col("correct") + 1) / (F.col("correct") + F.col("incorrect") + 2))


def max_rate_table(accuracy: DataFrame, thresholds: list[float], lowest: int = 1) -> DataFrame:
    """Highest rate of each tile whose accuracy meets the threshold, else the lowest rate."""
    meets = accuracy.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return meets.groupBy("row", "col", "threshold").agg(
        F.coalesce(F.max(F.when(F.col("accuracy") >= F.col("threshold"), F.col("rate"))),
                   F.lit(lowest).cast("bigint")).alias("max_rate"))


def learn_rates(gt: DataFrame, sampled: DataFrame, rates: list[int], tilesize: int, rows: int, cols: int,
                thresholds: list[float], min_iou: float = 0.3) -> DataFrame:
    """Rate table from the tracks obtained at each sampling rate (column ``rate`` of ``sampled``)."""
    counts = assoc_counts(gt, sampled, rates, tilesize, rows, cols, min_iou)
    return max_rate_table(laplace_accuracy(counts, rates, rows, cols), thresholds, min(rates))


def schedule_mistrack(gt: DataFrame, pred: DataFrame, retained: DataFrame, width: float, height: float, rows: int,
                      cols: int, min_iou: float = 0.3) -> DataFrame:
    """Truth boxes whose centre cell was retained, with whether their association holds at adjacent ones."""
    anchors = filter_by_active_tile(_slim(gt), retained, width, height, rows, cols)
    matches = match_boxes(_slim(gt), _slim(pred), min_iou).select("video", "frame_idx", "l_track_id", "r_track_id")
    return anchor_consistency(anchors, matches)


def relevance_cells(tracks: DataFrame, width: float, height: float, rows: int, cols: int) -> DataFrame:
    return boxes_to_cells(_slim(tracks), width, height, rows, cols).select("video", "frame_idx", "row", "col").distinct()


def whole_frame_baseline(cells: DataFrame, rates: list[int]) -> DataFrame:
    """Cells kept when whole frames are sampled at each rate (``variant_id`` = ``frame_<rate>``)."""
    rate = F.explode(F.array(*[F.lit(r) for r in rates]))
    return cells.withColumn("_r", rate).where(F.col("frame_idx") % F.col("_r") == 0).withColumn(
        "variant_id", F.concat(F.lit("frame_"), F.col("_r").cast("string"))).drop("_r")


def evaluate_schedules(gt: DataFrame, matches: DataFrame, cells: DataFrame, schedules: DataFrame, width: float,
                       height: float, rows: int, cols: int) -> DataFrame:
    """Retention and mistrack rate of every schedule of retained cells (keyed by ``variant_id``).

    ``matches`` pairs truth and predicted boxes; it is shared by all variants.
    """
    kept = schedules.groupBy("variant_id").agg(F.count("*").alias("retained"))
    located = center_cell(_slim(gt), width, height, rows, cols)
    anchors = located.join(schedules, ["video", "frame_idx", "row", "col"]).select(
        "variant_id", "video", "frame_idx", "track_id")
    wrong = agg.mistrack_rate(anchor_consistency(anchors, matches), ["variant_id"])
    return _with_retention(kept.join(wrong, "variant_id", "left"), cells)


def _with_retention(variants: DataFrame, cells: DataFrame) -> DataFrame:
    total = cells.agg(F.count("*").alias("original"))
    return variants.join(total).withColumn("retention_rate", F.coalesce(
        F.try_divide(F.col("retained").cast("double"), F.col("original").cast("double")), F.lit(0.0)))


def kept_cells(cells: DataFrame, choices: list[int]) -> DataFrame:
    """Frames at which each cell is kept under each rate: first and last cover of every run of rate + 1 frames.

    Cells count as their own group, so a cell's schedule depends on its own rate only.
    """
    rate = F.explode(F.array(*[F.lit(c).cast("bigint") for c in choices]))
    run = F.floor(F.col("frame_idx") / (F.col("rate") + 1)).alias("_run")
    runs = cells.withColumn("rate", rate).groupBy("video", "row", "col", "rate", run).agg(
        F.min("frame_idx").alias("_a"), F.max("frame_idx").alias("_b"))
    return runs.select("video", "row", "col", "rate", F.explode(F.array_distinct(F.array("_a", "_b"))).alias("frame_idx"))


def evaluate_rate_grids(gt: DataFrame, matches: DataFrame, cells: DataFrame, choices: list[int], width: float, height: float,
                        rows: int, cols: int, existing: DataFrame | None = None) -> DataFrame:
    """Retention and mistrack rate of every assignment of a rate to every cell, ``grid_<r>-<r>-...``.

    A track only feels the rates of the cells it visits. Tracks are therefore
    evaluated once per assignment of *their* cells (``sub``), keyed by the set of
    cells; every grid then adds up the sub-assignments it contains. The data is
    multiplied by choices ** visited cells instead of choices ** all cells. Variants
    in ``existing`` (column ``variant_id``) are left out.
    """
    n, size = rows * cols, len(choices)
    cells = materialize(cells, "cells")
    kept = materialize(kept_cells(cells, choices), "grids")
    matches = materialize(matches.select("video", "frame_idx", "l_track_id", "r_track_id"), "matches")
    cell = (F.col("row") * cols + F.col("col")).cast("int")
    located = center_cell(_slim(gt), width, height, rows, cols).where("row IS NOT NULL").select(
        "video", "frame_idx", "track_id", cell.alias("cell"), F.floor(F.col("frame_idx") / BLOCK).alias("_blk"))
    # Rows are multiplied last, where they lie: what a box needs is gathered by frame, then dealt once by blocks of a track.
    frame = ["video", "frame_idx"]
    held = kept.select(*frame, cell.alias("cell"), "rate").repartition(*frame).groupBy(*frame, "cell").agg(F.collect_set("rate").alias("_kept"))
    pair = matches.select(*frame, F.col("l_track_id").alias("track_id"), F.col("r_track_id").alias("_pred")).repartition(*frame)
    boxes = located.repartition(*frame).join(held, [*frame, "cell"]).join(pair, [*frame, "track_id"], "left")
    visits = located.groupBy("video", "track_id").agg(F.array_sort(F.collect_set("cell")).alias("visited"), F.collect_set("_blk").alias("_blks"))
    visits = visits.select("video", "track_id", "visited", (F.size("_blks") > 1).alias("_spans"), F.explode("_blks").alias("_blk"))
    k = F.size("visited")
    index = F.explode(F.sequence(F.lit(0).cast("bigint"), F.pow(F.lit(size), k).cast("bigint") - 1))
    options = F.array(*[F.lit(c).cast("bigint") for c in choices])

    def rate(i: Column) -> Column:
        """Rate of the ``i``-th visited cell in assignment ``_i``."""
        return F.element_at(options, (F.floor(F.col("_i") / F.pow(F.lit(size), k - 1 - i)) % size + 1).cast("int"))

    own = rate(F.array_position("visited", F.col("cell")) - 1)
    anchors = boxes.repartition("video", "track_id", "_blk").join(visits, ["video", "track_id", "_blk"]).withColumn("_i", index).where(F.array_contains("_kept", own)).select(
        "_spans", "_i", "visited", "video", "track_id", "_blk", "frame_idx", "_pred")
    w = Window.partitionBy("video", "track_id", "_blk", "_i").orderBy("frame_idx")
    seen = F.struct("frame_idx", "_pred")
    # Only tracks that go on in another block need its border.
    short = anchors.where(~F.col("_spans")).withColumns({"_n": F.lead(seen).over(w), "_p": F.lag(seen).over(w)}).select(
        "visited", "_i", "_pred", *[F.col(f"{c}.{v}").alias(f"{way}_{v}") for c, way in (("_n", "next"), ("_p", "prev")) for v in ("frame_idx", "_pred")])
    far = with_neighbours(anchors.where("_spans"), ["_i", "video", "track_id"], "frame_idx", ["frame_idx", "_pred"], backward="prev")
    ok = holds_around("_pred")
    per_sub = short.unionByName(far.select(*short.columns)).groupBy("visited", "_i").agg(
        F.count_if(ok).alias("correct"), F.count_if(~ok).alias("incorrect"))
    per_sub = materialize(per_sub, "subs").select(
        "visited", "correct", "incorrect", F.concat_ws("|", F.array_join("visited", ","), F.array_join(
            F.transform("visited", lambda v, i: rate(i)), "-")).alias("sub"))

    def grids(df: DataFrame) -> DataFrame:
        out = rate_grids(df, choices, n).withColumn("variant_id", F.concat(F.lit("grid_"), F.col("grid_key")))
        return out if existing is None else out.join(existing.select("variant_id").distinct(), "variant_id", "left_anti")

    part = F.array_join(F.transform("visited", lambda c: F.element_at(F.col("grid"), c + 1)), "-")
    held = grids(per_sub.select("visited").distinct()).withColumn("sub", F.concat_ws("|", F.array_join("visited", ","), part)).join(
        per_sub.drop("visited"), "sub").groupBy("variant_id").agg(F.sum("correct").alias("correct"), F.sum("incorrect").alias("incorrect"))
    per_cell = kept.groupBy(cell.alias("cell"), "rate").agg(F.count("*").alias("n"))
    sized = grids(cells.sparkSession.range(1).drop("id")).select("variant_id", F.posexplode("grid").alias("cell", "rate")).join(
        per_cell, ["cell", "rate"], "left").groupBy("variant_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("retained"))
    out = sized.join(held, "variant_id", "left").fillna(0, subset=["correct", "incorrect"]).withColumn(
        "mistrack_rate", F.coalesce(F.try_divide(F.col("incorrect").cast("double"), F.col("correct") + F.col("incorrect")), F.lit(0.0)))
    return _with_retention(out, cells)


def pruned_detections(dets: DataFrame, groups: DataFrame, rates: DataFrame, width: float, height: float, rows: int,
                      cols: int) -> DataFrame:
    """Detections left when only the selected tile groups are kept."""
    kept = apply_selection(groups, prune_groups(groups, rates)).select("video", "frame_idx", "row", "col").distinct()
    return filter_by_active_tile(dets, kept, width, height, rows, cols)
