"""Joins (survey section 2.3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackgrid.functions import geometry as g
from trackgrid.functions import naming
from trackgrid.scale import null_safe, renamed
from trackgrid.schemas import BOX, MATCH_COLUMNS, PARAMS, VARIANT_KEYS


def _literal(value: object, dtype: str) -> Column:
    return F.lit(value).cast(dtype)


#: Types of the parameter lists a grid is built from.
PARAM_TYPES = {
    "classifier": "string", "tilesize": "int", "sample_rate": "int", "tracking_accuracy_threshold": "double",
    "tilepadding": "string", "canvas_scale": "double", "tracker": "string",
}


def param_grid(df: DataFrame, **choices: list) -> DataFrame:
    """Every combination of the parameter lists for each row of ``df``.

    The lists are configuration, so each becomes an exploded literal array: no join.
    Parameters without a list stay NULL.
    """
    for name, dtype in PARAM_TYPES.items():
        values = choices.get(name) or [None]
        df = df.withColumn(name, F.explode(F.array(*[_literal(v, dtype) for v in values])))
    ident = naming.param_str(F.col("classifier"), F.col("tilesize"), F.col("sample_rate"),
                             F.col("tracking_accuracy_threshold"), F.col("tilepadding"),
                             F.col("canvas_scale"), F.col("tracker"))
    return df.withColumn("variant_id", ident)


def cross_join_manifest(videos: DataFrame, naive: bool = True, **choices: list) -> DataFrame:
    """Videos x variants. With ``naive`` each video also gets the parameterless baseline."""
    system = param_grid(videos, **choices).withColumn("variant", F.lit("system"))
    if not naive:
        return system
    baseline = param_grid(videos).withColumn("variant_id", F.lit("naive")).withColumn("variant", F.lit("naive"))
    return system.unionByName(baseline)


def rate_grids(df: DataFrame, choices: list[int], cells: int) -> DataFrame:
    """Add every assignment of a rate to each of ``cells`` cells: ``grid_key`` and ``grid``."""
    n = len(choices)
    digits = F.transform(
        F.sequence(F.lit(0), F.lit(cells - 1)),
        lambda i: F.element_at(F.array(*[F.lit(c) for c in choices]),
                               (F.floor(F.col("_g") / F.pow(F.lit(n), F.lit(cells - 1) - i)) % n + 1).cast("int")),
    )
    return (
        df.withColumn("_g", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n**cells - 1).cast("bigint"))))
        .withColumn("grid", digits).withColumn("grid_key", naming.encode_rate_grid(F.col("grid"))).drop("_g")
    )


TRADEOFF_COLUMNS = [*VARIANT_KEYS, *PARAMS, "frame_count", "time", "throughput_fps"]


def join_accuracy_runtime(accuracy: DataFrame, runtime: DataFrame, required: bool = False) -> DataFrame:
    """Accuracy and runtime of each variant; ``required`` fails when nothing joins."""
    metrics = [c for c in accuracy.columns if c not in VARIANT_KEYS + PARAMS]
    params = [c for c in PARAMS if c in accuracy.columns]
    measured = [c for c in runtime.columns if c not in VARIANT_KEYS + PARAMS]
    out = accuracy.join(runtime.select(*VARIANT_KEYS, *measured), VARIANT_KEYS).select(
        *VARIANT_KEYS, *params, *measured, *metrics)
    if required and out.isEmpty():
        raise ValueError("accuracy and runtime tables share no variant")
    return out


def attach_naive_baseline(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``<column>_naive`` of the split's baseline variant."""
    keys = ["dataset", "videoset"]
    base = df.where("variant = 'naive'").groupBy(*keys).agg(*[F.max(c).alias(f"{c}_naive") for c in columns])
    return df.where("variant <> 'naive'").join(base, keys, "left")


def attach_frame_counts(df: DataFrame, frames: DataFrame) -> DataFrame:
    return df.join(frames.select("video", "frame_count"), "video")


def split_frame_counts(df: DataFrame) -> DataFrame:
    """One frame count per split (the largest known one)."""
    return df.groupBy("dataset", "videoset").agg(F.max("frame_count").alias("frame_count"))


def select_by_pareto(valid: DataFrame, test: DataFrame, accuracy: str, time: str = "time") -> DataFrame:
    """Test rows whose parameters are on the validation front of their dataset.

    NULL parameters equal each other. Datasets without any match keep all their
    test rows, which also covers a missing validation split or metric.
    """
    from trackgrid.operators.pareto import pareto_front

    cols = [c for c in MATCH_COLUMNS if c in valid.columns and c in test.columns]
    if not cols:
        return test
    front = pareto_front(valid, time, accuracy, min_x=True, min_y=False, by=["dataset"])
    keys = ["dataset", *cols]
    allowed = front.select(*keys).distinct()
    probe = test.join(renamed(allowed, keys, "_k_").withColumn("_hit", F.lit(1)),
                      reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]),
                      "left").select(*test.columns, "_hit")
    matched = probe.where("_hit = 1").select("dataset").distinct()
    fallback = test.join(renamed(matched, ["dataset"], "_m_"),
                         F.col("dataset").eqNullSafe(F.col("_m_dataset")), "left_anti")
    return probe.where("_hit = 1").drop("_hit").unionByName(fallback)


def stage_params(front: DataFrame, columns: list[str], collapse_tracker: bool = False) -> DataFrame:
    """Distinct parameter combinations of a stage.

    With ``collapse_tracker`` the tracker becomes NULL where no threshold is set,
    because unpruned stages do not depend on it.
    """
    out = front.select(*columns)
    if collapse_tracker and {"tracker", "tracking_accuracy_threshold"} <= set(columns):
        out = out.withColumn("tracker", F.when(F.col("tracking_accuracy_threshold").isNotNull(), F.col("tracker")))
    return out.distinct()


def combo_filter(df: DataFrame, front: DataFrame, columns: list[str], collapse_tracker: bool = False) -> DataFrame:
    """Rows whose parameter combination the front allows, NULL-safe."""
    allowed = stage_params(front, ["dataset", *columns], collapse_tracker)
    return df.join(allowed, null_safe(df, allowed, ["dataset", *columns]), "left_semi")


def missing_rows(expected: DataFrame, available: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(available, null_safe(expected, available, keys), "left_anti")


def unexpected_rows(expected: DataFrame, available: DataFrame, keys: list[str]) -> DataFrame:
    return missing_rows(available, expected, keys)


#: Videos of a tile of :func:`params_per_video`, and parts the parameter rows of a split are dealt in.
VIDEOS_PER_TILE, PARAM_SLICES = 1024, 32


def params_per_video(params: DataFrame, videos: DataFrame) -> DataFrame:
    """Every parameter row of a split with every video of it.

    The product is large whatever is done, so it is dealt by slices of the parameter rows, and it comes out tile by tile: the same
    videos beside one parameter row after the other. A columnar file holds such short repeats in a small part
    of what rows take that run through all videos of the split.
    """
    keys = ["dataset", "videoset"]
    held = [c for c in videos.columns if c not in keys]
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*(held or keys)))
    tiles = videos.withColumn("_tile", F.floor((number - 1) / VIDEOS_PER_TILE)).groupBy(*keys, "_tile").agg(
        F.collect_list(F.struct(*(held or ["_tile"]))).alias("_videos"))
    dealt = tiles.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(PARAM_SLICES - 1))))
    # A number of partitions is given since these rows are few: dealt by their size, one task would make the whole product.
    dealt = dealt.repartition(int(videos.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_slice")
    sliced = params.withColumn("_slice", F.pmod(F.xxhash64(*params.columns), F.lit(PARAM_SLICES)).cast("int"))
    pairs = dealt.join(sliced, [*keys, "_slice"]).withColumn("_video", F.explode("_videos"))
    return pairs.select(*keys, *[c for c in params.columns if c not in keys], *[F.col(f"_video.{c}").alias(c) for c in held])


# --- spatial joins ---------------------------------------------------------

def _spatial_keys(df: DataFrame, cell: int, b: g.Box) -> DataFrame:
    def span(lo: Column, hi: Column) -> Column:
        return F.sequence(F.floor(lo / cell), F.floor(hi / cell))

    return df.withColumn("_cx", F.explode(span(b.x1, b.x2))).withColumn("_cy", F.explode(span(b.y1, b.y2)))


def overlap_pairs(left: DataFrame, right: DataFrame, frame: list[str], cell: int = 256,
                  closed: bool = False) -> DataFrame:
    """Overlapping box pairs; columns other than ``frame`` come out as ``l_*`` / ``r_*``.

    Boxes are keyed by the cells of a coarse grid they touch, so boxes that cannot
    meet are never paired; a pair is reported only by the cell that holds the upper
    left corner of the shared area, so no duplicate removal is needed.
    """
    lcols = [c for c in left.columns if c not in frame]
    rcols = [c for c in right.columns if c not in frame]
    lk = _spatial_keys(renamed(left, lcols, "l_"), cell, g.box("l_"))
    rk = _spatial_keys(renamed(right, rcols, "r_"), cell, g.box("r_"))
    a, b = g.box("l_"), g.box("r_")
    meets = g.overlap2d(a, b) if closed else (
        (F.least(a.x2, b.x2) > F.greatest(a.x1, b.x1)) & (F.least(a.y2, b.y2) > F.greatest(a.y1, b.y1)))
    owner = (F.col("_cx") == F.floor(F.greatest(a.x1, b.x1) / cell)) & (
        F.col("_cy") == F.floor(F.greatest(a.y1, b.y1) / cell))
    return lk.join(rk, [*frame, "_cx", "_cy"]).where(meets & owner).drop("_cx", "_cy")


def _margins(box: g.Box, similarity: str, least: float, reach: float | None) -> tuple[Column, Column]:
    """How far a box is grown on each side so that all pairs of at least ``least`` touch."""
    if reach is not None:
        return F.lit(reach / 2), F.lit(reach / 2)
    if similarity == "giou" and least > 0:
        # Apart, the value is at most half the union's share of the hull: the hull is no wider than both boxes by 1 / (2 least).
        grow = max(0.0, 1 / (2 * least) - 1)
        return box.width * grow, box.height * grow
    if similarity in ("diou", "ciou") and least > 0:
        # Apart, the centres are at most sqrt(1 - 2 least) of the hull's diagonal from each other.
        share = max(0.0, 1 - 2 * least) ** 0.5
        grow = F.sqrt(box.width * box.width + box.height * box.height) * (share / (1 - share) / 2)
        return grow, grow
    raise ValueError(f"{similarity} of at least {least} needs a search radius: pass reach")


def near_pairs(left: DataFrame, right: DataFrame, frame: list[str], cell: int, similarity: str, least: float, reach: float | None) -> DataFrame:
    """Candidate pairs of a similarity that does not end where overlap ends."""
    def grown(df: DataFrame) -> DataFrame:
        mx, my = _margins(g.box(), similarity, least, reach)
        held = df.withColumns({f"_{c}": F.col(c) for c in ("x1", "y1", "x2", "y2")})
        return held.withColumns({"x1": F.col("x1") - mx, "y1": F.col("y1") - my, "x2": F.col("x2") + mx, "y2": F.col("y2") + my})

    pairs = overlap_pairs(grown(left), grown(right), frame, cell, closed=True)
    back = {f"{s}{c}": F.col(f"{s}_{c}") for s in ("l_", "r_") for c in ("x1", "y1", "x2", "y2")}
    return pairs.withColumns(back).drop(*[f"{s}_{c}" for s in ("l_", "r_") for c in ("x1", "y1", "x2", "y2")])


def iou_join(left: DataFrame, right: DataFrame, min_iou: float = 0.0, frame: list[str] | None = None,
             cell: int = 256, similarity: str = "iou", reach: float | None = None) -> DataFrame:
    """Pairs of boxes of the same frame with a similarity of at least ``min_iou``.

    Measures that boxes apart can reach find their candidates in a radius that follows from
    the threshold. Where none does (a threshold of 0, or ``ct_dist``), ``reach`` gives the
    largest distance in pixels between the edges of a pair.
    """
    from trackgrid.registry import ASSOCIATION

    frame = frame or ["video", "frame_idx"]
    if similarity in ("iou", "iou_plus1") and reach is None:
        pairs = overlap_pairs(left, right, frame, cell)
    else:
        pairs = near_pairs(left, right, frame, cell, similarity, min_iou, reach)
    if similarity == "ct_dist":
        return with_center_similarity(pairs, frame).withColumnRenamed("center_similarity", "iou").where(F.col("iou") >= min_iou)
    return pairs.withColumn("iou", ASSOCIATION[similarity](g.box("l_"), g.box("r_"))).where(F.col("iou") >= min_iou)


def sweep_join(left: DataFrame, right: DataFrame, gaps: list[int], min_iou: float, by: list[str], step: tuple[str, str] | None = None,
               cell: int = 256, similarity: str = "iou") -> DataFrame:
    """Pairs of a box and one ``gap`` frames later, for all ``gaps`` at once, with a similarity of at least ``min_iou``.

    ``step`` names the columns of a left box's movement per frame (x, y), which it follows up to the later frame. Boxes meet
    by runs of frames as long as the gaps reach and by the cells that they pass in them, so a left box is sent once or
    twice and not once for every gap. ``frame_idx`` is the later frame; ``l_frame`` and ``l_gap`` come along.
    """
    from trackgrid.registry import ASSOCIATION

    low, high = min(gaps), max(gaps)
    width = high - low + 1
    lcols, rcols = ([c for c in df.columns if c not in by] for df in (left, right))
    start, run = F.col("l_frame_idx"), F.col("_run")
    near, far = F.greatest(F.lit(low), run * width - start), F.least(F.lit(high), run * width + width - 1 - start)

    def at(c: str, gap: Column) -> Column:
        return F.col(f"l_{c}") + F.col(f"l_{step[c[0] == 'y']}") * gap if step else F.col(f"l_{c}")

    passed = g.Box(*[pick(at(c, near), at(c, far)) for c, pick in zip(BOX, (F.least, F.least, F.greatest, F.greatest))])
    runs = F.sequence(F.floor((start + low) / width), F.floor((start + high) / width))
    lk = _spatial_keys(renamed(left, lcols, "l_").withColumn("_run", F.explode(runs)), cell, passed)
    rk = _spatial_keys(renamed(right, rcols, "r_").withColumn("_run", F.floor(F.col("r_frame_idx") / width)), cell, g.box("r_"))
    pairs = lk.join(rk, [*by, "_run", "_cx", "_cy"]).withColumn("l_gap", (F.col("r_frame_idx") - start).cast("bigint")).where(
        F.col("l_gap").isin([int(i) for i in gaps]))
    pairs = pairs.withColumns({f"l_{c}": at(c, F.col("l_gap")) for c in BOX})
    a, b = g.box("l_"), g.box("r_")
    left_edge, top_edge = F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1)
    meets = (F.least(a.x2, b.x2) > left_edge) & (F.least(a.y2, b.y2) > top_edge)
    owner = (F.col("_cx") == F.floor(left_edge / cell)) & (F.col("_cy") == F.floor(top_edge / cell))
    return pairs.where(meets & owner).drop("_run", "_cx", "_cy").withColumnsRenamed({"l_frame_idx": "l_frame", "r_frame_idx": "frame_idx"}).withColumn(
        "iou", ASSOCIATION[similarity](a, b)).where(F.col("iou") >= min_iou)


def with_center_similarity(pairs: DataFrame, frame: list[str]) -> DataFrame:
    """Add ``center_similarity``: centre distance over the largest of the frame, reversed.

    The largest distance is a partial aggregation joined back, so a crowded frame's pairs stay spread.
    """
    far = pairs.withColumn("_d", g.center_distance(g.box("l_"), g.box("r_")))
    top = far.groupBy(*frame).agg(F.max("_d").alias("_top"))
    value = F.when(F.col("_top") > 0, (F.col("_top") - F.col("_d")) / F.col("_top")).otherwise(F.lit(0.0))
    return far.join(top, frame).withColumn("center_similarity", value).drop("_d", "_top")


def overlap_join(left: DataFrame, right: DataFrame, frame: list[str] | None = None, cell: int = 256) -> DataFrame:
    """Pairs of boxes of the same frame that touch (closed intervals)."""
    return overlap_pairs(left, right, frame or ["video", "frame_idx"], cell, closed=True)


# --- collages --------------------------------------------------------------

COLLAGE = ["video", "collage_idx"]


def unpack_detections(dets: DataFrame, index_map: DataFrame, placements: DataFrame, tilesize: int,
                      rows: int, cols: int) -> DataFrame:
    """Canvas boxes mapped back to frames.

    Each box probes centre, then its four corners; the first probe on an occupied
    tile names its group. ``status`` is ``mapped`` or ``no_tile``; ``center_missed``
    marks boxes with an empty in-grid probe before the hit. ``dets`` needs a
    ``det_id`` unique within its collage.
    """
    b = g.box()
    points = [(b.cx, b.cy), (b.x1, b.y1), (b.x2, b.y1), (b.x1, b.y2), (b.x2, b.y2)]
    probes = F.array(*[
        F.struct(F.lit(i).alias("probe"), g.tile_of(x, tilesize).alias("col"), g.tile_of(y, tilesize).alias("row"))
        for i, (x, y) in enumerate(points)])
    key = [*COLLAGE, "det_id"]
    probed = dets.select(*key, *BOX, F.explode(probes).alias("_p")).select(*key, *BOX, "_p.*").where(
        g.tile_in_grid(F.col("row"), F.col("col"), rows, cols))
    hits = probed.join(index_map.select(*COLLAGE, "row", "col", "group_id"), [*COLLAGE, "row", "col"], "left")
    first = hits.groupBy(*key).agg(
        F.min_by("group_id", F.when(F.col("group_id").isNotNull(), F.col("probe"))).alias("group_id"),
        F.min(F.when(F.col("group_id").isNotNull(), F.col("probe"))).alias("_hit"),
        F.min(F.when(F.col("group_id").isNull(), F.col("probe"))).alias("_miss"),
    )
    located = dets.join(first, key, "left").join(
        placements.select(*COLLAGE, "group_id", "frame_idx", "py", "px", "oy", "ox"), [*COLLAGE, "group_id"], "left")
    dx = (F.col("ox") - F.col("px")) * tilesize
    dy = (F.col("oy") - F.col("py")) * tilesize
    missed = F.col("_miss").isNotNull() & (F.col("_hit").isNull() | (F.col("_miss") < F.col("_hit")))
    return located.select(
        *key, "frame_idx", "group_id",
        (F.col("x1") + dx).alias("x1"), (F.col("y1") + dy).alias("y1"),
        (F.col("x2") + dx).alias("x2"), (F.col("y2") + dy).alias("y2"),
        F.when(F.col("group_id").isNull(), "no_tile").otherwise("mapped").alias("status"),
        missed.alias("center_missed"),
    )


def project_annotations(tracks: DataFrame, placements: DataFrame, index_map: DataFrame, tilesize: int,
                        canvas_width: float, canvas_height: float) -> DataFrame:
    """Frame boxes projected onto the collages their centre tile was placed in, clipped to the canvas.

    The source tile of every placed cell is computed once, which turns the search
    over a frame's groups into an equi-join on the centre tile.
    """
    source = index_map.join(placements, [*COLLAGE, "group_id"]).select(
        *COLLAGE, "group_id", "frame_idx",
        (F.col("row") - F.col("py") + F.col("oy")).alias("row"),
        (F.col("col") - F.col("px") + F.col("ox")).alias("col"),
        ((F.col("px") - F.col("ox")) * tilesize).alias("_dx"),
        ((F.col("py") - F.col("oy")) * tilesize).alias("_dy"),
    )
    first = source.groupBy("video", "collage_idx", "frame_idx", "row", "col").agg(
        F.min("group_id").alias("_g"), F.min_by("_dx", "group_id").alias("_dx"), F.min_by("_dy", "group_id").alias("_dy"))
    b = g.box()
    keyed = tracks.withColumns({"row": g.tile_of(b.cy, tilesize), "col": g.tile_of(b.cx, tilesize)})
    found = keyed.join(first, ["video", "frame_idx", "row", "col"])
    moved = g.Box(b.x1 + F.col("_dx"), b.y1 + F.col("_dy"), b.x2 + F.col("_dx"), b.y2 + F.col("_dy"))
    out = g.clip(moved, 0, 0, canvas_width, canvas_height)
    return found.select(
        *COLLAGE, F.col("_g").alias("group_id"), "frame_idx", "track_id",
        *[c.alias(n) for n, c in zip(BOX, out)],
    ).where("x2 > x1 AND y2 > y1")


def video_number_join(videos: DataFrame, files: DataFrame) -> DataFrame:
    """Competitor files joined to videos by the number in the video's name."""
    numbered = videos.withColumn("video_id", naming.video_number(F.col("video")))
    unique = numbered.withColumn("_n", F.count("*").over(Window.partitionBy("video_id")))
    checked = unique.where(F.assert_true(F.col("_n") == 1, "video numbers are not unique").isNull()).drop("_n")
    return checked.join(files, "video_id")


def align_frames(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Predicted and true tile scores side by side; a tile absent on one side is NULL there."""
    keys = ["video", "frame_idx", "row", "col"]
    return pred.select(*keys, F.col("score").alias("pred_score")).join(
        truth.select(*keys, F.col("score").alias("true_score")), keys, "full")


def resolve_truth_source(df: DataFrame) -> DataFrame:
    """Where a split's reference tracks come from: baseline tracks for ``valid``, annotations for ``test``."""
    return df.withColumns({
        "truth_dataset": naming.dataset_root(F.col("dataset")),
        "truth_source": F.when(F.col("videoset") == "valid", "naive").otherwise("groundtruth"),
    })
