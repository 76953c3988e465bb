"""Projections, filters and sampling (survey section 2.2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackgrid.functions import geometry as g
from trackgrid.scale import with_rank
from trackgrid.schemas import BOX


def filter_class(df: DataFrame, classes: list[str], column: str = "class") -> DataFrame:
    return df.where(F.col(column).isin(classes))


def threshold_tiles(df: DataFrame, threshold: float, mode: str = "prune") -> DataFrame:
    """Relevant tiles. ``prune``: score >= t; ``compress``: score > t*255; ``evaluate``: score/255 >= t."""
    score = F.col("score")
    keep = {
        "prune": score >= threshold,
        "compress": score > threshold * 255,
        "evaluate": score / 255 >= threshold,
    }[mode]
    return df.where(keep)


def sample_frames(df: DataFrame, rate: int, frame_count: Column | None = None) -> DataFrame:
    """Every ``rate``-th frame; with ``frame_count`` the last frame is always kept."""
    keep = F.col("frame_idx") % rate == 0
    if frame_count is not None:
        keep = keep | (F.col("frame_idx") == frame_count - 1)
    return df.where(keep)


def fps_step(fps: Column) -> Column:
    """Decoding step per source frame rate; other rates are an error."""
    return (
        F.when(fps == 15, 1)
        .when(fps.between(29, 31), 2)
        .when(fps.between(59, 60.1), 4)
        .otherwise(F.raise_error(F.concat(F.lit("unsupported frame rate "), fps.cast("string"))).cast("int"))
    )


def frame_stride(fps: Column, stride: int) -> Column:
    return F.when(fps > 20, 2 * stride).otherwise(stride)


def downsample_2x(df: DataFrame) -> DataFrame:
    """Halve the frame rate: even frames, renumbered."""
    return df.where(F.col("frame_idx") % 2 == 0).withColumn("frame_idx", F.expr("frame_idx div 2"))


def linspace_frames(df: DataFrame, count: str, fps: float, target_fps: float) -> DataFrame:
    """Evenly spaced frame ids of each row's ``count`` frames, truncated to whole frames."""
    m = F.greatest(F.lit(1), F.floor(F.col(count) * target_fps / fps)).cast("bigint")
    step = F.when(m > 1, (F.col(count) - 1) / (m - 1)).otherwise(F.lit(0.0))
    return df.withColumn("_m", m).withColumn("_step", step).withColumn(
        "_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_m") - 1))
    ).withColumn(
        "frame_idx",
        F.when((F.col("_m") > 1) & (F.col("_i") == F.col("_m") - 1), F.col(count) - 1)
        .otherwise(F.floor(F.col("_i") * F.col("_step"))).cast("bigint"),
    ).drop("_m", "_i", "_step").distinct()


def sample_linspace(df: DataFrame, videos: DataFrame, fps: float, target_fps: float) -> DataFrame:
    """Rows of ``df`` at evenly spaced frames of each video (``videos``: video, frame_count)."""
    ids = linspace_frames(videos.select("video", "frame_count"), "frame_count", fps, target_fps)
    return df.join(ids.select("video", "frame_idx"), ["video", "frame_idx"], "left_semi")


def segment_of(frame: Column, frame_count: Column, segments: int) -> Column:
    """Segment whose half-open frame range [n*i div k, n*(i+1) div k) holds the frame."""
    guess = F.floor((frame * segments) / frame_count)
    upper = F.floor(frame_count * (guess + 1) / segments)
    return F.when(frame >= upper, guess + 1).otherwise(guess).cast("bigint")


def segment_range(frame_count: Column, i: Column, segments: int) -> list[Column]:
    return [F.floor(frame_count * i / segments).alias("start_frame"),
            F.floor(frame_count * (i + 1) / segments).alias("end_frame")]


def ordered_by_hash(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Add ``rank``, the 0-based position of each row in md5(seed, key) order, and ``total``.

    Rows are numbered inside the ranges of the digest's leading four digits and the
    65,536 range sizes are then added up, so no task ever sorts the whole table.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    hashed = df.withColumn("_h", digest).withColumn("_p", F.substring(digest, 1, 4))
    local = hashed.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("_h", key)))
    sizes = hashed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_p", F.coalesce(before, F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy()).alias("total"))
    return local.join(starts, "_p").withColumn("rank", F.col("_r") - 1 + F.col("_start")).drop(
        "_h", "_p", "_r", "_start")


def split_videos(videos: DataFrame, train: int, valid: int, test: int, seed: int = 0) -> DataFrame:
    """Exact-count train / valid / test split in hash order; the name gets its split prefix.

    It is an error to ask for more videos than there are.
    """
    need = train + valid + test
    enough = F.assert_true(F.col("total") >= need, F.concat(F.lit(f"{need} videos asked for, there are "), F.col("total").cast("string"))).isNull()
    ranked = ordered_by_hash(videos, "video", seed).where(enough)
    split = (
        F.when(F.col("rank") < train, "train")
        .when(F.col("rank") < train + valid, "valid")
        .when(F.col("rank") < train + valid + test, "test")
    )
    return ranked.withColumn("split", split).where("split IS NOT NULL").withColumn(
        "name", F.concat(F.substring("split", 1, 2), F.col("video").cast("string"))
    ).drop("rank", "total")


def split_frames(df: DataFrame, key: str, val_fraction: float, seed: int = 42) -> DataFrame:
    """The last int(n * fraction) rows in hash order are validation."""
    ranked = ordered_by_hash(df, key, seed)
    cut = F.col("total") - F.floor(F.col("total") * val_fraction)
    return ranked.withColumn("split", F.when(F.col("rank") < cut, "train").otherwise("val")).drop("rank", "total")


def subsample_every(df: DataFrame, keys: list[str], order: str, every: int, offset: int = 0) -> DataFrame:
    """Every ``every``-th row of each key in the order of a whole-number column, starting at ``offset``."""
    if every < 1 or not 0 <= offset < every:
        raise ValueError("every must be positive and 0 <= offset < every")
    return with_rank(df, keys, order, "_rn").where(F.col("_rn") % every == offset).drop("_rn")


def filter_config(df: DataFrame, **allowed: list | None) -> DataFrame:
    """Conjunctive allow-lists; ``None`` inside a list allows NULL; absent columns are skipped."""
    for column, values in allowed.items():
        if values is None or column not in df.columns:
            continue
        keep = F.col(column).isin([v for v in values if v is not None])
        if None in values:
            keep = F.coalesce(keep, F.lit(False)) | F.col(column).isNull()
        df = df.where(keep)
    return df


#: Operations that never count as query time, and per-stage exclusions.
IGNORED_OPS = ["total_frame_time", "read_frame", "save_canvas", "save_mapping_files"]
STAGE_EXCLUDED_OPS = {
    "020_exec_classify": ["read", "retrieve"],
    "030_exec_compress": ["save_collage", "pack_all_total"],
}


def drop_ops(df: DataFrame, ignored: list[str] = IGNORED_OPS,
             by_stage: dict[str, list[str]] | None = None) -> DataFrame:
    """Remove ignored operations everywhere and excluded ones per stage.

    The exclusion list is configuration, so it becomes a filter that reaches the scan.
    """
    rules = STAGE_EXCLUDED_OPS if by_stage is None else by_stage
    drop = F.col("op").isin(ignored)
    for stage, ops in rules.items():
        drop = drop | ((F.col("stage") == stage) & F.col("op").isin(ops))
    return df.where(~F.coalesce(drop, F.lit(False)))


def _with_box(df: DataFrame, b: g.Box, drop_empty: bool = True) -> DataFrame:
    out = df.withColumns(dict(zip(BOX, b)))
    return out.where("x2 > x1 AND y2 > y1") if drop_empty else out


def scale_boxes(df: DataFrame, from_size: tuple[int, int], to_size: tuple[int, int]) -> DataFrame:
    """Resize coordinates, clamp to the target frame, drop boxes that vanish."""
    (fw, fh), (tw, th) = from_size, to_size
    b = g.box()
    sx, sy = tw / fw, th / fh
    scaled = g.Box(b.x1 * sx, b.y1 * sy, b.x2 * sx, b.y2 * sy)
    return _with_box(df, g.clip(scaled, 0, 0, tw - 1, th - 1))


def snap_to_tiles(df: DataFrame, width: int, height: int, tilesize: int) -> DataFrame:
    """Scale coordinates so that the frame is a whole number of tiles."""
    sx = (width // tilesize) * tilesize / width
    sy = (height // tilesize) * tilesize / height
    b = g.box()
    return _with_box(df, g.Box(b.x1 * sx, b.y1 * sy, b.x2 * sx, b.y2 * sy), drop_empty=False)


def offset_boxes(df: DataFrame, dx: Column, dy: Column, width: int, height: int) -> DataFrame:
    """Shift crop coordinates into the frame, clamp, drop boxes that vanish."""
    b = g.box()
    moved = g.Box(b.x1 + dx, b.y1 + dy, b.x2 + dx, b.y2 + dy)
    return _with_box(df, g.clip(moved, 0, 0, width - 1, height - 1))


def corner_crops(width: int, height: int) -> list[tuple[int, int, int, int]]:
    """The four corner crops (x, y, w, h) of two thirds of the frame."""
    w, h = max(1, width * 2 // 3), max(1, height * 2 // 3)
    right, bottom = max(0, width - w), max(0, height - h)
    return [(x, y, w, h) for y in (0, bottom) for x in (0, right)]


def uncrop_boxes(df: DataFrame, width: int, height: int, crop: str = "crop") -> DataFrame:
    """Boxes found in corner crop number ``crop`` mapped back to the frame."""
    crops = corner_crops(width, height)
    dx = F.element_at(F.array(*[F.lit(c[0]) for c in crops]), F.col(crop).cast("int") + 1)
    dy = F.element_at(F.array(*[F.lit(c[1]) for c in crops]), F.col(crop).cast("int") + 1)
    return offset_boxes(df, dx, dy, width, height)


def clip_to_rect(df: DataFrame, rect: tuple[float, float, float, float]) -> DataFrame:
    """Clip boxes to a rectangle (x1, y1, x2, y2) and drop the empty ones."""
    return _with_box(df, g.clip(g.box(), *rect))


def exclude_polygon(df: DataFrame, polygon: list[tuple[float, float]]) -> DataFrame:
    return df.where(~g.box_hits_polygon(g.box(), polygon))


def valid_boxes(df: DataFrame, strict: bool = False) -> DataFrame:
    """Boxes with positive size; ``strict`` turns an invalid box into an error."""
    ok = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    return df.where(F.assert_true(ok, "box without area").isNull() if strict else ok)


def confidence_band(score: Column, high: float, low: float = 0.1) -> Column:
    """``high``: score > high; ``low``: low < score < high; NULL otherwise (also at score = high)."""
    return F.when(score > high, "high").when((score > low) & (score < high), "low")


def add_default_columns(df: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """Add the missing columns among ``{name: (type, value)}``."""
    return df.withColumns({c: F.lit(v).cast(t) for c, (t, v) in defaults.items() if c not in df.columns})


def mask_never_relevant(samples: DataFrame, tiles: DataFrame) -> DataFrame:
    """Drop negative samples at tiles that are never relevant; positives stay.

    ``samples`` has ``label`` (0/1) and a tile; ``tiles`` holds relevant tiles.
    """
    ever = tiles.select("row", "col").distinct().withColumn("_ever", F.lit(True))
    return samples.join(ever, ["row", "col"], "left").where("label = 1 OR _ever").drop("_ever")


def filter_by_active_tile(boxes: DataFrame, active: DataFrame, width: float, height: float,
                          rows: int, cols: int) -> DataFrame:
    """Boxes whose centre cell is active in their frame."""
    from trackgrid.operators.tiles import center_cell

    located = center_cell(boxes, width, height, rows, cols)
    keys = [k for k in ("variant_id", "video", "frame_idx", "row", "col") if k in active.columns and k in located.columns]
    return located.join(active.select(*keys).distinct(), keys, "left_semi").drop("row", "col")
