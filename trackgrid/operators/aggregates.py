"""Aggregations (survey section 2.4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackgrid.schemas import PARAMS, VARIANT_KEYS


def runtime_per_op(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys, "stage", "op").agg(F.sum("time").alias("time"), F.count("time").alias("count"))


def runtime_overall(df: DataFrame, keys: list[str], manifest: DataFrame | None = None) -> DataFrame:
    """Time per stage; with ``manifest`` a stage without operations reports 0."""
    total = df.groupBy(*keys, "stage").agg(F.sum("time").alias("time"))
    if manifest is None:
        return total
    return manifest.select(*keys, "stage").distinct().join(total, [*keys, "stage"], "left").fillna({"time": 0.0})


def _variant_columns(df: DataFrame) -> list[str]:
    return [c for c in [*VARIANT_KEYS, *PARAMS] if c in df.columns]


def runtime_per_video(df: DataFrame) -> DataFrame:
    return df.groupBy(*_variant_columns(df), "video").agg(F.sum("time").alias("time"))


def runtime_per_split(per_video: DataFrame, frames: DataFrame) -> DataFrame:
    """Split totals with ``throughput_fps`` as the ratio of sums."""
    keys = _variant_columns(per_video)
    counted = per_video.join(frames.select("video", "frame_count"), "video")
    out = counted.groupBy(*keys).agg(F.sum("frame_count").alias("frame_count"), F.sum("time").alias("time"))
    return out.withColumn("throughput_fps", F.try_divide(F.col("frame_count").cast("double"), F.col("time")))


def stage_breakdown(df: DataFrame) -> DataFrame:
    """Per (stage, config, op) time next to its (stage, config) total."""
    parts = df.groupBy("stage", "config", "op").agg(F.sum("time").alias("time"))
    return parts.withColumn("total", F.sum("time").over(Window.partitionBy("stage", "config")))


def runtime_rollup(df: DataFrame) -> DataFrame:
    """Time at the levels (stage, config, op), (stage, config) and (stage) in one pass; ``level`` tells which."""
    return df.rollup("stage", "config", "op").agg(
        F.sum("time").alias("time"), F.grouping_id().cast("bigint").alias("level")).where("level < 7")


def overall_breakdown(execution: DataFrame, naive: DataFrame, index: DataFrame) -> DataFrame:
    """Execution and baseline time per (config, stage) and index time per stage, as one table."""
    run = execution.groupBy("config", "stage").agg(F.sum("time").alias("time")).withColumn("part", F.lit("execution"))
    base = naive.groupBy("stage").agg(F.sum("time").alias("time")).select(
        F.lit("naive").alias("config"), "stage", "time", F.lit("naive").alias("part"))
    built = index.groupBy("stage").agg(F.sum("time").alias("time")).select(
        F.lit("index").alias("config"), "stage", "time", F.lit("index").alias("part"))
    return run.unionByName(base).unionByName(built)


def naive_share(df: DataFrame, root: str = "root") -> DataFrame:
    """Share of each operation in the total time of a dataset root."""
    parts = df.groupBy(root, "op").agg(F.sum("time").alias("time"))
    total = F.sum("time").over(Window.partitionBy(root))
    return parts.withColumn("share", F.coalesce(F.try_divide(F.col("time"), total), F.lit(0.0)))


def manifest_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("count"))


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per distinct value of each column (as text), NULLs left out."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("_v"))
    return long.select("_v.*").where("value IS NOT NULL").distinct()


def tile_outcome(pred: Column, truth: Column) -> Column:
    return (F.when(pred & truth, "tp").when(pred & ~truth, "fp").when(~pred & truth, "fn").otherwise("tn"))


def tile_confusion(aligned: DataFrame, threshold: float, keys: list[str], grid_tiles: int | None = None) -> DataFrame:
    """tp / fp / fn / tn tiles per ``keys``. Tiles absent from both tables are true negatives of ``grid_tiles``."""
    pred = F.coalesce(F.col("pred_score"), F.lit(0)) >= threshold
    true = F.coalesce(F.col("true_score"), F.lit(0)) >= threshold
    counts = aligned.groupBy(*keys).agg(
        F.count_if(pred & true).alias("tp"), F.count_if(pred & ~true).alias("fp"),
        F.count_if(~pred & true).alias("fn"), F.count_if(~pred & ~true).alias("tn"),
        F.count_distinct("video", "frame_idx").alias("frames"))
    if grid_tiles is not None:
        counts = counts.withColumn("tn", F.col("frames") * grid_tiles - F.col("tp") - F.col("fp") - F.col("fn"))
    return counts


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def quality(df: DataFrame) -> DataFrame:
    """precision, recall, accuracy and f1 of a confusion table; 0 on an empty denominator."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return df.withColumns({
        "precision": precision, "recall": recall, "accuracy": _ratio(tp + tn, tp + fp + fn + tn),
        "f1": _ratio(2 * precision * recall, precision + recall)})


def classifier_quality(aligned: DataFrame, runtime: DataFrame, threshold: float, grid_tiles: int) -> DataFrame:
    """Micro-averaged quality per (classifier, tilesize) with milliseconds per frame."""
    keys = ["classifier", "tilesize"]
    total = tile_confusion(aligned, threshold, keys, grid_tiles)
    spent = runtime.groupBy(*keys).agg(F.sum("time").alias("time"))
    return quality(total).join(spent, keys, "left").withColumn(
        "mspf", _ratio(F.col("time") * 1000, F.col("frames")))


def error_over_time(aligned: DataFrame, objects: DataFrame, threshold: float, grid_tiles: int) -> DataFrame:
    """Per-frame error rate and quality next to the frame's object count."""
    keys = ["video", "frame_idx"]
    counts = quality(tile_confusion(aligned, threshold, keys, grid_tiles)).withColumn(
        "error_rate", _ratio(F.col("fp") + F.col("fn"), F.lit(grid_tiles)))
    seen = objects.groupBy(*keys).agg(F.count("*").alias("objects"))
    return counts.join(seen, keys, "left").fillna({"objects": 0})


def error_heatmap(aligned: DataFrame, threshold: float) -> DataFrame:
    """Sum of error codes (1 false positive, 2 false negative) per tile position."""
    pred = F.coalesce(F.col("pred_score"), F.lit(0)) >= threshold
    true = F.coalesce(F.col("true_score"), F.lit(0)) >= threshold
    code = F.when(pred & ~true, 1).when(~pred & true, 2).otherwise(0)
    return aligned.groupBy("row", "col").agg(F.sum(code).alias("error"))


def score_histogram(aligned: DataFrame, threshold: float, bins: int = 20) -> DataFrame:
    """Counts of predicted scores (0..255) by bin, correctness and true class."""
    score = F.coalesce(F.col("pred_score"), F.lit(0))
    pred, true = score >= threshold, F.coalesce(F.col("true_score"), F.lit(0)) >= threshold
    bin_no = F.least(F.floor(score * bins / 255.0), F.lit(bins - 1)).cast("bigint")
    return aligned.groupBy(
        bin_no.alias("bin"), (pred == true).alias("correct"), true.alias("actual")).agg(F.count("*").alias("count"))


def always_relevant(tiles: DataFrame, threshold: float) -> DataFrame:
    """Tile positions relevant in any frame of any video."""
    return tiles.groupBy("row", "col").agg(F.bool_or(F.col("score") >= threshold).alias("relevant"))


def training_set_stats(samples: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Samples before and after masking and the share removed."""
    before = samples.groupBy(*keys).agg(F.count("*").alias("before"))
    after = kept.groupBy(*keys).agg(F.count("*").alias("after"))
    both = before.join(after, keys, "left").fillna({"after": 0})
    return both.withColumns({
        "removed": F.col("before") - F.col("after"),
        "pct_removed": _ratio((F.col("before") - F.col("after")) * 100, F.col("before"))})


def retention(original: DataFrame, pruned: DataFrame, keys: list[str]) -> DataFrame:
    """Active tiles before and after pruning and their ratio (0 when there were none)."""
    a = original.groupBy(*keys).agg(F.count("*").alias("original"))
    b = pruned.groupBy(*keys).agg(F.count("*").alias("pruned"))
    return a.join(b, keys, "left").fillna({"pruned": 0}).withColumn(
        "retention_rate", _ratio(F.col("pruned"), F.col("original")))


def training_summary(epochs: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per-run summary of training logs and its mean per (classifier, tilesize)."""
    keys = ["video", "classifier", "tilesize"]
    test = F.col("split") == "test"
    runs = epochs.groupBy(*keys).agg(
        F.count_if(test).alias("num_epochs"), F.min(F.when(test, F.col("loss"))).alias("best_val_loss"),
        F.max(F.when(test, F.col("accuracy"))).alias("best_val_accuracy"),
        F.sum(F.when(~test, F.col("time"))).alias("total_train_time"), F.sum(F.when(test, F.col("time"))).alias("total_val_time"))
    timed = steps.groupBy(*keys).agg(
        F.avg(F.when(F.col("op") == "train_step", F.col("time"))).alias("avg_train_step_time"),
        F.avg(F.when(F.col("op") == "test_inference", F.col("time"))).alias("avg_inference_time"))
    runs = runs.join(timed, keys, "left").fillna(0.0, subset=["avg_train_step_time", "avg_inference_time"])
    means = runs.groupBy("classifier", "tilesize").agg(*[F.avg(c).alias(c) for c in runs.columns if c not in keys])
    return runs, means


def pruning_reduction(df: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles with and without pruning, time and % reduction per threshold.

    ``df``: keys, threshold (NULL = unpruned), tiles, time.
    """
    sums = df.groupBy(*keys, "threshold").agg(F.sum("tiles").alias("tiles"), F.sum("time").alias("time"))
    base = F.max(F.when(F.col("threshold").isNull(), F.col("tiles"))).over(Window.partitionBy(*keys))
    return sums.withColumn("unpruned_tiles", base).where("threshold IS NOT NULL").withColumn(
        "pct_reduction", _ratio((F.col("unpruned_tiles") - F.col("tiles")) * 100, F.col("unpruned_tiles")))


def prune_breakdown(ops: DataFrame) -> DataFrame:
    """Time per (config, op) with the configuration's total."""
    parts = ops.groupBy("config", "op").agg(F.sum("time").alias("time"))
    return parts.withColumn("total", F.sum("time").over(Window.partitionBy("config")))


def order_configs(df: DataFrame, value: str = "total") -> DataFrame:
    """Rows with the position of their configuration, the largest total first (ties by name).

    The configurations are reduced to one row each before they are ordered.
    """
    totals = df.groupBy("config").agg(F.max(value).alias("_v"))
    place = F.row_number().over(Window.orderBy(F.col("_v").desc(), "config")) - 1
    return df.join(totals.select("config", place.alias("position")), "config")


def prune_summary(df: DataFrame, level: str = "threshold") -> DataFrame:
    """Mean retention and total time per (dataset, config, threshold or time limit)."""
    return df.groupBy("dataset", "config", level).agg(
        F.avg("retention_rate").alias("retention_rate"), F.sum("time").alias("time"))


def compression_counts(index_map: DataFrame, canvases: DataFrame, keys: list[str]) -> DataFrame:
    """Canvases, occupied and empty tiles per configuration. ``canvases``: keys, tiles."""
    held = index_map.groupBy(*keys).agg(F.count("*").alias("occupied_tiles"))
    whole = canvases.groupBy(*keys).agg(F.count("*").alias("images"), F.sum("tiles").alias("_all"))
    return whole.join(held, keys, "left").fillna({"occupied_tiles": 0}).withColumn(
        "empty_tiles", F.col("_all") - F.col("occupied_tiles")).drop("_all")


def padding_tiles(index_map: DataFrame, placements: DataFrame, tiles: DataFrame, threshold: float,
                  keys: list[str]) -> DataFrame:
    """Occupied canvas tiles and how many of them were not relevant in their frame.

    Tiles below the threshold, outside the grid or of a frame without scores count as padding.
    """
    collage = ["video", "collage_idx", "group_id"]
    source = index_map.join(placements, collage).select(
        *keys, "frame_idx",
        (F.col("row") - F.col("py") + F.col("oy")).alias("row"),
        (F.col("col") - F.col("px") + F.col("ox")).alias("col"))
    scored = source.join(tiles.select("video", "frame_idx", "row", "col", "score"),
                         ["video", "frame_idx", "row", "col"], "left")
    irrelevant = F.coalesce(F.col("score"), F.lit(0)) <= threshold * 255
    return scored.groupBy(*keys).agg(
        F.count("*").alias("occupied_tiles"), F.count_if(irrelevant).alias("padding_tiles"))


def compression_effectiveness(df: DataFrame, keys: list[str]) -> DataFrame:
    """Occupancy, non-padding and padding ratio of summed tile counts; a zero divisor counts as 1."""
    sums = df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("empty_tiles", "occupied_tiles", "padding_tiles")])
    empty, held, pad = (F.col(c).cast("double") for c in ("empty_tiles", "occupied_tiles", "padding_tiles"))
    one = F.lit(1.0)
    return sums.withColumns({
        "non_padding_tiles": F.col("occupied_tiles") - F.col("padding_tiles"),
        "occupancy": held / F.greatest(empty + held, one),
        "padding_ratio": pad / F.greatest(held, one)})


def detection_ms(dataset: Column, by_dataset: dict[str, int] | None = None, otherwise: int = 40) -> Column:
    """Estimated detection milliseconds per image: ``by_dataset``, else ``otherwise``."""
    out = F.lit(otherwise)
    for name, ms in (by_dataset or {}).items():
        out = F.when(dataset == name, ms).otherwise(out)
    return out


def compression_method_compare(df: DataFrame, detect_ms: dict[str, int] | None = None) -> DataFrame:
    """Images and seconds per (dataset, config, method) with estimated detection time added."""
    sums = df.groupBy("dataset", "config", "method").agg(F.sum("images").alias("images"), F.sum("time").alias("time"))
    detect = F.col("images") * detection_ms(F.col("dataset"), detect_ms) / 1000.0
    return sums.withColumns({"detect_time": detect, "total_time": F.col("time") + detect})


def track_presence(df: DataFrame) -> DataFrame:
    """First and last frame and number of frames of each track."""
    return df.groupBy("video", "track_id").agg(
        F.min("frame_idx").alias("min_frame"), F.max("frame_idx").alias("max_frame"),
        F.count_distinct("frame_idx").alias("frames"))


def mape(pred: Column, truth: Column) -> Column:
    """Absolute error in percent; without truth 0 when nothing was predicted, else infinite."""
    return F.when(truth > 0, F.abs(pred - truth) * 100.0 / truth).otherwise(
        F.when(pred == 0, 0.0).otherwise(F.lit(float("inf"))))


def count_errors(df: DataFrame) -> DataFrame:
    return df.withColumns({"Count_DetsMAPE": mape(F.col("Dets"), F.col("GT_Dets")),
                           "Count_TracksMAPE": mape(F.col("IDs"), F.col("GT_IDs"))})


def flatten_metrics(df: DataFrame, metrics: tuple[str, ...] = ("HOTA", "AssA", "DetA")) -> DataFrame:
    """Mean over thresholds of each metric's array, as ``HOTA_<metric>``."""
    def mean(c: str) -> Column:
        return F.aggregate(F.col(c), F.lit(0.0), lambda acc, v: acc + v) / F.size(c)

    return df.withColumns({f"HOTA_{m}": mean(m) for m in metrics})


def best_points(df: DataFrame, accuracy: str, by: list[str] | None = None, x: str = "time",
                tie: str = "variant_id") -> DataFrame:
    """Most accurate point faster than the baseline, else the fastest, with its speed-up."""
    by = by or ["dataset"]
    row = F.struct(tie, x, f"{x}_naive", accuracy)
    faster = F.col(x) < F.col(f"{x}_naive")
    best = F.max_by(row, F.when(faster, F.struct(F.col(accuracy), -F.col(x), F.col(tie))))
    fastest = F.min_by(row, F.struct(x, tie))
    picked = df.groupBy(*by).agg(F.coalesce(best, fastest).alias("_p"))
    return picked.select(*by, "_p.*").withColumn(
        "speedup", F.when(F.col(x) > 0, F.col(f"{x}_naive") / F.col(x)).otherwise(0.0))


def mistrack_rate(df: DataFrame, keys: list[str], correct: str = "correct") -> DataFrame:
    out = df.groupBy(*keys).agg(F.count_if(F.col(correct)).alias("correct"),
                                F.count_if(~F.col(correct)).alias("incorrect"))
    return out.withColumn("mistrack_rate", _ratio(F.col("incorrect"), F.col("correct") + F.col("incorrect")))


def max_gap(thresholds: Column) -> Column:
    """Sampling gap of a tracker configuration: doubles per threshold up to the first 1.0 after the first."""
    n = F.size(thresholds)
    tail = F.slice(thresholds, F.lit(2), F.greatest(n - 1, F.lit(0)))
    at = F.array_position(tail, F.lit(1.0))
    return (F.when(thresholds.isNull() | (n < 2), F.lit(1.0))
            .when(at > 0, F.pow(F.lit(2.0), at - 1)).otherwise(F.pow(F.lit(2.0), n - 1)).cast("bigint"))


def total_frames(frames: DataFrame, keys: list[str]) -> DataFrame:
    return frames.groupBy(*keys).agg(F.sum("frame_count").alias("frame_count"))


def dataset_summary(entries: DataFrame) -> DataFrame:
    """Entries and annotations per dataset, per (dataset, classifier) and overall."""
    return entries.rollup("dataset", "classifier").agg(
        F.count("*").alias("entries"), F.sum("annotations").alias("annotations"),
        F.grouping_id().cast("bigint").alias("level"))


# --- reshaping (survey section 2.6) ----------------------------------------

def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in which two tables differ, with ``side`` telling the table that has them."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(
        b.exceptAll(a).withColumn("side", F.lit("right")))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("count")).where("count > 1")


def melt_ops(df: DataFrame, ids: list[str], ops: list[str]) -> DataFrame:
    return df.unpivot(ids, ops, "operation", "runtime")


def pivot_ops(df: DataFrame, ids: list[str], ops: list[str]) -> DataFrame:
    """One column per known operation (0 when absent)."""
    return df.groupBy(*ids).pivot("op", ops).agg(F.sum("time")).fillna(0.0, subset=ops)


def split_variants(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(baseline rows, system rows); a table without ``variant`` is all system."""
    if "variant" not in df.columns:
        df = df.withColumn("variant", F.lit("system"))
    return df.where("variant = 'naive'"), df.where("variant <> 'naive'")


def stack_tile_types(df: DataFrame, keys: list[str]) -> DataFrame:
    """Empty, non-padding and padding tiles as rows with their share."""
    long = df.withColumn("non_padding_tiles", F.col("occupied_tiles") - F.col("padding_tiles")).unpivot(
        keys, ["empty_tiles", "non_padding_tiles", "padding_tiles"], "tile_type", "tiles")
    return long.withColumn("share", _ratio(F.col("tiles"), F.sum("tiles").over(Window.partitionBy(*keys))))
