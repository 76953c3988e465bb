"""Registered queries over boxes, tiles, groups and canvases."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackgrid.functions import geometry as g
from trackgrid.operators import aggregates as agg
from trackgrid.operators import filters, grouping, joins, packing, pruning, tiles, trajectories
from trackgrid.plans import fixtures as fx
from trackgrid.plans.catalog import register, rounded
from trackgrid.plans.fixtures import COLS, HEIGHT, ROWS, TILE, WIDTH, sql
from trackgrid.scale import materialize

FRAME = ["video", "frame_idx"]


@register("j11_boxes_to_tiles", sql("SELECT video, frame_idx, det_id, row, col FROM det_tiles", "det_tiles"))
def _(spark, sf):
    return tiles.boxes_to_tiles(fx.detections(spark, sf), TILE, ROWS, COLS).select("video", "frame_idx", "det_id", "row", "col")


_CLIP = """
    SELECT *, greatest(0, least(1080, x1)) AS cx1, greatest(0, least(720, y1)) AS cy1,
      greatest(0, least(1080, x2)) AS cx2, greatest(0, least(720, y2)) AS cy2 FROM gt_tracks"""


@register("j12_boxes_to_cells", sql("""
    SELECT video, frame_idx, track_id, row, col FROM clipped
    JOIN (SELECT range AS row FROM range(3)) ON row BETWEEN floor(cy1 / 240) AND floor(least(720 - 1e-9, cy2 - 1e-9) / 240)
    JOIN (SELECT range AS col FROM range(3)) ON col BETWEEN floor(cx1 / 360) AND floor(least(1080 - 1e-9, cx2 - 1e-9) / 360)
    WHERE cx2 > cx1 AND cy2 > cy1""", "gt_tracks", clipped=_CLIP))
def _(spark, sf):
    return tiles.boxes_to_cells(fx.gt_tracks(spark, sf), WIDTH, HEIGHT, 3, 3).select("video", "frame_idx", "track_id", "row", "col")


_CENTER = """
    SELECT video, frame_idx, track_id,
      CASE WHEN cx2 > cx1 AND cy2 > cy1 THEN CAST(floor(least(720 - 1e-9, (cy1 + cy2) / 2) / 240) AS BIGINT) END AS row,
      CASE WHEN cx2 > cx1 AND cy2 > cy1 THEN CAST(floor(least(1080 - 1e-9, (cx1 + cx2) / 2) / 360) AS BIGINT) END AS col
    FROM clipped"""


@register("j13_center_cell", sql("SELECT * FROM centered", "gt_tracks", clipped=_CLIP, centered=_CENTER))
def _(spark, sf):
    return tiles.center_cell(fx.gt_tracks(spark, sf), WIDTH, HEIGHT, 3, 3).select("video", "frame_idx", "track_id", "row", "col")


@register("f24_active_boxes", sql("""
    SELECT c.video, c.frame_idx, c.track_id FROM centered c WHERE EXISTS (
      SELECT 1 FROM active a WHERE a.video = c.video AND a.frame_idx = c.frame_idx AND a.row = c.row AND a.col = c.col)""",
    "gt_tracks", "detections", clipped=_CLIP, centered=_CENTER, active="""
      SELECT DISTINCT video, frame_idx, row, col FROM detections
      JOIN (SELECT range AS row FROM range(3)) ON row BETWEEN floor(y1 / 240) AND floor(least(720 - 1e-9, y2 - 1e-9) / 240)
      JOIN (SELECT range AS col FROM range(3)) ON col BETWEEN floor(x1 / 360) AND floor(least(1080 - 1e-9, x2 - 1e-9) / 360)
      WHERE score > 0.5"""))
def _(spark, sf):
    active = tiles.boxes_to_cells(fx.detections(spark, sf).where("score > 0.5"), WIDTH, HEIGHT, 3, 3)
    return filters.filter_by_active_tile(fx.gt_tracks(spark, sf), active, WIDTH, HEIGHT, 3, 3).select("video", "frame_idx", "track_id")


@register("f01_filter_class", """
    SELECT event_type AS class, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL""")
def _(spark, sf):
    e = fx.read(spark, sf, "events").select(F.col("event_type").alias("class"))
    return filters.filter_class(e, ["click", "view"]).groupBy("class").agg(F.count("*").alias("n"))


@register("f02_threshold_tiles", sql("""
    SELECT video, frame_idx, row, col, 'prune' AS mode FROM tile_scores WHERE score >= 128
    UNION ALL SELECT video, frame_idx, row, col, 'compress' FROM tile_scores WHERE score > 0.4 * 255
    UNION ALL SELECT video, frame_idx, row, col, 'evaluate' FROM tile_scores WHERE score / 255::DOUBLE >= 0.4""", "tile_scores"))
def _(spark, sf):
    t = fx.tile_scores(spark, sf)
    cols = [*FRAME, "row", "col"]
    out = [filters.threshold_tiles(t, v, m).select(*cols, F.lit(m).alias("mode"))
           for m, v in (("prune", 128), ("compress", 0.4), ("evaluate", 0.4))]
    return out[0].unionByName(out[1]).unionByName(out[2])


_LAST = "SELECT video, max(frame_idx) + 1 AS frame_count FROM gt_tracks GROUP BY video"


def _counts(spark, sf):
    return fx.gt_tracks(spark, sf).groupBy("video").agg((F.max("frame_idx") + 1).alias("frame_count"))


@register("f03_sample_frames", sql("""
    SELECT video, frame_idx, track_id FROM gt_tracks JOIN n USING (video)
    WHERE frame_idx % 8 = 0 OR frame_idx = frame_count - 1""", "gt_tracks", n=_LAST))
def _(spark, sf):
    rows = fx.gt_tracks(spark, sf).join(_counts(spark, sf), "video")
    return filters.sample_frames(rows, 8, F.col("frame_count")).select("video", "frame_idx", "track_id")


@register("f04_sample_frames_strict", sql("SELECT video, frame_idx, track_id FROM gt_tracks WHERE frame_idx % 4 = 0", "gt_tracks"))
def _(spark, sf):
    return filters.sample_frames(fx.gt_tracks(spark, sf), 4).select("video", "frame_idx", "track_id")


@register("f05_f06_frame_steps", """
    SELECT s_suppkey, CASE fps WHEN 15 THEN 1 WHEN 30 THEN 2 ELSE 4 END AS step, CASE WHEN fps > 20 THEN 10 ELSE 5 END AS stride
    FROM (SELECT s_suppkey, [15, 30, 60][CAST(s_nationkey % 3 + 1 AS INT)] AS fps FROM supplier)""")
def _(spark, sf):
    fps = F.element_at(F.array(F.lit(15), F.lit(30), F.lit(60)), (F.col("s_nationkey") % 3 + 1).cast("int"))
    return fx.read(spark, sf, "supplier").select(
        "s_suppkey", filters.fps_step(fps).alias("step"), filters.frame_stride(fps, 5).alias("stride"))


@register("f07_downsample", sql("""
    SELECT video, track_id, CAST(frame_idx // 2 AS BIGINT) AS frame_idx, x1 FROM gt_tracks WHERE frame_idx % 2 = 0""", "gt_tracks"))
def _(spark, sf):
    return filters.downsample_2x(fx.gt_tracks(spark, sf)).select("video", "track_id", "frame_idx", "x1")


@register("f08_linspace", sql("""
    WITH m AS (SELECT video, frame_count, CAST(greatest(1, floor(frame_count * 2 / 15.0::DOUBLE)) AS BIGINT) AS m FROM n),
    ids AS (SELECT DISTINCT video, CASE WHEN m > 1 AND i = m - 1 THEN frame_count - 1
      ELSE CAST(floor(i * CASE WHEN m > 1 THEN (frame_count - 1) / CAST(m - 1 AS DOUBLE) ELSE 0 END) AS BIGINT) END AS frame_idx
      FROM (SELECT *, unnest(range(m)) AS i FROM m))
    SELECT g.video, g.frame_idx, g.track_id FROM gt_tracks g JOIN ids USING (video, frame_idx)""", "gt_tracks", n=_LAST))
def _(spark, sf):
    return filters.sample_linspace(fx.gt_tracks(spark, sf), _counts(spark, sf), 15, 2).select("video", "frame_idx", "track_id")


@register("f09_segments", sql("""
    SELECT video, frame_idx, track_id, s AS segment FROM gt_tracks JOIN n USING (video)
    JOIN (SELECT range AS s FROM range(7)) ON frame_idx >= frame_count * s // 7 AND frame_idx < frame_count * (s + 1) // 7""",
    "gt_tracks", n=_LAST))
def _(spark, sf):
    rows = fx.gt_tracks(spark, sf).join(_counts(spark, sf), "video")
    return rows.select("video", "frame_idx", "track_id", filters.segment_of(F.col("frame_idx"), F.col("frame_count"), 7).alias("segment"))


@register("f12_subsample_every", sql("""
    SELECT video, track_id, frame_idx FROM (SELECT *, row_number() OVER (PARTITION BY video, track_id ORDER BY frame_idx) - 1 AS rn
      FROM gt_tracks) WHERE rn % 3 = 1""", "gt_tracks"))
def _(spark, sf):
    return filters.subsample_every(fx.gt_tracks(spark, sf), ["video", "track_id"], "frame_idx", 3, 1).select(
        "video", "track_id", "frame_idx")


@register("f15_scale_boxes", sql("""
    SELECT * FROM (SELECT video, frame_idx, track_id, round(greatest(0, least(639, x1 * (640 / 1080::DOUBLE))), 6) AS x1,
      round(greatest(0, least(359, y1 * 0.5)), 6) AS y1, round(greatest(0, least(639, x2 * (640 / 1080::DOUBLE))), 6) AS x2,
      round(greatest(0, least(359, y2 * 0.5)), 6) AS y2 FROM gt_tracks) WHERE x2 > x1 AND y2 > y1""", "gt_tracks"))
def _(spark, sf):
    return rounded(filters.scale_boxes(fx.gt_tracks(spark, sf), (WIDTH, HEIGHT), (640, 360)).select(
        "video", "frame_idx", "track_id", "x1", "y1", "x2", "y2"), "x1", "y1", "x2", "y2")


@register("f16_snap_to_tiles", sql("""
    SELECT video, frame_idx, track_id, round(x1 * (1024 / 1080::DOUBLE), 6) AS x1, round(y2 * (704 / 720::DOUBLE), 6) AS y2
    FROM gt_tracks""", "gt_tracks"))
def _(spark, sf):
    return rounded(filters.snap_to_tiles(fx.gt_tracks(spark, sf), WIDTH, HEIGHT, 64).select(
        "video", "frame_idx", "track_id", "x1", "y2"), "x1", "y2")


@register("f17_uncrop_boxes", sql("""
    SELECT * FROM (SELECT video, frame_idx, track_id, greatest(0, least(1079, x1 + k % 2 * 360)) AS x1,
      greatest(0, least(719, y1 + CASE WHEN k % 4 >= 2 THEN 240 ELSE 0 END)) AS y1, greatest(0, least(1079, x2 + k % 2 * 360)) AS x2,
      greatest(0, least(719, y2 + CASE WHEN k % 4 >= 2 THEN 240 ELSE 0 END)) AS y2 FROM gt_tracks) WHERE x2 > x1 AND y2 > y1""", "gt_tracks"))
def _(spark, sf):
    crops = fx.gt_tracks(spark, sf).withColumn("crop", F.col("k") % 4)
    return filters.uncrop_boxes(crops, WIDTH, HEIGHT).select("video", "frame_idx", "track_id", "x1", "y1", "x2", "y2")


@register("f18_clip_to_rect", sql("""
    SELECT * FROM (SELECT video, frame_idx, track_id, greatest(100, least(900, x1)) AS x1, greatest(50, least(500, y1)) AS y1,
      greatest(100, least(900, x2)) AS x2, greatest(50, least(500, y2)) AS y2 FROM gt_tracks) WHERE x2 > x1 AND y2 > y1""", "gt_tracks"))
def _(spark, sf):
    return filters.clip_to_rect(fx.gt_tracks(spark, sf), (100, 50, 900, 500)).select(
        "video", "frame_idx", "track_id", "x1", "y1", "x2", "y2")


_POLYGON = [(200.0, 100.0), (800.0, 150.0), (600.0, 500.0), (300.0, 400.0)]


def _inside_sql(x: str, y: str) -> str:
    edges = []
    for (ax, ay), (bx, by) in zip(_POLYGON, _POLYGON[1:] + _POLYGON[:1]):
        edges.append(f"CASE WHEN (({ay} > {y}) <> ({by} > {y})) AND {x} < {bx - ax} * ({y} - {ay}) / {by - ay} + {ax} THEN 1 ELSE 0 END")
    return f"(({' + '.join(edges)}) % 2 = 1)"


@register("f19_exclude_polygon", sql(f"""
    SELECT video, frame_idx, track_id FROM gt_tracks WHERE NOT ({" OR ".join(_inside_sql(x, y) for x in ("x1", "x2") for y in ("y1", "y2"))}
      OR {" OR ".join(f"({px} BETWEEN x1 AND x2 AND {py} BETWEEN y1 AND y2)" for px, py in _POLYGON)})""", "gt_tracks"))
def _(spark, sf):
    return filters.exclude_polygon(fx.gt_tracks(spark, sf), _POLYGON).select("video", "frame_idx", "track_id")


@register("f20_valid_boxes", sql("SELECT video, frame_idx, track_id FROM gt_tracks WHERE least(x2, 500) > x1", "gt_tracks"))
def _(spark, sf):
    cut = fx.gt_tracks(spark, sf).withColumn("x2", F.least(F.col("x2"), F.lit(500.0)))
    return filters.valid_boxes(cut).select("video", "frame_idx", "track_id")


@register("f21_confidence_bands", sql("""
    SELECT CASE WHEN score > 0.5 THEN 'high' WHEN score > 0.1 AND score < 0.5 THEN 'low' END AS band, count(*) AS n
    FROM gt_tracks GROUP BY ALL""", "gt_tracks"))
def _(spark, sf):
    return fx.gt_tracks(spark, sf).groupBy(filters.confidence_band(F.col("score"), 0.5).alias("band")).agg(F.count("*").alias("n"))


_SAMPLES = "SELECT video, frame_idx, row, col, CASE WHEN score >= 200 THEN 1 ELSE 0 END AS label FROM tile_scores"


def _samples(spark, sf):
    return fx.tile_scores(spark, sf).select(*FRAME, "row", "col", F.when(F.col("score") >= 200, 1).otherwise(0).alias("label"))


_EVER = "SELECT DISTINCT row, col FROM tile_scores WHERE score >= 128"


@register("f23_mask_never_relevant", sql("""
    SELECT s.* FROM samples s WHERE label = 1 OR EXISTS (SELECT 1 FROM ever e WHERE e.row = s.row AND e.col = s.col)""",
    "tile_scores", samples=_SAMPLES, ever=_EVER))
def _(spark, sf):
    return filters.mask_never_relevant(_samples(spark, sf), fx.tile_scores(spark, sf).where("score >= 128"))


@register("a16_training_set_stats", sql("""
    SELECT label, b AS before, a AS after, b - a AS removed, round((b - a) * 100.0::DOUBLE / b, 6) AS pct_removed FROM (
      SELECT label, count(*) AS b, count(*) FILTER (WHERE label = 1 OR EXISTS (SELECT 1 FROM ever e WHERE e.row = s.row AND e.col = s.col)) AS a
      FROM samples s GROUP BY label)""", "tile_scores", samples=_SAMPLES, ever=_EVER))
def _(spark, sf):
    s = _samples(spark, sf)
    kept = filters.mask_never_relevant(s, fx.tile_scores(spark, sf).where("score >= 128"))
    return rounded(agg.training_set_stats(s, kept, ["label"]), "pct_removed")


# --- tile quality ----------------------------------------------------------

_ALIGNED = """
    SELECT coalesce(p.video, t.video) AS video, coalesce(p.frame_idx, t.frame_idx) AS frame_idx, coalesce(p.row, t.row) AS row,
      coalesce(p.col, t.col) AS col, p.score AS pred_score, t.score AS true_score
    FROM tile_scores p FULL JOIN true_tiles t ON p.video = t.video AND p.frame_idx = t.frame_idx AND p.row = t.row AND p.col = t.col"""
_CONF = """count(*) FILTER (WHERE coalesce(pred_score, 0) >= 100 AND coalesce(true_score, 0) >= 100) AS tp,
      count(*) FILTER (WHERE coalesce(pred_score, 0) >= 100 AND coalesce(true_score, 0) < 100) AS fp,
      count(*) FILTER (WHERE coalesce(pred_score, 0) < 100 AND coalesce(true_score, 0) >= 100) AS fn"""


def _aligned(spark, sf):
    return joins.align_frames(fx.tile_scores(spark, sf), fx.true_tiles(spark, sf))


@register("j20_align_frames", sql("SELECT * FROM aligned", "tile_scores", "true_tiles", aligned=_ALIGNED))
def _(spark, sf):
    return _aligned(spark, sf)


_QUALITY = """round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
      round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
      round(coalesce(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 0), 6) AS f1"""


@register("a09_a10_tile_quality", sql(f"""
    SELECT video, tp, fp, fn, tn, frames, {_QUALITY} FROM (SELECT *, frames * 216 - tp - fp - fn AS tn FROM (
      SELECT video, {_CONF}, count(DISTINCT frame_idx) AS frames FROM aligned GROUP BY video))""",
    "tile_scores", "true_tiles", aligned=_ALIGNED))
def _(spark, sf):
    return rounded(agg.quality(agg.tile_confusion(_aligned(spark, sf), 100, ["video"], ROWS * COLS)),
                   "precision", "recall", "accuracy", "f1")


@register("a11_classifier_quality", sql(f"""
    SELECT q.*, time, round(time * 1000 / frames, 6) AS mspf FROM (
      SELECT classifier, tilesize, tp, fp, fn, tn, frames, {_QUALITY} FROM (SELECT *, frames * 216 - tp - fp - fn AS tn FROM (
        SELECT 'c' || video % 3 AS classifier, 60 AS tilesize, {_CONF}, count(DISTINCT video * 100000 + frame_idx) AS frames FROM aligned GROUP BY ALL))) q
    JOIN (SELECT 'c' || user_id % 3 AS classifier, round(sum(value), 6) AS time FROM events GROUP BY ALL) USING (classifier)""",
    "tile_scores", "true_tiles", aligned=_ALIGNED))
def _(spark, sf):
    rows = _aligned(spark, sf).withColumns({"classifier": F.concat(F.lit("c"), F.col("video") % 3), "tilesize": F.lit(60)})
    spent = fx.read(spark, sf, "events").select(
        F.concat(F.lit("c"), F.col("user_id") % 3).alias("classifier"), F.lit(60).alias("tilesize"), F.col("value").alias("time"))
    spent = spent.groupBy("classifier", "tilesize").agg(F.round(F.sum("time"), 6).alias("time"))
    return rounded(agg.classifier_quality(rows, spent, 100, ROWS * COLS), "precision", "recall", "accuracy", "f1", "mspf")


@register("a12_error_over_time", sql(f"""
    SELECT video, frame_idx, tp, fp, fn, tn, frames, {_QUALITY}, round((fp + fn) / 216::DOUBLE, 6) AS error_rate,
      coalesce(objects, 0) AS objects FROM (SELECT *, frames * 216 - tp - fp - fn AS tn FROM (
      SELECT video, frame_idx, {_CONF}, CAST(1 AS BIGINT) AS frames FROM aligned GROUP BY video, frame_idx))
    LEFT JOIN (SELECT video, frame_idx, count(*) AS objects FROM detections GROUP BY ALL) USING (video, frame_idx)""",
    "tile_scores", "true_tiles", aligned=_ALIGNED))
def _(spark, sf):
    return rounded(agg.error_over_time(_aligned(spark, sf), fx.detections(spark, sf), 100, ROWS * COLS),
                   "precision", "recall", "accuracy", "f1", "error_rate")


@register("a13_error_heatmap", sql("""
    SELECT row, col, CAST(sum(CASE WHEN coalesce(pred_score, 0) >= 100 AND coalesce(true_score, 0) < 100 THEN 1
      WHEN coalesce(pred_score, 0) < 100 AND coalesce(true_score, 0) >= 100 THEN 2 ELSE 0 END) AS BIGINT) AS error
    FROM aligned GROUP BY ALL""", "tile_scores", "true_tiles", aligned=_ALIGNED))
def _(spark, sf):
    return agg.error_heatmap(_aligned(spark, sf), 100)


@register("a14_score_histogram", sql("""
    SELECT CAST(least(floor(coalesce(pred_score, 0) * 20 / 255.0::DOUBLE), 19) AS BIGINT) AS bin,
      (coalesce(pred_score, 0) >= 100) = (coalesce(true_score, 0) >= 100) AS correct, coalesce(true_score, 0) >= 100 AS actual,
      count(*) AS count FROM aligned GROUP BY ALL""", "tile_scores", "true_tiles", aligned=_ALIGNED))
def _(spark, sf):
    return agg.score_histogram(_aligned(spark, sf), 100)


@register("a15_always_relevant", sql("SELECT row, col, bool_or(score >= 250) AS relevant FROM tile_scores GROUP BY ALL", "tile_scores"))
def _(spark, sf):
    return agg.always_relevant(fx.tile_scores(spark, sf), 250)


@register("a17_retention", sql("""
    SELECT video, count(*) AS original, count(*) FILTER (WHERE score >= 128) AS pruned,
      round(count(*) FILTER (WHERE score >= 128) / count(*), 6) AS retention_rate FROM tile_scores GROUP BY ALL""", "tile_scores"))
def _(spark, sf):
    t = fx.tile_scores(spark, sf)
    return rounded(agg.retention(t, filters.threshold_tiles(t, 128), ["video"]), "retention_rate")


# --- canvases --------------------------------------------------------------

@register("g14_crop_index", sql("SELECT * FROM index_map", "index_map"))
def _(spark, sf):
    return fx.index_map(spark, sf)


@register("g15_collage_range", sql("""
    SELECT video, collage_idx, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame, count(*) AS groups
    FROM placements GROUP BY ALL""", "placements"))
def _(spark, sf):
    return packing.collage_range(fx.placements(spark, sf))


@register("g16_tile_copy_plan", sql("""
    SELECT video, collage_idx, frame_idx, group_id, (row - py + oy) * 60 AS src_y, (col - px + ox) * 60 AS src_x,
      row * 60 AS dst_y, col * 60 AS dst_x FROM index_map JOIN placements USING (video, collage_idx, group_id)""", "index_map"))
def _(spark, sf):
    return packing.tile_copy_plan(fx.index_map(spark, sf), fx.placements(spark, sf), TILE)


@register("a22_compression_counts", sql("""
    SELECT video, images, coalesce(occupied, 0) AS occupied_tiles, images * 864 - coalesce(occupied, 0) AS empty_tiles
    FROM (SELECT video, count(DISTINCT collage_idx) AS images FROM placements GROUP BY ALL)
    LEFT JOIN (SELECT video, count(*) AS occupied FROM index_map GROUP BY ALL) USING (video)""", "index_map"))
def _(spark, sf):
    canvases = fx.placements(spark, sf).select("video", "collage_idx").distinct().withColumn("tiles", F.lit(ROWS * COLS * 4).cast("bigint"))
    return agg.compression_counts(fx.index_map(spark, sf), canvases, ["video"])


_PADDED = """
    SELECT m.video, count(*) AS occupied_tiles, count(*) FILTER (WHERE coalesce(t.score, 0) <= 0.5 * 255) AS padding_tiles
    FROM index_map m JOIN placements p USING (video, collage_idx, group_id)
    LEFT JOIN tile_scores t ON t.video = m.video AND t.frame_idx = p.frame_idx AND t.row = m.row - p.py + p.oy AND t.col = m.col - p.px + p.ox
    GROUP BY m.video"""


def _padding(spark, sf):
    return agg.padding_tiles(fx.index_map(spark, sf), fx.placements(spark, sf), fx.tile_scores(spark, sf), 0.5, ["video"])


@register("a23_padding_tiles", sql("SELECT * FROM padded", "index_map", "tile_scores", padded=_PADDED))
def _(spark, sf):
    return _padding(spark, sf)


_CANVASES = "SELECT video, count(DISTINCT collage_idx) * 864 AS total FROM placements GROUP BY ALL"


def _counts_table(spark, sf):
    total = fx.placements(spark, sf).select("video", "collage_idx").distinct().groupBy("video").agg(
        (F.count("*") * ROWS * COLS * 4).alias("_t"))
    return _padding(spark, sf).join(total, "video").withColumn("empty_tiles", F.col("_t") - F.col("occupied_tiles")).withColumn(
        "config", F.concat(F.lit("c"), F.col("video") % 4))


@register("a24_effectiveness", sql("""
    SELECT config, CAST(sum(total - occupied_tiles) AS BIGINT) AS empty_tiles, CAST(sum(occupied_tiles) AS BIGINT) AS occupied_tiles,
      CAST(sum(padding_tiles) AS BIGINT) AS padding_tiles, CAST(sum(occupied_tiles - padding_tiles) AS BIGINT) AS non_padding_tiles,
      round(sum(occupied_tiles) / greatest(sum(total), 1), 6) AS occupancy, round(sum(padding_tiles) / greatest(sum(occupied_tiles), 1), 6) AS padding_ratio
    FROM (SELECT 'c' || video % 4 AS config, * FROM padded JOIN canvases USING (video)) GROUP BY ALL""",
    "index_map", "tile_scores", padded=_PADDED, canvases=_CANVASES))
def _(spark, sf):
    return rounded(agg.compression_effectiveness(_counts_table(spark, sf), ["config"]), "occupancy", "padding_ratio")


@register("u09_stack_tile_types", sql("""
    WITH t AS (SELECT video, 'empty_tiles' AS tile_type, total - occupied_tiles AS tiles, total FROM padded JOIN canvases USING (video)
      UNION ALL SELECT video, 'non_padding_tiles', occupied_tiles - padding_tiles, total FROM padded JOIN canvases USING (video)
      UNION ALL SELECT video, 'padding_tiles', padding_tiles, total FROM padded JOIN canvases USING (video))
    SELECT video, tile_type, tiles, round(tiles / total, 6) AS share FROM t""",
    "index_map", "tile_scores", padded=_PADDED, canvases=_CANVASES))
def _(spark, sf):
    return rounded(agg.stack_tile_types(_counts_table(spark, sf), ["video"]), "share")


_PROBES = """
    SELECT video, collage_idx, det_id, probe, floor(x / 60) AS col, floor(y / 60) AS row FROM (
      SELECT *, 0 AS probe, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM canvas_detections UNION ALL SELECT *, 1, x1, y1 FROM canvas_detections
      UNION ALL SELECT *, 2, x2, y1 FROM canvas_detections UNION ALL SELECT *, 3, x1, y2 FROM canvas_detections
      UNION ALL SELECT *, 4, x2, y2 FROM canvas_detections) WHERE floor(x / 60) BETWEEN 0 AND 17 AND floor(y / 60) BETWEEN 0 AND 47"""


@register("j14_unpack_detections", sql("""
    WITH f AS (SELECT p.video, p.collage_idx, p.det_id, arg_min(group_id, probe) FILTER (WHERE group_id IS NOT NULL) AS group_id,
        min(probe) FILTER (WHERE group_id IS NOT NULL) AS hit, min(probe) FILTER (WHERE group_id IS NULL) AS miss
      FROM probes p LEFT JOIN index_map m ON p.video = m.video AND p.collage_idx = m.collage_idx AND p.row = m.row AND p.col = m.col GROUP BY ALL)
    SELECT d.video, d.collage_idx, d.det_id, p.frame_idx, f.group_id, d.x1 + (ox - px) * 60 AS x1, d.y1 + (oy - py) * 60 AS y1,
      d.x2 + (ox - px) * 60 AS x2, d.y2 + (oy - py) * 60 AS y2, CASE WHEN f.group_id IS NULL THEN 'no_tile' ELSE 'mapped' END AS status,
      miss IS NOT NULL AND (hit IS NULL OR miss < hit) AS center_missed
    FROM canvas_detections d LEFT JOIN f USING (video, collage_idx, det_id)
    LEFT JOIN placements p ON p.video = d.video AND p.collage_idx = d.collage_idx AND p.group_id = f.group_id""",
    "canvas_detections", "index_map", probes=_PROBES))
def _(spark, sf):
    return joins.unpack_detections(fx.canvas_detections(spark, sf), fx.index_map(spark, sf), fx.placements(spark, sf), TILE, ROWS * 4, COLS)


@register("j15_project_annotations", sql("""
    SELECT * FROM (SELECT video, collage_idx, group_id, frame_idx, track_id,
      greatest(0, least(1080, x1 + dx)) AS x1, greatest(0, least(2880, y1 + dy)) AS y1,
      greatest(0, least(1080, x2 + dx)) AS x2, greatest(0, least(2880, y2 + dy)) AS y2
    FROM (SELECT g.*, s.collage_idx, s.group_id, (s.px - s.ox) * 60 AS dx, (s.py - s.oy) * 60 AS dy,
        row_number() OVER (PARTITION BY g.video, s.collage_idx, g.frame_idx, g.track_id ORDER BY s.group_id) AS rn
      FROM gt_tracks g JOIN (SELECT m.row - py + oy AS row, m.col - px + ox AS col, p.* FROM index_map m
        JOIN placements p USING (video, collage_idx, group_id)) s
      ON s.video = g.video AND s.frame_idx = g.frame_idx AND s.row = floor((y1 + y2) / 2 / 60) AND s.col = floor((x1 + x2) / 2 / 60))
    WHERE rn = 1) WHERE x2 > x1 AND y2 > y1""", "index_map"))
def _(spark, sf):
    return joins.project_annotations(fx.gt_tracks(spark, sf), fx.placements(spark, sf), fx.index_map(spark, sf), TILE, WIDTH, HEIGHT * 4)


# --- groups and pruning ----------------------------------------------------

_OFF = {m: ", ".join(f"({r}, {c})" for r, c in [(0, 0)] + tiles.PADDING[m]) for m in tiles.PADDING}


def _padded_sql(mode: str) -> str:
    return f"""SELECT video, frame_idx, row + dr AS row, col + dc AS col, min(CASE WHEN dr = 0 AND dc = 0 THEN 1 ELSE 2 END) AS kind
      FROM tile_scores, (VALUES {_OFF[mode]}) o(dr, dc) WHERE row + dr BETWEEN 0 AND 11 AND col + dc BETWEEN 0 AND 17
      GROUP BY video, frame_idx, row + dr, col + dc"""


def _edges_sql(mode: str) -> str:
    """Links as ``a -> b``; a diagonal one starts at an original tile."""
    straight = ", ".join(f"({r}, {c})" for r, c in tiles.ORTHOGONAL)
    out = f"""SELECT a.video, a.frame_idx, a.row * 18 + a.col AS a, b.row * 18 + b.col AS b FROM padded a, (VALUES {straight}) o(dr, dc), padded b
      WHERE a.video = b.video AND a.frame_idx = b.frame_idx AND b.row = a.row + dr AND b.col = a.col + dc AND (a.kind = 1 OR b.kind = 1)"""
    if tiles.DIAGONAL[mode]:
        slanted = ", ".join(f"({r}, {c})" for r, c in tiles.DIAGONAL[mode])
        one = f"""FROM padded a, (VALUES {slanted}) o(dr, dc), padded b WHERE a.video = b.video AND a.frame_idx = b.frame_idx
          AND b.row = a.row + dr AND b.col = a.col + dc AND a.kind = 1"""
        ends = ("a.row * 18 + a.col", "b.row * 18 + b.col")
        out = f"""SELECT DISTINCT * FROM ({out} UNION ALL SELECT a.video, a.frame_idx, {ends[0]}, {ends[1]} {one}
          UNION ALL SELECT a.video, a.frame_idx, {ends[1]}, {ends[0]} {one})"""
    return out


@register("g01_pad_tiles", sql("SELECT * FROM padded", "tile_scores", padded=_padded_sql("tr")))
def _(spark, sf):
    return tiles.pad_tiles(fx.tile_scores(spark, sf), "tr", ROWS, COLS)


@register("j18_tile_adjacency", sql("""
    SELECT video, frame_idx, a // 18 AS src_row, a % 18 AS src_col, b // 18 AS dst_row, b % 18 AS dst_col FROM edges""",
    "tile_scores", padded=_padded_sql("bl"), edges=_edges_sql("bl")))
def _(spark, sf):
    padded = tiles.pad_tiles(fx.tile_scores(spark, sf), "bl", ROWS, COLS)
    return tiles.tile_adjacency(padded, "bl")


_REACH = """
    SELECT video, frame_idx, row * 18 + col AS cell, row * 18 + col AS root FROM padded
    UNION SELECT e.video, e.frame_idx, e.b, r.root FROM rec_reach r JOIN edges e ON e.video = r.video AND e.frame_idx = r.frame_idx AND e.a = r.cell
      WHERE r.root < e.b"""
_GROUPED = """
    SELECT c.video, c.frame_idx, c.cell // 18 AS row, c.cell % 18 AS col, kind, group_id, size, oy, ox
    FROM (SELECT video, frame_idx, cell, min(root) AS root FROM rec_reach GROUP BY ALL) c
    JOIN (SELECT *, row_number() OVER (PARTITION BY video, frame_idx ORDER BY size DESC, oy, ox, root) - 1 AS group_id FROM (
        SELECT video, frame_idx, root, count(*) AS size, min(cell // 18) AS oy, min(cell % 18) AS ox
        FROM (SELECT video, frame_idx, cell, min(root) AS root FROM rec_reach GROUP BY ALL) GROUP BY ALL)) s
      ON s.video = c.video AND s.frame_idx = c.frame_idx AND s.root = c.root
    JOIN padded p ON p.video = c.video AND p.frame_idx = c.frame_idx AND p.row = c.cell // 18 AND p.col = c.cell % 18"""


def _group_query(mode: str):
    text = sql(_GROUPED, "tile_scores", recursive=True, padded=_padded_sql(mode), edges=_edges_sql(mode), rec_reach=_REACH)

    @register(f"g02_group_tiles_{mode}", text)
    def _(spark, sf):
        return grouping.group_tiles(fx.tile_scores(spark, sf), mode, ROWS, COLS)


for _mode in ("none", "plus", "tr"):
    _group_query(_mode)


# Selection and packing work on the connected groups of the relevant tiles.
_GROUPS = dict(padded=_padded_sql("none"), edges=_edges_sql("none"), rec_reach=_REACH, grouped=_GROUPED)
_TG = "SELECT video, frame_idx, row, col, group_id FROM grouped"


def _tile_groups(spark, sf):
    return grouping.group_tiles(fx.tile_scores(spark, sf), "none", ROWS, COLS).select("video", "frame_idx", "row", "col", "group_id")


@register("g03_w12_group_ids", sql("""
    SELECT video, frame_idx, group_id, size, min_row, min_col,
      row_number() OVER (PARTITION BY video, frame_idx ORDER BY size DESC, min_row, min_col, block) - 1 AS rank
    FROM (SELECT video, frame_idx, group_id, group_id AS block, count(*) AS size, min(row) AS min_row, min(col) AS min_col FROM tg GROUP BY ALL)""",
    "tile_scores", recursive=True, **_GROUPS, tg=_TG))
def _(spark, sf):
    sizes = _tile_groups(spark, sf).groupBy("video", "frame_idx", F.col("group_id").alias("block")).agg(
        F.count("*").alias("size"), F.min("row").alias("min_row"), F.min("col").alias("min_col"))
    return trajectories.group_ids(sizes).select(*FRAME, F.col("block").alias("group_id"), "size", "min_row", "min_col",
                                                F.col("group_id").alias("rank"))


_RATES = "SELECT row, col, 1 + count(*) % 8 AS max_rate FROM tile_scores GROUP BY row, col"


def _groups_and_rates(spark, sf):
    """Groups, computed once for all that use them, and the rates; each tile is in one group, so its rows count its scores."""
    groups = materialize(_tile_groups(spark, sf), "groups")
    return groups, groups.groupBy("row", "col").agg((F.count("*") % 8 + 1).alias("max_rate"))


_AROUND = """
    SELECT t.*, max_rate, lead(frame_idx) OVER w AS nf, lag(frame_idx) OVER w AS pf FROM tg t JOIN rates USING (row, col)
    WINDOW w AS (PARTITION BY video, row, col ORDER BY frame_idx)"""
_RULES = """
    SELECT video, row, col, frame_idx, group_id, CAST(NULL AS BIGINT) AS until, 'forced' AS kind FROM around
    WHERE (nf IS NOT NULL OR pf IS NOT NULL) AND (nf IS NULL OR pf IS NULL OR nf - frame_idx > max_rate OR frame_idx - pf > max_rate)
    UNION ALL SELECT video, row, col, frame_idx, group_id, frame_idx + max_rate, 'window' FROM around WHERE nf - frame_idx <= max_rate"""


@register("g09_prune_constraints", sql("SELECT * FROM rules", "tile_scores", recursive=True, **_GROUPS, tg=_TG, rates=_RATES, around=_AROUND, rules=_RULES))
def _(spark, sf):
    return pruning.prune_constraints(*_groups_and_rates(spark, sf))


_SIZES = "SELECT video, frame_idx, group_id, count(*) AS size FROM tg GROUP BY ALL"
_RUNS = """
    SELECT video, row, col, frame_idx // (max_rate + 1) AS run, min(frame_idx) AS fa, arg_min(group_id, frame_idx) AS ga,
      max(frame_idx) AS fb, arg_max(group_id, frame_idx) AS gb FROM tg JOIN rates USING (row, col) GROUP BY ALL"""
_CHOSEN0 = """
    SELECT DISTINCT video, frame_idx, group_id FROM (SELECT video, row, col, fa AS frame_idx, ga AS group_id FROM runs
      UNION ALL SELECT video, row, col, fb, gb FROM runs) JOIN covers USING (video, row, col) WHERE n > 1"""
_COVERS = "SELECT video, row, col, count(*) AS n FROM tg GROUP BY ALL"
_NEAR = """
    SELECT t.video, t.row, t.col, t.frame_idx, t.group_id, size, n, max_rate, lead(t.frame_idx) OVER w AS nf, lag(t.frame_idx) OVER w AS pf,
      lead(t.group_id) OVER w AS ng, lag(t.group_id) OVER w AS pg
    FROM tg t JOIN chosen0 USING (video, frame_idx, group_id) JOIN sizes USING (video, frame_idx, group_id)
    JOIN rates r ON r.row = t.row AND r.col = t.col JOIN covers k ON k.video = t.video AND k.row = t.row AND k.col = t.col
    WINDOW w AS (PARTITION BY t.video, t.row, t.col ORDER BY t.frame_idx)"""
_SPARE = """
    SELECT video, frame_idx, group_id, size FROM near GROUP BY ALL
    HAVING bool_and(n = 1 OR coalesce(nf - pf <= max_rate, FALSE))"""
_DROPPED = """
    SELECT * FROM spare s WHERE NOT EXISTS (SELECT 1 FROM (SELECT video, frame_idx, group_id, nf AS f, ng AS g FROM near
        UNION ALL SELECT video, frame_idx, group_id, pf, pg FROM near) o
      JOIN spare r ON r.video = o.video AND r.frame_idx = o.f AND r.group_id = o.g
      WHERE o.video = s.video AND o.frame_idx = s.frame_idx AND o.group_id = s.group_id
        AND (r.size > s.size OR (r.size = s.size AND (r.frame_idx < s.frame_idx OR (r.frame_idx = s.frame_idx AND r.group_id < s.group_id)))))"""
_PRUNE = dict(**_GROUPS, tg=_TG, rates=_RATES, covers=_COVERS, sizes=_SIZES, runs=_RUNS, chosen0=_CHOSEN0, near=_NEAR, spare=_SPARE, dropped=_DROPPED)


@register("g10_prune_groups", sql("""
    SELECT c.*, size FROM chosen0 c JOIN sizes USING (video, frame_idx, group_id) WHERE NOT EXISTS (SELECT 1 FROM dropped d
      WHERE d.video = c.video AND d.frame_idx = c.frame_idx AND d.group_id = c.group_id)""", "tile_scores", recursive=True, **_PRUNE))
def _(spark, sf):
    return pruning.prune_groups(*_groups_and_rates(spark, sf), refine=1)


@register("g11_check_prune", sql("""
    SELECT kind, count(*) AS broken FROM (
      SELECT r.kind FROM rules r WHERE r.kind = 'forced' AND r.group_id NOT IN (0, 4, 8)
      UNION ALL SELECT r.kind FROM rules r WHERE r.kind = 'window' AND r.group_id IN (0, 4, 8) AND NOT EXISTS (
        SELECT 1 FROM tg t WHERE t.group_id IN (0, 4, 8) AND t.video = r.video AND t.row = r.row AND t.col = r.col
          AND t.frame_idx > r.frame_idx AND t.frame_idx <= r.until)) GROUP BY ALL""",
    "tile_scores", recursive=True, **_GROUPS, tg=_TG, rates=_RATES, around=_AROUND, rules=_RULES))
def _(spark, sf):
    groups, rates = _groups_and_rates(spark, sf)
    picked = groups.where("group_id IN (0, 4, 8)").select(*pruning.GROUP).distinct()
    return pruning.check_prune(picked, groups, rates).groupBy("kind").agg(F.count("*").alias("broken"))


# A feasible selection breaks no constraint.
@register("g11_prune_is_feasible", "SELECT CAST(0 AS BIGINT) AS broken")
def _(spark, sf):
    groups, rates = _groups_and_rates(spark, sf)
    broken = pruning.check_prune(pruning.prune_groups(groups, rates, refine=2), groups, rates)
    return broken.agg(F.count("*").alias("broken"))


@register("g12_apply_selection", sql("""
    SELECT t.video, count(*) AS tiles FROM tg t JOIN (SELECT c.* FROM chosen0 c WHERE NOT EXISTS (SELECT 1 FROM dropped d
      WHERE d.video = c.video AND d.frame_idx = c.frame_idx AND d.group_id = c.group_id)) USING (video, frame_idx, group_id) GROUP BY ALL""",
    "tile_scores", recursive=True, **{**_PRUNE, "rates": "SELECT row, col, greatest((1 + count(*) % 8) // 2, 1) AS max_rate FROM tile_scores GROUP BY row, col"}))
def _(spark, sf):
    groups, rates = _groups_and_rates(spark, sf)
    rates = pruning.scale_rates(rates, 2)
    return pruning.apply_selection(groups, pruning.prune_groups(groups, rates, refine=1)).groupBy("video").agg(F.count("*").alias("tiles"))


@register("w16_first_last", sql("""
    SELECT video, row, col, min(frame_idx) AS first_frame, arg_min(group_id, frame_idx) AS first_group, max(frame_idx) AS last_frame,
      arg_max(group_id, frame_idx) AS last_group FROM tg GROUP BY ALL""", "tile_scores", recursive=True, **_GROUPS, tg=_TG))
def _(spark, sf):
    return trajectories.first_last_per_tile(_tile_groups(spark, sf))


@register("w16_largest_groups", sql("""
    SELECT * EXCLUDE (rn), rn - 1 AS group_id FROM (SELECT *, row_number() OVER (PARTITION BY video, frame_idx ORDER BY size DESC, min_row, min_col) AS rn
      FROM (SELECT video, frame_idx, group_id AS block, count(*) AS size, min(row) AS min_row, min(col) AS min_col FROM tg GROUP BY ALL)) WHERE rn <= 2""",
    "tile_scores", recursive=True, **_GROUPS, tg=_TG))
def _(spark, sf):
    sizes = _tile_groups(spark, sf).groupBy("video", "frame_idx", F.col("group_id").alias("block")).agg(
        F.count("*").alias("size"), F.min("row").alias("min_row"), F.min("col").alias("min_col"))
    return trajectories.largest_groups(sizes, 2)


_PACK = """
    SELECT *, CAST(CASE WHEN size_class <= 6 THEN floor((row_number() OVER w - 1) / size_class)
        ELSE floor(coalesce(sum(size) OVER (PARTITION BY video, batch, size_class ORDER BY size DESC, frame_idx, group_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 186) END AS BIGINT) AS slot
    FROM (SELECT video, frame_idx // 16 AS batch, frame_idx, group_id, size, CAST(least(floor(216 / size), 7) AS BIGINT) AS size_class FROM sizes)
    WINDOW w AS (PARTITION BY video, batch, size_class ORDER BY size DESC, frame_idx, group_id)"""


def _sizes(spark, sf):
    return _tile_groups(spark, sf).groupBy("video", "frame_idx", "group_id").agg(F.count("*").alias("size")).withColumn(
        "batch", F.floor(F.col("frame_idx") / 16))


@register("g13_pack_groups", sql(_PACK, "tile_scores", recursive=True, **_GROUPS, tg=_TG, sizes=_SIZES))
def _(spark, sf):
    return packing.pack_groups(_sizes(spark, sf), ROWS * COLS, ["video", "batch"])


# One group after the other; the free cells of a batch's canvases travel along.
_FIT_AT = {"first": "list_position(list_transform(r.free, lambda x: x >= o.size), true)", "best": "list_position(r.free, list_min(list_filter(r.free, lambda x: x >= o.size)))",
           "easiest": "CASE WHEN list_max(r.free) >= o.size THEN list_position(r.free, list_max(r.free)) END"}


def _fit_query(mode: str):
    text = sql("SELECT video, frame_idx, group_id, size, batch, slot FROM rec_packed WHERE k > 0", "tile_scores", recursive=True, **_GROUPS, tg=_TG, sizes=_SIZES,
               ordered="""SELECT video, frame_idx // 16 AS batch, frame_idx, group_id, size,
                 row_number() OVER (PARTITION BY video, frame_idx // 16 ORDER BY size DESC, frame_idx, group_id) AS k FROM sizes""",
               rec_packed=f"""SELECT DISTINCT video, batch, 0::BIGINT AS k, NULL::BIGINT AS frame_idx, NULL::BIGINT AS group_id, NULL::BIGINT AS size, NULL::BIGINT AS slot, []::BIGINT[] AS free FROM ordered
                 UNION ALL SELECT video, batch, k, frame_idx, group_id, size, CAST(coalesce(place - 1, len(free)) AS BIGINT),
                   CASE WHEN place IS NULL THEN list_append(free, 216 - size) ELSE list_concat(list_append(free[1:place - 1], free[place] - size), free[place + 1:]) END
                 FROM (SELECT o.*, r.free, nullif({_FIT_AT[mode]}, 0) AS place FROM rec_packed r JOIN ordered o ON o.video = r.video AND o.batch = r.batch AND o.k = r.k + 1)""")

    @register(f"g13_pack_{mode}_fit", text)
    def _(spark, sf):
        return packing.pack_fit(_sizes(spark, sf), ROWS * COLS, ["video", "batch"], mode)


for _mode in packing.FITS:
    _fit_query(_mode)


@register("g13_canvas_bound", sql("""
    SELECT video, frame_idx // 16 AS batch, CAST(ceil(sum(size) / 216) AS BIGINT) AS min_canvases FROM sizes GROUP BY ALL""",
    "tile_scores", recursive=True, **_GROUPS, tg=_TG, sizes=_SIZES))
def _(spark, sf):
    return packing.canvas_bound(_sizes(spark, sf), ROWS * COLS, ["video", "batch"])


# --- scalar functions ------------------------------------------------------

_PAIR_SQL = """
    SELECT g.video, g.frame_idx, g.track_id AS gid, p.track_id AS pid, g.x1 AS ax1, g.y1 AS ay1, g.x2 AS ax2, g.y2 AS ay2,
      p.x1 AS bx1, p.y1 AS by1, p.x2 AS bx2, p.y2 AS by2, p.score,
      greatest(0, least(g.x2, p.x2) - greatest(g.x1, p.x1)) * greatest(0, least(g.y2, p.y2) - greatest(g.y1, p.y1)) AS inter
    FROM gt_tracks g JOIN pred_tracks p USING (video, frame_idx)
    WHERE least(g.x2, p.x2) > greatest(g.x1, p.x1) AND least(g.y2, p.y2) > greatest(g.y1, p.y1)"""
_IOU_SQL = """
    SELECT *, inter / uni AS iou, (greatest(ax2, bx2) - least(ax1, bx1)) AS hw, (greatest(ay2, by2) - least(ay1, by1)) AS hh,
      pow((ax1 + ax2) / 2 - (bx1 + bx2) / 2, 2) + pow((ay1 + ay2) / 2 - (by1 + by2) / 2, 2) AS gap2,
      4 / pow(pi(), 2) * pow(atan((bx2 - bx1) / (by2 - by1 + 1)) - atan((ax2 - ax1) / (ay2 - ay1 + 1)), 2) AS v
    FROM (SELECT *, (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - inter AS uni FROM pairs)"""


def _pairs(spark, sf):
    return joins.iou_join(fx.gt_tracks(spark, sf), fx.pred_tracks(spark, sf))


@register("j16_iou_join", sql("""
    SELECT video, frame_idx, gid AS l_track_id, pid AS r_track_id, round(iou, 6) AS iou FROM ious WHERE iou >= 0.3""",
    "pred_tracks", pairs=_PAIR_SQL, ious=_IOU_SQL))
def _(spark, sf):
    return rounded(joins.iou_join(fx.gt_tracks(spark, sf), fx.pred_tracks(spark, sf), 0.3).select(
        "video", "frame_idx", "l_track_id", "r_track_id", "iou"), "iou")


@register("j17_overlap_join", sql("""
    SELECT g.video, g.frame_idx, g.track_id AS l_track_id, p.track_id AS r_track_id FROM gt_tracks g JOIN pred_tracks p USING (video, frame_idx)
    WHERE g.x1 <= p.x2 AND p.x1 <= g.x2 AND g.y1 <= p.y2 AND p.y1 <= g.y2""", "pred_tracks"))
def _(spark, sf):
    return joins.overlap_join(fx.gt_tracks(spark, sf), fx.pred_tracks(spark, sf)).select(
        "video", "frame_idx", "l_track_id", "r_track_id")


@register("x01_x06_similarities", sql("""
    SELECT video, frame_idx, gid AS l_track_id, pid AS r_track_id, round(iou, 6) AS iou,
      round(i1 / ((ax2 - ax1 + 1) * (ay2 - ay1 + 1) + (bx2 - bx1 + 1) * (by2 - by1 + 1) - i1), 6) AS iou_plus1,
      round((iou - (hw * hh - uni) / (hw * hh) + 1) / 2, 6) AS giou, round((iou - gap2 / (hw * hw + hh * hh) + 1) / 2, 6) AS diou,
      round((iou - gap2 / (hw * hw + hh * hh) - coalesce(v / nullif(1 - iou + v, 0), 0) * v + 1) / 2, 6) AS ciou,
      round(CASE WHEN top > 0 THEN (top - sqrt(gap2)) / top ELSE 0 END, 6) AS center, round(iou * score, 6) AS fused
    FROM (SELECT *, (least(ax2, bx2) - greatest(ax1, bx1) + 1) * (least(ay2, by2) - greatest(ay1, by1) + 1) AS i1,
      max(sqrt(gap2)) OVER (PARTITION BY video, frame_idx) AS top FROM ious)""", "pred_tracks", pairs=_PAIR_SQL, ious=_IOU_SQL))
def _(spark, sf):
    a, b = g.box("l_"), g.box("r_")
    names = ["iou", "iou_plus1", "giou", "diou", "ciou", "center", "fused"]
    pairs = joins.with_center_similarity(_pairs(spark, sf), FRAME)
    return rounded(pairs.select(
        "video", "frame_idx", "l_track_id", "r_track_id", "iou", g.iou_plus1(a, b).alias("iou_plus1"), g.giou(a, b).alias("giou"),
        g.diou(a, b).alias("diou"), g.ciou(a, b).alias("ciou"),
        F.col("center_similarity").alias("center"),
        (1 - g.fuse_score(1 - F.col("iou"), F.col("r_score"))).alias("fused")), *names)


@register("x11_fused_appearance", sql("""
    SELECT video, frame_idx, gid AS l_track_id, pid AS r_track_id, round(1 - score * (1 + iou) / 2 + 1e-9, 6) AS cost FROM ious""",
    "pred_tracks", pairs=_PAIR_SQL, ious=_IOU_SQL))
def _(spark, sf):
    """The score stands for the similarity of appearance."""
    cost = g.fuse_iou(1 - F.col("r_score"), F.col("iou")) + 1e-9  # off the ties of rounding
    return rounded(_pairs(spark, sf).select("video", "frame_idx", "l_track_id", "r_track_id", cost.alias("cost")), "cost")


@register("x08_box_conversions", sql("""
    SELECT video, frame_idx, track_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, (x2 - x1) * (y2 - y1) AS area,
      round((x2 - x1) / (y2 - y1), 6) AS ratio, x2 - x1 AS width, y2 - y1 AS height,
      round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM gt_tracks""", "gt_tracks"))
def _(spark, sf):
    b = g.box()
    conv = fx.gt_tracks(spark, sf).select("video", "frame_idx", "track_id", *g.to_center_area(b), *g.to_tlwh(b)[2:])
    back = g.from_center_area(F.col("cx"), F.col("cy"), F.col("area"), F.col("ratio"))
    return rounded(conv.select("*", *back), "ratio", "x1", "y1", "x2", "y2")


@register("x11_feature_distance", """
    SELECT a.vec_id, round(greatest(0, 1 - list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))
        / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])))
         * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))), 6) AS distance
    FROM embeddings a JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) b USING (label)""")
def _(spark, sf):
    e = fx.read(spark, sf, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("_ref"))
    return rounded(e.join(first, "label").select("vec_id", g.cosine_distance(F.col("embedding"), F.col("_ref")).alias("distance")), "distance")


@register("x12_x21_tile_of", sql("""
    SELECT video, frame_idx, track_id, CAST(floor(y1 / 60) AS BIGINT) AS row, CAST(floor(x2 / 60) AS BIGINT) AS col,
      floor(y1 / 60) BETWEEN 0 AND 11 AND floor(x2 / 60) BETWEEN 0 AND 17 AS in_grid, x1 <= 500 AND 300 <= x2 AS spans FROM gt_tracks""", "gt_tracks"))
def _(spark, sf):
    row, col = g.tile_of(F.col("y1"), TILE), g.tile_of(F.col("x2"), TILE)
    spans = g.overlap1d(F.col("x1"), F.col("x2"), F.lit(300), F.lit(500))
    return fx.gt_tracks(spark, sf).select("video", "frame_idx", "track_id", row.alias("row"), col.alias("col"),
                                          g.tile_in_grid(row, col, ROWS, COLS).alias("in_grid"), spans.alias("spans"))


@register("x20_canvas_dims", """
    SELECT p_partkey, p_size * 10 // 3 AS src_rows, p_size * 25 // 3 AS src_cols,
      greatest(1, CAST(round_even((p_size * 10 // 3) * 0.5, 0) AS BIGINT)) AS dst_rows, greatest(1, CAST(round_even((p_size * 25 // 3) * 0.5, 0) AS BIGINT)) AS dst_cols
    FROM part""")
def _(spark, sf):
    p = fx.read(spark, sf, "part")
    return p.select("p_partkey", *g.canvas_dims(F.col("p_size") * 25, F.col("p_size") * 10, 3, 0.5))


@register("x22_point_in_polygon", sql(f"SELECT video, frame_idx, track_id, {_inside_sql('x1', 'y1')} AS inside FROM gt_tracks", "gt_tracks"))
def _(spark, sf):
    return fx.gt_tracks(spark, sf).select("video", "frame_idx", "track_id",
                                          g.point_in_polygon(F.col("x1"), F.col("y1"), _POLYGON).alias("inside"))
