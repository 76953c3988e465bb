"""Registered queries that write derived tables in each file format and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackgrid.plans import fixtures as fx
from trackgrid.plans import trainsets
from trackgrid.plans.catalog import register, rounded
from trackgrid.plans.fixtures import COLS, HEIGHT, ROWS, TILE, WIDTH, sql
from trackgrid.plans.tiles import _POLYGON, _inside_sql
from trackgrid.plans.tradeoffs import joined, tradeoff_sql
from trackgrid.plans.tracking import _INTERP, nms_sql
from trackgrid.scale import new_path
from trackgrid.sources import frames, labels, tables


def _long(df, *columns):
    """File names and JSON give strings and ints; compare as BIGINT."""
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


_DET = """SELECT video, frame_idx, row_number() OVER (PARTITION BY video, frame_idx ORDER BY det_id) - 1 AS det_id, x1, y1, x2, y2,
    score FROM detections"""


@register("s01_read_detections", sql(_DET, "detections"))
def _(spark, sf):
    path = new_path(spark, "s01")
    frames.write_detections(fx.detections(spark, sf), path)
    return _long(frames.read_detections(spark, path), "video", "frame_idx", "det_id")


@register("s02_read_index_detections", sql(_DET, "detections"))
def _(spark, sf):
    path = new_path(spark, "s02")
    frames.write_index_detections(fx.detections(spark, sf), path)
    return _long(frames.read_index_detections(spark, path), "video", "frame_idx", "det_id")


@register("s03_s14_tracks", sql("""
    SELECT video, frame_idx, track_id, x1, y1, x2, y2, 0 AS class, 1.0::DOUBLE AS confidence FROM gt_tracks""", "gt_tracks"))
def _(spark, sf):
    path = new_path(spark, "s03")
    frames.write_tracks(fx.gt_tracks(spark, sf), path)
    return _long(frames.read_tracks(spark, path), "video", "frame_idx", "class")


@register("s14_track_frames", sql("""
    SELECT r.video, f AS frame_idx, coalesce(n, 0) AS boxes FROM (SELECT video, unnest(range(a, b + 1)) AS f FROM (
      SELECT video, min(frame_idx) AS a, max(frame_idx) AS b FROM gt_tracks GROUP BY ALL)) r
    LEFT JOIN (SELECT video, frame_idx, count(*) AS n FROM gt_tracks GROUP BY ALL) g ON g.video = r.video AND g.frame_idx = f""", "gt_tracks"))
def _(spark, sf):
    return frames.track_frames(fx.gt_tracks(spark, sf)).select("video", "frame_idx", F.size("tracks").cast("bigint").alias("boxes"))


@register("s15_tracks_total", sql("""
    SELECT video, f AS frame_idx, coalesce(n, 0) AS boxes FROM (SELECT DISTINCT video FROM gt_tracks) JOIN (SELECT range AS f FROM range(300)) ON TRUE
    LEFT JOIN (SELECT video, frame_idx AS f, count(*) AS n FROM gt_tracks GROUP BY ALL) USING (video, f)""", "gt_tracks"))
def _(spark, sf):
    return frames.track_frames(fx.gt_tracks(spark, sf), 300).select("video", "frame_idx", F.size("tracks").cast("bigint").alias("boxes"))


@register("s04_read_tile_scores", sql("""
    SELECT f.video, f.frame_idx, row, col, coalesce(score, 0) AS score FROM (SELECT DISTINCT video, frame_idx FROM tile_scores) f
    JOIN grid_rows ON TRUE JOIN grid_cols ON TRUE LEFT JOIN tile_scores t USING (video, frame_idx, row, col)""", "tile_scores"))
def _(spark, sf):
    path = new_path(spark, "s04")
    frames.write_tile_scores(fx.tile_scores(spark, sf), path, ROWS, COLS)
    return _long(frames.read_tile_scores(spark, path), "video", "frame_idx", "row", "score")


@register("s05_read_pruned_scores", sql("""
    SELECT video, frame_idx, row, col, score FROM tile_scores WHERE score >= 128""", "tile_scores"))
def _(spark, sf):
    path = new_path(spark, "s05")
    # A tile names its variants where its frame lies, and files are packed: most of a grid is zeros.
    names = F.array(F.when(F.col("score") >= 128, "yolo_60_040"), F.when(F.col("score") >= 64, "yolo_60_060"))
    both = fx.tile_scores(spark, sf).where("score >= 64").withColumn("variant_id", F.explode(names)).where("variant_id IS NOT NULL")
    enc = frames.encode_tile_scores(both, ROWS, COLS, ["variant_id"])
    frames.by_folder(enc, "variant_id", "video").write.option("compression", "gzip").partitionBy("variant_id", "video").json(path)
    return _long(frames.read_tile_scores(spark, path, variant_id="yolo_60_040").where("score > 0"), "video", "frame_idx", "row", "score")


@register("s06_encode_tile_scores", sql("""
    SELECT f.video, f.frame_idx AS idx, string_agg(lpad(lower(hex(CAST(coalesce(score, 0) AS BIGINT))), 2, '0'), '' ORDER BY row, col) AS classification_hex
    FROM (SELECT DISTINCT video, frame_idx FROM tile_scores) f JOIN grid_rows ON TRUE JOIN grid_cols ON TRUE
    LEFT JOIN tile_scores t USING (video, frame_idx, row, col) GROUP BY ALL""", "tile_scores"))
def _(spark, sf):
    return _long(frames.encode_tile_scores(fx.tile_scores(spark, sf), ROWS, COLS).drop("classification_size"), "idx")


@register("s07_s08_placements", sql("""
    SELECT video, collage_idx, row_number() OVER (PARTITION BY video, collage_idx ORDER BY group_id) AS group_id, frame_idx, py, px, oy, ox
    FROM placements""", "placements"))
def _(spark, sf):
    path = new_path(spark, "s07")
    frames.write_placements(fx.placements(spark, sf), path)
    return _long(frames.read_placements(spark, path).drop("start_frame", "end_frame"), "video", "collage_idx")


@register("s09_read_runtime", sql("""
    SELECT video, stage, op, round(time, 6) AS time FROM runtimes WHERE stage = '030_exec_compress' AND op <> 'save_collage'""", "runtimes"))
def _(spark, sf):
    path = new_path(spark, "s09")
    logs = fx.runtimes(spark, sf).where("stage = '030_exec_compress'")
    line = F.to_json(F.struct(F.array(F.struct("op", (F.col("time") * 1000).alias("time"))).alias("runtime"), F.lit(1).alias("frames")))
    logs.select("video", line.alias("value")).write.partitionBy("video").text(path)
    return rounded(frames.read_runtime(spark, path, "030_exec_compress", glob="*"), "time")


def _write_frame_arrays(spark, df, path, folder):
    """Files ``<folder>/<video>.json`` of one array of frames each, null where a frame has no objects."""
    obj = F.struct(F.col("x1").alias("left"), F.col("y1").alias("top"), F.col("x2").alias("right"), F.col("y2").alias("bottom"),
                   F.lit("car").alias("class"), "score", "track_id")
    per_frame = df.groupBy("video", "frame_idx").agg(F.array_sort(F.collect_list(obj)).alias("o"))
    spans = df.groupBy("video").agg(F.max("frame_idx").alias("m")).select("video", F.explode(F.sequence(F.lit(0).cast("bigint"), "m")).alias("frame_idx"))
    rows = spans.join(per_frame, ["video", "frame_idx"], "left").withColumn("j", F.coalesce(F.to_json("o"), F.lit("null")))
    doc = rows.groupBy("video").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "j"))), lambda s: s["j"]), ",").alias("d"))
    doc.select(F.lit(folder).alias("param"), "video", F.concat(F.lit("["), "d", F.lit("]")).alias("value")).write.partitionBy("param", "video").text(path)


@register("s11_list_videos", """
    SELECT DISTINCT 'site1' AS dataset, CASE WHEN s_suppkey % 2 = 0 THEN 'valid' ELSE 'test' END AS videoset, 'n' || s_nationkey % 5 AS folder FROM supplier""")
def _(spark, sf):
    path = new_path(spark, "s11")
    names = fx.read(spark, sf, "supplier").select(
        F.lit("site1").alias("dataset"), F.when(F.col("s_suppkey") % 2 == 0, "valid").otherwise("test").alias("videoset"),
        F.concat(F.lit("n"), F.col("s_nationkey") % 5, F.lit(".mp4")).alias("video"), F.lit("x").alias("value")).distinct()
    # A text writer names part files itself, so here the folder stands for the video.
    names.write.partitionBy("dataset", "videoset", "video").text(path)
    layout = r"dataset=([^/]+)/videoset=([^/]+)/video=([^/.]+)"
    return tables.list_videos(spark, path, ("txt",), layout).distinct().withColumnRenamed("video", "folder")


@register("s12_tradeoff_csv", tradeoff_sql("SELECT * REPLACE (CAST(sample_rate AS BIGINT) AS sample_rate) FROM tradeoff"))
def _(spark, sf):
    path = new_path(spark, "s12")
    table = joined(spark, sf)
    tables.write_table(table, path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    return tables.read_table(spark, path, schema)


@register("s13_results_glob", sql("""
    SELECT dataset, count(*) AS n, round(sum(HOTA_HOTA), 6) AS total FROM accuracy GROUP BY ALL""", "accuracy"))
def _(spark, sf):
    path = new_path(spark, "s13")
    fx.accuracy(spark, sf).select("dataset", "variant_id", "HOTA_HOTA").write.partitionBy("dataset").csv(path, header=True)
    rows = tables.read_results_glob(spark, f"{path}/*/*.csv", "variant_id STRING, HOTA_HOTA DOUBLE")
    return rounded(rows.withColumn("dataset", F.url_decode(F.url_decode("dataset"))).groupBy("dataset").agg(
        F.count("*").alias("n"), F.sum("HOTA_HOTA").alias("total")), "total")


@register("s16_mot", sql("""
    SELECT video, frame_idx, track_id, (frame_idx + 1) || ',' || track_id || ',' || printf('%.2f,%.2f,%.2f,%.2f', x1, y1, x2 - x1, y2 - y1) || ',1.0,-1,-1,-1' AS value
    FROM pred_tracks""", "pred_tracks"))
def _(spark, sf):
    return labels.mot_lines(fx.pred_tracks(spark, sf))


@register("s16_mot_files", sql("SELECT video, count(*) AS lines, min(frame_idx) + 1 AS first FROM pred_tracks GROUP BY ALL", "pred_tracks"))
def _(spark, sf):
    path = new_path(spark, "s16")
    labels.to_mot(fx.pred_tracks(spark, sf), path)
    lines = spark.read.text(path)
    return _long(lines.groupBy("video").agg(F.count("*").alias("lines"), F.min(F.split("value", ",")[0].cast("bigint")).alias("first")), "video")


@register("s17_cvat", sql("""
    SELECT track_id, count(*) AS boxes, min(frame_idx) AS first_frame, round(max(x2), 2) AS right_edge FROM gt_tracks GROUP BY ALL""", "gt_tracks"))
def _(spark, sf):
    path = new_path(spark, "s17")
    labels.to_cvat(fx.gt_tracks(spark, sf), path)
    back = spark.read.format("xml").option("rowTag", "track").schema(
        "_id BIGINT, _label STRING, box ARRAY<STRUCT<_frame: BIGINT, _xbr: DOUBLE>>").load(f"{path}/*")
    return back.select(F.col("_id").alias("track_id"), F.explode("box").alias("b")).groupBy("track_id").agg(
        F.count("*").alias("boxes"), F.min("b._frame").alias("first_frame"), F.max("b._xbr").alias("right_edge"))


_LABELS = """
    SELECT CASE WHEN video % 5 = 0 THEN 'val' ELSE 'train' END AS split, video || '_' || lpad(CAST(frame_idx AS VARCHAR), 8, '0') AS image, x1, y1, x2, y2
    FROM detections"""


def _all_labels(spark, sf):
    return fx.detections(spark, sf).select(
        F.when(F.col("video") % 5 == 0, "val").otherwise("train").alias("split"),
        F.concat_ws("_", F.col("video").cast("string"), F.format_string("%08d", "frame_idx")).alias("image"),
        F.lit(WIDTH).alias("image_width"), F.lit(HEIGHT).alias("image_height"), "x1", "y1", "x2", "y2")


@register("s18_yolo_labels", sql(f"""
    SELECT split, image, '0 ' || printf('%.6f %.6f %.6f %.6f', (x1 + x2) / 2 / 1080, (y1 + y2) / 2 / 720, (x2 - x1) / 1080, (y2 - y1) / 720) AS value
    FROM ({_LABELS})""", "detections"))
def _(spark, sf):
    return labels.yolo_labels(_all_labels(spark, sf))


@register("s20_darknet_labels", sql(f"""
    SELECT split, image, '0 ' || printf('%.6f %.6f %.6f %.6f', (x1 + x2) / 2 / 1080, (y1 + y2) / 2 / 720, (x2 - x1) / 1080, (y2 - y1) / 720) AS value
    FROM ({_LABELS})""", "detections"))
def _(spark, sf):
    return labels.yolo_labels(_all_labels(spark, sf), target=(WIDTH * 2, HEIGHT * 2))


@register("s19_s21_coco", sql(f"""
    SELECT i.id AS image_id, l.image, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, (x2 - x1) * (y2 - y1) AS area
    FROM labelled l JOIN (SELECT split, image, row_number() OVER (ORDER BY split, image) AS id FROM (SELECT DISTINCT split, image FROM labelled)) i USING (split, image)""",
    "detections", labelled=_LABELS))
def _(spark, sf):
    path = new_path(spark, "s19")
    labels.to_coco(_all_labels(spark, sf), path)
    back = labels.read_labels(spark, path, "coco")
    ids = spark.read.schema("id BIGINT, file_name STRING").json(f"{path}/images", recursiveFileLookup=True).select(
        F.col("id").alias("image_id"), F.regexp_replace("file_name", r"\.jpg$", "").alias("image"))
    out = back.join(ids, "image").withColumn("area", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    return rounded(out.select("image_id", "image", "x1", "y1", "x2", "y2", "area"), "x1", "y1", "x2", "y2")


@register("s23_competitor_stats", """
    SELECT CAST(p_partkey AS INT) AS param_id, p_brand AS detector_cfg, p_type AS segmentation_cfg, p_name AS tracker_cfg, p_retailprice AS runtime FROM part""")
def _(spark, sf):
    p = fx.read(spark, sf, "part").select(
        F.col("p_partkey").alias("Unnamed: 0"), F.col("p_brand").alias("detector_cfg"), F.col("p_type").alias("segmentation_cfg"),
        F.col("p_name").alias("tracker_cfg"), F.col("p_retailprice").alias("runtime_total"))
    return tables.normalize_competitor_stats(p, "indexed")


@register("e14_import_competitor", sql(f"""
    SELECT CAST(3 AS BIGINT) AS param_id, video AS video_id, track_id, frame_idx, x1, y1, x2, y2, interpolated FROM ({_INTERP})""", "gt_tracks"))
def _(spark, sf):
    path = new_path(spark, "s10")
    _write_frame_arrays(spark, fx.gt_tracks(spark, sf), path, "3")
    # Spark names part files itself, so parameter set and video are folders here.
    tracks = frames.import_competitor_tracks(spark, path, glob="*", layout=r"param=([^/]+)/video=([^/]+)/")
    return rounded(tracks, "x1", "y1", "x2", "y2")


@register("s10_frame_annotations", sql("""
    SELECT video, frame_idx, row_number() OVER (PARTITION BY video, frame_idx ORDER BY x1, y1, x2, y2, score, track_id) - 1 AS det_id, track_id,
      x1, y1, x2, y2, 'car' AS class, score FROM gt_tracks""", "gt_tracks"))
def _(spark, sf):
    path = new_path(spark, "s10")
    _write_frame_arrays(spark, fx.gt_tracks(spark, sf), path, "0")
    rows = frames.read_frame_annotations(spark, path, glob="*", layout=r"param=([^/]+)/video=([^/]+)/")
    return _long(rows.drop("folder"), "video", "frame_idx", "det_id")


# Suppression runs on what class, size and polygon leave of every fourth frame.
_TRAINSET_ROWS = f"""
    SELECT * FROM crowded_all WHERE frame_idx % 4 = 0 AND det_id % 10 <> 7 AND NOT ({" OR ".join(_inside_sql(x, y) for x in ("x1", "x2") for y in ("y1", "y2"))}
      OR {" OR ".join(f"({px} BETWEEN x1 AND x2 AND {py} BETWEEN y1 AND y2)" for px, py in _POLYGON)})"""
_TRAINSET = """
    SELECT s.split, s.image, d.video, d.frame_idx, d.det_id, x1, y1, x2, y2 FROM crowded d JOIN (
      SELECT video, frame_idx, image, CASE WHEN row_number() OVER (ORDER BY md5('42:' || image), image) - 1 < n - floor(n * 0.2::DOUBLE) THEN 'train' ELSE 'val' END AS split
      FROM (SELECT DISTINCT video, frame_idx, video || '_' || lpad(CAST(frame_idx AS VARCHAR), 8, '0') AS image FROM crowded_all WHERE frame_idx % 4 = 0),
        (SELECT count(DISTINCT (video, frame_idx)) AS n FROM crowded_all WHERE frame_idx % 4 = 0)) s USING (video, frame_idx)
    WHERE NOT EXISTS (SELECT 1 FROM n_lost n WHERE n.video = d.video AND n.frame_idx = d.frame_idx AND n.w = d.det_id)"""


@register("e16_detector_trainset", sql(_TRAINSET, "gt_tracks", crowded_all=fx.CTES["crowded"][1], crowded=_TRAINSET_ROWS, **nms_sql(5)))
def _(spark, sf):
    kind = F.when(F.col("det_id") % 10 == 7, "sign").when(F.col("det_id") % 3 == 0, "truck").otherwise("car")
    marked = fx.crowded_detections(spark, sf).withColumn("class", kind)
    return trainsets.build_detector_trainset(marked, 4, 0.2, classes=["car", "truck"], polygon=_POLYGON, nms_threshold=0.5)


_CANVAS_SET = """
    SELECT 'site0/' || c.video || '/yolo/' || lpad(CAST(c.collage_idx AS VARCHAR), 4, '0') || '.jpg' AS image_path, coalesce(n, 0) AS boxes, round(coalesce(s, 0), 6) AS left_sum
    FROM (SELECT DISTINCT video, collage_idx FROM placements) c LEFT JOIN (
      SELECT video, collage_idx, count(*) AS n, sum(x1) AS s FROM (SELECT video, collage_idx,
        greatest(0, least(1080, x1 + dx)) AS x1, greatest(0, least(2880, y1 + dy)) AS y1, greatest(0, least(1080, x2 + dx)) AS x2, greatest(0, least(2880, y2 + dy)) AS y2
      FROM (SELECT g.*, s.collage_idx, (s.px - s.ox) * 60 AS dx, (s.py - s.oy) * 60 AS dy,
          row_number() OVER (PARTITION BY g.video, s.collage_idx, g.frame_idx, g.track_id ORDER BY s.group_id) AS rn
        FROM gt_tracks g JOIN (SELECT m.row - py + oy AS row, m.col - px + ox AS col, p.* FROM index_map m
          JOIN placements p USING (video, collage_idx, group_id)) s
        ON s.video = g.video AND s.frame_idx = g.frame_idx AND s.row = floor((y1 + y2) / 2 / 60) AS BOOLEAN AND s.col = floor((x1 + x2) / 2 / 60))
      WHERE rn = 1) WHERE x2 > x1 AND y2 > y1 GROUP BY ALL) USING (video, collage_idx)""".replace(" AS BOOLEAN", "")


@register("e17_s25_canvas_trainset", sql(_CANVAS_SET, "index_map"))
def _(spark, sf):
    path = new_path(spark, "s25")
    entries = trainsets.build_canvas_trainset(fx.gt_tracks(spark, sf), fx.placements(spark, sf), fx.index_map(spark, sf), TILE,
                                              WIDTH, HEIGHT * 4, "site0", "yolo")
    tables.write_annotations(entries, path)
    back = tables.read_annotations(spark, path)
    return rounded(back.select("image_path", F.size("annotations").cast("bigint").alias("boxes"), F.aggregate(
        "annotations", F.lit(0.0), lambda acc, a: acc + a["bbox"][0]).alias("left_sum")), "left_sum")
