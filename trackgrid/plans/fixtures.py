"""Detection, track, tile and runtime tables derived from the benchmark tables.

Every table is defined twice, as a DataFrame and as SQL text, from whole tables.
Each order is a moving object whose line items are its observations; 500
consecutive orders share a video, so videos grow in number with the data while
a frame stays as crowded as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackgrid.operators.joins import COLLAGE
from trackgrid.operators.tiles import boxes_to_tiles

TILE, ROWS, COLS = 60, 12, 18
WIDTH, HEIGHT = 1080, 720
#: Frames that share a canvas of the derived placements.
PER_CANVAS = 4


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def gt_tracks(spark: SparkSession, sf: str) -> DataFrame:
    seen = read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"), F.max("l_quantity").alias("qty"))
    o, k = F.col("l_orderkey"), (F.col("l_linenumber") - 1).cast("bigint")
    x, y = (o * 53) % 960 + 7 * k, (o * 29) % 600 + 3 * k
    return seen.select(
        F.floor(o / 500).alias("video"), o.alias("track_id"),
        ((o * 13) % 250 + 2 * k + F.col("l_linenumber") % 2).alias("frame_idx"),
        x.cast("double").alias("x1"), y.cast("double").alias("y1"),
        (x + 40 + o % 60).cast("double").alias("x2"), (y + 30 + o % 50).cast("double").alias("y2"),
        (F.col("qty") / 50).alias("score"), "part", "supp", k.alias("k"))


def pred_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """What a tracker with a confidence cut, jitter and identity switches reports."""
    shift = (F.col("supp") % 5).cast("double")
    return gt_tracks(spark, sf).where("score > 0.1").withColumns({
        "x1": F.col("x1") + shift, "x2": F.col("x2") + shift,
        "track_id": 2 * F.col("track_id") + F.when(F.col("k") >= 3, 1).otherwise(0)})


def detections(spark: SparkSession, sf: str) -> DataFrame:
    """Detections of a frame without identity; ``det_id`` is unique within a frame."""
    return gt_tracks(spark, sf).where("score > 0.1").select(
        "video", "frame_idx", (F.col("track_id") % 500).alias("det_id"), "x1", "y1", "x2", "y2", "score")


def crowded_detections(spark: SparkSession, sf: str) -> DataFrame:
    """Two overlapping reports per object, as merged crops give; scores are distinct per frame."""
    gt = gt_tracks(spark, sf)
    twice = gt.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    s = (F.col("supp") % 5 + 1) * F.col("copy")
    return twice.select(
        "video", "frame_idx", (F.col("track_id") % 500 * 2 + F.col("copy")).alias("det_id"),
        (F.col("x1") + s * 4).alias("x1"), "y1", (F.col("x2") + s * 4).alias("x2"), "y2",
        (F.col("score") * F.when(F.col("copy") == 0, 1.0).otherwise(0.9)).alias("score"))


def tile_scores(spark: SparkSession, sf: str) -> DataFrame:
    # Boxes are dealt by frame before they become tiles: fewer rows move, and steps on whole frames need not move them again.
    boxes = detections(spark, sf).select("video", "frame_idx", "x1", "y1", "x2", "y2").repartition("video", "frame_idx")
    tiles = boxes_to_tiles(boxes, TILE, ROWS, COLS).select("video", "frame_idx", "row", "col").distinct()
    return tiles.withColumn("score", (F.col("row") * 31 + F.col("col") * 17 + F.col("frame_idx") * 7) % 256)


def true_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles of all annotated boxes, fully relevant."""
    return boxes_to_tiles(gt_tracks(spark, sf), TILE, ROWS, COLS).select(
        "video", "frame_idx", "row", "col").distinct().withColumn("score", F.lit(255).cast("bigint"))


def placements(spark: SparkSession, sf: str) -> DataFrame:
    """Every detection's tile rectangle placed on a canvas that stacks four frames."""
    d = detections(spark, sf)
    slot = F.col("frame_idx") % PER_CANVAS

    def tile(c: str):
        return F.floor(F.col(c) / TILE)

    r0, c0 = F.least(tile("y1"), F.lit(ROWS - 1)), F.least(tile("x1"), F.lit(COLS - 1))
    return d.select(
        "video", F.floor(F.col("frame_idx") / PER_CANVAS).alias("collage_idx"),
        (F.col("det_id") * PER_CANVAS + slot + 1).alias("group_id"), "frame_idx",
        (r0 + ROWS * slot).alias("py"), c0.alias("px"), r0.alias("oy"), c0.alias("ox"),
        (F.least(tile("y2"), F.lit(ROWS - 1)) - r0 + 1).alias("h"),
        (F.least(tile("x2"), F.lit(COLS - 1)) - c0 + 1).alias("w"))


def index_map(spark: SparkSession, sf: str) -> DataFrame:
    from trackgrid.operators.packing import crop_index

    return crop_index(placements(spark, sf)).groupBy(*COLLAGE, "row", "col").agg(F.min("group_id").alias("group_id"))


def canvas_detections(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes a detector reports on canvases: annotated boxes with jitter, some off their tiles."""
    gt = gt_tracks(spark, sf)
    dy = (F.col("frame_idx") % PER_CANVAS) * (ROWS * TILE)
    dx = (F.col("part") % 3) * 150.0
    return gt.select(
        "video", F.floor(F.col("frame_idx") / PER_CANVAS).alias("collage_idx"),
        (F.col("track_id") * PER_CANVAS + F.col("frame_idx") % PER_CANVAS).alias("det_id"),
        (F.col("x1") + dx).alias("x1"), (F.col("y1") + dy).alias("y1"),
        (F.col("x2") + dx).alias("x2"), (F.col("y2") + dy).alias("y2"))


def runtimes(spark: SparkSession, sf: str) -> DataFrame:
    """Stage timings (ms as logged -> seconds) from the event stream."""
    ops = F.element_at(F.array(*[F.lit(o) for o in ("decode", "read", "infer", "save_collage", "track")]),
                       (F.col("user_id") % 5 + 1).cast("int"))
    stage = F.create_map(*[F.lit(v) for pair in STAGES.items() for v in pair])[F.col("event_type")]
    return read(spark, sf, "events").select(
        stage.alias("stage"), ops.alias("op"), F.concat(F.lit("video"), F.expr("user_id div 10")).alias("video"),
        F.concat(F.lit("cfg"), F.col("user_id") % 3).alias("config"), (F.col("value") / 1000).alias("time"))


STAGES = {"signup": "020_exec_classify", "error": "022_exec_prune", "view": "030_exec_compress",
          "click": "040_exec_detect", "purchase": "060_exec_track"}


def variants(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    return read(spark, sf, "part").select(
        F.col("p_brand").alias("dataset"), p.alias("_p"),
        F.when(F.col("p_size") == 1, "naive").otherwise("system").alias("variant"),
        F.concat(F.lit("v"), F.floor(p / 2).cast("string")).alias("variant_id"),
        F.when(p % 2 == 0, "valid").otherwise("test").alias("videoset"),
        F.when(F.col("p_size") > 1, F.col("p_type")).alias("classifier"),
        F.when(F.col("p_size") > 1, F.col("p_size") % 2 * 30 + 30).cast("bigint").alias("tilesize"),
        F.when(F.col("p_size") > 1, F.pow(F.lit(2.0), F.col("p_size") % 5)).cast("bigint").alias("sample_rate"),
        F.when((F.col("p_size") > 1) & (F.col("p_size") % 4 > 0), (F.col("p_size") % 4 + 1) * 20 / 100.0).alias(
            "tracking_accuracy_threshold"),
        F.when(F.col("p_size") > 1, F.substring_index("p_name", " ", 1)).alias("tilepadding"),
        F.when(F.col("p_size") > 1, F.lit(1.0)).alias("canvas_scale"),
        F.when(F.col("p_size") > 1, F.when(F.col("p_size") % 3 == 0, "sort").otherwise("bytetrack")).alias("tracker"),
        (((p * 37) % 1000) / 1000.0).alias("HOTA_HOTA"))


def variant_runtimes(spark: SparkSession, sf: str) -> DataFrame:
    """Operation timings of every variant on every video it ran on: one row per line item."""
    li = read(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("_p"), F.concat(F.lit("te"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("video"),
        F.col("l_returnflag").alias("stage"), F.col("l_linestatus").alias("op"),
        (F.col("l_quantity") / 100).alias("time"))
    return li.join(variants(spark, sf), "_p").drop("_p", "HOTA_HOTA")


def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return variants(spark, sf).drop("_p")


def video_frames(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "supplier").select(
        F.concat(F.lit("te"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("video"),
        (F.col("s_suppkey") % 90 + 10).alias("frame_count"))


# --- the same tables as SQL ------------------------------------------------

_STAGE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STAGES.items()) + " END"

CTES: dict[str, tuple[list[str], str]] = {
    "gt_tracks": ([], """
        SELECT CAST(floor(o / 500) AS BIGINT) AS video, o AS track_id,
          CAST((o * 13) % 250 + 2 * k + (k + 1) % 2 AS BIGINT) AS frame_idx,
          CAST((o * 53) % 960 + 7 * k AS DOUBLE) AS x1, CAST((o * 29) % 600 + 3 * k AS DOUBLE) AS y1,
          CAST((o * 53) % 960 + 7 * k + 40 + o % 60 AS DOUBLE) AS x2,
          CAST((o * 29) % 600 + 3 * k + 30 + o % 50 AS DOUBLE) AS y2,
          qty / 50 AS score, part, supp, k
        FROM (SELECT l_orderkey AS o, CAST(l_linenumber - 1 AS BIGINT) AS k, min(l_partkey) AS part,
                min(l_suppkey) AS supp, max(l_quantity) AS qty
              FROM lineitem GROUP BY l_orderkey, l_linenumber)"""),
    "pred_tracks": (["gt_tracks"], """
        SELECT video, 2 * track_id + CASE WHEN k >= 3 THEN 1 ELSE 0 END AS track_id, frame_idx,
          x1 + supp % 5 AS x1, y1, x2 + supp % 5 AS x2, y2, score, part, supp, k
        FROM gt_tracks WHERE score > 0.1"""),
    "detections": (["gt_tracks"], """
        SELECT video, frame_idx, track_id % 500 AS det_id, x1, y1, x2, y2, score FROM gt_tracks WHERE score > 0.1"""),
    "crowded": (["gt_tracks"], """
        SELECT video, frame_idx, track_id % 500 * 2 + c AS det_id, x1 + (supp % 5 + 1) * c * 4 AS x1, y1,
          x2 + (supp % 5 + 1) * c * 4 AS x2, y2, score * CASE WHEN c = 0 THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS score
        FROM gt_tracks, (VALUES (0), (1)) AS t(c)"""),
    "grid_rows": ([], "SELECT CAST(range AS BIGINT) AS row FROM range(12)"),
    "grid_cols": ([], "SELECT CAST(range AS BIGINT) AS col FROM range(18)"),
    "det_tiles": (["detections", "grid_rows", "grid_cols"], """
        SELECT d.*, row, col FROM detections d
        JOIN grid_rows ON row BETWEEN floor(trunc(y1) / 60) AND floor(trunc(y2) / 60)
        JOIN grid_cols ON col BETWEEN floor(trunc(x1) / 60) AND floor(trunc(x2) / 60)"""),
    "gt_tiles": (["gt_tracks", "grid_rows", "grid_cols"], """
        SELECT d.*, row, col FROM gt_tracks d
        JOIN grid_rows ON row BETWEEN floor(trunc(y1) / 60) AND floor(trunc(y2) / 60)
        JOIN grid_cols ON col BETWEEN floor(trunc(x1) / 60) AND floor(trunc(x2) / 60)"""),
    "tile_scores": (["det_tiles"], """
        SELECT DISTINCT video, frame_idx, row, col, (row * 31 + col * 17 + frame_idx * 7) % 256 AS score FROM det_tiles"""),
    "true_tiles": (["gt_tiles"], "SELECT DISTINCT video, frame_idx, row, col, CAST(255 AS BIGINT) AS score FROM gt_tiles"),
    "placements": (["detections"], """
        SELECT video, collage_idx, group_id, frame_idx, oy + 12 * slot AS py, ox AS px, oy, ox,
          r1 - oy + 1 AS h, c1 - ox + 1 AS w
        FROM (SELECT video, CAST(floor(frame_idx / 4) AS BIGINT) AS collage_idx, frame_idx, frame_idx % 4 AS slot,
          det_id * 4 + frame_idx % 4 + 1 AS group_id,
          least(CAST(floor(y1 / 60) AS BIGINT), 11) AS oy, least(CAST(floor(x1 / 60) AS BIGINT), 17) AS ox,
          least(CAST(floor(y2 / 60) AS BIGINT), 11) AS r1, least(CAST(floor(x2 / 60) AS BIGINT), 17) AS c1
          FROM detections)"""),
    "index_map": (["placements"], """
        SELECT video, collage_idx, row, col, min(group_id) AS group_id
        FROM placements
        JOIN (SELECT CAST(range AS BIGINT) AS row FROM range(48)) ON row BETWEEN py AND py + h - 1
        JOIN (SELECT CAST(range AS BIGINT) AS col FROM range(18)) ON col BETWEEN px AND px + w - 1
        GROUP BY ALL"""),
    "canvas_detections": (["gt_tracks"], """
        SELECT video, CAST(floor(frame_idx / 4) AS BIGINT) AS collage_idx, track_id * 4 + frame_idx % 4 AS det_id,
          x1 + part % 3 * 150 AS x1, y1 + frame_idx % 4 * 720 AS y1,
          x2 + part % 3 * 150 AS x2, y2 + frame_idx % 4 * 720 AS y2 FROM gt_tracks"""),
    "runtimes": ([], f"""
        SELECT {_STAGE_SQL} AS stage,
          list_extract(['decode', 'read', 'infer', 'save_collage', 'track'], CAST(user_id % 5 + 1 AS INT)) AS op,
          'video' || (user_id // 10) AS video, 'cfg' || (user_id % 3) AS config, value / 1000 AS time FROM events"""),
    "variants": ([], """
        SELECT p_brand AS dataset, p_partkey AS _p,
          CASE WHEN p_size = 1 THEN 'naive' ELSE 'system' END AS variant,
          'v' || CAST(floor(p_partkey / 2) AS BIGINT) AS variant_id,
          CASE WHEN p_partkey % 2 = 0 THEN 'valid' ELSE 'test' END AS videoset,
          CASE WHEN p_size > 1 THEN p_type END AS classifier,
          CASE WHEN p_size > 1 THEN CAST(p_size % 2 * 30 + 30 AS BIGINT) END AS tilesize,
          CASE WHEN p_size > 1 THEN CAST(pow(2, p_size % 5) AS BIGINT) END AS sample_rate,
          CASE WHEN p_size > 1 AND p_size % 4 > 0 THEN (p_size % 4 + 1) * 20 / 100.0::DOUBLE END AS tracking_accuracy_threshold,
          CASE WHEN p_size > 1 THEN split_part(p_name, ' ', 1) END AS tilepadding,
          CASE WHEN p_size > 1 THEN 1.0::DOUBLE END AS canvas_scale,
          CASE WHEN p_size > 1 THEN CASE WHEN p_size % 3 = 0 THEN 'sort' ELSE 'bytetrack' END END AS tracker,
          ((p_partkey * 37) % 1000) / 1000.0::DOUBLE AS HOTA_HOTA FROM part"""),
    "accuracy": (["variants"], "SELECT * EXCLUDE (_p) FROM variants"),
    "variant_runtimes": (["variants"], """
        SELECT 'te' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS video, l_returnflag AS stage, l_linestatus AS op,
          l_quantity / 100 AS time, v.* EXCLUDE (_p, HOTA_HOTA) FROM lineitem JOIN variants v ON l_partkey = _p"""),
    "video_frames": ([], """
        SELECT 'te' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS video, s_suppkey % 90 + 10 AS frame_count FROM supplier"""),
}


def sql(body: str, *names: str, recursive: bool = False, **extra: str) -> str:
    """``body`` with the named tables, and what they need, as common table expressions."""
    ordered: list[str] = []

    def need(name: str) -> None:
        if name in ordered:
            return
        for parent in CTES[name][0]:
            need(parent)
        ordered.append(name)

    for n in names:
        need(n)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in ordered]
    parts += [f"{n} AS MATERIALIZED ({text})" if not n.startswith("rec_") else f"{n} AS ({text})"
              for n, text in extra.items()]
    head = "WITH RECURSIVE " if recursive else "WITH "
    if body.lstrip().startswith("WITH"):
        body = f"SELECT * FROM ({body})"
    return head + ",\n".join(parts) + "\n" + body if parts else body
