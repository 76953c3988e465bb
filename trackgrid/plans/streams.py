"""Registered streaming queries: the derived tables replayed through Structured Streaming."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from trackgrid.operators import linking, tiles
from trackgrid.plans import fixtures as fx
from trackgrid.plans.catalog import register, rounded
from trackgrid.plans.fixtures import COLS, ROWS, TILE, sql
from trackgrid.plans.tracking import link_sql
from trackgrid.scale import new_path
from trackgrid.streaming import events


#: Parts in which a table arrives; the stream stops after each and goes on from its checkpoint.
PARTS = 6
#: Parts that have not arrived yet, by stream.
_COMING: dict[str, list] = {}


def _parts(df, time=None):
    """The table in parts, in order of ``time`` or dealt by hash."""
    if time is None:
        place = F.pmod(F.xxhash64(*df.columns), F.lit(PARTS))
        return [df.where(place == k) for k in range(PARTS)]
    at = F.col(time).cast("double")
    cuts = df.agg(F.percentile_approx(at, [k / PARTS for k in range(1, PARTS)], 10000)).first()[0]
    if cuts is None:
        return [df]
    return [df.where((at > low if low is not None else F.lit(True)) & (at <= high if high is not None else F.lit(True))) for low, high in zip([None, *cuts], [*cuts, None])]


def _replay(df, tag, time=None):
    """A file stream of a derived table that arrives in parts."""
    path = new_path(df.sparkSession, tag)
    first, *more = _parts(df, time)
    first.write.parquet(path)
    _COMING[tag] = [lambda part=part: part.write.mode("append").parquet(path) for part in more]
    return events.stream_detections(df.sparkSession, path, df.schema)


def _drain(stream, tag, mode="append"):
    """Run a stream over what has arrived, part after part with a restart between them, and read what it wrote."""
    spark = stream.sparkSession
    out, state = new_path(spark, f"{tag}-out"), new_path(spark, f"{tag}-state")
    events.run_to_table(stream, out, state, mode).awaitTermination()
    for arrive in _COMING.pop(tag):
        arrive()
        events.run_to_table(stream, out, state, mode).awaitTermination()
    schema = stream.schema if mode == "append" else StructType([*stream.schema.fields, StructField("epoch", IntegerType())])
    return spark.read.schema(schema).parquet(out)


@register("t01_stream_detections", sql("SELECT video, count(*) AS n FROM detections GROUP BY ALL", "detections"))
def _(spark, sf):
    return _drain(_replay(fx.detections(spark, sf), "t01", "frame_idx"), "t01").groupBy("video").agg(F.count("*").alias("n"))


@register("t02_stream_tiles", sql("SELECT video, row, col, count(*) AS n FROM det_tiles WHERE score > 0.5 GROUP BY ALL", "det_tiles"))
def _(spark, sf):
    stream = _replay(fx.detections(spark, sf), "t02", "frame_idx").where("score > 0.5")
    return _drain(tiles.boxes_to_tiles(stream, TILE, ROWS, COLS), "t02").groupBy("video", "row", "col").agg(F.count("*").alias("n"))


def _events(spark, sf):
    return fx.read(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "event_id")


def _plain(df):
    """Window bounds without a time zone, as the source table has them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


#: A closing row far in the future moves the watermark past every real window.
def _closed(df):
    last = df.groupBy().agg(F.max("ts").alias("m"))
    end = last.select(*[(F.col("m") + F.expr("INTERVAL 400 DAYS")).alias("ts") if c == "ts" else F.lit(None).cast(t).alias(c)
                        for c, t in df.dtypes])
    return df.unionByName(end)


@register("t03_frame_counts", """
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS end, event_type, count(*) AS objects
    FROM events GROUP BY ALL""")
def _(spark, sf):
    stream = _replay(_closed(_events(spark, sf)), "t03", "ts")
    return _plain(_drain(events.frame_counts(stream, "1 hour", late="60 days", by=["event_type"]), "t03").where("event_type IS NOT NULL"))


@register("t03_sliding_counts", """
    SELECT s AS start, s + INTERVAL 2 HOUR AS end, count(*) AS objects FROM (
      SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL (i) HOUR AS s FROM events, (VALUES (0), (1)) v(i)) GROUP BY ALL""")
def _(spark, sf):
    stream = _replay(_closed(_events(spark, sf)), "t03s", "ts")
    out = _drain(events.frame_counts(stream, "2 hours", "1 hour", late="60 days", by=["event_type"]), "t03s")
    # The row that closes the stream has no type.
    return _plain(out.where("event_type IS NOT NULL").groupBy("start", "end").agg(F.sum("objects").alias("objects")))


@register("t04_track_sessions", """
    WITH e AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
      SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events))
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS end, count(*) AS hits FROM e GROUP BY user_id, s""")
def _(spark, sf):
    stream = _replay(_closed(_events(spark, sf)), "t04", "ts")
    return _plain(_drain(events.track_sessions(stream, "12 hours", ["user_id"], late="60 days"), "t04").where("user_id IS NOT NULL"))


@register("t05_confirm_tracks", sql("SELECT video, track_id FROM gt_tracks GROUP BY ALL HAVING count(*) >= 3", "gt_tracks"))
def _(spark, sf):
    rows = fx.gt_tracks(spark, sf).select("video", "track_id", "frame_idx")
    stream = _replay(events.with_event_time(rows, "2024-01-01 00:00:00", 15.0), "t05", "ts")
    return _drain(events.confirm_tracks(stream, 3, 3_600_000), "t05").select("video", "track_id")


@register("t06_drop_replayed", "SELECT user_id, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY ALL")
def _(spark, sf):
    e = _events(spark, sf)
    stream = _replay(e.unionByName(e), "t06", "ts")
    out = _drain(events.drop_replayed(stream, ["event_id"], "60 days"), "t06")
    return rounded(out.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("value")), "value")


@register("t02_stream_active_boxes", sql("""
    SELECT g.video, count(*) AS n FROM (SELECT video, frame_idx, CAST(floor((y1 + y2) / 2 / 60) AS BIGINT) AS row, CAST(floor((x1 + x2) / 2 / 60) AS BIGINT) AS col
      FROM detections  ) g WHERE EXISTS (SELECT 1 FROM tile_scores t WHERE t.score >= 128 AND t.video = g.video AND t.frame_idx = g.frame_idx
        AND t.row = g.row AND t.col = g.col) GROUP BY ALL""", "tile_scores"))
def _(spark, sf):
    """A stream filtered against a table: the boxes whose centre tile is relevant."""
    stream = _replay(fx.detections(spark, sf), "t02a", "frame_idx")
    active = fx.tile_scores(spark, sf).where("score >= 128")
    centred = stream.withColumns({"row": F.floor((F.col("y1") + F.col("y2")) / 2 / TILE), "col": F.floor((F.col("x1") + F.col("x2")) / 2 / TILE)})
    kept = centred.join(active, ["video", "frame_idx", "row", "col"], "left_semi")
    return _drain(kept, "t02a").groupBy("video").agg(F.count("*").alias("n"))


@register("t07_t09_video_end", sql("SELECT video, frame_idx, det_id, track_id FROM rec_chain", "detections", recursive=True, **link_sql(20)))
def _(spark, sf):
    """Videos arrive frame by frame, each with its end; those that ended are linked while others are still coming."""
    dets = fx.detections(spark, sf).withColumn("is_end", F.lit(False))
    # Two of three videos come whole with the first parts, and every end comes twice.
    turn = F.pmod(F.col("video"), F.lit(3)) * 2
    late = F.floor(F.pmod(F.col("frame_idx"), F.lit(2)))
    ends = dets.select("video").distinct().select("video", *[
        (F.lit(True) if c == "is_end" else F.lit(None).cast(t)).alias(c) for c, t in dets.dtypes if c != "video"])
    parts = [dets.where((turn + late) == k).unionByName(ends.where((turn + 1).isin(k, k - 1))) for k in range(PARTS + 1)]
    path, state = new_path(spark, "t07"), new_path(spark, "t07-state")
    places = {name: new_path(spark, f"t07-{name}") for name in ("pending", "sink", "finished", "late")}

    def whole_video(rows):
        return linking.link_tracks(rows).select("video", "frame_idx", "det_id", "track_id")

    for part in parts:
        part.write.mode("append").parquet(path)
        stream = events.stream_detections(spark, path, dets.schema)
        events.on_video_end(stream, whole_video, checkpoint=state, **places).awaitTermination()
    return spark.read.schema("video BIGINT, frame_idx BIGINT, det_id BIGINT, track_id BIGINT").parquet(places["sink"]).select(
        "video", "frame_idx", "det_id", "track_id")


@register("t08_runtime_totals", sql("SELECT stage, op, round(sum(time), 6) AS time, count(*) AS count FROM runtimes GROUP BY ALL", "runtimes"))
def _(spark, sf):
    out = _drain(events.runtime_totals(_replay(fx.runtimes(spark, sf), "t08")), "t08", "update")
    newest = out.groupBy("stage", "op").agg(F.max_by(F.struct("time", "count"), "epoch").alias("_n"))
    return rounded(newest.select("stage", "op", "_n.*"), "time")
