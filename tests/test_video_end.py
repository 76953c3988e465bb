"""The end of a video: repeated markers, late rows, idle videos, restarts and replayed batches."""

import glob
import shutil

from pyspark.sql import functions as F

from trackgrid.streaming import events

SCHEMA = "video long, frame_idx long, is_end boolean"


def test_life_of_videos(spark, tmp_path):
    places = {name: f"{tmp_path}/{name}" for name in ("pending", "sink", "finished", "late")}
    seen = []

    def count(rows):
        seen.append(1)
        return rows.groupBy("video").agg(F.count("*").alias("n"), F.max("frame_idx").alias("last"))

    def arrive(*rows, max_idle=None):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = events.stream_detections(spark, f"{tmp_path}/in", "video long, frame_idx long, is_end boolean")
        events.on_video_end(stream, count, checkpoint=f"{tmp_path}/state", max_idle=max_idle, **places).awaitTermination()

    def table(name, *columns):
        return sorted(tuple(r) for r in spark.read.schema("video long, frame_idx long, n long, last long, batch long").parquet(places[name]).select(*columns).collect())

    end = (None, True)
    arrive((1, 0, False), (1, 1, False), (2, 0, False), (3, 5, False))
    assert table("sink", "video") == [] and table("pending", "video") == [(1,), (1,), (2,), (3,)]
    arrive((1, 2, False), (1, *end), (2, 1, False))
    assert table("sink", "video", "n", "last") == [(1, 3, 2)]
    # A second marker does nothing, a row after the end is late; the finished video has left.
    arrive((1, *end), (1, 9, False), (2, *end))
    assert table("sink", "video", "n", "last") == [(1, 3, 2), (2, 2, 1)]
    assert table("late", "video", "frame_idx") == [(1, 9)]
    assert {v for v, in table("pending", "video")} == {2, 3}
    # A batch whose commit was lost is replayed and leaves the same result.
    for path in glob.glob(f"{tmp_path}/state/commits/*2*") + glob.glob(f"{tmp_path}/state/commits/.2*"):
        shutil.move(path, f"{tmp_path}/lost-{path.rsplit('/', 1)[1]}")
    arrive((4, 0, False))
    assert table("sink", "video", "n", "last") == [(1, 3, 2), (2, 2, 1)]
    assert table("late", "video", "frame_idx") == [(1, 9)]
    # Without a marker a video ends when no row of it came for so many batches.
    arrive((4, 1, False), max_idle=3)
    assert table("sink", "video", "n", "last") == [(1, 3, 2), (2, 2, 1), (3, 1, 5)]
    arrive((4, *end), (3, 6, False))
    assert table("sink", "video", "n") == [(1, 3), (2, 2), (3, 1), (4, 2)]
    assert table("late", "video", "frame_idx") == [(1, 9), (3, 6)]
    assert table("finished", "video") == [(1,), (2,), (3,), (4,)]


def test_a_pending_video_is_one_file_of_a_batch_and_leaves_whatever_its_name(spark, tmp_path):
    """Every task used to write a file for every video, and folders were looked up by names as patterns."""
    places = {name: f"{tmp_path}/{name}" for name in ("pending", "sink", "finished", "late")}
    names = ["a", "b*", "c:d", "e=f/g", None]

    def arrive(rows):
        spark.createDataFrame(rows, "video string, frame_idx long, is_end boolean").repartition(4).write.mode("append").parquet(f"{tmp_path}/in")
        stream = events.stream_detections(spark, f"{tmp_path}/in", "video string, frame_idx long, is_end boolean")
        events.on_video_end(stream, lambda df: df.groupBy("video").agg(F.count("*").alias("n")), checkpoint=f"{tmp_path}/state", **places).awaitTermination()

    arrive([(v, f, False) for v in names for f in range(40)])
    assert len(glob.glob(f"{tmp_path}/pending/batch=0/video=*/part-*")) == len(glob.glob(f"{tmp_path}/pending/batch=0/video=*")) == 5
    arrive([(v, None, True) for v in names if v != "a"])
    arrive([("a", 40, False)])
    assert {r.video: r.n for r in spark.read.schema("video string, n long").parquet(places["sink"]).collect()} == {"b*": 40, "c:d": 40, "e=f/g": 40}
    left = sorted(p.rsplit("/", 2)[1:] for p in glob.glob(f"{tmp_path}/pending/batch=*/video=*"))
    assert left == [["batch=0", "video=__HIVE_DEFAULT_PARTITION__"], ["batch=0", "video=a"], ["batch=2", "video=a"]]
