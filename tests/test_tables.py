import json
import os
import random

import pytest
from pyspark.sql import functions as F

from trackgrid.functions import naming
from trackgrid.operators import aggregates as agg
from trackgrid.operators import filters, joins
from trackgrid.plans import reports
from trackgrid.sources import frames, labels, tables


def test_tradeoff_table(spark):
    schema = ("dataset string, videoset string, variant string, variant_id string, classifier string, tilesize int, sample_rate int, "
              "tracking_accuracy_threshold double, tilepadding string, canvas_scale double, tracker string")
    sys_ = ("demo", "test", "system", "cfg_a", "net", 60, 2, None, "none", 1.0, "bytetrack")
    naive = ("demo", "test", "naive", "naive", None, None, None, None, None, None, None)
    acc = spark.createDataFrame([(*sys_, 0.8), (*naive, 0.7)], schema + ", HOTA_HOTA double")
    run = spark.createDataFrame([(*sys_, "te01.mp4", t) for t in (1.0, 2.0)] + [(*sys_, "te02.mp4", 4.0)]
                                + [(*naive, "te01.mp4", t) for t in (0.5, 1.0)] + [(*naive, "te02.mp4", 3.0)],
                                schema + ", video string, time double")
    count = spark.createDataFrame([("te01.mp4", 100), ("te02.mp4", 50)], "video string, frame_count int")
    got = {r.variant_id: r for r in reports.tradeoff_table(acc, run, count).collect()}
    assert (got["cfg_a"].time, got["cfg_a"].frame_count, got["cfg_a"].throughput_fps) == (7.0, 150, 150 / 7.0)
    assert (got["naive"].time, got["naive"].throughput_fps, got["naive"].classifier) == (4.5, 150 / 4.5, None)
    assert got["cfg_a"].classifier == "net" and got["naive"].HOTA_HOTA == 0.7


@pytest.mark.parametrize("text, expected", [
    ("net05_60_2_plus_s100_bytetrack", ("net05", 60, 2, None, "plus", 1.0, "bytetrack")),
    ("net05_60_4_070_square_s100_ocsort", ("net05", 60, 4, 0.7, "square", 1.0, "ocsort")),
    ("net05_60_2_070_ocsort", ("net05", 60, 2, 0.7, None, None, "ocsort")),
    ("net05_60", ("net05", 60, None, None, None, None, None)),
    ("net05_60_8", ("net05", 60, 8, None, None, None, None)),
])
def test_param_str_round_trip(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    parsed = df.select(*[c.alias(n) for n, c in naming.parse_param_str(F.col("t")).items()])
    assert tuple(parsed.first()) == expected
    back = parsed.select(naming.param_str(*[F.col(c) for c in parsed.columns])).first()[0]
    assert back == text


def test_names(spark):
    one = spark.range(1)
    def value(c):
        return one.select(c).first()[0]
    assert value(naming.dataset_for_videoset(F.lit("site1-y05"), F.lit("valid"))) == "site1-y05-val"
    assert value(naming.base_dataset(F.lit("site1-y05-val"))) == "site1-y05"
    assert value(naming.name_videoset(F.lit("site1-y05"))) == "test"
    assert [value(naming.threshold_slug(F.lit(v))) for v in (30.0, 32.5, 100.0)] == ["030", "032p5", "100"]
    grid = F.array(*[F.lit(v) for v in (1, 2, 4)])
    assert value(naming.encode_rate_grid(grid)) == "1-2-4"
    assert value(naming.decode_rate_grid(F.lit("1-2-4"))) == [1, 2, 4]
    assert value(naming.grid_variant_id(F.lit("m"), grid, F.lit(32.5))) == "m_t032p5_1-2-4"


def test_runtime_logs(spark, tmp_path):
    folder = tmp_path / "te01"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join([
        json.dumps({"runtime": [{"op": "pack", "time": 1500}, {"op": "save_collage", "time": 9}, {"op": "save_canvas", "time": 9}], "n": 1}),
        json.dumps({"runtime": [{"op": "pack", "time": 500}]})]))
    got = [tuple(r) for r in frames.read_runtime(spark, str(folder), "030_exec_compress").collect()]
    assert sorted(got) == [("te01", "030_exec_compress", "pack", 0.5), ("te01", "030_exec_compress", "pack", 1.5)]
    other = tmp_path / "te02"
    other.mkdir()
    (other / "b.json").write_text(json.dumps([{"op": "infer", "time": 10}, {"op": "read_frame", "time": 5}]))
    assert [(r.op, r.time) for r in frames.read_runtime(spark, str(other), "040_exec_detect").collect()] == [("infer", 0.01)]
    last = tmp_path / "te03"
    last.mkdir()
    (last / "c.jsonl").write_text(json.dumps([4, [[1, 2, 3, 4, 0.5]], [{"op": "detect", "time": 20}]]))
    assert [(r.op, r.time) for r in frames.read_runtime(spark, str(last), "011_tune_detect").collect()] == [("detect", 0.02)]
    dets = frames.read_index_detections(spark, str(last)).collect()
    assert [(r.video, r.frame_idx, r.det_id, r.x2, r.score) for r in dets] == [("te03", 4, 0, 3.0, 0.5)]


def test_tracks_file_later_line_wins(spark, tmp_path):
    folder = tmp_path / "v1"
    folder.mkdir()
    (folder / "tracking.jsonl").write_text("\n".join([
        '{"frame_idx": 0, "tracks": [[1, 0, 0, 1, 1]]}', '{"frame_idx": 1, "tracks": [[1, 0, 0, 2, 2, 3, 0.5]]}',
        '{"frame_idx": 0, "tracks": [[7, 0, 0, 9, 9], [8, 1, 1, 2, 2]]}']))
    got = frames.read_tracks(spark, str(folder)).orderBy("frame_idx", "track_id").collect()
    assert [(r.video, r.frame_idx, r.track_id, r["class"], r.confidence) for r in got] == [
        ("v1", 0, 7, 0, 1.0), ("v1", 0, 8, 0, 1.0), ("v1", 1, 1, 3, 0.5)]


def test_list_videos(spark, tmp_path, rows):
    folder = tmp_path / "site1" / "test"
    folder.mkdir(parents=True)
    for name in ("te02.avi", "notes.txt", "te01.mp4", "preview.png"):
        (folder / name).write_text("x")
    assert rows(tables.list_videos(spark, str(tmp_path))) == [("site1", "test", "te01.mp4"), ("site1", "test", "te02.avi")]


def test_manifest_grid(spark):
    videos = spark.createDataFrame([("d", "test", "v1"), ("d", "test", "v2")], "dataset string, videoset string, video string")
    grid = joins.cross_join_manifest(videos, classifier=["n"], tilesize=[60], tracking_accuracy_threshold=[None, 0.4], tracker=["sort"])
    assert grid.count() == 2 * (2 + 1)
    assert {r.variant_id for r in grid.collect()} == {"naive", "n_60_sort", "n_60_040_sort"}
    assert joins.rate_grids(spark.range(1), [1, 2, 4], 9).select("grid_key").distinct().count() == 3**9


def test_competitor_stats(spark):
    a = spark.createDataFrame([(1, "d", "s", "t", 3.5), (0, "d", "s", "t", 2.5)],
                              "`Unnamed: 0` int, detector_cfg string, segmentation_cfg string, tracker_cfg string, runtime_total double")
    got = {r.param_id: r.runtime for r in tables.normalize_competitor_stats(a, "indexed").collect()}
    assert got == {0: 2.5, 1: 3.5}
    with pytest.raises(Exception, match="not unique"):
        tables.normalize_competitor_stats(a.union(a), "indexed").collect()
    b = spark.createDataFrame([("v", 1.0, 1.0), ("total", 9.0, 2.0)], "video_name string, inference_total double, decode double")
    assert [(r.param_id, r.runtime, r.detector_cfg) for r in tables.normalize_competitor_stats(b, "total").collect()] == [(0, 7.0, None)]


def test_competitor_tracks(spark, tmp_path, rows):
    folder = tmp_path / "3"
    folder.mkdir()
    obj = {"track_id": 5, "left": 0, "top": 0, "right": 10, "bottom": 10}
    far = {"track_id": 5, "left": 20, "top": 0, "right": 30, "bottom": 10}
    (folder / "12.json").write_text(json.dumps([[obj], None, [far]]))
    got = frames.import_competitor_tracks(spark, str(tmp_path)).collect()
    assert sorted((r.param_id, r.video_id, r.track_id, r.frame_idx, r.x1) for r in got) == [
        (3, 12, 5, 0, 0.0), (3, 12, 5, 1, 10.0), (3, 12, 5, 2, 20.0)]
    (folder / "13.json").write_text(json.dumps([[{**obj, "track_id": None}]]))
    with pytest.raises(Exception, match="required fields"):
        frames.import_competitor_tracks(spark, str(tmp_path)).collect()


def test_frame_annotations_across_splits(spark, tmp_path):
    """A file cut into many splits numbers its frames like one read whole."""
    rng = random.Random(2)
    doc = []
    for f in range(400):
        n = rng.randint(0, 3)
        doc.append(None if rng.random() < 0.2 else [
            {"left": f, "top": 0, "right": f + 1, "bottom": 1, "class": None if i else "car", "score": 0.5, "track_id": i} for i in range(n)])
    folder = tmp_path / "set"
    folder.mkdir()
    (folder / "v.json").write_text(json.dumps(doc, indent=1))
    (folder / "empty.json").write_text("[]")
    (folder / "null.json").write_text("null")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = sorted((r.video, r.folder, r.frame_idx, r.track_id, r.x1) for r in frames.read_frame_annotations(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted(("v", "set", f, d["track_id"], float(f)) for f, ds in enumerate(doc) for d in ds or [])


MASK = """<annotations><image id="0" name="a.jpg" width="1280" height="720">
<box label="other" xtl="0" ytl="0" xbr="5" ybr="5"></box><box label="crop" xtl="1.5" ytl="2" xbr="3" ybr="4"></box>
<polygon label="domain" points="0,0;10,0;10,10;0,10"></polygon></image></annotations>"""


def test_masks_drive_filters(spark, tmp_path):
    (tmp_path / "m.xml").write_text(MASK)
    rect, polygons = tables.mask_of(tables.read_masks(spark, str(tmp_path / "m.xml")))
    assert rect == (1.5, 2.0, 3.0, 4.0) and polygons == [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]]
    boxes = spark.createDataFrame([(5.0, 5.0, 7.0, 7.0), (20.0, 20.0, 30.0, 30.0), (-5.0, -5.0, 15.0, 15.0)],
                                  "x1 double, y1 double, x2 double, y2 double")
    assert [r.x1 for r in filters.exclude_polygon(boxes, polygons[0]).collect()] == [20.0]


def test_training_logs(spark, tmp_path):
    folder = tmp_path / "v1" / "training" / "results" / "net_small_60"
    folder.mkdir(parents=True)
    (folder / "train_losses.json").write_text(json.dumps([{"loss": 1.0, "time": 3.0}, {"loss": 0.5, "time": 4.0}]))
    (folder / "test_losses.json").write_text(json.dumps([{"loss": 0.9, "accuracy": 0.6, "time": 1.0}, {"loss": 0.8, "accuracy": 0.5, "time": 1.0}]))
    (folder / "throughput_per_epoch.jsonl").write_text(
        json.dumps([{"op": "train_step", "time": 2.0}, {"op": "test_inference", "time": 1.0}]) + "\n" + json.dumps([{"op": "train_step", "time": 4.0}]))
    runs, means = agg.training_summary(*tables.read_training_logs(spark, str(tmp_path)))
    r = runs.first()
    assert (r.classifier, r.tilesize, r.num_epochs, r.best_val_loss, r.best_val_accuracy) == ("net_small", 60, 2, 0.8, 0.6)
    assert (r.total_train_time, r.total_val_time, r.avg_train_step_time, r.avg_inference_time) == (7.0, 2.0, 3.0, 1.0)
    assert means.first().num_epochs == 2.0


def test_fps_and_gaps(spark):
    df = spark.createDataFrame([(15.0,), (30.0,), (59.9,)], "fps double")
    assert [r[0] for r in df.select(filters.fps_step(F.col("fps"))).collect()] == [1, 2, 4]
    with pytest.raises(Exception, match="unsupported frame rate"):
        spark.createDataFrame([(24.0,)], "fps double").select(filters.fps_step(F.col("fps"))).collect()
    gaps = spark.createDataFrame([([],), ([1.0],), ([0.5, 1.0],), ([0.5, 0.5, 1.0],), ([0.5, 0.5, 0.5],)], "t array<double>")
    assert [r[0] for r in gaps.select(agg.max_gap(F.col("t"))).collect()] == [1, 1, 1, 2, 4]


def test_splits_are_exact(spark):
    videos = spark.range(1000).select(F.col("id").cast("string").alias("video"))
    got = {r.split: r["count"] for r in filters.split_videos(videos, 500, 300, 150, seed=3).groupBy("split").count().collect()}
    assert got == {"train": 500, "valid": 300, "test": 150}
    marks = {r.split: r["count"] for r in filters.split_frames(videos, "video", 0.2).groupBy("split").count().collect()}
    assert marks == {"train": 800, "val": 200}


def test_linspace(spark):
    df = spark.createDataFrame([("a", 10), ("b", 1)], "video string, n int")
    got = filters.linspace_frames(df, "n", 15.0, 6.0).collect()
    assert sorted(r.frame_idx for r in got if r.video == "a") == [0, 3, 6, 9]
    assert [r.frame_idx for r in got if r.video == "b"] == [0]


def test_label_formats(spark, tmp_path, rows):
    boxes = spark.createDataFrame([("train", "i1", 200, 100, 10.0, 20.0, 30.0, 60.0), ("val", "i2", 200, 100, 0.0, 0.0, 200.0, 100.0)],
                                  "split string, image string, image_width int, image_height int, x1 double, y1 double, x2 double, y2 double")
    labels.to_yolo_labels(boxes, str(tmp_path / "y"))
    back = labels.read_labels(spark, str(tmp_path / "y"), "yolo", 200, 100)
    assert rows(back.select("image", "class", *[F.round(c, 3) for c in ("x1", "y1", "x2", "y2")])) == [
        ("i1", "car", 10.0, 20.0, 30.0, 60.0), ("i2", "car", 0.0, 0.0, 200.0, 100.0)]
    doc = {"images": [{"id": 1, "file_name": "i1.jpg", "width": 200, "height": 100}],
           "annotations": [{"id": 1, "image_id": 1, "category_id": 2, "bbox": [1, 2, 3, 4], "area": 12}], "categories": [{"id": 1, "name": "car"}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    assert rows(labels.read_labels(spark, str(tmp_path / "c.json"), "coco_document")) == [("i1", "class_2", 1.0, 2.0, 4.0, 6.0)]
    labels.to_darknet_labels(boxes, str(tmp_path / "d"), (400, 200))
    assert sorted(os.listdir(tmp_path / "d")) == ["labels", "lists", "names"]


def test_numbering_is_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = labels.numbered(df, ["k"], "n").orderBy("k").collect()
    assert [(r.k, r.n) for r in got] == [(i, i + 1) for i in range(1000)]
