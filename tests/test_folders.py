"""Files per folder, and encoded grids."""

import glob

import pytest
from pyspark.sql import functions as F

from trackgrid.sources import frames, labels


def boxes(spark, videos=6, n=40):
    return spark.range(videos * n).select(
        (F.col("id") % videos).alias("video"), F.floor(F.col("id") / videos).alias("frame_idx"), F.col("id").alias("track_id"),
        F.col("id").alias("det_id"), F.lit(1.0).alias("x1"), F.lit(2.0).alias("y1"), F.lit(30.0).alias("x2"), F.lit(40.0).alias("y2"),
        F.lit(0.9).alias("score")).repartition(8)


@pytest.mark.parametrize("write", ["detections", "index", "cvat", "scores"])
def test_a_video_gets_one_file_and_not_one_of_every_task(spark, tmp_path, write):
    path, df = str(tmp_path / "out"), boxes(spark)
    if write == "detections":
        frames.write_detections(df, path)
    elif write == "index":
        frames.write_index_detections(df, path)
    elif write == "cvat":
        labels.to_cvat(df, path)
    else:
        frames.write_tile_scores(df.selectExpr("video", "frame_idx", "0L AS row", "1L AS col", "200L AS score"), path, 2, 2)
    assert len(glob.glob(f"{path}/video=*/part-*")) == 6


def test_encoded_grid_keeps_order_and_gaps(spark):
    rows = [(1, 0, 0, 1, 10), (1, 0, 1, 2, 255), (1, 1, 0, 0, 0), (1, 2, 1, 2, 1), (1, 3, 9, 9, 7)]
    got = frames.encode_tile_scores(spark.createDataFrame(rows, "video long, frame_idx long, row long, col long, score long"), 2, 3)
    assert {r.idx: r.classification_hex for r in got.collect()} == {0: "000a000000ff", 1: "000000000000", 2: "000000000001", 3: "000000000000"}


def test_grids_of_variants_stay_where_their_frames_lie(spark, rows):
    """Variants used to be dealt twice more, by tile and by frame, as names that hold the video's."""
    made = [(v, 1, f, r, 1, (r * 100 + f) % 256) for v in ("a", "b") for f in range(3) for r in range(2)] + [("a", None, 0, 0, 0, 9), ("b", 2, 0, 0, 0, None)]
    df = spark.createDataFrame(made, "variant_id string, video long, frame_idx long, row long, col long, score long")
    got = frames.encode_tile_scores(df.repartition("video", "frame_idx"), 2, 3, ["variant_id"])
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    want = [(v, *r) for v in ("a", "b") for r in rows(frames.encode_tile_scores(df.where(F.col("variant_id") == v), 2, 3), "video", "idx", "classification_hex")]
    assert rows(got, "variant_id", "video", "idx", "classification_hex") == sorted(want, key=repr)


def test_pruned_scores_are_the_same_rows_from_packed_files(spark, tmp_path, rows, monkeypatch):
    import __spark_entry__ as entry
    from trackgrid.plans import exports, fixtures

    spark.range(600).selectExpr("id div 4 * 3 AS l_orderkey", "CAST(id % 4 + 1 AS INT) AS l_linenumber", "id % 5 AS l_partkey", "id % 7 AS l_suppkey",
                                "CAST(id % 50 + 1 AS DOUBLE) AS l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(exports, "new_path", lambda spark, tag: f"{tmp_path}/{tag}")
    got = rows(entry.queries()["s05_read_pruned_scores"](spark, str(tmp_path)), "video", "frame_idx", "row", "col", "score")
    tiles = fixtures.tile_scores(spark, str(tmp_path))
    assert got == rows(tiles.where("score >= 128"), "video", "frame_idx", "row", "col", "score")
    other = frames.read_tile_scores(spark, f"{tmp_path}/s05", variant_id="yolo_60_060").where("score > 0").selectExpr("CAST(video AS LONG) video", "CAST(frame_idx AS LONG) frame_idx", "CAST(row AS LONG) row", "col", "CAST(score AS LONG) score")
    assert rows(other) == rows(tiles.where("score >= 64"), "video", "frame_idx", "row", "col", "score")
    assert glob.glob(f"{tmp_path}/s05/variant_id=*/video=*/*.json.gz")
