"""Many small groups in one call: groups stay whole and apart."""

import pytest
from pyspark.sql import functions as F

from trackgrid.operators import grouping, packing, tiles
from trackgrid.scale import in_whole_groups


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows", [3, 7, 1000])
def test_groups_stay_whole_whatever_the_batches(spark, rows):
    """Groups of one row, of several batches, and of a NULL key; calls get whole groups only."""
    data = [(k, i) for k, n in ((1, 1), (2, 20), (3, 1), (4, 7)) for i in range(n)] + [(None, 0), (None, 1)]
    df = spark.createDataFrame(data, "k int, i int")

    def count(batch):
        out = batch.groupby("k", dropna=False).size().reset_index(name="n")
        return out.astype({"k": "Int64"})

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = sorted(map(tuple, in_whole_groups(df, ["k"], count, "k int, n bigint").collect()), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == sorted([(1, 1), (2, 20), (3, 1), (4, 7), (None, 2)], key=str)


def test_frames_and_batches_are_not_one_call_each(spark):
    """A call for every group costs more than its work when groups are small."""
    scored = spark.createDataFrame([(v, f, r, 1) for v in range(3) for f in range(200) for r in (0, 1, 5)], "video long, frame_idx long, row long, col long")
    grouped = grouping.group_tiles(scored, "none", 12, 18)
    sized = grouping.group_summary(grouped).select("video", "frame_idx", "group_id", "size")
    packed = packing.pack_fit(sized.withColumn("batch", F.floor(F.col("frame_idx") / 16)), 3, ["video", "batch"], "first")
    for df in (grouped, packed):
        assert "FlatMapGroupsInPandas" not in plan(df)
    assert {tuple(r) for r in grouped.select("group_id", "size", "oy", "ox", "row").distinct().collect()} == {(0, 2, 0, 1, 0), (0, 2, 0, 1, 1), (1, 1, 5, 1, 5)}
    assert {r.n for r in packed.groupBy("video", "batch", "slot").agg(F.sum("size").alias("n")).collect()} == {3}


def exchanges(df):
    return plan(df).count("Exchange")


def test_a_frame_is_one_row_of_bits_when_it_is_dealt(spark):
    """Padding and labelling work on whole frames: one shuffle, with no row per tile and nothing to sort."""
    tiles_ = [(None, 0, 0, 0), (1, 0, -1, 2), (1, 0, 3, 3), (1, 0, 3, 3), (1, 1, 0, 0), (1, 1, 0, 4), (1, 2, None, 1), (1, 2, 9, 9)]
    df = spark.createDataFrame(tiles_, "video long, frame_idx long, row long, col long")
    grouped = grouping.group_tiles(df, "plus", 4, 5)
    assert exchanges(grouped) == 1 and "Sort" not in plan(grouped)
    padded = tiles.pad_tiles(df, "plus", 4, 5)
    key = ("video", "frame_idx", "row", "col", "kind")
    assert sorted(map(tuple, grouped.select(*key).collect()), key=str) == sorted(map(tuple, padded.select(*key).collect()), key=str)
    assert grouped.dtypes == [*padded.dtypes, *[(c, "bigint") for c in ("group_id", "size", "oy", "ox")]]
    # a tile just outside the grid still pads into it
    assert grouped.where("video = 1 AND frame_idx = 0 AND row = 0 AND col = 2").count() == 1
