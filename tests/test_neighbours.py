"""Adjacent rows of a key across blocks."""

from pyspark.sql import functions as F

from trackgrid.scale import with_neighbours


def test_neighbours_share_one_shuffle_of_the_table(spark):
    """The window and the join of the borders: the wide rows are sent once."""
    df = spark.createDataFrame([(1, 0, "a"), (1, 3, "b"), (1, 70000, "c"), (None, 1, "d"), (None, 70000, "e"), (2, 5, "f")], "k int, at long, v string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = with_neighbours(df, ["k"], "at", ["v"], backward="prev")
        text = out._jdf.queryExecution().executedPlan().toString()
        got = {(r.k, r.at): (r.prev_v, r.next_v) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert text.count("Exchange") <= 4
    assert got == {(1, 0): (None, "b"), (1, 3): ("a", "c"), (1, 70000): ("b", None), (None, 1): (None, "e"), (None, 70000): ("d", None), (2, 5): (None, None)}


def test_association_steps_are_written_and_pairs_leave_their_boxes_behind(spark, monkeypatch):
    """One plan used to hold the shuffles of all steps on the disks at once."""
    from trackgrid.evaluation import rates

    written, keep = [], rates.materialize
    monkeypatch.setattr(rates, "materialize", lambda df, tag: (written.append(df.columns), keep(df, tag))[1])
    gt = spark.createDataFrame([(1, f, t, 50.0 * t, 0.0, 50.0 * t + 40, 40.0) for f in range(8) for t in range(3)],
                               "video long, frame_idx long, track_id long, x1 double, y1 double, x2 double, y2 double")
    sampled = gt.withColumn("rate", F.explode(F.array(*[F.lit(r).cast("bigint") for r in (1, 2)])))
    out = {(r.rate, r.row, r.col): (r.correct, r.incorrect) for r in rates.assoc_counts(gt, sampled, [1, 2], 60, 2, 3).collect()}
    assert out[1, 0, 0] == (16, 0) and out[2, 0, 2] == (4, 0)
    assert len(written) == 5 and not any(c.endswith("x1") for c in written[2]) and "iou" in written[2]
