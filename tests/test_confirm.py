"""Confirmation of tracks in a stream."""

import random

import numpy as np
import pandas as pd

from trackgrid.streaming import events


def test_tracks_are_confirmed_over_batches_with_state_in_the_rows(spark, tmp_path):
    """Three hits in two parts, a gap that starts the count anew, and too few hits; state is not asked for by single calls."""
    path, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "video long, track_id long, ts timestamp"

    def arrive(rows):
        spark.createDataFrame(rows, "video long, track_id long, s long").selectExpr(
            "video", "track_id", "timestamp_seconds(1700000000 + s) AS ts").write.mode("append").parquet(path)
        stream = events.confirm_tracks(events.stream_detections(spark, path, schema), 3, 10_000)
        assert "FlatMapGroupsInPandasWithState" in stream._jdf.queryExecution().logical().toString()
        events.run_to_table(stream, out, state).awaitTermination()

    arrive([(1, 1, 0), (1, 1, 5), (1, 2, 0), (1, 2, 20), (1, 3, 1)])
    arrive([(1, 1, 9), (1, 2, 25), (1, 4, 21), (1, 4, 22), (1, 4, 23)])
    arrive([(1, 2, 30), (1, 1, 31)])
    rows = spark.read.parquet(out).selectExpr("track_id", "unix_seconds(confirmed_at) - 1700000000 AS s").collect()
    assert sorted(map(tuple, rows)) == [(1, 9), (2, 30), (4, 23)]


def plain(seen, last, times, min_hits, max_age):
    """One track's hits one after the other: count, latest hit, and when it had enough."""
    at = None
    for ms in sorted(times):
        if last >= 0 and ms - last > max_age:
            seen = 0
        seen, last = seen + 1, max(last, ms)
        if seen == min_hits:
            at = ms
    return seen, last, at


def test_the_tracks_of_a_group_are_counted_together():
    """Every track used to be a call of its own."""
    random.seed(3)
    held, state = np.zeros((5, 0), "int64"), {}
    for step in range(12):
        rows = [(random.choice([1, 2, 2 ** 60 + 1]), random.randrange(4), random.randrange(2), step * 300 + random.randrange(-200, 900)) for _ in range(random.choice([1, 5, 40]))]
        batch = pd.DataFrame(rows, columns=["video", "track_id", "nulls", "ms"])
        held, found = events._count_hits(held, batch.assign(ts=batch["ms"].astype("datetime64[ms]")), 3, 250)
        want = []
        for key in sorted({r[:3] for r in rows}):
            *state[key], at = plain(*state.get(key, (0, -1)), [r[3] for r in rows if r[:3] == key], 3, 250)
            want += [(key, at)] if at is not None else []
        assert {tuple(t[:3]): (t[3], t[4]) for t in held.T.tolist()} == {k: tuple(v) for k, v in state.items()}
        got = [(None if pd.isna(r.video) else int(r.video), None if pd.isna(r.track_id) else int(r.track_id), r.confirmed_at) for r in found.itertuples()]
        assert sorted(got, key=str) == sorted(((None if k[2] & 1 else k[0], None if k[2] & 2 else k[1], pd.Timestamp(at, unit="ms")) for k, at in want), key=str)


def test_ids_that_are_null_or_large_stay_tracks(spark, tmp_path):
    path = f"{tmp_path}/in"
    ids = [(None, 1), (None, None), (0, 0), (2 ** 60 + 1, 2), (2 ** 60, 2)]
    spark.createDataFrame([(v, t, s) for v, t in ids for s in range(4)], "video long, track_id long, s long").selectExpr(
        "video", "track_id", "timestamp_seconds(1700000000 + s) AS ts").write.parquet(path)
    stream = events.confirm_tracks(events.stream_detections(spark, path, "video long, track_id long, ts timestamp"), 3, 10_000)
    assert stream._jdf.queryExecution().logical().toString().count("_group") > 0
    events.run_to_table(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").selectExpr("video", "track_id", "unix_seconds(confirmed_at) - 1700000000 AS s").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((v, t, 2) for v, t in ids), key=str)


def test_what_stays_away_leaves_the_state(spark, tmp_path):
    path, schema = f"{tmp_path}/in", "video long, track_id long, ts timestamp"
    sizes = []
    for s in (0, 100, 300, 301):
        spark.createDataFrame([(1, s * 10 + i, s) for i in range(2)] + [(1, 1, s)], "video long, track_id long, s long").selectExpr(
            "video", "track_id", "timestamp_seconds(1700000000 + s) AS ts").write.mode("append").parquet(path)
        query = events.run_to_table(events.confirm_tracks(events.stream_detections(spark, path, schema), 3, 10_000), f"{tmp_path}/out", f"{tmp_path}/state")
        query.awaitTermination()
        sizes.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    assert sizes[-1] <= 5 < 9
    assert spark.read.schema(schema).parquet(f"{tmp_path}/out").count() == 0
