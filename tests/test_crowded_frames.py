"""Matching and suppression read frames as a stream: frames that span batches, and one frame that holds most rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trackgrid.operators import matching

BATCHES = [1, 7, 10_000]


@pytest.fixture(params=BATCHES)
def batched(spark, request):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield spark
    spark.conf.set(name, before)


def _candidates(seed):
    """Frames of 0 to 40 pairs and one with a third of all; NULL videos, string ids, equal weights."""
    rng = random.Random(seed)
    pairs = {}
    for video in ("a", "b", None):
        for frame in range(6):
            for _ in range(rng.randint(0, 40)):
                pairs[video, frame, f"l{rng.randint(0, 9)}", rng.randint(0, 9)] = rng.randint(0, 5) / 4
    for _ in range(len(pairs) // 2):
        pairs["b", 3, f"l{rng.randint(0, 30)}", rng.randint(0, 30)] = rng.randint(0, 5) / 4
    return [(*k, w) for k, w in pairs.items()]


@pytest.mark.parametrize("seed", range(2))
def test_matches_do_not_depend_on_batches(batched, seed):
    pairs = _candidates(seed)
    df = batched.createDataFrame(pairs, "video string, frame_idx int, l string, r bigint, w double")
    got = matching.match_in_frames(df, ["video"], "frame_idx", ["l"], ["r"], [F.col("w")])
    assert got.schema == df.schema
    used, expected = set(), set()
    for p in sorted(pairs, key=lambda p: (-p[4], p[2], p[3])):
        ends = {(p[0], p[1], "l", p[2]), (p[0], p[1], "r", p[3])}
        if not ends & used:
            used |= ends
            expected.add(p)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(expected) and set(rows) == expected


def _overlap(a, b):
    w = min(a[5], b[5]) - max(a[3], b[3]) + 1
    h = min(a[6], b[6]) - max(a[4], b[4]) + 1
    inner = max(w, 0) * max(h, 0)
    size = [(r[5] - r[3] + 1) * (r[6] - r[4] + 1) for r in (a, b)]
    return inner / (sum(size) - inner)


def test_suppression_does_not_depend_on_batches(batched):
    rng, boxes = random.Random(3), []
    for frame in range(8):
        for k in range(150 if frame == 5 else rng.randint(0, 25)):
            x, y = rng.randint(0, 60), rng.randint(0, 60)
            boxes.append((1, frame, k, float(x), float(y), float(x + rng.randint(10, 30)), float(y + rng.randint(10, 30)), rng.randint(0, 6) / 6))
    df = batched.createDataFrame(boxes, "video bigint, frame_idx bigint, det_id bigint, x1 double, y1 double, x2 double, y2 double, score double")
    kept = defaultdict(list)
    for b in sorted(boxes, key=lambda b: (-b[7], -b[2])):
        if all(_overlap(b, k) < 0.4 for k in kept[b[1]]):
            kept[b[1]].append(b)
    got = sorted(tuple(r) for r in matching.nms(df, 0.4).collect())
    assert got == sorted(b for rows in kept.values() for b in rows)


def test_copies_of_one_box(spark):
    """Many copies of one box have a pair for every two of them; one match per box is left."""
    n = 300
    side = spark.createDataFrame([(0, 1, k, 10.0, 10.0, 50.0, 50.0) for k in range(n)],
                                 "video bigint, frame_idx bigint, track_id bigint, x1 double, y1 double, x2 double, y2 double")
    got = {(r.l_track_id, r.r_track_id) for r in matching.match_boxes(side, side, 0.5).collect()}
    assert got == {(k, k) for k in range(n)}


def test_no_pairs(spark):
    none = spark.createDataFrame([], "video string, frame_idx int, l string, r bigint, w double")
    assert matching.match_in_frames(none, ["video"], "frame_idx", ["l"], ["r"], [F.col("w")]).count() == 0
