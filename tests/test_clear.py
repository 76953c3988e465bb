"""Matches that keep to the frame before, against a version that goes frame by frame."""

import random

import pytest

from trackgrid.evaluation import metrics
from trackgrid.operators import matching

PAIRS = "video long, frame_idx long, a long, b long, iou double"


def frame_by_frame(pairs, frames):
    out = []
    for video in sorted({v for v, _ in frames}):
        before = set()
        for f in sorted(f for v, f in frames if v == video):
            here = [(a, b, i) for v, g, a, b, i in pairs if (v, g) == (video, f)]
            used_a, used_b, now = set(), set(), set()
            for a, b, i in sorted(here, key=lambda p: ((p[0], p[1]) not in before, -p[2], p[0], p[1])):
                if a not in used_a and b not in used_b:
                    used_a.add(a)
                    used_b.add(b)
                    now.add((a, b))
                    out.append((video, f, a, b, i))
            before = now
    return sorted(out)


def got(spark, pairs, frames):
    found = matching.match_continued(spark.createDataFrame(pairs, PAIRS), spark.createDataFrame(frames, "video long, frame_idx long"), ["video"], "frame_idx", "a", "b", "iou")
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("size", [3, 16, 1024])
@pytest.mark.parametrize("boxes, share", [(2, 0.9), (4, 0.5), (3, 0.2)])
def test_random_pairs(spark, monkeypatch, size, boxes, share):
    monkeypatch.setattr(matching, "FRAMES_PER_STATE", size)
    draw = random.Random(size * boxes)
    frames = [(v, f) for v in range(3) for f in range(50) if draw.random() < 0.9]
    pairs = [(v, f, a, b, round(draw.random(), 1)) for v, f in frames if f % 11 for a in range(boxes) for b in range(boxes) if draw.random() < share]
    assert got(spark, pairs, frames) == frame_by_frame(pairs, frames)


def test_a_choice_that_lasts_over_all_blocks(spark, monkeypatch):
    # The first frame leaves no choice; from then on the worse pairs hold, since they held before.
    monkeypatch.setattr(matching, "FRAMES_PER_STATE", 4)
    frames = [(0, f) for f in range(30)]
    pairs = [(0, 0, 1, 2, 0.6), (0, 0, 2, 1, 0.6)] + [(0, f, a, b, 0.9 if a == b else 0.6) for f in range(1, 30) for a in (1, 2) for b in (1, 2)]
    result = got(spark, pairs, frames)
    assert result == frame_by_frame(pairs, frames) and all(a != b for _, _, a, b, _ in result)


def test_crossing_objects_keep_their_tracks(spark):
    """Two objects pass each other; where both overlap both tracks, similarity alone would swap them."""
    def box(x):
        return (x, 0.0, x + 100.0, 100.0)

    gt = [(0, f, k, *box(x)) for f in range(11) for k, x in ((1, 4.0 * f), (2, 40.0 - 4.0 * f))]
    # Near the crossing, each track lags behind its object, closer to the other one.
    pred = [(0, f, 10 + k, *box(x + (9.0 if k == 1 else -9.0) * (f == 5 or f == 6))) for _, f, k, x, *_ in gt]
    schema = "video long, frame_idx long, track_id long, x1 double, y1 double, x2 double, y2 double"
    row = metrics.clear_mot(spark.createDataFrame(gt, schema), spark.createDataFrame(pred, schema)).first()
    assert (row.tp, row.fn, row.fp, row.idsw, row.frag, row.mt) == (22, 0, 0, 0, 0, 2)


def test_nothing_to_match(spark):
    assert got(spark, [], []) == [] and got(spark, [], [(0, 1), (0, 2)]) == []
