"""Rate grids against a plain sweep, with tracks that go on in another block of frames."""

from itertools import product

from trackgrid.evaluation import rates
from trackgrid.operators import matching


def plain(boxes, matched, choices):
    cell = {(f, t): (y > 50) * 2 + (x > 50) for f, t, x, y in boxes}
    out = {}
    for grid in product(choices, repeat=4):
        runs = {}
        for f, c in {(f, c) for (f, _), c in cell.items()}:
            runs.setdefault((c, f // (grid[c] + 1)), []).append(f)
        kept = {(f, c) for (c, _), fs in runs.items() for f in (min(fs), max(fs))}
        good = bad = 0
        for t in {t for _, t in cell}:
            seen = [(f, matched.get((f, t))) for f in sorted(f for (f, u), c in cell.items() if u == t and (f, c) in kept)]
            for i, (_, p) in enumerate(seen):
                near = [seen[j][1] for j in (i - 1, i + 1) if 0 <= j < len(seen)]
                ok = p is not None and all(n == p for n in near)
                good, bad = good + ok, bad + (not ok)
        out["grid_" + "-".join(map(str, grid))] = (len(kept), good, bad)
    return out


def test_grids_agree_with_a_plain_sweep_and_rows_are_dealt_before_they_are_multiplied(spark, monkeypatch):
    boxes = [(f, t, (f * 7 + t * 31) % 100, 20 if t < 3 else (f // 5 * 60 + 20) % 100) for t in range(5) for f in range(65536 - 9 * (t % 2) - 9, 65536 + 8 * (t % 3)) if (f + t) % 4]
    matched = {(f, t): t + 10 * (f % 9 > 4) for f, t, _, _ in boxes if (f * t) % 5 != 1}
    gt = spark.createDataFrame([(1, f, t, x - 2.0, y - 2.0, x + 2.0, y + 2.0) for f, t, x, y in boxes],
                               "video long, frame_idx long, track_id long, x1 double, y1 double, x2 double, y2 double")
    matches = spark.createDataFrame([(1, f, t, p) for (f, t), p in matched.items()], "video long, frame_idx long, l_track_id long, r_track_id long")
    cells = rates.center_cell(gt, 100, 100, 2, 2).select("video", "frame_idx", "row", "col").distinct()
    plans, keep = {}, rates.materialize
    monkeypatch.setattr(rates, "materialize", lambda df, tag: (plans.update({tag: df._jdf.queryExecution().optimizedPlan().toString()}), keep(df, tag))[1])
    got = rates.evaluate_rate_grids(gt, matches, cells, [1, 4], 100, 100, 2, 2).collect()
    cell = {(f, t): (y >= 50, x >= 50) for f, t, x, y in boxes}
    assert {r.variant_id: (r.retained, r.correct, r.incorrect) for r in got} == plain([(f, t, 99 * c[1], 99 * c[0]) for (f, t), c in cell.items()], matched, [1, 4])
    # Read from the top, a plan names the assignments (_i) before it deals the rows by their track's block.
    assert plans["subs"].index("explode(sequence") < plans["subs"].index("RepartitionByExpression [video")


def test_pairs_leave_boxes_behind(spark, rows):
    df = spark.createDataFrame([(1, 0, i, 10.0 * i, 0.0, 10.0 * i + 9, 9.0, "x" * 50) for i in range(6)],
                               "video long, frame_idx long, track_id long, x1 double, y1 double, x2 double, y2 double, more string")
    out = matching.match_ids(df, df, 0.3)
    assert out.columns == ["video", "frame_idx", "l_track_id", "r_track_id", "iou"]
    assert rows(out) == rows(matching.match_boxes(df, df, 0.3), *out.columns)
