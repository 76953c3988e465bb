import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackgrid.evaluation import metrics, rates
from trackgrid.functions import geometry as g
from trackgrid.operators import filters, grouping, joins, linking, matching, packing, pruning, tiles, trajectories
from trackgrid.registry import tracker
from trackgrid.scale import with_neighbours

BOXES = "video bigint, frame_idx bigint, track_id bigint, x1 double, y1 double, x2 double, y2 double"


def iou(a, b, plus=0.0):
    w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]) + plus)
    h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]) + plus)
    size = [(c[2] - c[0] + plus) * (c[3] - c[1] + plus) for c in (a, b)]
    return w * h / (sum(size) - w * h)


def random_boxes(rng, frames, per_frame, size=40, area=120):
    out = []
    for f in range(frames):
        for t in range(rng.randint(1, per_frame)):
            x, y = rng.randint(0, area), rng.randint(0, area)
            out.append((0, f, t, float(x), float(y), float(x + rng.randint(5, size)), float(y + rng.randint(5, size))))
    return out


# --- cells and tiles -------------------------------------------------------

def test_cells_of_boxes_by_sampling_points(spark):
    """A box lies in the cells of the points strictly inside it and the frame, its centre in one of them."""
    rng = random.Random(23)
    width, height, nr, nc = 640, 350, 5, 4
    boxes = []
    for t in range(40):
        x, y = rng.randrange(-90, 700), rng.randrange(-90, 400)
        boxes.append((4, 9, t, float(x), float(y), float(x + rng.randrange(1, 300)), float(y + rng.randrange(1, 200))))
    df = spark.createDataFrame(boxes, BOXES)
    cells, middle = {}, {}
    for r in tiles.boxes_to_cells(df, width, height, nr, nc).collect():
        cells.setdefault(r.track_id, set()).add((r.row, r.col))
    for r in tiles.center_cell(df, width, height, nr, nc).collect():
        middle[r.track_id] = (r.row, r.col)
    for _, _, t, x1, y1, x2, y2 in boxes:
        xs = [v + 0.5 for v in range(int(max(0, x1)), int(min(width, x2)))]
        ys = [v + 0.5 for v in range(int(max(0, y1)), int(min(height, y2)))]
        expected = {(int(y * nr / height), int(x * nc / width)) for y in ys for x in xs}
        assert cells.get(t, set()) == expected
        assert (middle[t] in expected) if expected else (middle[t] == (None, None))


def brute_groups(cells, mode, rows, cols):
    """Flood fill over an explicit link set."""
    kind = {}
    for r, c in cells:
        for dr, dc in tiles.PADDING[mode]:
            if 0 <= r + dr < rows and 0 <= c + dc < cols:
                kind.setdefault((r + dr, c + dc), 2)
    kind.update({cell: 1 for cell in cells})
    links = set()
    for (r, c), k in kind.items():
        for dr, dc in tiles.ORTHOGONAL:
            if (r + dr, c + dc) in kind and 1 in (k, kind[(r + dr, c + dc)]):
                links.add(((r, c), (r + dr, c + dc)))
        for dr, dc in tiles.DIAGONAL[mode]:
            if k == 1 and (r + dr, c + dc) in kind:
                links |= {((r, c), (r + dr, c + dc)), ((r + dr, c + dc), (r, c))}
    near = {}
    for a, b in links:
        near.setdefault(a, []).append(b)
    groups, left = [], set(kind)
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            cell = todo.pop()
            seen.add(cell)
            todo += [n for n in near.get(cell, []) if n not in seen]
        groups.append(frozenset(seen))
        left -= seen
    return kind, set(groups), links


@pytest.mark.parametrize("mode", list(tiles.PADDING))
def test_group_tiles_matches_flood_fill(spark, mode):
    rng, cases = random.Random(42), {}
    for f, density in itertools.product(range(2), (0.1, 0.3, 0.5)):
        frame = f * 100 + int(density * 10)
        cases[frame] = {(r, c) for r in range(9) for c in range(11) if rng.random() < density}
    df = spark.createDataFrame([(0, f, r, c) for f, cells in cases.items() for r, c in cells],
                               "video bigint, frame_idx bigint, row bigint, col bigint")
    got = {}
    for r in grouping.group_tiles(df, mode, 9, 11).collect():
        got.setdefault(r.frame_idx, {}).setdefault(r.group_id, []).append(r)
    padded = tiles.pad_tiles(df, mode, 9, 11)
    edges = {(r.frame_idx, (r.src_row, r.src_col), (r.dst_row, r.dst_col)) for r in tiles.tile_adjacency(padded, mode).collect()}
    for frame, cells in cases.items():
        kind, groups, links = brute_groups(cells, mode, 9, 11)
        mine = got[frame]
        assert {frozenset((r.row, r.col) for r in rs) for rs in mine.values()} == groups
        assert {(r.row, r.col): r.kind for rs in mine.values() for r in rs} == kind
        assert {(a, b) for f, a, b in edges if f == frame} == links
        sizes = [len(mine[i]) for i in range(len(mine))]
        assert sizes == sorted(sizes, reverse=True)
        for rs in mine.values():
            assert all((r.size, r.oy, r.ox) == (len(rs), min(x.row for x in rs), min(x.col for x in rs)) for r in rs)


def test_packing_never_overflows(spark):
    rng = random.Random(1)
    data = [(0, f, gid, rng.choice([1, 2, 3, 9, 20, 60, 99])) for f in range(20) for gid in range(6)]
    df = spark.createDataFrame(data, "video bigint, frame_idx bigint, group_id bigint, size bigint")
    packed = packing.pack_groups(df, 100, ["video"])
    assert packed.count() == len(data)
    fill = packed.groupBy("video", "size_class", "slot").agg(F.sum("size").alias("s")).collect()
    assert max(r.s for r in fill) <= 100
    assert len(fill) >= packing.canvas_bound(df, 100, ["video"]).first().min_canvases


# --- matching and suppression ----------------------------------------------

def greedy(pairs):
    used_l, used_r, out = set(), set(), set()
    for s, l, r in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        if l not in used_l and r not in used_r:
            used_l.add(l), used_r.add(r), out.add((l, r))
    return out


def best_total(pairs):
    """Largest total similarity over all one-to-one subsets."""
    pairs = [p for p in pairs]
    def go(i, used_l, used_r):
        if i == len(pairs):
            return 0.0
        s, l, r = pairs[i]
        skip = go(i + 1, used_l, used_r)
        return skip if l in used_l or r in used_r else max(skip, s + go(i + 1, used_l | {l}, used_r | {r}))
    return go(0, frozenset(), frozenset())


def test_matching_is_greedy_and_near_optimal(spark):
    rng = random.Random(7)
    left, right = random_boxes(rng, 12, 5), random_boxes(rng, 12, 5)
    ldf, rdf = spark.createDataFrame(left, BOXES), spark.createDataFrame(right, BOXES)
    got = {}
    for r in matching.match_boxes(ldf, rdf, 0.05).collect():
        got.setdefault(r.frame_idx, set()).add((r.l_track_id, r.r_track_id))
    total, best = 0.0, 0.0
    for f in range(12):
        pairs = [(iou(a[3:], b[3:]), a[2], b[2]) for a in left for b in right if a[1] == b[1] == f and iou(a[3:], b[3:]) >= 0.05]
        assert got.get(f, set()) == greedy(pairs)
        total += sum(s for s, l, r in pairs if (l, r) in got.get(f, set()))
        best += best_total(pairs)
    assert total >= 0.9 * best


def test_matching_without_candidates(spark):
    left = spark.createDataFrame([(0, 0, 1, 0.0, 0.0, 1.0, 1.0)], BOXES)
    right = spark.createDataFrame([(0, 0, 1, 5.0, 5.0, 6.0, 6.0)], BOXES)
    assert matching.match_boxes(left, right, 0.3).count() == 0


def test_overlap_pairs_cross_grid_cells(spark, rows):
    rng = random.Random(3)
    a, b = random_boxes(rng, 4, 8, 300, 900), random_boxes(rng, 4, 8, 300, 900)
    got = rows(joins.iou_join(spark.createDataFrame(a, BOXES), spark.createDataFrame(b, BOXES), cell=64), "frame_idx", "l_track_id", "r_track_id")
    assert got == sorted(((x[1], x[2], y[2]) for x in a for y in b if x[1] == y[1] and iou(x[3:], y[3:]) > 0), key=repr)


def test_nms_matches_sequential(spark):
    rng = random.Random(11)
    boxes = [(v, f, t, x1, y1, x2, y2, round(rng.random(), 3)) for v, f, t, x1, y1, x2, y2 in random_boxes(rng, 10, 12, 60, 90)]
    df = spark.createDataFrame(boxes, "video bigint, frame_idx bigint, det_id bigint, x1 double, y1 double, x2 double, y2 double, score double")
    got = {(r.frame_idx, r.det_id) for r in matching.nms(df, 0.3).collect()}
    expected = set()
    for f in range(10):
        todo = sorted((b for b in boxes if b[1] == f), key=lambda b: (b[7], b[2]))
        while todo:
            top = todo.pop()
            expected.add((f, top[2]))
            todo = [b for b in todo if iou(top[3:7], b[3:7], 1.0) < 0.3]
    assert got == expected


# --- ordered operators -----------------------------------------------------

def test_neighbours_across_blocks(spark):
    frames = [0, 3, 9, 10, 11, 40, 41, 90]
    df = spark.createDataFrame([("k", f) for f in frames] + [("j", 5)], "k string, f bigint")
    got = {(r.k, r.f): (r.next_f, r.prev_f) for r in with_neighbours(df, ["k"], "f", ["f"], backward="prev", block=10).collect()}
    for i, f in enumerate(frames):
        assert got[("k", f)] == (frames[i + 1] if i + 1 < len(frames) else None, frames[i - 1] if i else None)
    assert got[("j", 5)] == (None, None)


def test_interpolation_leaves_observations(spark):
    df = spark.createDataFrame([(0, 0, 1, 0.0, 0.0, 10.0, 10.0), (0, 4, 1, 8.0, 4.0, 18.0, 14.0)], BOXES)
    got = sorted((r.frame_idx, r.x1, r.y1, r.interpolated) for r in trajectories.interpolate_tracks(df).collect())
    assert got == [(0, 0.0, 0.0, False), (1, 2.0, 1.0, True), (2, 4.0, 2.0, True), (3, 6.0, 3.0, True), (4, 8.0, 4.0, False)]


def walk(frame, step, bound, gid, sid, seen_g, seen_s, pairs):
    f = frame + step
    while (f - bound) * step <= 0:
        a, b = (f, gid) in seen_g, (f, sid) in seen_s
        if a != b:
            return False
        if a and b:
            return (f, gid, sid) in pairs
        f += step
    return True


@pytest.mark.parametrize("rate", [1, 2, 4])
def test_consistency_matches_a_walk(spark, rate):
    rng = random.Random(rate)
    gt, pred = [], []
    for t in range(6):
        for f in range(40):
            if rng.random() < 0.7:
                box = (30.0 * t + f % 3, 10.0, 30.0 * t + 25, 40.0)
                gt.append((0, f, t, *box))
                if rng.random() < 0.8:
                    pred.append((0, f, 10 * t + (f > 20 and t % 2), *box))
    tables = [trajectories.at_rates(spark.createDataFrame(d, BOXES), [rate]) for d in (gt, pred)]
    got = {(r.frame_idx, r.l_track_id, r.r_track_id): r.correct for r in rates.consistent_matches(*tables).collect()}
    seen_g, seen_s = {(r[1], r[2]) for r in gt}, {(r[1], r[2]) for r in pred}
    pairs = set(got)
    for (f, gid, sid), ok in got.items():
        ends = [fr for fr, t in seen_g if t == gid] + [fr for fr, t in seen_s if t == sid]
        assert ok == (walk(f, rate, max(ends), gid, sid, seen_g, seen_s, pairs) and walk(f, -rate, min(ends), gid, sid, seen_g, seen_s, pairs))


def test_schedule_mistracks_by_hand(spark):
    """A track that is followed, one that changes its match, one that is lost half way and one outside the schedule."""
    def standing(track, x, frames):
        return [(7, f, track, x, 40.0, x + 30, 70.0) for f in frames]

    gt = spark.createDataFrame(standing(1, 10.0, range(4)) + standing(2, 110.0, range(4)) + standing(3, 210.0, range(4)) + standing(4, 310.0, range(4)), BOXES)
    pred = spark.createDataFrame(standing(21, 12.0, range(4)) + standing(22, 110.0, (0, 1)) + standing(23, 110.0, (2, 3)) + standing(24, 210.0, (0, 1)), BOXES)
    kept = spark.createDataFrame([(7, f, 0, c) for f in range(4) for c in (0, 1, 2)], "video bigint, frame_idx bigint, row bigint, col bigint")
    got = {}
    for r in rates.schedule_mistrack(gt, pred, kept, 400, 100, 1, 4).collect():
        got.setdefault(r.track_id, {})[r.frame_idx] = r.correct
    assert got == {1: dict.fromkeys(range(4), True), 2: {0: True, 1: False, 2: False, 3: True}, 3: {0: True, 1: False, 2: False, 3: False}}


def test_rate_table_against_counts(spark):
    """Every tile gets the highest rate whose smoothed accuracy reaches the threshold, or the lowest rate."""
    rng = random.Random(31)
    wanted = [1, 3, 9]
    counts = {(r, c, q): (rng.randrange(30), rng.randrange(12)) for r in range(2) for c in range(4) for q in wanted if rng.random() < 0.8}
    df = spark.createDataFrame([(*k, *v) for k, v in counts.items()], "row bigint, col bigint, rate bigint, correct bigint, incorrect bigint")
    table = rates.max_rate_table(rates.laplace_accuracy(df, wanted, 2, 4), [0.45, 0.75], 1)
    expected = {}
    for r, c, t in itertools.product(range(2), range(4), (0.45, 0.75)):
        good = [q for q in wanted if (lambda n: (n[0] + 1) / (sum(n) + 2))(counts.get((r, c, q), (0, 0))) >= t]
        expected[(r, c, t)] = max(good, default=1)
    assert {(r.row, r.col, r.threshold): r.max_rate for r in table.collect()} == expected


# --- selection of groups ---------------------------------------------------

def selection(spark, covers, distance, refine=2):
    """covers: {frame: {(row, col): group}}; returns chosen (frame, group) and broken constraints."""
    data = [(0, f, r, c, gid) for f, cells in covers.items() for (r, c), gid in cells.items()]
    df = spark.createDataFrame(data, "video bigint, frame_idx bigint, row bigint, col bigint, group_id bigint")
    limit = spark.createDataFrame([(r, c, d) for (r, c), d in distance.items()], "row bigint, col bigint, max_rate bigint")
    chosen = pruning.prune_groups(df, limit, refine)
    return {(r.frame_idx, r.group_id) for r in chosen.collect()}, pruning.check_prune(chosen, df, limit).count()


def cheapest(covers, distance):
    """Fewest cells of a selection meeting every constraint, by trying all subsets."""
    groups = sorted({(f, gid) for f, cells in covers.items() for gid in cells.values()})
    size = {(f, gid): sum(1 for x in covers[f].values() if x == gid) for f, gid in groups}
    seen = {t: sorted(f for f in covers if t in covers[f]) for t in distance}
    best = None
    for bits in range(2 ** len(groups)):
        on = {gr for i, gr in enumerate(groups) if bits >> i & 1}
        ok = True
        for t, pos in seen.items():
            held = [f for f in pos if (f, covers[f][t]) in on]
            if len(pos) > 1:
                ok &= pos[0] in held and pos[-1] in held
                for a, b in zip(pos, pos[1:]):
                    if b - a > distance[t]:
                        ok &= a in held and b in held
                    elif a in held:
                        ok &= any(a < h <= a + distance[t] for h in held)
        if ok:
            cost = sum(size[gr] for gr in on)
            best = cost if best is None else min(best, cost)
    return best, size


@pytest.mark.parametrize("covers, distance", [
    # A wide group twice, with single tiles between at uneven gaps.
    ({1: {(0, 0): 0, (0, 1): 0}, 4: {(0, 0): 0}, 6: {(0, 1): 0}, 9: {(0, 0): 0, (0, 1): 0}}, {(0, 0): 3, (0, 1): 8}),
    # Two tiles that never share a group, one of them with a gap over its distance.
    ({0: {(2, 0): 0, (0, 3): 1}, 5: {(2, 0): 1}, 7: {(0, 3): 0}, 8: {(2, 0): 0, (0, 3): 1}}, {(2, 0): 4, (0, 3): 9}),
    # A tile that is in every frame beside tiles seen once each.
    ({f: {(1, 1): 0, (f, 5): 0} for f in range(6)}, {(1, 1): 2, **{(f, 5): 1 for f in range(6)}}),
])
def test_selection_of_planted_groups(spark, covers, distance):
    chosen, broken = selection(spark, covers, distance)
    best, size = cheapest(covers, distance)
    assert broken == 0 and best <= sum(size[gr] for gr in chosen) <= 2 * best


@pytest.mark.parametrize("seed", range(4))
def test_selection_is_feasible_and_close_to_the_optimum(spark, seed):
    rng = random.Random(seed)
    cells = [(0, 0), (0, 1), (1, 0)]
    covers = {f: {t: rng.randint(0, 1) for t in cells if rng.random() < 0.8} for f in range(7)}
    distance = {t: rng.randint(1, 4) for t in cells}
    chosen, broken = selection(spark, covers, distance)
    best, size = cheapest(covers, distance)
    assert broken == 0
    assert best <= sum(size[gr] for gr in chosen) <= 2 * max(best, 1)


# --- linking ---------------------------------------------------------------

def moving(n_tracks, frames, drop, seed):
    rng = random.Random(seed)
    out = []
    for t in range(n_tracks):
        for f in range(frames):
            if rng.random() >= drop:
                x, y = 100.0 * t + 3 * f, 50.0 + 2 * f
                out.append((0, f, t, x, y, x + 60, y + 40, 0.9 if rng.random() < 0.8 else 0.35))
    return out


DETS = "video bigint, frame_idx bigint, det_id bigint, x1 double, y1 double, x2 double, y2 double, score double"


@pytest.mark.parametrize("name, params", [
    ("sort", {}), ("sort", {"max_age": 5}), ("ocsort", {"max_age": 5}), ("bytetrack", {"max_age": 5})])
def test_trackers_follow_separate_objects(spark, name, params):
    data = moving(4, 30, 0.1, 1)
    got = tracker(name, **params)(spark.createDataFrame(data, DETS)).collect()
    by_object = {}
    for r in got:
        by_object.setdefault(r.det_id, set()).add(r.track_id)
    assert all(len(ids) == 1 for ids in by_object.values()) and len(by_object) == 4
    assert len({next(iter(i)) for i in by_object.values()}) == 4
    assert len({(r.frame_idx, r.track_id) for r in got}) == len(got)
    if name == "sort":
        assert len(got) == len(data)


def test_tracker_min_hits_and_gap(spark):
    data = [(0, f, 0, 0.0, 0.0, 10.0, 10.0, 0.9) for f in (0, 1, 2, 30, 31)]
    df = spark.createDataFrame(data, DETS)
    ids = {r.frame_idx: r.track_id for r in linking.link_tracks(df, max_age=5).collect()}
    assert ids[0] == ids[2] != ids[30] == ids[31]
    assert {r.frame_idx for r in linking.link_tracks(df, max_age=5, min_hits=3).collect()} == {0, 1, 2}
    with pytest.raises(ValueError):
        tracker("none")


def test_two_stage_start_needs_high_score(spark):
    low = [(0, f, 0, 0.0, 0.0, 10.0, 10.0, 0.3) for f in range(3)]
    late = [(0, f, 1, 50.0, 0.0, 60.0, 10.0, 0.3 if f < 2 else 0.9) for f in range(5)]
    got = linking.link_tracks_two_stage(spark.createDataFrame(low + late, DETS), max_age=3).collect()
    assert {(r.frame_idx, r.det_id) for r in got} == {(2, 1), (3, 1), (4, 1)}


def test_sampled_tracking(spark):
    got = linking.run_tracker_sampled(spark.createDataFrame(moving(2, 16, 0.0, 2), DETS), 4, tracker("sort", max_age=2)).collect()
    assert {r.frame_idx for r in got} == {0, 4, 8, 12} and len({r.track_id for r in got}) == 2


# --- metrics ---------------------------------------------------------------

def test_perfect_tracks_score_one(spark):
    rng = random.Random(9)
    gt = [(0, f, t, 100.0 * t + f, 0.0, 100.0 * t + f + 50, 40.0) for t in range(3) for f in range(10)]
    df = spark.createDataFrame(gt, BOXES)
    mean = metrics.hota_mean(metrics.hota(df, df)).where("video = 'COMBINED'").first()
    assert (mean.HOTA_HOTA, mean.HOTA_DetA, mean.HOTA_AssA) == pytest.approx((1.0, 1.0, 1.0))
    clear = metrics.clear_mot(df, df).first()
    assert (clear.MOTA, clear.idsw, clear.mt, clear.frag) == (1.0, 0, 3, 0)
    assert metrics.identity(df, df).first().IDF1 == 1.0


def test_identity_switch_and_misses(spark):
    gt = [(0, f, 1, 0.0, 0.0, 50.0, 40.0) for f in range(10)]
    pred = [(0, f, 5 if f < 4 else 6, 0.0, 0.0, 50.0, 40.0) for f in range(10) if f != 7]
    a, b = spark.createDataFrame(gt, BOXES), spark.createDataFrame(pred, BOXES)
    clear = metrics.clear_mot(a, b).first()
    assert (clear.tp, clear.fn, clear.fp, clear.idsw, clear.frag) == (9, 1, 0, 1, 1)
    ident = metrics.identity(a, b).first()
    assert (ident.idtp, ident.idfn, ident.idfp) == (5, 5, 4)
    per = metrics.hota(a, b).where("video = '0' AND alpha = 0.5").first()
    # two pairs of 4 and 5 matches: A = c / (10 + n - c)
    ass = (4 * 4 / (10 + 4 - 4) + 5 * 5 / (10 + 5 - 5)) / 9
    assert per.AssA == pytest.approx(ass) and per.DetA == pytest.approx(0.9)


def test_box_similarities(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5.0, 5.0, 15.0, 15.0)], "l_x1 double, l_y1 double, l_x2 double, l_y2 double, "
                               "r_x1 double, r_y1 double, r_x2 double, r_y2 double")
    a, b = g.box("l_"), g.box("r_")
    r = df.select(g.iou(a, b), g.iou_plus1(a, b), g.giou(a, b), g.diou(a, b), g.ciou(a, b)).first()
    assert r[0] == pytest.approx(25 / 175)
    assert r[1] == pytest.approx(36 / (121 + 121 - 36))
    assert r[2] == pytest.approx((25 / 175 - (225 - 175) / 225 + 1) / 2)
    assert r[3] == pytest.approx((25 / 175 - 50 / 450 + 1) / 2) and r[4] == pytest.approx(r[3])


def test_unpack_inverts_projection(spark):
    """A box put on a canvas and mapped back lands where it was."""
    place = spark.createDataFrame([(0, 0, 1, 3, 0, 0, 2, 3, 2, 2), (0, 0, 2, 4, 0, 3, 0, 0, 2, 2)],
                                  "video bigint, collage_idx bigint, group_id bigint, frame_idx bigint, py bigint, px bigint, oy bigint, ox bigint, h bigint, w bigint")
    index = packing.crop_index(place)
    tracks = spark.createDataFrame([(0, 3, 1, 65.0, 45.0, 85.0, 70.0), (0, 4, 2, 5.0, 5.0, 25.0, 30.0), (0, 4, 3, 300.0, 300.0, 320.0, 320.0)], BOXES)
    canvas = joins.project_annotations(tracks, place, index, 20, 100, 40)
    assert canvas.count() == 2
    back = joins.unpack_detections(canvas.drop("frame_idx", "group_id").withColumnRenamed("track_id", "det_id"), index, place, 20, 2, 5)
    got = {(r.frame_idx, r.det_id): (r.x1, r.y1, r.x2, r.y2) for r in back.collect()}
    assert got == {(3, 1): (65.0, 45.0, 85.0, 70.0), (4, 2): (5.0, 5.0, 25.0, 30.0)}


# --- long chains and one-sided videos ----------------------------------------

def test_long_chain_of_preferences_needs_no_rounds(spark):
    """Every box prefers the next one's partner a little more, so only the last pair is mutual at first."""
    n = 500
    pairs = [(0, 3, k, k, 1.0 + 0.001 * k) for k in range(n)] + [(0, 3, k, k + 1, 1.0005 + 0.001 * k) for k in range(n - 1)]
    df = spark.createDataFrame(pairs, "video bigint, frame_idx bigint, l bigint, r bigint, w double")
    got = {(p.l, p.r) for p in matching.match_in_frames(df, ["video", "frame_idx"], "frame_idx", ["l"], ["r"], [F.col("w")]).collect()}
    assert got == greedy([(w, a, b) for _, _, a, b, w in pairs])


def test_chained_suppression(spark):
    """Each box overlaps the next one only, so every other box stays."""
    boxes = [(0, 1, k, 6.0 * k, 0.0, 6.0 * k + 20, 20.0, 1 - 0.001 * k) for k in range(300)]
    df = spark.createDataFrame(boxes, "video bigint, frame_idx bigint, det_id bigint, x1 double, y1 double, x2 double, y2 double, score double")
    assert sorted(r.det_id for r in matching.nms(df, 0.5).collect()) == list(range(0, 300, 2))


def test_one_sided_videos_and_sampled_frames(spark):
    def moving(video):
        return [(video, f, 1, 2.0 * f, 0.0, 2.0 * f + 30, 30.0) for f in range(12)]

    gt, pred = spark.createDataFrame(moving(1) + moving(2), BOXES), spark.createDataFrame(moving(1) + moving(3), BOXES)
    got = {r.video: (r.tp, r.fn, r.fp, r.frag, r.MOTA) for r in metrics.clear_mot(gt, pred).collect()}
    assert got == {1: (12, 0, 0, 0, 1.0), 2: (0, 12, 0, 0, 0.0), 3: (0, 0, 12, 0, -12.0)}
    sampled = [metrics.prepare_eval(x, 3) for x in (gt, gt)]
    assert {r.frag for r in metrics.clear_mot(*sampled).collect()} == {0}


@pytest.mark.parametrize("name,least", [("giou", 0.3), ("diou", 0.3), ("ciou", 0.25), ("giou", 0.6)])
def test_measures_that_need_no_overlap_lose_no_pair(spark, name, least):
    from trackgrid.registry import ASSOCIATION

    rng = random.Random(11)
    left, right = random_boxes(rng, 3, 7, 60, 400), random_boxes(rng, 3, 7, 60, 400)
    ldf, rdf = spark.createDataFrame(left, BOXES), spark.createDataFrame(right, BOXES)
    got = joins.iou_join(ldf, rdf, least, similarity=name)
    every = joins.renamed(ldf, ["track_id", "x1", "y1", "x2", "y2"], "l_").join(joins.renamed(rdf, ["track_id", "x1", "y1", "x2", "y2"], "r_"), ["video", "frame_idx"])
    expected = every.withColumn("iou", ASSOCIATION[name](g.box("l_"), g.box("r_"))).where(F.col("iou") >= least)
    columns = ["frame_idx", "l_track_id", "r_track_id", "l_x1", "r_y2"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, expected.select(*columns).collect()))


def test_centre_distance_prefers_the_nearest(spark):
    one = spark.createDataFrame([(0, 0, 1, 0.0, 0.0, 10.0, 10.0)], BOXES)
    two = spark.createDataFrame([(0, 0, 1, 80.0, 80.0, 90.0, 90.0), (0, 0, 2, 12.0, 0.0, 22.0, 10.0)], BOXES)
    got = matching.match_boxes(one, two, 0.2, similarity="ct_dist", reach=200.0).collect()
    assert [(r.l_track_id, r.r_track_id) for r in got] == [(1, 2)]
    with pytest.raises(ValueError):
        joins.iou_join(one, two, 0.2, similarity="ct_dist")


def test_more_videos_than_there_are_is_an_error(spark):
    videos = spark.createDataFrame([(k,) for k in range(3)], "video bigint")
    assert filters.split_videos(videos, 1, 1, 1).count() == 3
    with pytest.raises(Exception, match="there are 3"):
        filters.split_videos(videos, 5, 5, 5).collect()
