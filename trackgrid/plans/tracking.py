"""Registered queries over tracks: matching, linking, evaluation, learned rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackgrid.evaluation import metrics, rates
from trackgrid.functions import geometry as g
from trackgrid.operators import aggregates as agg
from trackgrid.operators import joins, linking, matching, tiles, trajectories
from trackgrid.plans import fixtures as fx
from trackgrid.plans.catalog import register, rounded
from trackgrid.plans.fixtures import COLS, HEIGHT, ROWS, TILE, WIDTH, sql
from trackgrid.plans.tiles import _CENTER, _CLIP, _IOU_SQL, _PAIR_SQL


def greedy_sql(pairs: str, within: str, left: str, right: str, order: str, rounds: int, name: str = "matched") -> dict[str, str]:
    """Mutual-best rounds as a chain of table expressions; ``rounds`` has to be enough to use up the pairs."""
    out = {f"{name}_p0": pairs}
    for i in range(rounds):
        rest = f"{name}_p{i}"
        out[f"{name}_m{i}"] = f"""
            SELECT * EXCLUDE (rl, rr) FROM (SELECT *,
              row_number() OVER (PARTITION BY {within}, {left} ORDER BY {order}, {left}, {right}) AS rl,
              row_number() OVER (PARTITION BY {within}, {right} ORDER BY {order}, {left}, {right}) AS rr FROM {rest}) WHERE rl = 1 AND rr = 1"""
        keys = within.split(", ")

        def lost(side: str) -> str:
            cols = [*keys, *side.split(", ")]
            return (f"NOT EXISTS (SELECT 1 FROM {name}_m{i} m WHERE "
                    + " AND ".join(f"m.{c} = p.{c}" for c in cols) + ")")

        out[f"{name}_p{i + 1}"] = f"SELECT * FROM {rest} p WHERE {lost(left)} AND {lost(right)}"
    out[name] = " UNION ALL ".join(f"SELECT * FROM {name}_m{i}" for i in range(rounds))
    return out


_SLIM_PAIRS = "SELECT video, frame_idx, gid, pid, iou FROM ious"
_MATCH = greedy_sql(_SLIM_PAIRS + " WHERE iou >= 0.3", "video, frame_idx", "gid", "pid", "iou DESC", 5)


@register("g04_match_boxes", sql("SELECT video, frame_idx, gid AS l_track_id, pid AS r_track_id, round(iou, 6) AS iou FROM matched",
                                 "pred_tracks", pairs=_PAIR_SQL, ious=_IOU_SQL, **_MATCH))
def _(spark, sf):
    return rounded(matching.match_boxes(fx.gt_tracks(spark, sf), fx.pred_tracks(spark, sf), 0.3).select(
        "video", "frame_idx", "l_track_id", "r_track_id", "iou"), "iou")


_EVERY_PAIR = _PAIR_SQL.split("WHERE")[0]
_MEASURES = {
    "giou": "(iou - (hw * hh - uni) / (hw * hh) + 1) / 2",
    "diou": "(iou - gap2 / (hw * hw + hh * hh) + 1) / 2",
    "ciou": "(iou - gap2 / (hw * hw + hh * hh) - coalesce(v / nullif(1 - iou + v, 0), 0) * v + 1) / 2",
}


def _register_measure(name: str, least: float) -> None:
    """Matching by a similarity that boxes apart can reach too."""
    pairs = f"SELECT video, frame_idx, gid, pid, m AS iou FROM (SELECT *, {_MEASURES[name]} AS m FROM ious) WHERE m >= {least}"
    steps = greedy_sql(pairs, "video, frame_idx", "gid", "pid", "round(iou, 9) DESC", 6)

    @register(f"v01_match_{name}", sql("SELECT video, frame_idx, gid AS l_track_id, pid AS r_track_id, round(iou, 6) AS iou FROM matched",
                                       "pred_tracks", pairs=_EVERY_PAIR, ious=_IOU_SQL, **steps))
    def _(spark, sf):
        pairs = joins.iou_join(fx.gt_tracks(spark, sf), fx.pred_tracks(spark, sf), least, similarity=name)
        best = matching.match_in_frames(pairs, ["video", "frame_idx"], "frame_idx", ["l_track_id"], ["r_track_id"], [F.round("iou", 9)])
        return rounded(best.select("video", "frame_idx", "l_track_id", "r_track_id", "iou"), "iou")


for _name, _least in (("giou", 0.4), ("diou", 0.45), ("ciou", 0.45)):
    _register_measure(_name, _least)


def nms_sql(rounds: int) -> dict[str, str]:
    out = {"n_e0": """
        SELECT video, frame_idx, a.det_id AS s, b.det_id AS w FROM crowded a JOIN crowded b USING (video, frame_idx)
        WHERE a.det_id <> b.det_id AND (a.score > b.score OR (a.score = b.score AND a.det_id > b.det_id))
          AND least(a.x2, b.x2) - greatest(a.x1, b.x1) + 1 > 0 AND least(a.y2, b.y2) - greatest(a.y1, b.y1) + 1 > 0
          AND (least(a.x2, b.x2) - greatest(a.x1, b.x1) + 1) * (least(a.y2, b.y2) - greatest(a.y1, b.y1) + 1)
            / ((a.x2 - a.x1 + 1) * (a.y2 - a.y1 + 1) + (b.x2 - b.x1 + 1) * (b.y2 - b.y1 + 1)
              - (least(a.x2, b.x2) - greatest(a.x1, b.x1) + 1) * (least(a.y2, b.y2) - greatest(a.y1, b.y1) + 1)) >= 0.5"""}
    for i in range(rounds):
        out[f"n_g{i}"] = f"""SELECT DISTINCT e.video, e.frame_idx, e.w FROM n_e{i} e WHERE NOT EXISTS (SELECT 1 FROM n_e{i} t
            WHERE t.video = e.video AND t.frame_idx = e.frame_idx AND t.w = e.s)"""
        gone = f"SELECT 1 FROM n_g{i} g WHERE g.video = e.video AND g.frame_idx = e.frame_idx AND g.w = e."
        out[f"n_e{i + 1}"] = f"SELECT * FROM n_e{i} e WHERE NOT EXISTS ({gone}w) AND NOT EXISTS ({gone}s)"
    out["n_lost"] = " UNION ALL ".join(f"SELECT * FROM n_g{i}" for i in range(rounds))
    return out


@register("w02_nms", sql("""
    SELECT video, frame_idx, det_id, round(score, 6) AS score FROM crowded c WHERE NOT EXISTS (
      SELECT 1 FROM n_lost n WHERE n.video = c.video AND n.frame_idx = c.frame_idx AND n.w = c.det_id)""", "crowded", **nms_sql(5)))
def _(spark, sf):
    return rounded(matching.nms(fx.crowded_detections(spark, sf), 0.5).select("video", "frame_idx", "det_id", "score"), "score")


_INTERP = """
    SELECT video, track_id, CAST(f AS BIGINT) AS frame_idx, round(x1 + t * (nx1 - x1), 6) AS x1, round(y1 + t * (ny1 - y1), 6) AS y1,
      round(x2 + t * (nx2 - x2), 6) AS x2, round(y2 + t * (ny2 - y2), 6) AS y2, f > frame_idx AS interpolated
    FROM (SELECT *, coalesce((f - frame_idx) / CAST(nf - frame_idx AS DOUBLE), 0) AS t FROM (
      SELECT video, track_id, frame_idx, x1, y1, x2, y2, nf, unnest(range(frame_idx, coalesce(nf, frame_idx + 1))) AS f,
        coalesce(nx1, x1) AS nx1, coalesce(ny1, y1) AS ny1, coalesce(nx2, x2) AS nx2, coalesce(ny2, y2) AS ny2
      FROM (SELECT *, lead(frame_idx) OVER w AS nf, lead(x1) OVER w AS nx1, lead(y1) OVER w AS ny1, lead(x2) OVER w AS nx2, lead(y2) OVER w AS ny2
        FROM gt_tracks WINDOW w AS (PARTITION BY video, track_id ORDER BY frame_idx))))"""


@register("w01_interpolate_tracks", sql(_INTERP, "gt_tracks"))
def _(spark, sf):
    return rounded(trajectories.interpolate_tracks(fx.gt_tracks(spark, sf)), "x1", "y1", "x2", "y2")


@register("w13_track_velocity", sql("""
    SELECT video, track_id, frame_idx, round(dy / (sqrt(dx * dx + dy * dy) + 1e-6), 6) AS dy, round(dx / (sqrt(dx * dx + dy * dy) + 1e-6), 6) AS dx
    FROM (SELECT c.video, c.track_id, c.frame_idx, (c.x1 + c.x2) / 2 - (p.x1 + p.x2) / 2 AS dx, (c.y1 + c.y2) / 2 - (p.y1 + p.y2) / 2 AS dy
      FROM (SELECT *, min(frame_idx) OVER (PARTITION BY video, track_id ORDER BY frame_idx RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING) AS near,
        lag(frame_idx) OVER (PARTITION BY video, track_id ORDER BY frame_idx) AS prev FROM gt_tracks) c
      LEFT JOIN gt_tracks p ON p.video = c.video AND p.track_id = c.track_id AND p.frame_idx = coalesce(near, prev))""", "gt_tracks"))
def _(spark, sf):
    return rounded(trajectories.track_velocity(fx.gt_tracks(spark, sf), 3).select("video", "track_id", "frame_idx", "dy", "dx"), "dy", "dx")


@register("w14_prev_frame", sql("""
    SELECT video, frame_idx, coalesce(lag(frame_idx) OVER w, lead(frame_idx) OVER w) AS ref_frame FROM (
      SELECT DISTINCT video, frame_idx FROM gt_tracks) WINDOW w AS (PARTITION BY video ORDER BY frame_idx)""", "gt_tracks"))
def _(spark, sf):
    return trajectories.prev_frame_ref(fx.gt_tracks(spark, sf).select("video", "frame_idx").distinct())


@register("a26_track_presence", sql("""
    SELECT video, track_id, min(frame_idx) AS min_frame, max(frame_idx) AS max_frame, count(DISTINCT frame_idx) AS frames
    FROM gt_tracks GROUP BY ALL""", "gt_tracks"))
def _(spark, sf):
    return agg.track_presence(fx.gt_tracks(spark, sf))


# --- association consistency and rates -------------------------------------

def _consistent_sql(rate: int) -> dict[str, str]:
    """Matched boxes at multiples of ``rate`` whose next and previous sighting of either track is a match of both."""
    r = f"r{rate}"
    seen = """SELECT video, track_id, frame_idx, lead(frame_idx) OVER w AS nf, lag(frame_idx) OVER w AS pf
        FROM {t} WHERE frame_idx % {rate} = 0 WINDOW w AS (PARTITION BY video, track_id ORDER BY frame_idx)"""
    return {
        f"{r}_g": seen.format(t="gt_tracks", rate=rate), f"{r}_p": seen.format(t="pred_tracks", rate=rate),
        f"{r}_m": f"""SELECT m.video, m.frame_idx, m.gid, m.pid, g.nf AS gn, g.pf AS gp, p.nf AS pn, p.pf AS pp
          FROM matched m JOIN {r}_g g ON g.video = m.video AND g.track_id = m.gid AND g.frame_idx = m.frame_idx
          JOIN {r}_p p ON p.video = m.video AND p.track_id = m.pid AND p.frame_idx = m.frame_idx""",
        f"{r}_c": f"""SELECT *, (gn IS NULL AND pn IS NULL OR coalesce(gn = pn, FALSE) AND EXISTS (SELECT 1 FROM {r}_m n
              WHERE n.video = m.video AND n.gid = m.gid AND n.pid = m.pid AND n.frame_idx = m.gn))
            AND (gp IS NULL AND pp IS NULL OR coalesce(gp = pp, FALSE) AND EXISTS (SELECT 1 FROM {r}_m n
              WHERE n.video = m.video AND n.gid = m.gid AND n.pid = m.pid AND n.frame_idx = m.gp)) AS correct FROM {r}_m m""",
    }


_TRACK_BASE = dict(pairs=_PAIR_SQL, ious=_IOU_SQL, **_MATCH)


@register("w04_association_consistent", sql("""
    SELECT video, frame_idx, gid AS l_track_id, pid AS r_track_id, correct FROM r2_c""", "pred_tracks", **_TRACK_BASE, **_consistent_sql(2)))
def _(spark, sf):
    gt, pred = (trajectories.at_rates(t, [2]) for t in (fx.gt_tracks(spark, sf), fx.pred_tracks(spark, sf)))
    return rates.consistent_matches(gt, pred).select("video", "frame_idx", "l_track_id", "r_track_id", "correct")


def _counts_sql(rate: int) -> str:
    return f"""SELECT row, col, count(*) FILTER (WHERE coalesce(correct, FALSE)) AS correct,
        count(*) FILTER (WHERE NOT coalesce(correct, FALSE)) AS incorrect, CAST({rate} AS BIGINT) AS rate
      FROM gt_tiles t LEFT JOIN r{rate}_c c ON c.video = t.video AND c.frame_idx = t.frame_idx AND c.gid = t.track_id
      WHERE t.frame_idx % {rate} = 0 GROUP BY row, col"""


def _at_rates(spark, sf, wanted):
    return trajectories.at_rates(fx.pred_tracks(spark, sf), wanted)


# The sampling rates that are tried.
_LEARN = [1, 2, 4, 8, 16]
_ALL_COUNTS = dict(counts=" UNION ALL ".join(_counts_sql(r) for r in _LEARN))
_RATE_STEPS = {k: v for r in _LEARN for k, v in _consistent_sql(r).items()}
_LAPLACE = """
    SELECT g.row, g.col, g.rate, coalesce(correct, 0) AS correct, coalesce(incorrect, 0) AS incorrect,
      (coalesce(correct, 0) + 1) / (coalesce(correct, 0) + coalesce(incorrect, 0) + 2) AS accuracy
    FROM (SELECT row, col, rate FROM grid_rows, grid_cols, (VALUES (1), (2), (4), (8), (16)) v(rate)) g LEFT JOIN counts USING (row, col, rate)"""


@register("a27_e06_assoc_counts", sql("SELECT * FROM counts", "pred_tracks", "gt_tiles", **_TRACK_BASE, **_RATE_STEPS, **_ALL_COUNTS))
def _(spark, sf):
    return rates.assoc_counts(fx.gt_tracks(spark, sf), _at_rates(spark, sf, _LEARN), _LEARN, TILE, ROWS, COLS)


@register("a28_laplace_accuracy", sql("SELECT * REPLACE (round(accuracy, 6) AS accuracy) FROM laplace",
                                      "pred_tracks", "gt_tiles", **_TRACK_BASE, **_RATE_STEPS, **_ALL_COUNTS, laplace=_LAPLACE))
def _(spark, sf):
    counts = rates.assoc_counts(fx.gt_tracks(spark, sf), _at_rates(spark, sf, _LEARN), _LEARN, TILE, ROWS, COLS)
    return rounded(rates.laplace_accuracy(counts, _LEARN, ROWS, COLS), "accuracy")


@register("a29_e13_learn_rates", sql("""
    SELECT row, col, t AS threshold, CAST(coalesce(max(rate) FILTER (WHERE accuracy >= t), 1) AS BIGINT) AS max_rate
    FROM laplace, (VALUES (0.4::DOUBLE), (0.6::DOUBLE), (0.8::DOUBLE)) v(t) GROUP BY ALL""",
    "pred_tracks", "gt_tiles", **_TRACK_BASE, **_RATE_STEPS, **_ALL_COUNTS, laplace=_LAPLACE))
def _(spark, sf):
    return rates.learn_rates(fx.gt_tracks(spark, sf), _at_rates(spark, sf, _LEARN), _LEARN, TILE, ROWS, COLS, [0.4, 0.6, 0.8])


_RETAINED = "SELECT DISTINCT video, frame_idx, row, col FROM centered WHERE row IS NOT NULL AND (frame_idx + row + col) % 3 > 0"
_ANCHORED = """
    SELECT a.*, m.pid, lead(a.frame_idx) OVER w AS nf, lag(a.frame_idx) OVER w AS pf, lead(m.pid) OVER w AS np, lag(m.pid) OVER w AS pp
    FROM (SELECT c.video, c.frame_idx, c.track_id FROM centered c JOIN retained USING (video, frame_idx, row, col)) a
    LEFT JOIN matched m ON m.video = a.video AND m.frame_idx = a.frame_idx AND m.gid = a.track_id
    WINDOW w AS (PARTITION BY a.video, a.track_id ORDER BY a.frame_idx)"""


def _retained(spark, sf):
    cells = tiles.center_cell(fx.gt_tracks(spark, sf), WIDTH, HEIGHT, 3, 3)
    return cells.where("row IS NOT NULL AND (frame_idx + row + col) % 3 > 0").select("video", "frame_idx", "row", "col").distinct()


@register("w03_e07_anchor_consistency", sql("""
    SELECT video, frame_idx, track_id, pid IS NOT NULL AND (nf IS NULL OR coalesce(np = pid, FALSE)) AND (pf IS NULL OR coalesce(pp = pid, FALSE)) AS correct
    FROM anchored""", "pred_tracks", **_TRACK_BASE, clipped=_CLIP, centered=_CENTER, retained=_RETAINED, anchored=_ANCHORED))
def _(spark, sf):
    return rates.schedule_mistrack(fx.gt_tracks(spark, sf), fx.pred_tracks(spark, sf), _retained(spark, sf), WIDTH, HEIGHT, 3, 3)


@register("a33_mistrack_rate", sql("""
    SELECT video, count(*) FILTER (WHERE ok) AS correct, count(*) FILTER (WHERE NOT ok) AS incorrect,
      round(count(*) FILTER (WHERE NOT ok) / count(*), 6) AS mistrack_rate FROM (SELECT video,
      pid IS NOT NULL AND (nf IS NULL OR coalesce(np = pid, FALSE)) AND (pf IS NULL OR coalesce(pp = pid, FALSE)) AS ok FROM anchored) GROUP BY ALL""",
    "pred_tracks", **_TRACK_BASE, clipped=_CLIP, centered=_CENTER, retained=_RETAINED, anchored=_ANCHORED))
def _(spark, sf):
    held = rates.schedule_mistrack(fx.gt_tracks(spark, sf), fx.pred_tracks(spark, sf), _retained(spark, sf), WIDTH, HEIGHT, 3, 3)
    return rounded(agg.mistrack_rate(held, ["video"]), "mistrack_rate")


_CELLS = "SELECT DISTINCT video, frame_idx, row, col FROM centered WHERE row IS NOT NULL"
# A grid gives a track what its visited cells give it, so a track is scored once for each assignment of those cells and a grid adds up.
_GRIDS = dict(
    grids="""SELECT 'grid_' || array_to_string(grid, '-') AS variant_id, grid FROM (
      SELECT list_transform(range(9), lambda i: [1, 2, 4][CAST(g // CAST(pow(3, 8 - i) AS BIGINT) AS BIGINT) % 3 + 1]) AS grid FROM range(19683) t(g))""",
    kept="""SELECT DISTINCT video, row, col, rate, unnest([fa, fb]) AS frame_idx FROM (
      SELECT video, row, col, rate, min(frame_idx) AS fa, max(frame_idx) AS fb FROM (
        SELECT cells.*, rate, frame_idx // (rate + 1) AS run FROM cells, (VALUES (1), (2), (4)) v(rate)) GROUP BY video, row, col, rate, run)""",
    visits="SELECT video, track_id, list_sort(list(DISTINCT row * 3 + col)) AS visited FROM centered WHERE row IS NOT NULL GROUP BY ALL",
    parts="SELECT variant_id, visited, list_transform(visited, lambda c: grid[c + 1]) AS sub FROM (SELECT DISTINCT visited FROM visits), grids",
    subs="""SELECT visited, sub, count(*) FILTER (WHERE ok) AS correct, count(*) FILTER (WHERE NOT ok) AS incorrect FROM (
      SELECT visited, sub, pid IS NOT NULL AND (nf IS NULL OR coalesce(np = pid, FALSE)) AND (pf IS NULL OR coalesce(pp = pid, FALSE)) AS ok FROM (
        SELECT p.visited, p.sub, m.pid, lead(c.frame_idx) OVER w AS nf, lag(c.frame_idx) OVER w AS pf, lead(m.pid) OVER w AS np, lag(m.pid) OVER w AS pp
        FROM centered c JOIN visits USING (video, track_id) JOIN (SELECT DISTINCT visited, sub FROM parts) p USING (visited)
        JOIN kept k ON k.video = c.video AND k.frame_idx = c.frame_idx AND k.row = c.row AND k.col = c.col
          AND k.rate = p.sub[list_position(p.visited, c.row * 3 + c.col)]
        LEFT JOIN matched m ON m.video = c.video AND m.frame_idx = c.frame_idx AND m.gid = c.track_id
        WINDOW w AS (PARTITION BY p.sub, c.video, c.track_id ORDER BY c.frame_idx))) GROUP BY ALL""",
    sizes="""SELECT variant_id, CAST(sum(coalesce(n, 0)) AS BIGINT) AS retained FROM (
      SELECT variant_id, unnest(range(9)) AS cell, unnest(grid) AS rate FROM grids) LEFT JOIN (
      SELECT row * 3 + col AS cell, rate, count(*) AS n FROM kept GROUP BY ALL) USING (cell, rate) GROUP BY ALL""",
    sums="""SELECT variant_id, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(incorrect) AS BIGINT) AS incorrect
      FROM parts JOIN subs USING (visited, sub) GROUP BY ALL""")
_CENTER2 = _CENTER.replace("/ 240", "/ 360").replace("/ 2) / 360) AS BIGINT) END AS col", "/ 2) / 540) AS BIGINT) END AS col")


def _cells(gt, rows, cols):
    return tiles.center_cell(gt, WIDTH, HEIGHT, rows, cols).where("row IS NOT NULL").select("video", "frame_idx", "row", "col").distinct()


def _matches(spark, sf):
    return matching.match_ids(fx.gt_tracks(spark, sf), fx.pred_tracks(spark, sf), 0.3)


_SCORED_SCHEDULES = """
    SELECT variant_id, retained, original, correct, incorrect, round(incorrect / (correct + incorrect), 6) AS mistrack_rate,
      round(retained / original, 6) AS retention_rate
    FROM (SELECT variant_id, count(*) AS retained FROM schedule GROUP BY ALL) JOIN (SELECT count(*) AS original FROM cells) ON TRUE
    JOIN (SELECT variant_id, count(*) FILTER (WHERE ok) AS correct, count(*) FILTER (WHERE NOT ok) AS incorrect FROM (
      SELECT variant_id, pid IS NOT NULL AND (nf IS NULL OR coalesce(np = pid, FALSE)) AND (pf IS NULL OR coalesce(pp = pid, FALSE)) AS ok FROM (
        SELECT s.variant_id, m.pid, lead(c.frame_idx) OVER w AS nf, lag(c.frame_idx) OVER w AS pf, lead(m.pid) OVER w AS np, lag(m.pid) OVER w AS pp
        FROM centered c JOIN schedule s USING (video, frame_idx, row, col)
        LEFT JOIN matched m ON m.video = c.video AND m.frame_idx = c.frame_idx AND m.gid = c.track_id
        WINDOW w AS (PARTITION BY s.variant_id, c.video, c.track_id ORDER BY c.frame_idx))) GROUP BY ALL) USING (variant_id)"""


@register("e08_j03_rate_grids", sql("""
    SELECT variant_id, retained, original, correct, incorrect, round(incorrect / (correct + incorrect), 6) AS mistrack_rate,
      round(retained / original, 6) AS retention_rate
    FROM sizes JOIN (SELECT count(*) AS original FROM cells) ON TRUE JOIN sums USING (variant_id)""",
    "pred_tracks", **_TRACK_BASE, clipped=_CLIP, centered=_CENTER, cells=_CELLS, **_GRIDS))
def _(spark, sf):
    """Every grid of 3 x 3 cells and 3 rates: 19,683."""
    gt = fx.gt_tracks(spark, sf)
    return rounded(rates.evaluate_rate_grids(gt, _matches(spark, sf), _cells(gt, 3, 3), [1, 2, 4], WIDTH, HEIGHT, 3, 3),
                   "mistrack_rate", "retention_rate")


@register("e09_whole_frame_baseline", sql(_SCORED_SCHEDULES, "pred_tracks", **_TRACK_BASE, clipped=_CLIP, centered=_CENTER2, cells=_CELLS,
    schedule="SELECT 'frame_' || r AS variant_id, cells.* FROM cells, (VALUES (1), (2), (4)) v(r) WHERE frame_idx % r = 0"))
def _(spark, sf):
    cells = _cells(fx.gt_tracks(spark, sf), 2, 2)
    plan = rates.whole_frame_baseline(cells, [1, 2, 4])
    return rounded(rates.evaluate_schedules(fx.gt_tracks(spark, sf), _matches(spark, sf), cells, plan, WIDTH, HEIGHT, 2, 2),
                   "mistrack_rate", "retention_rate")


# --- tracking metrics ------------------------------------------------------

_ALIGN = dict(
    pairs=_PAIR_SQL, ious=_IOU_SQL,
    sims="SELECT *, sum(iou) OVER (PARTITION BY video, frame_idx, gid) AS rs, sum(iou) OVER (PARTITION BY video, frame_idx, pid) AS cs FROM (" + _SLIM_PAIRS + ")",
    gn="SELECT video, track_id AS gid, count(*) AS gt_n FROM gt_tracks GROUP BY ALL",
    pn="SELECT video, track_id AS pid, count(*) AS pred_n FROM pred_tracks GROUP BY ALL",
    aligned="""SELECT video, gid, pid, gt_n, pred_n, s / (gt_n + pred_n - s) AS alignment FROM (
      SELECT video, gid, pid, sum(iou / (rs + cs - iou)) AS s FROM sims GROUP BY ALL) JOIN gn USING (video, gid) JOIN pn USING (video, pid)""")
_HOTA_MATCH = greedy_sql("""SELECT video, frame_idx, gid, pid, iou, gt_n, pred_n, round(alignment * iou, 9) AS score FROM sims JOIN aligned USING (video, gid, pid)""",
                         "video, frame_idx", "gid", "pid", "score DESC", 5)
_HOTA = dict(
    alphas="SELECT round(0.05 * i, 2)::DOUBLE AS alpha FROM range(1, 20) r(i)",
    pc="""SELECT video, alpha, gid, pid, gt_n, pred_n, count(*) AS c, sum(iou) AS s FROM matched JOIN alphas ON iou >= alpha - 1e-9 GROUP BY ALL""",
    pv="""SELECT video, alpha, CAST(sum(c) AS BIGINT) AS tp, sum(c * c / greatest(1, gt_n + pred_n - c)) AS ass, sum(s) AS loc FROM pc GROUP BY ALL""",
    lng="""SELECT CAST(video AS VARCHAR) AS video, alpha, g, p, coalesce(tp, 0) AS tp, coalesce(ass, 0) AS ass, coalesce(loc, 0) AS loc
      FROM (SELECT video, count(*) AS g FROM gt_tracks GROUP BY ALL) JOIN (SELECT video, count(*) AS p FROM pred_tracks GROUP BY ALL) USING (video)
      JOIN alphas ON TRUE LEFT JOIN pv USING (video, alpha)""",
    allv="""SELECT * FROM lng UNION ALL SELECT 'COMBINED', alpha, CAST(sum(g) AS BIGINT), CAST(sum(p) AS BIGINT), CAST(sum(tp) AS BIGINT), sum(ass), sum(loc)
      FROM lng GROUP BY alpha""",
    scored="""SELECT video, alpha, tp, g - tp AS fn, p - tp AS fp, sqrt(tp / greatest(1, g + p - tp) * (ass / greatest(1, tp))) AS HOTA,
      tp / greatest(1, g + p - tp) AS DetA, ass / greatest(1, tp) AS AssA, CASE WHEN tp > 0 THEN loc / tp ELSE 1 END AS LocA FROM allv""")


@register("e02_hota", sql("""
    SELECT video, alpha, tp, fn, fp, round(HOTA, 6) AS HOTA, round(DetA, 6) AS DetA, round(AssA, 6) AS AssA, round(LocA, 6) AS LocA FROM scored""",
    "pred_tracks", **_ALIGN, **_HOTA_MATCH, **_HOTA))
def _(spark, sf):
    return rounded(metrics.hota(fx.gt_tracks(spark, sf), fx.pred_tracks(spark, sf)), "HOTA", "DetA", "AssA", "LocA")


@register("e02_hota_mean", sql("""
    SELECT video, round(avg(HOTA), 6) AS HOTA_HOTA, round(avg(DetA), 6) AS HOTA_DetA, round(avg(AssA), 6) AS HOTA_AssA FROM scored GROUP BY ALL""",
    "pred_tracks", **_ALIGN, **_HOTA_MATCH, **_HOTA))
def _(spark, sf):
    return rounded(metrics.hota_mean(metrics.hota(fx.gt_tracks(spark, sf), fx.pred_tracks(spark, sf))), "HOTA_HOTA", "HOTA_DetA", "HOTA_AssA")


# Frame by frame: pairs matched in the frame before, then the better overlap, while both ends are free.
_MATCH5 = dict(
    seen="SELECT video, frame_idx, row_number() OVER (PARTITION BY video ORDER BY frame_idx) AS k FROM (SELECT DISTINCT video, frame_idx FROM gt_tracks INTERSECT SELECT DISTINCT video, frame_idx FROM pred_tracks)",
    listed="""SELECT b.video, b.frame_idx, b.k, coalesce(list({'gid': gid, 'pid': pid, 'iou': iou} ORDER BY iou DESC, gid, pid) FILTER (WHERE gid IS NOT NULL), []) AS pairs
      FROM seen b LEFT JOIN (SELECT * FROM ious WHERE iou >= 0.5) i ON i.video = b.video AND i.frame_idx = b.frame_idx GROUP BY ALL""",
    rec_matched="""SELECT video, 0::BIGINT AS k, CAST(NULL AS BIGINT) AS frame_idx, []::STRUCT(gid BIGINT, pid BIGINT, iou DOUBLE)[] AS m FROM seen GROUP BY ALL
      UNION ALL SELECT l.video, l.k, l.frame_idx, list_reduce(list_prepend([]::STRUCT(gid BIGINT, pid BIGINT, iou DOUBLE)[], list_transform(
        list_concat(list_filter(l.pairs, lambda p: len(list_filter(r.m, lambda q: q.gid = p.gid AND q.pid = p.pid)) > 0), list_filter(l.pairs, lambda p: len(list_filter(r.m, lambda q: q.gid = p.gid AND q.pid = p.pid)) = 0)),
        lambda p: [p])), lambda a, x: CASE WHEN len(list_filter(a, lambda q: q.gid = x[1].gid OR q.pid = x[1].pid)) > 0 THEN a ELSE list_concat(a, x) END)
      FROM rec_matched r JOIN listed l ON l.video = r.video AND l.k = r.k + 1""",
    matched="SELECT video, frame_idx, x.gid AS gid, x.pid AS pid, x.iou AS iou FROM (SELECT video, frame_idx, unnest(m) AS x FROM rec_matched)")


@register("e03_clear_mot", sql("""
    WITH r AS (SELECT *, lag(pid) OVER w AS pp, lag(frame_idx) OVER w AS pf FROM matched WINDOW w AS (PARTITION BY video, gid ORDER BY frame_idx)),
    t AS (SELECT video, gid, count(*) AS hits, sum(iou) AS siou, count(*) FILTER (WHERE pp <> pid) AS idsw, count(*) FILTER (WHERE pf < frame_idx - 1) AS frag FROM r GROUP BY ALL),
    v AS (SELECT gn.video, CAST(sum(gt_n) AS BIGINT) AS g, CAST(sum(coalesce(hits, 0)) AS BIGINT) AS tp, CAST(sum(coalesce(idsw, 0)) AS BIGINT) AS idsw,
      CAST(sum(coalesce(frag, 0)) AS BIGINT) AS frag, sum(coalesce(siou, 0)) AS siou, count(*) FILTER (WHERE coalesce(hits, 0) / gt_n > 0.8) AS mt,
      count(*) FILTER (WHERE coalesce(hits, 0) / gt_n BETWEEN 0.2 AND 0.8) AS pt, count(*) FILTER (WHERE coalesce(hits, 0) / gt_n < 0.2) AS ml
      FROM gn LEFT JOIN t USING (video, gid) GROUP BY gn.video)
    , u AS (SELECT video, coalesce(g, 0) AS g, coalesce(tp, 0) AS tp, coalesce(p, 0) AS p, coalesce(idsw, 0) AS idsw, coalesce(frag, 0) AS frag,
      coalesce(siou, 0) AS siou, coalesce(mt, 0) AS mt, coalesce(pt, 0) AS pt, coalesce(ml, 0) AS ml
      FROM v FULL JOIN (SELECT video, count(*) AS p FROM pred_tracks GROUP BY ALL) USING (video))
    SELECT video, tp, g - tp AS fn, p - tp AS fp, idsw, frag, mt, pt, ml, round((tp - (p - tp) - idsw) / greatest(1, g), 6) AS MOTA,
      round(siou / greatest(1, tp), 6) AS MOTP FROM u""",
    "pred_tracks", recursive=True, pairs=_PAIR_SQL, ious=_IOU_SQL, gn=_ALIGN["gn"], **_MATCH5))
def _(spark, sf):
    return rounded(metrics.clear_mot(fx.gt_tracks(spark, sf), fx.pred_tracks(spark, sf)), "MOTA", "MOTP")


_ID_MATCH = greedy_sql("SELECT video, gid, pid, count(*) AS frames FROM ious WHERE iou >= 0.5 GROUP BY ALL", "video", "gid", "pid", "frames DESC", 6)


@register("e04_identity", sql("""
    SELECT video, tp AS idtp, g - tp AS idfn, p - tp AS idfp, round(2 * tp / greatest(1, g + p), 6) AS IDF1, round(tp / greatest(1, g), 6) AS IDR,
      round(tp / greatest(1, p), 6) AS IDP FROM (SELECT video, count(*) AS g FROM gt_tracks GROUP BY ALL)
    JOIN (SELECT video, count(*) AS p FROM pred_tracks GROUP BY ALL) USING (video)
    JOIN (SELECT video, CAST(sum(frames) AS BIGINT) AS tp FROM matched GROUP BY ALL) USING (video)""",
    "pred_tracks", pairs=_PAIR_SQL, ious=_IOU_SQL, **_ID_MATCH))
def _(spark, sf):
    return rounded(metrics.identity(fx.gt_tracks(spark, sf), fx.pred_tracks(spark, sf)), "IDF1", "IDR", "IDP")


@register("e05_count_metrics", sql("""
    SELECT video, GT_Dets, GT_IDs, Dets, IDs, GT_max, max_ids FROM (SELECT video, count(*) AS GT_Dets, count(DISTINCT track_id) AS GT_IDs, max(track_id) + 1 AS GT_max FROM gt_tracks GROUP BY ALL)
    JOIN (SELECT video, count(*) AS Dets, count(DISTINCT track_id) AS IDs, max(track_id) + 1 AS max_ids FROM pred_tracks GROUP BY ALL) USING (video)""", "pred_tracks"))
def _(spark, sf):
    gt, pred = fx.gt_tracks(spark, sf), fx.pred_tracks(spark, sf)
    compat = metrics.count_metrics(gt, pred, compat=True).select("video", F.col("GT_IDs").alias("GT_max"), F.col("IDs").alias("max_ids"))
    return metrics.count_metrics(gt, pred).join(compat, "video")


@register("e01_prepare_eval", sql("""
    SELECT video, frame_idx // 3 AS frame_idx, track_id, 0 AS class, 1.0::DOUBLE AS confidence FROM gt_tracks WHERE frame_idx % 3 = 0""", "gt_tracks"))
def _(spark, sf):
    return metrics.prepare_eval(fx.gt_tracks(spark, sf), 3, strict=True).select("video", "frame_idx", "track_id", "class", "confidence")


# --- linking ---------------------------------------------------------------

_EDGES = """
    SELECT a.video, a.frame_idx AS lf, a.det_id AS ld, b.frame_idx AS rf, b.det_id AS rd,
      greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i,
      (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s
    FROM detections a JOIN detections b ON a.video = b.video AND b.frame_idx = a.frame_idx + 1
    WHERE least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1)"""
_LINK1 = greedy_sql("SELECT video, lf, ld, rf, rd, i / (s - i) AS w FROM edges WHERE i / (s - i) >= 0.1", "video", "lf, ld", "rf, rd", "w DESC", 6)
_CHAIN = """
    SELECT video, frame_idx, det_id, frame_idx * 4294967296 + det_id AS track_id FROM detections d
      WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.video = d.video AND m.rf = d.frame_idx AND m.rd = d.det_id)
    UNION ALL SELECT m.video, m.rf, m.rd, c.track_id FROM rec_chain c JOIN matched m ON m.video = c.video AND m.lf = c.frame_idx AND m.ld = c.det_id"""


@register("g05_link_adjacent", sql("SELECT * FROM rec_chain", "detections", recursive=True, edges=_EDGES, **_LINK1, rec_chain=_CHAIN))
def _(spark, sf):
    return linking.link_tracks(fx.detections(spark, sf), max_age=1).select("video", "frame_idx", "det_id", "track_id")


def _overlap_sql(a: str, b: str, where: str, columns: str, source: str) -> str:
    return f"""
    SELECT * FROM (SELECT {columns}, i / (s - i) AS w FROM (SELECT a.video, {source},
        greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i,
        (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s
      FROM {a} a JOIN {b} b ON a.video = b.video AND {where}
      WHERE least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1))) WHERE w >= 0.1"""


def link_sql(max_age: int, nodes: str = "SELECT * FROM detections") -> dict[str, str]:
    """Two-pass linking: adjacent frames, then open ends moved along their last step; ``rec_chain`` has the track ids."""
    out = {"nodes": nodes}
    out |= greedy_sql(_overlap_sql("nodes", "nodes", "b.frame_idx = a.frame_idx + 1", "video, lf, ld, rf, rd",
                                   "a.frame_idx AS lf, a.det_id AS ld, b.frame_idx AS rf, b.det_id AS rd"),
                      "video", "lf, ld", "rf, rd", "w DESC", 6, "near1")
    out["stepped"] = """
        SELECT n.*, coalesce(((n.x1 + n.x2) / 2 - (p.x1 + p.x2) / 2) / (n.frame_idx - p.frame_idx), 0) AS vx,
          coalesce(((n.y1 + n.y2) / 2 - (p.y1 + p.y2) / 2) / (n.frame_idx - p.frame_idx), 0) AS vy
        FROM nodes n LEFT JOIN near1 l ON l.video = n.video AND l.rf = n.frame_idx AND l.rd = n.det_id
        LEFT JOIN nodes p ON p.video = l.video AND p.frame_idx = l.lf AND p.det_id = l.ld"""
    out["tails"] = """
        SELECT video, frame_idx, det_id, gap, x1 + vx * gap AS x1, y1 + vy * gap AS y1, x2 + vx * gap AS x2, y2 + vy * gap AS y2
        FROM (SELECT *, CAST(range AS BIGINT) AS gap FROM stepped, range(2, %d)) n
        WHERE NOT EXISTS (SELECT 1 FROM near1 l WHERE l.video = n.video AND l.lf = n.frame_idx AND l.ld = n.det_id)""" % (max_age + 1)
    out["heads"] = """
        SELECT * FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM near1 l WHERE l.video = n.video AND l.rf = n.frame_idx AND l.rd = n.det_id)"""
    out |= greedy_sql(_overlap_sql("tails", "heads", "b.frame_idx = a.frame_idx + a.gap", "video, lf, ld, rf, rd, gap",
                                   "a.frame_idx AS lf, a.det_id AS ld, b.frame_idx AS rf, b.det_id AS rd, a.gap"),
                      "video", "lf, ld", "rf, rd", "gap, w DESC", 16, "far")
    out["links"] = "SELECT video, lf, ld, rf, rd FROM near1 UNION ALL SELECT video, lf, ld, rf, rd FROM far"
    out["rec_chain"] = """
        SELECT video, frame_idx, det_id, frame_idx * 4294967296 + det_id AS track_id FROM nodes d
          WHERE NOT EXISTS (SELECT 1 FROM links m WHERE m.video = d.video AND m.rf = d.frame_idx AND m.rd = d.det_id)
        UNION ALL SELECT m.video, m.rf, m.rd, c.track_id FROM rec_chain c JOIN links m ON m.video = c.video AND m.lf = c.frame_idx AND m.ld = c.det_id"""
    return out


@register("g05_link_tracks", sql("""
    SELECT video, track_id, frame_idx, det_id FROM (SELECT *, count(*) OVER (PARTITION BY video, track_id) AS n FROM rec_chain) WHERE n >= 2""",
    "detections", recursive=True, **link_sql(20)))
def _(spark, sf):
    return linking.link_tracks(fx.detections(spark, sf), min_hits=2).select("video", "track_id", "frame_idx", "det_id")


_FUSED = "1 - (1 - (1 - (1 - iou)) * rs)"
_NORM = "(sqrt({x} * {x} + {y} * {y}) + 1e-6)"
_DIRECTED = f"""iou + CASE WHEN has_step THEN (pi() / 2 - abs(acos(least(1.0::DOUBLE, greatest(-1.0::DOUBLE,
    vy / {_NORM.format(x='vx', y='vy')} * (sy / {_NORM.format(x='sx', y='sy')}) + vx / {_NORM.format(x='vx', y='vy')} * (sx / {_NORM.format(x='sx', y='sy')})))))) / pi() * 0.2 * rs ELSE 0 END"""
_NOT_USED = "NOT EXISTS (SELECT 1 FROM links{i} l WHERE l.video = n.video AND l.{f} = n.frame_idx AND l.{d} = n.det_id)"


def stages_sql(nodes: str, stages: list[dict], rounds: int = 16) -> dict[str, str]:
    """Association passes over open ends as table expressions; the last ``links`` and ``nodes`` come out unnumbered."""
    out = {"nodes0": nodes, "links0": "SELECT video, frame_idx AS lf, det_id AS ld, frame_idx AS rf, det_id AS rd FROM detections WHERE FALSE"}
    for i, st in enumerate(stages):
        move = "+ {v} * gap" if st.get("predict") else ""
        boxes = ", ".join(f"{c} {move.format(v='v' + c[0])} AS {c}" for c in ("x1", "y1", "x2", "y2"))
        out[f"stepped{i}"] = f"""
        SELECT n.*, coalesce(((n.x1 + n.x2) / 2 - (p.x1 + p.x2) / 2) / (n.frame_idx - p.frame_idx), 0) AS vx, p.video IS NOT NULL AS has_step,
          coalesce(((n.y1 + n.y2) / 2 - (p.y1 + p.y2) / 2) / (n.frame_idx - p.frame_idx), 0) AS vy
        FROM nodes{i} n LEFT JOIN links{i} l ON l.video = n.video AND l.rf = n.frame_idx AND l.rd = n.det_id
        LEFT JOIN nodes{i} p ON p.video = l.video AND p.frame_idx = l.lf AND p.det_id = l.ld"""
        gaps = ", ".join(f"(CAST({v} AS BIGINT))" for v in st["gaps"])
        out[f"tails{i}"] = f"""
        SELECT video, frame_idx, det_id, gap, vx, vy, has_step, (x1 + x2) / 2 AS ox, (y1 + y2) / 2 AS oy, {boxes}
        FROM stepped{i} n, (VALUES {gaps}) v(gap) WHERE {st.get("tails", "TRUE")} AND {_NOT_USED.format(i=i, f="lf", d="ld")}"""
        out[f"heads{i}"] = f"SELECT * FROM nodes{i} n WHERE {st.get('heads', 'TRUE')} AND {_NOT_USED.format(i=i, f='rf', d='rd')}"
        pairs = f"""
        SELECT video, lf, ld, rf, rd, gap, w FROM (SELECT *, {st.get("weight", "iou")} AS w FROM (SELECT *, i / (s - i) AS iou FROM (
          SELECT a.video, a.frame_idx AS lf, a.det_id AS ld, b.frame_idx AS rf, b.det_id AS rd, a.gap, a.vx, a.vy, a.has_step, b.score AS rs,
            (b.x1 + b.x2) / 2 - a.ox AS sx, (b.y1 + b.y2) / 2 - a.oy AS sy,
            greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i,
            (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s
          FROM tails{i} a JOIN heads{i} b ON a.video = b.video AND b.frame_idx = a.frame_idx + a.gap
          WHERE least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1)))
          WHERE iou >= {st.get("min_iou", 0)}) WHERE w >= {st.get("min_weight", 0)}"""
        out |= greedy_sql(pairs, "video", "lf, ld", "rf, rd", "gap, w DESC", rounds, f"got{i}")
        union = f"SELECT * FROM links{i} UNION ALL SELECT video, lf, ld, rf, rd FROM got{i}"
        if "start" in st:
            out[f"all{i}"] = union
            out[f"rec_start{i}"] = f"""
            SELECT video, frame_idx, det_id FROM nodes{i} n WHERE {st["start"]} AND NOT EXISTS (
              SELECT 1 FROM all{i} l WHERE l.video = n.video AND l.rf = n.frame_idx AND l.rd = n.det_id)
            UNION ALL SELECT l.video, l.rf, l.rd FROM rec_start{i} c JOIN all{i} l ON l.video = c.video AND l.lf = c.frame_idx AND l.ld = c.det_id"""
            out[f"kept{i}"] = f"SELECT * FROM rec_start{i}"
            out[f"nodes{i + 1}"] = f"SELECT n.* FROM nodes{i} n JOIN kept{i} USING (video, frame_idx, det_id)"
            out[f"links{i + 1}"] = f"SELECT l.* FROM all{i} l JOIN kept{i} k ON k.video = l.video AND k.frame_idx = l.rf AND k.det_id = l.rd"
        else:
            out[f"nodes{i + 1}"], out[f"links{i + 1}"] = f"SELECT * FROM nodes{i}", union
    last = len(stages)
    out["nodes"], out["links"] = f"SELECT * FROM nodes{last}", f"SELECT * FROM links{last}"
    return out | {"rec_chain": _CHAINED}


_CHAINED = link_sql(2)["rec_chain"]
_BANDED = "SELECT * FROM detections WHERE score > {high} OR (score > 0.1 AND score < {high})"


def _bands(high: float) -> tuple[str, str]:
    return f"n.score > {high}", f"n.score > 0.1 AND n.score < {high}"


_HIGH, _LOW = _bands(0.5)
_TWO_STAGE = stages_sql(_BANDED.format(high=0.5), [
    dict(gaps=[1], tails=_HIGH, heads=_HIGH, weight=_FUSED, min_weight="(1 - 0.8::DOUBLE)"),
    dict(gaps=[1], heads=_LOW, min_iou=0.5, start=_HIGH),
    dict(gaps=[1], tails=_LOW, heads=_HIGH, weight=_FUSED, min_weight="(1 - 0.8::DOUBLE)"),
    dict(gaps=range(2, 21), heads=_HIGH, predict=True, weight=_FUSED, min_weight="(1 - 0.8::DOUBLE)")])


@register("g06_link_two_stage", sql("""
    SELECT t.* FROM started t WHERE NOT EXISTS (SELECT 1 FROM overlapping o WHERE o.video = t.video AND o.frame_idx = t.frame_idx AND o.track_id = t.track_id)""",
    "detections", recursive=True, **_TWO_STAGE,
    started="""
      SELECT video, track_id, frame_idx, det_id FROM (SELECT c.*, min(CASE WHEN score >= 0.6 THEN frame_idx END) OVER (PARTITION BY video, track_id) AS first
        FROM rec_chain c JOIN nodes n USING (video, frame_idx, det_id)) WHERE frame_idx >= first""",
    sized="""
      SELECT s.*, x1, y1, x2, y2, count(*) OVER (PARTITION BY s.video, s.track_id) AS hits FROM started s JOIN nodes n USING (video, frame_idx, det_id)""",
    overlapping="""
      SELECT DISTINCT video, frame_idx, track_id FROM (SELECT a.video, a.frame_idx, a.track_id,
        greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i,
        (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s
        FROM sized a JOIN sized b USING (video, frame_idx) WHERE a.hits < b.hits OR (a.hits = b.hits AND a.track_id > b.track_id)) WHERE i / (s - i) >= 0.85"""))
def _(spark, sf):
    return linking.link_tracks_two_stage(fx.detections(spark, sf)).select("video", "track_id", "frame_idx", "det_id")


_HIGH3, _LOW3 = _bands(0.3)
_BY_DIRECTION = stages_sql(_BANDED.format(high=0.3), [
    dict(gaps=[1], tails=_HIGH3, heads=_HIGH3, min_iou=0.1),
    dict(gaps=[1], heads=_LOW3, min_iou=0.1, start=_HIGH3),
    dict(gaps=[1], tails=_LOW3, heads=_HIGH3, min_iou=0.1, weight=_DIRECTED, min_weight="-9"),
    dict(gaps=[2, 3], heads=_HIGH3, min_iou=0.1, predict=True, weight=_DIRECTED, min_weight="-9"),
    dict(gaps=range(4, 21), heads=_HIGH3, min_iou=0.1, predict=True, weight=_DIRECTED, min_weight="-9"),
    dict(gaps=range(2, 21), heads=_HIGH3, min_iou=0.1)])


@register("g07_link_direction", sql("SELECT video, track_id, frame_idx, det_id FROM rec_chain", "detections", recursive=True, **_BY_DIRECTION))
def _(spark, sf):
    return linking.link_tracks_direction(fx.detections(spark, sf)).select("video", "track_id", "frame_idx", "det_id")


@register("g08_tracker_sampled", sql("SELECT video, track_id, frame_idx * 2 AS frame_idx, det_id FROM rec_chain", "detections", recursive=True,
    **link_sql(20, "SELECT * REPLACE (frame_idx // 2 AS frame_idx) FROM detections WHERE frame_idx % 2 = 0")))
def _(spark, sf):
    from trackgrid.registry import tracker

    return linking.run_tracker_sampled(fx.detections(spark, sf), 2, tracker("sort")).select(
        "video", "track_id", "frame_idx", "det_id")


_TRACKED = "SELECT c.video, c.track_id, c.frame_idx, x1, y1, x2, y2 FROM rec_chain c JOIN nodes n USING (video, frame_idx, det_id)"


@register("e15_naive_tracks", sql(_INTERP.replace("gt_tracks", "tracked"), "detections", recursive=True, **link_sql(20), tracked=_TRACKED))
def _(spark, sf):
    from trackgrid.plans.trackings import naive_tracks

    return rounded(naive_tracks(fx.detections(spark, sf), "sort"), "x1", "y1", "x2", "y2")


@register("e15_truth_tracks", sql("""
    SELECT video, track_id, CASE WHEN n >= 1000 THEN frame_idx // 2 ELSE frame_idx END AS frame_idx, x1, y1, x2, y2, interpolated
    FROM filled JOIN (SELECT video, max(frame_idx) * 4 AS n FROM gt_tracks GROUP BY ALL) USING (video) WHERE n < 1000 OR frame_idx % 2 = 0""",
    "detections", recursive=True, **link_sql(20), tracked=_TRACKED, filled=_INTERP.replace("gt_tracks", "tracked")))
def _(spark, sf):
    from trackgrid.plans.trackings import truth_tracks

    counts = fx.gt_tracks(spark, sf).groupBy("video").agg((F.max("frame_idx") * 4).alias("frame_count"))
    return rounded(truth_tracks(fx.detections(spark, sf), counts, "sort"), "x1", "y1", "x2", "y2")


@register("x07_direction_cost", sql("""
    SELECT video, track_id, frame_idx, round(CASE WHEN pvx IS NULL THEN 0 ELSE (pi() / 2 - abs(acos(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, pvx * vx + pvy * vy))))) / pi() * 0.2 * score END, 6) AS cost
    FROM (SELECT *, lag(vx) OVER w AS pvx, lag(vy) OVER w AS pvy FROM (
      SELECT *, dx / (sqrt(dx * dx + dy * dy) + 1e-6) AS vx, dy / (sqrt(dx * dx + dy * dy) + 1e-6) AS vy FROM (
        SELECT *, (x1 + x2) / 2 - lag((x1 + x2) / 2) OVER w AS dx, (y1 + y2) / 2 - lag((y1 + y2) / 2) OVER w AS dy
        FROM gt_tracks WINDOW w AS (PARTITION BY video, track_id ORDER BY frame_idx)))
      WINDOW w AS (PARTITION BY video, track_id ORDER BY frame_idx))""", "gt_tracks"))
def _(spark, sf):
    from trackgrid.scale import with_neighbours

    v = trajectories.track_velocity(fx.gt_tracks(spark, sf), 0)
    both = with_neighbours(v, ["video", "track_id"], "frame_idx", ["dy", "dx"], forward=None, backward="prev")
    cost = g.direction_cost((F.col("prev_dy"), F.col("prev_dx")), (F.col("dy"), F.col("dx")), F.col("score"), 0.2, F.col("prev_dx").isNotNull())
    return rounded(both.select("video", "track_id", "frame_idx", cost.alias("cost")), "cost")


@register("x10_same_class_pairs", sql("""
    SELECT g.video, g.frame_idx, g.track_id AS l_track_id, p.track_id AS r_track_id FROM gt_tracks g JOIN pred_tracks p
    ON g.video = p.video AND g.frame_idx = p.frame_idx AND g.supp % 3 = p.part % 3
    WHERE least(g.x2, p.x2) > greatest(g.x1, p.x1) AND least(g.y2, p.y2) > greatest(g.y1, p.y1)""", "pred_tracks"))
def _(spark, sf):
    from trackgrid.operators.joins import iou_join

    left = fx.gt_tracks(spark, sf).withColumn("class", F.col("supp") % 3)
    right = fx.pred_tracks(spark, sf).withColumn("class", F.col("part") % 3)
    return iou_join(left, right, frame=["video", "frame_idx", "class"]).select("video", "frame_idx", "l_track_id", "r_track_id")
