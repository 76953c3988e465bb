"""One-to-one matching and suppression."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from trackgrid.functions import geometry as g
from trackgrid.operators.joins import iou_join, overlap_pairs
from trackgrid.scale import materialize
from trackgrid.schemas import BOX

#: Frames that are matched one after the other in one group, where a match depends on the frame before.
FRAMES_PER_STATE = 1024


def _taken(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs, ordered from the best, find both their ends free."""
    out = (np.bincount(left)[left] == 1) & (np.bincount(right)[right] == 1)
    # Pairs whose ends have no other candidate are free whatever the others do.
    used_left, used_right = np.zeros(left.max() + 1, bool), np.zeros(right.max() + 1, bool)
    for k in np.flatnonzero(~out):
        if not (used_left[left[k]] or used_right[right[k]]):
            out[k] = used_left[left[k]] = used_right[right[k]] = True
    return out


def _frame_numbers(batch: pa.RecordBatch, keys: list[str], ids: list[str]) -> tuple[pd.DataFrame, np.ndarray]:
    """The ids of a batch, and for each row the number of its frame within the batch."""
    table = batch.select([*keys, *ids]).to_pandas()
    return table, table.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()


def _matcher(keys: list[str], left: list[str], right: list[str], columns: list[str]):
    """Task on pairs in order of frames, best pair first: the pairs that find both ends free.

    Frames that lie within a batch are settled at once. A frame that goes on in the next batch leaves
    behind which of its boxes are taken.
    """
    def match(batches):
        last, used = None, (set(), set())
        for batch in batches:
            if not batch.num_rows:
                continue
            table, number = _frame_numbers(batch, keys, [*left, *right])
            taken = _taken(*[table.groupby([*keys, *side], sort=False, dropna=False).ngroup().to_numpy() for side in (left, right)])
            for n in sorted({0, int(number[-1])}):
                rows = np.flatnonzero(number == n)
                key = tuple(batch.column(k)[int(rows[0])].as_py() for k in keys)
                if key != last:
                    last, used = key, (set(), set())
                some = table.iloc[rows]
                ends = [list(zip(*[some[c].tolist() for c in side])) for side in (left, right)]
                for i, a, b in zip(rows.tolist(), *ends):
                    taken[i] = a not in used[0] and b not in used[1]
                    if taken[i]:
                        used[0].add(a)
                        used[1].add(b)
            yield batch.select(columns).filter(pa.array(taken))

    return match


def match_in_frames(pairs: DataFrame, within: list[str], frame: str, left: list[str], right: list[str], order: list[Column]) -> DataFrame:
    """Greedy one-to-one subset of the candidate pairs of each frame, best pair first.

    ``order`` ranks pairs (larger is better); ties go to the smaller left, then right id.
    Pairs of different frames never compete: pairs are dealt by frame, sorted (Spark spills) and read as
    a stream. A task holds one batch and the ids taken in the current frame, so a frame
    with a third of all boxes, or with many copies of one box, needs memory for its boxes, not for its pairs.
    """
    ranks = [f"_o{i}" for i in range(len(order))]
    keys = list(dict.fromkeys([*within, frame]))
    dealt = pairs.withColumns(dict(zip(ranks, order))).repartition(*keys)
    ranked = dealt.sortWithinPartitions(*keys, *[F.col(r).desc() for r in ranks], *left, *right)
    return ranked.drop(*ranks).mapInArrow(_matcher(keys, left, right, pairs.columns), pairs.schema)


def _continued(frame: str, left: str, right: str, rank: str):
    """Matching of a block's frames in order, pairs matched in the frame before first; the first frame is told what was."""
    def match(pairs: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        pairs = pairs.sort_values([frame, rank, left, right], ascending=[True, False, True, True], kind="stable").reset_index(drop=True)
        number = pairs[frame].to_numpy()
        starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        ends = np.r_[starts[1:], len(pairs)]
        l, r = (pd.Series(list(zip(number, pairs[c]))).factorize()[0] for c in (left, right))
        real = pairs[left].notna().to_numpy()
        free = real & (np.bincount(l, real)[l] == 1) & (np.bincount(r, real)[r] == 1)
        taken, contested = free.copy(), np.add.reduceat(real & ~free, starts) > 0
        ids = list(zip(pairs[left], pairs[right]))
        told = set(zip(before[left], before[right]))
        for k in np.flatnonzero(contested):
            last = told if k == 0 else {ids[i] for i in range(starts[k - 1], ends[k - 1]) if taken[i]}
            rows = [i for i in range(starts[k], ends[k]) if real[i] and not free[i]]
            used_l, used_r = set(), set()
            for i in sorted(rows, key=lambda i: (ids[i] not in last, i)):
                if l[i] not in used_l and r[i] not in used_r:
                    used_l.add(l[i])
                    used_r.add(r[i])
                    taken[i] = True
        # One row without ids tells of the block itself.
        out = pd.concat([pairs[taken], pairs.iloc[[0]].assign(**{left: None, right: None})])
        return out.assign(_last=out[frame] == number[-1], _asks=bool(contested[0])).astype({left: "Int64", right: "Int64"})

    return match


def match_continued(pairs: DataFrame, frames: DataFrame, within: list[str], frame: str, left: str, right: str, rank: str) -> DataFrame:
    """One-to-one matches per frame; pairs that were matched in the frame before go first, then the better ``rank``.

    ``frames`` lists the frames (``within`` and ``frame``) that count as one before another, also those without
    pairs. Blocks of frames are matched side by side, each from an assumed state. Where the block before turns out to end in
    another state and the first frame has a choice, the block is matched again; the choice
    seldom lasts longer than a block, so further passes see few blocks or none.
    """
    columns = [*within, frame, left, right, rank]
    block = F.floor(F.col(frame) / FRAMES_PER_STATE).alias("_block")
    empty = frames.select(*within, frame).join(pairs.select(*within, frame).distinct(), [*within, frame], "left_anti")
    rows = pairs.select(*columns).unionByName(empty, allowMissingColumns=True).select(*columns, block)
    rows = materialize(rows, "clear")
    kind = StructType([*rows.schema, StructField("_last", BooleanType()), StructField("_asks", BooleanType())])
    keys, of = [*within, "_block"], Window.partitionBy(*within).orderBy("_block")
    told = rows.select(*keys, left, right).where("false")
    settle = _continued(frame, left, right, rank)

    def matched(some: DataFrame, state: DataFrame) -> DataFrame:
        grouped = some.groupBy(*keys).cogroup(state.groupBy(*keys))
        # Blocks without rows have nothing to match, whatever they are told.
        return materialize(grouped.applyInPandas(lambda a, b: settle(a, b)[kind.names] if len(a) else pd.DataFrame(columns=kind.names), kind), "clear")

    found = matched(rows, told)
    blocks = materialize(found.where(f"{left} IS NULL").select(*keys, "_asks").withColumn("_prior", F.lag("_block").over(of)), "clear")
    asking = blocks.where("_asks AND _prior IS NOT NULL").select(*keys, "_prior")
    while True:
        ended = found.where(f"_last AND {left} IS NOT NULL").select(*within, F.col("_block").alias("_prior"), left, right)
        now = asking.join(ended, [*within, "_prior"]).select(*keys, left, right)
        changed = materialize(now.exceptAll(told).union(told.exceptAll(now)).select(*keys).distinct(), "clear")
        if changed.isEmpty():
            return found.where(f"{left} IS NOT NULL").select(*columns)
        told = materialize(now, "clear")
        again = matched(rows.join(changed, keys, "left_semi"), told.join(changed, keys, "left_semi"))
        found = materialize(found.join(changed, keys, "left_anti").unionByName(again), "clear")


def one_to_one(pairs: DataFrame, within: list[str], left: list[str], right: list[str], order: list[Column],
               tag: str = "match") -> DataFrame:
    """Greedy one-to-one subset of candidate pairs that belong to no frame, best pair first.

    For pairs of tracks, whose number is small beside their boxes. ``order`` ranks pairs (larger is better); ties go to the smaller left, then right
    id. A round keeps the pairs that are the best of both their ends and drops the
    pairs that lost an end; it repeats until no pair is left. That is the greedy
    result, and candidates that are already one-to-one finish in the first round.

    Each end's best pair is a partial aggregation, so a popular box costs no more
    than its candidates' partial sums; no group of pairs is ever gathered.
    """
    rank = [c.alias(f"_o{i}") for i, c in enumerate(order)] + [(-F.col(c)).alias(f"_n_{c}") for c in [*left, *right]]
    payload = [c for c in pairs.columns if c not in [*within, *left, *right]]
    best = F.max(F.struct(*rank, *payload)).alias("_b")
    ids = [*within, *left, *right]

    def mutual(rest: DataFrame) -> DataFrame:
        of_left = rest.groupBy(*within, *left).agg(best).select(
            *within, *left, *[(-F.col(f"_b._n_{c}")).alias(c) for c in right], *[F.col(f"_b.{c}") for c in payload])
        of_right = rest.groupBy(*within, *right).agg(F.max(F.struct(*rank)).alias("_b")).select(
            *within, *right, *[(-F.col(f"_b._n_{c}")).alias(c) for c in left])
        return of_left.join(of_right, ids).select(*pairs.columns)

    rest, found = materialize(pairs, tag), []
    while True:
        got = materialize(mutual(rest), tag)
        found.append(got)
        rest = materialize(
            rest.join(got.select(*within, *left), [*within, *left], "left_anti")
            .join(got.select(*within, *right), [*within, *right], "left_anti"), tag)
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, found)


def match_boxes(left: DataFrame, right: DataFrame, min_iou: float, frame: list[str] | None = None,
                left_id: str = "track_id", right_id: str = "track_id", similarity: str = "iou", reach: float | None = None) -> DataFrame:
    """One-to-one matching of the boxes of each frame by similarity of at least ``min_iou``.

    All other columns of both sides come along as ``l_*`` / ``r_*``.
    """
    frame = frame or ["video", "frame_idx"]
    pairs = iou_join(left, right, min_iou, frame, similarity=similarity, reach=reach)
    return match_in_frames(pairs, frame, frame[-1], [f"l_{left_id}"], [f"r_{right_id}"], [F.col("iou")])


def match_ids(left: DataFrame, right: DataFrame, min_iou: float) -> DataFrame:
    """:func:`match_boxes` without the boxes: (video, frame_idx, l_track_id, r_track_id, iou). Pairs leave them behind before they are dealt."""
    frame, ids = ["video", "frame_idx"], ["l_track_id", "r_track_id"]
    slim = [t.select(*frame, "track_id", *BOX) for t in (left, right)]
    return match_in_frames(iou_join(*slim, min_iou, frame).select(*frame, *ids, "iou"), frame, "frame_idx", ids[:1], ids[1:], [F.col("iou")])


def nms(df: DataFrame, threshold: float, frame: list[str] | None = None, key: str = "det_id",
        score: str = "score") -> DataFrame:
    """Non-maximum suppression per frame: keep the best box, drop those overlapping it too much.

    Overlap counts whole pixels. Only pairs at or above ``threshold`` become edges. A box is kept
    if no kept stronger neighbour drops it; the strongest box with edges decides first. Edges
    are dealt by frame, sorted and read as a stream; a task holds one batch and the boxes dropped in the current frame.
    """
    frame = frame or ["video", "frame_idx"]
    ids = [*frame, key]
    slim = df.select(*ids, "x1", "y1", "x2", "y2", score)
    # Boxes that share a pixel touch once grown by it, which is what the closed overlap of grown boxes finds.
    grown = slim.withColumns({"x2": F.col("x2") + 1, "y2": F.col("y2") + 1})
    pairs = overlap_pairs(grown, grown, frame)
    a, b = g.box("l_"), g.box("r_")
    real_a, real_b = g.Box(a.x1, a.y1, a.x2 - 1, a.y2 - 1), g.Box(b.x1, b.y1, b.x2 - 1, b.y2 - 1)
    stronger = (F.col(f"l_{score}") > F.col(f"r_{score}")) | (
        (F.col(f"l_{score}") == F.col(f"r_{score}")) & (F.col(f"l_{key}") > F.col(f"r_{key}")))
    edges = pairs.where(stronger & (g.iou_plus1(real_a, real_b) >= threshold)).select(*frame, f"l_{key}", f"r_{key}", f"l_{score}")
    dealt = edges.repartition(*frame).sortWithinPartitions(*frame, F.col(f"l_{score}").desc(), F.col(f"l_{key}").desc())
    lost = df.select(*ids).schema

    def suppressed(batches):
        last, gone = None, set()
        for batch in batches:
            if not batch.num_rows:
                continue
            table, number = _frame_numbers(batch, frame, [f"l_{key}", f"r_{key}"])
            first, out, current = tuple(batch.column(k)[0].as_py() for k in frame), [], 0
            gone = gone if first == last else set()
            # Every edge into a box comes before the edges out of it, as strong ends are in order.
            for i, (n, strong, weak) in enumerate(zip(number.tolist(), table[f"l_{key}"].tolist(), table[f"r_{key}"].tolist())):
                if n != current:
                    gone, current = set(), n
                if strong not in gone and weak not in gone:
                    gone.add(weak)
                    out.append(i)
            last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in frame)
            kept = batch.select([*frame, f"r_{key}"]).take(pa.array(out, pa.int64()))
            yield pa.RecordBatch.from_arrays(kept.columns, names=ids)

    return df.join(dealt.mapInArrow(suppressed, lost), ids, "left_anti")
