"""Operator 12: hard negatives by summaries of vector segments.

A vector is cut into segments; of each, mean and deviation are kept. Over a segment of n
components, two vectors' inner product differs from n times the product of the means by at
most n times the product of the deviations, so summaries bound a score from both sides. Bounds
start with few long segments; only pairs that these leave open meet the bounds of shorter
ones, and only what passes the last is scored exactly.

Anchors are a stated query set. They are sent to the tasks in blocks of bounded size, and the
table is passed over twice for each block: for the anchors' positives and, once these set the
range of scores, for the negatives. A task keeps the best rows of its part for every anchor;
these few meet in a shuffle by anchor. No pair is ever a row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackgrid.llm.common import Scratch

#: Segments of a vector on each level of bounds, the coarsest first.
LEVELS = (4, 16)
#: Bytes of anchors that are sent to tasks at a time.
BLOCK_OF_ANCHORS = 8 << 20
#: Rows and anchors that a task compares at a time.
ROWS, ANCHORS = 4096, 1024
#: Up to this share of open pairs they are taken one by one, not as a matrix.
SPARSE = 1 / 16


def _summaries(x: np.ndarray) -> list[np.ndarray]:
    """Means and deviations on every level, side by side and scaled so that products of two summaries are summed."""
    out = []
    for level in LEVELS:
        segments = min(level, max(1, x.shape[1]))
        size = max(1, -(-x.shape[1] // segments))
        # Zeros behind the last component change no inner product.
        parts = np.pad(x, ((0, 0), (0, segments * size - x.shape[1]))).reshape(len(x), segments, size)
        out.append(np.concatenate([parts.mean(2), parts.std(2)], 1) * np.sqrt(size))
    return out


def _bounds(rows: np.ndarray, anchors: np.ndarray, pairs: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all scores, or of the given pairs of places."""
    half = rows.shape[1] // 2
    if pairs is None:
        middle, width = rows[:, :half] @ anchors[:, :half].T, rows[:, half:] @ anchors[:, half:].T
    else:
        r, a = rows[pairs[0]], anchors[pairs[1]]
        middle, width = (np.einsum("ij,ij->i", r[:, s], a[:, s]) for s in (slice(None, half), slice(half, None)))
    # Scores are whole numbers: half of one covers what rounding loses.
    width = width * (1 + 1e-9) + np.abs(middle) * 1e-9 + 0.5
    return middle - width, middle + width


@dataclass
class _Group:
    """Anchors of one vector length."""

    index: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray

    def __post_init__(self):
        self.levels, self.largest = _summaries(self.x), float(np.abs(self.x).max(initial=0))


class AnchorBlock:
    """Anchors that are looked for in one pass, by vector length."""

    def __init__(self, ids: np.ndarray, labels: pa.Array, vectors: list[np.ndarray]):
        self.ids, self.values = ids, labels.unique()
        codes = pc.index_in(labels, self.values).to_numpy()
        sizes = np.array([len(v) for v in vectors], np.int64)
        self.groups = []
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            self.groups.append(_Group(at, ids[at], codes[at], np.stack([vectors[k] for k in at])))


def _vectors(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scaled whole components side by side, starts and sizes, and which rows have a vector that takes part."""
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    bad = flat.is_null().to_numpy(zero_copy_only=False)
    flat = np.floor(flat.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False) * scale)
    row = np.repeat(np.arange(len(sizes)), sizes)
    # Beyond this a score might not fit 64 bits.
    with np.errstate(invalid="ignore"):
        bad |= ~(np.abs(flat) <= np.sqrt(2.0**62 / np.maximum(sizes, 1)[row]))
    valid &= np.bincount(row[bad], minlength=len(sizes)) == 0
    return flat, np.cumsum(sizes) - sizes, sizes, valid


class _Best:
    """The best ``k`` rows of every slot (an anchor, or an anchor and a positive) so far."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.score, self.id = np.zeros((slots, k), np.int64), np.zeros((slots, k), np.int64)
        self.have = np.zeros(slots, np.int64)

    def least(self, low: np.ndarray) -> np.ndarray:
        """The least score that still matters in each slot."""
        return np.where(self.have == self.k, np.maximum(self.score[:, -1], low), low)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Put rows, any number a slot, into their slots."""
        touched = np.unique(slot)
        if not len(touched):
            return
        have = self.have[touched]
        old = np.arange(self.k) < have[:, None]
        slot = np.concatenate([np.repeat(touched, have), slot])
        score = np.concatenate([self.score[touched][old], score])
        ids = np.concatenate([self.id[touched][old], ids])
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        good = rank < self.k
        self.score[slot[good], rank[good]], self.id[slot[good], rank[good]] = score[good], ids[good]
        self.have[touched] = np.bincount(slot[good], minlength=len(self.have))[touched]


def _top(score: np.ndarray, fits: np.ndarray, ids: np.ndarray, k: int, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, anchor) of the best ``k`` fitting rows of each column; rows are in order of id."""
    n = len(ids)
    if n > k:
        if small:
            # Score and place in one number, so that no two are equal.
            key = np.where(fits, score * ROWS + np.arange(n, 0, -1)[:, None] - 1, -np.inf)
            rows = np.argpartition(key, n - k, axis=0)[n - k:]
        else:
            rows = np.lexsort((np.broadcast_to(np.arange(n)[:, None], score.shape), -score, ~fits), axis=0)[:k]
    else:
        rows = np.broadcast_to(np.arange(n)[:, None], score.shape)
    columns = np.broadcast_to(np.arange(score.shape[1]), rows.shape)
    good = fits[rows, columns]
    return rows[good], columns[good]


class _Search:
    """One pass: best rows per slot among those with the same label, or with another label and a score in range.

    ``low`` and ``high`` bound the scores of a slot, as (anchors, ranges); without them any score counts.
    """

    def __init__(self, block: AnchorBlock, k: int, same: bool, low: np.ndarray | None = None, high: np.ndarray | None = None):
        self.block, self.k, self.same = block, k, same
        everything = np.full((len(block.ids), 1), np.iinfo(np.int64).min), np.full((len(block.ids), 1), np.iinfo(np.int64).max)
        self.low, self.high = (low, high) if low is not None else everything
        self.best = [_Best(len(block.ids), k) for _ in range(self.low.shape[1])]

    def rows(self, ids: np.ndarray, labels: pa.Array, vectors: tuple) -> None:
        flat, starts, sizes, valid = vectors
        codes = pc.index_in(labels, self.block.values).fill_null(-1).to_numpy(zero_copy_only=False)
        for group in self.block.groups:
            size = group.x.shape[1]
            mine = np.flatnonzero(valid & (sizes == size))
            mine = mine[np.argsort(ids[mine], kind="stable")]
            for k in range(0, len(mine), ROWS):
                at = mine[k:k + ROWS]
                x = flat[starts[at][:, None] + np.arange(size)]
                levels, largest = _summaries(x), float(np.abs(x).max(initial=0))
                for j in range(0, len(group.ids), ANCHORS):
                    self._compare(ids[at], codes[at], x, levels, group, slice(j, j + ANCHORS), largest)

    def _compare(self, ids, codes, x, levels, group: _Group, part: slice, largest: float) -> None:
        anchors, ax = group.index[part], group.x[part]
        open_ = (codes[:, None] == group.labels[part]) == self.same
        open_ &= ids[:, None] != group.ids[part]
        least = np.stack([b.least(self.low[:, j])[anchors] for j, b in enumerate(self.best)], 1)
        low, high = least.min(1), self.high[anchors].max(1)
        pairs = None
        for rows, full in zip(levels, group.levels):
            if pairs is None and np.count_nonzero(open_) <= SPARSE * open_.size:
                pairs = np.nonzero(open_)
            under, over = _bounds(rows, full[part], pairs)
            if pairs is None:
                open_ &= (over >= low) & (under <= high)
            else:
                still = (over >= low[pairs[1]]) & (under <= high[pairs[1]])
                pairs = pairs[0][still], pairs[1][still]
        if pairs is None and np.count_nonzero(open_) <= SPARSE * open_.size:
            pairs = np.nonzero(open_)
        most = largest * group.largest * x.shape[1]
        kind = np.float64 if most < 2.0**52 else np.int64
        if pairs is None:
            score = x.astype(kind) @ ax.astype(kind).T
            for j, best in enumerate(self.best):
                fits = open_ & (score >= least[:, j]) & (score <= self.high[anchors, j])
                r, a = _top(score, fits, ids, self.k, most < 2.0**40)
                best.add(anchors[a], score[r, a].astype(np.int64), ids[r])
        else:
            score = np.einsum("ij,ij->i", x[pairs[0]].astype(kind), ax[pairs[1]].astype(kind)).astype(np.int64)
            for j, best in enumerate(self.best):
                fits = (score >= least[pairs[1], j]) & (score <= self.high[anchors[pairs[1]], j])
                best.add(anchors[pairs[1][fits]], score[fits], ids[pairs[0][fits]])

    def found(self):
        """Anchors (places in the block), ranges, ids and scores of what was kept."""
        for j, best in enumerate(self.best):
            a, k = np.nonzero(np.arange(self.k) < best.have[:, None])
            yield a, np.full(len(a), j), best.id[a, k], best.score[a, k]


def _pass(vectors: DataFrame, names: tuple[str, str, str], scale: float, search) -> DataFrame:
    """Best rows of each task: place of the anchor, number of the range, id and score."""
    name_id, name_label, name_vector = names

    def task(batches):
        state = search()
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(name_id)).to_numpy(zero_copy_only=False)
            state.rows(ids, batch.column(batch.schema.get_field_index(name_label)), _vectors(batch.column(batch.schema.get_field_index(name_vector)), scale))
        for a, j, ids, score in state.found():
            # A few thousand rows at a time, as other batches are.
            for k in range(0, len(a), 1 << 16):
                cut = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(v[cut].astype(t)) for v, t in ((a, np.int32), (j, np.int32), (ids, np.int64), (score, np.int64))], names=["anchor", "range", "id", "score"])

    return vectors.select(name_id, name_label, name_vector).mapInArrow(task, "anchor int, range int, id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows over all tasks; Spark cuts to ``k`` before the shuffle too."""
    order = Window.partitionBy("anchor", "range").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _anchor_blocks(anchors: DataFrame, names: tuple[str, str, str]):
    """Number of blocks of distinct anchors, and the blocks' rows, read one at a time."""
    size = anchors.agg(F.sum(F.size(names[2]).cast("long") * 8 + 64)).first()[0] or 0
    count = max(1, -(-size // (BLOCK_OF_ANCHORS // 2)))
    place = F.pmod(F.xxhash64(*names), F.lit(count))
    return count, ((anchors.where(place == k) if count > 1 else anchors).sort(*names).toArrow() for k in range(count))


def mine(vectors: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0,
         vec_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """Hard negatives of every anchor and each of its positives, by descending score.

    A component counts as the whole number below ``scale`` times itself, so scores (inner products) are whole
    numbers. An anchor's positives are the ``positives`` best rows of its label; a positive's negatives are the
    ``negatives`` best rows of other labels whose score is from ``low`` to ``high`` percent of the positive's; ties go to the
    smaller id. Returns ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``; anchors without positives, and
    positives without negatives, give no row.

    Rows with a NULL id or label, or with a NULL vector or a NULL or infinite component or one that is no number take no part, nor do rows whose components
    are so large that a score might not fit 64 bits (about 5 * 10**8 for 64 components, scaled). Vectors of
    different lengths have no score; empty vectors score 0. Rows with the anchor's id are the
    anchor; other ids that repeat count row by row. Anchors that repeat in whole count once. An empty table, or
    one without anchors, gives an empty result; further columns are not read.

    Memory of a task is a block of anchors with their best rows; anchors go through the driver one block
    (``BLOCK_OF_ANCHORS``) at a time. Each block's results are a table in the shared folder.
    """
    spark, names = vectors.sparkSession, (vec_id, label, vector)
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull())
    rows = rows.select(F.col(vec_id).cast("long").alias(vec_id), label, vector, is_anchor.alias("_anchor"))
    chosen = rows.where("_anchor").select(*names).distinct()
    rows = rows.select(*names)
    scratch, results = Scratch(spark, "negatives"), []
    count, blocks = _anchor_blocks(chosen, names)
    for block in blocks:
        block = block.combine_chunks()
        ids = block.column(vec_id).to_numpy()
        column, labels = (block.column(c).combine_chunks() for c in (vector, label))
        flat, starts, sizes, valid = _vectors(column, scale)
        at = np.flatnonzero(valid)
        anchors = AnchorBlock(ids[at], labels.take(pa.array(at)), [flat[starts[k]:starts[k] + sizes[k]] for k in at])
        sent = spark.sparkContext.broadcast(anchors)
        found = _ranked(_pass(rows, names, scale, lambda sent=sent: _Search(sent.value, positives, True)), positives).toArrow()
        a, rank = found.column("anchor").to_numpy(), found.column("rank").to_numpy() - 1
        score, positive = np.zeros((len(at), positives), np.int64), np.zeros((len(at), positives), np.int64)
        # Without a positive, the range is empty.
        least, most = np.ones_like(score), np.zeros_like(score)
        score[a, rank], positive[a, rank] = found.column("score").to_numpy(), found.column("id").to_numpy()
        limits = [(-(-low * int(s) // 100), high * int(s) // 100) for s in score[a, rank]]
        least[a, rank], most[a, rank] = [x for x, _ in limits], [x for _, x in limits]
        ranges = spark.sparkContext.broadcast((least, most))
        best = _ranked(_pass(rows, names, scale, lambda sent=sent, ranges=ranges: _Search(sent.value, negatives, False, *ranges.value)), negatives)
        result = best.mapInArrow(_named(anchors.ids, positive, score), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
        results.append(scratch.table(result, "block") if count > 1 else result)
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out


def _named(ids: np.ndarray, positive: np.ndarray, score: np.ndarray):
    """Ids and scores of anchors and positives in place of their numbers."""
    def task(batches):
        for batch in batches:
            a, j, negative, scored, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("anchor", "range", "id", "score", "rank"))
            arrays = [ids[a], positive[a, j], rank.astype(np.int32), negative, score[a, j], scored]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return task
