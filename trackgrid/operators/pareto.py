"""Pareto fronts, pruning and interpolation."""

from __future__ import annotations

from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _best_so_far(group: list[str], minimize_x: bool, minimize_y: bool) -> Column:
    order = F.col("_x").asc() if minimize_x else F.col("_x").desc()
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (F.min if minimize_y else F.max)("_y").over(w)


def _front_steps(points: DataFrame, group: list[str], min_x: bool, min_y: bool) -> DataFrame:
    best = points.withColumn("_best", _best_so_far(group, min_x, min_y))
    good = F.col("_y") <= F.col("_best") if min_y else F.col("_y") >= F.col("_best")
    return best.where(F.col("_best").isNull() | good).drop("_best")


def pareto_front(df: DataFrame, x: str, y: str, *, min_x: bool, min_y: bool, by: list[str] | None = None,
                 lanes: int = 32) -> DataFrame:
    """Rows not beaten on both axes, per ``by`` group (NULL is a group); rows without x or y are dropped.

    Sweeping from the best x, a row stays when its y is at least as good as the best
    y seen before; among equal x only the best y stays, with all its ties.

    Equal x values are first reduced to their best y by a partial aggregation. Each
    of ``lanes`` random slices of a group then keeps its own front, and only these
    survivors meet in the group's final sweep. A point beaten in its slice is beaten
    in the whole, so the result is exact while no task sorts a whole group.
    """
    by = by or []
    clean = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()
                     & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_s{i}") for i, c in enumerate(by)]
    nulls = [F.col(c).isNull().alias(f"_n{i}") for i, c in enumerate(by)]
    group = [f"_s{i}" for i in range(len(by))] + [f"_n{i}" for i in range(len(by))]
    marked = clean.select("*", *keys, *nulls, F.col(x).alias("_x"), F.col(y).alias("_y"))
    steps = marked.groupBy(*group, "_x").agg((F.min if min_y else F.max)("_y").alias("_y"))
    laned = steps.withColumn("_lane", F.pmod(F.xxhash64("_x"), F.lit(lanes)))
    local = _front_steps(laned, [*group, "_lane"], min_x, min_y).drop("_lane")
    front = _front_steps(local, group, min_x, min_y)
    return marked.join(front, [*group, "_x", "_y"], "left_semi").select(*df.columns)


#: The three metric pairs whose fronts are flagged, with their directions.
FLAG_PAIRS = {
    "pareto_mistrack_retention": ("mistrack_rate", "retention_rate", True, True),
    "pareto_retention_hota": ("retention_rate", "HOTA_HOTA", True, False),
    "pareto_mistrack_hota": ("mistrack_rate", "HOTA_HOTA", True, False),
}


def pareto_flags(df: DataFrame, key: str = "grid_key", by: list[str] | None = None) -> DataFrame:
    """Flag the frontier rows of each metric pair among ``method = 'exhaustive'``."""
    by = by or []
    rows = df.where("method = 'exhaustive'")
    out = df
    for name, (x, y, min_x, min_y) in FLAG_PAIRS.items():
        front = pareto_front(rows, x, y, min_x=min_x, min_y=min_y, by=by)
        marks = front.select(*by, key).distinct().withColumn(name, F.lit(True))
        out = out.join(marks, [*by, key], "left").withColumn(
            name, (F.col("method") == "exhaustive") & F.coalesce(F.col(name), F.lit(False)))
    return out


def _flattest(x: np.ndarray, y: np.ndarray, keep: int) -> np.ndarray:
    """Positions left after repeatedly removing the widest-angle interior point."""
    def unit(v: np.ndarray) -> np.ndarray:
        span = v.max() - v.min()
        return (v - v.min()) / (span if span > 0 else 1.0)

    px, py = unit(x.astype(float)), unit(y.astype(float))

    def angle(i, before, after):
        back, ahead = (px[before] - px[i], py[before] - py[i]), (px[after] - px[i], py[after] - py[i])
        size = np.sqrt(back[0] * back[0] + back[1] * back[1]) * np.sqrt(ahead[0] * ahead[0] + ahead[1] * ahead[1])
        return np.where(size > 0, (back[0] * ahead[0] + back[1] * ahead[1]) / np.where(size > 0, size, 1.0), -1.0)

    n = len(px)
    inner = np.arange(1, n - 1)
    cos = np.r_[np.nan, angle(inner, inner - 1, inner + 1), np.nan]
    before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), np.ones(n, bool)
    widest = [(c, i) for i, c in zip(inner.tolist(), cos[1:-1].tolist())]
    heapify(widest)
    # A removal changes its two neighbours only; their old entries no longer agree with ``cos`` and are passed over.
    left = n
    while left > max(keep, 2):
        c, i = heappop(widest)
        if not alive[i] or c != cos[i]:
            continue
        alive[i] = False
        left -= 1
        a, b = before[i], after[i]
        after[a], before[b] = b, a
        for k in (a, b):
            if 0 < k < n - 1:
                cos[k] = angle(k, before[k], after[k])
                heappush(widest, (float(cos[k]), k))
    return np.flatnonzero(alive)


def pareto_prune(front: DataFrame, x: str, y: str, points: int, *, min_x: bool, by: list[str]) -> DataFrame:
    """Thin each group's front to ``points`` rows, dropping the most collinear first; endpoints stay.

    A group here is a front, at most one row per distinct parameter set of the
    configured grid, so its size is bounded by configuration and not by the data.
    The removals of one front depend on each other; fronts are independent. A heap of angles makes a front of
    n rows cost n log n.
    """
    columns = front.columns

    def thin(batch: pd.DataFrame) -> pd.DataFrame:
        ordered = batch.sort_values([x, y], ascending=[not min_x, True], kind="stable").reset_index(drop=True)
        if len(ordered) <= points:
            return ordered[columns]
        return ordered.iloc[_flattest(ordered[x].to_numpy(), ordered[y].to_numpy(), points)][columns]

    return front.groupBy(*by).applyInPandas(thin, front.schema)


def interp_at(df: DataFrame, queries: DataFrame, x: str, y: str, by: list[str], extrapolate: bool = False,
              blocks: int = 32) -> DataFrame:
    """Piecewise-linear ``y`` at ``query_point``; NULL outside the range unless clamped by ``extrapolate``.

    Queries and curve points of a group share ordered windows over blocks of the axis,
    so the enclosing segment is found without pairing queries with segments and
    without sorting a whole group in one task. Each group's axis is cut at its own
    quantiles, a partial aggregation; nothing runs while the query is planned.
    """
    curve = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).cast("double").alias("_x")).agg(
        F.max(F.col(y).cast("double")).alias("_y"))
    asked = queries.select(*by, F.col("query_point").cast("double").alias("_x"), F.lit(None).cast("double").alias("_y"),
                           F.lit(True).alias("_q"))
    line = curve.withColumn("_q", F.lit(False)).unionByName(asked)
    # Any cuts give the same result; quantiles make the blocks even. Each block also gets the nearest curve points outside it.
    cuts = line.groupBy(*[F.col(c).alias(f"_k_{c}") for c in by]).agg(
        F.percentile_approx("_x", [i / blocks for i in range(1, blocks)], 1000).alias("_cuts"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by], F.lit(True))
    blk = F.size(F.coalesce(F.filter("_cuts", lambda c: F.col("_x") > c), F.array()))
    line = line.join(cuts, same).withColumn("_blk", blk).drop("_cuts", *[f"_k_{c}" for c in by])
    point = F.when(~F.col("_q"), F.struct("_x", "_y"))
    ends = line.groupBy(*by, "_blk").agg(F.max(point).alias("_hi"), F.min(point).alias("_lo"))
    over = Window.partitionBy(*by).orderBy("_blk")
    ends = ends.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_blk").alias("_k_blk"),
                       F.last("_hi", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
                       F.first("_lo", True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    w = Window.partitionBy(*by, "_blk").orderBy("_x", "_q")
    back = F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    wr = Window.partitionBy(*by, "_blk").orderBy(F.col("_x").desc(), F.col("_q"))
    ahead = F.last(point, ignorenulls=True).over(wr.rowsBetween(Window.unboundedPreceding, 0))
    placed = line.withColumns({"_a": back, "_b": ahead}).where("_q")
    on = F.col("_blk") == F.col("_k_blk")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    placed = placed.join(ends, on)
    a, b, q = F.coalesce("_a", "_before"), F.coalesce("_b", "_after"), F.col("_x")
    inner = F.when(a["_x"] == b["_x"], a["_y"]).otherwise(
        a["_y"] + (b["_y"] - a["_y"]) * (q - a["_x"]) / F.nullif(b["_x"] - a["_x"], F.lit(0.0)))
    value = F.when(a.isNotNull() & b.isNotNull(), inner)
    if extrapolate:
        value = F.coalesce(value, a["_y"], b["_y"])
    return placed.select(*by, F.col("_x").alias("query_point"), value.alias("interpolated_value"))


def _grid(df: DataFrame, top: Column, step: float) -> DataFrame:
    """Query points 0, step, 2*step ... up to the first one at or past ``top``."""
    n = F.ceil(top / step + 1 - 1e-9).cast("bigint")
    return df.withColumn("query_point", F.explode(F.transform(
        F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: i.cast("double") * step)))


def speedup_at_accuracy(ours: DataFrame, others: DataFrame, accuracy: str, time: str = "time",
                        increment: float = 0.02) -> DataFrame:
    """other time / our time at evenly spaced accuracies; NULL outside either system's range.

    ``others`` carries ``system``; both carry ``dataset``.
    """
    tops = ours.where(F.col(time).isNotNull()).groupBy("dataset").agg(
        F.least(F.lit(1.0), F.max(accuracy)).alias("_top"))
    levels = _grid(tops.where("_top IS NOT NULL"), F.col("_top"), increment).drop("_top")
    pairs = levels.join(others.select("dataset", "system").distinct(), "dataset")
    mine = interp_at(ours.where(F.col(time).isNotNull()), levels, accuracy, time, ["dataset"])
    their = interp_at(others.where(F.col(time).isNotNull()), pairs, accuracy, time, ["dataset", "system"])
    both = their.withColumnRenamed("interpolated_value", "other_time").join(
        mine.withColumnRenamed("interpolated_value", "our_time"), ["dataset", "query_point"])
    return both.select(
        "dataset", F.col("query_point").alias("accuracy_level"), F.upper("system").alias("comparison_system"),
        (F.col("other_time") / F.nullif(F.col("our_time"), F.lit(0.0))).alias("speedup_ratio"),
        "our_time", "other_time")


def gain_at_runtime(ours: DataFrame, others: DataFrame, accuracy: str, time: str = "time",
                    increment: float = 50.0) -> DataFrame:
    """our accuracy - other accuracy at evenly spaced runtimes; NULL outside either range."""
    tops = ours.select("dataset", time, F.lit(True).alias("_o")).unionByName(
        others.select("dataset", time, F.lit(False).alias("_o"))).groupBy("dataset").agg(
        F.max(time).alias("_top"), F.bool_or("_o").alias("_ours"))
    levels = _grid(tops.where("_ours AND _top IS NOT NULL"), F.col("_top"), increment).drop("_top", "_ours")
    pairs = levels.join(others.select("dataset", "system").distinct(), "dataset")
    mine = interp_at(ours, levels, time, accuracy, ["dataset"])
    their = interp_at(others, pairs, time, accuracy, ["dataset", "system"])
    both = their.withColumnRenamed("interpolated_value", "other_accuracy").join(
        mine.withColumnRenamed("interpolated_value", "our_accuracy"), ["dataset", "query_point"])
    return both.select(
        "dataset", F.col("query_point").alias("runtime_level"), F.upper("system").alias("comparison_system"),
        (F.col("our_accuracy") - F.col("other_accuracy")).alias("accuracy_gain"), "our_accuracy", "other_accuracy")
