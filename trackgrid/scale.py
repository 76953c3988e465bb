"""Helpers that keep iterative and ordered operators safe at cluster scale."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LOCAL_FOLDERS: dict[str, str] = {}

#: Width, in order-key units, of one window partition of an ordered operator.
BLOCK = 65536
#: Spark's switch to delete shuffle files at the end of a statement.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local session (tests) may leave it unset; it then gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _LOCAL_FOLDERS:
        folder = tempfile.mkdtemp(prefix="trackgrid-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL_FOLDERS[context.applicationId] = folder
    return _LOCAL_FOLDERS[context.applicationId]


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage by writing ``df`` to the shared folder and scanning it back.

    The written table survives lost executors, gives the planner its real size,
    and is computed once however often the result is used.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    # What was shuffled for the table is of no use once it is written; kept until a collection of garbage it would fill the disks.
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def with_neighbours(
    df: DataFrame,
    keys: list[str],
    order: str,
    columns: list[str],
    *,
    forward: str | None = "next",
    backward: str | None = None,
    later: str | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Add ``<forward>_<col>`` / ``<backward>_<col>`` from the adjacent row of each key.

    ``later`` names a column; ``later_<col>`` is its first value that is not NULL in the rows after.

    ``order`` is a whole number that is unique within a key. The window runs per
    ``(key, order div block)``, so one window partition holds at most ``block``
    rows whatever share of the table a key holds; the few rows at block borders
    are completed from a table with one row per block of the keys that span
    several blocks.
    """
    prefixes = [p for p in (forward, backward) if p]
    # One column that is never NULL identifies a block, so that the window, the borders and the join share one shuffle.
    # It holds the keys, so they are not carried beside it.
    blk = F.floor(F.col(order) / block)
    rest = [c for c in df.columns if c not in keys or c == order]
    part = df.select(F.struct(*[F.col(k).alias(f"_k_{k}") for k in keys], blk.alias("_k_blk")).alias("_block"), *rest)
    # For ``later`` rows run backwards: what is still to come is then a running value.
    w = Window.partitionBy("_block").orderBy(F.col(order).desc() if later else F.col(order))
    payload = F.struct(*[F.col(c).alias(c) for c in columns])
    shift = {forward: F.lag, backward: F.lead} if later else {forward: F.lead, backward: F.lag}
    found = {f"_{p}": shift[p](payload).over(w) for p in prefixes}
    if later:
        found["_later"] = F.last(later, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    ordered = part.withColumns(found)

    # Column by column, so that plain values are aggregated by hash and nothing is sorted for it.
    ends = []
    if forward:
        ends += [F.min_by(c, order).alias(f"_head_{c}") for c in columns]
    if backward:
        ends += [F.max_by(c, order).alias(f"_tail_{c}") for c in columns]
    if later:
        ends.append(F.min_by(later, F.when(F.col(later).isNotNull(), F.col(order))).alias("_first"))
    borders = part.groupBy("_block").agg(*ends)
    wb = Window.partitionBy(*[F.col(f"_block._k_{k}") for k in keys]).orderBy("_block._k_blk")

    def packed(side: str):
        return F.struct(*[F.col(f"_{side}_{c}").alias(c) for c in columns])

    edge = {}
    if forward:
        edge[f"_edge_{forward}"] = F.lead(packed("head")).over(wb)
    if backward:
        edge[f"_edge_{backward}"] = F.lag(packed("tail")).over(wb)
    if later:
        after = Window.partitionBy(*[F.col(f"_block._k_{k}") for k in keys]).orderBy(F.col("_block._k_blk").desc())
        edge["_edge_later"] = F.last("_first", ignorenulls=True).over(after.rowsBetween(Window.unboundedPreceding, -1))
    borders = borders.withColumns(edge)
    borders = borders.where(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in edge]))
    joined = ordered.join(borders.where("_block._k_blk IS NOT NULL").select("_block", *edge), "_block", "left")
    out = [F.col(c) if c in rest else F.col(f"_block._k_{c}").alias(c) for c in df.columns]
    for p in prefixes:
        row = F.coalesce(F.col(f"_{p}"), F.col(f"_edge_{p}"))
        out += [row[c].alias(f"{p}_{c}") for c in columns]
    if later:
        out.append(F.coalesce("_later", "_edge_later").alias(f"later_{later}"))
    return joined.select(*out)


def with_rank(df: DataFrame, keys: list[str], order: str, name: str, block: int = BLOCK) -> DataFrame:
    """Number the rows of each key from 0 in the order of a whole-number column unique within it.

    Rows are numbered inside ``order div block`` and shifted by the rows of the blocks
    before, so no window partition holds more than ``block`` rows.
    """
    part = df.withColumn("_blk", F.floor(F.col(order) / block))
    local = part.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_blk").orderBy(order)) - 1)
    w = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    starts = part.groupBy(*keys, "_blk").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return local.join(starts.drop("_n"), [*keys, "_blk"]).withColumn(name, F.col("_r") + F.col("_start")).drop("_blk", "_r", "_start")


def in_whole_groups(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str) -> DataFrame:
    """Apply ``fn`` to the rows of each key, many small groups in one call.

    Rows are dealt by key, sorted (Spark spills) and read as a stream; ``fn`` gets a batch's whole groups at once and
    has to keep them apart itself. Beyond a batch only the last group is held, so a task needs the memory
    of its largest group, as with one call per group, but pays for calls by the batch.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            # Where the groups of the rows held and of this batch begin; the last group may go on.
            both = pd.concat([held[-1].iloc[-1:], batch], ignore_index=True)[keys] if held else batch[keys]
            changed = np.zeros(len(both) - 1, bool)
            for c in keys:
                a, b = both[c].iloc[1:], both[c].iloc[:-1]
                changed |= ((a.to_numpy() != b.to_numpy()) & ~(a.isna().to_numpy() & b.isna().to_numpy())).astype(bool)
            starts = np.flatnonzero(changed) + (0 if held else 1)
            if len(starts):
                yield fn(pd.concat([*held, batch.iloc[:starts[-1]]], ignore_index=True))
                held, batch = [], batch.iloc[starts[-1]:]
            held.append(batch)
        if held:
            yield fn(pd.concat(held, ignore_index=True))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]):
    """Join condition in which NULL parameters equal each other."""
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[k])
    return on


def renamed(df: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    """Rename ``columns`` by prefixing them."""
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in columns})
