"""Structured Streaming forms of the per-frame stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from trackgrid.sources.frames import _folder_name, _store

#: State store for queries whose state outgrows memory.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_detections(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet",
                      max_files: int | None = None) -> DataFrame:
    """File source of detections; ``max_files`` bounds what a micro-batch takes in."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def with_event_time(df: DataFrame, start: str, fps: float) -> DataFrame:
    """Event time of a frame: recording start plus frame index over frame rate."""
    return df.withColumn("ts", F.timestamp_micros(
        F.unix_micros(F.lit(start).cast("timestamp")) + (F.col("frame_idx") * (1e6 / fps)).cast("bigint")))


def frame_counts(stream: DataFrame, width: str, slide: str | None = None, late: str = "1 minute",
                 by: list[str] | None = None) -> DataFrame:
    """Objects per tumbling or sliding window; rows later than ``late`` are dropped by the watermark."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.withWatermark("ts", late).groupBy(window, *(by or [])).agg(F.count("*").alias("objects")).select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), *(by or []), "objects")


def track_sessions(stream: DataFrame, gap: str, keys: list[str], late: str = "1 minute") -> DataFrame:
    """Lifetimes of tracks: a track ends when it is not seen for ``gap``."""
    session = F.session_window("ts", gap)
    return stream.withWatermark("ts", late).groupBy(session, *keys).agg(F.count("*").alias("hits")).select(
        *keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "hits")


#: Groups whose state travels together: tracks are many and small, and every call of a group costs far more than its rows.
TRACK_GROUPS = 4096
_TRACK_STATE = ["video", "track_id", "nulls", "seen", "last"]


def _confirm(min_hits: int, max_age_ms: int):
    """Counts the hits of a group's tracks; reports one when it has enough, forgets it when it stays away."""
    def count(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = np.frombuffer(state.get[0], "int64").reshape(len(_TRACK_STATE), -1) if state.exists else np.zeros((len(_TRACK_STATE), 0), "int64")
        done = []
        for batch in [] if state.hasTimedOut else rows:
            held, found = _count_hits(held, batch, min_hits, max_age_ms)
            done.append(found)
        held = held[:, held[4] + max_age_ms >= state.getCurrentWatermarkMs()]
        if held.shape[1]:
            state.update((np.ascontiguousarray(held).tobytes(),))
            state.setTimeoutTimestamp(max(int(held[4].min()) + max_age_ms, state.getCurrentWatermarkMs(), 1))
        elif state.exists:
            state.remove()
        if sum(map(len, done)):
            yield pd.concat(done).drop_duplicates(["video", "track_id"], keep="last")

    return count


def _count_hits(held: np.ndarray, batch: pd.DataFrame, min_hits: int, max_age_ms: int) -> tuple[np.ndarray, pd.DataFrame]:
    """State of the tracks after a batch's rows, and the tracks that got their ``min_hits`` in it, all tracks at once."""
    own = batch[_TRACK_STATE[:3]].to_numpy("int64")
    ms = batch["ts"].to_numpy().astype("datetime64[ms]").astype("int64")
    tracks, at = np.unique(np.concatenate([held[:3].T, own]), axis=0, return_inverse=True)
    at = at.reshape(-1)
    n = held.shape[1]
    seen, last = np.zeros(len(tracks), "int64"), np.full(len(tracks), -1, "int64")
    seen[at[:n]], last[at[:n]] = held[3], held[4]
    at = at[n:]
    order = np.lexsort((ms, at))
    at, ms = at[order], ms[order]
    place, first = np.arange(len(at)), np.concatenate([[True], at[1:] != at[:-1]])
    start = np.maximum.accumulate(np.where(first, place, 0))
    # Hits of a track are in order of time, so the latest one so far is the one before or that of the state.
    before = np.maximum(last[at], np.where(first, -1, np.concatenate([[-1], ms[:-1]])))
    fresh = (before >= 0) & (ms > before + max_age_ms)
    since = np.maximum.accumulate(np.where(fresh | first, place, 0))
    hits = place - since + 1 + np.where(fresh[since], 0, seen[at])
    ends = np.flatnonzero(np.concatenate([at[1:] != at[:-1], [True]]))
    done = np.flatnonzero(hits == min_hits)
    # Of several times in one batch the latest counts.
    done = done[np.concatenate([at[done][1:] != at[done][:-1], [True]])] if len(done) else done
    seen[at[ends]], last[at[ends]] = hits[ends], np.maximum(before[ends], ms[ends])
    keys = tracks[at[done]]
    found = pd.DataFrame({
        "video": pd.array(keys[:, 0], "Int64"), "track_id": pd.array(keys[:, 1], "Int64"), "confirmed_at": ms[done].astype("datetime64[ms]")})
    found.loc[(keys[:, 2] & 1) > 0, "video"] = pd.NA
    found.loc[(keys[:, 2] & 2) > 0, "track_id"] = pd.NA
    return np.vstack([tracks.T, seen, last]), found


def confirm_tracks(stream: DataFrame, min_hits: int, max_age_ms: int, late: str = "1 minute") -> DataFrame:
    """Tracks (video, track_id) once they have ``min_hits`` hits without a gap over ``max_age_ms``.

    State is five numbers per live track. The tracks of a group travel together with the batch's rows, and those that stayed
    away are dropped by an event-time timeout. RocksDB keeps large state off the heap.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    # Ids that are NULL are tracks too; numbers and marks keep every id exact.
    nulls = F.when(F.col("video").isNull(), 1).otherwise(0) + F.when(F.col("track_id").isNull(), 2).otherwise(0)
    zero = F.lit(0).cast("bigint")
    keyed = stream.withWatermark("ts", late).select(
        F.pmod(F.xxhash64("video", "track_id"), F.lit(TRACK_GROUPS)).alias("_group"), F.coalesce(F.col("video").cast("bigint"), zero).alias("video"),
        F.coalesce(F.col("track_id").cast("bigint"), zero).alias("track_id"), nulls.cast("bigint").alias("nulls"), "ts").groupBy("_group")
    return keyed.applyInPandasWithState(
        _confirm(min_hits, max_age_ms), "video bigint, track_id bigint, confirmed_at timestamp", "tracks binary",
        "append", GroupStateTimeout.EventTimeTimeout)


def drop_replayed(stream: DataFrame, keys: list[str], late: str = "1 minute") -> DataFrame:
    """Frames sent again within the watermark are dropped."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def runtime_totals(stream: DataFrame) -> DataFrame:
    """Running seconds and operations per stage, for update mode."""
    return stream.groupBy("stage", "op").agg(F.sum("time").alias("time"), F.count("*").alias("count"))


def _table(spark: SparkSession, path: str, schema: StructType, epoch: int) -> DataFrame:
    """What the batches before ``epoch`` wrote to a folder per batch; a replayed batch does not see its own first try."""
    written = StructType([*schema, StructField("batch", LongType())])
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], written)
    return spark.read.schema(written).parquet(path).where(F.col("batch") < epoch)


def _leave(pending: str, videos: DataFrame) -> None:
    """Delete the pending folders of videos whose batch is committed. Tasks do it, so names don't pass through the driver."""
    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(pending)
        gone, held = 0, None
        for batch in batches:
            if held is None:
                held = [f.path for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.base_name.startswith("batch=")]
            folders = [f"{b}/video={_folder_name(video)}" for video in batch.column(0).to_pylist() for b in held]
            for found in store.get_file_info(folders):
                if found.type == fs.FileType.Directory:
                    store.delete_dir(found.path)
                    gone += 1
        yield pa.RecordBatch.from_pydict({"gone": pa.array([gone], pa.int64())})

    parts = int(videos.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = videos.where("video IS NOT NULL").select(F.col("video").cast("string")).repartition(parts, "video")
    named.mapInArrow(delete, "gone bigint").agg(F.sum("gone")).collect()


def on_video_end(stream: DataFrame, process: Callable[[DataFrame], DataFrame], *, pending: str, sink: str, finished: str, late: str,
                 checkpoint: str, max_idle: int | None = None) -> StreamingQuery:
    """Barrier per video: keep rows until a video's end marker, then process the whole video, once.

    The stream has ``video``, ``is_end`` and the frame columns. Rows are appended to ``pending`` in a folder per
    batch and video. A video ends with its marker or, with ``max_idle``, once that many batches have
    passed without a row of it. Its rows of all batches are then read back by a join that prunes to its
    folders, processed, and written to ``sink``; ``finished`` lists it from then on. Further markers of a finished
    video do nothing; further rows of it go to ``late``, unprocessed. Its pending folders are deleted in the
    batch after, when its own is committed for certain.

    Every table has a folder per batch, and a batch reads only those before it, so a batch that is
    replayed after a failure writes the same again in place of its first try. Runs over what has arrived.
    """
    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        names = StructType([batch.schema["video"]])
        done = _table(spark, finished, names, epoch).select("video", "batch")
        _leave(pending, done.where(F.col("batch") == epoch - 1).select("video"))
        over = done.select("video").distinct()
        rows, schema = batch.where("NOT is_end").drop("is_end"), batch.drop("is_end").schema
        # Dealt by video, so that a video gets one file and not one from every task; the number keeps the many folders in many tasks.
        # Tasks put their files in place themselves: nothing reads the folder of a batch whose write did not end, it is written again.
        fresh = rows.join(over, "video", "left_anti").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "video")
        fresh.write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("video").parquet(f"{pending}/batch={epoch}")
        rows.join(over, "video", "left_semi").write.mode("overwrite").parquet(f"{late}/batch={epoch}")
        kept = _table(spark, pending, schema, epoch + 1)
        ended = batch.where("is_end").select("video")
        if max_idle is not None:
            idle = kept.groupBy("video").agg(F.max("batch").alias("last")).where(F.col("last") <= epoch - max_idle)
            ended = ended.union(idle.select("video"))
        ended = ended.distinct().join(over, "video", "left_anti")
        ended.write.mode("overwrite").parquet(f"{finished}/batch={epoch}")
        ended = spark.read.schema(names).parquet(f"{finished}/batch={epoch}")
        process(kept.select(schema.names).join(ended, "video", "left_semi")).write.mode("overwrite").parquet(f"{sink}/batch={epoch}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tracks_sink(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished tracks to a Parquet table, one folder per batch so that a retry replaces itself."""
    def handle(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).start()


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run over what has arrived and stop. Append writes files; update keeps the newest row per batch folder."""
    if mode == "append":
        return stream.writeStream.format("parquet").outputMode("append").option("path", path).option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def handle(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(path)

    return stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()
