"""Tabular sources and sinks: CSV results, listings, competitor statistics, logs, masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackgrid import schemas

#: File endings of videos.
VIDEO_EXTENSIONS = ("mp4", "avi", "mov", "mkv")


def list_videos(spark: SparkSession, root: str, extensions: tuple[str, ...] = VIDEO_EXTENSIONS,
                layout: str = r"([^/]+)/([^/]+)/([^/]+)$") -> DataFrame:
    """(dataset, videoset, video) of the video files below ``root/<dataset>/<videoset>``; contents are not read."""
    glob = "*.{" + ",".join(extensions) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select(*[F.regexp_extract("path", layout, i).alias(c) for i, c in ((1, "dataset"), (2, "videoset"), (3, "video"))])


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, declared schema and empty fields as NULL."""
    return spark.read.schema(schema).csv(path, header=True, nullValue="")


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    df.write.partitionBy(*(by or [])).csv(path, header=True, nullValue="")


def read_results_glob(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Every results table matching a glob, with the dataset named by its folder."""
    rows = spark.read.schema(schema).csv(pattern, header=True, nullValue="")
    return rows.withColumn("dataset", F.regexp_extract("_metadata.file_path", r"([^/=]+)/[^/]+$", 1))


_COMPETITOR = ["param_id", "detector_cfg", "segmentation_cfg", "tracker_cfg", "runtime"]


def normalize_competitor_stats(df: DataFrame, kind: str) -> DataFrame:
    """Competitor runtimes as (param_id, configurations, runtime).

    ``indexed``: an unnamed index column is the param_id and ``runtime`` or
    ``runtime_total`` the time; ids are unique. ``total``: exactly one row is named
    ``total`` and its runtime is ``inference_total`` - ``decode``.
    """
    if kind == "indexed":
        for name in ("Unnamed: 0", "_c0"):
            if name in df.columns:
                df = df.withColumnRenamed(name, "param_id")
        time = "runtime" if "runtime" in df.columns else "runtime_total"
        copies = F.count("*").over(Window.partitionBy("param_id"))
        return df.withColumns({"param_id": F.col("param_id").cast("int"), "runtime": F.col(time)}).withColumn("_n", copies).where(
            F.assert_true(F.col("_n") == 1, "param_id is not unique").isNull()).select(*_COMPETITOR)
    total = df.where("video_name = 'total'").withColumn("_n", F.count("*").over(Window.partitionBy("video_name")))
    one = total.where(F.assert_true(F.col("_n") == 1, "expected one total row").isNull())
    return one.select(F.lit(0).alias("param_id"), *[F.lit(None).cast("string").alias(c) for c in _COMPETITOR[1:4]],
                      (F.col("inference_total") - F.col("decode")).alias("runtime"))


def read_training_logs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(epochs, steps) of training runs in folders ``<video>/training/results/<classifier>_<tilesize>``.

    Epochs: one row per entry of ``train_losses.json`` / ``test_losses.json``; steps:
    one row per timing in ``throughput_per_epoch.jsonl``.
    """
    where = r"([^/]+)/training/results/(.+)_([0-9]+)/[^/]+$"
    keys = [F.regexp_extract("_metadata.file_path", where, i).alias(c) for i, c in ((1, "video"), (2, "classifier"), (3, "tilesize"))]

    def files(glob: str, whole: bool) -> DataFrame:
        return spark.read.text(path, wholetext=whole, recursiveFileLookup=True, pathGlobFilter=glob)

    epochs = files("*_losses.json", True).select(
        *keys, F.regexp_extract("_metadata.file_name", "^(train|test)", 1).alias("split"),
        F.explode(F.from_json("value", "array<struct<loss:double,accuracy:double,time:double>>")).alias("_e"))
    steps = files("throughput_per_epoch.jsonl", False).where(F.trim("value") != "").select(
        *keys, F.explode(F.from_json("value", schemas.TIMINGS)).alias("_s"))
    size = F.col("tilesize").cast("int")
    return (epochs.select("video", "classifier", size.alias("tilesize"), "split", "_e.*"),
            steps.select("video", "classifier", size.alias("tilesize"), "_s.*"))


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """Include rectangle and exclude polygons of each annotated image.

    The rectangle is the box labelled ``crop-area``, else ``crop``, else the first one.
    """
    shape = ("_name STRING, box ARRAY<STRUCT<_label: STRING, _xtl: DOUBLE, _ytl: DOUBLE, _xbr: DOUBLE, _ybr: DOUBLE>>, "
             "polygon ARRAY<STRUCT<_label: STRING, _points: STRING>>")
    images = spark.read.format("xml").option("rowTag", "image").schema(shape).load(path)

    def labelled(name: str):
        return F.try_element_at(F.filter("box", lambda b: b["_label"] == name), F.lit(1))

    rect = F.coalesce(labelled("crop-area"), labelled("crop"), F.try_element_at("box", F.lit(1)))

    def points(text):
        return F.transform(F.split(text, ";"), lambda p: F.struct(
            F.split(p, ",")[0].cast("double").alias("x"), F.split(p, ",")[1].cast("double").alias("y")))

    return images.select(
        F.col("_name").alias("image"), F.struct(rect["_xtl"].alias("x1"), rect["_ytl"].alias("y1"),
                                                rect["_xbr"].alias("x2"), rect["_ybr"].alias("y2")).alias("rect"),
        F.transform("polygon", lambda p: F.struct(p["_label"].alias("label"), points(p["_points"]).alias("points"))).alias("polygons"))


def mask_of(masks: DataFrame) -> tuple[tuple | None, list[list[tuple[float, float]]]]:
    """The rectangle and polygons of a one-image mask file, as values for the clip and polygon filters."""
    found = masks.take(2)
    if len(found) > 1:
        raise ValueError("the mask file holds more than one image")
    if not found:
        return None, []
    row = found[0]
    rect = None if row.rect.x1 is None else tuple(row.rect)
    return rect, [[(p.x, p.y) for p in poly.points] for poly in (row.polygons or [])]


def write_annotations(df: DataFrame, path: str) -> None:
    """Nested annotation entries as JSON lines."""
    df.write.json(path)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ANNOTATION_FILE).json(path)
