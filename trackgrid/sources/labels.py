"""Tracker and detector exchange formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackgrid.functions import geometry as g
from trackgrid.scale import materialize
from trackgrid.schemas import BOX
from trackgrid.sources.frames import by_folder, write_video_lines


def mot_lines(tracks: DataFrame) -> DataFrame:
    """MOT rows: 1-based frame, id, left, top, width, height, confidence 1.0 and three -1."""
    b = g.box()
    line = F.format_string("%d,%d,%.2f,%.2f,%.2f,%.2f,1.0,-1,-1,-1", F.col("frame_idx") + 1, F.col("track_id"),
                           b.x1, b.y1, b.width, b.height)
    return tracks.select("video", "frame_idx", "track_id", line.alias("value"))


def to_mot(tracks: DataFrame, path: str) -> None:
    """MOT files per video in frame and id order; a video that spans several tasks has several ordered part files.

    Lines are made once their rows are in place, so that sampling the ranges makes none.
    """
    held = tracks.select("video", "frame_idx", "track_id", *BOX)
    dealt = held.repartitionByRange("video", "frame_idx", "track_id").sortWithinPartitions("video", "frame_idx", "track_id")
    write_video_lines(mot_lines(dealt).select("video", "value"), path)


def cvat_tracks(tracks: DataFrame) -> DataFrame:
    """One row per track with its boxes in frame order, shaped as the XML's elements.

    The format keeps a track in one element; a track has at most one box per frame.
    """
    fixed = {c: F.format_string("%.2f", c) for c in ("x1", "y1", "x2", "y2")}
    box = F.struct(
        F.col("frame_idx").alias("_frame"), F.lit(0).alias("_outside"), F.lit(0).alias("_occluded"), F.lit(1).alias("_keyframe"),
        fixed["x1"].alias("_xtl"), fixed["y1"].alias("_ytl"), fixed["x2"].alias("_xbr"), fixed["y2"].alias("_ybr"))
    return tracks.groupBy("video", F.col("track_id").alias("_id")).agg(
        F.array_sort(F.collect_list(box)).alias("box")).withColumn("_label", F.lit("object"))


def to_cvat(tracks: DataFrame, path: str) -> None:
    dealt = by_folder(cvat_tracks(tracks).select("video", "_id", "_label", "box"), "video")
    dealt.write.partitionBy("video").format("xml").option(
        "rootTag", "annotations").option("rowTag", "track").save(path)


def yolo_label(b: g.Box, width: Column, height: Column) -> Column:
    return F.format_string("0 %.6f %.6f %.6f %.6f", b.cx / width, b.cy / height, b.width / width, b.height / height)


def yolo_labels(boxes: DataFrame, target: tuple[int, int] | None = None) -> DataFrame:
    """Normalised label lines per image. ``boxes``: split, image, image_width, image_height and a box.

    With ``target`` (S20) boxes are first rescaled to that image size.
    """
    b, w, h = g.box(), F.col("image_width").cast("double"), F.col("image_height").cast("double")
    if target is not None:
        sx, sy = F.lit(float(target[0])) / w, F.lit(float(target[1])) / h
        b, w, h = g.Box(b.x1 * sx, b.y1 * sy, b.x2 * sx, b.y2 * sy), F.lit(float(target[0])), F.lit(float(target[1]))
    return boxes.select("split", "image", yolo_label(b, w, h).alias("value"))


def to_yolo_labels(boxes: DataFrame, path: str) -> None:
    yolo_labels(boxes).repartition("split", "image").write.partitionBy("split", "image").text(path)


def to_darknet_labels(boxes: DataFrame, path: str, target: tuple[int, int] | None = None) -> None:
    """Label files per image, the list of images of each split, and the class name file."""
    yolo_labels(boxes, target).repartition("image").select("image", "value").write.partitionBy("image").text(f"{path}/labels")
    listed = boxes.select("split", F.concat(F.lit("images/"), F.col("image"), F.lit(".jpg")).alias("value")).distinct()
    listed.write.partitionBy("split").text(f"{path}/lists")
    boxes.sparkSession.range(1).select(F.lit("car").alias("value")).write.text(f"{path}/names")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number all rows from 1 in ``order`` without gathering them.

    Rows are range-partitioned and sorted once; each partition is then shifted by the
    rows before it, a table with one row per partition.
    """
    laid = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns(
        {"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}), "number")
    sizes = laid.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_p", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return laid.join(starts, "_p").withColumn(name, F.col("_i") - F.col("_first") + F.col("_before") + 1).drop(
        "_p", "_i", "_first", "_before")


def coco_tables(boxes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories). Image and annotation ids count from 1 in name order over all splits."""
    images = numbered(boxes.select("split", "image", "image_width", "image_height").distinct(), ["split", "image"], "id")
    b = g.box()
    ann = numbered(boxes, ["split", "image", "x1", "y1", "x2", "y2"], "id").join(
        images.select("split", "image", F.col("id").alias("image_id")), ["split", "image"])
    annotations = ann.select(
        "split", "id", "image_id", F.lit(1).alias("category_id"), F.array(b.x1, b.y1, b.width, b.height).alias("bbox"),
        b.area.alias("area"), F.lit(0).alias("iscrowd"))
    files = images.select("split", "id", F.concat("image", F.lit(".jpg")).alias("file_name"),
                          F.col("image_width").alias("width"), F.col("image_height").alias("height"))
    names = boxes.sparkSession.range(1).select(F.lit(1).alias("id"), F.lit("car").alias("name"), F.lit("vehicle").alias("supercategory"))
    return files, annotations, names


def to_coco(boxes: DataFrame, path: str) -> None:
    """COCO sections as JSON lines, one folder per section and split, so no task holds a whole document."""
    images, annotations, categories = coco_tables(boxes)
    images.write.partitionBy("split").json(f"{path}/images")
    annotations.write.partitionBy("split").json(f"{path}/annotations")
    categories.write.json(f"{path}/categories")


def _class_name(class_id: Column) -> Column:
    return F.when(class_id == 0, "car").otherwise(F.concat(F.lit("class_"), class_id.cast("string")))


def read_yolo_labels(spark: SparkSession, path: str, width: float, height: float) -> DataFrame:
    """Label files back to pixel boxes; the image is the file's folder (Darknet files are the same)."""
    part = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path, recursiveFileLookup=True).select(
        F.regexp_extract("_metadata.file_path", r"([^/=]+)/[^/]+$", 1).alias("image"), part.alias("_p")).where(F.size("_p") >= 5)
    v = [F.col("_p")[i].cast("double") for i in range(5)]
    cx, cy, w, h = v[1] * width, v[2] * height, v[3] * width, v[4] * height
    return lines.select("image", _class_name(F.col("_p")[0].cast("int")).alias("class"), (cx - w / 2).alias("x1"),
                        (cy - h / 2).alias("y1"), (cx + w / 2).alias("x2"), (cy + h / 2).alias("y2"))


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """COCO annotations as pixel boxes, from sections as :func:`to_coco` writes them."""
    images = spark.read.schema("id BIGINT, file_name STRING, width INT, height INT").json(f"{path}/images", recursiveFileLookup=True)
    ann = spark.read.schema("id BIGINT, image_id BIGINT, category_id INT, bbox ARRAY<DOUBLE>, area DOUBLE").json(
        f"{path}/annotations", recursiveFileLookup=True)
    names = spark.read.schema("id INT, name STRING").json(f"{path}/categories")
    return _coco_boxes(images, ann, names)


def read_coco_document(spark: SparkSession, path: str) -> DataFrame:
    """COCO annotations as pixel boxes, from one document per file."""
    doc = spark.read.schema(
        "images ARRAY<STRUCT<id: BIGINT, file_name: STRING, width: INT, height: INT>>, "
        "annotations ARRAY<STRUCT<id: BIGINT, image_id: BIGINT, category_id: INT, bbox: ARRAY<DOUBLE>, area: DOUBLE>>, "
        "categories ARRAY<STRUCT<id: INT, name: STRING>>").json(path, multiLine=True)
    return _coco_boxes(doc.select(F.inline("images")), doc.select(F.inline("annotations")), doc.select(F.inline("categories")))


def _coco_boxes(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    named = annotations.join(categories.select(F.col("id").alias("category_id"), "name"), "category_id", "left")
    x, y, w, h = (F.col("bbox")[i] for i in range(4))
    label = F.coalesce("name", F.concat(F.lit("class_"), F.col("category_id").cast("string")))
    return named.join(images.select(F.col("id").alias("image_id"), "file_name"), "image_id").select(
        F.regexp_replace("file_name", r"\.[^.]+$", "").alias("image"), label.alias("class"), x.alias("x1"), y.alias("y1"),
        (x + w).alias("x2"), (y + h).alias("y2"))


def read_labels(spark: SparkSession, path: str, fmt: str, width: float = 0, height: float = 0) -> DataFrame:
    """Labels of any supported format: ``yolo``, ``darknet``, ``coco`` or ``coco_document``."""
    if fmt in ("yolo", "darknet"):
        return read_yolo_labels(spark, path, width, height)
    return {"coco": read_coco, "coco_document": read_coco_document}[fmt](spark, path)
