"""Declared schemas: nothing is inferred from files."""

from __future__ import annotations

from pyspark.sql import types as T

BOX = ["x1", "y1", "x2", "y2"]
FRAME = ["video", "frame_idx"]

#: Parameters of a variant; NULL is a value ("not used"), matched null-safely.
PARAMS = [
    "classifier",
    "tilesize",
    "sample_rate",
    "tracking_accuracy_threshold",
    "tilepadding",
    "canvas_scale",
    "tracker",
]
VARIANT_KEYS = ["dataset", "videoset", "variant", "variant_id"]
MATCH_COLUMNS = ["variant_id", *PARAMS]

BOXES = T.ArrayType(T.ArrayType(T.DoubleType()))
TIMINGS = "array<struct<op:string,time:double>>"

DETECTION_FILE = "frame_idx INT, detections ARRAY<ARRAY<DOUBLE>>"
UNPACKED_FILE = "frame_idx INT, bboxes ARRAY<ARRAY<DOUBLE>>"
CANVAS_FILE = "image_file STRING, bboxes ARRAY<ARRAY<DOUBLE>>"
TRACK_FILE = "frame_idx INT, tracks ARRAY<ARRAY<DOUBLE>>"
SCORE_FILE = "classification_size ARRAY<INT>, classification_hex STRING, idx INT"
FRAME_OBJECT = (
    "array<struct<left:double,top:double,right:double,bottom:double,"
    "class:string,score:double,track_id:bigint>>"
)
ANNOTATION_FILE = (
    "dataset STRING, video STRING, image_path STRING, image_width INT, image_height INT, "
    "annotations ARRAY<STRUCT<bbox: ARRAY<DOUBLE>, class: STRING, frame_idx: INT, track_id: BIGINT>>"
)
TRADEOFF_FILE = (
    "dataset STRING, videoset STRING, variant STRING, variant_id STRING, classifier STRING, "
    "tilesize INT, sample_rate INT, tracking_accuracy_threshold DOUBLE, tilepadding STRING, "
    "canvas_scale DOUBLE, tracker STRING, frame_count BIGINT, time DOUBLE, "
    "throughput_fps DOUBLE, HOTA_HOTA DOUBLE"
)
ACCURACY_FILE = (
    "dataset STRING, videoset STRING, variant STRING, variant_id STRING, classifier STRING, "
    "tilesize INT, sample_rate INT, tracking_accuracy_threshold DOUBLE, tilepadding STRING, "
    "canvas_scale DOUBLE, tracker STRING, HOTA_HOTA DOUBLE"
)
TRAINING_LOG = (
    "classifier STRING, tilesize INT, run STRING, epoch INT, train_loss DOUBLE, val_loss DOUBLE, "
    "accuracy DOUBLE, timings ARRAY<STRUCT<op: STRING, time: DOUBLE>>"
)
