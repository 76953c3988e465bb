"""Named choices: association measures, trackers and runtime log shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackgrid.functions import geometry as g
from trackgrid.schemas import TIMINGS

#: Box similarity by name, larger is better. ``ct_dist`` is relative to its frame and made by ``joins.iou_join``.
ASSOCIATION = {
    "iou": g.iou,
    "iou_plus1": g.iou_plus1,
    "giou": g.giou,
    "diou": g.diou,
    "ciou": g.ciou,
}


def _list(text: Column) -> Column:
    """A log line that is a list of timings or a single timing."""
    many = F.from_json(text, TIMINGS)
    one = F.array(F.from_json(text, "op string, time double"))
    return F.when(F.ltrim(text).startswith("["), many).otherwise(one)


def _last(text: Column) -> Column:
    """The timings are the last element of the line's array."""
    return F.from_json(F.element_at(F.from_json(text, "array<string>"), -1), TIMINGS)


def _runtime(text: Column) -> Column:
    """The timings are the field ``runtime``."""
    return _list(F.get_json_object(text, "$.runtime"))


#: Which part of a log line holds the timings, by stage.
RUNTIME_SHAPE = {
    "011_tune_detect": _last,
    "012_tune_create_training_data": _list,
    "013_tune_train_classifier": _list,
    "001_preprocess_groundtruth_detection": _list,
    "002_preprocess_groundtruth_tracking": _runtime,
    "020_exec_classify": _list,
    "022_exec_prune_polyominoes": _runtime,
    "030_exec_compress": _runtime,
    "040_exec_detect": _list,
    "050_exec_uncompress": _list,
    "060_exec_track": _runtime,
}


def tracker(name: str, **overrides):
    """Linking operator by name: a function of a detections table."""
    from trackgrid.operators import linking

    # Default parameters of each tracker.
    defaults = {
        "sort": (linking.link_tracks, {"max_age": 20, "min_hits": 1, "min_iou": 0.1}),
        "bytetrack": (linking.link_tracks_two_stage, {"high": 0.5, "match_thresh": 0.8, "max_age": 20}),
        "ocsort": (linking.link_tracks_direction,
                   {"high": 0.3, "max_age": 20, "min_hits": 1, "min_iou": 0.1, "delta_t": 3, "inertia": 0.2}),
    }
    if name not in defaults:
        raise ValueError(f"unknown tracker {name}")
    function, params = defaults[name]
    return lambda detections: function(detections, **{**params, **overrides})
