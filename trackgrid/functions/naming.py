"""Names and identifiers of variants, videos and configurations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scale_to_percent(scale: Column) -> Column:
    return F.bround(scale * 100, 0).cast("int")


def format_threshold(threshold: Column) -> Column:
    """0.4 -> ``040``."""
    return F.lpad(F.bround(threshold * 100, 0).cast("int").cast("string"), 3, "0")


def param_str(classifier: Column, tilesize: Column, sample_rate: Column, threshold: Column,
              tilepadding: Column, canvas_scale: Column, tracker: Column) -> Column:
    """``_``-joined identifier; unset parts are left out."""
    return F.concat_ws(
        "_", classifier, tilesize.cast("string"), sample_rate.cast("string"),
        format_threshold(threshold), tilepadding,
        F.concat(F.lit("s"), scale_to_percent(canvas_scale).cast("string")), tracker,
    )


def parse_param_str(ident: Column) -> dict[str, Column]:
    """The seven fields of a parameter identifier, as columns by name."""
    parts = F.split(ident, "_")

    def at(i: Column) -> Column:
        return F.coalesce(F.try_element_at(parts, i.cast("int")), F.lit(""))

    rate_at = F.lit(3)
    has_rate = at(rate_at).rlike("^[0-9]+$")
    thr_at = F.when(has_rate, 4).otherwise(3)
    has_thr = at(thr_at).rlike("^[0-9]{3}$")
    rest_at = thr_at + F.when(has_thr, 1).otherwise(0)
    rest = F.when(F.size(parts) >= rest_at,
                  F.slice(parts, rest_at.cast("int"), F.greatest(F.lit(0), F.size(parts) - rest_at + 1)))
    rest = F.coalesce(rest, F.array().cast("array<string>"))
    scale_tokens = F.filter(F.transform(rest, lambda t, i: F.when(t.rlike("^s[0-9]+$"), i)),
                            lambda i: i.isNotNull())
    scale_at = F.try_element_at(scale_tokens, F.lit(1))
    after = F.when(scale_at.isNotNull(),
                   F.slice(rest, F.coalesce(scale_at, F.lit(0)) + 2, F.size(rest))).otherwise(rest)
    return {
        "classifier": at(F.lit(1)),
        "tilesize": at(F.lit(2)).try_cast("int"),
        "sample_rate": F.when(has_rate, at(rate_at)).try_cast("int"),
        "tracking_accuracy_threshold": F.when(has_thr, at(thr_at)).try_cast("int") / 100.0,
        "tilepadding": F.when(scale_at > 0, F.try_element_at(rest, F.lit(1))),
        "canvas_scale": F.substring(F.try_element_at(rest, scale_at + 1), 2, 9).try_cast("int") / 100.0,
        "tracker": F.when(F.size(after) > 0, F.array_join(after, "_")),
    }


def encode_rate_grid(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda v: v.cast("string")), "-")


def decode_rate_grid(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, "-"), lambda t: t != ""), lambda t: t.cast("int"))


def threshold_slug(percent: Column) -> Column:
    """30.5 -> ``030p5``; whole percentages carry no decimal."""
    tenths = F.bround(percent * 10, 0).cast("bigint")
    whole = F.lpad(F.floor(tenths / 10).cast("string"), 3, "0")
    return F.when(tenths % 10 == 0, whole).otherwise(
        F.concat(whole, F.lit("p"), (tenths % 10).cast("string")))


def grid_variant_id(method: Column, grid: Column, threshold_pct: Column | None = None) -> Column:
    if threshold_pct is None:
        return F.concat_ws("_", method, encode_rate_grid(grid))
    return F.concat_ws("_", method, F.concat(F.lit("t"), threshold_slug(threshold_pct)),
                       encode_rate_grid(grid))


def dataset_root(dataset: Column) -> Column:
    """Detector variants (``name-detector``) share one root."""
    return F.when(dataset.startswith("ams"), F.lit("ams")).otherwise(F.substring_index(dataset, "-", 1))


def competitor_dataset(dataset: Column) -> Column:
    root = dataset_root(dataset)
    return F.when(root == "ams", F.lit("amsterdam")).otherwise(root)


def dataset_for_videoset(dataset: Column, videoset: Column) -> Column:
    return F.when(videoset == "valid", F.concat(dataset, F.lit("-val"))).otherwise(dataset)


def base_dataset(name: Column) -> Column:
    return F.regexp_replace(name, "-val$", "")


def name_videoset(name: Column) -> Column:
    return F.when(name.endswith("-val"), F.lit("valid")).otherwise(F.lit("test"))


def videoset_of(video: Column) -> Column:
    head = F.substring(video, 1, 2)
    return (F.when(head == "tr", "train").when(head == "va", "valid").when(head == "te", "test"))


def config_label(variant: Column, classifier: Column, sample_rate: Column, threshold: Column,
                 tilepadding: Column, tracker: Column) -> Column:
    label = F.concat_ws(
        " ",
        F.substring(F.coalesce(classifier, F.lit("NA")), 1, 6),
        F.coalesce(F.concat(F.lit("SR"), sample_rate.cast("string")), F.lit("SR-")),
        F.coalesce(F.concat(F.lit("TA"), format_threshold(threshold)), F.lit("TA-none")),
        F.substring(F.coalesce(tilepadding, F.lit("naive")), 1, 6),
        F.substring(F.coalesce(tracker, F.lit("naive")), 1, 6),
    )
    return F.when(variant == "naive", F.lit("Naive")).otherwise(label)


def ms_to_s(ms: Column) -> Column:
    return ms / 1000.0


def time_mspf(seconds: Column, frames: Column) -> Column:
    """Milliseconds per frame."""
    return F.try_divide(seconds * 1000.0, frames.cast("double"))


def video_number(video: Column) -> Column:
    return F.regexp_extract(video, "([0-9]+)", 1).try_cast("bigint")


def collage_name(name: Column) -> list[Column]:
    """Collage, first and last frame of a ``NNNN_start_end`` file name."""
    pattern = "([0-9]+)_([0-9]+)_([0-9]+)"
    return [F.nullif(F.regexp_extract(name, pattern, i), F.lit("")).cast("int").alias(c)
            for i, c in ((1, "collage_idx"), (2, "start_frame"), (3, "end_frame"))]
