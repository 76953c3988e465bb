"""Mix sources to target weights by hash thresholds.

Every document has a fixed hash. A source takes its documents below a threshold of
the hash; the threshold is found from histograms of tokens by hash bucket, refined
only inside the bucket in which the budget ends. Nothing is sorted. Thresholds are
nested: a larger budget keeps all that a smaller one takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackgrid.llm.common import Scratch

#: Levels of the histogram and hash bits of each.
LEVELS, BITS = 5, 12
#: The order of sources repeats these weights.
WEIGHTS = (5, 2, 1)
#: No source and no document is taken more often than this.
MOST = 3


def word_count(column):
    """Words between ASCII white space; NULL has none."""
    return F.coalesce(F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)`` from ``sizes(source, source_size)``, one row per source.

    Weights follow the order of the sources by code point, NULL last. Targets share the
    sum of all sizes by weight and stop at ``most`` times the source's size; the excess is
    shared again by weight until no target is above. A round adds the sources that
    stop; it reads two sums. The table has a row per source of the mix.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    table = scratch.table(sizes.select("source", "source_size", weight.cast("long").alias("w")), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    stopped, capped, share = F.lit(False), -1, F.lit(0.0)
    while True:
        left = table.agg(F.sum(F.when(stopped, F.col("source_size") * most).otherwise(0)), F.sum(F.when(stopped, 0).otherwise(F.col("w"))),
                         F.sum(F.when(stopped, 1).otherwise(0))).first()
        if left[2] is None or left[2] == capped or not left[1]:
            break
        capped = left[2]
        share = F.col("w") * F.lit(int(total - left[0])).cast("long") / F.lit(int(left[1])).cast("long")
        stopped = stopped | (F.col("source_size") * most < share)
    return table.select("source", "source_size", F.when(stopped, F.col("source_size").cast("double") * most).otherwise(share).alias("target"))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix", id_col: str = "doc_id",
        text: str = "text", source: str = "source") -> DataFrame:
    """How often the mix takes each document: all columns plus ``size, source_size, target, taken``.

    A source takes whole passes of its documents and, for the rest of its target, those
    below its hash threshold once more; of the document at the threshold it takes the words
    that are left. So a source misses its target by less than a word, and no document is taken
    more than ``most`` times. The hash depends on ``seed``, id and text alone: reruns and other
    partitionings agree. Rows equal in id and text have one hash; at the threshold they
    share what is left, each less than a word short. Documents without
    words have size 0 and take nothing. NULL ids and sources are values like others; an
    empty table gives an empty result. Very long texts count whole. Other columns pass through; those named as the
    new ones are replaced.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    bucket = F.conv(F.substring(digest, 1, LEVELS * BITS // 4), 16, 10).cast("long")
    drop = [c for c in ("size", "source_size", "target", "taken", "passes", "limit", "left", "held", "_h", "_s") if c in docs.columns]
    sized = docs.drop(*drop).withColumns({"_h": bucket, "size": word_count(F.col(text))})
    slim = scratch.table(sized.select(F.col(source).alias("source"), "_h", "size"), "sizes")

    targets = scratch.table(source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), scratch, weights, most), "targets")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets.withColumn("passes", passes.cast("long")).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))

    # Tokens in full buckets below the threshold, and the threshold's leading bits so far.
    edge = plan.select(F.col("source").alias("s"), "rest", F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("prefix"))
    inside = slim
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        counts = inside.groupBy("source", F.shiftrightunsigned("_h", shift).alias("cell")).agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
        counts = counts.withColumn("upto", upto)
        over = counts.join(edge, F.col("source").eqNullSafe(F.col("s"))).where(F.col("below") + F.col("upto") > F.col("rest"))
        # A source whose documents all fit has no bucket that is over and keeps everything.
        found = over.groupBy("source").agg(F.min("cell").alias("cell"), F.min_by(F.col("upto") - F.col("n"), "cell").alias("step"), F.min_by("n", "cell").alias("held"))
        found = found.withColumnRenamed("source", "f")
        edge = edge.join(found, F.col("s").eqNullSafe(F.col("f"))).select("s", "rest", (F.col("below") + F.col("step")).alias("below"), F.col("cell").alias("prefix"), "held")
        if level < LEVELS:
            edge = scratch.table(edge.drop("held"), "edge")
            here = edge.select("s", "prefix")
            inside = scratch.table(slim.join(here, F.col("source").eqNullSafe(F.col("s")) & (F.shiftrightunsigned("_h", shift) == F.col("prefix"))).select("source", "_h", "size"), "inside")
    left = F.floor(F.col("rest") - F.col("below")).cast("long")
    limits = plan.join(edge.select("s", F.col("prefix").alias("limit"), left.alias("left"), "held"), F.col("source").eqNullSafe(F.col("s")), "left")
    limits = scratch.table(limits.select(F.col("source").alias("_s"), "source_size", "target", "passes", "limit", "left", "held"), "limits")
    for name in ("sizes", "sources", "targets", "edge", "inside"):
        scratch.drop(name)
    joined = sized.join(limits, F.col(source).eqNullSafe(F.col("_s")), "left")
    size = F.col("size")
    # Without a threshold the rest holds the whole source.
    extra = (F.when(F.col("limit").isNull() | (F.col("_h") < F.col("limit")), size)
             .when(F.col("_h") == F.col("limit"), F.expr("size * left div held")).otherwise(0))
    extra = F.when(F.col("passes") * F.col("source_size") >= F.col("target"), 0).otherwise(extra)
    return joined.withColumn("taken", (size * F.col("passes") + extra).cast("long")).drop("_s", "_h", "passes", "limit", "left", "held")
